"""Quality rules per document and per host, in DataFrame functions only.

Base rules fail single documents. For hosts more rules count (``RULES``): too few or repeated words, repeated lines, symbols, and words of odd length. Failures of each
rule are aggregated by host, each host's rate is
shrunk towards a beta prior fitted to all hosts (method of moments, rule by rule), and a host whose
shrunken rate of some rule passes ``max_rate`` fails with all its documents. A document that fails a rule other than the base is kept if its host is.

Five-word windows are compared by 64-bit hashes within one text. Arrays are only ever combined element
by element or sorted, so a text costs n log n at most; nothing is exploded. Only one row of sums reaches the driver. The features
are written once, then joined to the bad hosts (broadcast if few, else a join AQE can split).

Defined results: null or empty text: no words, base_failed; a null host is never judged as a host and its
documents keep their own verdict; equal rows are judged each; empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace, within

SPACE = r"[\x20\x09-\x0D]+"
MAX_RATE = 0.5
BROADCAST_HOSTS = 20_000
#: What counts against a host, over the features of a document; a document without words fails the base rule only.
RULES = {
    "base": "base_failed",
    "lines": "n_words > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "symbols": "n_words > 0 AND 10 * n_symbols > word_chars",
    "lengths": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
}


def _shift(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def features(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    df = df.select(
        "doc_id", "host", "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    df = df.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("h2", F.zip_with("h1", _shift(F.col("h1"), 1), pair))
    df = df.withColumn("h4", F.zip_with("h2", _shift(F.col("h2"), 2), pair))
    windows = F.slice(F.zip_with("h4", _shift(F.col("h1"), 4), pair), 1, F.greatest(F.size("h1") - 4, F.lit(0)))
    df = df.withColumn("windows", windows).withColumn("sorted", F.sort_array("windows"))
    df = df.withColumn("repeats", F.exists(F.zip_with("sorted", _shift(F.col("sorted"), 1), lambda a, b: a == b), lambda x: x))
    places = F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("places", places)
    twins = F.zip_with("places", _shift(F.col("places"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    covered = F.zip_with("starts", _shift(F.col("starts"), 1), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(feats: DataFrame) -> DataFrame:
    """``host, n`` and, of each rule, how many documents fail it and their rate, shrunk by the beta prior that fits all hosts."""
    hosts = feats.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.expr(rule).cast("long")).alias(f"failed_{name}") for name, rule in RULES.items()))
    sums = [F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")]
    for name in RULES:
        x = F.col(f"failed_{name}").cast("double")
        sums += [F.sum(x).alias(f"f_{name}"), F.sum(x * x / F.col("n")).alias(f"ffn_{name}")]
    s = hosts.agg(*sums).first()
    rates = []
    for name in RULES:
        if not s.k:
            rates.append(F.lit(None).cast("double").alias(f"rate_{name}"))
            continue
        mean = s[f"f_{name}"] / s.n
        inside = mean * (1 - mean)
        spread = (s[f"ffn_{name}"] - s[f"f_{name}"] * mean) - (s.k - 1) * inside
        room = s.n - s.nn / s.n
        between = spread / room if room > 0 else 0.0
        strength = min(max(inside / between - 1, 2.0), 1e6) if between > 0 else 1e6
        rates.append(((F.col(f"failed_{name}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{name}"))
    return hosts.select("*", *rates)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Features, ``base_failed``, ``kept`` and ``host_failed`` (the first rule that the host fails, else null) per row of ``docs``."""
    ws = Workspace(docs.sparkSession, "quality")
    feats = ws.save(features(docs, id_col, text_col, host_col), "features")
    failed = F.coalesce(*(F.when(F.col(f"rate_{name}") > max_rate, name) for name in RULES))
    bad = ws.save(host_rates(feats).select("host", failed.alias("host_failed")).where("host_failed IS NOT NULL"), "bad-hosts")
    joined = feats.join(F.broadcast(bad) if within(bad, BROADCAST_HOSTS) else bad, "host", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"), "host_failed")


def op10(docs: DataFrame) -> DataFrame:
    return judge_quality(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, words[i:i+4] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM g),
o AS (SELECT rid, i, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS cov FROM c WHERE k > 1),
r AS (SELECT rid, sum(cov) AS rep FROM o GROUP BY rid),
f AS (SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
             len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON w.rid = r.rid),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
u AS (SELECT source, 1 AS k, 'base' AS rule, base_failed AS x FROM b UNION ALL SELECT source, 2, 'lines', n_words > 0 AND 10 * n_dup_lines > 3 * n_lines FROM b
      UNION ALL SELECT source, 3, 'symbols', n_words > 0 AND 10 * n_symbols > word_chars FROM b UNION ALL SELECT source, 4, 'lengths', n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) FROM b),
h AS (SELECT source, k, rule, count(*)::DOUBLE AS n, sum(x::INT)::DOUBLE AS x FROM u WHERE source IS NOT NULL GROUP BY ALL),
s AS (SELECT k, count(*) AS hosts, sum(n) AS nt, sum(x) AS ft, sum(n * n) AS nn, sum(x * x / n) AS ffn FROM h GROUP BY k),
p AS (SELECT k, ft / nt AS m, ft / nt * (1 - ft / nt) AS v, (ffn - ft * ft / nt - (hosts - 1) * (ft / nt * (1 - ft / nt))) / nullif(nt - nn / nt, 0) AS bt FROM s),
q AS (SELECT k, m, CASE WHEN bt > 0 THEN least(greatest(v / bt - 1, 2.0), 1e6) ELSE 1e6 END AS st FROM p),
bad AS (SELECT source, arg_min(rule, k) AS host_failed FROM h JOIN q USING (k) WHERE (x + m * st) / (n + st) > 0.5 GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_failed IS NULL AS kept, host_failed FROM b LEFT JOIN bad USING (source)
"""
