"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the host suffixes and path prefixes that some rule could
have, each expression is hashed, joined to the rules on the first 32 bits of the
digest, and a hit counts only if the whole digest agrees. Of the rules that fit a URL the longest
wins (host and path together), then the one with the longer host, then block over allow.

How far a URL is expanded follows from the rules (most labels of a host, longest
path, lengths of paths that don't end in a slash), so a hostile URL
with thousands of labels or slashes stays bounded. Rules are broadcast if they are
few; else they are joined by shuffle, with the URLs of a hot host salted.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule;
an empty path starts with no rule's ``/``; repeated rows are judged each; several verdicts on one
rule count as block; no rules: every URL gets the default; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import within

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BROADCAST_RULES = 200_000
SALTS = 16


def host_and_path(url) -> tuple:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``id, host, path, rule, verdict``, one row per row of ``pages``."""
    ruled = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("v"))  # block sorts after allow
    expr = F.concat("host", "path")
    ruled = ruled.select(
        F.substring(F.sha2(expr, 256), 1, 8).alias("r_short"),
        F.sha2(expr, 256).alias("r_digest"),
        F.struct(F.length(expr).alias("length"), F.length("host").alias("host_length"), (F.col("v") == "block").alias("block"), expr.alias("rule"), F.col("v").alias("verdict")).alias("r"),
    )
    bounds = rules.agg(  # one row, no longer than the longest rule
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("longest"),
        F.collect_set(F.when(~F.col("path").endswith("/"), F.length("path"))).alias("lengths"),
    ).first()
    labels, longest = bounds.labels or 0, bounds.longest or 0

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("uid"))
    parts = F.slice(F.split("host", r"\."), -labels, labels) if labels else F.array().cast("array<string>")
    parts = F.when(F.size(F.split("host", r"\.")) >= labels, parts).otherwise(F.split("host", r"\."))
    suffixes = F.transform(parts, lambda _, i: F.concat_ws(".", F.slice(F.col("parts"), i + 1, F.greatest(F.size("parts") - i, F.lit(0)))))
    cut = F.split(F.substring("path", 1, longest), "/")
    prefixes = F.transform(F.slice("cut", 1, F.greatest(F.size("cut") - 1, F.lit(0))), lambda _, i: F.concat(F.concat_ws("/", F.slice(F.col("cut"), 1, i + 1)), F.lit("/")))
    fixed = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(bounds.lengths or [])]).cast("array<string>")
    urls = urls.select("*", F.when(F.col("host") != "", parts).otherwise(F.array().cast("array<string>")).alias("parts"), cut.alias("cut"))
    urls = urls.select("id", "host", "path", "uid", suffixes.alias("suffixes"), F.array_distinct(F.filter(F.concat(prefixes, fixed), lambda p: p.isNotNull())).alias("prefixes"))
    exprs = urls.select("id", "host", "path", "uid", F.explode_outer("suffixes").alias("s"), "prefixes").select("id", "host", "path", "uid", "s", F.explode_outer("prefixes").alias("p"))
    digest = F.sha2(F.concat("s", "p"), 256)
    exprs = exprs.select("id", "host", "path", "uid", digest.alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    same = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest"))
    if within(ruled, broadcast_rules):
        hits = exprs.join(F.broadcast(ruled), same, "left")
    else:
        salted = ruled.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = exprs.join(salted, same & (F.pmod("uid", F.lit(SALTS)) == F.col("r_salt")), "left")
    best = hits.groupBy("uid", "id", "host", "path").agg(F.max("r").alias("r"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))


def op1(pages: DataFrame) -> DataFrame:
    return judge_urls(pages, rule_table(pages.sparkSession, RULES))


ORACLE = """
WITH rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
m AS (
  SELECT u.*, rh || rp AS rule, v,
    row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, v DESC) AS k
  FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
