"""Typing, validation and resolution of entities."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import leaky_states

# Pronouns and the types they stand for, and what names of persons and companies look like.
PRONOUNS = [("Person", r"(?i:\b(?:he|she|him|her)\b)|该人|此人"), ("Organization", r"(?i:\b(?:the company|it)\b)|该公司|该企业")]
COMPANY = r"\b[A-Z][A-Za-z]+(?:\s[A-Z][A-Za-z]+)*\s(?:Inc|Corp|Ltd|Group|Labs)\b"
PERSON = r"\b[A-Z][a-z]+\s[A-Z][a-z]+\b"
# Context that decides an ambiguous word.
CONTEXT = {"apple": ["公司", "发布", "iphone", "ipad", "mac", "库克", "手机", "company", "released", "ceo", "tim cook"], "亚马逊": ["公司", "电商", "aws", "云计算", "创始人", "jeff bezos"], "crm": ["销售", "客户", "系统", "软件", "平台"]}
# Families of mentions.
MENTIONS = [
    ("Person", r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"), ("Technology", r"\b(GPT-\d+|BERT|CLIP|ViT|ResNet|DALL.E|T5|LLaMA)\b"), ("Language", r"(?i)\b(Python|JavaScript|TypeScript|Rust|Go|Java|Swift|Kotlin)\b"),
    ("Product", r"\b([A-Z][a-z]+[\d.]+(?:[-\s][A-Za-z\d]+)*)\b"), ("Email", r"\b([\w.-]+@[\w.-]+\.\w+)\b"), ("Url", r"(https?://[^\s,，。]+)"), ("Topic", r"(#\w+)"),
    ("Organization", r"([\x{4e00}-\x{9fff}]{2,8}(?:公司|集团|大学|银行|科技|有限|研究院|中心))"), ("Location", r"([\x{4e00}-\x{9fff}]{2,4}(?:省|市|区|县|路|街道|大厦|广场|桥))"), ("Person", r"([\x{4e00}-\x{9fff}]{2,4}(?:先生|女士|博士|教授|同学|经理|老师|同志))"),
]
# Terms of queries with their English form.
TERMS_ZH = {
    "深度学习": "deep learning", "框架": "framework", "向量": "vector", "图数据库": "graph database", "数据库": "database", "编码器": "encoder", "解码器": "decoder", "神经网络": "neural network", "机器学习": "machine learning", "自然语言": "natural language",
    "训练": "training", "推理": "inference", "离线": "offline", "在线": "online", "加载": "load", "嵌入": "embedding", "相似度": "similarity", "搜索": "search", "检索": "retrieval", "分类": "classification", "回归": "regression", "聚类": "clustering",
    "社区": "community", "梦境": "dream", "记忆": "memory", "知识图谱": "knowledge graph", "超图": "hypergraph", "图查询": "graph query", "监听": "monitor", "健康": "health", "错误": "error", "恢复": "recovery", "备份": "backup", "缓存": "cache",
    "索引": "index", "重建": "rebuild", "部署": "deploy", "容器": "container", "服务器": "server", "爬虫": "crawler",
}
# What first persons say of themselves, in order of precedence.
PROFILE_ZH = [("住在", "identity"), ("我是", "identity"), ("我住", "identity"), ("职业", "work"), ("工作于", "work"), ("工作", "work"), ("喜欢", "preferences"), ("偏好", "preferences"), ("爱好", "preferences"), ("擅长", "preferences"), ("讨厌", "preferences"), ("习惯", "preferences")]
PROFILE_EN = [("i live in", "identity"), ("i work at", "work"), ("my favorite", "preferences")]


def resolve_pronouns(text: Column) -> Column:
    """Each pronoun becomes the nearest name of its type before it; it stays where there is none.

    Names and pronouns are marked in one pass, the text is cut at the marks, and one fold over the pieces remembers the last name of each type."""
    of = dict(PRONOUNS)
    pieces = F.split(F.regexp_replace(text, f"{COMPANY}|{PERSON}|{of['Person']}|{of['Organization']}", "\x01$0\x02"), "[\x01\x02]")
    nobody = F.lit(None).cast("string")
    start = F.struct(F.lit("").alias("out"), nobody.alias("person"), nobody.alias("company"), F.lit(False).alias("marked"))

    def step(a: Column, piece: Column) -> Column:
        is_ = lambda pattern: a["marked"] & piece.rlike(f"^(?:{pattern})$")
        company = is_(COMPANY)
        person = ~company & is_(PERSON)
        said = F.when(is_(of["Person"]), F.coalesce(a["person"], piece)).when(is_(of["Organization"]), F.coalesce(a["company"], piece)).otherwise(piece)
        return F.struct(F.concat(a["out"], said).alias("out"), F.when(person, piece).otherwise(a["person"]).alias("person"), F.when(company, piece).otherwise(a["company"]).alias("company"), (~a["marked"]).alias("marked"))

    return F.aggregate(pieces, start, step)["out"]


def disambiguate(text: Column, word: str) -> Column:
    low = F.lower(text)
    hit = F.exists(F.array(*map(F.lit, CONTEXT[word])), lambda k: low.contains(k))
    return F.when(hit, "Organization").otherwise("ambiguous")


def mentions(text: Column) -> Column:
    """Array of (kind, name) of all families, each once."""
    def family(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    return F.array_distinct(F.concat(*[family(kind, p) for kind, p in MENTIONS]))


def normalise_query(text: Column) -> Column:
    """Full-width punctuation becomes space, terms get their English form, spaces are squeezed."""
    out = F.translate(text, "，。！？；：、（）《》【】", " " * 13)
    for zh, en in TERMS_ZH.items():
        out = F.replace(out, F.lit(zh), F.lit(f" {en} "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def profile_candidates(nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """Direct statements in the first person, with the value of the first phrase that occurs."""
    text = F.trim(F.col(text_col))
    low = F.lower(text)
    hits = []
    for phrase, grp in PROFILE_ZH + PROFILE_EN:
        here = text if phrase > "z" else low
        tail = F.expr(f"substring({text_col}, locate('{phrase}', lower({text_col})) + {len(phrase)})")
        hits.append(F.when(here.contains(phrase), F.struct(F.lit(grp).alias("grp"), tail.alias("tail"))))
    first = nodes.where((F.col("source_type") == "direct") & low.rlike(r"^(我|我的|my\b|i\b)")).withColumn("_hit", F.coalesce(*hits)).where("_hit IS NOT NULL")
    value = F.regexp_replace(F.split(F.col("_hit.tail"), r"[，。！？、；,.!?;]")[0], r"[\s，。！？、；：,.!?;:'\"()（）【】\[\]的]+", "")
    value = F.regexp_replace(value, "^是", "")
    return first.select("*", F.col("_hit.grp").alias("grp"), value.alias("value")).where(F.length("value") >= 2).drop("_hit")


def validate(rules: list[tuple[str, dict]]) -> Column:
    """Array of errors of a row: required, min, max, enum."""
    errors = []
    for name, r in rules:
        c = F.col(name)
        if r.get("required"):
            errors.append(F.when(c.isNull() | (F.trim(c.cast("string")) == ""), f"{name}:required"))
        if "min" in r or "max" in r:
            errors.append(F.when(~c.between(r.get("min", float("-inf")), r.get("max", float("inf"))), f"{name}:range"))
        if "enum" in r:
            errors.append(F.when(~c.isin(r["enum"]), f"{name}:enum"))
    return F.filter(F.array(*errors), lambda x: x.isNotNull())


def priority(degree: Column, nodes: Column, freshness: Column) -> Column:
    return F.when(nodes > 0, degree / nodes * (1 + freshness)).otherwise(0.0)


def level(strategy: Column, reranks: Column) -> Column:
    return F.when(strategy == "hybrid", "fusion").when((strategy == "auto") & reranks, "fusion").otherwise("hypergraph")


def write_gate(writes: DataFrame, source: str, order: list[str], value: Column, warmup: int = 100, threshold: float = 0.5) -> DataFrame:
    """``place, hidden, gate, kept`` of each write of a source: a leaky state of squashed inputs; kept during warm-up, then where state and input together pass the threshold."""
    states = leaky_states(writes, source, order, 0.1 * F.tanh(value), 0.9, value)
    gate = 1 / (1 + F.exp(-(0.5 * F.col("state") + 0.5 * F.col("carry"))))
    return states.select(source, "place", F.col("state").alias("hidden"), gate.alias("gate"), ((F.col("place") <= warmup) | (gate > threshold)).alias("kept"))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _keys(name: Column, least: float) -> Column:
    """Two names whose ratio is at least ``least`` (over 2/3) share one of these.

    Matched pieces of one letter each need a letter that isn't matched between any two of them, so M letters in such pieces give a ratio of at most
    2M / (3M - 1): either two letters in a row are shared, or both names together have at most 2 / (3 least - 2) letters. Short names also have their letters as keys.
    """
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: name.substr(i, F.lit(n)))
    none = F.array().cast("array<string>")
    pairs = F.when(F.length(name) > 1, cut(2)).otherwise(none)
    return F.array_distinct(F.concat(pairs, F.when(F.length(name).between(1, int(2 / (3 * least - 2) + 1e-9)), cut(1)).otherwise(none)))


def align(left: DataFrame, right: DataFrame, left_near: DataFrame, right_near: DataFrame, least: float = 0.75, least_shared: float = 0.6) -> DataFrame:
    """Best partner of each name of ``left`` (name) in ``right`` (other): exact 1.0, else by lexical ratio, else by the Jaccard of neighbours.

    ``left_near`` (name, neighbour) and ``right_near`` (other, neighbour) hold the neighbours. Ties go to the first name in order.
    """
    if least <= 2 / 3:
        raise ValueError("the keys cover lexical ratios over 2/3")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    lexical_ratio = F.pandas_udf(_ratios, "double")  # the built-in distance is another measure
    a, b = left.select("name", norm("name").alias("x")).distinct(), right.select("other", norm("other").alias("y")).distinct()
    exact = a.join(b, F.col("x") == F.col("y")).select("name", "other", F.lit(0).alias("step"), F.lit(1.0).alias("score"))
    fits = F.least(F.length("x"), F.length("y")) * 2 >= least * (F.length("x") + F.length("y"))
    met = a.withColumn("key", F.explode(_keys(F.col("x"), least))).join(b.withColumn("key", F.explode(_keys(F.col("y"), least))), "key").where(fits & (F.col("x") != F.col("y"))).select("name", "other", "x", "y").distinct()
    lexical = met.select("name", "other", F.lit(1).alias("step"), lexical_ratio("x", "y").alias("score")).where(F.col("score") >= least)
    m = left_near.select("name", norm("neighbour").alias("near")).distinct().join(left, "name", "left_semi")
    n = right_near.select("other", norm("neighbour").alias("near")).distinct().join(right, "other", "left_semi")
    common = m.join(n, "near").groupBy("name", "other").agg(F.count("*").alias("both"))
    sized = common.join(m.groupBy("name").agg(F.count("*").alias("p")), "name").join(n.groupBy("other").agg(F.count("*").alias("q")), "other")
    shared = sized.select("name", "other", F.lit(2).alias("step"), (F.col("both") / (F.col("p") + F.col("q") - F.col("both"))).alias("score")).where(F.col("score") >= least_shared)
    best = exact.union(lexical).union(shared).groupBy("name").agg(F.min(F.struct("step", (-F.col("score")).alias("minus"), "other")).alias("b"))
    return best.select("name", F.col("b.other").alias("match"), F.round(-F.col("b.minus"), 6).alias("score"))
