"""A consolidation run: eight written stages, of which a run that was cut off repeats no more than it must.

Each stage is a table in the folder of the run, complete when Spark's marker lies beside its files. A run that finds a stage complete reads it; from the first one that isn't on, stages run again, since they start from what the ones before wrote. So a lost executor costs tasks, a lost
driver a stage, and a run that ended gives its report again without any work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import passing_shuffles
from .communities import louvain
from .temporal import is_prunable, keep_last

EPISODES, QUOTED, KEYWORDS, WORDS, CONTENT = 20, 5, 20, 500, 2000


def _complete(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class Run:
    """Stages of one run, by name, in the order in which they are asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.again, self.ran = spark, root, False, []

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if self.again or not _complete(self.spark, path):
            self.again = True  # what comes after starts from this
            self.ran.append(name)
            with passing_shuffles(self.spark):
                make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def consolidate(
    nodes: DataFrame, edges: DataFrame, root: str, cluster: Callable[[DataFrame], DataFrame] = louvain, most_pruned: float = 0.5, at: str = "1970-01-01 00:00:00", previous: str = "0" * 64
) -> tuple[DataFrame, Run]:
    """The report, a row, and the run, whose stages are tables: ``gather``, ``cluster``, ``synthesise``, ``compress``, ``prune``, ``resolve``, ``persist``, ``report``.

    ``nodes``: id, content, source, tau (now), protected, age (seconds), degree, quarantine; ``edges``: src, dst, weight; ``cluster`` gives (id, community). Communities need two members. Nodes that have faded go, unless more than ``most_pruned`` of all would.
    Of members with equal contents (without regard to case and blanks at the ends) the one with the highest tau stays, the smallest id on a tie, and takes over the others' contents. ``persist`` has every node as it should be after the run: content, version, whether it is archived.
    The report's hash covers what was done and the hash of the run before.
    """
    run = Run(nodes.sparkSession, root)
    gathered = run.stage("gather", lambda: nodes.where("NOT quarantine AND id IS NOT NULL").select("id", "content", "source", "tau", "protected", "age", "degree"))

    def clustered() -> DataFrame:
        here = gathered.select("id")
        inside = edges.join(here.toDF("src"), "src", "left_semi").join(here.toDF("dst"), "dst", "left_semi").select("src", "dst", "weight")
        found = cluster(inside).join(here, "id", "left_semi")
        large = found.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2").select("community")
        return found.join(large, "community", "left_semi").select("id", "community")

    members = run.stage("cluster", clustered)

    def synthesised() -> DataFrame:
        own = members.join(gathered, "id")
        sizes = own.groupBy("community").agg(F.count("*").alias("size"))
        few = keep_last(own.select("community", "id", F.substring(F.coalesce("content", F.lit("")), 1, 100).alias("t")), ["community"], [F.col("id")], EPISODES)
        listed = few.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("e"))
        sources = keep_last(own.where("source IS NOT NULL").select("community", "source").distinct(), ["community"], [F.col("source")], 3).groupBy("community").agg(F.array_sort(F.collect_list("source")).alias("topics"))
        quoted = F.array_join(F.transform(F.slice("e", 1, QUOTED), lambda x: x["t"]), "; ")
        report = F.concat(F.lit("Community "), "community", F.lit(": "), "size", F.lit(" members. "), quoted)
        both = sizes.join(listed, "community").join(sources, "community", "left")
        return both.select("community", "size", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.transform("e", lambda x: x["id"]).alias("episodes"), report.alias("report"))

    reports = run.stage("synthesise", synthesised)

    def compressed() -> DataFrame:
        short = reports.withColumn("report", F.array_join(F.slice(F.filter(F.split("report", " "), lambda x: x != ""), 1, WORDS), " "))
        words = short.select("community", F.explode(F.regexp_extract_all(F.lower("report"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word")).groupBy("community", "word").agg(F.count("*").alias("n"))
        best = keep_last(words, ["community"], [F.desc("n"), F.col("word")], KEYWORDS).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), lambda x: x["word"]).alias("keywords"))
        return short.join(best, "community", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))

    short = run.stage("compress", compressed)

    def pruned() -> DataFrame:
        faded = gathered.select("id", F.coalesce(is_prunable(F.col("tau"), F.col("protected"), F.col("age"), F.col("degree")), F.lit(False)).alias("gone"))
        share = faded.agg(F.avg(F.col("gone").cast("double"))).first()[0] or 0.0
        return faded.where(F.col("gone") & F.lit(share <= most_pruned)).select("id")

    gone = run.stage("prune", pruned)

    def resolved() -> DataFrame:
        own = members.join(gathered, "id").join(gone, "id", "left_anti").where("content IS NOT NULL").select("community", "id", "tau", F.sha2(F.lower(F.trim("content")), 256).alias("digest"))
        best = own.groupBy("community", "digest").agg(F.max(F.struct("tau", (-F.col("id")).alias("n"))).alias("b"), F.count("*").alias("n")).where("n > 1").select("community", "digest", (-F.col("b.n")).alias("winner"))
        return own.join(best, ["community", "digest"]).where("id <> winner").select(F.col("id").alias("loser"), "winner")

    merges = run.stage("resolve", resolved)

    def persisted() -> DataFrame:
        first = keep_last(merges, ["winner"], [F.col("loser")], 1).join(gathered.select(F.col("id").alias("loser"), F.col("content").alias("other")), "loser").select(F.col("winner").alias("id"), "other")
        taken = merges.groupBy(F.col("winner").alias("id")).agg(F.count("*").alias("merged"))
        marked = gathered.join(gone.withColumn("faded", F.lit(True)), "id", "left").join(merges.select(F.col("loser").alias("id"), F.col("winner").alias("merged_into")), "id", "left").join(taken, "id", "left").join(first, "id", "left")
        content = F.when(F.col("merged").isNotNull(), F.substring(F.concat("content", F.lit(" | merged: "), "other"), 1, CONTENT)).otherwise(F.col("content"))
        archived = F.coalesce("faded", F.lit(False)) | F.col("merged_into").isNotNull()
        return marked.join(members, "id", "left").select("id", content.alias("content"), "community", archived.alias("archived"), "merged_into", F.coalesce("merged", F.lit(0)).alias("merged"), (1 + F.coalesce(F.signum("merged"), F.lit(0))).cast("int").alias("version"))

    after = run.stage("persist", persisted)

    def reported() -> DataFrame:
        one = lambda df, *cols: df.agg(*cols).first()  # noqa: E731  a row of sums
        c = one(short, F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.size("keywords")), F.lit(0)).alias("words"), F.coalesce(F.sum(F.size("topics")), F.lit(0)).alias("topics"), F.coalesce(F.sum(F.size("episodes")), F.lit(0)).alias("episodes"))
        p = one(after, F.count("*").alias("n"), F.count_if("archived").alias("archived"), F.count_if(F.col("merged") > 0).alias("updated"))
        counts = {"communities": c.n, "members": c.size, "topics": c.topics, "episodes": c.episodes, "keywords": c.words, "pruned": gone.count(), "conflicts": merges.count(), "updated": p.updated, "size_before": p.n, "size_after": p.n - p.archived}
        said = "|".join([previous, *(f"{k}={v}" for k, v in counts.items()), at])
        return nodes.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], F.lit(at).alias("at"), F.lit(previous).alias("previous"), F.sha2(F.lit(said), 256).alias("hash"))

    return run.stage("report", reported), run
