"""Files beside the tables: benchmark instances, media, rules and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string>"
INSTANCE = f"question_id long, question_type string, question string, answer string, haystack_sessions array<array<{TURN}>>, haystack_dates array<string>"
# Endings of media files.
MEDIA = {"image": ["png", "jpg", "jpeg", "gif", "webp"], "audio": ["wav", "mp3", "ogg", "flac", "m4a"], "video": ["mp4", "webm", "mov", "mkv"]}


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def benchmark_instances(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Instances with ``dates``, the times of their sessions; one a line, or (``multi_line``) arrays over a whole file. Dates like 2023/05/20 (Sat) 02:21; others are null."""
    rows = spark.read.schema(INSTANCE).option("multiLine", multi_line).json(path)
    plain = F.transform("haystack_dates", lambda d: F.try_to_timestamp(F.regexp_replace(d, r"\s*\([^)]*\)\s*", " "), F.lit("yyyy/MM/dd HH:mm")))
    return rows.withColumn("dates", plain)


def save_media(files: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as a table in the folder, committed at once; names that would leave it and rows without content are left out."""
    safe = files.where(~F.col("name").contains("/") & ~F.col("name").contains("..") & F.col("content").isNotNull())
    safe.write.mode("overwrite").parquet(folder)


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, kind, size, content`` of the media of a folder: of a table that ``save_media`` wrote, or of plain files."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "name string, kind string, size long, content binary")
    if _exists(spark, f"{folder}/_SUCCESS"):
        rows = spark.read.parquet(folder).select("name", "content")
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    ending = F.lower(F.element_at(F.split("name", r"\."), -1))
    kind = F.coalesce(*[F.when(ending.isin(ends), name) for name, ends in MEDIA.items()])
    return rows.select("name", kind.alias("kind"), F.octet_length("content").cast("long").alias("size"), "content").where("kind IS NOT NULL")


def alias_files(spark: SparkSession, path: str) -> DataFrame:
    """``alias, entity`` of JSON lines with a map ``aliases``; missing files and broken lines give nothing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "alias string, entity string")
    rows = spark.read.schema("aliases map<string,string>").option("mode", "DROPMALFORMED").json(path)
    return rows.where("aliases IS NOT NULL").select(F.explode("aliases").alias("alias", "entity"))


def rule_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, parent, keys`` of type rules: a JSON object a line with a map ``types`` of structs (parent, keys). Missing files, broken lines and JSON that is no such object give nothing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "name string, parent string, keys array<string>")
    rows = spark.read.schema("types map<string,struct<parent:string,keys:array<string>>>").option("mode", "DROPMALFORMED").json(path)
    return rows.where("types IS NOT NULL").select(F.explode("types").alias("name", "rule")).where("rule IS NOT NULL").select("name", "rule.parent", F.coalesce("rule.keys", F.array().cast("array<string>")).alias("keys"))


def skill_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, body`` of the skills of a folder, one file each."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "name string, body string")
    found = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.url_decode(F.regexp_extract("path", r"/skill=([^/]*)/", 1))
    return found.select(F.url_decode(name).alias("name"), F.regexp_replace("value", r"\n\z", "").alias("body"))


def export_skills(skills: DataFrame, folder: str, most: int = 3) -> None:
    """Writes skills (name, body) as files in folders of their own: the first ``most`` names that aren't there yet; those that are stay as they are."""
    new = skills.where("name IS NOT NULL AND name <> ''").join(skill_files(skills.sparkSession, folder).select("name"), "name", "left_anti").orderBy("name").limit(most)
    new.select(F.col("name").alias("skill"), F.col("body").alias("value")).write.mode("append").partitionBy("skill").text(folder)
