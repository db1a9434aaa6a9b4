"""Writes of records with media: payloads become files, vectors and transcripts.

Payloads are base64 text, or binary content of files (``binaryFile``). Each is one row from the start, so a record with many large ones is spread over tasks; encoders see Arrow batches of contents. What can't be decoded, or is larger than ``LARGEST``, is left out; what an encoder
fails on (null) keeps its file and is marked, so a failing model loses no data. Three tables are written and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Workspace
from ..sources.files import MEDIA

LARGEST = 10 * 1024 * 1024  # characters of a payload
CAPTION = 1024
HEARD = "[audio transcription]: "
Encoder = Callable[[Column], Column]


def media_items(records: DataFrame) -> DataFrame:
    """``id, kind, position, content`` of records (id, images, audio, video: arrays of base64 text, may be null)."""
    parts = []
    for kind, column in (("image", "images"), ("audio", "audio"), ("video", "video")):
        item = records.select("id", F.lit(kind).alias("kind"), F.posexplode(column).alias("position", "payload")).where(F.length("payload") <= LARGEST)
        parts.append(item.select("id", "kind", "position", F.try_to_binary("payload", F.lit("base64")).alias("content")))
    return parts[0].union(parts[1]).union(parts[2]).where("content IS NOT NULL")


def write_multimodal(records: DataFrame, items: DataFrame, embed: Encoder, transcribe: Encoder, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes files, visual nodes and episodes of records (id, text) with media items (id, kind, position, content).

    ``embed`` makes an array of doubles of an image's content, ``transcribe`` text of audio; null where they fail. Files are named by their content, so equal ones are one file and a repeated write changes nothing.
    A visual node has the mean of its images' vectors and the record's text as caption; an episode the text and what was heard, in order."""
    digest = F.sha2("content", 256)
    ending = F.create_map(*[F.lit(x) for kind, ends in MEDIA.items() for x in (kind, ends[0])])[F.col("kind")]
    heard = F.when(F.col("kind") == "audio", transcribe(F.when(F.col("kind") == "audio", F.col("content"))))
    seen = F.when(F.col("kind") == "image", embed(F.when(F.col("kind") == "image", F.col("content"))))
    read = items.select("id", "kind", "position", F.concat(digest, F.lit("."), ending).alias("path"), F.octet_length("content").cast("long").alias("size"), "content", heard.alias("heard"), seen.alias("vector"))
    read = ws.save(read.withColumn("encoded", (F.col("kind") == "video") | F.col("heard").isNotNull() | F.col("vector").isNotNull()), "read")
    files = ws.save(read.groupBy("path").agg(F.first("kind").alias("kind"), F.first("size").alias("size"), F.first("content").alias("content"), F.count("*").alias("uses"), F.count_if(~F.col("encoded")).alias("not_encoded")), "files")

    said = read.where("kind = 'audio' AND heard <> ''").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "heard"))), lambda x: x["heard"]), " ").alias("transcription"))
    merged = F.concat_ws("\n", F.nullif("text", F.lit("")), F.concat(F.lit(HEARD), "transcription"))
    episodes = ws.save(records.select("id", "text").join(said, "id", "left").select("id", merged.alias("content"), "transcription").where("content <> ''"), "episodes")

    values = read.where("vector IS NOT NULL").select("id", "position", F.posexplode("vector").alias("dim", "x"))
    mean = values.groupBy("id", "dim").agg(F.avg("x").alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("vector"))
    first = read.where("kind = 'image'").groupBy("id").agg(F.min_by("path", "position").alias("image_path"), F.count("*").alias("images"))
    nodes = mean.join(first, "id").join(episodes.select("id", F.substring("content", 1, CAPTION).alias("caption")), "id", "left")
    visual = ws.save(nodes.select("id", "image_path", "images", F.coalesce("caption", F.lit("")).alias("caption"), "vector"), "visual")
    return files, visual, episodes
