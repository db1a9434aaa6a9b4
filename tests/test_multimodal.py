"""Records with media against what a plain loop writes."""

import base64
import hashlib

from pyspark.sql import functions as F

from mnemex.operators.multimodal import media_items, write_multimodal
from mnemex.shared import Workspace


def test_three_tables(spark):
    b = lambda x: base64.b64encode(x).decode()
    rows = [
        (1, "a picture", [b(b"\x02"), b(b"\x04\x04"), "!no!"], [b(b"hello"), "$", b(b"world")], None),
        (2, None, [b(b"\x00")], None, [b(b"film")]),  # an image that its encoder fails on
        (3, "", None, [b(b"only heard")], []),
        (4, None, [], [], [b(b"film")]),
        (5, "only text", None, None, None),
        (6, "x" * 3000, [b(b"\x02")], None, None),
    ]
    df = spark.createDataFrame(rows, "id long, text string, images array<string>, audio array<string>, video array<string>").repartition(3)
    embed = lambda c: F.when(F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int") > 0, F.array(F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("double"), F.octet_length(c).cast("double")))
    for _ in range(2):  # a repeated write changes nothing
        files, visual, episodes = write_multimodal(df, media_items(df), embed, lambda c: c.cast("string"), Workspace(spark, "test"))
        name = lambda x, end: hashlib.sha256(x).hexdigest() + "." + end
        got = {r.path: (r.kind, r.size, bytes(r.content), r.uses, r.not_encoded) for r in files.collect()}
        assert got == {
            name(b"\x02", "png"): ("image", 1, b"\x02", 2, 0), name(b"\x04\x04", "png"): ("image", 2, b"\x04\x04", 1, 0), name(b"\x00", "png"): ("image", 1, b"\x00", 1, 1), name(b"hello", "wav"): ("audio", 5, b"hello", 1, 0),
            name(b"world", "wav"): ("audio", 5, b"world", 1, 0), name(b"only heard", "wav"): ("audio", 10, b"only heard", 1, 0), name(b"film", "mp4"): ("video", 4, b"film", 2, 0),
        }
        heard = "a picture\n[audio transcription]: hello world"
        assert {r.id: r.content for r in episodes.collect()} == {1: heard, 3: "[audio transcription]: only heard", 5: "only text", 6: "x" * 3000}
        assert {r.id: (r.image_path, r.caption, r.vector) for r in visual.collect()} == {1: (name(b"\x02", "png"), heard, [3.0, 1.5]), 6: (name(b"\x02", "png"), "x" * 1024, [2.0, 1.0])}
    assert [x.count() for x in write_multimodal(df.where("false"), media_items(df.where("false")), embed, lambda c: c.cast("string"), Workspace(spark, "test"))] == [0, 0, 0]


def test_binary_files_are_items_too(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x07")
    (tmp_path / "b.wav").write_bytes(b"sound")
    found = spark.read.format("binaryFile").load(str(tmp_path))
    items = found.select(F.lit(1).cast("long").alias("id"), F.when(F.col("path").endswith(".png"), "image").otherwise("audio").alias("kind"), F.lit(0).alias("position"), "content")
    records = spark.createDataFrame([(1, "t")], "id long, text string")
    files, visual, episodes = write_multimodal(records, items, lambda c: F.array(F.octet_length(c).cast("double")), lambda c: c.cast("string"), Workspace(spark, "test"))
    assert files.count() == 2 and visual.first().vector == [1.0] and episodes.first().content == "t\n[audio transcription]: sound"
