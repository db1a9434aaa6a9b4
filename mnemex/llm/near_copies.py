"""Near copies by word shingles: fingerprints and sketches propose pairs, exact Jaccard similarity decides, and an exact join by rare shingles finds what they missed.

A text is the set of its shingles of five words. Texts of one set are one class. Classes are proposed as pairs where their SimHash fingerprints are near (operator 6: anchors within 4 of 64 bits), and where one of ``BANDS`` groups of ``ROWS`` minimum hashes agrees: two sets
with similarity s agree in a group with probability s**ROWS, so of pairs at 0.8 all but (1 - 0.8**5)**14 = 0.4 % are proposed by groups alone, of closer ones less are missed. Each pair is then compared by the sets themselves.

A group that more than ``CROWD`` classes share isn't paired off. Its classes are dealt out to blocks; in a block sixteen leaders are taken, half of them those that agree most with what most of the block's sketches say (the text that all are copies of), and each class is proposed with the three leaders
whose sketches are nearest to its own. Leaders of several blocks meet in turn, until one block is left. So pairs grow with the number of classes, not with its square.

Links found so far make components. What is missing are links between two of them, and none of those is lost (``rest``). A set has n - ceil(LEAST n) items at most that a near one lacks, so a class with more items of its own component alone is done with; that is seen on the part ``PART`` of all items first, which
leaves few classes, and on all items of those. With items in one order, two sets that share at least k items share one of the first n - k + 1 of each: classes meet by those, the rarest items first. Any order does, and any items may pass for shared: those that many of ``SAMPLE`` texts have do and come last, which
saves work and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import Workspace, within
from .simhash import SEED, fingerprint, near_links

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 14, 5
CROWD, BLOCK, LEADERS, NEAREST = 32, 4096, 16, 3
SMALL = 500_000  # keys sent to all tasks
MAYBE = 0.55  # of a sketch's estimate, to be proposed with a leader
SAMPLE, COMMON = 8192, 131_072  # texts looked at for the order of items, and items that come last in it
PART = 307  # of 1,024 items, by which classes are first told apart
_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Different hashes of the shingles, ascending; a text of fewer words is one shingle, one without words has none. A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    cut = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut), dtype=np.uint64))


def sketch(own: np.ndarray) -> np.ndarray:
    """Minima of the hashes under each of the random maps, upper halves."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), 4096):
        mixed = FACTORS[:, None] * own[i : i + 4096][None, :] + SHIFTS[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.record_batch({"item": pa.array(shingle_set(text.as_py()).view("<i8"))})


def common_items(texts: DataFrame, ws: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Items that several of a sample of different texts have, ascending, and how many."""
    marked = texts.select("text", F.xxhash64("text").alias("mark"))
    marks = ws.save(marked.select("mark").distinct().orderBy("mark").limit(SAMPLE), "sample")
    sampled = marked.join(F.broadcast(marks), "mark").dropDuplicates(["mark"]).select("text")
    often = sampled.mapInArrow(_items, "item long").groupBy("item").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "item").limit(COMMON).toArrow()  # bounded by ``COMMON``
    items = often["item"].to_numpy().view("<u8")
    order = np.argsort(items)
    return items[order], often["n"].to_numpy()[order]


def weights(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many texts of the sample have each of the items; 0 for those that aren't common."""
    items, n = common
    if not len(items):
        return np.zeros(len(own), dtype=np.int64)
    at = np.minimum(np.searchsorted(items, own), len(items) - 1)
    return np.where(items[at] == own, n[at], 0)


def lacking(n):
    """The most items of a set of n that a near one can lack: numbers or columns."""
    return n - (F.ceil(LEAST * n - 1e-9) if isinstance(n, Column) else int(np.ceil(LEAST * n - 1e-9)))


def _read(common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(i, 1024) for part in batches for i in range(0, part.num_rows, 1024)):
            rows, first = [], [np.zeros(0, dtype=np.uint64)]
            for text in batch.column(1):
                text = text.as_py()
                own = shingle_set(text)
                marks = sketch(own)
                bands = [xxhash.xxh64_intdigest(marks[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)] if len(own) else []
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), fingerprint(text), np.array(bands, dtype="<u8").view("<i8").tolist(), marks.tobytes(), len(own)))
                part = own[(own & np.uint64(1023)) < PART]
                first.append(part[weights(part, common.value) == 0])
            digests, fps, bands, marks, sizes = zip(*rows, strict=True)
            ends = np.cumsum([len(x) for x in first], dtype=np.int32)
            yield pa.record_batch({
                "key": batch.column(0), "digest": pa.array(digests, pa.binary()), "fp": pa.array(np.array(fps, dtype="<u8").view("<i8")), "bands": pa.array(bands, pa.list_(pa.int64())), "marks": pa.array(marks, pa.binary()),
                "n": pa.array(sizes, pa.int64()), "rare": pa.array([len(x) for x in first[1:]], pa.int64()), "first": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view("<i8"))),
            })

    return run


def _entries(common: Broadcast):
    """All items of texts that aren't common, and of common ones, in their order, as many as may be among the first that are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, root, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = shingle_set(text)
                weight = weights(own, common.value)
                plain = int((weight == 0).sum())
                at = np.lexsort((own, weight))[: max(plain, lacking(len(own)) + 1)]
                same = {k: pa.array(np.full(len(at), v, dtype=np.int64)) for k, v in (("no", no), ("root", root), ("n", len(own)), ("plain", plain))}
                yield pa.record_batch({"item": pa.array(own[at].view("<i8")), "weight": pa.array(weight[at].astype(np.int64)), **same})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets themselves, by 32 bits of each hash."""
    for batch in batches:
        items = [np.unique((shingle_set(x.as_py()) >> np.uint64(32)).astype("<u4")).tobytes() for x in batch.column(1)]
        yield pa.record_batch({"head": batch.column(0), "items": pa.array(items, pa.binary())})


def _lead(group: pa.Table) -> pa.Table:
    """For the classes of a block of a crowd: pairs with their nearest leaders, and the leaders."""
    heads = group.column("head").to_pylist()
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), "<u4").reshape(len(heads), -1)
    order = np.argsort([xxhash.xxh64_intdigest(m.tobytes()) for m in marks], kind="stable")  # any order that doesn't depend on how rows were dealt
    common = np.empty(marks.shape[1], dtype=marks.dtype)
    for j in range(marks.shape[1]):
        values, n = np.unique(marks[:, j], return_counts=True)
        common[j] = values[n.argmax()]
    agree = (marks == common).sum(axis=1)
    central = order[np.argsort(-agree[order], kind="stable")][: LEADERS // 2]
    leaders = np.unique(np.r_[central, order[: LEADERS - len(central)]])
    alike = np.stack([(marks == marks[i]).mean(axis=1) for i in leaders], axis=1)
    best = np.argsort(-alike, axis=1, kind="stable")[:, : NEAREST + 1]
    a, b = [], []
    for i in range(len(heads)):
        near = [int(leaders[j]) for j in best[i] if leaders[j] != i and alike[i, j] >= MAYBE][:NEAREST]
        a += [heads[i]] * len(near)
        b += [heads[j] for j in near]
    kind = group.schema.field("head").type
    lead = [heads[i] for i in leaders]
    return pa.table({
        "band": pa.array([group.column("band")[0].as_py()] * (len(a) + len(lead)), pa.int64()), "a": pa.array(a + lead, kind), "b": pa.array(b + [None] * len(lead), kind),
        "marks": pa.array([None] * len(a) + [marks[i].tobytes() for i in leaders], pa.binary()),
    })


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        close = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))  # no copies
            both = len(np.intersect1d(x, y, assume_unique=True))
            close.append(both >= LEAST * (len(x) + len(y) - both))
        yield pa.record_batch(batch.filter(pa.array(close, pa.bool_())).columns[:2], names=["src", "dst"])


def proposals(heads: DataFrame, ws: Workspace) -> DataFrame:
    """``a, b``: pairs of classes (head, fp, bands, marks) that may be near."""
    kind = heads.schema["head"].dataType.simpleString()
    lows = ws.save(heads.groupBy("fp").agg(F.min("head").alias("low")), "lows")
    pairs = heads.join(lows, "fp").where("head <> low").select(F.col("head").alias("a"), F.col("low").alias("b"))
    links = near_links(lows.select("fp"), ws, crowds=False)  # ``rest`` sees to what crowds leave out
    pairs = pairs.union(links.join(lows.toDF("src", "a"), "src").join(lows.toDF("dst", "b"), "dst").select("a", "b"))
    banded = heads.select("head", F.explode("bands").alias("band"))
    sizes = ws.save(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    banded = ws.save(banded.join(sizes, "band"), "banded")
    few = banded.where(F.col("n") <= CROWD).select("band", "head")
    pairs = pairs.union(few.toDF("band", "a").join(few.toDF("band", "b"), "band").where("a < b").select("a", "b"))
    now = ws.save(banded.where(F.col("n") > CROWD).join(heads.select("head", "marks"), "head").select("band", "head", "marks", "n"), "crowd-0")
    for turn in range(1, 10):
        if within(now, 0):
            break
        dealt = now.withColumn("block", F.pmod(F.xxhash64("marks"), F.ceil(F.col("n") / BLOCK)).cast("int"))
        led = ws.save(dealt.groupBy("band", "block").applyInArrow(_lead, f"band long, a {kind}, b {kind}, marks binary"), f"led-{turn}")
        pairs = pairs.union(led.where("b IS NOT NULL").select("a", "b"))
        several = now.where(F.col("n") > BLOCK).select("band").distinct()
        leaders = led.where("b IS NULL").select("band", F.col("a").alias("head"), "marks").join(several, "band", "left_semi")
        counted = leaders.groupBy("band").agg(F.count("*").alias("n"))
        now = ws.save(leaders.join(counted, "band").select("band", "head", "marks", "n"), f"crowd-{turn}")
    return ws.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def rest(read: DataFrame, classes: DataFrame, comps: DataFrame, texts: DataFrame, common: Broadcast, ws: Workspace) -> DataFrame:
    """``a, b``: pairs of classes (head, digest, n, rare) of different components (node, component) that may be near; none that is near is left out. ``read`` has the rare items of a part (digest, first).

    The rows of an item's largest component meet the others but not each other.
    """
    number = F.xxhash64("digest")  # rows of what meets stay short; sets are told apart by digests
    each = Window.partitionBy("item")
    entries = read.select(number.alias("no"), F.explode("first").alias("item"))
    several = entries.withColumn("low", F.min("no").over(each)).withColumn("high", F.max("no").over(each)).where("low < high")
    met = ws.save(several.select("item", "no").distinct(), "met")
    comps = comps.withColumnRenamed("node", "head")
    known = classes.join(F.broadcast(comps) if within(comps, SMALL) else comps, "head", "left").select("head", number.alias("no"), F.xxhash64(F.coalesce("component", "head")).alias("root"), "n", "rare")
    known = ws.save(known, "known")
    shared = met.join(known.select("no", "root"), "no").withColumn("low", F.min("root").over(each)).withColumn("high", F.max("root").over(each)).where("low < high")
    shared = ws.save(shared.groupBy("no").agg(F.count("*").alias("shared")), "shared")
    left = known.join(shared, "no", "left").where(F.col("rare") - F.coalesce("shared", F.lit(0)) <= lacking(F.col("n"))).where("n > 0")
    left = ws.save(left.select("head", "no", "root"), "left")
    held = texts.join((F.broadcast(left) if within(left, SMALL) else left).withColumnRenamed("head", "key"), "key").select("no", "root", "text")
    entries = held.mapInArrow(_entries(common), "item long, weight long, no long, root long, n long, plain long")
    several = entries.withColumn("low", F.min("root").over(each)).withColumn("high", F.max("root").over(each)).withColumn("often", F.count("*").over(each)).where("low < high")
    met = ws.save(several.drop("low", "high").distinct(), "met-all")
    own = Window.partitionBy("no")
    place = F.row_number().over(own.orderBy("weight", F.when(F.col("weight") == 0, F.col("often")), "item"))  # after the items of one component, which meet nothing
    placed = met.withColumn("before", F.col("plain") - F.count(F.when(F.col("weight") == 0, 1)).over(own)).withColumn("place", F.col("before") + place)
    met = ws.save(placed.where(F.col("place") <= lacking(F.col("n")) + 1).select("item", "no", "root", "n", "place"), "met-first")
    sizes = met.groupBy("item", "root").agg(F.count("*").alias("k")).groupBy("item").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"))
    met = ws.save(met.join(sizes.where("roots > 1").select("item", F.col("top.root").alias("main")), "item"), "met-main")
    x = met.select("item", F.col("no").alias("a"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("place").alias("i"), "main")
    y = met.select("item", F.col("no").alias("b"), F.col("root").alias("s"), "n", F.col("place").alias("j"))
    least = lambda total: F.ceil(LEAST / (1 + LEAST) * total - 1e-9)  # noqa: E731  items that sets of so many items together share, if they are near
    x = x.where(F.col("i") <= F.col("m") - least(2 * F.col("m")) + 1)  # of the smaller set
    must = least(F.col("m") + F.col("n"))
    near = (F.col("m") >= LEAST * F.col("n") - 1e-9) & (F.col("i") <= F.col("m") - must + 1) & (F.col("j") <= F.col("n") - must + 1)
    both = x.where("r <> main").join(y, "item").where("r <> s AND (m < n OR m = n AND a < b)").where(near).select("a", "b")
    both = both.union(x.where("r = main").join(met.where("root <> main").select("item", F.col("no").alias("b"), "n", F.col("place").alias("j")), "item").where("m < n OR m = n AND a < b").where(near).select("a", "b"))
    found = ws.save(both.distinct(), "found")
    named = found.join(known.select(F.col("head").alias("x"), F.col("no").alias("a")), "a").join(known.select(F.col("head").alias("y"), F.col("no").alias("b")), "b")
    return ws.save(named.select(F.col("x").alias("a"), F.col("y").alias("b")), "rest")


def compared(pairs: DataFrame, texts: DataFrame, ws: Workspace, table: str) -> DataFrame:
    """``src, dst``: the pairs (a, b) of texts (key, text) whose sets have a similarity of ``LEAST`` or more."""
    kind = texts.schema["key"].dataType.simpleString()
    asked = ws.save(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), f"{table}-asked")
    held = texts.join(F.broadcast(asked) if within(asked, SMALL) else asked, "key", "left_semi")
    sets = ws.save(held.mapInArrow(_sets, f"head {kind}, items binary").groupBy("head").agg(F.max("items").alias("items")), f"{table}-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return ws.save(both.mapInArrow(_compare, f"src {kind}, dst {kind}"), table)


def near_copies(docs: DataFrame, key_col: str, text_col: str, ws: Workspace | None = None) -> DataFrame:
    """``key, component``: one row for each row, with the smallest key that links of ``LEAST`` or more reach; keys are to tell texts apart. Texts without a word are one class."""
    ws = ws or Workspace(docs.sparkSession, "near-copies")
    kind = docs.schema[key_col].dataType.simpleString()
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_items(texts, ws))
    read = ws.save(texts.mapInArrow(_read(common), f"key {kind}, digest binary, fp long, bands array<long>, marks binary, n long, rare long, first array<long>"), "read")
    heads = ws.save(read.groupBy("digest").agg(F.min("key").alias("head")), "heads")
    first = read.join(heads.withColumnRenamed("head", "key"), ["key", "digest"], "left_semi").dropDuplicates(["digest"])
    classes = ws.save(first.select(F.col("key").alias("head"), "digest", "fp", "bands", "marks", "n", "rare"), "classes")
    links = compared(proposals(classes, ws), texts, ws, "links")
    comps = ws.save(connected_components(links), "components")
    more = compared(rest(read, classes, comps, texts, common, ws), texts, ws, "more")
    if not within(more, 0):
        comps = connected_components(comps.toDF("src", "dst").union(more))
    comps = comps.withColumnRenamed("node", "head")
    rooted = ws.save(heads.join(comps, "head", "left").select("digest", F.coalesce("component", "head").alias("component")), "rooted")
    return read.select("key", "digest").join(rooted, "digest").select("key", "component")
