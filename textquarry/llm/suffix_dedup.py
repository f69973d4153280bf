"""Suffix-array dedup: byte passages that occur anywhere else, found with a logarithmic family of suffix arrays.

A suffix array of every byte would be many times the corpus. The arrays here are *sparse*: they
hold the suffixes at anchors. The anchor of a 200-byte string is the place of its least k-gram by hash
(the first of equal ones), so equal strings have their anchors at equal places, and about one byte in 85 is an
anchor. An array orders its suffixes by the hash of their first k bytes; any order in which equal
beginnings are neighbours serves, as nothing but equality is asked of it.

The index is a family of levels. A new batch of texts gets its array, which is scanned against
each level in one merge on the suffixes' beginnings; beginnings found twice are *seeds* of long
matches. Then the batch becomes a level, and levels of equal size merge, so n batches lie in
log2(n) levels and an array is rewritten log2(n) times. Levels are bucketed tables, so scans
and merges move none of them (plan: no Exchange on either side).

Seeds say where 200 bytes may match; what does is found exactly. The window starts that share an anchor are
a run, and their bytes together a span.

1. A span that occurs in two places is removed from both: all its windows match.
2. A beginning with several different spans (the ends of matches, mostly) is looked into: its
   windows are cut into groups of 16, then 4, then 1 by their distance to the anchor. All windows of
   a group share a core. Equal spans of a group match; groups with a core that no other span has
   end there; others are cut on. Single windows are compared whole, so the answer is
   exact for each byte (up to 128 bits of hash in two halves).

What is collected of a document are its own anchors and intervals. Copies of whole texts are counted first and meet nothing
but their hash. A key with more than its share of rows (a passage in a third of all documents) is joined by
broadcast of the few such keys, all others by a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, Scratch, mix64, slices, tune

#: Bytes of a passage; bytes of a suffix's beginning; windows that are looked at at once.
LENGTH, BEGINNING, CHUNK = 200, 32, 1 << 20
#: Batches that a whole table is added in. Their number does not follow the input: each is a share of it.
BATCHES = 4
#: Windows of the groups that differing spans are cut into, one after the other.
GROUPS = (16, 4, 1)
#: A key with more rows than this, and than one row in SHARE of all, is joined by broadcast; such keys are a few hundred thousand at most.
HOT_ROWS, SHARE = 1000, 1 << 16
#: Bits, at any size of input, of the map that says which texts anything is asked of; bits of a row of it.
BITS, ROW_BITS = 1 << 26, 1 << 15
_PLACE = np.uint64((1 << 24) - 1)


def _grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a byte array; k is a power of two."""
    h, base, n = _BYTE[buf], _BASE, 1
    while n < k:
        h, base, n = h[:-n] * base + h[n:], base * base, 2 * n
    return mix64(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :])


def beginning(length: int) -> int:
    """Bytes of a suffix that seeds are found by: a power of two, a quarter of the passage at most."""
    return min(BEGINNING, 1 << max(length // 4, 1).bit_length() - 1)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, first window, last window, hash of the beginning) of all runs of windows that share an anchor.

    buf holds several texts, offsets where each begins and ends; places count from buf's beginning.
    """
    k = beginning(length)
    lasts = offsets[1:] - length
    for c in range(0, max(len(buf) - length + 1, 0), CHUNK):
        part = buf[c : c + CHUNK + length - 1]
        h = _grams(part, k)
        low = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        at = (low & _PLACE).astype(np.int64)
        edge = np.zeros(len(at) + 1, np.int64)
        whole = (lasts >= np.maximum(offsets[:-1], c)) & (offsets[:-1] < c + len(at))
        np.add.at(edge, np.maximum(offsets[:-1][whole] - c, 0), 1)
        np.add.at(edge, np.minimum(lasts[whole] - c + 1, len(at)), -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(starts):
            continue
        own, text = at[starts], np.searchsorted(offsets, starts + c, "right") - 1
        new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1) | (np.diff(text, prepend=-1) != 0))
        last = np.append(new[1:], len(starts)) - 1
        yield text[new], own[new] + c, starts[new] + c, starts[last] + c, h[own[new]]


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _suffixes(length: int):
    """(d, pos, olo, ohi, g, h) of all anchors: windows begin olo to ohi bytes before pos; g and h are hashes of beginning and span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, off in slices(batch.column(1)):
                view = memoryview(np.ascontiguousarray(buf))
                for text, at, lo, hi, g in anchors(buf, off, length):
                    h = [xxhash.xxh3_64_intdigest(view[a : b + length], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)]
                    columns = [pa.array(ids[i + text]), pa.array((at - off[text]).astype(np.int32)), pa.array((at - hi).astype(np.int32)), pa.array((at - lo).astype(np.int32)), pa.array(g.view(np.int64)), _longs(h)]
                    yield pa.RecordBatch.from_arrays(columns, names=["d", "pos", "olo", "ohi", "g", "h"])

    return run


_CONTEXT = "d long, pos int, clo int, chi int, n long, bytes binary"


def _contexts(length: int):
    """The bytes around the anchors that are asked for: from the first window of the run to the end of its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for d, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                rows += [(d, a["pos"], a["olo"], a["ohi"], a["n"], raw[a["pos"] - a["ohi"] : a["pos"] - a["olo"] + length]) for a in asked]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["d", "pos", "clo", "chi", "n", "bytes"])

    return run


def _cut_on(length: int, width: int):
    """Windows olo to ohi of a context in groups of ``width``: (core, span, d, pos, olo, ohi, n), hashes of what a group's windows share and of all they cover."""

    farthest = length - beginning(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, span, out = [], [], []
            for d, pos, chi, n, raw, olo, ohi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for group in range(olo // width, ohi // width + 1):
                    a, b = group * width, min(group * width + width - 1, farthest)
                    lo, hi = max(a, olo), min(b, ohi)
                    # window o begins chi - o bytes into the context
                    core.append(xxhash.xxh3_64_intdigest(raw[chi - a : chi - b + length], a * 2 + 1))
                    span.append(xxhash.xxh3_64_intdigest(raw[chi - hi : chi - lo + length], lo * 2))
                    out.append((d, pos, lo, hi, n))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([_longs(core), _longs(span), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=["core", "span", "d", "pos", "olo", "ohi", "n"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the intervals that are asked for."""
    for batch in batches:
        rows = []
        for d, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            kept, upto, spans, n = hashlib.sha256(), 0, 0, 0
            for lo, hi in sorted((g["lo"], g["hi"]) for g in gone):
                if lo > upto or not spans:
                    kept.update(raw[upto:lo])
                    spans, upto = spans + 1, lo
                n, upto = n + max(hi - upto, 0), max(hi, upto)
            kept.update(raw[upto:])
            rows.append((d, n, spans, kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["d", "n_removed", "n_spans", "kept"])


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], weight: str, limit: int) -> DataFrame:
    """left joined with right, which has a row for each key and, as ``weight``, the number of left's rows with it.

    Keys of more than ``limit`` rows are few and are broadcast, so that their rows stay where they are.
    """
    hot = right.where(F.col(weight) > limit).drop(weight)
    cold = right.where(F.col(weight) <= limit).drop(weight)
    if hot.isEmpty():
        return left.join(cold, keys)
    few = F.broadcast(hot.select(*keys))
    return left.join(F.broadcast(hot), keys).unionByName(left.join(few, keys, "left_anti").join(cold, keys))


def where_asked(texts: DataFrame, asked: DataFrame, key: str = "d", of: str = "of") -> DataFrame:
    """texts (all rows that are asked for, and few others) before they are shuffled: by a bit map of fixed size that is broadcast.

    A map that is full lets every row pass, and the join that follows decides.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(BITS))
    at = F.floor(place(F.col(of)) / ROW_BITS)
    bits = asked.groupBy(at.alias("_row")).agg(F.bitmap_construct_agg(F.pmod(place(F.col(of)), F.lit(ROW_BITS))).alias("_bits"))  # BITS / ROW_BITS rows of 4 KB
    bit = F.pmod(place(F.col(key)), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = texts.join(F.broadcast(bits), F.floor(place(F.col(key)) / ROW_BITS) == F.col("_row"))
    return known.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*texts.columns)


class SuffixLevels:
    """The family of sparse suffix arrays: (rank, table) of levels, a table (g, n) for each, bucketed and sorted by g.

    g is the hash of a suffix's beginning, n how many suffixes begin so. ``add`` takes the
    suffixes of a batch; ``seeds`` are the beginnings that were found twice until then.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        self.levels: list[tuple[int, str]] = []
        self.found: list[DataFrame] = []

    def _stored(self, array: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        array.write.bucketBy(buckets, "g").sortBy("g").option("path", f"{self.scratch.base}/{name}").saveAsTable(name)
        return name

    def add(self, suffixes: DataFrame) -> None:
        """Array of a batch (g), scan against all levels, then merges of levels of equal rank."""
        name = self._stored(suffixes.groupBy("g").agg(F.count("*").alias("n")))
        array = self.spark.table(name)
        met = [array.where("n > 1").select("g"), *[array.join(self.spark.table(level).select("g"), "g").select("g") for _, level in self.levels]]
        self.found.append(self.scratch.save(reduce(DataFrame.unionByName, met)))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, last = self.levels.pop()
            a, b = self.spark.table(name), self.spark.table(last).withColumnRenamed("n", "m")
            merged = self._stored(a.join(b, "g", "full_outer").select("g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            self.spark.sql(f"DROP TABLE {name}")
            self.spark.sql(f"DROP TABLE {last}")
            self.scratch.forget(name)
            self.scratch.forget(last)
            name, rank = merged, rank + 1
        self.levels.append((rank, name))

    def seeds(self) -> DataFrame:
        """(g, n): beginnings found twice or more, and how often they occur."""
        found = self.scratch.save(reduce(DataFrame.unionByName, self.found).distinct())
        each = [found.join(self.spark.table(name), "g") for _, name in self.levels]
        return self.scratch.save(each[0] if len(each) == 1 else reduce(DataFrame.unionByName, each).groupBy("g").agg(F.sum("n").alias("n")))

    def close(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.forget(name)
        self.levels.clear()


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """What is left of each text without the bytes of passages of ``length`` bytes that also begin elsewhere.

    Returns a row for each row: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the
    bytes that are left. Every place of a repeated passage goes, the first one too; places may
    overlap, in one text as well; texts are UTF-8 bytes and matches never cross them.

    A null text is empty. Rows that repeat an id or both id and text are texts of their own, so rows with equal
    texts of ``length`` bytes or more are removed whole. Ids, null or not, say nothing
    about the passages. Very long texts are looked at in pieces that overlap; a text of one repeated byte has an anchor at every byte. An empty
    table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = scratch.save(docs.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "sha"))
    # 64 bits of the hash name a text; they are drawn anew in the rare case that they do not tell all texts apart.
    draw = 0
    while rows.groupBy(F.xxhash64(F.lit(draw), "sha").alias("d")).agg((F.min("sha") < F.max("sha")).alias("bad")).where("bad").limit(1).count():
        draw += 1
    named = F.xxhash64(F.lit(draw), "sha").alias("d")
    texts = scratch.save(rows.groupBy(named).agg(F.count("*").alias("m"), F.min("id").alias("least")))
    long = docs.where(F.octet_length("text") >= length).select("id", named, "text")

    suffixes = scratch.save(long.select("d", "text").mapInArrow(_suffixes(length), "d long, pos int, olo int, ohi int, g long, h long"))
    limit = max(HOT_ROWS, suffixes.count() // SHARE)
    family = SuffixLevels(spark, scratch)
    for b in range(batches):
        family.add(suffixes.where(F.pmod("d", F.lit(batches)) == b).select("g"))
    seeds = family.seeds()
    family.close()

    # Copies of a text are one place with a count from here on.
    shared = join_spread(suffixes, seeds, ["g"], "n", limit).groupBy("g", "h", "olo", "ohi", "d", "pos").agg(F.count("*").alias("c"))
    shared = scratch.save(shared)
    scratch.drop(suffixes)
    key = ["g", "h", "olo", "ohi"]
    spans = scratch.save(shared.groupBy(*key).agg(F.sum("c").alias("n"), F.count("*").alias("places"), F.min(F.struct("d", "pos")).alias("first")))
    whole = lambda df: df.select("d", (F.col("pos") - F.col("ohi")).alias("lo"), (F.col("pos") - F.col("olo") + length).alias("hi"))
    marks = [scratch.save(whole(join_spread(shared, spans.where("places > 1").select(*key, "places"), key, "places", limit)))]
    several = scratch.save(spans.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"))
    active = scratch.save(join_spread(spans, several, ["g"], "k", limit).select("first.d", "first.pos", "olo", "ohi", "n"))
    scratch.drop(shared)
    scratch.drop(spans)

    def fetch(asked: DataFrame, take: str, schema: str, kernel) -> DataFrame:  # noqa: ANN001
        """Texts with what is asked of each, one row a text: a copy is told from the others by its id."""
        asked = scratch.save(asked.join(texts, "d").where(take).select(F.col("d").alias("of"), "least", "asked"))
        met = where_asked(long, asked.select("of")).join(asked, (F.col("d") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")))
        return scratch.save(met.select("d", "text", "asked").mapInArrow(kernel, schema))

    asked = active.groupBy("d").agg(F.collect_list(F.struct("pos", "olo", "ohi", "n")).alias("asked"))
    around = fetch(asked, "true", _CONTEXT, _contexts(length))
    groups = around.select("d", "pos", "chi", "n", "bytes", F.col("clo").alias("olo"), F.col("chi").alias("ohi"))
    for width in GROUPS:
        cut = scratch.save(groups.mapInArrow(_cut_on(length, width), "core long, span long, d long, pos int, olo int, ohi int, n long"))
        # A text that stands in several equal rows may bring a place twice; a place counts once.
        equal = cut.groupBy("core", "span").agg(F.max("n").alias("n"), F.count("*").alias("places"), F.min(F.struct("d", "pos", "olo", "ohi")).alias("first"), F.max(F.struct("d", "pos", "olo", "ohi")).alias("last"))
        equal = scratch.save(equal.withColumn("two", F.col("first") != F.col("last")))
        marks.append(scratch.save(whole(join_spread(cut, equal.where("two").select("core", "span", "places"), ["core", "span"], "places", limit))))
        several = scratch.save(equal.groupBy("core").agg(F.count("*").alias("k")).where("k > 1"))
        if width > 1:
            active = join_spread(equal, several, ["core"], "k", limit)
            active = scratch.save(active.select("first.d", "first.pos", "first.olo", "first.ohi", F.when(F.col("two"), F.lit(2)).otherwise(F.col("n")).cast("long").alias("n")))
            groups = around.drop("n").join(active, ["d", "pos"]).where("clo <= olo and ohi <= chi").select("d", "pos", "chi", "n", "bytes", "olo", "ohi")
        scratch.drop(cut)
    gone = reduce(DataFrame.unionByName, marks)
    gone = gone.groupBy("d").agg(F.collect_set(F.struct("lo", "hi")).alias("asked"))
    left = fetch(gone, "m = 1", "d long, n_removed long, n_spans long, kept string", _removed)

    rows = rows.withColumn("d", named)
    copies = scratch.save(texts.where("m > 1").select("d", "m"))
    hot = F.broadcast(copies.where(F.col("m") > limit).select("d"))
    single = rows.join(hot, "d", "left_anti").join(copies.where(F.col("m") <= limit).select("d"), "d", "left_anti").join(left, "d", "left")
    done = single.select("id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept"))
    all_of_it = F.col("n_bytes") >= length
    nothing = F.lit(hashlib.sha256().hexdigest())
    twice = join_spread(rows, copies, ["d"], "m", limit).select("id", "n_bytes", F.when(all_of_it, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(all_of_it, 1).otherwise(0).cast("long").alias("n_spans"), F.when(all_of_it, nothing).otherwise(F.col("sha")).alias("kept"))
    return done.unionByName(twice).select(F.col("id").alias(id_col), "n_bytes", F.col("n_removed").cast("long").alias("n_removed"), F.col("n_spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))
