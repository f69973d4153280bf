"""What the operators of this package share: scratch tables, word hashes, held-out splits, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, ship  # noqa: F401

#: Rows that Spark hands to Python at once. Texts may be long, so batches are kept short.
ARROW_ROWS = 512
#: Bytes of text that the vectorised kernels work on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """What the Arrow stages rely on: short batches, and this package on the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text leaves ``rest`` mod ``mod``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def learns(doc_id: Column, mod: int, rest: int) -> Column:
    """The complement of held_out; a null id neither is held out nor teaches."""
    return doc_id.isNotNull() & ~held_out(doc_id, mod, rest)


# --------------------------------------------------------------------------- word hashes

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, _BASE, np.uint64)]))
_LANE = _SEED.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and the number of them in each text.

    buf holds the UTF-8 bytes of all texts, offsets where each begins (and the end).
    """
    global _powers
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    low = _LOWER[buf]
    word = ~_SPACE[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(buf)]
    begins[first] = word[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    spans = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, spans)
    while len(_powers) < spans.max():
        _powers = np.concatenate([_powers, _powers * (_powers[-1] * _BASE)])
    value = _BYTE[low[starts[0] :]] * _powers[place]
    value *= word[starts[0] :]
    return mix64(np.add.reduceat(value, starts - starts[0])), np.diff(np.searchsorted(starts, offsets))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) for runs of texts of about SLICE_BYTES; null texts are empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def ngram_hashes(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the index of their text; shorter texts give the whole sequence as one."""
    n = len(h)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        lane = h[j:] * _LANE[j]
        total[: n - j] += lane ^ (lane >> np.uint64(29))
    whole = np.arange(n) + k <= ends[doc] if n else np.zeros(0, bool)
    out, where = total[whole], doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        rest = []
        for i in short:
            x = np.uint64(counts[i]) * _LANE[63]
            for j, w in enumerate(h[ends[i] - counts[i] : ends[i]]):
                lane = w * _LANE[j]
                x = x + (lane ^ (lane >> np.uint64(29)))
            rest.append(x)
        out, where = np.concatenate([out, np.array(rest, np.uint64)]), np.concatenate([where, short])
    return mix64(out), where


def distinct_in_text(h: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h without repeats inside a text, sorted by text and hash."""
    order = np.argsort(where, kind="stable")
    h, where = h[order], where[order]
    if not len(h):
        return h, where
    bounds = np.flatnonzero(np.diff(where, prepend=-1, append=where[-1] + 1))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        h[i:j].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (where[1:] != where[:-1])
    return h[keep], where[keep]


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node in edges; comp is the smallest node reachable.

    Alternating large-star and small-star steps on a table of edges. Minima are taken with
    groupBy, so that a hub is pre-aggregated before the shuffle, and are joined back, so that
    the rows of a hub can be split. Each step is written to the shared folder; the driver
    sees a count and a checksum only.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = scratch.save(e)
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        last, e = e, scratch.save(small)
        scratch.drop(last)
    return e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


# --------------------------------------------------------------------------- vectors


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first column, of rows that come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else [0]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if held and key[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Neither null nor zero, with finite components only."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def main_dimension(vectors: DataFrame, column: str = "v") -> int:
    """The dimension that most vectors have (the smaller of two); 0 for none."""
    found = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def vector_sample(vectors: DataFrame, most: int, dim: int, column: str = "v") -> np.ndarray:
    """At most ``most`` distinct vectors, those of lowest hash, in a fixed order."""
    hashed = vectors.where(F.size(column) == dim).select(F.xxhash64(column).alias("h"), F.col(column).alias("v"))
    count = hashed.agg(F.approx_count_distinct("h")).first()[0]
    if count > 2 * most:  # only hashes that low are sorted; the estimate is far better than this allows for
        hashed = hashed.where(F.pmod("h", F.lit(1 << 40)) < int(1.5 * most / count * (1 << 40)))
    rows = hashed.groupBy("h").agg(F.first("v").alias("v")).orderBy(F.pmod("h", F.lit(1 << 40)), "h").limit(most).toArrow()
    return np.unique(matrix(rows["v"], dim), axis=0) if rows.num_rows else np.zeros((0, dim))
