"""Vector code compression: product codes from integer codebooks, assigned behind segment-mean lower bounds.

Components become integers, floor(4096 * x), and vectors are cut into parts; each part position
has a codebook of 16 entries that rounds of assigning and averaging improve. All of it is exact
integer arithmetic, so results do not depend on how rows are dealt.

How a part finds its nearest entry. Cut x and an entry c into blocks of length l, and write a block as its
mean and a residual. The squared distance is, block by block, l * (difference of means)^2 plus
the squared distance of the residuals, which is no less than the squared difference of their norms. So

    |x - c|^2  >=  sum over blocks of  l * (m_x - m_c)^2 + (r_x - r_c)^2

and the bound grows as blocks are halved: the next finer one splits each residual into means
again. The coarsest bound (one block) is taken for every entry; the entry that it favours gets
its exact distance, which is the first limit. Entries whose bound lies beyond the limit go; those left
get the next finer bound and are filtered again; what survives all levels gets exact integer
distances. Bounds are in floating point and give way by more than their rounding error (SLACK), so no entry
is lost that might be nearest or tie.

A round is one pass over the vectors: each task assigns its rows and adds up the parts of every
entry, and (part, entry, component) sums are added by a shuffle that is pre-aggregated to
16 x dimension rows a task. Codebooks, 16 x dimension integers, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from .common import Scratch, main_dimension, tune

#: Entries of a codebook, parts of a vector, rounds; what one is worth in the integers.
ENTRIES, PARTS, ROUNDS, SCALE = 16, 8, 6, 4096
#: Components beyond this, once integers, count as not finite: sums of them could pass 38 digits.
LARGEST = float(2**62)
#: Integers below this, divided by a part's components, have exact distances and sums of squares in 64 bits; larger ones take Python's.
NARROW = 2**30
#: Share of the squares involved by which a bound gives way.
SLACK = 1e-9
#: Rows of label totals (about 60 bytes each) that are broadcast; more are joined by a shuffle, rows of a label dealt over SALTS.
BROADCAST_LABELS, SALTS = 200_000, 16


def _fitting(x: np.ndarray, length: int) -> np.ndarray:
    """Integers as 64 bits where parts of that length have exact distances in them, else Python's."""
    return x.astype(np.int64) if not x.size or np.abs(x).max() < NARROW // length else x.astype(object)


def _integers(column: pa.Array, cuts: list[tuple[int, int]]) -> np.ndarray:
    """floor(SCALE * x) of rows of a list column."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, cuts[-1][1])
    return _fitting(x.astype(np.int64), cuts[0][1])


def bounds_of(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end: equal ones, or the first longer by one where they can't be."""
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _levels(length: int) -> list[list[tuple[int, int]]]:
    """Blocks of a part, one, then two, four and so on, while they hold two components or more."""
    out, n = [], 1
    while n == 1 or n * 2 <= length:
        out.append(bounds_of(length, n))
        n *= 2
    return out


def _summary(x: np.ndarray, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Means, scaled by the root of the block's length, and residual norms: (rows, blocks) each.

    length * squares - sum^2 is a whole number, taken exactly before it is divided, so that the
    norm is right to the last bits however small it is beside the mean.
    """
    mean, rest = [], []
    for i, j in blocks:
        part, n = x[:, i:j], j - i
        total = part.sum(1)
        left = n * (part * part).sum(1) - total * total
        mean.append(total.astype(np.float64) / np.sqrt(n))
        rest.append(np.sqrt(left.astype(np.float64) / n))
    return np.stack(mean, 1), np.stack(rest, 1)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, ties to the lower one; its squared distance; exact distances taken) of each row."""
    n, k, length = len(x), len(book), x.shape[1]
    if not n or not length:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    exact = lambda rows, entries: ((x[rows] - book[entries]) ** 2).sum(1)
    best = index = rows = entries = None
    for level, blocks in enumerate(_levels(length)):
        (mx, rx), (mc, rc) = _summary(x, blocks), _summary(book, blocks)
        give = SLACK * ((mx**2 + rx**2).sum(1).max() + (mc**2 + rc**2).sum(1).max() + 1)
        if level == 0:
            bound = (mx - mc.T) ** 2 + (rx - rc.T) ** 2
            index = bound.argmin(1)
            best = exact(np.arange(n), index)
            rows, entries = np.nonzero(bound <= best.astype(np.float64)[:, None] + give)
        else:
            bound = ((mx[rows] - mc[entries]) ** 2 + (rx[rows] - rc[entries]) ** 2).sum(1)
            keep = bound <= best[rows].astype(np.float64) + give
            rows, entries = rows[keep], entries[keep]
    distance = exact(rows, entries)
    order = np.lexsort((entries, distance, rows)) if distance.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], distance[i], entries[i])), np.int64)
    first = order[np.unique(rows[order], return_index=True)[1]]
    return entries[first], distance[first], len(rows) + n


def _sums(books: list[np.ndarray], cuts: list[tuple[int, int]]):
    """One row for each part, entry and component that a task's rows touch: (part, entry, at, total, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = cuts[-1][1]
        total = np.zeros((ENTRIES, dim), object)
        count = np.zeros((len(cuts), ENTRIES), np.int64)
        for batch in batches:
            x = _integers(batch.column(0), cuts)
            for p, (i, j) in enumerate(cuts):
                entry, _, _ = nearest_entries(x[:, i:j], books[p])
                for e in np.unique(entry):
                    at = entry == e
                    total[e, i:j] += x[at, i:j].sum(0).astype(object)
                    count[p, e] += int(at.sum())
        rows = [(p, int(e), at, Decimal(int(total[e, at])), int(count[p, e])) for p, (i, j) in enumerate(cuts) for e in np.flatnonzero(count[p]) for at in range(i, j)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "at", "total", "n"])

    return run


def _coded(books: list[np.ndarray], cuts: list[tuple[int, int]]):
    """The id, label, code and error of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(0), cuts)
            code, error = [], np.zeros(len(x), object)
            for p, (i, j) in enumerate(cuts):
                entry, distance, _ = nearest_entries(x[:, i:j], books[p])
                code.append(entry)
                error = error + distance.astype(object)
            text = ["".join(f"{e:02x}" for e in row) for row in np.stack(code, 1).tolist()] if len(x) else []
            errors = pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(text, pa.string()), errors], names=["id", "label", "code", "error"])

    return run


def _finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < LARGEST)), F.lit(False))


def train(kept: DataFrame, dim: int, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of each part after the rounds; kept: (id, v) of usable vectors of dim components."""
    cuts = bounds_of(dim, parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow().column(0).combine_chunks()
    start = _integers(first, cuts)
    books = [start[:, i:j] for i, j in cuts]
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(books, cuts), "part int, entry int, at int, total decimal(38,0), n long")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.astype(object) for b in books]
        for row in sums.collect():  # 16 x dim rows
            books[row["part"]][row["entry"], row["at"] - cuts[row["part"]][0]] = int(row["total"]) // row["n"]
        books = [_fitting(b, cuts[0][1]) for b in books]
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal integers joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """Product codes of all vectors: id, code, error, label_error, codebooks_sha256.

    code: an entry for each part, two hex digits each. error: squared integer distance of the
    vector to its code. label_error: error summed over equal labels, nulls together. An error beyond 64 bits is null.

    Vectors that are null or empty or hold null or non-finite components are dropped, and so are those
    that have other than the most frequent number of components, or one beyond 10^15. Fewer vectors than
    entries give fewer entries. Ties of distance go to the lower entry, and of ids, among the
    first entries, to the smaller vector; a null id comes last. Repeated rows count and are coded each. A number of components that
    is no multiple of ``parts`` makes the first parts longer by one. An empty table gives no rows. Other
    columns are not read. The caller's plan is evaluated once for each round.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(_finite(F.col("v")))
    dim = main_dimension(kept.where(F.size("v") > 0))
    types = {f.name: f.dataType for f in vectors.schema.fields}
    fields = [StructField("id", types[id_col]), StructField("label", types[label_col]), StructField("code", StringType()), StructField("error", DecimalType(38, 0))]
    if dim:
        kept = kept.where(F.size("v") == dim)
        books = train(kept, dim, parts, rounds)
        coded = scratch.save(kept.select("v", "id", "label").mapInArrow(_coded(books, bounds_of(dim, parts)), StructType(fields)))
        name = fingerprint(books)
    else:
        coded, name = spark.createDataFrame([], StructType(fields)), fingerprint([])
    totals = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("total")))
    fits = lambda c: F.when(F.abs(c) < F.lit(Decimal(2**63)), c.cast(LongType()))
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals.withColumnRenamed("label", "of"))
        joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = totals.select(F.col("label").alias("of"), "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = coded.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)) == F.col("salt")))
    return joined.select(F.col("id").alias(id_col), "code", fits(F.col("error")).alias("error"), fits(F.col("total")).alias("label_error"), F.lit(name).alias("codebooks_sha256"))
