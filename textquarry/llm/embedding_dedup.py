"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation that makes the signs of the rotated components balanced bits is learned on a
bounded sample. Every vector gets a code of as many keys as there are tables, and the i-th
table files it under its i-th key. Keys get a bit longer whenever the largest label doubles, so
that a bucket holds about as many vectors at any size, and there are as many tables as it then
takes for two vectors at the threshold to share a key with probability FOUND. Of what meets in a
bucket, pairs whose whole codes differ in more bits than vectors at the threshold do are passed
over, and the others are compared by cosine, in double precision, on the original vectors; a
pair counts in the first table in which it meets, and only there.

Equal vectors are one class with a multiplicity. A table's bucket is cut into blocks of
bounded size and every pair of blocks is one unit of work, which gives a count for each class
and a spanning set of links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, main_dimension, matrix, runs, tune, usable, vector_sample

#: Vectors of the sample that the rotation is learned from, and rounds of learning.
SAMPLE, ROUNDS = 20_000, 30
#: Vectors of the largest label to a key, about; least bits of a key; probability that two vectors at the threshold meet.
BUCKET, LEAST_BITS, FOUND = 128, 8, 0.985
#: Standard deviations beyond the mean Hamming distance at the threshold that a pair may lie.
SLACK = 5
#: Classes of a block.
BLOCK = 1024
#: More buckets that need several blocks than this are joined by a shuffle.
BROADCAST_BUCKETS = 100_000


def rotations(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` signs): principal directions, rotated by iterative quantisation.

    Vectors of fewer dimensions than bits get several rotations from different beginnings.
    """
    dim = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    x = sample - mean
    values, axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(dim))
    axes = axes[:, np.argsort(-values)][:, : min(bits, dim)]
    seed, out = np.random.default_rng(7), []
    while sum(o.shape[1] for o in out) < bits:
        z = x @ axes
        turn = np.linalg.qr(seed.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = (u @ w).T
        out.append(axes @ turn)
    return mean, np.hstack(out)[:, :bits]


def tables(most: int, least: float) -> tuple[int, int, int]:
    """(bits of a key, tables, largest Hamming distance) for so many vectors of a label and a threshold."""
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, most) / BUCKET))))
    differ = math.acos(min(1.0, max(-1.0, least))) / math.pi  # share of bits in which vectors at the threshold differ
    met = (1 - differ) ** bits
    number = max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - met))) if met < FOUND else 1
    n = number * bits
    return bits, number, math.ceil(n * differ + SLACK * math.sqrt(n * differ * (1 - differ)) + 1)


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int) -> np.ndarray:
    """Rows of keys of so many bits."""
    signs = ((x - mean) @ projection >= 0).reshape(len(x), -1, bits)
    return (signs << np.arange(bits, dtype=np.int32)).sum(2, dtype=np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _filed(shared, dim: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = shared.value
        for batch in batches:
            code = codes(unit(matrix(batch.column(3), dim)), mean, projection, bits)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "code"])

    return run


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest row reachable for each row of a symmetric boolean matrix."""
    root = np.arange(len(links))
    rows, cols = np.nonzero(links)
    while len(rows):
        low = root.copy()
        np.minimum.at(low, rows, root[cols])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _near(x: np.ndarray, y: np.ndarray, code: np.ndarray, other: np.ndarray, bits: int, radius: int, least: float) -> np.ndarray:
    """Which rows of x and y have codes near enough and a cosine of least or more."""
    signs = lambda c: (((c[:, :, None] >> np.arange(bits)) & 1) * 2 - 1).reshape(len(c), -1).astype(np.float32)
    near = signs(code) @ signs(other).T >= code.shape[1] * bits - 2 * radius
    if near.mean() > 0.1:  # then the product of all is cheaper than picking
        return near & (x @ y.T >= least)
    rows, cols = np.nonzero(near)
    for i in range(0, len(rows), 1 << 14):
        r, c = rows[i : i + (1 << 14)], cols[i : i + (1 << 14)]
        near[r, c] = (x[r] * y[c]).sum(1) >= least
    return near


def _linked(dim: int, least: float, bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            node, many, side = (table[c].to_numpy() for c in ("node", "many", "side"))
            which = int(table["bucket"][0].as_py())
            x = unit(matrix(table["v"], dim))
            code = table["code"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            order = np.lexsort((node, side))
            node, many, side, x, code = node[order], many[order], side[order], x[order], code[order]
            n = len(x)
            if side.any():  # two blocks: only pairs across
                cut = int(np.searchsorted(side, True))
                hit = np.zeros((n, n), bool)
                hit[:cut, cut:] = _near(x[:cut], x[cut:], code[:cut], code[cut:], bits, radius, least)
                hit |= hit.T
            else:
                hit = _near(x, x, code, code, bits, radius, least)
                hit |= hit.T
                np.fill_diagonal(hit, False)
            rows, cols = np.nonzero(hit)
            first = ~(code[rows, :which] == code[cols, :which]).any(1) if which else np.ones(len(rows), bool)
            counted = np.zeros(n, np.int64)
            np.add.at(counted, rows[first], many[cols[first]])
            root = _roots(hit)
            at = np.flatnonzero((counted > 0) | (root != np.arange(n)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(counted[at]), pa.array(node[root[at]])], names=["node", "links", "other"])

    return run


def near_dedup(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine ``least`` or more between vectors of one label: id, n_links, component_id, kept.

    n_links counts the other rows linked directly; component_id is the smallest id reachable by
    links, itself included; kept tells whether the row has it. Vectors that are null, zero, hold
    null or non-finite components or have another dimension than most, and rows with a null
    label, link with nothing. Repeated rows are rows of their own and link with each other; a
    null id stays null, and is kept only where nothing else names its component. An empty
    table gives no rows. Other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    dim = main_dimension(rows.where(usable(F.col("v"))))
    good = F.col("label").isNotNull() & usable(F.col("v")) & (F.size("v") == dim)
    rows = rows.withColumn("node", F.when(good, F.xxhash64("label", "v")))
    classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("many"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.save(classes.select("node", "many", F.xxhash64("label").alias("label"), "v"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, number, radius = tables(most, least)
    mean, projection = rotations(unit(vector_sample(classes, SAMPLE, dim)) if dim else np.zeros((0, 1)), bits * number)
    shared = spark.sparkContext.broadcast((mean, projection))
    filed = classes.mapInArrow(_filed(shared, dim, bits), f"node long, many long, label long, v {rows.schema['v'].dataType.simpleString()}, code array<int>")
    places = F.transform("code", lambda c, i: F.xxhash64("label", i, c))
    filed = filed.select("node", "many", "v", "code", F.posexplode(places).alias("bucket", "place"))
    filed = scratch.save(filed)

    large = filed.groupBy("place").count().where(F.col("count") > BLOCK).select("place", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = scratch.save(large)
    if large.count() <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    cut = filed.join(large, "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = cut.select(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "bucket", "node", "many", (F.col("own") > F.col("other")).alias("side"), "v", "code")
    found = met.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(dim, least, bits, radius), "node long, links long, other long")
    found = scratch.save(found)
    links = scratch.save(found.groupBy("node").agg(F.sum("links").alias("links")))
    groups = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)

    named = rows.select("id", "node").join(classes.select("node", "many"), "node", "left").join(links, "node", "left").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = scratch.save(named)
    smallest = scratch.save(named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("smallest")))
    named = named.join(smallest, "comp", "left")
    component = F.when(F.col("comp").isNotNull(), F.col("smallest")).otherwise(F.col("id"))
    return named.select(
        F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("many") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
