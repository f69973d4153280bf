"""Many query vectors at once: the k most cosine-similar rows of each, exactly.

Query vectors are broadcast in blocks of bounded size and rows are never shuffled: each task multiplies its
Arrow batches with a block's matrix, keeps the k best of every query as a partial aggregate,
and hands on k rows a query. What is shuffled is queries x k x tasks rows of three numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..runtime import Scratch, ship

#: Bytes of the query vectors (as doubles) that are broadcast at once.
QUERY_BYTES = 16 << 20
#: Rows that are multiplied with all queries at once, and candidates that are measured at once.
BLOCK_ROWS, CANDIDATES = 2048, 1 << 15
#: More than the rounding of a product of matrices can make of a cosine.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, with finite components only."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Best:
    """The k best rows seen of each query: similarity first, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.sqrt((queries * queries).sum(1))
        self.unit = queries / self.norms[:, None]
        self.least = np.full(len(queries), -np.inf)
        self.query = np.zeros(0, np.int64)
        self.sim = np.zeros(0)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, x: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Offer rows to the queries of these numbers (all, if None)."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        for i in range(0, len(x), BLOCK_ROWS):
            self._block(ids[i : i + BLOCK_ROWS], x[i : i + BLOCK_ROWS], asked)

    def _block(self, ids: np.ndarray, x: np.ndarray, asked: np.ndarray) -> None:
        norms = np.sqrt((x * x).sum(1))
        rough = self.unit[asked] @ (x / norms[:, None]).T
        limit = self.least[asked]
        if len(x) > self.k:
            limit = np.maximum(limit, np.partition(rough, len(x) - self.k, axis=1)[:, len(x) - self.k])
        q, row = np.nonzero(rough >= limit[:, None] - SLACK)
        q = asked[q]
        sim = np.empty(len(q))
        for i in range(0, len(q), CANDIDATES):  # row by row, so that equal vectors get equal similarities
            a, b = q[i : i + CANDIDATES], row[i : i + CANDIDATES]
            sim[i : i + CANDIDATES] = (self.queries[a] * x[b]).sum(1) / (self.norms[a] * norms[b])
        if self.ids is None:
            self.ids = ids[:0]
        query, found, sim = np.concatenate([self.query, q]), np.concatenate([self.ids, ids[row]]), np.concatenate([self.sim, sim])
        order = np.lexsort((np.unique(found, return_inverse=True)[1], -sim, query))
        query, found, sim = query[order], found[order], sim[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.query, self.ids, self.sim = query[keep], found[keep], sim[keep]
        last = np.flatnonzero(place == self.k - 1)
        self.least[query[last]] = sim[last]

    def rows(self, names: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.ids is not None and len(self.query):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(self.query)), pa.array(self.ids, id_type), pa.array(self.sim)], names=["query_id", "id", "similarity"])


def query_blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(dimension, ids, vectors) of bounded blocks of the queries; of several vectors of one id the smallest counts."""
    spark = queries.sparkSession
    clean = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("query_id").isNotNull() & usable(F.col("v")))
    clean = Scratch(spark).save(clean.groupBy("query_id").agg(F.min("v").alias("v")))
    for dim, n in sorted((r[0], r[1]) for r in clean.groupBy(F.size("v")).count().collect()):
        blocks = -(-n * dim * 8 // QUERY_BYTES)
        for b in range(blocks):
            block = clean.where((F.size("v") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            if block.num_rows:
                block = block.combine_chunks()
                yield dim, block["query_id"].chunk(0), rows_of(block["v"].chunk(0), dim)


def found_schema(queries: DataFrame, query_id: str, rows: DataFrame, id_col: str) -> StructType:
    return StructType([StructField("query_id", queries.schema[query_id].dataType), StructField("id", rows.schema[id_col].dataType), StructField("similarity", DoubleType())])


def ranked(spark: SparkSession, parts: list[DataFrame], schema: StructType, k: int) -> DataFrame:
    """(query_id, rank, id, similarity): the k best of each query among the partial results."""
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _kernel(shared, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        best, kind = Best(queries, k), None
        for batch in batches:
            kind = batch.column(0).type
            best.add(batch.column(0).to_numpy(zero_copy_only=False), rows_of(batch.column(1), dim))
        yield from best.rows(names, kind)

    return run


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, embedding: str = "embedding", id_col: str = "id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to each query: query_id, rank (from 1), id, similarity; ties to the smaller id.

    rows and queries may be the same table; a row that is a query is found by itself. Vectors that are
    null, empty, zero or hold what is null or not finite take no part, nor do null ids, nor rows of another dimension than
    the query's. Rows that repeat an id are found as often. The queries are collected block by block; the
    rows are scanned once for each block of QUERY_BYTES.
    """
    spark = rows.sparkSession
    ship(spark)
    schema = found_schema(queries, query_id, rows, id_col)
    clean = rows.select(F.col(id_col).alias("id"), F.col(embedding).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    parts = []
    for dim, names, block in query_blocks(queries, query_id, vector):
        shared = spark.sparkContext.broadcast((names, block))
        parts.append(clean.where(F.size("v") == dim).mapInArrow(_kernel(shared, dim, k), schema))
    return ranked(spark, parts, schema, k)
