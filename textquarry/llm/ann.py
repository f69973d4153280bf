"""Approximate nearest neighbours in balanced posting lists.

Equal vectors are one vector with its smallest ids. Centroids come from a bounded sample of
distinct vectors, halved again and again along its main direction, so that every list gets the
same share of it. Every vector is posted to its nearest list and, near a boundary, to further
lists whose centroids are not much farther and lie in other directions. A query walks a
neighbour graph of the centroids and opens the lists whose distance is within a ratio of the
nearest one's; the ratio is the smallest of RATIOS that finds RECALL of the sample's own
neighbours. Lists are joined with their queries in blocks of bounded size on both sides, the
best of a block are measured in double precision on the original vectors, and the best of all
blocks are kept. A query whose lists hold too few candidates is searched in all vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, main_dimension, matrix, runs, tune, usable, vector_sample

#: Bytes of the sample (as doubles) that centroids are made of, and its vectors for each list at least.
SAMPLE_BYTES, PER_LIST = 64 << 20, 8
#: A list has this many distinct vectors at least, and there are 2 * sqrt(distinct vectors) lists at most.
LIST = 64
#: Ways to post boundary vectors: most lists of one, and how much farther than the nearest a further list may be. The way counts by which a
#: query meets the fewest rows. A further list must lie APART from nearer ones, in distances to the vector.
REPLICAS, APART = ((2, 1.005), (2, 1.02), (2, 1.05), (2, 1.2), (4, 1.2)), 0.25
#: How much farther than the nearest list an opened one may be: the first that finds the share RECALL of the neighbours of TRIED sample vectors.
RATIOS, RECALL, TRIED = (*(1 + i / 100 for i in range(2, 51)), 1.6, 2.0, math.inf), 0.96, 512
#: Neighbours of a centroid in the graph; rows of a block on each side.
#: A block's vectors are held while its queries pass in groups of QUERIES, so a list's vectors are copied once for BLOCK_QUERIES of them.
DEGREE, BLOCK_VECTORS, BLOCK_QUERIES, QUERIES = 24, 4096, 1 << 14, 512


def halve(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of the parts into which the sample falls when the largest are halved until there are ``lists``."""
    parts = [sample]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len, reverse=True)
        out = []
        for n, x in enumerate(parts):
            if len(x) < 2 or len(parts) + n >= lists:
                out.append(x)
                continue
            y = x - x.mean(0)
            v = y[np.argmax((y**2).sum(1))]
            for _ in range(6):
                v = y.T @ (y @ v)
                v = v / (np.linalg.norm(v) or 1.0)
            order = np.argsort(y @ v, kind="stable")
            out += [x[order[: len(x) // 2]], x[order[len(x) // 2 :]]]
        parts = out
    return np.array([x.mean(0) for x in parts if len(x)]).reshape(-1, sample.shape[1])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; what rounding adds is about 1e-15 of the squared norms."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


class Lists:
    """Centroids, their neighbour graph and the ratio in which lists are opened; all about the sample's mean."""

    def __init__(self, sample: np.ndarray, lists: int, k: int):
        self.mean = sample.mean(0)
        sample = sample - self.mean
        self.centroids = halve(sample, lists)
        n = len(self.centroids)
        most = min(DEGREE, n - 1)
        self.graph = np.zeros((n, 0), np.int64)
        if n > 1:
            graph = []
            for i in range(0, n, 1024):
                near = squares(self.centroids[i : i + 1024], self.centroids)
                near[np.arange(len(near)), i + np.arange(len(near))] = np.inf
                graph.append(np.argpartition(near, most - 1, 1)[:, :most])
            self.graph = np.concatenate(graph)
        near = self._neighbours(sample, k)
        self.cost, self.ratio, self.replicas = 1.0, math.inf, REPLICAS[-1]
        if near is None:
            return
        self.cost, self.ratio, self.replicas = min(self._fitted(sample, *near, way) for way in REPLICAS)
        if self.cost >= 1:  # lists would be more work than all rows: one list holds them
            self.centroids, self.graph, self.ratio, self.cost = np.zeros((1, sample.shape[1])), np.zeros((1, 0), np.int64), math.inf, 1.0

    def _neighbours(self, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """TRIED sample vectors and the k nearest others of each."""
        step = max(1, len(sample) // TRIED)
        asked = np.arange(0, len(sample), step)[:TRIED]
        k = min(k, len(sample) - 1)
        if k < 1 or len(self.centroids) < 2:
            return None
        near = np.full((len(asked), k), np.inf)
        ids = np.zeros((len(asked), k), np.int64)
        for i in range(0, len(sample), 4096):
            d = squares(sample[asked], sample[i : i + 4096])
            d[asked[:, None] == np.arange(i, i + d.shape[1])[None]] = np.inf
            both, which = np.concatenate([near, d], 1), np.concatenate([ids, np.broadcast_to(np.arange(i, i + d.shape[1]), d.shape)], 1)
            at = np.argpartition(both, k - 1, 1)[:, :k]
            near, ids = np.take_along_axis(both, at, 1), np.take_along_axis(which, at, 1)
        return asked, ids

    def _fitted(self, sample: np.ndarray, asked: np.ndarray, ids: np.ndarray, way: tuple[int, float]) -> tuple[float, float, tuple[int, float]]:
        """(rows that a query meets for each row of the sample, the first of RATIOS that opens a list of RECALL of the neighbours, the way to post)."""
        needed = np.unique(ids)
        lists: list[list[int]] = [[] for _ in needed]
        rows = np.zeros(len(self.centroids), np.int64)
        for i in range(0, len(sample), 4096):
            row, at = self.posted(sample[i : i + 4096], way)
            np.add.at(rows, at, 1)
            wanted = np.searchsorted(needed, row + i)
            for r, c, w in zip((row + i).tolist(), at.tolist(), wanted.tolist(), strict=True):
                if w < len(needed) and needed[w] == r:
                    lists[w].append(c)
        place = np.searchsorted(needed, ids)
        far = np.sqrt(squares(sample[asked], self.centroids))
        far /= np.maximum(far.min(1, keepdims=True), 1e-300)
        wants = np.array([min(far[i, c] for c in lists[p]) for i in range(len(asked)) for p in place[i]])
        ratio = next(r for r in RATIOS if (wants <= r).mean() >= RECALL)
        return float(((far <= ratio) @ rows).mean() / len(sample)), ratio, way

    def posted(self, x: np.ndarray, way: tuple[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector's lists. x is about the mean."""
        copies, near = way or self.replicas
        d = np.sqrt(squares(x, self.centroids))
        most = min(copies, d.shape[1])
        at = np.argpartition(d, most - 1, 1)[:, :most]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), 1, kind="stable"), 1)
        own = np.take_along_axis(d, at, 1)
        keep = own <= near * own[:, :1] + 1e-12
        for j in range(1, most):  # a list in the same direction as a nearer one adds little
            for i in range(j):
                apart = np.sqrt(((self.centroids[at[:, i]] - self.centroids[at[:, j]]) ** 2).sum(1))
                keep[:, j] &= ~keep[:, i] | (apart > APART * own[:, j])
        return np.nonzero(keep)[0], at[keep]

    def opened(self, q: np.ndarray) -> list[int]:
        """Lists within the ratio of the nearest, found by walking the graph from a few entries. q is about the mean."""
        measure = lambda at: np.sqrt(((self.centroids[at] - q) ** 2).sum(1))
        n = len(self.centroids)
        start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
        seen = np.zeros(n, bool)
        seen[start] = True
        found = dict(zip(start.tolist(), measure(start).tolist(), strict=True))
        todo = [(d, c) for c, d in found.items()]
        heapq.heapify(todo)
        best, wait = min(found.values()), 0
        while todo:
            d, c = heapq.heappop(todo)
            wait = wait + 1 if d > self.ratio * best else 0
            if wait > DEGREE:  # so many in a row led nowhere near
                break
            new = self.graph[c][~seen[self.graph[c]]]
            if len(new):
                seen[new] = True
                for m, e in zip(new.tolist(), measure(new).tolist(), strict=True):
                    found[m] = e
                    heapq.heappush(todo, (e, m))
                    best = min(best, e)
        return [c for c, d in found.items() if d <= self.ratio * best + 1e-12]


def _post(shared, dim: int, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        for batch in batches:
            x = matrix(batch.column(1), dim) - lists.mean
            if queries:
                own = [lists.opened(q) for q in x]
                row = np.repeat(np.arange(len(x)), [len(o) for o in own])
                at = np.array([c for o in own for c in o], np.int64)
            else:
                row, at = lists.posted(x)
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *some.columns], names=["list", "id", "v"])

    return run


def _nearest(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            side = table["query"].to_numpy()
            ids, x = table["id"].to_numpy(), matrix(table["v"], dim)
            q, qid, c, cid = x[side], ids[side], x[~side], ids[~side]
            if not len(q) or not len(c):
                continue
            order = np.argsort(cid, kind="stable")
            c, cid = c[order], cid[order]
            middle = c.mean(0)
            near_q, near_c = q - middle, c - middle
            slack = 1e-14 * dim * ((near_q**2).sum(1) + (near_c**2).sum(1).max())  # more than rounding can add
            most = k + len(cid) - len(np.unique(cid))  # rows that repeat an id take no other's place
            out = []
            for i in range(len(q)):
                if i % QUERIES == 0:
                    rough = squares(near_q[i : i + QUERIES], near_c)
                d = np.where(cid == qid[i], np.inf, rough[i % QUERIES])
                edge = np.partition(d, most - 1)[most - 1] if len(d) > most else np.inf
                at = np.flatnonzero((d <= edge + slack[i]) & np.isfinite(d)) if np.isfinite(edge) else np.flatnonzero(np.isfinite(d))
                exact = np.sqrt(((c[at] - q[i]) ** 2).sum(1))
                best = np.lexsort((cid[at], exact))
                best = best[np.sort(np.unique(cid[at][best], return_index=True)[1])][:k]
                out.append((np.full(len(best), qid[i]), cid[at][best], exact[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _met(posted: DataFrame, opened: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of every list that a query opens.

    A list's vectors are cut in nv parts, its queries in nq, and every part meets every part.
    """
    nv = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("nv"))
    nq = opened.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq"))
    parts = F.broadcast(nv.join(nq, "list"))  # a row for each list, of which the sample bounds the number
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(parts, "list").select("list", place("nv").alias("a"), every("nq").alias("b"), F.lit(False).alias("query"), "id", "v")
    right = opened.join(parts, "list").select("list", every("nv").alias("a"), place("nq").alias("b"), F.lit(True).alias("query"), "id", "v")
    blocks = left.unionByName(right).select(F.xxhash64("list", "a", "b").alias("key"), "query", "id", "v")
    found = blocks.repartition("key").sortWithinPartitions("key").mapInArrow(_nearest(dim, k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query by Euclidean distance: query_id, rank (from 1), id, score.

    Nearest first, ties to the smaller id; a query's own id is no candidate. Vectors that are
    null, zero, hold null or non-finite components or have another dimension than most take
    no part, nor do rows with a null id, on either side. Rows that repeat an id count once per
    distinct vector, with their smallest score. Queries without candidates, and an empty
    table, give no rows. Other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base, asked = clean(vectors), clean(queries)
    dim = main_dimension(base)
    if not dim:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    # Of equal vectors nobody needs more than the k + 1 smallest ids.
    single = base.groupBy(F.xxhash64("v").alias("h"), "id").agg(F.first("v").alias("v"))
    order = Window.partitionBy("h").orderBy("id")
    base = scratch.save(single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1))
    distinct, rows = base.agg(F.count_if(F.col("place") == 1), F.count("*")).first()
    base = base.select("id", "v")
    sample = vector_sample(base, max(PER_LIST, SAMPLE_BYTES // (8 * dim)), dim)
    lists = max(1, min(distinct // LIST, round(2 * math.sqrt(distinct)), len(sample) // PER_LIST))
    shared = spark.sparkContext.broadcast(Lists(sample, lists, k))
    schema = "list int, id long, v array<double>"
    posted = scratch.save(base.mapInArrow(_post(shared, dim, False), schema))
    opened = scratch.save(asked.distinct().mapInArrow(_post(shared, dim, True), schema))
    found = scratch.save(_met(posted, opened, dim, k))

    # Queries with fewer results than there are candidates are searched again, in all vectors.
    enough = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, rows - 1))
    short = scratch.save(asked.distinct().join(enough, "id", "left_anti"))
    if rows > 1 and not short.isEmpty():
        one = F.lit(0).alias("list")
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_met(base.select(one, "id", "v"), short.select(one, "id", "v"), dim, k))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
