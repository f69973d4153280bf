"""A stored vector index under cosine: inverted lists in segments, extended without being rebuilt.

Each append writes one *segment*: the centroids of its rows and their vectors, dealt to the nearest
centroid and sorted by list. Segments that are there are not touched. A search opens, in each segment,
the lists nearest to a query, as many as the segment needs for RECALL (fitted on its sample when it is built), and
merges the k best of all. ``compact`` writes segments of like size into one, so there are about log(rows) of them.

Below the root lie ``segments/<name>/lists`` (list, id, v), ``segments/<name>/centroids``, and the
manifest, a table with a row for each append or merge. A segment counts once its manifest row is there, so a
build that fails leaves nothing that is read; a merge's row names the segments it replaces.

Rows are not moved by a search: lists that no query opens are skipped by the statistics of the
files, and in the others each task multiplies a list's rows with the queries that open it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .batch_search import Best, found_schema, query_blocks, ranked, rows_of, unit, usable

#: Vectors of a segment's sample; sample vectors for each list at least; rounds of learning.
SAMPLE, PER_LIST, ROUNDS = 20_000, 16, 8
#: Share of the sample's own neighbours that a segment's number of opened lists finds, of NEIGHBOURS of TRIED vectors.
RECALL, NEIGHBOURS, TRIED = 0.98, 10, 400
#: So many lists opened in all are looked up by the files' statistics; more are a scan.
LOOKED_UP = 512
_MANIFEST = "segment string, n_rows long, dim int, n_lists int, probes int, replaces array<string>"


@dataclass(frozen=True)
class Segment:
    name: str
    n_rows: int
    dim: int
    n_lists: int
    probes: int


def learned(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical means of unit vectors; a list that gets none takes a vector far from its own mean."""
    centroids = sample[np.random.default_rng(5).choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        sim = sample @ centroids.T
        own = sim.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(sim.max(1), kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def fitted_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """How many of the nearest lists hold the share RECALL of the sample's neighbours."""
    asked = np.arange(0, len(sample), max(1, len(sample) // TRIED))[:TRIED]
    k = min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return len(centroids)
    sim = sample[asked] @ sample.T
    sim[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    own = (sample @ centroids.T).argmax(1)
    place = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(sample[asked] @ centroids.T), axis=1), np.arange(len(centroids))[None].repeat(len(asked), 0), 1)
    needed = np.take_along_axis(place, own[near], 1).ravel()
    return int(np.sort(needed)[min(int(np.ceil(RECALL * len(needed))), len(needed)) - 1]) + 1


def _dealt(shared, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (unit(rows_of(batch.column(1), dim)) @ shared.value.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], names=["list", "id", "v"])

    return run


def _searched(shared, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of every query among a task's rows, list by list; rows come sorted by list within a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, asked = shared.value
        best, kind = Best(queries, k), None
        for batch in batches:
            kind = batch.column(1).type
            lists = batch.column(0).to_numpy(zero_copy_only=False)
            ids, x = batch.column(1).to_numpy(zero_copy_only=False), rows_of(batch.column(2), dim)
            order = np.argsort(lists, kind="stable")
            edges = np.flatnonzero(np.diff(lists[order], prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                own = asked.get(int(lists[order[i]]))
                if own is not None:
                    best.add(ids[order[i:j]], x[order[i:j]], own)
        yield from best.rows(names, kind)

    return run


class VectorIndex:
    """The index below ``root``, a folder that driver and executors share; there need be nothing yet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------------ what is stored

    def segments(self) -> list[Segment]:
        """The live segments, in the order of their names."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest").collect()
        gone = {name for r in rows for name in r["replaces"]}
        return sorted((Segment(r["segment"], r["n_rows"], r["dim"], r["n_lists"], r["probes"]) for r in rows if r["segment"] not in gone), key=lambda s: s.name)

    def _lists(self, segment: Segment) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/segments/{segment.name}/lists")

    def _centroids(self, segment: Segment) -> np.ndarray:
        table = self.spark.read.parquet(f"{self.root}/segments/{segment.name}/centroids").orderBy("list").toArrow().combine_chunks()
        return rows_of(table["centroid"].chunk(0), segment.dim)

    # ------------------------------------------------------------------ writing

    def append(self, rows: DataFrame, id_col: str = "id", embedding: str = "embedding") -> Segment | None:
        """Add rows as a segment of their own; None if none has a usable vector.

        Vectors that are null, empty, zero or hold what is null or not finite are not found, nor are null ids.
        All vectors of an index have one dimension; another is refused. Ids may repeat.
        """
        clean = rows.select(F.col(id_col).alias("id"), F.col(embedding).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        return self._written(clean, [])

    def _written(self, clean: DataFrame, replaced: list[Segment]) -> Segment | None:
        ship(self.spark)
        sizes = {r[0]: r[1] for r in clean.groupBy(F.size("v")).count().collect()}
        if not sizes:
            return None
        dims = set(sizes) | {s.dim for s in self.segments()}
        if len(dims) > 1:
            raise ValueError(f"vectors of {sorted(dims)} dimensions in one index")
        dim, n = dims.pop(), sum(sizes.values())
        share = F.lit(min(int(2 * SAMPLE / n * (1 << 30)), 1 << 30))
        some = clean.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE)
        sample = unit(rows_of(some.select("v").toArrow().combine_chunks()["v"].chunk(0), dim))
        lists = max(1, min(round(2 * n**0.5), len(sample) // PER_LIST))
        centroids = learned(sample, lists)
        name = uuid.uuid4().hex
        folder = f"{self.root}/segments/{name}"
        dealt = clean.mapInArrow(_dealt(self.spark.sparkContext.broadcast(centroids), dim), f"list int, id {clean.schema['id'].dataType.simpleString()}, v {clean.schema['v'].dataType.simpleString()}")
        # By list and hash, so that a list with a third of all rows is dealt over several files.
        dealt.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").write.parquet(f"{folder}/lists")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        made = Segment(name, n, dim, lists, fitted_probes(sample, centroids))
        entry = (name, n, dim, lists, made.probes, [s.name for s in replaced])
        self.spark.createDataFrame([entry], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return made

    def compact(self, factor: int = 4) -> None:
        """Write segments of like size (within ``factor``) into one, until no ``factor`` of them are left.

        Replaced folders stay for searches that still read them; ``vacuum`` deletes them.
        """
        while True:
            sizes: dict[int, list[Segment]] = {}
            for s in self.segments():
                sizes.setdefault(int(np.log(s.n_rows) / np.log(factor)), []).append(s)
            due = next((own for _, own in sorted(sizes.items()) if len(own) >= factor), None)
            if due is None:
                return
            rows = self._lists(due[0])
            for s in due[1:]:
                rows = rows.unionByName(self._lists(s))
            self._written(rows.select("id", "v"), due)

    def vacuum(self) -> None:
        """Delete folders of segments that are not live: replaced ones, and what failed builds left."""
        live = {s.name for s in self.segments()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            if status.getPath().getName() not in live:
                files.delete(status.getPath(), True)

    # ------------------------------------------------------------------ searching

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """About the k rows most similar to each query: query_id, rank (from 1), id, similarity (exact); ties to the smaller id.

        probes: lists to open in each segment in place of the fitted number; as many as there are make the search exact.
        A query whose lists hold fewer than k rows is answered from all lists.
        """
        segments = self.segments()
        if not segments:
            kind = queries.schema[query_id].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, rank int, id string, similarity double")
        ship(self.spark)
        schema = found_schema(queries, query_id, self._lists(segments[0]), "id")
        centroids = {s.name: self._centroids(s) for s in segments}
        total = min(k, sum(s.n_rows for s in segments))
        parts = []
        for dim, names, block in query_blocks(queries, query_id, vector):
            if dim != segments[0].dim:
                continue
            opened, held = {}, np.zeros(len(block), np.int64)
            for s in segments:
                sizes = self._sizes(s)
                order = np.argsort(-(unit(block) @ centroids[s.name].T), axis=1, kind="stable")
                opened[s.name] = order[:, : min(probes or s.probes, s.n_lists)]
                held += sizes[opened[s.name]].sum(1)
            few = held < total
            for s in segments:
                asked: dict[int, list[int]] = {}
                for q, own in enumerate(opened[s.name].tolist()):
                    for at in range(s.n_lists) if few[q] else own:
                        asked.setdefault(at, []).append(q)
                shared = self.spark.sparkContext.broadcast((names, block, {at: np.array(q) for at, q in asked.items()}))
                rows = self._lists(s)
                rows = rows.where(F.col("list").isin(sorted(asked))) if len(asked) <= min(LOOKED_UP, s.n_lists // 2) else rows
                parts.append(rows.select("list", "id", "v").mapInArrow(_searched(shared, dim, k), schema))
        return ranked(self.spark, parts, schema, k)

    def _sizes(self, segment: Segment) -> np.ndarray:
        """Rows of each list of a segment, counted once for this object."""
        if not hasattr(self, "_counted"):
            self._counted: dict[str, np.ndarray] = {}
        if segment.name not in self._counted:
            sizes = np.zeros(segment.n_lists, np.int64)
            for r in self._lists(segment).groupBy("list").count().collect():  # a row for each list, at most SAMPLE / PER_LIST
                sizes[r[0]] = r[1]
            self._counted[segment.name] = sizes
        return self._counted[segment.name]
