"""Batch search against brute force, and the stored index: recall, appends, merges, failures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import batch_search, search, vector_index
from textquarry.operators.batch_search import batch_top_k
from textquarry.operators.vector_index import VectorIndex

SCHEMA = "id string, embedding array<float>"


def table(spark, x, first=0, parts=4):
    return spark.createDataFrame([(f"v{first + i:05d}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], SCHEMA).repartition(parts)


def clustered(seed, n, dim=24, clusters=60, wide=0.4):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + wide * rng.standard_normal((n, dim))


def brute(x, asked, k):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x[asked] @ x.T, 12)
    return {f"q{a}": [f"v{i:05d}" for i in np.lexsort((np.arange(len(x)), -s))[:k]] for a, s in zip(asked, sim, strict=True)}


def queries(spark, x, asked):
    return spark.createDataFrame([(f"q{a}", x[a].astype(np.float32).tolist()) for a in asked], "query_id string, embedding array<float>")


def lists_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_batch_top_k(spark, monkeypatch):
    """Several blocks of queries, several batches, rows that are equal: ties go to the smaller id."""
    monkeypatch.setattr(batch_search, "QUERY_BYTES", 24 * 8 * 7)
    x = clustered(1, 1500)
    x[700:720] = x[3]
    asked = [0, 3, 5, 710, 1499, *range(20, 40)]
    found = batch_top_k(table(spark, x), queries(spark, x, asked), 15)
    assert lists_of(found) == brute(x, asked, 15)
    assert [r.rank for r in found.where("query_id = 'q3'").orderBy("rank").collect()] == list(range(1, 16))


def test_batch_top_k_odd(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [1.0, None]), (None, [1.0, 1.0]), ("f", [2.0, 0.0]), ("g", [1.0]), ("h", []), ("a", [0.0, 1.0])], SCHEMA)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [1.0, 0.1]), ("r", [1.0]), ("s", None), (None, [1.0, 0.0]), ("t", [1.0, 2.0, 3.0])], "query_id string, embedding array<float>")
    assert lists_of(batch_top_k(rows, asked, 5)) == {"q": ["a", "f", "a"], "r": ["g"]}
    assert batch_top_k(rows.limit(0), asked, 5).count() == 0
    assert batch_top_k(rows, asked.limit(0), 5).columns == ["query_id", "rank", "id", "similarity"]


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if "/segments/" in d + "/" and not f.startswith(".")}


def test_index_append_and_recall(spark, tmp_path):
    """An append leaves all files that are there as they are; recall holds before and after, and after merges."""
    x = clustered(2, 6000)
    asked = list(range(0, 6000, 60))
    index = VectorIndex(spark, str(tmp_path))
    first = index.append(table(spark, x[:4000]))
    assert 1 <= first.probes < first.n_lists
    before = files(tmp_path)
    index.append(table(spark, x[4000:], 4000))
    assert {f: t for f, t in files(tmp_path).items() if f in before} == before
    want = brute(x, asked, 10)
    assert len(index.segments()) == 2 and recall(lists_of(index.search(queries(spark, x, asked), 10)), want) >= 0.95
    assert lists_of(index.search(queries(spark, x, asked), 10, probes=10**6)) == want
    again = VectorIndex(spark, str(tmp_path))  # what is stored is all there is
    for i in range(3):
        again.append(table(spark, x[i * 50 : i * 50 + 50], 6000 + i * 50))
    again.append(table(spark, x[150:200], 6150))
    again.compact()
    assert sorted(s.n_rows for s in again.segments()) == [200, 2000, 4000]
    again.vacuum()
    assert len(os.listdir(tmp_path / "segments")) == 3
    whole = np.concatenate([x, x[:200]])
    assert recall(lists_of(again.search(queries(spark, x, asked), 10)), brute(whole, asked, 10)) >= 0.95


def test_index_opens_few_lists(spark, tmp_path):
    """One query reads the lists it opens: the filter reaches the files' statistics."""
    x = clustered(3, 3000)
    index = VectorIndex(spark, str(tmp_path))
    made = index.append(table(spark, x))
    found = index.search(queries(spark, x, [7]), 5, probes=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(list, " in plan and made.n_lists > 6
    assert found.count() == 5


def test_index_hot_list_and_few_rows(spark, tmp_path):
    """A third of all rows equal; and a query whose lists hold fewer rows than asked for gets them from all lists."""
    x = clustered(4, 900)
    x[::3] = x[0]
    index = VectorIndex(spark, str(tmp_path))
    index.append(table(spark, x))
    assert lists_of(index.search(queries(spark, x, [0, 1]), 40, probes=10**6)) == brute(x, [0, 1], 40)
    assert len(lists_of(index.search(queries(spark, x, [1]), 800, probes=1))["q1"]) == 800


def test_index_failures(spark, tmp_path, monkeypatch):
    index = VectorIndex(spark, str(tmp_path))
    asked = queries(spark, clustered(5, 3), [0])
    assert index.search(asked, 3).count() == 0 and index.append(table(spark, np.zeros((3, 24)))) is None
    x = clustered(5, 100)
    index.append(table(spark, x))
    with pytest.raises(ValueError, match="dimensions"):
        index.append(table(spark, clustered(5, 10, dim=5), 100))
    monkeypatch.setattr(vector_index, "fitted_probes", lambda *a: 1 / 0)  # fails when the vectors are written, before the manifest is
    with pytest.raises(ZeroDivisionError):
        index.append(table(spark, x, 100))
    assert [s.n_rows for s in index.segments()] == [100] and len(os.listdir(tmp_path / "segments")) == 2
    index.vacuum()
    assert len(os.listdir(tmp_path / "segments")) == 1
    assert index.search(queries(spark, clustered(6, 2, dim=3), [0]), 3).count() == 0


def test_search_chunks_orphans_and_index(spark, tmp_path):
    """Chunks without a document take no places, with and without an index."""
    x = clustered(7, 400)
    chunks = table(spark, x).withColumn("document_id", F.when(F.hash("id") % 4 == 0, F.concat(F.lit("d"), F.substring("id", 5, 2)))).withColumns({"section_title": F.lit("s"), "content": F.col("id")})
    docs = spark.createDataFrame([(f"d{i:02d}", "t", "u", "o") for i in range(0, 100, 2)], "id string, title string, url string, org_id string")
    entities = spark.createDataFrame([("o", "name")], "id string, name string")
    vector = F.array(*[F.lit(float(v)) for v in x[0].astype(np.float32)])
    index = VectorIndex(spark, str(tmp_path))
    index.append(chunks)
    exact = [r.id for r in search.search_chunks(chunks, docs, entities, vector, 12).collect()]
    owned = {r.id for r in chunks.join(docs.select(F.col("id").alias("document_id")), "document_id").collect()}
    assert exact == [i for i in brute(x, [0], 400)["q0"] if i in owned][:12]
    got = [r.id for r in search.search_chunks(chunks, docs, entities, vector, 12, index).collect()]
    assert len(got) == 12 and set(got) <= owned and len(set(got) & set(exact)) >= 11
