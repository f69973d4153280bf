"""Registered queries of batch search and of the stored vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.batch_search import batch_top_k
from .operators.vector_index import VectorIndex
from .queries import _t, query
from .runtime import Scratch

_EXACT = """SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS INTEGER) AS rank, e.vec_id AS id, round(s, 6) AS similarity
FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) p
JOIN embeddings q ON q.vec_id = a_id JOIN embeddings e ON e.vec_id = b_id QUALIFY rank <= 10"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity", F.round("similarity", 6))


def _index(spark: SparkSession, sf: str) -> VectorIndex:
    """Five appends of the vectors, of which the first four are merged."""
    index = VectorIndex(spark, f"{Scratch(spark).base}/index")
    rows = _t(spark, sf, "embeddings")
    for part in range(5):
        index.append(rows.where(F.pmod("vec_id", F.lit(5)) == part), id_col="vec_id")
        if part == 3:
            index.compact()
    return index


@query(_EXACT)
def batch_topk(spark, sf):
    """The ten most similar vectors of every hundredth one, itself included."""
    return _rounded(batch_top_k(_t(spark, sf, "embeddings"), _asked(spark, sf), 10, id_col="vec_id"))


@query(_EXACT)
def index_topk_all_lists(spark, sf):
    """The same from the stored index in two segments, all lists opened."""
    return _rounded(_index(spark, sf).search(_asked(spark, sf), 10, probes=1 << 20))


@query("SELECT count(*) AS n_queries, true AS reaches FROM embeddings WHERE vec_id % 100 = 0")
def index_topk_recall(spark, sf):
    """Whether the lists that the index opens by itself hold 95 % of the true neighbours."""
    exact = batch_top_k(_t(spark, sf, "embeddings"), _asked(spark, sf), 10, id_col="vec_id").select("query_id", "id", F.lit(1).alias("true"))
    found = _index(spark, sf).search(_asked(spark, sf), 10).select("query_id", "id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.count("found") >= 0.95 * F.count("true")).alias("reaches"))
    return both
