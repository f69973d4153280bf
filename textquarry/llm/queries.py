"""The registered queries of this package: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .ann import nearest
from .embedding_dedup import near_dedup
from .filter_audit import audit
from .html_extract import html_extract
from .language_id import language_id
from .line_dedup import drop_repeated_lines
from .lm_score import lm_score
from .mixing import mix
from .ngram_jaccard import ngram_jaccard
from .packing import pack
from .quality import quality
from .suffix_dedup import suffix_dedup
from .vector_codes import compress


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal documents: five-word shingles, Jaccard 0.75."""
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), with_ids=False)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 of their sources."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learned from those that are not held out."""
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among the vectors of each label: cosine 0.93."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels that are not held out."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that copy an earlier line, up to one word."""
    return drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector, from integer codebooks."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, in every order of them."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 200 bytes that occur elsewhere."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_packing, op3_ann, op4_mixing, op5_language_id, op6_lm_score, op7_embedding_dedup, op8_quality, op9_line_dedup, op10_html_extract, op11_vector_codes, op12_filter_audit, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
