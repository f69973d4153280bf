"""From raw documents to packed training sequences: five operators, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes every stage's rows as Parquet in the folder that executors
share and hands the table as read back to the next stage; a stage's table goes when the next
one's is written.

All stages: an empty table gives no rows; columns of other names than doc_id, text, lang, source
and n_chars pass through the first four; whole texts count, however long; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm.common import Scratch
from textquarry.llm.language_id import keep_identified
from textquarry.llm.line_dedup import keep_unrepeated
from textquarry.llm.mixing import take
from textquarry.llm.ngram_jaccard import keep_one_per_class
from textquarry.llm.packing import pack
from textquarry.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; what the classifier rejects goes.

    Null and letterless texts go. Null ids and null langs teach nothing and are judged by their
    text; repeated rows stay repeated; of languages that tie the more frequent one counts.
    """
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that copy an earlier line; those left blank go.

    Earlier is the smaller id, null last, then the smaller hash of the text, then the line. Rows
    that repeat id and text are one document and lose the same lines. Texts that lose no line
    stay, null and empty ones too.
    """
    return keep_unrepeated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-equal ones: the smallest id, null last.

    Different texts with one id are different documents. Rows that repeat id and text become one.
    Texts without words are in no class and stay.
    """
    return keep_one_per_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, at most three times.

    A null source is a source. Rows that share an id are taken equally often. Texts without words go.
    """
    return take(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their token ids.

    Every row is packed; a null id stays null, and a null or empty text is the end id alone.
    """
    return pack(docs, vocabulary())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]

#: No SQL: token ids, compressed sizes and packing are not expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        last, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if n:
            scratch.drop(last)
    return docs
