"""Ingestion as one plan: gates, first per URL, new ones only, one enrichment, six tables.

The corpus is parsed once. Models are asked through a ledger, which knows what was answered before, and the
enrichment is written before anything is derived from it; a task that is retried later re-reads it. Every table is appended as a whole, without the rows it
holds already, and documents come last: they say what is stored. A run that fails half-way
leaves its enrichment behind, and the next run first appends what is missing of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize, urls
from ..operators.chunking import Count, chunk_text, estimate
from ..operators.writes import first_per_key, identified
from ..providers import EMBEDDING_BATCH, ENTITY_CHARS, ENTITY_PAGES, SUMMARY_CHARS, TRUNCATED, EmbeddingProvider, LanguageProvider, embed_all, with_retry
from ..runtime import Scratch, ship
from ..sources.corpus import split_rejects
from .ledger import Ledger, request_key
from .storage import KeyedTable, written

TABLES = {"entities": schemas.ENTITIES, "documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "projects": schemas.PROJECTS, "project_evidence": schemas.EVIDENCE, "chat_sessions": schemas.CHAT_SESSIONS}


@dataclass(frozen=True)
class Warehouse:
    """The six tables, dealt by id, and the rejects of the last run."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", TABLES[name])

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def unseen(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows whose id the table does not hold."""
        return self.table(name).unseen(rows)

    def append(self, name: str, rows: DataFrame) -> int:
        """Add rows and return how many; columns that they lack are null."""
        return self.table(name).append(rows)

    def rejects(self) -> DataFrame:
        return self.spark.read.schema(schemas.REJECTS).parquet(f"{self.root}/rejects")


#: What a document has that could not be summarised.
NO_SUMMARY = {"title": "Untitled Document", "summary": "Failed to generate summary", "keywords": [], "document_type": "other", "fiscal_year": None}
_CHUNKS = "doc string, chunk_index int, section_title string, content string, token_count int"


def _tried(call: Callable[..., object]) -> Callable[[list[tuple]], list[str | None]]:
    """Answers as JSON, one call for each request; a failure is the record of one document, not the run."""

    def ask(rows: list[tuple]) -> list[str | None]:
        out: list[str | None] = []
        for row in rows:
            try:
                out.append(json.dumps(with_retry(lambda r=row: call(*r))))
            except Exception:
                out.append(None)
        return out

    return ask


def _vectors(embeddings: EmbeddingProvider) -> Callable[[list[tuple]], list[str | None]]:
    """Vectors as JSON. Texts of a batch that fails are tried alone; those that fail are passed over by search."""

    def ask(rows: list[tuple]) -> list[str | None]:
        texts = [t for (t,) in rows]
        try:
            return [json.dumps([float(x) for x in v]) for v in embed_all(embeddings, texts, lambda _: None)]
        except Exception:
            return [None] if len(rows) == 1 else [v for row in rows for v in ask([row])]

    return ask


def _chunker(count: Count):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(doc, index, title, content, tokens) for title, content, tokens, index in chunk_text(text, count)]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "chunk_index", "section_title", "content", "token_count"])

    return run


ENRICHED = (
    f"summary {schemas.SUMMARY.simpleString()}, chunks array<struct<section_title:string,content:string,token_count:int,chunk_index:int,embedding:array<float>>>, "
    f"projects array<struct<record:{schemas.EXTRACTED_PROJECT.simpleString()},embedding:array<float>>>"
)


def _name(provider: object) -> str:
    return str(getattr(provider, "name", type(provider).__name__))


def enrich(documents: DataFrame, embeddings: EmbeddingProvider, model: LanguageProvider, count: Count = estimate, ledger: str | None = None) -> DataFrame:
    """documents (org_id, url, url_id, text, file) with summary, chunks and projects; a model's failure leaves its part empty.

    What the ledger (a folder; one of this call alone if None) holds is not asked again. Texts stay where they are
    until all answers have met their document by its hash: then they are joined once.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    ledger = ledger or f"{scratch.base}/ledger"
    asks, embeds = Ledger(spark, ledger, _name(model)), Ledger(spark, ledger, f"{_name(embeddings)}:{embeddings.dimension}")
    text, url = F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))
    short = F.when(F.length(text) <= SUMMARY_CHARS, text).otherwise(F.concat(F.substring(text, 1, SUMMARY_CHARS), F.lit(TRUNCATED)))
    doc = request_key("document", "", url, text)
    summary_key, project_key = request_key("summary", asks.model, short, url), request_key("projects", asks.model, text, url)
    keys = scratch.save(documents.select(doc.alias("doc"), summary_key.alias("s"), project_key.alias("p")).distinct())
    summaries = asks.ask("summary", documents.select(short.alias("text"), url.alias("url")), ["text", "url"], _tried(model.summarize))
    found = asks.ask("projects", documents.select(text.alias("text"), url.alias("url")), ["text", "url"], _tried(model.projects))
    records = F.coalesce(F.from_json("answer", f"array<{schemas.EXTRACTED_PROJECT.simpleString()}>"), F.array())
    projects = scratch.save(keys.join(found.withColumnRenamed("key", "p"), "p").select("doc", F.posexplode(records).alias("place", "record")))
    chunks = scratch.save(documents.select(doc.alias("doc"), text.alias("text")).dropDuplicates(["doc"]).mapInArrow(_chunker(count), _CHUNKS))
    of_project = F.concat(F.coalesce("record.title", F.lit("")), F.lit(" "), F.coalesce("record.description", F.lit("")))
    texts = chunks.select(F.col("content").alias("text")).unionByName(projects.select(of_project.alias("text")))
    vectors = embeds.ask("embedding", texts, ["text"], _vectors(embeddings), EMBEDDING_BATCH)
    vectors = scratch.save(vectors.select(F.col("key").alias("v"), F.from_json("answer", "array<float>").alias("embedding")))
    embedded = lambda rows, of: rows.withColumn("v", request_key("embedding", embeds.model, of)).join(vectors, "v", "left")

    own = F.sort_array(F.collect_list(F.struct("chunk_index", "section_title", "content", "token_count", "embedding")))
    own = F.transform(own, lambda c: F.struct(c["section_title"].alias("section_title"), c["content"].alias("content"), c["token_count"].alias("token_count"), c["chunk_index"].alias("chunk_index"), c["embedding"].alias("embedding")))
    of_chunks = embedded(chunks, F.col("content")).groupBy("doc").agg(own.alias("chunks"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("place", "record", "embedding")), lambda a, b: a["place"] - b["place"]), lambda p: F.struct(p["record"].alias("record"), p["embedding"].alias("embedding")))
    of_projects = embedded(projects, of_project).groupBy("doc").agg(own.alias("projects"))
    summary = F.coalesce(F.from_json("answer", schemas.SUMMARY), F.from_json(F.lit(json.dumps(NO_SUMMARY)), schemas.SUMMARY)).alias("summary")
    answered = keys.join(summaries.withColumnRenamed("key", "s"), "s", "left").select("doc", summary).join(of_chunks, "doc", "left").join(of_projects, "doc", "left")
    none = lambda name: F.coalesce(name, F.array()).alias(name)
    return documents.withColumn("doc", doc).join(answered, "doc").select(*documents.columns, "summary", none("chunks"), none("projects"))


def new_documents(corpus: DataFrame, warehouse: Warehouse, order: str = "file") -> DataFrame:
    """The first document of each URL that is not stored."""
    named = identified(first_per_key(corpus, "url", order), "url")
    return warehouse.unseen("documents", named).select(*corpus.columns)


def derive(enriched: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks, projects and project_evidence of enriched documents."""
    now = F.current_timestamp().cast("timestamp_ntz")
    base = identified(enriched, "url").withColumn("s", normalize.summary(F.col("summary")))
    documents = base.select("id", "url", "url_id", "org_id", "s.title", F.col("text").alias("content"), F.col("s.document_type").alias("content_type"), "s.summary", "s.keywords", "s.fiscal_year", F.aggregate("chunks", F.lit(0), lambda n, c: n + c["token_count"]).alias("token_count"), F.size("chunks").alias("chunk_count"), now.alias("created_at"), now.alias("updated_at"))
    chunks = identified(base.select(F.col("id").alias("document_id"), F.explode("chunks").alias("c"), now.alias("created_at")).select("document_id", "c.*", "created_at"), "document_id", "chunk_index")
    found = base.select(F.col("id").alias("document_id"), "org_id", F.posexplode("projects").alias("place", "p")).select("document_id", "org_id", "place", "p.embedding", normalize.project(F.col("p.record")).alias("r"))
    found = identified(found, "document_id", "place").withColumn("created_at", now)
    projects = found.select("id", "org_id", "r.*", F.array("document_id").alias("source_documents"), "embedding", F.col("created_at").alias("first_seen_at"), F.col("created_at").alias("last_updated_at"), "created_at")
    projects = projects.drop("evidence_excerpts").withColumn("contacts", F.transform("contacts", lambda c: F.struct(c["name"].alias("name"), c["title"].alias("title"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"), c["context"].alias("context"))))
    evidence = found.select(F.col("id").alias("project_id"), "document_id", F.posexplode("r.evidence_excerpts").alias("place", "excerpt"), F.lit("phase_signal").alias("evidence_type"), F.col("r.phase_confidence").alias("confidence"), "created_at")
    return {"documents": documents, "chunks": chunks, "projects": projects, "project_evidence": identified(evidence, "project_id", "place")}


def entity_info(corpus: DataFrame, model: LanguageProvider, ledger: str | None = None) -> DataFrame:
    """(id, website, name, type, state, confidence) from each entity's first three documents, those already stored too."""
    rows = corpus.select(F.col("org_id").alias("id"), "file", "url", F.substring("text", 1, ENTITY_CHARS).alias("text"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("file", "url"))  # limited before the shuffle
    pages = rows.withColumn("place", place).where(F.col("place") <= ENTITY_PAGES).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("file", "url", "text"))).alias("pages"))
    site = urls.website(F.col("url"))
    sites = corpus.where(site.isNotNull()).groupBy(F.col("org_id").alias("id")).agg(F.min_by(site, "file").alias("website"))
    sample = pages.join(sites, "id", "left").select("id", "pages", "website")

    shown = F.transform("pages", lambda p: F.struct(p["url"].alias("url"), F.lit("").alias("title"), p["text"].alias("content")))
    asked = sample.select("id", "website", F.to_json(shown).alias("pages"), F.coalesce("website", F.lit("")).alias("of"))
    asks = Ledger(corpus.sparkSession, ledger or f"{Scratch(corpus.sparkSession).base}/ledger", _name(model))
    answers = asks.ask("entity", asked, ["pages", "of"], _tried(lambda pages, of: model.entity(json.loads(pages), of)))
    raw = asked.withColumn("key", request_key("entity", asks.model, F.col("pages"), F.col("of"))).join(answers, "key").select("id", "website", F.from_json("answer", schemas.ENTITY_INFO).alias("e")).select("id", "website", "e.*")
    return raw.select("id", "website", normalize.entity(F.struct("name", "type", "state", "confidence")).alias("e")).where("e is not null").select("id", "website", "e.*")


def _stored(warehouse: Warehouse, staging: str, schema) -> dict[str, int]:
    """Append what the tables lack of an enrichment, documents last, and delete it. Each table is derived once: its rows are counted as they are written."""
    tables = derive(warehouse.spark.read.schema(schema).parquet(staging))
    done = {name: warehouse.append(name, warehouse.unseen(name, tables[name])) for name in ("chunks", "projects", "project_evidence", "documents")}
    path = warehouse.spark._jvm.org.apache.hadoop.fs.Path(staging)
    path.getFileSystem(warehouse.spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def _enriched_schema(documents: DataFrame):
    return documents.sparkSession.createDataFrame([], ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema], ENRICHED])).schema


def ingest(corpus: DataFrame, warehouse: Warehouse, embeddings: EmbeddingProvider, model: LanguageProvider, staging: str, count: Count = estimate) -> dict[str, int]:
    """Run everything and return the numbers of new rows and of rejects. Stored documents are not changed.

    staging names a folder of this warehouse alone. What a failed run has left there is stored
    first; one that failed while it was written is written again. Answers of models are kept in the
    warehouse's ledger: neither that run nor a later one asks for them again.
    """
    spark, ledger = warehouse.spark, f"{warehouse.root}/_ledger"
    scratch = Scratch(spark)
    corpus = scratch.save(corpus)
    fresh = corpus.select(F.col("entity").alias("id")).distinct().withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
    warehouse.append("entities", warehouse.unseen("entities", fresh))
    good, bad = split_rejects(corpus, warehouse.read("entities"))
    rejected = written(bad.select("entity", "file", "url", "reason"), lambda df: df.write.mode("overwrite").parquet(f"{warehouse.root}/rejects"))
    good = scratch.save(good)
    schema = _enriched_schema(good)
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/_SUCCESS")
    if left.getFileSystem(spark._jsc.hadoopConfiguration()).exists(left):
        _stored(warehouse, staging, schema)
    new = scratch.save(new_documents(good, warehouse))
    enrich(new, embeddings, model, count, ledger).select(*schema.fieldNames()).write.mode("overwrite").parquet(staging)
    done = _stored(warehouse, staging, schema)
    warehouse.table("entities").overlay(scratch.save(entity_info(good, model, ledger)))
    return done | {"rejected": rejected}
