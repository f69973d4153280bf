"""The read API: each function returns DataFrames, nothing is collected but a chat's context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import literal
from ..operators import search as S
from ..operators.rollups import count_by_phase, counts_per, matching, totals, with_phase
from ..operators.writes import in_array
from ..providers import EmbeddingProvider, LanguageProvider
from ..schemas import CHAT_SESSIONS, PHASES

LIST_COLUMNS = ["id", "title", "description", "phase", "phase_confidence", "category", "estimated_value", "fiscal_year", "timeline_notes", "contacts", "keywords", "org_id", "entity_name", "created_at"]
PIPELINE_COLUMNS = ["id", "title", "description", "phase", "phase_confidence", "category", "estimated_value", "fiscal_year", "org_id", "entity_name"]


def _named(projects: DataFrame, entities: DataFrame) -> DataFrame:
    return projects.join(entities.select(F.col("id").alias("org_id"), F.col("name").alias("entity_name")), "org_id", "left")


def projects_list(projects: DataFrame, entities: DataFrame, phase: str | None = None, category: str | None = None, org_id: str | None = None) -> DataFrame:
    """Projects, newest first, with their entity and phase; the filters reach the scan of projects."""
    chosen = matching(projects, phase=phase, category=category, org_id=org_id)
    return with_phase(_named(chosen, entities).select(*LIST_COLUMNS)).orderBy(F.col("created_at").desc_nulls_first(), "id")


def pipeline(projects: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """projects (by phase), by_phase (all six, counted) and summary."""
    listed = with_phase(_named(projects, entities).select(*PIPELINE_COLUMNS))
    return {"projects": listed.where(F.col("phase").isin([p[0] for p in PHASES])), "by_phase": count_by_phase(projects).orderBy("phase_priority"), "summary": totals(projects)}


def project_detail(projects: DataFrame, entities: DataFrame, evidence: DataFrame, documents: DataFrame, project_id: str) -> dict[str, DataFrame]:
    """project (no row: not found), its evidence with documents, and its source documents."""
    one = projects.where(F.col("id") == project_id)
    docs = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("url").alias("document_url"))
    own = evidence.where(F.col("project_id") == project_id).join(docs, "document_id", "left")
    return {"project": with_phase(_named(one, entities)), "evidence": own, "documents": in_array(documents.select("id", "title", "url", "content_type", "summary"), one, "source_documents")}


def search(chunks: DataFrame, documents: DataFrame, projects: DataFrame, entities: DataFrame, query: str, provider: EmbeddingProvider, limit: int = 10, kind: str = "all") -> dict[str, DataFrame]:
    """documents and projects for a query; an unknown kind finds nothing."""
    if not query:
        raise ValueError("a query is required")
    vector = literal(provider.embed([query])[0])
    out = {}
    if kind in ("all", "documents"):
        out["documents"] = S.document_results(S.search_chunks(chunks, documents, entities, vector, limit))
    if kind in ("all", "projects"):
        found = S.search_projects(projects, entities, vector, limit)
        out["projects"] = found.select("id", "title", "description", "phase", "phase_label", "phase_emoji", "category", "estimated_value", F.col("entity_name").alias("entity"), F.col("similarity").alias("relevance"))
    return out


def entities_stats(entities: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Entities by id with their numbers of documents and projects."""
    return counts_per(entities, "id", {"document_count": (documents, "org_id"), "project_count": (projects, "org_id")}).orderBy("id")


def entity_detail(entities: DataFrame, documents: DataFrame, projects: DataFrame, entity_id: str) -> dict[str, DataFrame]:
    """entity (no row: not found), its documents and its projects, newest first."""
    newest = [F.col("created_at").desc_nulls_first(), "id"]
    docs = documents.where(F.col("org_id") == entity_id).select("id", "title", "url", "content_type", "summary", "fiscal_year", "created_at").orderBy(*newest)
    return {"entity": entities.where(F.col("id") == entity_id), "documents": docs, "projects": with_phase(projects.where(F.col("org_id") == entity_id)).orderBy(*newest)}


def retrieve(chunks: DataFrame, documents: DataFrame, projects: DataFrame, entities: DataFrame, vector: Column) -> tuple[DataFrame, DataFrame]:
    """The chunks and projects that an answer is based on."""
    return S.search_chunks(chunks, documents, entities, vector), S.search_projects(projects, entities, vector)


def check_query(query: str) -> str:
    if not 1 <= len(query) <= 2000:
        raise ValueError("a query has 1 to 2000 characters")
    return query


def chat(chunks: DataFrame, documents: DataFrame, projects: DataFrame, entities: DataFrame, query: str, embeddings: EmbeddingProvider, model: LanguageProvider, phase: str | None = None, category: str | None = None, org_id: str | None = None) -> dict:
    """answer, sources (of the first five chunks) and session (a row to append). Filters narrow the projects."""
    chosen = matching(projects, phase=phase, category=category, org_id=org_id)
    docs, own, context = _basis(*retrieve(chunks, documents, chosen, entities, literal(embeddings.embed([check_query(query)])[0])))
    answer = model.answer(query, context)
    return {"answer": answer, "sources": [{"title": d.document_title, "url": d.document_url, "similarity": d.similarity} for d in docs[:5]], "session": _session(chunks.sparkSession, query, answer, docs, own)}


def _basis(found: DataFrame, near: DataFrame) -> tuple[list, list, str]:
    """The ten chunks and five projects, each searched once, and the context they make."""
    spark = found.sparkSession
    docs, own = found.collect(), near.collect()
    context = S.format_context(spark.createDataFrame(docs, found.schema), spark.createDataFrame(own, near.schema)).first()["context"]
    return docs, own, context


def _session(spark: SparkSession, query: str, answer: str, docs: list, own: list) -> DataFrame:
    matched = ([{"id": d.document_id, "title": d.document_title, "url": d.document_url} for d in docs], [{"id": p.id, "title": p.title, "phase": p.phase} for p in own])
    return spark.createDataFrame([(None, query, answer, *matched, None)], CHAT_SESSIONS).withColumns({"created_at": F.current_timestamp().cast("timestamp_ntz"), "id": F.sha2(F.concat("query", "response"), 256)})


def chat_stream(chunks: DataFrame, documents: DataFrame, projects: DataFrame, entities: DataFrame, query: str, embeddings: EmbeddingProvider, model: LanguageProvider, store: Callable[[DataFrame], None] = lambda session: None, phase: str | None = None, category: str | None = None, org_id: str | None = None) -> Iterator[str]:
    """The answer piece by piece, from what is retrieved for the query; store gets the session when it is whole. A stream is not retried."""
    chosen = matching(projects, phase=phase, category=category, org_id=org_id)
    docs, own, context = _basis(*retrieve(chunks, documents, chosen, entities, literal(embeddings.embed([check_query(query)])[0])))
    said = []
    for piece in model.stream(query, context):
        said.append(piece)
        yield piece
    store(_session(chunks.sparkSession, query, "".join(said), docs, own))


def health() -> dict[str, str]:
    return {"status": "ok"}
