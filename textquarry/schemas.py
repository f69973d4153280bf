"""Table and record types, and the small dimensions that operators join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VECTOR = T.ArrayType(T.FloatType())
CONTACT = _struct(name=S, title=S, email=S, phone=S, context=S)

# Stored tables.
ENTITIES = _struct(id=S, name=S, type=S, state=S, website=S, created_at=TS)
DOCUMENTS = _struct(
    id=S, url=S, url_id=S, org_id=S, title=S, content=S, content_type=S, summary=S, keywords=T.ArrayType(S), fiscal_year=I, token_count=I, chunk_count=I, created_at=TS, updated_at=TS
)
CHUNKS = _struct(id=S, document_id=S, section_title=S, content=S, token_count=I, chunk_index=I, embedding=VECTOR, created_at=TS)
PROJECTS = _struct(
    id=S, org_id=S, title=S, description=S, phase=S, phase_confidence=T.FloatType(), phase_reasoning=S, category=S, estimated_value=T.DecimalType(15, 2), fiscal_year=I, timeline_notes=S,
    contacts=T.ArrayType(CONTACT), source_documents=T.ArrayType(S), first_seen_at=TS, last_updated_at=TS, embedding=VECTOR, keywords=T.ArrayType(S), created_at=TS,
)
EVIDENCE = _struct(id=S, project_id=S, document_id=S, chunk_id=S, evidence_type=S, excerpt=S, confidence=T.FloatType(), created_at=TS)
CHAT_SESSIONS = _struct(id=S, query=S, response=S, matched_docs=T.ArrayType(_struct(id=S, title=S, url=S)), matched_projects=T.ArrayType(_struct(id=S, title=S, phase=S)), created_at=TS)

REJECTS = _struct(entity=S, file=S, url=S, reason=S)

# Records in flight.
RAW_DOCUMENT = _struct(url=S, org_id=S, url_id=S, text=S)
CHUNK = _struct(section_title=S, content=S, token_count=I, chunk_index=I)
LINK = _struct(url=S, anchor_text=S, context=S, title=S, rel=S, type=S)
PAGE = _struct(url=S, title=S, markdown=S, links=T.ArrayType(LINK))
SUMMARY = _struct(title=S, summary=S, keywords=T.ArrayType(S), document_type=S, fiscal_year=I)
EXTRACTED_PROJECT = _struct(
    title=S, description=S, phase=S, phase_reasoning=S, phase_confidence=D, category=S, estimated_value=D, fiscal_year=I, timeline_notes=S,
    contacts=T.ArrayType(_struct(name=S, title=S, context=S)), evidence_excerpts=T.ArrayType(S), keywords=T.ArrayType(S),
)
ENTITY_INFO = _struct(name=S, type=S, state=S, confidence=D)
RANKING = _struct(index=I, relevance_score=D, category=S, rationale=S)

# Phases with label, sign, description and priority, in their order.
PHASES = [
    ("strategy", "Strategy", "🎯", "Mentioned in plans/goals, no budget yet", 1),
    ("budget", "Budget", "💰", "Funding allocated or approved", 2),
    ("contacts", "Contacts", "👤", "Decision makers identified", 3),
    ("rfp_open", "RFP Open", "📋", "Active RFP accepting bids", 4),
    ("awarded", "Awarded", "✅", "Contract awarded", 5),
    ("in_progress", "In Progress", "🔄", "Work underway", 6),
]
# Link categories in their order.
CATEGORIES = ["budget", "finance", "procurement", "contact", "meeting", "policy", "project", "department", "document", "other"]
# Entity, document and project types.
ENTITY_TYPES = ["city", "county", "school_district", "special_district", "university", "other"]
DOCUMENT_TYPES = ["budget", "meeting", "rfp", "policy", "contact", "other"]
PROJECT_CATEGORIES = ["technology", "infrastructure", "consulting", "facilities", "services", "other"]


def phase_dimension(spark: SparkSession) -> DataFrame:
    """The six phases, a row each."""
    return spark.createDataFrame(PHASES, "phase string, phase_label string, phase_emoji string, phase_description string, phase_priority int")


def category_dimension(spark: SparkSession) -> DataFrame:
    """The ten link categories with their place."""
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "place int, category string")
