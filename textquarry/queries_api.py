"""Registered queries of the read API, through the plans that serve it.

The six tables are made from the driver's: nations are entities, orders projects (with the
vectors of embeddings whose ids they share), documents documents, embeddings chunks of them,
lineitem evidence. Every query reads its whole tables; limits are those of top-k search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import urls
from .functions.vectors import literal
from .operators import search
from .plans import api
from .providers import HashedEmbedding
from .queries import _t, query
from .schemas import PHASES

ASKED = "budget of the network upgrade and its vendor contract"
EMBEDDINGS = HashedEmbedding(64)

_VECTOR = "[" + ", ".join(repr(x) for x in EMBEDDINGS.embed([ASKED])[0]) + "]::DOUBLE[]"
_KNOWN = ", ".join(f"('{p}', '{label}', '{sign}', {n})" for p, label, sign, _, n in PHASES)
_TABLES = f"""
ent AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation),
doc AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'https://' || source || '.gov/' || doc_id AS url, CAST(doc_id % 25 AS VARCHAR) AS org_id, 'Document ' || doc_id AS title, left(text, 100) AS summary, lang AS content_type, text FROM documents),
chu AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(vec_id % 100 AS VARCHAR) AS document_id, 'Section ' || label AS section_title, 'Chunk ' || vec_id AS content, embedding FROM embeddings),
pro AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS org_id, 'Order ' || o_orderkey AS title, {{phase}} AS phase, o_orderpriority AS category,
  CAST(o_totalprice AS DECIMAL(15, 2)) AS estimated_value, o_orderdate AS created_at, e.embedding FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN embeddings e ON e.vec_id = o_orderkey),
kn AS (SELECT * FROM (VALUES {_KNOWN}) v(phase, phase_label, phase_emoji, phase_priority))""".format(phase="CASE o_orderstatus WHEN 'P' THEN 'strategy' WHEN 'O' THEN 'rfp_open' WHEN 'F' THEN 'unheard' END")
_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR})"
#: The chunks and projects found for ASKED, with their places.
_FOUND = f"""
top AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM (SELECT chu.*, {_COSINE} AS similarity FROM chu JOIN doc ON doc.id = document_id WHERE embedding IS NOT NULL) QUALIFY r <= 10),
near AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM (SELECT *, {_COSINE} AS similarity FROM pro WHERE embedding IS NOT NULL) QUALIFY r <= 5)"""


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://"), "source", F.lit(".gov/"), "doc_id")
    return _t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), url.alias("url"), urls.url_id(url).alias("url_id"), F.pmod("doc_id", F.lit(25)).cast("string").alias("org_id"), F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.substring("text", 1, 100).alias("summary"), F.col("lang").alias("content_type"), F.lit(None).cast("int").alias("fiscal_year"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.pmod("vec_id", F.lit(100)).cast("string").alias("document_id"), F.concat(F.lit("Section "), "label").alias("section_title"), F.concat(F.lit("Chunk "), "vec_id").alias("content"), "embedding"
    )


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    orders, none = _t(spark, sf, "orders"), F.lit(None)
    owners = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("org_id"))
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("o_orderkey"), "embedding")
    phase = F.when(F.col("o_orderstatus") == "P", "strategy").when(F.col("o_orderstatus") == "O", "rfp_open").when(F.col("o_orderstatus") == "F", "unheard")
    return orders.join(owners, "o_custkey", "left").join(vectors, "o_orderkey", "left").select(
        F.col("o_orderkey").cast("string").alias("id"), "org_id", F.concat(F.lit("Order "), "o_orderkey").alias("title"), none.cast("string").alias("description"), phase.alias("phase"), none.cast("float").alias("phase_confidence"),
        F.col("o_orderpriority").alias("category"), F.col("o_totalprice").cast("decimal(15,2)").alias("estimated_value"), none.cast("int").alias("fiscal_year"), none.cast("string").alias("timeline_notes"), none.cast("string").alias("contacts"),
        none.cast("string").alias("keywords"), F.array(F.pmod("o_orderkey", F.lit(100)).cast("string")).alias("source_documents"), "embedding", F.col("o_orderdate").alias("created_at"),
    )


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("project_id"), F.col("l_linenumber").alias("line"), F.pmod("l_partkey", F.lit(200)).cast("string").alias("document_id"))


_LISTED = "coalesce(kn.phase_label, 'Strategy') AS phase_label, coalesce(kn.phase_emoji, '🎯') AS phase_emoji"


@query(
    f"""WITH {_TABLES} SELECT p.id, p.title, p.phase, phase_label, phase_priority, category, CAST(estimated_value AS DOUBLE) AS estimated_value, org_id, ent.name AS entity_name
FROM pro p LEFT JOIN ent ON ent.id = org_id JOIN kn ON kn.phase = p.phase WHERE p.phase = 'rfp_open' AND category = '2-HIGH'"""
)
def api_projects_list(spark, sf):
    found = api.projects_list(_projects(spark, sf), _entities(spark, sf), phase="rfp_open", category="2-HIGH")
    return found.select("id", "title", "phase", "phase_label", "phase_priority", "category", F.col("estimated_value").cast("double").alias("estimated_value"), "org_id", "entity_name")


@query(f"WITH {_TABLES} SELECT p.id, p.phase, {_LISTED}, ent.name AS entity_name FROM pro p LEFT JOIN ent ON ent.id = org_id JOIN kn ON kn.phase = p.phase")
def api_pipeline_projects(spark, sf):
    return api.pipeline(_projects(spark, sf), _entities(spark, sf))["projects"].select("id", "phase", "phase_label", "phase_emoji", "entity_name")


@query(
    f"""WITH {_TABLES} SELECT kn.phase, kn.phase_label, count(p.id) AS n, (SELECT count(*) FROM pro) AS total, CAST((SELECT sum(estimated_value) FROM pro) AS DOUBLE) AS total_estimated_value
FROM kn LEFT JOIN pro p ON p.phase = kn.phase GROUP BY 1, 2"""
)
def api_pipeline_counts(spark, sf):
    out = api.pipeline(_projects(spark, sf), _entities(spark, sf))
    summary = out["summary"].withColumn("total_estimated_value", F.col("total_estimated_value").cast("double"))
    return out["by_phase"].crossJoin(F.broadcast(summary)).select("phase", "phase_label", "n", "total", "total_estimated_value")  # six rows and one


@query(
    f"""WITH {_TABLES}, one AS (SELECT * FROM pro WHERE id = (SELECT CAST(min(l_orderkey) AS VARCHAR) FROM lineitem))
SELECT 'project' AS part, one.id AS id, {_LISTED}, ent.name AS title FROM one LEFT JOIN ent ON ent.id = org_id LEFT JOIN kn ON kn.phase = one.phase
UNION ALL SELECT 'evidence', CAST(l_linenumber AS VARCHAR), NULL, NULL, doc.title FROM lineitem LEFT JOIN doc ON doc.id = CAST(l_partkey % 200 AS VARCHAR) WHERE CAST(l_orderkey AS VARCHAR) = (SELECT id FROM one)
UNION ALL SELECT 'document', doc.id, NULL, NULL, doc.title FROM doc WHERE doc.id = (SELECT CAST(CAST(id AS BIGINT) % 100 AS VARCHAR) FROM one)"""
)
def api_project_detail(spark, sf):
    """The three parts of the detail of the first project that has evidence."""
    first = _t(spark, sf, "lineitem").agg(F.min("l_orderkey")).first()[0]
    out = api.project_detail(_projects(spark, sf), _entities(spark, sf), _evidence(spark, sf), _documents(spark, sf), str(first))
    none = F.lit(None).cast("string")
    row = lambda part, i, label, emoji, title: [F.lit(part).alias("part"), i.cast("string").alias("id"), label.alias("phase_label"), emoji.alias("phase_emoji"), title.alias("title")]
    project = out["project"].select(*row("project", F.col("id"), F.col("phase_label"), F.col("phase_emoji"), F.col("entity_name")))
    evidence = out["evidence"].select(*row("evidence", F.col("line"), none, none, F.col("document_title")))
    return project.unionByName(evidence).unionByName(out["documents"].select(*row("document", F.col("id"), none, none, F.col("title"))))


@query(
    f"""WITH {_TABLES}, {_FOUND.replace('r <= 5', 'r <= 10')}, best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY r) = 1)
SELECT 'document' AS kind, doc.id, doc.title, ent.name AS entity, section_title || ': ' || content || '...' AS shown, round(similarity, 6) AS relevance FROM best JOIN doc ON doc.id = document_id LEFT JOIN ent ON ent.id = org_id
UNION ALL SELECT 'project', n.id, n.title, ent.name, {_LISTED.split(" AS ")[0]}, round(similarity, 6) FROM near n LEFT JOIN ent ON ent.id = org_id LEFT JOIN kn ON kn.phase = n.phase"""
)
def api_search(spark, sf):
    out = api.search(_chunks(spark, sf), _documents(spark, sf), _projects(spark, sf), _entities(spark, sf), ASKED, EMBEDDINGS)
    relevance = F.round("relevance", 6).alias("relevance")
    documents = out["documents"].select(F.lit("document").alias("kind"), "id", "title", "entity", F.concat("matched_section", F.lit(": "), "excerpt").alias("shown"), relevance)
    return documents.unionByName(out["projects"].select(F.lit("project").alias("kind"), "id", "title", "entity", F.col("phase_label").alias("shown"), relevance))


@query(f"WITH {_TABLES} SELECT id, name, (SELECT count(*) FROM doc WHERE doc.org_id = ent.id) AS document_count, (SELECT count(*) FROM pro WHERE pro.org_id = ent.id) AS project_count FROM ent")
def api_entities_stats(spark, sf):
    return api.entities_stats(_entities(spark, sf), _documents(spark, sf), _projects(spark, sf))


@query(
    f"""WITH {_TABLES} SELECT 'entity' AS part, id, name AS title FROM ent WHERE id = '7' UNION ALL SELECT 'document', id, title FROM doc WHERE org_id = '7'
UNION ALL SELECT 'project', p.id, {_LISTED.split(" AS ")[0]} FROM pro p LEFT JOIN kn ON kn.phase = p.phase WHERE org_id = '7'"""
)
def api_entity_detail(spark, sf):
    out = api.entity_detail(_entities(spark, sf), _documents(spark, sf), _projects(spark, sf), "7")
    row = lambda part, title: out[part if part == "entity" else part + "s"].select(F.lit(part).alias("part"), "id", F.col(title).alias("title"))
    return row("entity", "name").unionByName(row("document", "title")).unionByName(row("project", "phase_label"))


_ABOUT = ", ".join(f"('{p}', '{about}')" for p, _, _, about, _ in PHASES)
_LF = "chr(10)"


@query(
    f"""WITH {_TABLES}, {_FOUND}, ab AS (SELECT * FROM (VALUES {_ABOUT}) v(phase, about)),
c AS (SELECT document_id, min(r) AS first, any_value('### ' || doc.title || {_LF} || '**Source**: ' || doc.url || {_LF} || CASE WHEN ent.name IS NULL THEN '' ELSE '**Entity**: ' || ent.name || {_LF} END || {_LF})
  || string_agg('**' || section_title || '**' || {_LF} || content || {_LF} || {_LF}, '' ORDER BY r) AS text FROM top JOIN doc ON doc.id = document_id LEFT JOIN ent ON ent.id = doc.org_id GROUP BY 1),
p AS (SELECT r, '### ' || coalesce(kn.phase_emoji, '🎯') || ' ' || n.title || {_LF} || '- **Phase**: ' || coalesce(kn.phase_label, 'Strategy') || ' - ' || coalesce(ab.about, '{PHASES[0][3]}') || {_LF}
  || coalesce('- **Entity**: ' || ent.name || {_LF}, '') || '- **Category**: ' || category || {_LF} || '- **Est. Value**: $' || regexp_replace(format('{{:,.2f}}', CAST(estimated_value AS DOUBLE)), '[.]?0+$', '') || {_LF} || {_LF} AS text
  FROM near n LEFT JOIN ent ON ent.id = n.org_id LEFT JOIN kn ON kn.phase = n.phase LEFT JOIN ab ON ab.phase = n.phase)
SELECT '## Retrieved Documents' || {_LF} || {_LF} || (SELECT string_agg(text, '' ORDER BY first) FROM c) || {_LF} || '## Related Projects in Pipeline' || {_LF} || {_LF} || (SELECT string_agg(text, '' ORDER BY r) FROM p) AS context"""
)
def context_text(spark, sf):
    """The whole context that a model is given for a question: documents with their chunks, then projects."""
    vector = literal(EMBEDDINGS.embed([ASKED])[0])
    chunks = search.search_chunks(_chunks(spark, sf), _documents(spark, sf), _entities(spark, sf), vector)
    return search.format_context(chunks, search.search_projects(_projects(spark, sf), _entities(spark, sf), vector))


class _Quoting:
    """A model that says what it was asked and how long its context is."""

    def answer(self, asked: str, context: str) -> str:
        return "".join(self.stream(asked, context))

    def stream(self, asked: str, context: str):
        yield asked
        yield f" ({context.count('### ')})"


_CHAT = f"""SELECT '{ASKED}' AS query, '{ASKED} (' || ((SELECT count(DISTINCT document_id) FROM top) + (SELECT count(*) FROM near)) || ')' AS response,
(SELECT string_agg(document_id, ',' ORDER BY r) FROM top) AS documents, (SELECT string_agg(id, ',' ORDER BY r) FROM near) AS projects"""


def _session(session: DataFrame) -> DataFrame:
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return session.select("query", "response", ids("matched_docs").alias("documents"), ids("matched_projects").alias("projects"))


@query(f"WITH {_TABLES}, {_FOUND} {_CHAT}")
def api_chat(spark, sf):
    """The session of an answer: the context holds a head for each document and each project found."""
    return _session(api.chat(_chunks(spark, sf), _documents(spark, sf), _projects(spark, sf), _entities(spark, sf), ASKED, EMBEDDINGS, _Quoting())["session"])


@query(f"WITH {_TABLES}, {_FOUND.replace('FROM pro WHERE', 'FROM pro WHERE category = ' + chr(39) + '1-URGENT' + chr(39) + ' AND')} {_CHAT}")
def api_chat_stream(spark, sf):
    """The session of a streamed answer about urgent projects."""
    stored: list[DataFrame] = []
    for _ in api.chat_stream(_chunks(spark, sf), _documents(spark, sf), _projects(spark, sf), _entities(spark, sf), ASKED, EMBEDDINGS, _Quoting(), stored.append, category="1-URGENT"):
        pass
    return _session(stored[0])
