"""Vector search with joins, result deduplication and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..functions.vectors import cosine
from .rollups import with_phase
from .vector_index import VectorIndex

CHUNKS, PROJECTS = 10, 5


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be a positive integer, not {limit!r}")
    return limit


def top_k(rows: DataFrame, vector: Column, k: int, embedding: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows most similar to vector, with similarity; ties to the smaller id. Rows without a usable embedding are left out.

    Only the scan of ids and embeddings feeds the scores, and each task keeps k rows.
    """
    scored = rows.where(F.col(embedding).isNotNull()).withColumn("similarity", cosine(F.col(embedding), vector)).where("similarity is not null")
    return scored.orderBy(F.col("similarity").desc(), id_col).limit(check_limit(k))


def owned_top_k(chunks: DataFrame, documents: DataFrame, vector: Column, k: int, index: VectorIndex | None = None) -> DataFrame:
    """(id, document_id, similarity) of the k best chunks that have a document.

    Ids and embeddings are scored (or an index is asked) before anything is joined; the documents of the few that are
    found are looked up by id, and where chunks without one take places, more are asked for.
    """
    want = check_limit(k)
    while True:
        if index is None:
            found = top_k(chunks.select("id", "document_id", "embedding"), vector, want).select("id", "document_id", "similarity")
        else:
            asked = chunks.sparkSession.range(1).select(F.lit(0).alias("query_id"), vector.alias("embedding"))
            best = index.search(asked, want).select("id", "similarity")
            found = chunks.select("id", "document_id").join(F.broadcast(best), "id")
        rows = found.collect()
        of = sorted({r["document_id"] for r in rows if r["document_id"] is not None})
        there = {r[0] for r in documents.where(F.col("id").isin(of)).select("id").collect()} if of else set()
        owned = sorted((r for r in rows if r["document_id"] in there), key=lambda r: (-r["similarity"], r["id"]))
        if len(owned) >= k or len(rows) < want:
            return chunks.sparkSession.createDataFrame([tuple(r) for r in owned[:k]], found.schema)
        want *= 4


def search_chunks(chunks: DataFrame, documents: DataFrame, entities: DataFrame, vector: Column, limit: int = CHUNKS, index: VectorIndex | None = None) -> DataFrame:
    """The best chunks with their document and its entity. The k chunks are found before anything is joined to them, by a stored index if one is given."""
    best = owned_top_k(chunks, documents, vector, limit, index)
    ids, of = ([r[0] for r in best.select(c).distinct().collect()] for c in ("id", "document_id"))
    best = F.broadcast(best.select("id", "similarity"))
    docs = documents.where(F.col("id").isin(of)).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("url").alias("document_url"), "org_id")
    names = entities.select(F.col("id").alias("org_id"), F.col("name").alias("entity_name"))
    out = chunks.where(F.col("id").isin(ids)).join(best, "id").join(docs, "document_id").join(names, "org_id", "left")
    return out.select("id", "document_id", "section_title", "content", "similarity", "document_title", "document_url", "entity_name").orderBy(F.col("similarity").desc(), "id")


def search_projects(projects: DataFrame, entities: DataFrame, vector: Column, limit: int = PROJECTS) -> DataFrame:
    """The best projects with their entity and phase."""
    best = top_k(projects, vector, limit)
    names = entities.select(F.col("id").alias("org_id"), F.col("name").alias("entity_name"))
    return with_phase(best.join(names, "org_id", "left")).orderBy(F.col("similarity").desc(), "id")


def best_per_document(found: DataFrame, document: str = "document_id", id_col: str = "id") -> DataFrame:
    """The best chunk of each document among those found; the limit was applied before."""
    order = Window.partitionBy(document).orderBy(F.col("similarity").desc(), id_col)
    return found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def document_results(found: DataFrame) -> DataFrame:
    """Search results for documents: one row each, with an excerpt."""
    best = best_per_document(found)
    return best.select(F.col("document_id").alias("id"), F.col("document_title").alias("title"), F.col("document_url").alias("url"), F.col("entity_name").alias("entity"), F.col("section_title").alias("matched_section"), excerpt(F.col("content")).alias("excerpt"), F.col("similarity").alias("relevance"))


def context_groups(found: DataFrame, document: str = "document_id", id_col: str = "id", content: str = "content") -> DataFrame:
    """Chunks found, grouped by document: place (documents by their best chunk, from 1), n_chunks, content in order of similarity."""
    ranked = found.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), id_col)))
    own = F.sort_array(F.collect_list(F.struct("_rank", F.col(content).cast("string").alias("c"))))
    groups = ranked.groupBy(document).agg(F.min("_rank").alias("_first"), F.count("*").alias("n_chunks"), F.array_join(F.transform(own, lambda x: x["c"]), "\n\n").alias("content"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy("_first"))).select("place", document, "n_chunks", "content")


def format_context(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """One row, one column: what a model is given about the chunks and projects found."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c, F.lit("\n"))).otherwise("")
    order = Window.orderBy(F.col("similarity").desc(), "id")
    head = F.concat(F.lit("### "), F.coalesce(F.nullif("document_title", F.lit("")), F.lit("Untitled")), F.lit("\n**Source**: "), F.coalesce("document_url", F.lit("")), F.lit("\n"), line("**Entity**", F.col("entity_name")), F.lit("\n"))
    body = F.concat(F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit("**"), "section_title", F.lit("**\n"))).otherwise(""), "content", F.lit("\n\n"))
    ranked = chunks.withColumn("r", F.row_number().over(order)).select("document_id", "r", head.alias("head"), body.alias("body"))
    joined = lambda s, f: F.array_join(F.transform(F.sort_array(F.collect_list(s)), f), "")
    docs = ranked.groupBy("document_id").agg(F.min("r").alias("r"), F.concat(F.min_by("head", "r"), joined(F.struct("r", "body"), lambda x: x["body"])).alias("text"))
    docs = docs.agg(F.count("*").alias("n"), joined(F.struct("r", "text"), lambda x: x["text"]).alias("docs"))
    money = F.when(F.col("estimated_value").isNotNull(), F.concat(F.lit("$"), F.call_function("format_number", F.col("estimated_value").cast("double"), F.lit("#,##0.###"))))
    text = F.concat(
        F.lit("### "), "phase_emoji", F.lit(" "), "title", F.lit("\n- **Phase**: "), "phase_label", F.lit(" - "), "phase_description", F.lit("\n"), line("- **Entity**", F.col("entity_name")), line("- **Category**", F.col("category")),
        line("- **Est. Value**", money), line("- **Fiscal Year**", F.nullif(F.col("fiscal_year"), F.lit(0)).cast("string")), line("- **Description**", F.col("description")), F.lit("\n"),
    )
    found = projects.withColumn("r", F.row_number().over(order)).select("r", text.alias("text")).agg(F.count("*").alias("m"), joined(F.struct("r", "text"), lambda x: x["text"]).alias("projects"))
    whole = F.concat(F.when(F.col("n") > 0, F.concat(F.lit("## Retrieved Documents\n\n"), "docs")).otherwise(""), F.when(F.col("m") > 0, F.concat(F.lit("\n## Related Projects in Pipeline\n\n"), "projects")).otherwise(""))
    return docs.crossJoin(found).select(whole.alias("context"))  # one row each
