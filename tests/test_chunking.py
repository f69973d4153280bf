from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.operators import chunking as C


def words(text):
    return len(text.split())


def titled(md):
    return [(s.title, s.content) for s in C.sections(md)]


def test_headers():
    assert titled("plain text") == [("Document", "plain text")]
    assert titled("intro\n\n## A\nbody a\n### B\nbody b") == [("Introduction", "intro"), ("A", "body a"), ("B", "body b")]
    assert titled("## A\n## B\nx") == [("B", "x")]
    assert titled("## A") == [("A", "## A")]
    assert titled("##\n\nfoo") == [("foo", "foo")]
    assert titled("# T\n#### x\nbody") == [("Document", "# T\n#### x\nbody")]


def test_merge_small():
    sized = lambda *n: [C.Section(str(i), "w " * k) for i, k in enumerate(n)]
    assert [s.title for s in C.merged(sized(50, 50, 150, 20), words)] == ["0", "2"]
    assert len(C.merged(sized(150, *[20] * 60), words)) == 1


def test_large_section():
    body = "\n\n".join("w " * n for n in (600, 300, 300))
    assert [(t, n) for t, _, n in C.parts(C.Section("T", body), words)] == [("T", 900), ("T (continued)", 325)]


def test_sentences_and_words():
    assert C.by_sentences("a b. C d", words) == ["a b. C d"]
    long = "x " * 700 + "end. " + "Y " * 700
    assert [words(p) for p in C.by_sentences(long, words)] == [701, 700]
    assert [words(p) for p in C.by_words("z " * 2500, words)] == [1000, 1000, 501 - 1]


def test_blank():
    assert C.chunk_text("") == C.chunk_text(" \n") == C.chunk_text(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["## H\n", "### K\n", "word ", "A sentence. ", "\n\n", "x" * 50 + " "]), max_size=60))
def test_indices_are_dense_and_words_stay(parts):
    md = "".join(parts)
    chunks = C.chunk_text(md, words)
    assert [c[3] for c in chunks] == list(range(len(chunks)))
    text = " ".join(c[1] for c in chunks)
    body = [w for line in md.split("\n") if not line.startswith("#") for w in line.split()]
    assert all(w in text for w in body)


def test_spark_form_equals_the_plain_one(spark):
    docs = [(1, "intro\n## A\n" + "w " * 3000), (2, None), (3, "## B\nshort"), (4, "")]
    rows = C.chunk_documents(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    want = [(d, *c) for d, t in docs for c in C.chunk_text(t)]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_merge_in_sql_equals_the_plain_one(spark):
    docs = [(1, "a" * 120 + "\nb\nc\n" + "d" * 100), (2, "x\ny")]
    df = C.lines_of(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    got = {(r.doc_id, r.group): r.content for r in C.merge_small_sections(df, "doc_id", "position", "content", F.length("content")).collect()}
    for d, t in docs:
        own = C.merged([C.Section("", x) for x in t.split("\n")], len)
        assert [got[d, i + 1] for i in range(len(own))] == [s.content for s in own]


def test_chunks_leave_a_worker_as_they_are_made(spark):
    """A worker gets short batches of texts and hands its chunks on before a batch is done."""
    from textquarry.operators import chunking
    from textquarry.runtime import ARROW_ROWS

    texts = spark.createDataFrame([(i, "plain words " * 20_000) for i in range(12)], "id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    chunks = chunking.chunk_documents(texts, "id", "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == ARROW_ROWS
    got = [(r.id, r.chunk_index) for r in chunks.select("id", "chunk_index").collect()]
    assert len(got) == len(set(got)) == 12 * len(chunking.chunk_text("plain words " * 20_000))
