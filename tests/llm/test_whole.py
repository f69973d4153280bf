"""Cases in which an operator once did less than the whole job."""

import math
import random
import zlib
from collections import Counter

import pytest

from textquarry.llm import language_id as li
from textquarry.llm import lm_score as lm
from textquarry.llm.ngram_jaccard import ngram_jaccard


def test_jaccard_members_below_the_bound(spark):
    """A member that shares too few prefix tokens to be a partner must not take the place of one that does.

    q links to m2 alone; m holds t, the rarest token that q shares with the group. Words are
    shingles (k=1), and each case draws other words, so other orders of their hashes.
    """
    rnd, rows, want = random.Random(7), [], {}
    for case in range(60):
        draw = lambda n: [f"{rnd.getrandbits(60):x}" for _ in range(n)]
        p, t, x = draw(99), draw(1), draw(31)
        texts = [p + t, p + x, p[:40] + p[41:] + t + draw(31), p[:81] + x + t + draw(17), *[x + draw(500) for _ in range(5)]]
        for i, words in enumerate(texts):
            rows.append((case * 10 + i, " ".join(words)))
            want[case * 10 + i] = case * 10 + (i if i > 3 else 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_jaccard(df, k=1).collect()}
    assert {k for k in want if got[k] != want[k]} == set()


def test_lm_rare_pairs(spark, monkeypatch):
    """Every word and pair counts, once seen is enough, where nothing is broadcast as well."""
    monkeypatch.setattr(lm, "COUNTED", 0.2)
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.randrange(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = {i: ["", *t.split(), ""] for i, t in rows}
    learned = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    word = Counter(w for t in learned for w in t[1:])
    pair = Counter(p for t in learned for p in zip(t, t[1:], strict=False))
    whole = sum(word.values()) + len(word) + 1
    c = lambda n: float(lm.count_of(lm.levels_of([n]))[0]) if n else 0.0

    def p(v, w):
        single = (c(word[w]) + 1) / whole
        return min(0.7 * min(c(pair[v, w]) / c(word[v]), 1) + 0.3 * single, 1) if word[v] else single

    assert sum(n == 1 for n in pair.values()) > 50
    for share in (0, 1 << 30):
        got = {r.doc_id: (r.score, r.base_score) for r in lm.lm_score(df, broadcast_bytes=share).collect()}
        for i, t in tokens.items():
            assert got[i][0] == pytest.approx(sum(math.log10(p(v, w)) for v, w in zip(t, t[1:], strict=False)), rel=1e-3)
            assert got[i][1] == pytest.approx(sum(math.log10((word[w] + 1) / whole) for w in t[1:]), rel=1e-9)


def test_many_languages(spark):
    """Every language found gets a dictionary."""
    rnd = random.Random(13)
    words = {f"l{i:03d}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for i in range(205)}
    rows = [(3 * i + j, " ".join(rnd.choice(own) for _ in range(20)), lang) for i, (lang, own) in enumerate(words.items()) for j in range(3)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.languages) == sorted(words)
    assert model.predict(" ".join(words["l204"]))[0] == "l204"


def test_pipeline_odd_tables(spark, tmp_path):
    """Null ids, texts, langs and sources, repeated rows and ids, clashing columns; and an empty table."""
    import corpus_pipeline

    rnd = random.Random(21)
    words = {"en": "the of and house river with that from green light morning story".split(), "fr": "le la des avec maison rivière que dans vert lumière matin histoire".split()}
    prose = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang, 60), lang, "a" if i % 3 else None) for i, lang in enumerate(["en", "fr"] * 40)]
    rows += [rows[5]] * 3 + [(6, prose("en", 50), "en", "a"), (None, prose("fr", 50), "fr", "b"), (None, None, None, None), (90, "", "en", "a"), (91, "1 2 3", None, "a"), (92, prose("en", 40), None, "b"), (93, rows[9][1] + " end", "fr", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, taken long, ids string"
    full = [(*r, len(r[1]) if r[1] is not None else None, "clash", 7, "clash") for r in rows]
    for name, table in (("some", spark.createDataFrame(full, schema)), ("none", spark.createDataFrame([], schema))):
        folder = f"{tmp_path}/{name}"
        table.coalesce(2).write.parquet(f"{folder}/documents.parquet")
        docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
        for stage, f in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(f(spark, docs, folder).toArrow())
            seen[stage] = docs
            if stage != "sequences":
                assert docs.columns == table.columns
        out = corpus_pipeline.run(spark, folder)
        assert out.count() == docs.count() and (docs.count() > 0) == (name == "some")
        if name == "none":
            continue
        kept = [(r.doc_id, r.text) for r in seen["near_copies"].collect()]
        assert len(kept) == len(set(kept)) and sum(k == 6 for k, _ in kept) == 2 and sum(k is None for k, _ in kept) == 1
        assert not {90, 91, 93} & {k for k, _ in kept} and {92, 5, 9} <= {k for k, _ in kept}
        assert set(kept) >= {(r.doc_id, r.text) for r in seen["mixture"].collect()}
        assert sum(r.doc_tokens for r in docs.where("start = 0").collect()) == sum(r.length for r in docs.collect())
