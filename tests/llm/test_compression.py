"""Both compression classifiers against plain loops over zstandard, with ties; every sampled text is in a dictionary."""

import math
import random
import re

import pytest
import zstandard

from textquarry.llm import language_id as li
from textquarry.llm import quality as q


def size(raw: bytes, data: bytes, block: int, level: int = 6) -> int:
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    one = zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(one.compress(data[i : i + block])) for i in range(0, len(data), block)) if data else len(one.compress(b""))


WORDS = {lang: [lang[0] + "".join(random.Random(f"{lang}{i}").choice(s) for s in ["aeiou", "bcdlmnrst", "aeiou", "kpqvwxyz"]) for i in range(120)] for lang in ("la", "mo", "ny")}


def text_of(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, text_of(rnd, lang := rnd.choice(list(WORDS)), rnd.choice([0, 1, 5, 60, 900])) + rnd.choice(["", " 12 É!", "\n"]), lang) for i in range(240)]
    rows += [(900, None, "la"), (901, " 12 ", "la"), (902, rows[0][1], None), (902, rows[0][1], None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language_by_a_plain_loop(spark, docs):
    """The smallest size with the cost of naming the language wins; the score and the rejection follow from the sizes."""
    rows, df = docs
    model = li.fit(df)
    got = {(r.doc_id): (r.lang_pred, r.score, r.rejected) for r in li.identify(df, model).collect()}
    for i, text, _ in rows:
        data = re.sub(r"[\W\d_]+", " ", (text or "").lower()).encode()
        if not data.strip():
            assert got[i] == ("und", 0.0, True)
            continue
        sizes = [size(raw, data, li.BLOCK) + cost for raw, cost in zip(model.dictionaries, model.costs, strict=True)]
        best, second = sorted(sizes)[:2]
        want = model.languages[sizes.index(best)]
        score = 1 / sum(math.exp(-min((s - best) / (li.SOFT * best), 700)) for s in sizes)
        assert got[i][0] == want and got[i][1] == pytest.approx(score) and got[i][2] == (1 - best / second < model.margin)


def test_all_sampled_texts_are_used(spark):
    rnd = random.Random(2)
    rows = [(i, text_of(rnd, "la", 200), "la") for i in range(700)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.dictionaries[0]) == li.DICT_TEXTS * (li.SAMPLE_BYTES + 1) - 1
    labels = spark.createDataFrame([(i, 1) for i in range(700)], "doc_id long, quality int")
    fitted = q.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    pieces = min(q.DICT_TEXTS, len(range(1, 701, (q.DICT_TEXTS + q.FIT_TEXTS) // q.DICT_TEXTS)))
    assert len(fitted.texts[1]) == pieces * (q.PIECE + 1) - 1 and fitted.texts[0] == b"\n" * 8
    assert fitted.sketches[1].count(b"\n") == q.SKETCH_TEXTS - 1


def test_language_ties_go_to_the_more_frequent(spark):
    """Equal dictionaries: sizes tie but for the cost of the name."""
    rows = [(i, "same words again", "aa" if i % 3 else "bb") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.LanguageModel(("aa", "bb"), (b"same words", b"same words"), (0.0, 0.0))
    assert model.predict("same words again")[0] == "aa"
    assert li.fit(df).predict("same words again")[0] == "aa"


def test_quality_by_a_plain_loop(spark, docs):
    """Features are size differences over sums for the text and its sketch; equal texts score alike."""
    rows, df = docs
    labels = spark.createDataFrame([(i, int(lang == "la")) for i, _, lang in rows if i < 240], "doc_id long, quality int")
    model = q.fit(df, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in q.score(df, model).collect()}
    for i, text, _ in rows:
        data = (text or "").encode()
        x = []
        for raws, form in ((model.texts, data), (model.sketches, q.sketch(data))):
            bad, good = (size(raw, form, q.BLOCK) for raw in raws)
            x.append((bad - good) / (bad + good))
        z = model.weights[0] * x[0] + model.weights[1] * x[1] + model.weights[2]
        assert got[i][0] == pytest.approx(1 / (1 + math.exp(-z))) and got[i][1] == int(got[i][0] >= 0.5)
    assert got[0] == got[902]
