"""Packing, mixing, language ID, LM scoring, quality, extraction and the pipeline on small tables."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from textquarry.llm import lm_score as lm
from textquarry.llm.html_extract import extract, html_extract
from textquarry.llm.language_id import MARGIN, LanguageModel, keep_identified, language_id, margin
from textquarry.llm.lm_score import Shape, count_of, levels_of, lm_score
from textquarry.llm.mixing import mix, take
from textquarry.llm.packing import WordTokenizer, difference, pack, windows
from textquarry.llm.quality import quality, sketch
from textquarry.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, score int"
WORDS = {"en": "the of and house river with that from green light morning story", "fr": "le la des avec maison rivière que dans vert lumière matin histoire", "de": "der die und mit haus fluss dass von grün licht morgen geschichte"}


def documents(n=160, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        words = WORDS[lang].split()
        lines = [" ".join(rnd.choice(words) + rnd.choice(["", "", "s", "en"]) for _ in range(rnd.randrange(6, 25))) for _ in range(rnd.randrange(1, 9))]
        text = ".\n".join(lines)
        out.append((i, text, lang, rnd.choice(["b", "a", None, "c"]), len(text), "k", 1))
    return [*out, (900, None, "en", "a", 0, "k", 1), (901, "", None, "b", 0, "k", 1), (None, "the river of light and the morning", "en", None, 3, "k", 1), (902, "123 ... 456", "en", "c", 3, "k", 1), (903, "the " * 9000, "en", "a", 3, "k", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


def test_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(vocabulary()), WordTokenizer(vocabulary())
    texts = ["Don't we'll I'M <|endoftext|>x a é ́ 東京 １２ 'S's '''ve 12ab3", "", " \n\t", *[d[1] for d in documents(20) if d[1]]]
    for text, got in zip(texts, own([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_tokenizer_of_another_kind():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), WordTokenizer(path)
    assert not own.by_words
    texts = ["Don't  we'll I'M x", "", " \n\tab"]
    assert [np.frombuffer(got, np.uint32).tolist() for got in own([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_difference():
    sizes = [8, 7, 6, 5, 4]
    sums = sorted(sum(sizes[i] for i in own) for own in difference(sizes, 2))
    assert sum(sums) == 30 and sums[1] - sums[0] <= 2
    rnd = random.Random(2)
    items = [(i, 0, rnd.randrange(1, 4096)) for i in range(200)]
    filled = windows(items, 4096)
    total = sum(x[2] for x in items)
    assert max(sum(x[2] for x in own) for own in filled) <= 4096 and len(filled) * 4096 <= max(total * 17 / 16, total + 4096)
    assert sum(x[2] for own in filled for x in own) == total


def test_window_count_rises():
    items = [(i, 0, 1300) for i in range(360)]  # 115 windows could hold all tokens, but only three whole items fit in one
    least = -(-360 * 1300 // 4096)
    assert max(map(len, difference([1300] * 360, least))) > 3
    filled = windows(items, 4096)
    assert least < len(filled) == 120 and all(len(own) == 3 for own in filled)  # nothing is cut
    rnd = random.Random(5)
    small = [(i, 0, rnd.randrange(1, 600)) for i in range(2000)]
    assert sorted(x for own in windows(small, 4096) for x in own) == small  # nothing is cut
    assert windows([], 4096) == []


def test_pack_pads_little(spark):
    rnd = random.Random(6)
    rows = [(i % 400, " ".join(rnd.choice(["alpha", "Beta", "gamma,", "x1"]) for _ in range(rnd.randrange(1, 900))), "clash", 3) for i in range(800)]
    rows += rows[:5] + [(None, None, None, None)] * 3
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").coalesce(1), vocabulary(), with_ids=False).collect()
    tokens, sequences = sum(r.length for r in out), {r.sequence_id for r in out}
    assert len(sequences) * 4096 <= max(tokens * 17 / 16, tokens + 4096)
    assert len([r for r in out if r.doc_id is None]) == 3 and all(r.length == 1 for r in out if r.doc_id is None)
    assert sum(r.start == 0 for r in out) == len(rows)


def test_pack(spark, docs):
    tok = WordTokenizer(vocabulary())
    rows = pack(docs, vocabulary()).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for key, text in texts.items():
        ids = next(tok([text.encode()])) + np.uint32(2).tobytes()
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and {r.doc_tokens for r in own} == {len(ids) // 4}
        assert b"".join(np.array(r.ids, np.uint32).tobytes() for r in own) == ids
        assert all(zlib.crc32(np.array(r.ids, np.uint32).tobytes()) == r.ids_crc32 for r in own)
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096
    assert pack(docs.limit(0), vocabulary()).count() == 0


def test_mix(spark, docs):
    docs = docs.where("doc_id is null or doc_id <> 903")  # larger than its source's target
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
    total, weight = sum(sizes.values()), {"a": 1, "b": 2, "c": 3, None: 1}
    capped: set = set()
    while True:
        rest = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and rest * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        own = [r for r in rows if source[r.doc_id] == s]
        target = 3 * sizes[s] if s in capped else rest * weight[s]
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
    assert sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    taken = take(docs)
    times = Counter(r.doc_id for r in taken.collect())
    assert taken.columns == docs.columns and times == {r.doc_id: r["taken"] // r["size"] for r in rows if r["taken"]}
    assert mix(docs.limit(0)).count() == 0 and mix(docs.where("doc_id in (900, 901)")).count() == 2


def test_language(spark, docs):
    rows = {r.doc_id: r for r in language_id(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    held = [r for k, r in rows.items() if r.held_out and k < 900]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert {rows[k].lang_pred for k in (900, 901, 902)} == {"und"} and rows[900].score == 0 and all(0 <= r.score <= 1 for r in rows.values())
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= docs.count() - 5
    assert language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_lm(spark, docs):
    rows = {r.doc_id: r for r in lm_score(docs).collect()}
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [*(r.text or "").encode().translate(lower).split(), None] for r in docs.collect()}
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(t for k, own in tokens.items() if k is not None and not held(k) for t in own)
    n, v = sum(count.values()), len(count)
    for k, own in tokens.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(own), sum(count[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), rel=1e-12)
        assert r.score <= 0
    quantised = lambda k: 0 if not k else 1 if k == 1 else 2 ** ((math.floor(2 * math.log2(k) + 1e-9) + 0.5) / 2)
    pairs = Counter(p for k, own in tokens.items() if k is not None and not held(k) for p in zip([None, *own], own))  # noqa: B905
    for k, own in tokens.items():
        want = 0.0
        for a, b in zip([None, *own], own):  # noqa: B905
            single = (quantised(count[b]) + 1) / (n + v + 1)
            both = min(quantised(pairs[a, b]) / quantised(count[a]), 1) if count[a] else 0
            want += math.log10(min(0.7 * both + 0.3 * single, 1) if count[a] else single)
        assert rows[k].score == pytest.approx(want, rel=2e-3, abs=1e-9), k  # a false positive may raise a word
    exact = lambda a, b: 0.7 * pairs[a, b] / count[a] + 0.3 * (count[b] + 1) / (n + v + 1)
    first = next(iter(count))
    assert sum(exact(first, b) for b in count) + 0.3 / (n + v + 1) == pytest.approx(1)
    far = {r.doc_id: r for r in lm_score(docs, broadcast_bytes=0).collect()}
    assert far == rows
    twice = lm_score(docs.unionByName(docs.where("doc_id = 3"))).where("doc_id = 3").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lm_score(docs.limit(0)).count() == 0 and lm_score(docs.where("doc_id is null")).first().train_tokens == 0


def test_lm_counts_broadcast(spark, docs, monkeypatch):
    """As many frequent words as fit are broadcast, whatever their share of the tokens; with fewer of them the rows stay."""
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 9 + [2, 3, 8, 9, 1 << 40])], "word long, n long")
    for most, least in ((14, 1), (13, 2), (5, 2), (4, 8), (3, 8), (2, 1 << 40), (0, 1 << 62)):
        monkeypatch.setattr(lm, "COUNTED", most)
        assert lm._least(counts) == least
    rows = lambda df: sorted(str((*r[:5], round(r.base_score, 8), round(r.score, 8))) for r in df.collect())
    monkeypatch.setattr(lm, "COUNTED", 20)
    few = rows(lm_score(docs))
    monkeypatch.undo()
    assert rows(lm_score(docs)) == few


def test_lm_asks_by_bucket(spark, docs, monkeypatch):
    """A bucket of many slices asks each part of the filter once, for distinct items; the answers are the levels of the whole counts. Copies of a row are folded and kept."""
    words = [f"w{i % 5000}" for i in range(400_000)]
    texts = [" ".join(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    table = {"bucket": [7] * len(texts), "key": list(range(len(texts))), "id": list(range(len(texts))), "text": texts, "copies": [1] * 30 + [-1] * 10}
    asks = list(lm._ask(Shape(512, 1 << 15), 64)(pa.table(table).to_batches()))
    assert sum(b.num_rows for b in asks) == 8
    items = np.concatenate([lm._numbers(x.as_py(), 6) for b in asks for x in b.column(2)])
    n = np.concatenate([lm._numbers(x.as_py(), 5) for b in asks for x in b.column(3)])
    assert len(items) == len(set(items.tolist())) == 5001 + 5002 and set(n.tolist()) == {30, 60} and n.sum() == 2 * 30 * 10_001
    levels = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for ask in asks for b in lm._answer(Shape(512, 1 << 15), 64)([ask]) for x in b.column(2)])
    assert (levels[n > 0] >= levels_of(n[n > 0])).all() and (levels[n > 0] == levels_of(n[n > 0])).mean() > 0.95
    many = docs.where("doc_id < 40 or doc_id is null").unionByName(docs.where("doc_id in (3, 4)").selectExpr("*", "explode(sequence(1, 30))").drop("col"))
    rows = lambda df: sorted(str((*r[:5], round(r.base_score, 8), round(r.score, 8))) for r in df.collect())
    near = rows(lm_score(many))
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    assert rows(lm_score(many, broadcast_bytes=0)) == near


def test_filter():
    items, n = np.arange(200_000, dtype=np.uint64) * np.uint64(977) + np.uint64(5), 1 + np.arange(200_000) % 9
    shape = Shape.of(int(levels_of(n).sum()))
    assert shape.bits * shape.shards < 20 * levels_of(n).sum() and Shape.of(1e12).shards <= 4096
    one = Shape(1, 1 << 23)
    raw = np.frombuffer(one.filled(items, n), np.uint8)
    found = one.levels(raw, items)
    assert (found >= levels_of(n)).all() and (found == levels_of(n)).mean() > 0.97
    assert (one.levels(raw, items + np.uint64(1)) == 0).mean() > 0.97
    assert [round(float(count_of(levels_of(np.array([k])))[0]), 1) for k in (1, 2, 4)] == [1, 2.4, 4.8] and count_of(np.array([0]))[0] == 0


def test_quality(spark, docs):
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in d[1].split()) if i % 2 else " | ".join(d[1].split()), "en", "a", 1, "k", 1) for i, d in enumerate(documents(120, 9)) if d[1]]
    both = docs.unionByName(spark.createDataFrame(bad, DOCS))
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id < 1000), 0) for r in both.where("doc_id < 900 or doc_id >= 1000").collect()] + [(None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and (r.doc_id < 900 or r.doc_id >= 1000)]
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) >= 0.95
    assert sketch(b"Aa  bb bb X9!") == b"Aa a = A0!"
    assert quality(both.limit(0), labels).count() == 0
    assert {r.score for r in quality(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_extract(spark):
    page = '<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">x</a></ul></nav><div class="ad">Buy, buy, buy, now and for ever.</div><article><h1>Head &amp; more</h1><p>One,<br>two&nbsp;  three.<p>Four <b>five</b><script>no</script></p><div class="comments"><p>nice, nice, nice</p></div></article><aside><p>side, side</p></aside><form><p>form</p></form><footer>foot</footer></body></html>'
    rows = [(1, "u", page, "clash"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "plain", "x"), (4, "z", "<p>" + "long, " * 50000, "x"), (5, "q", "<nav>a</nav>", "x")]
    got = {r.page_id: r for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "Head & more\n\nOne, two three.\n\nFour five" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[None].text, got[3].text, got[5].text) == ("", "", "plain", "") and got[4].n_chars == 299_999
    assert extract("<div><section><p>First part, with words.</p></section><section><p>Second part, with words, too.</p></section></div>") == "First part, with words.\n\nSecond part, with words, too."
    for broken in ("<p", "<a href='x", "</p></div>", "<!-- open", "<script>never", "a < b > c", "<" * 50):
        extract(broken)


def test_pipeline(spark, tmp_path):
    from tests.llm.test_pairs import lines_brute, shingles

    rows = [d[:5] for d in documents(80, 3) if d[0] is not None]
    rows += [(700, rows[3][1], rows[3][2], "b", 1), (701, rows[4][1] + "s", rows[4][2], "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).toArrow())
        seen[name] = docs
    texts = {name: {r.doc_id: r.text for r in seen[name].collect()} for name in ("language", "lines", "near_copies", "mixture")}
    assert {900, 901, 902}.isdisjoint(texts["language"]) and len(texts["language"]) >= len(rows) - 5
    assert texts["lines"] == {k: t for k, t in lines_brute(sorted(texts["language"].items())).items() if t.strip()}
    sets = {k: shingles(t) for k, t in texts["near_copies"].items()}
    assert not [1 for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert set(texts["mixture"]) <= set(texts["near_copies"])
    assert seen["sequences"].selectExpr("sum(length)").first()[0] == sum(r.doc_tokens for r in seen["sequences"].where("start = 0").collect())
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in texts)


def test_many_languages(spark):
    """Seventy languages, each with an alphabet of its own order: all are learned, and time follows their number."""
    rnd = random.Random(8)
    words = {f"l{k:02d}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 8))) for _ in range(40)] for k in range(70)}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(words) * 14)]
    table = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    got = language_id(table).collect()
    assert len(got) == len(rows) + 3 and len({r.lang_pred for r in got}) == 70
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out]) > 0.95
    text = " ".join(words["l00"])

    def seconds(n):
        model = LanguageModel(tuple(map(str, range(n))), tuple((" ".join(w) * 20).encode() for w in list(words.values())[:n]), (0.0,) * n)
        model.predict(text)
        began = time.process_time()
        for _ in range(30):
            model.predict(text)
        return time.process_time() - began

    assert seconds(70) < 10 * seconds(35) + 0.2


def test_margin():
    assert margin([]) == MARGIN and margin([(0.1, True), (0.2, True)]) == MARGIN
    found = margin([(0.01, False), (0.02, False), (0.02, True), (0.03, False), (0.05, True), (0.06, True), (0.2, False)])
    assert 0.03 < found < 0.0301


def test_repeats_and_clashes(spark):
    rows = [(i % 50, " ".join(["good clean prose about the sea"] * (1 + i % 3)) if i % 2 else "X!! Y!! Z!!", "en" if i % 2 else "de", "s", 1) for i in range(200)]
    table = spark.createDataFrame([(*r, 7, 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, predicted int, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 1)] * 5, "doc_id long, quality int")
    for out in (quality(table, labels), language_id(table), lm_score(table), mix(table)):
        got = [r[0] for r in out.collect()]
        assert sorted(got) == sorted(r[0] for r in rows)
    one = {r.doc_id: r.score for r in quality(table, labels).collect()}
    assert len({round(one[k], 12) for k in range(0, 50, 2)}) == 1  # equal texts tie
    long = "good clean prose about the sea " * 60_000
    assert quality(spark.createDataFrame([(1, long)], "doc_id long, text string"), labels.limit(0)).first().score == 0.5
