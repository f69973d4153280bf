"""Jaccard join, line dedup, embedding dedup and ANN search against brute force and on odd tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from textquarry.llm.ann import nearest
from textquarry.llm.embedding_dedup import near_dedup
from textquarry.llm.line_dedup import drop_repeated_lines, keep_unrepeated
from textquarry.llm.ngram_jaccard import keep_one_per_class, ngram_jaccard

DOCS = "doc_id long, text string, component_id string, n_lines int, node long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    base = [[word() for _ in range(rnd.choice([6, 20, 60, 200]))] for _ in range(12)]
    passage = [word() for _ in range(55)]
    texts = [None, "", " \n\t", "One two", "one TWO", "é à"]
    for b in base:
        for _ in range(6):
            copy = list(b)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rnd.choice([3, 10, 25]))]) for _ in range(20)]
    texts += [texts[10].upper(), " ".join(word() for _ in range(4000)), texts[10]]
    return texts


def test_jaccard(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = classes(len(sets), links)
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(sets))}
    kept = keep_one_per_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_jaccard_postings_that_count():
    """A pass over sorted postings keeps all that may count for a link with another group and few others, however batches are cut."""
    import numpy as np
    import pyarrow as pa
    from textquarry.llm.ngram_jaccard import _viable

    def may_link(a, b):
        need = max(-(-(a[2] + b[2]) * 75 // 175) + (-max(a[2], b[2]) * 75 // 100) + 1, 1)
        return a[4] != b[4] and 4 * a[2] >= 3 * b[2] and 4 * b[2] >= 3 * a[2] and min(a[3], b[3]) >= need

    rnd = random.Random(8)
    rows = sorted((rnd.choice([1, 2, 3, rnd.randrange(200)]), i, rnd.randrange(5, 90), rnd.randrange(1, 12), i % 7, 1) for i in range(400))
    names = ["token", "node", "n", "have", "comp", "weight"]
    want = set()
    for token in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == token]
        want |= set(own) if len(own) > 32 else {a for a in own if any(may_link(a, b) for b in own)}
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows[i : i + size], strict=True)], names=names) for i in range(0, len(rows), size)]
        assert {tuple(r.values()) for b in _viable(75, 100)(iter(batches)) for r in b.to_pylist()} == want


def test_jaccard_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, long), (7, long), (7, long), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(df).collect()), key=str)
    assert got == sorted([(None, 26, 7), (7, 26, 7), (7, 26, 7), (9, 0, 9), (None, 0, None)], key=str)
    assert ngram_jaccard(df.limit(0)).count() == 0


def lines_brute(rows, least=5):
    """The kept text of (id, text) rows; ids are unique."""
    said = sorted((d, i, tuple(re.split(r"[ \t\x0b\f\r]+", line.lower().strip(" \t\x0b\f\r")))) for d, t in rows if t is not None for i, line in enumerate(t.split("\n")))
    said = [s for s in said if len(s[2]) >= least]

    def near(a, b):
        if a == b:
            return True
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = {said[j][:2] for j in range(len(said)) if any(near(said[i][2], said[j][2]) for i in range(j))}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_lines(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghij") * 3
    base = [[word() for _ in range(rnd.randrange(3, 14))] for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "a b c d\na b c d"), (4, "x " * 600 + "\n" + "x " * 599)]
    for d in range(5, 60):
        lines = []
        for _ in range(rnd.randrange(1, 7)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(line))
                line[at : at + 1] = rnd.choice([[word()], [], [line[at], word()]])
            lines.append(" ".join(line).capitalize() if rnd.random() < 0.5 else "  ".join(line) + " ")
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, "c", 5) for d, t in rows], "doc_id long, text string, doc string, n_lines int").repartition(3)
    out = drop_repeated_lines(df)
    assert {r.doc_id: r.text for r in out.collect()} == lines_brute(rows)
    assert sorted(out.columns) == sorted([*df.columns, "n_dropped"])
    kept = keep_unrepeated(df)
    assert kept.columns == df.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}


def test_lines_odd_tables(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(None, line), (4, line), (4, line), (4, line + "\nzz")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped) for r in drop_repeated_lines(df).collect()), key=str)
    assert [g for g in got if g[0] is None] == [(None, 1, 1)] and sorted(g[2] for g in got if g[0] == 4) in ([0, 0, 1], [0, 1, 1])
    assert drop_repeated_lines(df.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string"


def vectors(n=600, dim=16, copies=40):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    for i in range(copies):
        x[n - 1 - i] = x[i // 4] + 0.05 * rng.standard_normal(dim)
    x[50] = x[51]
    return x.astype(np.float32)


ODD = [(1001, None, 1, "x"), (1002, [0.0] * 16, 1, "x"), (1003, [float("nan")] + [1.0] * 15, 1, "x"), (1004, [float("inf")] * 16, 1, "x"), (1005, [1.0], 1, "x"), (1006, [None] + [1.0] * 15, 1, "x")]


def test_embedding_dedup(spark):
    x = vectors()
    label = np.arange(len(x)) % 3
    label[:10], label[-40:] = 0, 0
    label[50:52] = 1
    rows = [(i, x[i].tolist(), int(label[i]), "n") for i in range(len(x))] + ODD + [(2000, x[50].tolist(), None, "x")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, VECTORS)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i, j in combinations(range(len(x)), 2) if label[i] == label[j] and u[i] @ u[j] >= 0.93]
    found = sum(got[i][0] for i in range(len(x))) / 2
    assert 0.9 * len(links) <= found <= len(links)
    want = classes(len(x), links)
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) > 0.98
    assert got[50][0] >= 1 and got[51][1] == got[50][1]
    assert all(got[o[0]] == (0, o[0], True) for o in ODD) and got[2000] == (0, 2000, True)
    assert near_dedup(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest(spark):
    x = vectors()
    df = spark.createDataFrame([(i, x[i].tolist(), 0, "n") for i in range(len(x))] + ODD, VECTORS)
    got = nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, len(x), 20):
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len({o[1] for o in own} & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert [o[0] for o in own] == list(range(1, 11)) and all(o[2] == pytest.approx(d[o[1]], abs=1e-12) for o in own)
        assert own == sorted(own, key=lambda o: (o[2], o[1]))
    assert hits >= 0.9 * 10 * len(range(0, len(x), 20))
    assert not [r for r in got if r.query_id > 999 or r.vec_id > 999]


def test_nearest_ties_and_few(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 5").limit(1)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert nearest(df.where("vec_id < 3"), df.where("vec_id = 0").limit(1)).count() == 2
    assert nearest(df.limit(0), df).count() == 0


def test_jaccard_between_large_groups(spark, monkeypatch):
    """Groups of near copies whose members almost or just reach each other: one pair of two groups is tried first."""
    from textquarry.llm import ngram_jaccard as module

    rounds = []
    verified = module._verified
    monkeypatch.setattr(module, "_verified", lambda *a: rounds.append(1) or verified(*a))
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for share in (8, 13, 14, 15, 16, 40):
        base = [word() for _ in range(120)]
        other = base[:-share] + [word() for _ in range(share)]
        for own in (base, other):
            for _ in range(25):
                text = list(own)
                text[rnd.randrange(len(text) - 50)] = word()
                rows.append(" ".join(text))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard(df).collect()}
    sets = [shingles(t) for t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = classes(len(rows), links)
    assert [got[i] for i in range(len(rows))] == want
    assert len(rounds) == 3


def test_one_of_each_class(spark):
    long, far = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(5, long, "b"), (5, far, "c"), (5, long, "a"), (6, long + " x", "a"), (None, far, "n"), (None, "w1 w2", "n"), (8, None, "p"), (8, None, "q"), (9, " ", "r"), (3, "w1 w2", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = [(5, long, "a"), (5, far, "c"), (8, None, "p"), (8, None, "q"), (9, " ", "r"), (3, "w1 w2", "s")]
    assert sorted(map(tuple, keep_one_per_class(df).collect()), key=str) == sorted(want, key=str)
    assert keep_one_per_class(df.limit(0)).count() == 0


def test_embedding_dedup_long_keys(spark, monkeypatch):
    """Recall of pairs just above the threshold with the keys and tables of a larger corpus; a hot label in several blocks."""
    from textquarry.llm import embedding_dedup as module

    monkeypatch.setattr(module, "BUCKET", 1)
    monkeypatch.setattr(module, "BLOCK", 64)
    assert module.tables(3000, 0.93)[0] == 12 and module.tables(10**9, 0.93)[0] > module.tables(10**6, 0.93)[0]
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((1500, 32))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.925, 0.96, (1500, 1))
    y = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * off])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(y)] + [(i, y[0].tolist(), 1) for i in (3000, 3001)] + [(0, y[0].tolist(), 1)]
    got = {}
    for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    gram = y @ y.T >= 0.93
    np.fill_diagonal(gram, False)
    plain = [i for i in range(1, 3000) if not gram[i, 0]]
    want, found = sum(gram[i].sum() for i in plain), sum(got[i][0][0] for i in plain)
    assert 0.95 * want <= found <= want
    assert len(got[0]) == 2 and got[0][0] == got[0][1] and got[3000][0][1] == 0 and got[0][0][0] == 3 + gram[0].sum()
