"""Vector codes, filter audit and suffix dedup against brute force, and their odd inputs."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from textquarry.llm import suffix_dedup as sd
from textquarry.llm import vector_codes as vc
from textquarry.llm.filter_audit import audit


# --------------------------------------------------------------------------- suffix dedup


def removed(texts: list[str | None], length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting every string of that length."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def check_suffixes(spark, texts, length, **options):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length, **options).collect()}
    want = dict(enumerate(removed(texts, length)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def passages(seed: int, letters: str, size: int) -> list[str]:
    rnd = random.Random(seed)
    draw = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    stock = [draw(rnd.randrange(size, 3 * size)) for _ in range(6)]
    out = []
    for _ in range(70):
        text = ""
        for _ in range(rnd.randrange(6)):
            p = rnd.choice(stock)
            i, j = sorted((rnd.randrange(len(p)), rnd.randrange(len(p))))
            piece = list(p[i:j])
            if piece and rnd.random() < 0.4:
                piece[rnd.randrange(len(piece))] = draw(1)
            text += rnd.choice(["", draw(rnd.randrange(size))]) + "".join(piece)
        out.append(text)
    return out + [out[3], out[3], "", None, letters[0] * 5 * size, letters[0] * 3 * size, "é" * size * 2]


@pytest.mark.parametrize("seed, letters, length", [(1, "ab", 8), (2, "abcdefgh ", 40), (3, "abcdefghijé ", 200)])
def test_suffix_dedup(spark, seed, letters, length, monkeypatch):
    """Random pieces of common passages with single edits; keys of more than two rows count as hot."""
    monkeypatch.setattr(sd, "HOT_ROWS", 2)
    monkeypatch.setattr(sd, "BITS", sd.ROW_BITS * (1 if seed == 2 else 64))
    check_suffixes(spark, passages(seed, letters, length), length)


@pytest.mark.parametrize("chunk", [16, 50, 1 << 20])
def test_anchors_of_long_texts(chunk, monkeypatch):
    """Whatever the size of the pieces, every window of every text is in one run, and its anchor's place depends on its bytes alone."""
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rnd = random.Random(chunk)
    texts = [bytes(rnd.choice(b"ab") for _ in range(n)) for n in (0, 3, 8, 40, 7, 200, 90, 90)]
    offsets = np.cumsum([0, *map(len, texts)])
    seen, places = Counter(), {}
    with np.errstate(over="ignore"):
        for run in sd.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, 8):
            for text, at, lo, hi, _ in zip(*run, strict=True):
                for start in range(lo, hi + 1):
                    seen[int(text), int(start - offsets[text])] += 1
                    places.setdefault(texts[text][start - offsets[text] : start - offsets[text] + 8], set()).add(int(at - start))
    assert seen == Counter({(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - 7)})
    assert all(len(p) == 1 for p in places.values())


def test_suffix_levels(spark):
    """Five batches lie in levels of four and one; seeds are what occurs twice, in one batch or in two."""
    from textquarry.llm.common import Scratch

    family = sd.SuffixLevels(spark, Scratch(spark))
    batches = [[1, 2, 2], [3], [1, 4], [5], [5, 6]]
    for batch in batches:
        family.add(spark.createDataFrame([(g,) for g in batch], "g long"))
    assert [rank for rank, _ in family.levels] == [2, 0]
    assert sorted(tuple(r) for r in family.seeds().collect()) == [(1, 2), (2, 2), (5, 2)]
    name = family.levels[0][1]
    plan = spark.table(name).join(spark.table(family.levels[1][1]), "g")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan or "BroadcastHashJoin" in plan
    family.close()


def test_suffix_dedup_odd_rows(spark):
    schema = "doc_id long, text string, d long, g string"
    assert sd.suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    same = "x" * 10 + "".join(chr(97 + i * 7 % 26) for i in range(300))
    rows = [(1, same, 0, ""), (1, same, 0, ""), (None, same[5:], 1, None), (None, None, 1, None), (2, "short", 2, "s"), (2, "short", 2, "s")]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in sd.suffix_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0), (5, 0, 0), (5, 0, 0), (305, 305, 1), (310, 310, 1), (310, 310, 1)]


# --------------------------------------------------------------------------- vector codes


def codes(rows: list[tuple[int, list[float], object]], parts: int = 8, rounds: int = 6):
    """The contract in Python's integers."""
    kept = sorted((i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows)
    dim = len(kept[0][1])
    cuts = vc.bounds_of(dim, parts)
    books = [[v[i:j] for _, v, _ in kept[:16]] for i, j in cuts]

    def assign(p, v):
        i, j = cuts[p]
        return min((sum((a - b) ** 2 for a, b in zip(v[i:j], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p, (i, j) in enumerate(cuts):
            own: dict[int, list] = {}
            for _, v, _ in kept:
                own.setdefault(assign(p, v)[1], []).append(v[i:j])
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, totals = {}, Counter()
    for i, v, label in kept:
        found = [assign(p, v) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label)
        totals[label] += out[i][1]
    name = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    fits = lambda n: n if n < 2**63 else None
    return {i: (c, fits(e), fits(totals[label]), name) for i, (c, e, label) in out.items()}


@pytest.mark.parametrize("dim, scale, n", [(16, 0.2, 120), (35, 3.0, 60), (8, 1e6, 40), (24, 0.5, 9)])
def test_vector_codes(spark, dim, scale, n, monkeypatch):
    """Parts of one component, parts of unequal lengths, integers beyond 64-bit squares, fewer vectors than entries, many ties."""
    rng = np.random.default_rng(dim)
    rows = [(i, (np.round(rng.standard_normal(dim), 1) * scale).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows[5] = (5, rows[4][1], 2)
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 0 if dim == 35 else 10)
    extra = [(1000, None, 1), (1001, [float("nan")] * dim, 1), (1002, [1.0] * (dim - 1) + [None], 1), (1003, [float("inf")] * dim, 2), (1004, [], 2), (1005, [1.0], None)]
    df = spark.createDataFrame([(*r, 0) for r in rows + extra], "vec_id long, embedding array<float>, label int, at int").repartition(3)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.compress(df).collect()}
    assert got == codes(rows)


def test_vector_codes_bounds_filter():
    """The bounds lose no nearest entry and leave few distances to take."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((4000, 16)) * 300).astype(np.int64)
    x += np.floor(rng.standard_normal((4000, 1)) * 3000).astype(np.int64)
    book = x[:16]
    index, distance, taken = vc.nearest_entries(x, book)
    whole = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (index == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert taken < whole.size / 2


def test_vector_codes_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vc.compress(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, 1)], empty.schema)
    assert vc.compress(nulls).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and vc.compress(nulls).count() == 0


# --------------------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        judged.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    """All rows against filtering in each of the 120 orders; nulls, repeated rows and ids, several labels of an id."""
    rnd = random.Random(5)
    texts = [None, "", "é É", "Ab " * 300, *[" ".join(rnd.choice(["w", "Xy", "z#", "q\tr"] + [str(k) for k in range(300)]) for _ in range(rnd.randrange(150, 260))) for _ in range(12)], *[" ".join(str(k) for k in range(250))] * 2]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(40) for _ in range(rnd.choice([0, 1, 1, 2]))] + [(None, 1, 1)]
    got = audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert got == brute_audit(docs, labels)


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(spark.createDataFrame([], "doc_id long, text string, lang string, n long, good int"), labels).count() == 0
    one = audit(spark.createDataFrame([(1, None, None, 7, "x")], "doc_id long, text string, lang string, n long, good string"), labels)
    assert one.count() == 600 and one.where("removed = 1").select("part").distinct().collect()[0][0] == ""
