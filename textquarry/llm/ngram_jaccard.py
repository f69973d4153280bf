"""N-gram Jaccard join by a token-group matrix.

Sets of word shingles are joined exactly at a Jaccard threshold t = num/den. Equal sets are
one *node*. Similar nodes are partitioned into groups; the matrix holds, for every group, the
union of its members' tokens; the overlap of a query set with that union bounds its overlap
with every member, and only groups whose bound reaches what the threshold asks for are opened.

How the matrix stays small. Fix any one order of all tokens. If |Q & S| >= ceil(t * |Q|), the
first p(n) = n - ceil(t * n) + 1 tokens of Q and of S share a token, and since at most
n - p(n) shared tokens lie outside both prefixes, |Q & S| <= c + max(|Q| - p, |S| - p) where c
counts the tokens that both prefixes hold. So prefixes alone form the matrix, and the bound is
taken on c. The order puts frequent tokens last (a bounded list of hints that every row
applies alike; any list gives the same result), then goes by hash.

Prefix tokens that no other prefix holds count for nothing, so with h common ones in its
prefix a set can reach only partners that ask for c <= h; rows beyond that are not joined.

Steps: (1) one pass gives each document's set size and node and the frequent tokens;
(2) a second pass gives the prefix postings, of which those that two nodes share are kept;
(3) in each token's nodes of like size, all are paired with the one whose prefix is shared
most; each node's best pair, if it passes the bound, is verified, and the components are the
groups, cut by set size; (4) the matrix token x group is joined with the nodes' prefixes, the
smaller component asking the larger; bounds are summed per (node, group), and qualifying groups
are opened: members that hold one of the node's rarest tokens there are verified, where they
are many first one pair for two groups, since one link joins them; (5) components over all
verified links.

Within a group no pairs are formed: its members are linked already, and the result is the
class, not the pairs. Nothing is dropped or capped. A token that very many texts hold is known
to be shared and is not gathered in one place to find that out; aggregates are taken before the shuffle and
written before they are joined, so that what a frequent key leaves to join can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, distinct_in_text, mix64, ngram_hashes, slices, tune, word_hashes

#: At most so many frequent tokens order the prefixes (16 bytes each on a worker).
HINTS = 1 << 20
#: A token of at least so many texts of one block of BLOCK tokens is a hint.
HINT_TEXTS, BLOCK = 2, 1 << 22
#: A token of at least so many texts counts as shared without looking.
HOT_TEXTS = 1000
#: Up to so many rows of three numbers and a flag (32 bytes) are broadcast to pick the texts to verify; more are joined by a shuffle.
BROADCAST_IDS = (32 << 20) // 32
#: Bytes of a shingle's hash in the sets that are compared; partners of a hub that one copy of its set serves.
HASH_BYTES, PARTNERS = 6, 128
#: Postings of a token of at most so many are compared pair by pair to find those that count for no link; all of a larger one are kept.
FEW = 32


def _sets(batch: pa.RecordBatch, text: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, distinct shingles, their text's index) for slices of a batch."""
    for i, j, buf, off in slices(batch.column(text)):
        h, counts = word_hashes(buf, off)
        h, where = distinct_in_text(*ngram_hashes(h, counts, k))
        yield i, j, h, where


def _nodes(h: np.ndarray, where: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and 64-bit ids of the sets."""
    size = np.bincount(where, minlength=texts)
    total = np.zeros(texts, np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        total[filled] = np.add.reduceat(mix64(h), np.concatenate([[0], np.cumsum(size[filled])[:-1]]))
    return size, mix64(total + size.astype(np.uint64)).view(np.int64)


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[np.ndarray] = []

        def hints() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            at = count >= HINT_TEXTS
            held.clear()
            none = pa.nulls(int(at.sum()), pa.int64())
            return _rows(none, none, count[at], token[at].view(np.int64), False)

        for batch in batches:
            for i, j, h, where in _sets(batch, 1, k):
                size, node = _nodes(h, where, j - i)
                yield _rows(batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), size, node, True)
                held.append(h)
                if sum(map(len, held)) >= BLOCK:
                    yield hints()
        if held:
            yield hints()

    return run


def _rows(ids: pa.Array, texts: pa.Array, n: np.ndarray, key: np.ndarray, is_text: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, texts, pa.array(n.astype(np.int64)), pa.array(key), pa.array(np.full(len(n), is_text))], names=["id", "same", "n", "key", "is_text"])


def _prefixes(k: int, num: int, den: int, hints):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        token, rank = hints.value
        seen: set[int] = set()
        for batch in batches:
            for i, j, h, where in _sets(batch, 0, k):
                size, node = _nodes(h, where, j - i)
                fresh = np.zeros(j - i, bool)
                for x in np.flatnonzero(size):
                    if (key := int(node[x])) not in seen:
                        seen.add(key)
                        fresh[x] = True
                at = fresh[where]
                h, where = h[at], where[at]
                if not len(h):
                    continue
                order = np.zeros(len(h), np.int64)
                if len(token):
                    place = np.minimum(np.searchsorted(token, h), len(token) - 1)
                    order = np.where(token[place] == h, rank[place], 0)
                by = np.lexsort((h, order, where)) if order.any() else np.arange(len(h))
                h, where = h[by], where[by]
                first = np.flatnonzero(np.diff(where, prepend=-1))
                inside = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
                n = size[where]
                keep = inside < n - (num * n + den - 1) // den + 1
                yield pa.RecordBatch.from_arrays([pa.array((h[keep] >> np.uint64(64 - 8 * HASH_BYTES)).view(np.int64)), pa.array(node[where[keep]]), pa.array(n[keep].astype(np.int32)), pa.array(order[by][keep] >= HOT_TEXTS)], names=["token", "node", "n", "hot"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, once each, of hot tokens and of those that two nodes share; rows come sorted by token and node, all of a token that is not hot."""
    last: list[np.ndarray] = []  # the last posting and whether it is known to be kept
    names = ["token", "node", "n", "hot"]
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        token, node, n, hot, keep = own = [*own, own[3]]
        if last:
            token, node, n, hot, keep = own = [np.concatenate(x) for x in zip(last, own, strict=True)]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, hot, keep = (x[new] for x in own)
        same = token[1:] == token[:-1]
        keep = keep.copy()
        keep[1:] |= same
        keep[:-1] |= same
        last = [token[-1:], node[-1:], n[-1:], hot[-1:], keep[-1:]]
        at = np.flatnonzero(keep[:-1])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (token, node, n, hot)], names=names)
    if last and last[4][0]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last[:4]], names=names)


def _whole_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut where its value changes: no token is in two."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if cut or held and held[0][0][0] != own[0][0]:  # else one token goes on
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in own], strict=True)]
            held = []
        held.append([c[cut:] for c in own])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """_need of arrays."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return np.maximum(-(-(a + b) * num // (num + den)) + np.maximum(a, b) * num // -den + 1, 1)


def _led(num: int, den: int):
    """(node, n, lead, lead_n) for each posting whose token has a node of like size to pair it with: the one whose prefix is shared most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, n, have in _whole_tokens(batches):
            band = np.floor(np.log(n) / np.log(den / num))
            by = np.lexsort((have, n, node, have / n, band, token))
            token, node, n, have, band = (x[by] for x in (token, node, n, have, band))
            ends = np.append((token[1:] != token[:-1]) | (band[1:] != band[:-1]), True)
            lead = np.flatnonzero(ends)[np.cumsum(ends) - ends]
            at = np.flatnonzero((node != node[lead]) & (np.minimum(have, have[lead]) >= _needed(n, n[lead], num, den)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[at], n[at], node[lead[at]], n[lead[at]])], names=["node", "n", "lead", "lead_n"])

    return run


def _viable(num: int, den: int):
    """Postings that another one of their token, of another group, may link with by their sizes and common tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_tokens(batches):
            token, _, n, have, comp, _ = own
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            count = np.diff(np.append(first, len(token)))
            keep = np.repeat((count > FEW) & (np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first)), count)
            size = np.repeat(count, count)
            for d in range(1, min(int(count.max()), FEW)):
                i = np.flatnonzero((token[d:] == token[:-d]) & (size[d:] <= FEW))
                a, b = n[i].astype(np.int64), n[i + d].astype(np.int64)
                met = (comp[i] != comp[i + d]) & (a * den >= b * num) & (b * den >= a * num) & (np.minimum(have[i], have[i + d]) >= _needed(a, b, num, den))
                keep[i[met]] = True
                keep[i[met] + d] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in own], names=["token", "node", "n", "have", "comp", "weight"])

    return run


def _tokens(k: int):
    """Whole sets for the nodes that are asked for, as sorted hashes; a set at most once for each use from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            asked, hub, part = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, j, h, where in _sets(batch, 0, k):
                size, node = _nodes(h, where, j - i)
                raw = np.ascontiguousarray((h >> np.uint64(64 - 8 * HASH_BYTES)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                ends = np.cumsum(size)
                rows = []
                for x in range(j - i):
                    key = (hub[i + x], asked[i + x], part[i + x])
                    if node[x] == asked[i + x] and key not in seen:
                        seen.add(key)
                        rows.append((*key, raw[ends[x] - size[x] : ends[x]].tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hub", "node", "part", "tokens"])

    return run


def _compare(num: int, den: int):
    """Pairs of a hub and a partner that reach the threshold; rows come sorted, a hub's set before its partners'."""

    def whole(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
        out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
        return out.view(np.uint64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, done = None, None, None
        for batch in batches:
            out = []
            for a, part, partner, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not partner:
                    if last != (a, part):
                        last, own, done = (a, part), whole(raw), None
                    continue
                if b == done or not (len(raw) * den >= len(own) * HASH_BYTES * num and len(raw) * num <= len(own) * HASH_BYTES * den):
                    continue
                done, other = b, whole(raw)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                if int((own[at] == other).sum()) * (num + den) >= (len(own) + len(other)) * num:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _need(a: Column, b: Column, num: int, den: int) -> Column:
    """Least number of common prefix tokens of sets of a and b tokens that reach the threshold."""
    return F.greatest(F.ceil((a + b) * num / F.lit(num + den)) - F.ceil(F.greatest(a, b) * num / F.lit(den)) + 1, F.lit(1))


def _verified(docs: DataFrame, profile: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold; a is the hub of its pairs.

    The few words that say which sets meet where go to the texts, and each set is shuffled once
    to each hub that it meets.
    """
    # part 0 is a hub's set, as often as it has parts; a partner belongs to part 1, 2, ...
    parts = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int") + 1
    partners = pairs.join(parts, "a").select(F.col("b").alias("key"), F.col("a").alias("hub"), part.alias("part"))
    asked = partners.unionByName(parts.select(F.col("a").alias("key"), F.col("a").alias("hub"), F.lit(0).alias("part")))
    owner = scratch.save(profile.groupBy("key").agg(F.min("id").alias("want")))
    asked = scratch.save(asked.join(owner, "key"))
    few = asked.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(asked) if few else asked, docs["id"].eqNullSafe(asked["want"])).select("text", "key", "hub", "part")
    sets = texts.mapInArrow(_tokens(k), "hub long, node long, part int, tokens binary")
    sets = sets.join(F.broadcast(parts) if few else parts, sets["hub"] == parts["a"])
    each = F.when(F.col("part") == 0, F.sequence(F.lit(1), F.col("parts"))).otherwise(F.array("part"))
    sets = sets.select("hub", F.explode(each).alias("at"), (F.col("part") > 0).alias("partner"), "node", "tokens")
    ordered = sets.repartition("hub", "at").sortWithinPartitions("hub", "at", "partner", "node")
    return scratch.save(ordered.mapInArrow(_compare(num, den), "a long, b long").distinct())


def _same(text_col: str) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.lit(1), F.col(text_col))


def _classes(documents: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, Scratch]:
    """(id, same, n, class) of every row; class is null for texts without shingles."""
    spark = documents.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    noted = scratch.save(docs.withColumn("same", _same("text")).mapInArrow(_profile(k), "id long, same long, n long, key long, is_text boolean"))
    profile = noted.where("is_text").select("id", "same", "n", "key")
    top = noted.where("not is_text").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HINTS).toArrow()
    token, rank = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.argsort(token)
    hints = spark.sparkContext.broadcast((token[by], rank[by]))

    made = docs.select("text").mapInArrow(_prefixes(k, num, den, hints), "token long, node long, n int, hot boolean")
    dealt = F.when(F.col("hot"), F.xxhash64("token", "node")).otherwise(F.col("token"))
    first = scratch.save(made.repartition(dealt).sortWithinPartitions("token", "node").mapInArrow(_shared, "token long, node long, n int, hot boolean"))
    have = first.groupBy("node").agg(F.count("*").cast("int").alias("have"))
    shared = scratch.save(first.join(have, "node").select("token", "node", "n", "have", "hot"))
    scratch.drop(first)

    # What all nodes of a token decide together is seen in one pass over its sorted postings, but for hot tokens.
    need = lambda a, b: _need(F.col(a), F.col(b), num, den)
    by_token = lambda rows: rows.where("not hot").drop("hot").repartition("token").sortWithinPartitions("token")
    led = by_token(shared).mapInArrow(_led(num, den), "node long, n int, lead long, lead_n int")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)))
    close = shared.where("hot").withColumn("band", band)
    middle = F.max(F.struct((F.col("have") / F.col("n")).alias("by"), F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("have").alias("lead_have")))
    leads = scratch.save(close.groupBy("token", "band").agg(middle.alias("m")).select("token", "band", "m.lead", "m.lead_n", "m.lead_have"))
    star = close.join(leads, ["token", "band"]).where((F.col("node") != F.col("lead")) & (F.least("have", "lead_have") >= need("n", "lead_n")))
    star = star.select("node", "n", "lead", "lead_n").unionByName(led)
    star = star.groupBy("node", "n", "lead", "lead_n").agg(F.count("*").alias("c")).where(F.col("c") >= need("n", "lead_n"))
    star = star.groupBy("node").agg(F.max(F.struct("c", "lead")).alias("best")).select(F.col("best.lead").alias("a"), F.col("node").alias("b"))
    links = _verified(docs, profile, scratch.save(star), scratch, k, num, den)
    groups = scratch.save(components(links, scratch))

    weights = scratch.save(groups.groupBy("comp").agg(F.count("*").alias("weight")))
    groups = scratch.save(groups.join(weights, "comp"))
    labelled = scratch.save(shared.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("weight", F.coalesce("weight", F.lit(1))))
    hot = labelled.where("hot").drop("hot")
    many = scratch.save(hot.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token"))
    viable = by_token(labelled.select("token", "node", "n", "have", "comp", "weight", "hot")).mapInArrow(_viable(num, den), "token long, node long, n int, have int, comp long, weight long")
    labelled = scratch.save(hot.join(many, "token", "left_semi").select("token", "node", "n", "have", "comp", "weight").unionByName(viable))
    matrix = labelled.groupBy("token", F.col("comp").alias("grp"), F.col("weight").alias("grp_weight"), F.col("n").alias("grp_n")).agg(F.count("*").alias("members"), F.max("have").alias("grp_have"))
    matrix = scratch.save(matrix)
    asks = (F.col("weight") < F.col("grp_weight")) | (F.col("weight") == F.col("grp_weight")) & (F.col("comp") < F.col("grp"))
    sized = (F.col("grp_n") * den >= F.col("n") * num) & (F.col("grp_n") * num <= F.col("n") * den)
    bound = labelled.join(matrix, "token").where(asks & sized & (F.least("have", "grp_have") >= need("n", "grp_n")))
    bound = bound.groupBy("node", "n", "have", "comp", "grp", "grp_n").agg(F.count("*").alias("c"))
    opened = scratch.save(bound.withColumn("spare", F.col("c") - need("n", "grp_n")).where("spare >= 0"))

    # A member shares all but ``spare`` of the c tokens at most, so it holds one of any spare + 1 of them: the rarest in its
    # group. They are taken from the tokens that c counts; others are held only by members that can't be partners.
    rarest = Window.partitionBy("node", "grp", "grp_n").orderBy("members", "token")
    tried = opened.join(labelled.select("token", "node"), "node").join(matrix.select("token", "grp", "grp_n", "grp_have", "members"), ["token", "grp", "grp_n"])
    tried = tried.where(F.least("have", "grp_have") >= need("n", "grp_n"))
    tried = scratch.save(tried.withColumn("place", F.row_number().over(rarest)).where("place <= spare + 1"))
    member = labelled.select("token", F.col("node").alias("other"), F.col("n").alias("grp_n"), F.col("have").alias("other_have"), F.col("comp").alias("grp"))
    possible = F.least("have", "other_have") >= need("n", "grp_n")
    total = profile.count()
    if (tried.agg(F.sum("members")).first()[0] or 0) > total:  # one link joins two groups: the closest node of one and a member of the other are verified first
        best = F.max(F.struct("spare", "node", "n", "have", "token", "grp_n"))
        one = tried.where("place = 1").groupBy("comp", "grp").agg(best.alias("m")).select("comp", "grp", "m.*")
        one = one.join(member, ["token", "grp", "grp_n"]).where(possible).groupBy("comp", "grp").agg(F.min(F.struct(F.col("node").alias("a"), F.col("other").alias("b"))).alias("p")).select("p.*").distinct()
        links = scratch.save(links.unionByName(_verified(docs, profile, scratch.save(one), scratch, k, num, den)))
        groups = scratch.save(components(links, scratch))
        now = lambda name: groups.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
        # A group is named by one of its nodes, so its class now is that node's.
        tried = tried.join(now("comp"), "comp", "left").join(now("grp"), "grp", "left")
        tried = tried.where(F.coalesce("comp_comp", "comp") != F.coalesce("grp_comp", "grp")).drop("comp_comp", "grp_comp")
    met = tried.join(member, ["token", "grp", "grp_n"]).where(possible)
    met = scratch.save(met.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    if not met.isEmpty():
        more = _verified(docs, profile, met, scratch, k, num, den)
        if not more.isEmpty():
            groups = scratch.save(components(links.unionByName(more), scratch))

    named = profile.join(groups.select(F.col("node").alias("key"), "comp"), "key", "left").select("id", "same", "n", F.when(F.col("n") > 0, F.coalesce("comp", "key")).alias("class"))
    return scratch.save(named), scratch

def ngram_jaccard(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Classes of texts under the links |A & B| / |A | B| >= num / den over their k-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than k words is one
    shingle. Returns one row per input row: the id column, n_shingles (set size) and
    component_id, the smallest id reachable by links, itself included.

    Null, empty and blank texts have no shingles, link with nothing and are their own class.
    Repeated rows are kept, one result row each. A null id keeps its row and joins its class,
    whose smallest id is taken over the ids that are not null (null if there is none). An empty
    table gives an empty result. Other columns are neither read nor returned.
    """
    named, scratch = _classes(documents, id_col, text_col, k, num, den)
    least = scratch.save(named.where("class is not null").groupBy("class").agg(F.min("id").alias("least")))
    return named.join(least, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def keep_one_per_class(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row of documents of each class, the one of the smallest id, columns as given.

    A null id comes after all others. Of several texts with that id in one class the one of
    smaller hash stays; texts with one id in different classes all stay. Of rows that repeat
    both id and text one stays, the smallest in its other columns. Null, empty and blank texts
    are each their own class and all stay. An empty table gives no rows.
    """
    named, scratch = _classes(documents, id_col, text_col, k, num, den)
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "same"))
    kept = scratch.save(named.where("class is not null").groupBy("class").agg(best.alias("b")).select(F.col("b.id").alias("_id"), F.col("b.same").alias("_same")))
    blank = named.where("class is null").select(F.col("id").alias("_id"), F.col("same").alias("_same"), F.lit(True).alias("_blank")).distinct()
    kept = kept.withColumn("_blank", F.lit(False)).unionByName(blank)
    rows = documents.withColumns({"_key": F.col(id_col).cast("long"), "_text": _same(text_col)})
    rows = rows.join(kept, rows["_key"].eqNullSafe(kept["_id"]) & (rows["_text"] == kept["_same"]))
    other = [F.hash(c) if t.startswith("map") else F.col(c) for c, t in documents.dtypes if c not in (id_col, text_col)]
    first = F.row_number().over(Window.partitionBy("_key", "_text").orderBy(*(other or [F.lit(0)])))
    blanks = rows.where("_blank").select(*documents.columns)
    return rows.where("not _blank").withColumn("_first", first).where("_first = 1").select(*documents.columns).unionByName(blanks)
