"""Language-model scores of texts from a log-frequency Bloom filter.

Every word and every pair of neighbours of all training texts is counted, once seen is enough.
The filter holds (item, level) for every level up to the logarithm of the item's count; a count
is read by probing level after level until a probe fails. A word's probability after v is

    WEIGHT * c(v w) / c(v) + (1 - WEIGHT) * (c(w) + 1) / (N + V + 1),

the second term alone where v was never seen. All counts come from the filter; as every pair
is counted, probabilities sum to 1 up to quantisation and false positives.

The filter is made in shards, by the hash of the items, each by one task; its size follows the
number of items. A filter of at most BROADCAST_BYTES is broadcast to the workers. A larger one
is not: texts are dealt into buckets, a bucket sends each part of the filter its distinct items
and their counts, packed, which make that part, and gets back their levels. Both ways give the
same scores.

The exact counts that base_score asks for are apart from the model: those of the most frequent
words, as many powers of two of counts as hold at most COUNTED words, are broadcast, others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, learns, mix64, runs, slices, tune, word_hashes

#: Most words whose exact counts are broadcast for base_score, the most frequent ones.
COUNTED = 1 << 20
#: Tokens that a worker counts, and sums that it merges, at once.
BLOCK = 1 << 21
#: Ratio of neighbouring levels, weight of the pairs, bits and probes of an entry.
RATIO, WEIGHT, BITS, PROBES = math.sqrt(2), 0.7, 10, 5
#: Bits of a shard; they double until there are at most so many shards.
SHARD_BITS, SHARDS = 1 << 21, 4096
#: Largest filter that is broadcast.
BROADCAST_BYTES = 128 << 20
#: One pair in so many is counted beforehand, to size the filter.
SAMPLED = 64
#: Bytes of text to a bucket, whose texts ask a filter that is not broadcast together, and for which there is a part of it.
BUCKET_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: The token that ends every text and precedes its first word.
END = np.uint64(0x2545F4914F6CDD1D)


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, tokens, text index of each) for slices of texts; every text ends with END."""
    for i, j, buf, off in slices(texts):
        h, counts = word_hashes(buf, off)
        ends = np.cumsum(counts + 1) - 1
        all_tokens = np.empty(len(h) + len(counts), np.uint64)
        is_end = np.zeros(len(all_tokens), bool)
        is_end[ends] = True
        all_tokens[is_end], all_tokens[~is_end] = END, h
        yield i, j, all_tokens, np.repeat(np.arange(len(counts)), counts + 1)


def _before(tokens: np.ndarray, text: np.ndarray, first: int | np.uint64) -> np.ndarray:
    """The token before each one; ``first`` before the first of a text."""
    out = np.roll(tokens, 1)
    out[np.diff(text, prepend=-1) != 0] = first
    return out


def _word_items(tokens: np.ndarray) -> np.ndarray:
    """Items have 48 bits, which confuses far fewer of them than the filter does."""
    return mix64(tokens + np.uint64(0x9E6C63D0876A9A47)) >> np.uint64(16)


def _pair_items(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(v * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) + w) >> np.uint64(16)


def levels_of(n: np.ndarray) -> np.ndarray:
    """Levels of counts of 1 and more."""
    return 1 + np.floor(np.log(n) / math.log(RATIO) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that stands for a level: 0 for none, 1 for the first, else the middle of what the level holds."""
    return np.where(level <= 1, level, RATIO ** (level - 0.5))


# --------------------------------------------------------------------------- the filter


@dataclass(frozen=True)
class Shape:
    """How many shards of how many bits the filter has."""

    shards: int
    bits: int

    @staticmethod
    def of(entries: float) -> Shape:
        bits = SHARD_BITS
        while entries * BITS > bits * SHARDS:
            bits *= 2
        return Shape(max(1, math.ceil(entries * BITS / bits)), bits)

    def shard(self, items: np.ndarray) -> np.ndarray:
        return ((items >> np.uint64(16)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def places(self, items: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """The bits of (item, level) in the item's shard."""
        h = mix64(items ^ mix64(np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + step * np.uint64(i)) & np.uint64(self.bits - 1)).astype(np.int64)

    def filled(self, items: np.ndarray, n: np.ndarray) -> bytes:
        """A shard with every item at all levels from 1 to its count's."""
        there = np.zeros(self.bits, bool)
        levels = levels_of(n) if len(n) else np.zeros(0, np.int64)
        for level in range(1, int(levels.max(initial=0)) + 1):
            items, levels = items[levels >= level], levels[levels >= level]
            for place in self.places(items, level):
                there[place] = True
        return np.packbits(there, bitorder="little").tobytes()

    def levels(self, raw: np.ndarray, items: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
        """Each item's level: the last before the first probe that fails. base is the first byte of the item's shard in raw."""
        out, alive, level = np.zeros(len(items), np.uint8), np.arange(len(items)), 1
        while len(alive) and level < 256:
            own = base if isinstance(base, int) else base[alive]
            there = np.ones(len(alive), bool)
            for place in self.places(items[alive], level):
                there &= (raw[own + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            out[alive] = level
            level += 1
        return out


@dataclass(frozen=True)
class Model:
    """What a worker needs: sizes, exact counts of frequent words, and the filter's shards where they are broadcast."""

    total: int
    distinct: int
    shape: Shape
    words: np.ndarray
    counts: np.ndarray
    raw: bytes | None

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Exact counts, 0 for words that are not frequent."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, self.counts[at], 0)

    def levels(self, items: np.ndarray) -> np.ndarray:
        return self.shape.levels(np.frombuffer(self.raw, np.uint8), items, self.shape.shard(items) * (self.shape.bits >> 3))

    def log(self, pair: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of second after first, from the levels of pairs and words."""
        single = (count_of(second) + 1) / (self.total + self.distinct + 1)
        known = first > 0
        both = np.minimum(count_of(pair) / np.where(known, count_of(first), 1), 1.0)
        return np.log10(np.minimum(np.where(known, WEIGHT * both + (1 - WEIGHT) * single, single), 1.0))


@dataclass(frozen=True)
class Asked:
    """The distinct words of a slice, its distinct items (of these words, then of pairs), and where its pairs and words are among them."""

    words: np.ndarray
    items: np.ndarray
    pair: np.ndarray
    first: np.ndarray
    second: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, text: np.ndarray) -> Asked:
        word, own = np.unique(tokens, return_inverse=True)
        first = _before(own, text, int(np.searchsorted(word, END)))
        pair, at = np.unique(_pair_items(_before(tokens, text, END), tokens), return_inverse=True)
        return Asked(word, np.concatenate([_word_items(word), pair]), (at + len(word)).astype(np.int32), first.astype(np.int32), own.astype(np.int32), text.astype(np.int32))

    def scores(self, model: Model, levels: np.ndarray, texts: int) -> np.ndarray:
        log = model.log(levels[self.pair], levels[self.first], levels[self.second])
        return np.bincount(self.text, log, texts)


# --------------------------------------------------------------------------- counting


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sampled, key, n): all words, and one in SAMPLED pairs."""
    np.seterr(over="ignore")
    words: list[np.ndarray] = []
    pairs: list[np.ndarray] = []

    def sums() -> Iterator[pa.RecordBatch]:
        for sampled, held in ((False, words), (True, pairs)):
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), sampled)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["sampled", "key", "n"])

    for batch in batches:
        for _, _, tokens, text in _tokens(batch.column(0)):
            words.append(tokens)
            item = _pair_items(_before(tokens, text, END), tokens)
            pairs.append(item[item % np.uint64(SAMPLED) == 0])
            if sum(map(len, words)) >= BLOCK:
                yield from sums()
    if words:
        yield from sums()


def _packed(shape: Shape, items: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(shard, items, n) of distinct items, as bytes."""
    shard = shape.shard(items)
    order = np.argsort(shard, kind="stable")
    bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shape.shards))
    rows = [(int(shard[order[i]]), items[order[i:j]].tobytes(), n[order[i:j]].astype(np.int32).tobytes()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "items", "n"])


def _count_pairs(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[np.ndarray] = []

        def sums() -> pa.RecordBatch:
            item, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _packed(shape, item, n)

        for batch in batches:
            for _, _, tokens, text in _tokens(batch.column(0)):
                held.append(_pair_items(_before(tokens, text, END), tokens))
                if sum(map(len, held)) >= BLOCK:
                    yield sums()
        if held:
            yield sums()

    return run


def _pack_words(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            key, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            held.clear()
            return _packed(shape, _word_items(key.view(np.uint64)), np.minimum(n, 2**31 - 1))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield packed()
        if held:
            yield packed()

    return run


def _built(shape: Shape):
    """A shard from the sums of all blocks; rows come sorted by shard."""

    def merged(items: list[np.ndarray], n: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        item, at = np.unique(np.concatenate(items), return_inverse=True)
        return [item], [np.bincount(at, np.concatenate(n), len(item))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        last, items, n, held = None, [], [], 0

        def made() -> pa.RecordBatch:
            own, sums = merged(items, n)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([shape.filled(own[0], sums[0])], pa.binary())], names=["shard", "raw"])

        for batch in batches:
            for shard, x, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != last:
                    if items:
                        yield made()
                    last, items, n, held = shard, [], [], 0
                items.append(np.frombuffer(x, np.uint64))
                n.append(np.frombuffer(k, np.int32))
                held += len(items[-1])
                if held > BLOCK:
                    items, n = merged(items, n)
                    held = 0  # what is merged no longer counts, so memory follows the shard's own items
        if items:
            yield made()

    return run


def _least(counts: DataFrame) -> int:
    """The least power of two that at most COUNTED words are counted as often as."""
    least, words = 1 << 62, 0
    for row in counts.groupBy(F.floor(F.log2("n") + 1e-9).alias("power")).count().orderBy(F.desc("power")).collect():
        words += row["count"]
        if words > COUNTED:
            break
        least = 1 << row["power"]
    return least


def fit(documents: DataFrame, scratch: Scratch, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[Model, DataFrame]:
    """The model of all texts, with its filter if that is broadcast, and the table (word, n) of exact counts."""
    texts = documents.select(F.col(text_col).alias("text"))
    noted = scratch.save(texts.mapInArrow(_count_words, "sampled boolean, key long, n long").groupBy("sampled", "key").agg(F.sum("n").alias("n")))
    level = 1 + F.floor(F.log("n") / math.log(RATIO) + 1e-9)
    by = {r["sampled"]: r for r in noted.groupBy("sampled").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.sum(level).alias("entries")).collect()}
    total, distinct = (by[False]["n"], by[False]["distinct"]) if False in by else (0, 0)
    shape = Shape.of(4096 + 1.1 * sum(r["entries"] * (SAMPLED if sampled else 1) for sampled, r in by.items()))

    counts = noted.where("not sampled").select(F.col("key").alias("word"), "n")
    raw = None
    if shape.shards * shape.bits >> 3 <= broadcast_bytes:
        kind = "shard int, items binary, n binary"
        sums = texts.mapInArrow(_count_pairs(shape), kind).unionByName(counts.mapInArrow(_pack_words(shape), kind))
        shards = scratch.save(sums.repartition("shard").sortWithinPartitions("shard").mapInArrow(_built(shape), "shard int, raw binary"))
        own = {r["shard"]: r["raw"] for r in shards.toLocalIterator()}
        empty = bytes(shape.bits >> 3)
        raw = b"".join([own.get(i, empty) for i in range(shape.shards)])
    frequent = counts.where(F.col("n") >= _least(counts)).toArrow()
    words = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Model(total, distinct, shape, words[order], frequent["n"].to_numpy()[order], raw), counts


# --------------------------------------------------------------------------- scoring


def _counted(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, times), each pair of them once."""
    order = np.lexsort((item, text))
    t, x = item[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])) if len(t) else np.zeros(0, np.int64)
    return x[new], t[new], np.diff(np.append(new, len(t)))


_ROWS = "key long, word long, times int, own struct<id:long,tokens:long,known:long,base:double,score:double>"


def _rows(model: Model, key: np.ndarray, ids: pa.Array, tokens: np.ndarray, asked: Asked, levels: np.ndarray, copies: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row (key, own) for every text, and (key, word, times) for its words whose exact counts are joined."""
    n, text, count = len(key), asked.text, model.exact(asked.words)[asked.second]
    base = np.where(count > 0, np.log10((count + 1) / (model.total + model.distinct + 1)), 0.0)
    own = pa.StructArray.from_arrays(
        [ids, pa.array(np.bincount(text, minlength=n).astype(np.int64)), pa.array(np.bincount(text, count > 0, n).astype(np.int64)), pa.array(np.bincount(text, base, n)), pa.array(asked.scores(model, levels, n))],
        names=["id", "tokens", "known", "base", "score"],
    )
    each = np.arange(n) if copies is None else np.repeat(np.arange(n), copies)
    yield pa.RecordBatch.from_arrays([pa.array(key[each]), pa.array(key[each]), pa.array(np.zeros(len(each), np.int32)), own if copies is None else own.take(pa.array(each))], names=["key", "word", "times", "own"])
    rare = np.flatnonzero(count == 0)
    if len(rare):
        x, t, times = _counted(text[rare], tokens[rare])
        times = times if copies is None else times * copies[x]
        yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(t.view(np.int64)), pa.array(times.astype(np.int32)), pa.nulls(len(x), own.type)], names=["key", "word", "times", "own"])


def _score(shared):
    """The rows of texts by a filter that is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        model: Model = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, tokens, text in _tokens(batch.column(2)):
                asked = Asked.of(tokens, text)
                yield from _rows(model, key[i:j], batch.column(1).slice(i, j - i), tokens, asked, model.levels(asked.items))

    return run


def _of_bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a bucket, and the text index of each."""
    found = [(tokens, text + i) for i, _, tokens, text in _tokens(table["text"].combine_chunks())]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _summed(items: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items in order, and the sums of their n."""
    if n.max(initial=0) > 1:
        order = np.argsort(items)
        item, n = items[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        return item[new], np.add.reduceat(n, new)
    item, those = np.sort(items), np.sort(items[n > 0])
    item = item[np.concatenate([[True], item[1:] != item[:-1]])]
    return item, np.searchsorted(those, item, "right") - np.searchsorted(those, item)


def _by_shard(shape: Shape, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shards in it) of items sorted by their shard."""
    shard = shape.shard(items)
    order = np.argsort(shard.astype(np.uint16) if shape.shards <= 1 << 16 else shard, kind="stable")
    return order, shard[order]


def _bytes(numbers: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, all lowest ones first, so that what is alike lies together."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _ask(shape: Shape, each: int):
    """A row for each bucket of texts and each part of the filter (so many shards): the distinct items it is to hold, and how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for table in runs(batches):
            tokens, text = _of_bucket(table)
            teaches = np.maximum(table["copies"].to_numpy(), 0)[text]
            (words, of_words), (pairs, of_pairs) = _summed(tokens, teaches), _summed(_pair_items(_before(tokens, text, END), tokens), teaches)
            items, n = np.concatenate([_word_items(words), pairs]), np.concatenate([of_words, of_pairs])
            order, shard = _by_shard(shape, items)
            items, n, part = items[order], n[order], shard // each
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=shape.shards))
            cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
            columns = [pa.array(part[bounds[:-1]], pa.int32()), pa.array(np.full(len(cuts), table["bucket"][0].as_py()), pa.int32()), pa.array([_bytes(items[a:b], 6) for a, b in cuts], pa.binary()), pa.array([_bytes(n[a:b], 5) for a, b in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "bucket", "items", "n"])

    return run


def _answer(shape: Shape, each: int):
    """The levels of all items that buckets ask of a part, from its filter, which their counts make; rows come sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for table in runs(batches):
            part, buckets = table["part"][0].as_py(), table["bucket"].to_pylist()
            asks = [_numbers(x.as_py(), 6) for x in table["items"]]
            items = np.concatenate(asks)
            item, at = np.unique(items, return_inverse=True)
            n = np.bincount(at, np.concatenate([_numbers(x.as_py(), 5) for x in table["n"]]), len(item))
            item, n = item[n > 0], n[n > 0]
            bounds = np.searchsorted(shape.shard(item), part * each + np.arange(each + 1))  # items in order are shards in order
            raw = np.frombuffer(b"".join(shape.filled(item[a:b], n[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.uint8)
            levels = shape.levels(raw, items, (shape.shard(items) - part * each) * (shape.bits >> 3))
            data = pa.array([x.tobytes() for x in np.split(levels, np.cumsum([len(x) for x in asks])[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.full(len(asks), part), pa.int32()), data], names=["bucket", "part", "data"])

    return run


def _joined(shared):
    """The rows of the texts of a bucket, from them and the answers to what they ask."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        model: Model = shared.value
        tokens, text = _of_bucket(texts)
        asked = Asked.of(tokens, text)
        levels = np.zeros(len(asked.items), np.uint8)
        order, _ = _by_shard(model.shape, asked.items)
        levels[order] = np.frombuffer(b"".join(answers.sort_by("part")["data"].to_pylist()), np.uint8)
        return pa.Table.from_batches(_rows(model, texts["key"].to_numpy(), texts["id"].combine_chunks(), tokens, asked, levels, np.abs(texts["copies"].to_numpy())))

    return run


def _score_by_parts(rows: DataFrame, shared, shape: Shape) -> DataFrame:
    """What _score makes of rows (key, id, text, copies), where the filter is not broadcast. copies is 1, or -1 for what does not teach.

    Texts are dealt into buckets by their key. A bucket sends each part of the filter its distinct items with their counts, which
    make the filter and ask it, and takes the texts anew when the answers come: no text and no position of a word travels with them.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    sizes = rows.select("key", size.alias("size")).groupBy("key").agg(F.max("size").alias("one"), F.count("*").alias("rows"))
    whole, again = sizes.agg(F.sum(F.col("one") * F.col("rows")), F.max(F.col("one") * (F.col("rows") - 1))).first()
    if (again or 0) > BUCKET_BYTES:  # copies of a row that would fill a bucket are one that teaches as often
        rows = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    bucket = F.pmod("key", F.lit(max(1, math.ceil((whole or 0) / BUCKET_BYTES)))).cast("int")
    dealt = rows.select(bucket.alias("bucket"), "key", "id", "text", "copies").repartition("bucket")
    each = max(1, shape.shards * PART_BYTES // max(1, whole or 0))
    asked = dealt.sortWithinPartitions("bucket").mapInArrow(_ask(shape, each), "part int, bucket int, items binary, n binary")
    answers = asked.repartition("part").sortWithinPartitions("part").mapInArrow(_answer(shape, each), "bucket int, part int, data binary")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_joined(shared), _ROWS)


def lm_score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Scores of all whole texts under a model of those that are not held out.

    Returns the id, held_out, n_tokens, n_known (tokens the training texts hold), train_tokens,
    base_score (add-one unigram, exact) and score (the model of pairs), both log10.

    A null or empty text is the end token alone. Null ids keep their rows, are not held out and
    teach nothing. Repeated rows each teach and each keep a row. An empty table gives no rows,
    and a table without training texts gives every token probability 1. Other columns are
    neither read nor returned.
    """
    spark = documents.sparkSession
    tune(spark)
    np.seterr(over="ignore")
    scratch = Scratch(spark)
    model, counts = fit(documents.where(learns(F.col(id_col), mod, rest)), scratch, text_col, broadcast_bytes)
    shared = spark.sparkContext.broadcast(model)
    key = F.xxhash64(F.lit(1), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = documents.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.when(learns(F.col(id_col), mod, rest), 1).otherwise(-1).cast("long").alias("copies"))
    scored = rows.drop("copies").mapInArrow(_score(shared), _ROWS) if model.raw is not None else _score_by_parts(rows, shared, model.shape)
    joined = scored.join(counts, "word", "left")
    log = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(model.total + model.distinct + 1)))
    known = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    by = joined.select("key", "own", log.alias("log"), known.alias("known")).groupBy("key").agg(
        F.max("own.id").alias("id"), F.count("own").alias("rows"), F.sum("own.tokens").alias("tokens"), F.sum(F.coalesce("own.known", F.lit(0)) + F.col("known")).alias("known"),
        F.sum(F.coalesce("own.base", F.lit(0.0)) + F.col("log")).alias("base"), F.max("own.score").alias("score"),
    )
    one = lambda c: (F.col(c) / F.col("rows")).cast("long")
    out = by.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id"), mod, rest).alias("held_out"), one("tokens").alias("n_tokens"), one("known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), "score",
    )
