"""Packing tokenised documents into fixed windows by multiway number differencing.

Documents stream through each input partition; nothing is shuffled. What a document has
beyond whole windows of ``window`` tokens, and every shorter document, becomes an item. When
items worth ``batch_windows`` windows are at hand, they are split over the fewest windows that
can hold them by Karmarkar-Karp differencing: partial partitions, each a vector of window
sums, wait in a heap by their spread; the two of largest spread are merged, largest sums
against smallest, until one partition is left. If a window of the near-equal ones exceeds its
capacity, the window count rises and the differencing starts again, as long as a PADDING-th of
the windows pads at most. What then exceeds a window, where items are too large to be spread
evenly, is cut off and put where there is room. A batch holds a bounded number of tokens
whatever the data are.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tune

#: A worker keeps the ids of so many words and of so many word parts: those it meets first,
#: which the frequent ones are among. Others are encoded again when they come again.
CACHE_WORDS = 250_000
#: Texts are looked up together until they hold so many words that are not kept.
NEW_WORDS = 50_000

#: Of so many windows one may be padding before an item is cut, which only items of about a third of a window or more can come to.
PADDING = 16

#: How a vocabulary must normalise and split text for the short way below; others take the whole tokenizer.
_NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words that the short way below may split: ASCII and Latin-1 letters in composed form.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own splitting pattern, for such words.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """How byte-level models write each byte: printable ones as themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts through a cache of words.

    The tokenizer never joins what white space separates, so a text's ids are those of its
    words. Words are looked up; a new one is split into the tokenizer's own parts, and new
    parts go to the tokenizer's model. Words beyond ASCII and Latin-1, and those that may
    hold a special token, go to the whole tokenizer; so do whole texts where the vocabulary
    normalises or splits in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        self.by_words = (kind["normalizer"], kind["pre_tokenizer"], kind.get("post_processor")) == (_NORMALISED, _SPLIT, None) and not any(t["lstrip"] or t["rstrip"] for t in kind["added_tokens"])
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32).tobytes()

    def _part(self, part: str) -> bytes:
        if (ids := self.parts.get(part)) is None:
            shown = part if part.isascii() else part.encode().decode("latin1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(shown)], np.uint32).tobytes()
            if len(self.parts) < CACHE_WORDS:
                self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace").lower()
        if text.isascii():
            if text.isalpha():
                return self._part(text)
            if text[-1] in _MARKS and text[:-1].isalpha():
                return self._part(text[:-1]) + self._part(text[-1])
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self._part(p) for p in _PARTS.findall(text)])
        return self._whole(word)

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            yield from map(self._whole, texts)
            return
        kept, at = self.words, 0
        while at < len(texts):
            split, new = [], set()
            while at < len(texts) and len(new) < NEW_WORDS:
                split.append(words := texts[at].split())
                new |= set(words).difference(kept)
                at += 1
            found = {w: self._word(w) for w in new}
            if len(kept) + len(found) <= CACHE_WORDS:
                kept |= found
                found = kept
            for words in split:
                yield b"".join([kept[w] if w in kept else found[w] for w in words]) if found is not kept else b"".join([kept[w] for w in words])


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split item indices over k windows of near-equal sums by multiway differencing."""
    n = len(sizes)
    sums, slots, heap = [], [], []
    for i, size in enumerate(sizes):
        a, b = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        a[-1], b[-1] = size, i
        sums.append(a)
        slots.append(b)
        heap.append((-size, i))
    heapq.heapify(heap)
    left, right = [], []
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        total, x, y = sums[i] + sums[j][::-1], slots[i], slots[j][::-1]
        slot = np.where(x < 0, y, x)
        for t in np.flatnonzero((x >= 0) & (y >= 0)):
            left.append(int(x[t]))
            right.append(int(y[t]))
            slot[t] = n + len(left) - 1
        order = np.argsort(total, kind="stable")
        sums[i], slots[i] = total[order], slot[order]
        sums[j] = slots[j] = None
        heapq.heappush(heap, (-int(sums[i][-1] - sums[i][0]), i))
    out = []
    for slot in slots[heap[0][1]] if heap else []:
        items, todo = [], [int(slot)] if slot >= 0 else []
        while todo:
            v = todo.pop()
            if v < n:
                items.append(v)
            else:
                todo += [left[v - n], right[v - n]]
        out.append(items)
    return out


def windows(items: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Items (document, start, length) of at most ``window`` tokens each as windows of at most ``window`` tokens.

    The count starts at the fewest windows that can hold all and rises by one while a window
    exceeds its capacity and at most one in PADDING windows is padding. Only what exceeds a
    window after that is cut off. No items give no windows; items of equal size keep their order.
    """
    total = sum(x[2] for x in items)
    k = -(-total // window)
    while True:
        filled = [[items[i] for i in own] for own in difference([x[2] for x in items], k)]
        if all(sum(x[2] for x in own) <= window for own in filled) or (k + 1) * window * PADDING > total * (PADDING + 1):
            break
        k += 1
    over, room = [], []
    for own in filled:
        much = sum(x[2] for x in own) - window
        while much > 0:
            doc, start, length = own.pop()
            cut = min(much, length)
            over.append((doc, start + length - cut, cut))
            if length > cut:
                own.append((doc, start, length - cut))
            much -= cut
        if much < 0:
            room.append([-much, own])
    for doc, start, length in over:
        while length:
            put = min(length, room[-1][0])
            room[-1][1].append((doc, start, put))
            start, length = start + put, length - put
            room[-1][0] -= put
            if not room[-1][0]:
                room.pop()
    return [own for own in filled if own]


def _packed(path: str, window: int, batch_windows: int, end_id: int, with_ids: bool):
    fields = [("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 40
        end = np.uint32(end_id).tobytes()
        docs: dict[int, tuple[object, bytes]] = {}  # open documents by a running number: id, ids
        items: list[tuple[int, int, int]] = []
        held, number = 0, 0
        rows: list[tuple] = []

        def emit(filled: list[list[tuple[int, int, int]]]) -> None:
            nonlocal sequence
            for own in filled:
                offset = 0
                for doc, start, length in own:
                    key, ids = docs[doc]
                    part = memoryview(ids)[4 * start : 4 * (start + length)]
                    rows.append((key, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, *([np.frombuffer(part, np.int32)] if with_ids else [])))
                    offset += length
                sequence += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])
            rows.clear()
            return batch

        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), tok(texts), strict=True):
                ids += end
                docs[number] = (key, ids)
                n, start = len(ids) // 4, 0
                while n - start >= window:
                    emit([[(number, start, window)]])
                    start += window
                if start < n:
                    items.append((number, start, n - start))
                    held += n - start
                else:
                    docs.pop(number)
                if held >= batch_windows * window:
                    emit(windows(items, window))
                    items, held = [], 0
                    docs.clear()
                number += 1
                if len(rows) >= 1024:
                    yield flush()
        if items:
            emit(windows(items, window))
        if rows:
            yield flush()

    return run


def pack(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, batch_windows: int = 128, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of tokenised documents in sequences of at most ``window`` tokens.

    path names the tokenizer's vocabulary file, on every worker. Returns a row for each piece:
    the id column, start (its document's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit), doc_tokens (with the end id that closes every document),
    sequence_id, offset (in the sequence, gapless from 0) and, with_ids, the ids.

    A null or empty text is the end id alone. Repeated rows are packed once each; a null id
    stays null. An empty table gives no rows. Other columns are neither read nor returned.
    Long documents are streamed in whole windows; no text is shortened. A partition pads less
    than one of PADDING windows, or one window where it has fewer.
    """
    tune(documents.sparkSession)
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    docs = documents.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{text_col}` AS text")
    out = docs.mapInArrow(_packed(path, window, batch_windows, end_id, with_ids), schema.replace(f"`{id_col}`", "doc"))
    return out.withColumnRenamed("doc", id_col)
