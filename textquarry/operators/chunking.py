"""Markdown chunks of bounded size.

Sections begin at headers of level 2 and 3. Sections that are too small join the one before,
sections that are too large are packed paragraph by paragraph, and every further part of such
a section begins with the last words of the part before it. What a part begins with counts
towards its size, so a section is folded in order; documents are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..runtime import ship, short_batches

MAX_TOKENS, MIN_TOKENS, OVERLAP_WORDS = 1000, 100, 25
#: Characters of chunks that a worker gathers before it hands them on.
HELD = 1 << 20
_BLANK = " \t\n\x0b\f\r                 　﻿"
_SPACE = f"[{_BLANK}]"
_HEADER = re.compile(rf"^(#{{2,3}}){_SPACE}+([^\n\r  ]+)$", re.M)
_SENTENCE = re.compile(rf"(?<=[.!?]){_SPACE}+(?=[A-Z])")
_GAP = re.compile(rf"{_SPACE}+")

Count = Callable[[str], int]


def estimate(text: str) -> int:
    """A token for every four characters begun; used where no tokenizer is given."""
    return -(-len(text) // 4)


@dataclass
class Section:
    title: str
    content: str


def sections(markdown: str) -> list[Section]:
    """Sections with a body, in order; text before the first header is the introduction."""
    heads = [(m.start(), m.group(2).strip(_BLANK)) for m in _HEADER.finditer(markdown)]
    if not heads:
        return [Section("Document", markdown.strip(_BLANK))]
    out = [Section("Introduction", markdown[: heads[0][0]])]
    for (start, title), (end, _) in zip(heads, [*heads[1:], (len(markdown), "")], strict=True):
        line_end = markdown.find("\n", start)
        out.append(Section(title, markdown[line_end + 1 if line_end >= 0 else start : end]))
    trimmed = [Section(s.title, s.content.strip(_BLANK)) for s in out]
    return [s for s in trimmed if s.content]


def merged(parts: list[Section], count: Count) -> list[Section]:
    """Sections under MIN_TOKENS appended to the one before; the first stays whatever its size."""
    out: list[Section] = []
    for part in parts:
        if out and count(part.content) < MIN_TOKENS:
            out[-1].content = f"{out[-1].content}\n\n{part.content}"
        else:
            out.append(Section(part.title, part.content))
    return out


def _fill(pieces: list[tuple[str, int]], glue: str) -> list[str]:
    """Pieces joined greedily while their tokens sum to at most MAX_TOKENS."""
    out, open_, total = [], [], 0
    for text, tokens in pieces:
        if open_ and total + tokens > MAX_TOKENS:
            out.append(glue.join(open_))
            open_, total = [], 0
        open_.append(text)
        total += tokens
    return [*out, glue.join(open_)] if open_ else out


def by_words(text: str, count: Count) -> list[str]:
    """Runs of words; each word is counted with the space after it."""
    return _fill([(w, count(w + " ")) for w in _GAP.split(text)], " ")


def by_sentences(text: str, count: Count) -> list[str]:
    """A paragraph as it is, as runs of sentences, or as runs of words where a sentence is too large itself."""
    if count(text) <= MAX_TOKENS:
        return [text]
    sentences = [s for s in _SENTENCE.split(text) if s.strip(_BLANK)]
    if len(sentences) < 2:
        return by_words(text, count)
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for sentence in sentences:
        tokens = count(sentence)
        if tokens <= MAX_TOKENS:
            held.append((sentence, tokens))
            continue
        out += [x.strip(_BLANK) for x in _fill(held, " ")]
        out += by_words(sentence, count)
        held = []
    return out + [y for y in (x.strip(_BLANK) for x in _fill(held, " ")) if y]


def parts(section: Section, count: Count) -> Iterator[tuple[str, str, int]]:
    """(title, content, tokens) of a large section. A part's tokens are the sum over its paragraphs, the last part's are counted."""
    paragraphs = [p for raw in re.split(r"\n\n+", section.content) if (text := raw.strip(_BLANK)) for p in by_sentences(text, count)]
    title, body, tokens = section.title, "", 0
    for paragraph in paragraphs:
        own = count(paragraph)
        if body and tokens + own > MAX_TOKENS:
            yield title, body.strip(_BLANK), tokens
            title = f"{section.title} (continued)"
            body = " ".join(_GAP.split(body)[-OVERLAP_WORDS:]) + "\n\n" + paragraph
            tokens = count(body)
        else:
            body = f"{body}\n\n{paragraph}" if body else paragraph
            tokens += own
    if body.strip(_BLANK):
        yield title, body.strip(_BLANK), count(body)


def chunk_text(markdown: str | None, count: Count = estimate) -> list[tuple[str, str, int, int]]:
    """(section_title, content, token_count, chunk_index) of a document; none for a blank one."""
    if not markdown or not markdown.strip(_BLANK):
        return []
    found: list[tuple[str, str, int]] = []
    for section in merged(sections(markdown), count):
        tokens = count(section.content)
        found += parts(section, count) if tokens > MAX_TOKENS else [(section.title, section.content, tokens)]
    return [(*chunk, i) for i, chunk in enumerate(found)]


def chunk_documents(documents: DataFrame, key: str, text: str, count: Count = estimate) -> DataFrame:
    """One row per chunk: the key, section_title, content, token_count, chunk_index. Nothing is shuffled."""
    ship(documents.sparkSession)
    short_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.string(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "section_title", "content", "token_count", "chunk_index"])

        for batch in batches:
            keys, texts = batch.columns
            rows, held = [], 0
            for i in range(batch.num_rows):  # one text and HELD characters of chunks at a time
                for chunk in chunk_text(texts[i].as_py(), count):
                    rows.append((keys[i].as_py(), *chunk))
                    held += len(chunk[1])
                    if held >= HELD:
                        yield batch_of(rows, keys.type)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows, keys.type)

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(key, text).mapInArrow(run, f"key {kind}, section_title string, content string, token_count int, chunk_index int")
    return out.withColumnRenamed("key", key)


def merge_small_sections(parts_: DataFrame, key: str, position: str, content: str, size: Column, least: int = MIN_TOKENS) -> DataFrame:
    """The merge of small sections as gaps and islands: key, group (from 1), content, n_sections.

    A section begins a group if it is large enough or the first of its key.
    """
    order = Window.partitionBy(key).orderBy(position)
    first = F.row_number().over(order) == 1
    begun = parts_.withColumn("group", F.sum(F.when(first | (size >= least), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(content).alias("c"))))
    return begun.groupBy(key, F.col("group").cast("int").alias("group")).agg(F.array_join(F.transform(own, lambda x: x["c"]), "\n\n").alias("content"), F.count("*").alias("n_sections"))


def lines_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines as sections: key, position, content."""
    return documents.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("position", "content")).where(js_trim(F.col("content")) != "")
