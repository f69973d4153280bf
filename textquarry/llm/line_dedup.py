"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is its sequence of words (white space between, lower case). Two lines are copies when
their sequences are equal or one inserted, deleted or replaced word apart. A line of at least
``min_words`` words is dropped when an earlier line, in the order of (id, line number), is a
copy of it.

Deletion neighbourhoods: a line emits the key of its own sequence (place 0) and of the sequence
without its i-th word, for every i. Copies by replacement share the key of the same place i;
copies by insertion share a key of which one place is 0. The key of a sequence is the XOR of
hashes of (word, place), so all keys of a line come from one running XOR. Within equal keys the
earliest line of a place stands for all of them, so no pairs are formed: every line gets the
earliest line of its own place and of place 0, and keeps what a comparison of the whole
sequences confirms.

Only lines that can have a copy emit neighbourhoods. Of two copies with w and w or w + 1 words,
either the first floor(w / 2) words agree or the last w - floor(w / 2) do; each distinct line
files the four such halves, and one whose halves nobody else files has no copy. A half that is
shared says on which side the edit lies, and only the keys of that side are emitted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A table of at most so many bytes is broadcast to the scan of the texts; a larger one is joined by a shuffle.
BROADCAST_BYTES = 24 << 20
#: Bytes of a row of likely lines: four hashes, a number, two flags.
LIKELY_BYTES = 64
_BLANK = " \t\x0b\f\r"
#: Places of a line that are summed up together.
STEP = 64


def _words(line: Column) -> Column:
    return F.split(F.trim(F.lower(line), F.lit(_BLANK)), "[ \\t\\x0B\\f\\r]+")


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _order() -> list[str]:
    return ["id", "doc", "line"]


def _lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, line, raw) of all lines; doc tells texts of one id apart."""
    return documents.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "raw")
    )


def _named(lines: DataFrame) -> DataFrame:
    """Adds the line's name, two hashes of its words."""
    return lines.withColumn("h", F.xxhash64("words")).withColumn("g", F.hash("words"))


def _halves(lines: DataFrame) -> DataFrame:
    """Adds the four halves: of w words and, as the longer of two copies, of w - 1. A front half is odd, a back half even."""
    w = F.size("words")
    out = lines
    for name, n in (("0", w), ("1", w - 1)):
        half = F.floor(n / 2).cast("int")
        out = out.withColumn(f"p{name}", F.xxhash64(F.lit("p"), n, F.slice("words", F.lit(1), half)).bitwiseOR(F.lit(1)))
        out = out.withColumn(f"s{name}", F.xxhash64(F.lit("s"), n, F.slice("words", w - (n - half) + 1, n - half)).bitwiseAND(F.lit(-2)))
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(steps: Column) -> Column:
    """The XOR of the first 1, 2, ... numbers, block by block, so that long lines take time in proportion."""
    zero = F.lit(0).cast("long")
    block = lambda b: F.slice(steps, b * STEP + 1, F.lit(STEP))
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STEP).cast("int"))
    append = lambda acc, x: F.array_append(acc, _xor(F.element_at(acc, -1), x))

    def joined(totals: Column) -> Column:
        own = lambda b: F.slice(F.aggregate(block(b), F.array(F.aggregate(F.slice(totals, F.lit(1), b), zero, _xor)), append), 2, STEP)
        return F.flatten(F.transform(blocks, own))

    return _let(F.transform(blocks, lambda b: F.aggregate(block(b), zero, _xor)), joined)


def _keys(words: Column, first: Column, last: Column) -> Column:
    """array<struct<place, key>>: the whole sequence, and it without the word of each place on the allowed sides."""
    zero = F.lit(0).cast("long")
    w = F.size(words)
    half = F.floor((w - 1) / 2).cast("int")

    def made(at: Column, moved: Column) -> Column:
        whole = F.aggregate(at, zero, _xor)
        steps = F.zip_with(F.concat(F.array(zero), F.slice(at, 1, w - 1)), moved, _xor)
        both = F.struct(F.aggregate(moved, zero, _xor).alias("total"), _let(steps, _running).alias("running"))
        without = _let(both, lambda s: F.transform(s["running"], lambda x, j: F.struct((j + 1).alias("place"), _xor(x, s["total"]).alias("key"))))
        # An edit outside the first half lies at a place beyond floor((w - 1) / 2), one outside the last half at or before ceil(w / 2).
        without = F.filter(without, lambda s: (first & (s["place"] > half)) | (last & (s["place"] <= w - half)))
        return F.concat(F.array(F.struct(F.lit(0).alias("place"), whole.alias("key"))), without)

    here = F.transform(words, lambda x, j: F.xxhash64(x, j))  # word j at place j
    before = F.transform(words, lambda x, j: F.xxhash64(x, j - 1))  # word j one place on
    return _let(F.struct(here.alias("at"), before.alias("moved")), lambda s: made(s["at"], s["moved"]))


def _less(words: Column, place: Column) -> Column:
    """words without the one at place; all of them for place 0."""
    return F.when(place == 0, words).otherwise(F.concat(F.slice(words, F.lit(1), F.greatest(place - 1, F.lit(0))), F.slice(words, place + 1, F.size(words))))


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """(doc, dropped): for every text that loses lines, the numbers of those lines (from 0)."""
    scratch = Scratch(documents.sparkSession)
    order = F.struct(*_order())
    lines = _lines(documents, id_col, text_col)
    worded = lines.withColumn("words", _words(F.col("raw"))).where(F.size("words") >= min_words)
    occurs = scratch.save(_halves(_named(worded)).drop("words", "raw"))
    distinct = occurs.groupBy("h", "g").agg(F.min(order).alias("first"), *[F.max(c).alias(c) for c in ("p0", "p1", "s0", "s1")], F.count("*").alias("n"))
    distinct = scratch.save(distinct)

    # What is common is found before the shuffle as far as possible, and written, so that the rows of a very common half can be split.
    halves = distinct.select("h", "g", F.explode(F.array("p0", "p1", "s0", "s1")).alias("half"))
    line = F.struct("h", "g")
    common = scratch.save(halves.groupBy("half").agg(F.min(line).alias("x"), F.max(line).alias("y")).where("x < y").select("half"))
    front = F.col("half").bitwiseAND(F.lit(1)) == 1
    likely = halves.join(common, "half", "left_semi").groupBy("h", "g").agg(F.max(front).alias("front"), F.max(~front).alias("back"))
    likely = scratch.save(likely.join(distinct.select("h", "g", "first.*"), ["h", "g"]))
    few = likely.count() * LIKELY_BYTES <= BROADCAST_BYTES
    found = lines.join((F.broadcast(likely) if few else likely).drop("id"), ["doc", "line"]).withColumn("words", _words(F.col("raw")))
    found = scratch.save(found.select("h", "g", "words", "front", "back", order.alias("first")).dropDuplicates(["h", "g"]))

    keys = scratch.save(found.select("h", "g", "first", F.explode(_keys(F.col("words"), F.col("front"), F.col("back"))).alias("k")).select("h", "g", "first", "k.*"))
    shared = scratch.save(keys.groupBy("key").agg(F.min("h").alias("h0"), F.max("h").alias("h1")).where("h0 <> h1").select("key"))
    met = scratch.save(keys.join(shared, "key", "left_semi"))

    lead = scratch.save(met.groupBy("key", "place").agg(F.min(F.struct("first", "h", "g")).alias("lead")))
    after = lead.where("place > 0").groupBy("key").agg(F.min(F.struct(F.col("lead.first").alias("first"), F.col("lead.h").alias("h"), F.col("lead.g").alias("g"), "place")).alias("lead"))
    same = met.where("place > 0").join(lead.where("place > 0"), ["key", "place"]).select("h", "g", "first", "place", "lead.first", F.col("lead.h").alias("kh"), F.col("lead.g").alias("kg"), F.col("place").alias("kplace"))
    longer = met.where("place > 0").join(lead.where("place = 0").drop("place"), "key").select("h", "g", "first", "place", "lead.first", F.col("lead.h").alias("kh"), F.col("lead.g").alias("kg"), F.lit(0).alias("kplace"))
    shorter = met.where("place = 0").join(after, "key").select("h", "g", "first", "place", "lead.first", F.col("lead.h").alias("kh"), F.col("lead.g").alias("kg"), F.col("lead.place").alias("kplace"))
    pairs = [p.toDF("h", "g", "own", "place", "earlier", "kh", "kg", "kplace").where("earlier < own") for p in (same, longer, shorter)]
    pairs = scratch.save(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).select("h", "g", "place", "kh", "kg", "kplace").distinct())
    words = found.select("h", "g", "words")
    near = pairs.join(words, ["h", "g"]).join(words.toDF("kh", "kg", "kwords"), ["kh", "kg"]).where(_less(F.col("words"), F.col("place")) == _less(F.col("kwords"), F.col("kplace"))).select("h", "g").distinct()

    marked = distinct.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").where("near or n > 1").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    marked = scratch.save(marked)
    gone = occurs.select("h", "g", *_order()).join(marked, ["h", "g"]).where(F.col("near") | (order != F.col("first")))
    return scratch.save(gone.groupBy("doc").agg(F.collect_set("line").alias("dropped")))


def drop_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """documents with the text of its kept lines, and n_lines and n_dropped as further columns.

    A null text stays null and has no lines; an empty text is one blank line. Blank lines and
    lines of fewer than min_words words are always kept. Rows that repeat both id and text are
    one document and lose the same lines; of texts with one id, the one of smaller hash comes
    first; null ids come last. Columns of the table with the names n_lines or n_dropped are
    replaced. An empty table gives no rows.
    """
    gone = repeated_lines(documents, id_col, text_col, min_words).toDF("_doc", "_dropped")
    size = gone.agg(F.sum(F.size("_dropped") * 4 + 48)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    named = documents.withColumn("_doc", F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(id_col), F.col(text_col))))
    lines = F.split(F.col(text_col), "\n")
    joined = named.join(gone, "_doc", "left")
    others = lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_dropped")), lambda i: F.get(own, i))
    kept = F.when(F.col("_dropped").isNull(), F.col(text_col)).otherwise(F.array_join(_let(lines, others), "\n"))
    joined = joined.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_dropped": F.greatest(F.coalesce(F.size("_dropped"), F.lit(0)), F.lit(0)), "_kept": kept})
    out = [F.col("_kept").alias(c) if c == text_col else F.col(c) for c in documents.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, F.greatest("n_lines", F.lit(0)).alias("n_lines"), "n_dropped")


def keep_unrepeated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """documents with repeated lines dropped and without the texts that this leaves blank; columns as given.

    Texts that lose no line stay, null, empty and blank ones too. n_chars follows the text where
    the table has it. Null ids come last in the order; rows that repeat id and text lose the same
    lines; an empty table gives no rows; columns of other names pass through.
    """
    out = drop_repeated_lines(documents, id_col, text_col).where((F.col("n_dropped") == 0) | F.col(text_col).rlike("\\S"))
    if chars_col in documents.columns:
        out = out.withColumn(chars_col, F.when(F.col("n_dropped") > 0, F.char_length(text_col)).otherwise(F.col(chars_col)))
    return out.select(*documents.columns)
