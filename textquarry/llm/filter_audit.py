"""Filter interaction audit by inclusion-exclusion over the lattice of filter intersections.

A document's five flags say which filters it fails. For a set T of filters let J[T] be the number
of documents that fail all of T: the sum, over documents, of the product of T's flags. The 32
sums of a part answer every question about every order of its filters, none of which is run:

* survivors of S:       N[S] = sum over T in S of (-1)^|T| J[T]                  (Moebius inversion)
* removed by f after P: N[P] - N[P + f];  redundant: J[f] less that
* unique failures of f: N[all but f] - N[all]
* Shapley value of f:   the game v(S) = J[{}] - N[S] has the Harsanyi dividends (-1)^(|T|+1) J[T], and
  each is shared equally by the members of T: the sum over T with f of dividend / |T|. Over the 120
  orders together that is 120 / |T| of it, a whole number.

Everything is DataFrame operations. What is shuffled is one narrow row a document (id, part, hash,
flags), first by id, to meet the labels, then by the hash of its text, pre-aggregated, so that
thousands of copies of one text are a row for each part and task. No row is joined back to its text's group:
the copies that fail the last filter are all but those of the smallest id, which the counts tell.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)
_WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """A to D as booleans of a text that is not null: short, repetitive, upper case, symbols.

    A: under 200 words. B: less than half of the words distinct. C: more than 3 % of the code points
    A-Z. D: any of ``#$%&*|``.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def patterns(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, f0..f4, n, good, toxic): documents of each part and combination of failures, counted.

    f0 to f3 are those of ``failures``; f4: the text is that of a smaller id of the whole table.
    good and toxic count documents that ``labels`` marks quality = 1 and toxic = 1.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    judged = documents.select(F.col(id_col).alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), *[f.cast("long").alias(f"f{i}") for i, f in enumerate(failures(text))])
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    flags = [f"f{i}" for i in range(4)]
    # Null ids have no label and would meet in one task of the join, so they pass it by.
    known = judged.where("id is not null").join(marks, "id", "left")
    unknown = judged.where("id is null").withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    sums = lambda n: [F.sum(n).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    each = known.groupBy("id", "part", "same", *flags).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # Of the copies in a part: all, and those of the smallest id (a struct that starts with the id).
    copies = each.groupBy("same", "part", *flags).agg(*sums("n"), F.min(F.struct("id", "n", "good", "toxic")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("same"))
    here = F.col("first.id") == F.col("least")
    copies = copies.withColumn("least", least)
    fresh = copies.where(here).select("part", *flags, F.lit(0).cast("long").alias("f4"), "first.n", "first.good", "first.toxic")
    kept = lambda c: F.col(c) - F.when(here, F.col(f"first.{c}")).otherwise(0)
    again = copies.select("part", *flags, F.lit(1).cast("long").alias("f4"), *[kept(c).alias(c) for c in ("n", "good", "toxic")]).where("n > 0")
    nameless = unknown.select("part", *flags, F.lit(0).cast("long").alias("f4"), F.lit(1).cast("long").alias("n"), "good", "toxic")
    return fresh.unionByName(again).unionByName(nameless).groupBy("part", *flags, "f4").agg(*sums("n"))


def joint_failures(counted: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of the 32 joint-failure sums, filter i at bit i of the index."""

    def product(at: int, weight: str) -> Column:
        out = F.col(weight)
        for i in range(len(FILTERS)):
            if at >> i & 1:
                out = out * F.col(f"f{i}")
        return F.sum(out)

    return counted.groupBy("part").agg(*[F.array(*[product(t, w) for t in range(_SETS)]).alias(w) for w in ("n", "good", "toxic")])


def survivors(joint: str) -> Column:
    """N[S] of all 32 sets S from J: the Moebius inversion, as an array."""
    sign = "if(bit_count(t) % 2 = 0, 1L, -1L)"
    inside = f"aggregate(sequence(0, {_SETS - 1}), 0L, (x, t) -> if((t & s) = t, x + {sign} * {joint}[t], x))"
    return F.expr(f"transform(sequence(0, {_SETS - 1}), s -> {inside})")


def audit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter does in each of the 120 orders, for each part of the documents.

    Returns a row for each part, filter_order (a permutation of ABCDE, applied left to right) and step
    (1 to 5): kept after the step, removed by it, redundant (failing its filter, removed earlier),
    unique_fails (failing no other filter), good_lost and toxic_lost (removed here and so labelled),
    shapley (what its filter removes, summed over all orders). Zeros are included.

    A null part is the empty string, a null text empty (and fails A). Rows that share id and text are
    counted one by one and are not copies of each other. A null id is smaller than none and none is
    smaller than it, so it neither fails E nor makes another fail; it has no label. Several labels of
    an id count together, any 1 being enough. Whole texts count, however long. An empty table
    gives no rows. Columns other than the named ones are not read.
    """
    scratch = Scratch(documents.sparkSession)
    parts = scratch.save(joint_failures(patterns(documents, labels, id_col, text_col, part_col)))
    dividend = f"if(bit_count(t) % 2 = 1, 1L, -1L) * n[t] * (120L div bit_count(t))"
    shared = lambda f: f"aggregate(sequence(1, {_SETS - 1}), 0L, (x, t) -> if((t & {1 << f}) > 0, x + {dividend}, x))"
    parts = parts.withColumns({"left": survivors("n"), "left_good": survivors("good"), "left_toxic": survivors("toxic"), "shares": F.array(*[F.expr(shared(f)) for f in range(len(FILTERS))])})
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda i: f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {i}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, 5), 0, (x, i) -> if(i < step, x | {bit('i')}, x))"))
    every = _SETS - 1
    removed = lambda name: F.expr(f"{name}[before] - {name}[before | own]")
    return steps.select(
        "part", "filter_order", "step", F.expr("left[before | own]").alias("kept"), removed("left").alias("removed"), F.expr("n[own] - (left[before] - left[before | own])").alias("redundant"),
        F.expr(f"left[{every} - own] - left[{every}]").alias("unique_fails"), removed("left_good").alias("good_lost"), removed("left_toxic").alias("toxic_lost"), F.expr("shares[instr('ABCDE', substr(filter_order, step, 1)) - 1]").alias("shapley"),
    )
