"""Raw answers of models as VARIANT: parsed, tested against what they should hold, split from what fails.

Everything is column expressions. An answer is never trusted: text that is no JSON, JSON of another
shape, and values out of their range each get a reason, and answers with a reason go to a table
of rejects instead of the pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a variant's type may begin with for each kind, and the SQL type that its values are read as.
KINDS = {"string": (("STRING",), "string"), "integer": (("BIGINT",), "bigint"), "number": (("BIGINT", "DECIMAL", "DOUBLE"), "double"), "boolean": (("BOOLEAN",), "boolean"), "array": (("ARRAY",), "variant"), "object": (("OBJECT",), "variant")}


@dataclass(frozen=True)
class Field:
    """What a field of an answer must be. ``type``: the SQL type to read it as, if not its kind's own (``array<string>``)."""

    name: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()
    type: str | None = None

    @property
    def sql_type(self) -> str:
        return self.type or KINDS[self.kind][1]


def unfenced(raw: Column) -> Column:
    """The answer without the fence of a code block around it and white space."""
    return F.regexp_replace(F.regexp_replace(raw, "^\\s*(?:```[a-zA-Z]*\\s*\\n)?", ""), "(?:\\n\\s*```)?\\s*$", "")


def parsed(raw: Column) -> Column:
    """The answer as VARIANT; null if it is no JSON."""
    return F.try_parse_json(unfenced(raw))


def _value(json: Column, f: Field) -> Column:
    return F.try_variant_get(json, f"$.{f.name}", f.sql_type)


def _reason(json: Column, f: Field) -> Column:
    """What is wrong with a field, or null."""
    there = F.try_variant_get(json, f"$.{f.name}", "variant")
    kind = F.schema_of_variant(there)
    missing = there.isNull() | (kind == "VOID")
    fits = F.lit(False)
    for begin in KINDS[f.kind][0]:
        fits = fits | kind.startswith(begin)
    value = _value(json, f)
    wrong = F.when(missing, F.lit(f"{f.name} is missing") if f.required else F.lit(None)).when(~fits | value.isNull(), f"{f.name} is not of kind {f.kind}")
    if f.low is not None:
        wrong = wrong.when(value < f.low, f"{f.name} is below {f.low:g}")
    if f.high is not None:
        wrong = wrong.when(value > f.high, f"{f.name} is above {f.high:g}")
    if f.among:
        wrong = wrong.when(~value.isin(*f.among), f"{f.name} is none of its values")
    return wrong


def reasons(raw: Column, fields: list[Field]) -> Column:
    """Why an answer is not what it should be, as an array; empty if it is."""
    json = parsed(raw)
    each = F.filter(F.array(*[_reason(json, f) for f in fields]), lambda r: r.isNotNull())
    blank = raw.isNull() | ~raw.rlike("\\S")
    return F.when(blank, F.array(F.lit("no answer"))).when(json.isNull(), F.array(F.lit("not JSON"))).when(~F.schema_of_variant(json).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(each)


def record(raw: Column, fields: list[Field]) -> Column:
    """The fields of an answer as a struct; one that is absent or of another kind is null."""
    json = parsed(raw)
    return F.struct(*[_value(json, f).alias(f.name) for f in fields])


def checked(answers: DataFrame, fields: list[Field], raw: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a table of raw answers: the first with ``record``, the second with ``reasons`` and the answer as it came.

    A row is in exactly one of them. Fields that an answer has beyond those named are let be.
    """
    noted = answers.withColumn("reasons", reasons(F.col(raw), fields))
    good = noted.where(F.size("reasons") == 0).drop("reasons")
    return good.withColumn("record", record(F.col(raw), fields)).drop(raw), noted.where(F.size("reasons") > 0)


# What models are asked for.
SUMMARY_FIELDS = [Field("title", "string", False), Field("summary", "string", False), Field("keywords", "array", False, type="array<string>"), Field("document_type", "string", False), Field("fiscal_year", "integer", False, type="int")]
ENTITY_FIELDS = [Field("name", "string"), Field("type", "string"), Field("state", "string", False), Field("confidence", "number", False, low=0, high=1)]
