"""Registered queries of raw answers: checked against what they should hold, and asked for once."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions.answers import Field, reasons, record
from .plans.ledger import Ledger, request_key
from .queries import _t, query
from .runtime import Scratch

# What an event's properties may come as: whole, cut off, of another shape, without the field, with text in it, fenced, empty, out of range.
_RAW_SQL = """CASE event_id % 9 WHEN 1 THEN left(props, length(props) - 1) WHEN 2 THEN '[' || props || ']' WHEN 3 THEN replace(props, '"k"', '"j"') WHEN 4 THEN '{"k": "text"}'
WHEN 5 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || props || chr(10) || chr(96) || chr(96) || chr(96) WHEN 6 THEN ' ' WHEN 7 THEN '{"k": ' || (event_id - 5000) || ', "m": [1]}' ELSE props END"""


@query(
    f"""WITH r AS (SELECT event_id, regexp_replace(regexp_replace({_RAW_SQL}, '^`+[a-z]*\\n', ''), '\\n`+$', '') AS raw FROM events),
j AS (SELECT event_id, raw, trim(raw) = '' AS blank, json_valid(raw) AS valid FROM r),
k AS (SELECT *, CASE WHEN valid THEN json_type(raw) END AS shape, CASE WHEN valid THEN json_type(raw, '$.k') END AS kind, CASE WHEN valid THEN TRY_CAST(json_extract_string(raw, '$.k') AS BIGINT) END AS k FROM j),
w AS (SELECT *, CASE WHEN blank THEN 'no answer' WHEN NOT valid THEN 'not JSON' WHEN shape <> 'OBJECT' THEN 'not an object' WHEN kind IS NULL THEN 'k is missing'
  WHEN kind NOT IN ('UBIGINT', 'BIGINT') THEN 'k is not of kind integer' WHEN k < 0 THEN 'k is below 0' WHEN k > 100 THEN 'k is above 100' END AS reason FROM k)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN k END AS k FROM w"""
)
def answers_checked(spark, sf):
    """The properties of all events as answers, of which most are broken in one of seven ways."""
    raw = F.expr(_RAW_SQL)
    fields = [Field("k", "integer", low=0, high=100)]
    noted = _t(spark, sf, "events").select("event_id", raw.alias("answer")).withColumn("reasons", reasons(F.col("answer"), fields))
    return noted.select("event_id", F.get("reasons", F.lit(0)).alias("reason"), F.when(F.size("reasons") == 0, record(F.col("answer"), fields)["k"]).alias("k"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS answer FROM documents")
def ledger_of_documents(spark, sf):
    """A request for each document's text, answered from a ledger that a first run filled for half of them and a second for all."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    ledger = Ledger(spark, f"{Scratch(spark).base}/ledger", "length")
    count = lambda rows: [json.dumps(len(t)) for (t,) in rows]
    ledger.ask("length", docs.where(F.pmod("doc_id", F.lit(2)) == 0), ["text"], count)
    answers = ledger.ask("length", docs, ["text"], count)
    return docs.withColumn("key", request_key("length", "length", F.col("text"))).join(answers, "key").select("doc_id", F.col("answer").cast("long").alias("answer"))
