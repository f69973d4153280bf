"""Answers of models: checked as VARIANT, kept in a ledger, asked for once."""

import json

import pytest
from pyspark.sql import functions as F

from textquarry import providers
from textquarry.functions.answers import ENTITY_FIELDS, SUMMARY_FIELDS, Field, checked, record, unfenced
from textquarry.plans import ingest as plan
from textquarry.plans.ledger import Ledger, request_key

CASES = [
    ('{"name": "A", "type": "city", "state": null, "confidence": 0.5, "more": 1}', []),
    ('```json\n{"name": "A", "type": "city"}\n```', []),
    ('{"name": "A", "type": "city", "confidence": 1}', []),
    ('{"name": "A", "type": 7}', ["type is not of kind string"]),
    ('{"name": null, "confidence": 1.5}', ["name is missing", "type is missing", "confidence is above 1"]),
    ('{"name": "A", "type": "city", "confidence": "high"}', ["confidence is not of kind number"]),
    ('{"name": "A", "type": "city", "confidence": -1}', ["confidence is below 0"]),
    ("[1, 2]", ["not an object"]), ('"text"', ["not an object"]), ("null", ["not an object"]), ("{oops", ["not JSON"]), ("", ["no answer"]), (" \n", ["no answer"]), (None, ["no answer"]),
]


def test_reasons(spark):
    """Every answer is accepted or rejected with all its reasons, never both."""
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "id int, answer string")
    good, bad = checked(df, ENTITY_FIELDS)
    assert {r.id: list(r.reasons) for r in bad.collect()} == {i: why for i, (_, why) in enumerate(CASES) if why}
    got = {r.id: r.record.asDict() for r in good.collect()}
    assert set(got) == {i for i, (_, why) in enumerate(CASES) if not why}
    assert got[0] == {"name": "A", "type": "city", "state": None, "confidence": 0.5} and got[2]["confidence"] == 1.0


def test_records(spark):
    fields = [*SUMMARY_FIELDS, Field("kind", "string", among=("a", "b")), Field("n", "integer", False, 1, 5), Field("ok", "boolean", False), Field("o", "object", False)]
    raw = '{"title": "t", "keywords": ["x", "y"], "fiscal_year": 2024, "kind": "b", "n": 5, "ok": true, "o": {"p": 1}}'
    df = spark.createDataFrame([(raw,), ('{"kind": "c", "n": 6, "keywords": 3, "ok": "yes", "o": []}',)], "answer string")
    good, bad = checked(df, fields)
    one = good.select("record.*").drop("o").first()
    assert (one.title, one.keywords, one.fiscal_year, one.kind, one.n, one.ok, one.summary) == ("t", ["x", "y"], 2024, "b", 5, True, None)
    assert list(bad.first().reasons) == ["keywords is not of kind array", "kind is none of its values", "n is above 5", "ok is not of kind boolean", "o is not of kind object"]
    assert df.select(unfenced(F.lit("```\n{}\n```  ")).alias("u"), record(F.lit("{"), [Field("a", "string")])["a"].alias("a")).first() == ("{}", None)


class Calls:
    """Counts what it is asked, over the tasks of this machine, in a file."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, rows):
        with open(self.path, "a") as out:
            out.writelines(f"{json.dumps(r)}\n" for r in rows)
        return [None if "fail" in r[0] else json.dumps(r[0].upper()) for r in rows]

    def asked(self):
        try:
            with open(self.path) as lines:
                return [json.loads(line)[0] for line in lines]
        except FileNotFoundError:
            return []


def test_ledger_asks_once(spark, tmp_path):
    """Repeated prompts are one call; a second run calls for what is new and for what failed; another model knows nothing."""
    calls = Calls(tmp_path / "calls")
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("fail",), ("c",)], "prompt string").repartition(3)
    ledger = Ledger(spark, f"{tmp_path}/ledger", "m", block=2)
    got = {json.loads(r.answer) for r in ledger.ask("k", df, ["prompt"], calls).collect()}
    assert got == {"A", "B", "C"} and sorted(calls.asked()) == ["a", "b", "c", "fail"]
    more = df.unionByName(spark.createDataFrame([("d",)], "prompt string"))
    keyed = more.distinct().withColumn("key", request_key("k", "m", F.col("prompt")))
    again = {r.prompt: r.answer for r in keyed.join(ledger.ask("k", more, ["prompt"], calls), "key").collect()}
    assert again == {p: json.dumps(p.upper()) for p in "abcd"}
    assert sorted(calls.asked()[4:]) == ["d", "fail"]
    assert Ledger(spark, f"{tmp_path}/ledger", "n").ask("k", df.limit(0), ["prompt"], calls).count() == 0
    assert ledger.ask("other", df.where("prompt = 'a'"), ["prompt"], calls).count() == 1 and calls.asked()[-1] == "a"


def test_ledger_keeps_what_was_answered(spark, tmp_path):
    """A run that fails in one block has paid for the blocks before; the next one asks for the rest."""
    df = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")

    def fails(rows):
        if any(r[0] == "p7" for r in rows):
            raise OSError("lost")
        return [json.dumps(r[0]) for r in rows]

    ledger = Ledger(spark, f"{tmp_path}/ledger", "m", block=5)
    with pytest.raises(Exception, match="lost"):
        ledger.ask("k", df, ["prompt"], fails, at_once=1)
    kept = ledger.known("k").count()
    calls = Calls(tmp_path / "calls")
    assert ledger.ask("k", df, ["prompt"], calls).count() == 40
    assert len(calls.asked()) == 40 - kept


def test_request_keys_differ(spark):
    one = spark.range(1)
    keys = one.select(request_key("k", "m", F.lit("ab"), F.lit("c")), request_key("k", "m", F.lit("a"), F.lit("bc")), request_key("k", "m", F.lit("a"), F.lit(None)), request_key("k", "m", F.lit("a"), F.lit("")), request_key("k2", "m", F.lit("ab"), F.lit("c"))).first()
    assert len(set(keys)) == 4 and keys[2] == keys[3]


def test_second_ingest_calls_nobody(spark, tmp_path):
    """Documents, their chunks and projects, and entities: all are answered by the ledger; rejects are kept with their reason."""
    log = tmp_path / "log"

    class Model(providers.RuleModel):
        name = "counted"

        def noted(self, what):
            with open(log, "a") as out:
                out.write(f"{what}\n")

        def summarize(self, content, url):
            self.noted("summary")
            return super().summarize(content, url)

        def projects(self, content, url):
            self.noted("projects")
            return super().projects(content, url)

        def entity(self, pages, website):
            self.noted("entity")
            return super().entity(pages, website)

    text = "# City of Example budget FY2024\n\n## Network Upgrade Project\nThe council approved a budget of $2.1 million for the network upgrade.\n\n" + "Plain words follow here. " * 20
    rows = [("e", f"f{i}", f"https://e.gov/{i}", "e", str(i), text, None) for i in range(3)] + [("e", "f9", "https://e.gov/9", "e", "9", "short", None)]
    corpus = spark.createDataFrame(rows, "entity string, file string, url string, org_id string, url_id string, text string, corrupt string")
    house = plan.Warehouse(spark, f"{tmp_path}/house")
    done = plan.ingest(corpus, house, providers.HashedEmbedding(8), Model(), f"{tmp_path}/staging")
    said = log.read_text().split()
    assert sorted(said) == ["entity", *["projects"] * 3, *["summary"] * 3]
    assert done["documents"] == 3 == house.read("documents").count() and done["chunks"] == house.read("chunks").count() > 0 and done["rejected"] == 1
    assert [(r.file, r.reason) for r in house.rejects().collect()] == [("f9", "short")]
    again = plan.ingest(corpus, house, providers.HashedEmbedding(8), Model(), f"{tmp_path}/staging")
    assert log.read_text().split() == said and again == {"documents": 0, "chunks": 0, "projects": 0, "project_evidence": 0, "rejected": 1}
    other = plan.Warehouse(spark, f"{tmp_path}/other")  # a new warehouse with the old ledger, as after its tables were lost
    (tmp_path / "other").mkdir()
    (tmp_path / "house" / "_ledger").rename(tmp_path / "other" / "_ledger")
    assert plan.ingest(corpus, other, providers.HashedEmbedding(8), Model(), f"{tmp_path}/staging2")["documents"] == 3
    assert log.read_text().split() == said
