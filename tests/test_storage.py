"""Tables dealt by key: plans without an Exchange on the stored side, parts that stay as they are, new sessions."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from textquarry.plans.storage import KeyedTable

SCHEMA = StructType([StructField(n, StringType()) for n in ("id", "name", "type", "state", "website")] + [StructField("n", IntegerType())])


def rows_of(spark, ids, **columns):
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def part(path):
    return path.split("part=")[1].split("/")[0]


@pytest.fixture
def table(spark, tmp_path):
    out = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=8, parts=4)
    assert out.append(rows_of(spark, [f"k{i}" for i in range(60)], name="old", n=1)) == 60
    yield out
    out.drop_registration()


def test_existence_check_moves_no_stored_row(spark, table):
    new = rows_of(spark, [f"k{i}" for i in range(50, 70)], name="new")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = table.unseen(new)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.id for r in found.collect()) == [f"k{i}" for i in range(60, 70)]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    stored = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "Exchange" not in stored.split("SortMergeJoin")[-1].split("+-")[-1]


def test_a_few_keys_read_their_parts(spark, table):
    one = rows_of(spark, ["k3"])
    paths = {part(f) for f in table.near(one).inputFiles()}
    assert len(paths) == 1
    assert sorted(r.id for r in table.unseen(rows_of(spark, ["k3", "k3x"])).collect()) == ["k3x"]


def test_overlay_rewrites_its_parts_only(spark, tmp_path, table):
    before = files(tmp_path)
    found = rows_of(spark, ["k5", "k6", "nobody"], name="new", type="city", website="w").withColumn("state", F.lit(None).cast("string")).withColumn("confidence", F.when(F.col("id") == "k6", 0.1).otherwise(0.9))
    touched = {str(r[0]) for r in found.select(table.part_of(F.col("id"))).distinct().collect()}
    assert 0 < len(touched) < 4
    table.overlay(found)
    after = files(tmp_path)
    assert {f for f in before if part(f) not in touched} == {f for f in after if part(f) not in touched}
    assert all(after[f] == t for f, t in before.items() if part(f) not in touched)
    got = {r.id: (r.name, r.type, r.n) for r in table.read().collect()}
    assert len(got) == 60 and got["k5"] == ("new", "city", 1) and got["k6"] == ("old", None, 1)
    assert table.overlay(found.limit(0)) == 0


def test_another_session_finds_the_table(spark, tmp_path, table):
    table.append(rows_of(spark, ["z"], n=3))
    table.drop_registration()
    again = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=16, parts=2)
    assert (again.buckets, again.parts) == (8, 4) and again.read().count() == 61
    assert again.read().where("id = 'z'").first().n == 3
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u"), SCHEMA, buckets=5, parts=2)


def test_change_that_fails_leaves_the_table(spark, table):
    before = sorted(map(tuple, table.read().collect()))
    with pytest.raises(Exception, match="oops"):
        table.rewrite(rows_of(spark, ["k1"]), lambda df: df.withColumn("name", F.raise_error(F.lit("oops"))))
    assert sorted(map(tuple, table.read().collect())) == before


def test_empty(spark, tmp_path):
    none = KeyedTable(spark, str(tmp_path / "e"), SCHEMA)
    assert none.read().count() == 0 and none.append(rows_of(spark, [])) == 0
    assert none.unseen(rows_of(spark, ["a"])).count() == 1
    none.drop_registration()
