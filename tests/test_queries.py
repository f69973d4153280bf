"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from textquarry import queries_answers, queries_api, queries_chunks, queries_search, queries_stream, queries_web  # noqa: F401 (they register their queries)
from textquarry.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    if name not in ORACLES:
        assert got.num_rows
        return
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLES[name]}")
    columns = [r[0] for r in duck.execute("DESCRIBE want").fetchall()]
    assert sorted(columns) == sorted(got.column_names)
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.execute(f"SELECT count(*) FROM (SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b})").fetchall() == [(0,)]


def test_frontier_levels_read_all_pages_of_a_url(spark, tmp_path):
    """Two pages of one URL link to different pages, and a later URL of the same key is not read: the rows are those of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, "https://s.gov/a", '<a href="/x">x</a>'), (1, "https://s.gov/a", '<a href="/y">y</a>'), (2, "https://s.gov/a", None), (3, "https://s.gov/a#z", '<a href="/z">z</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted((r.depth, r.url) for r in QUERIES["crawl_frontier_levels"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["crawl_frontier_levels"]).fetchall()) == [(0, "https://s.gov/a"), (1, "https://s.gov/x"), (1, "https://s.gov/y")]
