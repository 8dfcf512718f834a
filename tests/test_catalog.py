"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from weftline.plans import catalog


def _rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(str(v) for v in r) for r in frame[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("documents", "pages", "supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    assert _rows(catalog.QUERIES[name](spark, data).toPandas()) == _rows(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_have_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["page_fingerprints", "streamed_baseline"])
def test_references_count_as_the_sql_says(spark, tmp_path, name):
    pages = ["<title>a &amp;&amp</title><p>b", "<p>&ampx; &lt &ltx; &copy</p>", "<p>&nbsp;&#39;&eacute;x&amp;lt;</p>", "<p>a & b &&amp; &middot;&quot;</p><script>a&&b</script><a href='?a&b'>c</a>"]
    spark.createDataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert _rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == _rows(con.sql(catalog.ORACLES[name]).df())


def test_recipes_of_all_profiles_go_through_one_dealt_stage(spark, tmp_path):
    spark.range(1, 451, 1, 1).selectExpr("id as s_suppkey", "id % 25 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = catalog.QUERIES["page_recipes"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert rows.rdd.getNumPartitions() >= 3
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert _rows(rows.toPandas()) == _rows(con.sql(catalog.ORACLES["page_recipes"]).df())
