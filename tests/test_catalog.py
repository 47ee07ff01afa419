import duckdb
import pytest
from lodestone.plans import catalog
from util import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert_same(df, catalog.ORACLE_SQL[name], SF)
    else:
        assert df.count() > 0


def test_plans_prune_columns_and_push_filters(spark):
    df = catalog.QUERIES["bm25_topk"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan
    assert "WindowGroupLimit" in plan


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_symbol_with_more_chunks_than_the_limit_equals_its_sql(spark, tmp_path):
    # 700 documents of src7, of which 233 have the symbol: the first 200 by point id are listed, as by list_files
    spark.range(20 * 700).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "concat('src', id % 20) AS source", "8L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["symbol_lookup"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["symbol_lookup"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 200
