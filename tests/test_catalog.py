"""Every query against its SQL."""

import math

import duckdb
import pytest

from tarn import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert got


def test_results_follow_the_files(spark, tmp_path):
    """Another folder of the same name, and changed tables, are read anew."""
    tables = ("lineitem", "orders", "customer", "nation", "embeddings", "events")
    run = lambda sf_dir, name: sorted(map(repr, catalog.QUERIES[name](spark, sf_dir).collect()))
    names = ("revenue_by_nation", "parquet_roundtrip", "array_leaf_roundtrip", "result_tree_roundtrip", "reuse_across_forms")
    for part, keep in (("a", 1), ("b", 2), ("a", 3)):
        for t in tables:
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            few = df if t in ("customer", "orders") else df.limit(10 * keep)
            few.write.mode("overwrite").parquet(f"{tmp_path}/{part}/same/{t}.parquet")
        got = {name: run(f"{tmp_path}/{part}/same", name) for name in names}
        assert len(got["parquet_roundtrip"]) == len(got["array_leaf_roundtrip"]) == 10 * keep
        assert sum(r.n for r in catalog.QUERIES["result_tree_roundtrip"](spark, f"{tmp_path}/{part}/same").collect()) == min(25, 10 * keep)
        assert sum(r.n for r in catalog.QUERIES["reuse_across_forms"](spark, f"{tmp_path}/{part}/same").collect()) == 10 * keep
        if keep > 1:
            assert got["revenue_by_nation"] != before
        before = got["revenue_by_nation"]
