"""Every query with SQL gives the rows that DuckDB gives."""

import os
from collections import Counter

import duckdb
import pytest

from weftspark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(map(tuple, df.select([f"`{c}`" for c in columns]).collect()))
    want = Counter(duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({plans.ORACLES[name]})").fetchall())
    assert got == want


def test_pca_distances_match_numpy(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("label = 3").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = (u * s)[:, :16]
    want = {(rows[i]["vec_id"], rows[j]["vec_id"]): np.linalg.norm(y[i] - y[j]) for i in range(len(y)) for j in range(i + 1, len(y))}
    got = {(r["i"], r["j"]): r["d"] for r in plans.QUERIES["pca_euclidean"](spark, SF).where("label = 3").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
