"""Pairs as strips give what pairs as rows give, and send a few bytes a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.operators import pairs as pr
from weftspark.operators import permute as pm
from weftspark.operators import ranks as rk
from weftspark.operators import reliability as rel
from weftspark.operators import strips as st


def metrics():
    return {"x": ("correlation", F.col("v")), "y": ("cosine", F.col("u")), "near": ("cityblock", F.col("k")), "kind": ("hamming", F.col("k") % 3)}


def items(spark, sizes, nulls=False):
    rng = np.random.default_rng(4)
    rows = [(g, k, [0.0] * 4 if nulls and k == 3 else rng.normal(size=4).tolist(), rng.normal(size=3).tolist()) for g, n in sizes for k in range(n)]
    return spark.createDataFrame(rows, "subject string, k long, v array<double>, u array<double>")


def strips(df, block=60):
    return st.Pairs(df, "subject", "k", block, **metrics())


def same(one, other, *keys):
    one, other = ({tuple(r[k] for k in keys): r[-1] for r in df.collect()} for df in (one, other))
    assert one == {k: v if v is None else pytest.approx(v, abs=1e-9) for k, v in other.items()} and one


@pytest.mark.parametrize("block", [60])
def test_association(spark, block):
    df = items(spark, (("a", 23), ("b", 12)), nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    same(st.partial_spearman(strips(df, block), "x", "y", ["near", "kind"]), rk.partial_spearman(rows, "subject", "x", "y", ["near", "kind"]), "subject")
    same(st.partial_spearman_of_residuals(strips(df, block), "x", "y", ["near"]), rk.partial_spearman_of_residuals(rows, "subject", "x", "y", ["near"]), "subject")
    same(st.associations(strips(df, block), "x", ["y", "near"]), rk.associations(rows, "subject", "x", ["y", "near"]), "subject", "other")


def test_shifts(spark):
    sizes = {"a": 15, "b": 12}
    df = items(spark, sizes.items())
    shifts = spark.createDataFrame([("a", [1, 4, 14]), ("b", [2, 6, 11])], "subject string, shifts array<long>")
    plan = df.join(shifts, "subject").select("subject", F.col("k").alias("item"), F.posexplode("shifts").alias("perm", "s"))
    n = F.when(F.col("subject") == "a", 15).otherwise(12)
    g = rk.residualized(pr.distances(df, "subject", "k", **metrics()), "subject", ["x", "y"], ["near"])
    want = pm.null_statistics(g, plan.withColumn("source", F.pmod(F.col("item") - F.col("s"), n)), "subject", "e_x", "z_y", ["z_near"])
    got, rho = st.shifted_statistics(strips(df), shifts, "x", "y", ["near"])
    same(got, want, "subject", "perm")
    same(rho, rk.partial_spearman(g, "subject", "x", "y", ["near"]), "subject")


@pytest.mark.parametrize("n", [14])
def test_subjects(spark, n):
    df = items(spark, [(s, n) for s in "abc"], nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    pairs = strips(df, 20)
    pairs.rank("x")
    same(st.subject_matrix(pairs, "x"), rel.subject_matrix(rows, "x"), "subject_a", "subject_b")
    pairs.rank("y")
    same(st.leave_one_out(pairs, "y").drop("perm"), rel.leave_one_out(rows, "y"), "subject")
    shifts = spark.createDataFrame([("a", [0, 3]), ("b", [1, 5]), ("c", [n - 1, 2])], "subject string, shifts array<long>")
    lags = pm.by_lag(rows, df.groupBy("subject").agg(F.count("*").alias("n")), "subject", "y")
    plan = shifts.select("subject", F.posexplode("shifts").alias("perm", "shift"))
    same(st.leave_one_out(pairs, "y", shifts), pm.rotated_leave_one_out(lags, plan, "subject"), "subject", "perm")


def test_few_bytes_a_pair():
    """A row of a pair table took over 40 bytes for each shuffle."""
    x = np.sort(np.random.default_rng(1).normal(size=200_000))
    raw = st.packed(st.ordered(x))
    assert len(raw) < 6 * len(x) and (st.unpacked(raw) == st.ordered(x)).all()
    ranks = np.cumsum(np.random.default_rng(2).integers(1, 60, 200_000))
    assert len(st.packed(ranks)) < 1.5 * len(ranks)


def test_values_in_order():
    x = np.array([-np.inf, -2.0, -1e-300, 0.0, 5e-324, 1.0, np.inf, np.nan])
    assert (np.diff(st.ordered(x)) > 0).all() and st.ordered(np.array([-0.0]))[0] == 0
