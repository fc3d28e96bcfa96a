"""Sums of products of ranks by cells: the same as by ranks of rows, in bounded memory, and no pair is sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_strips import items, metrics, strips

from weftspark.operators import cells as ce
from weftspark.operators import pairs as pr
from weftspark.operators import permute as pm
from weftspark.operators import ranks as rk
from weftspark.operators import reliability as rel
from weftspark.operators import slices as sl
from weftspark.operators import strips as st

NEAR = ["near", "kind"]


@pytest.fixture
def by_cells(monkeypatch):
    """Groups of any size; few pairs have few in a cell, but those weigh more."""
    for name, value in (("OVER", 0), ("ALONE", 0), ("AGREE", 1e-3)):
        monkeypatch.setattr(ce, name, value)
    monkeypatch.setattr(sl, "WHOLE", 0)


@pytest.fixture
def unsent(monkeypatch, by_cells):
    """Neither ranks are exchanged, nor are those within buckets kept, which a task held for all pairs of its group."""

    def never(*_, **__):
        raise AssertionError("pairs' values are sent")

    monkeypatch.setattr(st.Pairs, "rank", never)
    monkeypatch.setattr(sl, "placed", never)
    monkeypatch.setattr(sl, "summed", never)


def same(one, other, *keys):
    one, other = ({tuple(r[k] for k in keys): r[-1] for r in df.collect()} for df in (one, other))
    assert one == {k: v if v is None else pytest.approx(v, abs=2e-6) for k, v in other.items()} and one


def test_groups(spark, unsent):
    df = items(spark, (("a", 230), ("b", 180)), nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    same(st.partial_spearman(strips(df), "x", "y", NEAR), rk.partial_spearman(rows, "subject", "x", "y", NEAR), "subject")
    same(st.associations(strips(df), "x", ["y", "near"]), rk.associations(rows, "subject", "x", ["y", "near"]), "subject", "other")
    same(st.partial_spearman_of_residuals(strips(df), "x", "y", NEAR), rk.partial_spearman_of_residuals(rows, "subject", "x", "y", NEAR), "subject")


def test_shifts(spark, unsent):
    df = items(spark, (("a", 150), ("b", 120)))
    shifts = spark.createDataFrame([("a", [1, 40]), ("b", [2, 60])], "subject string, shifts array<long>")
    plan = df.join(shifts, "subject").select("subject", F.col("k").alias("item"), F.posexplode("shifts").alias("perm", "s"))
    n = F.when(F.col("subject") == "a", 150).otherwise(120)
    g = rk.residualized(pr.distances(df, "subject", "k", **metrics()), "subject", ["x", "y"], ["near"])
    want = pm.null_statistics(g, plan.withColumn("source", F.pmod(F.col("item") - F.col("s"), n)), "subject", "e_x", "z_y", ["z_near"])
    same(st.shifted_statistics(strips(df), shifts, "x", "y", ["near"])[0], want, "subject", "perm")


def residual_rows(rows, target):
    return rk.residualized(rows, "subject", [target], NEAR).select("subject", "i", "j", F.round(f"e_{target}", 9).alias("e"))


def test_subjects(spark, unsent):
    """Distances and residuals, as they are and with shifts, against the mean of the others'."""
    n = 130
    df = items(spark, [(s, n) for s in "abc"], nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    shifts = spark.createDataFrame([("a", [0, 3]), ("b", [1, 50]), ("c", [n - 1, 2])], "subject string, shifts array<long>")
    plan = shifts.select("subject", F.posexplode("shifts").alias("perm", "shift"))
    sizes = df.groupBy("subject").agg(F.count("*").alias("n"))
    same(st.leave_one_out(strips(df), "x").drop("perm"), rel.leave_one_out(rows, "x"), "subject")
    same(st.leave_one_out(strips(df), "y", shifts), pm.rotated_leave_one_out(pm.by_lag(rows, sizes, "subject", "y"), plan, "subject"), "subject", "perm")
    pairs = strips(df)
    st.residual(pairs, "e", "y", NEAR, 9)
    rest = residual_rows(rows, "y")
    same(st.leave_one_out(pairs, "e").drop("perm"), rel.leave_one_out(rest, "e"), "subject")
    same(st.leave_one_out(pairs, "e", shifts), pm.rotated_leave_one_out(pm.by_lag(rest, sizes, "subject", "e"), plan, "subject"), "subject", "perm")


def test_matrices(spark, unsent):
    df = items(spark, [(s, 130) for s in "abc"], nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    same(st.agreement(strips(df), "x"), rel.subject_matrix(rows, "x"), "subject_a", "subject_b")
    got = st.agreement_of_residuals(strips(df), "x", NEAR)
    same(got.where("kind = 'raw'").drop("kind"), rel.subject_matrix(rows, "x"), "subject_a", "subject_b")
    same(got.where("kind = 'residual'").drop("kind"), rel.subject_matrix(residual_rows(rows, "x"), "e"), "subject_a", "subject_b")


def test_where_wide_cells_differ(spark, by_cells, monkeypatch):
    """Ranks are exchanged."""
    monkeypatch.setattr(ce, "AGREE", -1.0)
    df = items(spark, [(s, 14) for s in "abc"])
    rows = pr.distances(df, "subject", "k", **metrics())
    pairs = strips(df, 20)
    same(st.agreement(pairs, "x"), rel.subject_matrix(rows, "x"), "subject_a", "subject_b")
    assert pairs.ranked == {"x"}
    st.residual(pairs, "e", "x", ["near"], 9)
    rest = rk.residualized(rows, "subject", ["x"], ["near"]).select("subject", "i", "j", F.round("e_x", 9).alias("e"))
    same(st.leave_one_out(pairs, "e").drop("perm"), rel.leave_one_out(rest, "e"), "subject")
    assert pairs.ranked == {"x", "near", "e"}


def test_ranks_by_cells():
    """Ranks by cells keep ties and order, and their means are those of the exact ranks."""
    x = np.round(np.random.default_rng(3).normal(size=50_000), 3)
    held = sl.Buckets(sl.Buckets.model(x[::5], 1 << 12))
    code = held.of(x)
    rank = sl.means(np.bincount(code, minlength=held.size))[code]
    exact = (rk.average_ranks(x, np.zeros(len(x), bool)) - (len(x) + 1) / 2) / len(x)
    most = np.bincount(code).max() / len(x)
    assert np.abs(rank - exact).max() <= most and abs(rank.sum()) < 1e-9
    order = np.argsort(x, kind="stable")
    assert (np.diff(rank[order]) >= 0).all() and all(len(np.unique(rank[x == v])) == 1 for v in np.unique(x)[::50])


def test_shifts_of_all_subjects_alike_are_taken_once():
    by, alike = st.relative({"a": [0, 3, 9], "b": [1, 4, 1]}, 10)
    assert by == {"a": [0, 0], "b": [1, 2]} and alike == [[0, 1], [2]]


def test_items_are_sent_for_few_tiles(spark):
    """A group of 13 blocks has 8 tiles, and its pairs are those of one tile."""
    df = items(spark, (("a", 50), ("b", 3)), nulls=True)
    got, want = ({(r["subject"], r["i"], r["j"]): (r["x"], r["kind"]) for r in pr.distances(df, "subject", "k", tile, x=("correlation", F.col("v")), kind=("hamming", F.col("k") % 3)).collect()} for tile in (4, 512))
    assert got.keys() == want.keys() and len(got) == 50 * 49 // 2 + 3 and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in got)
    assert {r["__parts"] for r in pr.sided(df, "subject", 4).collect()} == {8, 1}
