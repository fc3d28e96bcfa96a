"""Sums of products of ranks by slices: the same as by ranks of rows, and no pair is sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_strips import items, metrics, same, strips

from weftspark.operators import pairs as pr
from weftspark.operators import permute as pm
from weftspark.operators import ranks as rk
from weftspark.operators import reliability as rel
from weftspark.operators import slices as sl
from weftspark.operators import strips as st


@pytest.fixture
def unsent(monkeypatch):
    """Ranks are not exchanged, which took some ten bytes a pair."""

    def never(*_):
        raise AssertionError("pairs' values are sent")

    monkeypatch.setattr(st.Pairs, "rank", never)


def test_groups(spark, unsent, monkeypatch):
    monkeypatch.setattr(sl, "SLICE", 50_000)
    monkeypatch.setattr(sl, "WHOLE", 100_000)
    monkeypatch.setattr(sl, "BOUND", 1e-8)
    df = items(spark, (("a", 530), ("b", 90)), nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    same(st.partial_spearman(strips(df), "x", "y", ["near", "kind"]), rk.partial_spearman(rows, "subject", "x", "y", ["near", "kind"]), "subject")
    same(st.associations(strips(df), "x", ["y", "near"]), rk.associations(rows, "subject", "x", ["y", "near"]), "subject", "other")


def test_residuals(spark, unsent, monkeypatch):
    """A group in slices and one that a task ranks, with nulls and ties."""
    monkeypatch.setattr(sl, "SLICE", 50_000)
    monkeypatch.setattr(sl, "WHOLE", 100_000)
    monkeypatch.setattr(sl, "BOUND", 1e-8)
    df = items(spark, (("a", 530), ("b", 90)), nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    same(st.partial_spearman_of_residuals(strips(df), "x", "y", ["near", "kind"]), rk.partial_spearman_of_residuals(rows, "subject", "x", "y", ["near", "kind"]), "subject")


@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_agreement_of_residuals(spark, unsent, monkeypatch, whole):
    """In slices, and where a task ranks a subject, with nulls and ties."""
    monkeypatch.setattr(sl, "SLICE", 3_000)
    monkeypatch.setattr(sl, "WHOLE", whole)
    monkeypatch.setattr(sl, "BUCKETS", 256)
    df = items(spark, [(s, 110) for s in "abc"], nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    got = st.agreement_of_residuals(strips(df), "x", ["near", "kind"])
    same(got.where("kind = 'raw'").drop("kind"), rel.subject_matrix(rows, "x"), "subject_a", "subject_b")
    rest = rk.residualized(rows, "subject", ["x"], ["near", "kind"]).select("subject", "i", "j", F.round("e_x", 9).alias("e"))
    same(got.where("kind = 'residual'").drop("kind"), rel.subject_matrix(rest, "e"), "subject_a", "subject_b")


def test_places_are_packed():
    for x in (np.zeros(0, np.int64), np.array([2]), np.array([2, 255, 3]), np.array([70000, 2, 300])):
        assert sl.unplaned(sl.planed(x)).tolist() == x.tolist()


def test_subjects(spark, unsent):
    n = 30
    df = items(spark, [(s, n) for s in "abc"], nulls=True)
    rows = pr.distances(df, "subject", "k", **metrics())
    shifts = spark.createDataFrame([("a", [0, 3]), ("b", [1, 5]), ("c", [n - 1, 2])], "subject string, shifts array<long>")
    same(st.leave_one_out(strips(df), "x").drop("perm"), rel.leave_one_out(rows, "x"), "subject")
    lags = pm.by_lag(rows, df.groupBy("subject").agg(F.count("*").alias("n")), "subject", "y")
    same(st.leave_one_out(strips(df), "y", shifts), pm.rotated_leave_one_out(lags, shifts.select("subject", F.posexplode("shifts").alias("perm", "shift")), "subject"), "subject", "perm")


def test_where_the_bound_does_not_hold(spark, monkeypatch):
    monkeypatch.setattr(sl, "BOUND", -1.0)
    monkeypatch.setattr(sl, "WHOLE", 0)
    df = items(spark, (("a", 23), ("b", 12)))
    rows = pr.distances(df, "subject", "k", **metrics())
    pairs = strips(df)
    same(st.partial_spearman(pairs, "x", "y", ["near"]), rk.partial_spearman(rows, "subject", "x", "y", ["near"]), "subject")
    assert pairs.ranked == {"x", "y", "near"}


def test_slices_add_what_buckets_leave_out():
    """Few buckets, within which one value falls as the other rises."""
    import pyarrow as pa

    n = 200
    table = pa.table({"__group": ["g"] * n, "__item": list(range(n)), "m_x": np.random.default_rng(0).normal(size=n), "m_y": np.random.default_rng(1).normal(size=n)})
    view = sl.Group(table, {"x": "cityblock", "y": "cityblock"}, "g")
    work = sl.Work(lambda t: view, n, {"x": ("x", 0), "y": ("y", 0)}, [("xy", ("x", ("x", 0)), ("y", ("y", 0)))], {"x": [("xy", ("y", ("y", 0)))], "y": [("xy", ("x", ("x", 0)))]})
    notes = {(u, name, stage): [sl.unzipped(p)] for u, name, stage, p in sl.task_sample(work, table, {}, 0, 64)}
    notes |= {(u, name, stage): sl.Counts.unpacked(p) for u, name, stage, p in sl.task_counts(work, table, notes, 0, 0, 1)}
    coarse = sum(v for *_, v in sl.task_means(work, table, notes, 0, 0, 1))
    got, e = coarse, {}
    for name in "xy":
        for lo, hi in ((0, 20), (20, 1000)):
            for _, key, v in sl.task_slice(work, table, notes, 0, name, lo, hi):
                if key == "xy":
                    got += v
                else:
                    e[key] = e.get(key, 0.0) + v
    next(sl.tiles(view))
    rank = [rk.average_ranks(view.value((x, 0)), np.zeros(work.pairs, bool)) for x in "xy"]
    want = float(np.prod([r - r.mean() for r in rank], axis=0).sum()) / work.pairs**2
    assert abs(got - want) <= np.sqrt(e["= x"] * e["= y"]) and abs(got - want) < abs(coarse - want) / 3


def test_buckets_keep_the_order():
    x = np.sort(np.concatenate((np.random.default_rng(2).normal(size=5000), [-np.inf, np.inf, np.nan, 0.0, -0.0])))
    held = sl.Buckets(sl.Buckets.model(x[::7], 1 << 10))
    code = held.of(x)
    assert (np.diff(code) >= 0).all() and code[0] == 0 and code[-1] == held.size - 1 and code[-2] < held.size - 1
    low, high = held.range(100, 300)
    assert ((x >= low) & (x <= high))[(code >= 100) & (code < 300)].all()
