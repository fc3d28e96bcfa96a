"""The whole association plan against numpy, permutation by permutation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.functions import columns as f
from weftspark.operators import checks
from weftspark.operators import permute as pm
from weftspark.plans import geometry

SUBJECTS, ROWS, CHANNELS = ["s1", "s2", "s3"], 14, 5


def frames(spark):
    rng = np.random.default_rng(3)
    words = ["ab，cd", "a!", "bcd。", "", "hello there", "cd,ab?", "x"]
    text = [words[i % 7] + chr(97 + i) * (i % 4) for i in range(ROWS)]
    chapter = ["CH01"] * 6 + ["CH02"] * 7 + ["CH03"]
    x = rng.normal(size=(3, ROWS, CHANNELS))
    rows = [(s, i, i + 2, x[k, i].tolist(), text[i], chapter[i], float(1 + i * i % 5), i / 20) for k, s in enumerate(SUBJECTS) for i in range(ROWS)]
    features = spark.createDataFrame(rows, "subject string, row int, embedding_index int, row_mean array<double>, text string, chapter string, duration double, position double")
    v = rng.normal(size=(ROWS + 2, 4))
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "row_index int, last array<double>")
    return features, vectors, x, v[2:], text, chapter


def ranks(v):
    order = np.argsort(v, kind="stable")
    r = np.empty(len(v))
    r[order] = np.arange(1, len(v) + 1)
    for u in np.unique(v):
        r[v == u] = r[v == u].mean()
    return (r - r.mean()) / r.std()


def rest(y, nuisances):
    a = np.column_stack([np.ones(len(y)), *nuisances])
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    return (e - e.mean()) / e.std()


def test_association(spark):
    features, vectors, x, v, text, chapter = frames(spark)
    got = geometry.semantic_association(features, vectors, ["last"], 100, 7)
    i, j = np.triu_indices(ROWS, 1)
    marks = set(f.ASCII_MARKS + f.CJK_MARKS)
    number = np.array([int(c[2:]) for c in chapter])
    jaccard = [1 - len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0 for a, b in zip([text[k] for k in i], [text[k] for k in j])]
    values = [np.arange(ROWS) / 20, np.array([1 + k * k % 5 for k in range(ROWS)]), np.array([len(t) for t in text]), None, None, np.array([sum(c in marks for c in t) for t in text])]
    nuisances = [ranks(d) for d in (*(abs(u[i] - u[j]) for u in values[:3]), (number[i] != number[j]).astype(float), np.round(jaccard, 12), abs(values[5][i] - values[5][j]))]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    semantic = 1 - (unit @ unit.T)
    neural = []
    for k in range(3):
        z = (x[k] - x[k].mean(0)) / x[k].std(0)
        neural.append(rest(ranks(1 - np.corrcoef(z)[i, j]), nuisances))
    stat = lambda square: np.mean([np.mean(e * rest(ranks(square[i, j]), nuisances)) for e in neural])
    one = got.summary.first()
    assert one["observed"] == pytest.approx(stat(semantic), abs=1e-6) and one["n"] == 100
    plan = {(r["perm"], r["grp"]): r["shift"] for r in pm.seeded_plan(spark.createDataFrame([(1, 6), (2, 7), (3, 1)], "grp int, n long"), 100, 7).collect()}
    want = []
    for p in range(100):
        source = np.arange(ROWS)
        for g in (1, 2):
            at = np.flatnonzero(number == g)
            source[at] = np.roll(at, plan[p, g])
        want.append(stat(semantic[source][:, source]))
    null = [r["stat"] for r in got.null.orderBy("perm").collect()]
    assert np.allclose(null, want, atol=1e-6)
    assert one["p"] == pytest.approx((1 + sum(w >= stat(semantic) for w in want)) / 101)


def test_variants(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, rng.normal(size=6).tolist(), rng.random(6).tolist(), rng.normal(size=(3, 6)).tolist()) for s in SUBJECTS for i in range(12)]
    df = spark.createDataFrame(rows, "subject string, row int, row_mean array<double>, row_std array<double>, relative array<array<double>>")
    got = geometry.variants(df, (4,))
    assert {r["variant"]: r["count"] for r in got.groupBy("variant").count().collect()} == {v: 3 * 66 for v in ("flat_correlation", "row_mean_correlation", "row_std_correlation", "binwise_correlation_mean", "pca4_euclidean")}
    assert got.where("d is null or d < 0").count() == 0
    assert sorted(r["place"] for r in geometry.ranked_variants(got).collect()) == [1, 2, 3, 4, 5]


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.5, [1.0, float("nan")]), (7, float("inf"), [1.0])], "run int, x double, v array<double>")
    for bad in (lambda: checks.finite(df, "x"), lambda: checks.finite(df, "v"), lambda: checks.open_runs(df), lambda: checks.at_least(df, "run", 3), lambda: checks.parameters(runs=[1, 1]), lambda: checks.parameters(permutations=5), lambda: checks.parameters(draws=50), lambda: checks.nulls(df, ["run"], "x"), lambda: checks.same_mean(df.withColumn("y", F.col("x") + 1), "x", "y"), lambda: checks.all_found(df, df.where("run = 1").select(F.col("run").alias("k")), "run", "k")):
        with pytest.raises(ValueError):
            bad()
    assert checks.finite(df.where("run = 1"), "x").count() == 1
