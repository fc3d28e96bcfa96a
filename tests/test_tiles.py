"""Tiled pairs, permutations and principal components, rotated lags, and sign flips met in the middle, against numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.operators import inference as inf
from weftspark.operators import pairs as pr
from weftspark.operators import permute as pm
from weftspark.operators import ranks as rk
from weftspark.operators import reliability as rel


def table(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("a", "b", None):
        for i in range(n if g == "a" else 9):
            v = [0.0, 0.0, 0.0, 0.0] if i == 3 else None if i == 4 else rng.normal(size=4).tolist()
            if i == 5:
                v = v[:3]
            rows.append((g, None if i == 8 else i, v, None if i == 6 else float(rng.integers(0, 9)), rng.choice(["x", "y", ""]) if i != 7 else None, "".join(rng.choice(list("abcé漢\U0001F600"), rng.integers(0, 5)))))
    return spark.createDataFrame(rows, "g string, k long, v array<double>, x double, c string, t string"), rows


@pytest.mark.parametrize("tile", [7, 512])
def test_distances_in_tiles(spark, tile):
    df, rows = table(spark)
    got = pr.distances(df, "g", "k", tile, n=("correlation", F.col("v")), part=("cosine", F.col("v")), rank=("euclidean", F.col("v")), x=("cityblock", F.col("x")), c=("hamming", F.col("c")), t=("jaccard", F.col("t"))).collect()
    by = {(g, k): r for r in rows for g, k in [r[:2]] if g and k is not None}
    assert sorted((r["g"], r["i"], r["j"]) for r in got) == sorted((g, i, j) for (g, i), (h, j) in itertools.product(by, by) if g == h and i < j)

    def angle(a, b):
        a, b = np.array(a), np.array(b)
        return None if not a.any() or not b.any() else 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    for r in got:
        _, _, va, xa, ca, ta = by[r["g"], r["i"]]
        _, _, vb, xb, cb, tb = by[r["g"], r["j"]]
        alike = va is not None and vb is not None and len(va) == len(vb)
        want = [angle(np.array(va) - np.mean(va), np.array(vb) - np.mean(vb)) if alike else None, angle(va, vb) if alike else None, math.dist(va, vb) if alike else None]
        want += [None if xa is None or xb is None else abs(xa - xb), None if ca is None or cb is None else float(ca != cb), 1 - len({*ta} & {*tb}) / len({*ta} | {*tb}) if ta or tb else 0.0]
        assert [None if x is None else pytest.approx(x, abs=1e-12) for x in want] == [r[x] for x in ("n", "part", "rank", "x", "c", "t")]


def test_no_task_holds_over_two_tiles(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.rand(1).alias("x"))
    ready = pr.parted(df, "g", 10)
    assert ready.agg(F.max("__parts")).first()[0] == 10
    assert pr.distances(df, "g", "k", 10, x=("cityblock", F.col("x"))).count() == 4950


def test_bins_in_tiles(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3, 5))
    df = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(20)], "g int, k int, v array<array<double>>")
    for r in pr.distances(df, "g", "k", 6, d=("binwise", F.col("v"))).collect():
        assert r["d"] == pytest.approx(np.mean([1 - np.corrcoef(x[r["i"], b], x[r["j"], b])[0, 1] for b in range(3)]))


@pytest.mark.parametrize("tile, parts", [(8, 1), (512, 7)])
def test_principal_distances(spark, tile, parts):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 60, 6)) @ rng.normal(size=(6, 6)) + 1e4
    x[:, :, 5] = 2.0
    df = spark.createDataFrame([(g, i, x[g, i].tolist()) for g in range(2) for i in range(60)], "g int, k long, v array<double>").repartition(parts)
    got = {(r["g"], r["i"], r["j"]): r["d"] for r in pr.principal_distances(df, "g", "k", "v", 3, tile).collect()}
    for g in range(2):
        sd = x[g].std(0)
        z = (x[g] - x[g].mean(0)) / np.where(sd == 0, 1, sd)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        y = (u * s)[:, :3]
        assert all(got[g, i, j] == pytest.approx(np.linalg.norm(y[i] - y[j]), abs=1e-7) for i, j in itertools.combinations(range(60), 2))
    with pytest.raises(Exception, match="too many components"):
        pr.principal_distances(df, "g", "k", "v", 7).collect()


def square(n, rng):
    m = rng.normal(size=(n, n))
    return m + m.T


@pytest.mark.parametrize("tile, chunk", [(4, 3), (5, 100), (512, 512)])
def test_permuted_pairs_in_tiles(spark, tile, chunk):
    """Any permutation, not shifts alone; groups of unlike size."""
    rng = np.random.default_rng(8)
    pairs, plan, want = [], [], {}
    for g, n in (("a", 17), ("b", 5)):
        i, j = np.triu_indices(n, 1)
        y, m = square(n, rng), [square(n, rng) for _ in range(2)]
        scores = lambda x: (x - x.mean()) / x.std()
        z, other = scores(y[i, j]), np.array([scores(x[i, j]) for x in m])
        e = scores(rng.normal(size=len(i)))
        e = scores(e - np.linalg.pinv(other.T) @ e @ other)
        pairs += [(g, int(a), int(b), float(p), float(q), *map(float, r)) for a, b, p, q, r in zip(i, j, e, z, other.T)]
        full = np.zeros((n, n))
        full[i, j] = full[j, i] = z
        for p in range(7):
            s = rng.permutation(n)
            plan += [(g, p, k, int(s[k])) for k in range(n)]
            moved = full[s[i], s[j]]
            left = moved - np.linalg.pinv(other.T) @ moved @ other
            want[g, p] = np.mean(e * left) / left.std() if abs(left.mean()) < 1e-9 else None
    df = spark.createDataFrame(pairs, "g string, i int, j int, e double, y double, n0 double, n1 double")
    moves = spark.createDataFrame(plan, "g string, perm int, item int, source int")
    got = {(r["g"], r["perm"]): r["stat"] for r in pm.null_statistics(df, moves, "g", "e", "y", ["n0", "n1"], tile, chunk).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def spearman(a, b):
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    return np.corrcoef(rank(a), rank(b))[0, 1]


@pytest.mark.parametrize("n", [6, 7, 2])
def test_rotated_lags(spark, n):
    rng = np.random.default_rng(n)
    d = {s: square(n, rng) for s in "abc"}
    i, j = np.triu_indices(n, 1)
    pairs = spark.createDataFrame([(s, int(a), int(b), float(m[a, b])) for s, m in d.items() for a, b in zip(i, j)], "subject string, i int, j int, d double")
    items = spark.createDataFrame([(s, n) for s in "abc"], "subject string, n int")
    shifts = {(p, s): int(rng.integers(0, n)) for p in range(4) for s in "abc"}
    plan = spark.createDataFrame([(p, s, x) for (p, s), x in shifts.items()], "perm int, subject string, shift int")
    lags = pm.by_lag(pairs, items, "subject", "d")
    if n == 2:
        assert [r["v"] for r in lags.where("subject = 'a'").collect()] == [[d["a"][0, 1]]]
        return
    got = {(r["perm"], r["subject"]): r["rho"] for r in pm.rotated_leave_one_out(lags, plan, "subject").collect()}
    for p in range(4):
        moved = {}
        for s, m in d.items():
            source = np.roll(np.arange(n), shifts[p, s])
            moved[s] = m[source][:, source][i, j]
        for s in "abc":
            assert got[p, s] == pytest.approx(spearman(moved[s], np.mean([moved[t] for t in "abc" if t != s], axis=0)))
    with pytest.raises(Exception, match="pair is missing"):
        pm.by_lag(pairs.where("i > 0"), items, "subject", "d").collect()


def test_subject_matrix_with_missing_pairs(spark):
    rng = random.Random(6)
    d = {(s, i, j): float(rng.randint(0, 30)) for s in "abcd" for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in d.items()], "subject string, i int, j int, d double").repartition(5)
    got = {(r["subject_a"], r["subject_b"]): r["rho"] for r in rel.subject_matrix(df).collect()}
    rank = {}
    for s in "abcd":
        own = np.array([v for k, v in d.items() if k[0] == s])
        rank |= {k: (own < v).sum() + ((own == v).sum() + 1) / 2 for k, v in d.items() if k[0] == s}
    for a, b in itertools.combinations("abcd", 2):
        both = [(rank[a, i, j], rank[b, i, j]) for i in range(12) for j in range(12) if (a, i, j) in d and (b, i, j) in d]
        assert got[a, b] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])


def test_sign_flips_met_in_the_middle(spark):
    rng = random.Random(2)
    rows = [("few", rng.gauss(0.3, 1)) for _ in range(9)] + [("ties", rng.choice([-1.0, 1.0, 2.0])) for _ in range(12)] + [("zero", 0.0)] * 7
    df = spark.createDataFrame(rows, "k string, v double")
    one, two = ({r["k"]: (r["n"], r["mean"], r["p"]) for r in inf.signflip(df, "k", "v", few).collect()} for few in (20, 3))
    assert one == two and one["zero"][2] == 1.0


def test_forty_sign_flips(spark):
    """Whole numbers: the number of patterns by their sums is known from a convolution."""
    rng = random.Random(4)
    v = [rng.randint(1, 9) * rng.choice([1, 1, -1]) for _ in range(40)]
    ways = {0: 1}
    for x in v:
        new = {}
        for s, n in ways.items():
            for y in (s + x, s - x):
                new[y] = new.get(y, 0) + n
        ways = new
    got = inf.signflip(spark.createDataFrame([("k", float(x)) for x in v], "k string, v double"), "k", "v").first()
    assert got["n"] == 40 and got["p"] == sum(n for s, n in ways.items() if s >= sum(v)) / 2**40


def test_large_and_small_groups_are_ranked_alike(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, i, *(None if rng.random() < 0.1 else float(rng.randint(0, 9)) for _ in range(2)), rng.random(), rng.random()) for g in ("a", "b", None) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double, u double, v double")
    steps = [lambda: rk.ranked_wide(df, "g", "x", "y"), lambda: rk.residualized(df, "g", ["u", "v"], ["x", "y"]), lambda: rk.rank_z(df, "g", "u", "x"), lambda: rk.numbered(df, "g", "at", "k")]
    plain = lambda f: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f().select(sorted(f().columns)).collect()], key=str)
    one = [plain(f) for f in steps]
    monkeypatch.setattr(rk, "SMALL", 3)
    assert [plain(f) for f in steps] == one


def test_ten_thousand_permutations(spark):
    """As many draws as a run's own report has, against numpy."""
    rng, n, draws = np.random.default_rng(11), 11, 10_000
    i, j = np.triu_indices(n, 1)
    scores = lambda x: (x - x.mean()) / x.std()
    y = square(n, rng)
    z, other = scores(y[i, j]), scores(square(n, rng)[i, j])
    e = scores(rng.normal(size=len(i)))
    e = scores(e - (e @ other) / (other @ other) * other)
    df = spark.createDataFrame([("g", int(a), int(b), float(p), float(q), float(r)) for a, b, p, q, r in zip(i, j, e, z, other)], "g string, i int, j int, e double, y double, n0 double")
    items = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("item")).withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    plan = items.withColumn("source", F.pmod(F.col("item") - pm.seeded_shift(5, F.col("perm"), F.lit(0), F.lit(n), identity=True), F.lit(n)))
    got = {r["perm"]: r["stat"] for r in pm.null_statistics(df, plan, "g", "e", "y", ["n0"]).collect()}
    full = np.zeros((n, n))
    full[i, j] = full[j, i] = z
    by_shift = []
    for s in range(n):
        source = (np.arange(n) - s) % n
        moved = full[source][:, source][i, j]
        left = moved - (moved @ other) / (other @ other) * other
        by_shift.append(np.mean(e * left) / np.sqrt(np.mean(left * left)))
    shifts = {r["perm"]: r["s"] for r in plan.where("item = 0").select("perm", F.pmod(-F.col("source"), F.lit(n)).alias("s")).collect()}
    assert len(got) == draws and all(abs(got[p] - by_shift[shifts[p]]) < 1e-9 for p in got)
    nulls = spark.createDataFrame([("t", v) for v in got.values()], "t string, stat double")
    one = pm.null_summary(nulls, spark.createDataFrame([("t", float(by_shift[3]))], "t string, observed double"), "t").first()
    least, most = ((1 + sum(v >= by_shift[3] + gap for v in got.values())) / (draws + 1) for gap in (1e-9, -1e-9))
    assert one["n"] == draws and least <= one["p"] <= most


def test_hundred_thousand_draws(spark):
    rng = random.Random(9)
    v = {(r, p): rng.gauss(0, 1) for r in range(3) for p in range(1000)}
    nulls = spark.createDataFrame([(r, p, x) for (r, p), x in v.items()], "run long, perm long, stat double")
    got = {r["draw"]: r["mean"] for r in inf.crossrun_null(nulls, 100_000, pm.seeded_shift(4, F.col("draw"), F.col("run"), F.col("n"), identity=True)).collect()}
    assert len(got) == 100_000
    spread = np.std(list(got.values()))
    assert abs(np.mean(list(got.values())) - np.mean([np.mean([v[r, p] for p in range(1000)]) for r in range(3)])) < 0.01 and 0.5 < spread < 0.65


@pytest.mark.parametrize("tile, parts", [(3, 6), (4096, 1)])
def test_standard_scores_in_parts(spark, tile, parts):
    """Nulls, unlike sizes, constants and large means, place by place."""
    rng = random.Random(5)
    rows = [(g, i, [7.0, rng.gauss(1e6, 1), None if rng.random() < 0.2 else rng.random()][: 2 if i == 4 else 3]) for g in "ab" for i in range(12)] + [("a", 99, None), (None, 1, [1.0]), ("c", 0, [])]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>").repartition(parts)
    got = {(r["g"], r["k"]): r["v"] for r in pr.zscored_vectors(df, "g", "k", "v", tile).collect()}
    want = {}
    for g in "ab":
        at = [[v[k] for h, _, v in rows if h == g and v is not None and len(v) > k and v[k] is not None] for k in range(3)]
        mean, sd = [np.mean(x) for x in at], [np.std(x) or 1.0 for x in at]
        want |= {(g, i): [None if x is None else pytest.approx((x - mean[k]) / sd[k], abs=1e-6) for k, x in enumerate(v)] for h, i, v in rows if h == g and v is not None}
    assert got == want | {("c", 0): []}


def test_cells_are_not_put_together(spark):
    """Spark joins partitions by what they read, which was one task for all pairs of a small table."""
    items = spark.createDataFrame([("g", k, float(k)) for k in range(300)], "g string, k long, x double")
    assert pr.distances(items, "g", "k", 16, d=("cityblock", F.col("x"))).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
