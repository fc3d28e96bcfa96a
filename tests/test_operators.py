"""Small cases with known results."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftspark.functions import columns as f
from weftspark.operators import events as ev
from weftspark.operators import inference as inf
from weftspark.operators import pairs as pr
from weftspark.operators import permute as pm
from weftspark.operators import pooling as po
from weftspark.operators import profile as pf
from weftspark.operators import ranks as rk
from weftspark.operators import reliability as rel
from weftspark.operators import segments as sg


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def stream(spark):
    rows = [("CH01", 0.0), ("ROWS", 2.0), ("ROWE", 3.0), ("ROWE", 4.0), ("ROWS", 5.0), ("ROWS", 6.0), ("ROWE", 7.0), ("CH02", 7.5), ("ROWS", 8.0)]
    df = spark.createDataFrame([("s", i, k, t) for i, (k, t) in enumerate(rows)], "stream string, i long, kind string, t double")
    return ev.with_context(df, "stream", "i", F.when(F.col("kind").startswith("CH"), F.col("kind")), "chapter")


def test_pairing_and_malformed(spark):
    args = (stream(spark), "stream", "i", "kind", "ROWS", "ROWE", "t")
    got = ev.segments(*args, "chapter").orderBy("segment").collect()
    assert [(r["start_time"], r["end_time"], r["chapter"]) for r in got] == [(2.0, 3.0, "CH01"), (6.0, 7.0, "CH01")]
    bad = ev.malformed(*args)
    assert sorted(r["problem"] for r in bad.collect()) == ["end_without_start", "start_before_previous_end", "unclosed_start"]
    with pytest.raises(ValueError, match="malformed"):
        ev.strict(bad)


def test_anchor(spark):
    df = spark.createDataFrame([("s", 0, "x"), ("s", 1, " go "), ("s", 2, "y"), ("t", 0, "x")], "stream string, i long, kind string")
    assert [(r["stream"], r["i"]) for r in ev.after_anchor(df, "stream", "i", F.trim("kind") == "go").orderBy("i").collect()] == [("s", 1), ("s", 2)]


def test_numeric_chapters(spark):
    df = spark.createDataFrame([(0, "1", "int"), (1, "2", "str"), (2, "3.0", "float"), (3, "true", "bool"), (4, "a1", "str"), (5, " 4 ", "str"), (6, "3.5", "float"), (7, None, "str")], "k int, v string, t string")
    got = {r["k"]: r["c"] for r in df.select("k", ev.numeric_chapter(F.col("v"), F.col("t")).alias("c")).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: None, 4: None, 5: 4, 6: None, 7: None}


@pytest.mark.parametrize("n, bins, edges", [(12, 8, [0, 2, 3, 4, 6, 8, 9, 10, 12]), (4, 8, [0, 0, 1, 2, 2, 2, 3, 4, 4])])
def test_bin_edges(spark, n, bins, edges):
    spans = spark.createDataFrame([("s", 0, 0, n)], "stream string, segment long, start long, stop long")
    got = sg.bin_edges(spans, bins).orderBy("bin").collect()
    assert [r["lo"] for r in got] == edges[:-1]
    assert [r["hi"] for r in got] == [max(b, min(n, a + 1)) if b <= a else b for a, b in zip(edges, edges[1:])]
    assert sg.empty_bins(spans, bins).count() == (1 if n == 4 else 0)


def test_segment_features(spark):
    signal = spark.createDataFrame([("s", i, 0, float(i)) for i in range(600)], "stream string, sample long, channel int, value double")
    spans = spark.createDataFrame([("s", 0, 250, 262), ("s", 1, 300, 302), ("s", 2, 5, 5)], "stream string, segment long, start long, stop long")
    got = {r["segment"]: r for r in sg.mean_std(signal, spans, "stream").collect()}
    assert got[0]["n"] == 12 and got[0]["mean"] == 255.5 and math.isclose(got[0]["sd"], math.sqrt(143 / 12)) and 2 not in got
    on = {r["segment"]: r for r in sg.onset_mean(signal, spans, "stream", 4).collect()}
    assert on[0]["mean"] == 251.5 and math.isnan(on[1]["mean"]) and not on[1]["available"]


def test_scan_refuses_what_a_mean_would_hide(spark):
    signal = spark.createDataFrame([("s", i, 0, float("nan") if i == 90 else float(i)) for i in range(100)], "stream string, sample long, channel int, value double")
    spans = lambda *rows: sg.sampled(spark.createDataFrame([("s", k, a, b, 100) for k, (a, b) in enumerate(rows)], "stream string, segment long, start_sec double, end_sec double, n long"), 10.0, "n")
    got = {r["segment"]: r for r in sg.scan(signal, spans((0.04, 1.0), (9.2, 12.0), (0.5, 0.7)), "stream", 2, 3).collect()}
    assert (got[0]["n"], got[0]["mean"], got[0]["clipped"], got[0]["bin_means"], got[0]["onset_mean"]) == (10, 4.5, False, [2.0, 7.0], 1.0)
    assert (got[1]["n"], got[1]["clipped"]) == (8, True) and math.isnan(got[2]["onset_mean"])
    with pytest.raises(Exception, match="without a sample"):
        sg.scan(signal, spans((0.0, 1.0), (11.0, 12.0)), "stream", 2, 3).collect()
    with pytest.raises(Exception, match="not a finite value at sample 90"):
        sg.scan(signal, spans((8.9, 9.5)), "stream", 2, 3).collect()


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (3, 1, 2, 2, 5, 5, 5)], "g string, v double")
    for fn in (rk.ranked, lambda *a: rk.ranked_wide(*a, parts=3)):
        assert sorted((r["v"], r["r_v"]) for r in fn(df, "g", "v").collect()) == [(1, 1), (2, 2.5), (2, 2.5), (3, 4), (5, 6), (5, 6), (5, 6)]


def test_constant_is_refused(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 2.0)], "g string, v double, w double")
    with pytest.raises(Exception, match="constant"):
        rk.rank_z(df, "g", "v").collect()


def test_residuals_with_dependent_nuisances(spark):
    rng = random.Random(2)
    rows = [("g", rng.random(), rng.random(), a := rng.random(), a) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, y double, n double, m double")
    got = rk.residualized(df, "g", ["x"], ["n", "m"]).agg(F.sum(F.col("e_x") * F.col("z_n")).alias("a"), F.avg("e_x").alias("b"), F.stddev_pop("e_x").alias("c")).first()
    assert abs(got["a"]) < 1e-9 and abs(got["b"]) < 1e-9 and abs(got["c"] - 1) < 1e-9


@pytest.mark.parametrize("a, b, want", [("ab", "bc", 2 / 3), ("", "", 0.0), ("", "a", 1.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, f.jaccard_distance(f.characters(F.lit(a)), f.characters(F.lit(b)))) == pytest.approx(want)


def test_texts_and_flags(spark):
    assert one(spark, f.punctuation_count(F.lit("a，b!c。"))) == 3
    assert one(spark, f.as_flag(F.lit(" Yes "))) and not one(spark, f.as_flag(F.lit("2"))) and one(spark, f.as_flag(F.lit(None).cast("string"))) is False
    assert [one(spark, f.sample_index(F.lit(x), 1.0, 9)) for x in (0.5, 1.5, 2.5, 99.0, -3.0)] == [0, 2, 2, 9, 0]
    assert one(spark, f.chapter_number(F.lit("CH07"))) == 7 and one(spark, f.chapter_number(F.lit(None).cast("string"))) == 0
    assert one(spark, f.whole_number_text(F.lit(" １２ "))) and not one(spark, f.whole_number_text(F.lit("1a")))


def test_constant_column_and_zero_vector(spark):
    df = spark.createDataFrame([("g", 0, [1.0, 1.0]), ("g", 1, [1.0, 3.0])], "g string, i int, v array<double>")
    assert sorted((r["i"], r["dim"], r["z"]) for r in pr.zscored(df, "g", "i", "v").collect()) == [(0, 0, 0), (0, 1, -1), (1, 0, 0), (1, 1, 1)]
    zero = spark.createDataFrame([("g", 0, [0.0, 0.0]), ("g", 1, [1.0, 3.0])], "g string, i int, v array<double>")
    assert pr.distances(zero, "g", "i", d=("cosine", F.col("v"))).first()["d"] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "label int, vec_id long, embedding array<double>")
    assert pr.distances(empty, "label", "vec_id", d=("correlation", F.col("embedding"))).count() == 0
    assert rk.ranked_wide(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_roll(spark):
    df = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 7)], "g string, i int")
    got = pm.shifted(df, ["g"], "i", F.lit(2)).orderBy("g", "i").collect()
    assert [r["source"] for r in got] == [3, 4, 0, 1, 2, 7]


def test_p_value(spark):
    nulls = spark.createDataFrame([("t", float(i)) for i in range(999)], "t string, stat double")
    observed = spark.createDataFrame([("t", 990.0)], "t string, observed double")
    got = pm.null_summary(nulls, observed, "t").first()
    assert got["p"] == pytest.approx(0.01) and got["percentile"] == pytest.approx(990 / 999)


def test_seeded_plan(spark):
    """Groups of one row don't draw; a plan is the same however it is dealt, and its draws are even."""
    sizes = spark.createDataFrame([(0, 3), (1, 1), (2, 5)], "grp int, n long")
    plan = lambda parts, seed=20: sorted(map(tuple, pm.seeded_plan(sizes.repartition(parts), 400, seed).collect()))
    got = plan(1)
    assert {g for _, g, _ in got} == {0, 2} and all(1 <= s < (3 if g == 0 else 5) for _, g, s in got) and len(got) == 800
    assert got == plan(8) and got != plan(8, 21)
    assert all(60 < sum(s == k for _, g, s in got if g == 2) < 140 for k in range(1, 5))


@pytest.mark.parametrize("values, p", [((0.0057, 0.0034, 0.0145, 0.0045, 0.0174, 0.0056), 0.015625), ((1.0, 2.0, 3.0, 4.0), 0.0625)])
def test_sign_flips(spark, values, p):
    df = spark.createDataFrame([("t", v) for v in values], "t string, v double")
    assert inf.signflip(df, "t", "v").first()["p"] == p


def test_influence_of_an_absent_subject(spark):
    df = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 3.0), ("2", "a", 2.0)], "run string, subject string, effect double")
    got = {r["subject"]: r for r in inf.influence(df).collect()}
    assert got["b"]["mean_without"] == 1.5 and got["b"]["runs_present"] == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-5, 5, allow_nan=False), min_size=1, max_size=7))
def test_sign_flip_bounds(spark, values):
    p = inf.signflip(spark.createDataFrame([("t", v) for v in values], "t string, v double"), "t", "v").first()["p"]
    assert 2.0 ** -len(values) <= p <= 1


def test_pooling(spark):
    rows = [("a", 0, [1.0, 2.0], False, True), ("a", 1, [3.0, 4.0], True, False), ("a", 2, [5.0, 8.0], True, False), ("a", 3, [9.0, 9.0], False, False), ("b", 0, [7.0, 7.0], False, True)]
    df = spark.createDataFrame(rows, "row string, token int, h array<double>, attended boolean, special boolean")
    got = {r["row"]: r["vector"] for r in po.masked_mean(df, "row", "h", F.col("attended") & ~F.col("special")).collect()}
    assert got == {"a": [4.0, 6.0], "b": [0.0, 0.0]}
    assert [r["vector"] for r in po.last_token(df, "row", "token", "h", F.col("attended")).collect()] == [[5.0, 8.0]]


def test_encoder_is_pluggable(spark):
    import numpy as np

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [list(r["vector"]) for r in po.embedded(df, F.col("t"), lambda: lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32), "q: ").collect()]
    assert sorted(got) == [[3.0, 1.0], [5.0, 1.0]]


def test_profile(spark):
    df = spark.createDataFrame(list(enumerate(["x", "n/a", "", "x", "NA", "y"])), "i int, v string")
    got = pf.profile(df, "v", "i").first()
    assert (got["n_nonmissing"], got["n_unique"], [(t["value"], t["n"]) for t in got["top_values"]]) == (3, 2, [("x", 2), ("y", 1)])


def test_latest_prefers_scoped(spark):
    df = spark.createDataFrame([("r1", "old", "2", 1), ("r1", "scoped", "1", 0), ("r2", "old", "5", 1)], "run string, name string, stamp string, rank int")
    assert {r["run"]: r["name"] for r in pf.latest(df, "run", "stamp", "name", F.col("rank")).collect()} == {"r1": "scoped", "r2": "old"}


def test_identity(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("a", 1, "y"), ("b", 1, None)], "subject string, item int, text string")
    assert [r["item"] for r in rel.mismatches(df, "item", "text").collect()] == [1]


def test_casts_and_stamps(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "t string")
    assert [r["t"] for r in pf.parsed(df, "t", "skip").collect()] == [1.5]
    assert [r["t"] for r in pf.parsed(df, "t", "column").collect()] == [None] * 3
    with pytest.raises(Exception, match="not a number"):
        pf.parsed(df, "t", "abort").collect()
    assert [one(spark, f.whole_number(F.lit(x))) for x in (" 12 ", "１２", "1a", "")] == [12, 12, None, None]
    assert one(spark, f.utc_stamp(F.lit("2024-05-06 07:08:09").cast("timestamp"))) == "2024-05-06T07:08:09+00:00"
    assert one(spark, f.local_stamp(F.lit("2024-05-06 07:08:09").cast("timestamp"))) == "20240506_070809"
    assert len(one(spark, f.utc_stamp())) == 25 and one(spark, f.gib(F.lit(3 * 1024**3 // 2))) == 1.5


def test_ranks_with_nulls(spark):
    rows = [(g, v, float(i)) for i, (g, v) in enumerate([("a", None), ("a", 2.0), ("a", None), (None, 1.0), (None, 1.0), ("a", 5.0)])]
    df = spark.createDataFrame(rows, "g string, v double, k double")
    assert sorted((r["k"], r["r_v"]) for r in rk.ranked_wide(df, "g", "v", "k").collect()) == sorted((r["k"], r["r_v"]) for r in rk.ranked(df, "g", "v").collect())


def test_common_subjects(spark):
    rows = [(1, 1, 0.5), (1, 2, 0.1), (2, 1, 0.3), (2, 3, 0.2), (1, 1, 0.7)]
    got = inf.common_subjects(spark.createDataFrame(rows, "run long, subject long, effect double")).collect()
    assert [(r["subject"], r["runs"], round(r["mean"], 6)) for r in got] == [(1, 2, 0.5)]


@pytest.mark.parametrize("parts", [1, 5])
def test_numbered(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(7)
    got = {r["i"]: r["n"] for r in rk.numbered(df, "g", "n", "x", "i", parts=parts).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(own)}
    assert got == want
    assert rk.numbered(df.where("false"), "g", "n", "x").count() == 0


def test_few_keys_do_not_deal_the_rows(spark, monkeypatch):
    """Two groups, three values: neither a group's nor a value's rows meet in one task."""
    from weftspark.operators import ranks as rk

    df = spark.range(400).select((F.col("id") % 2).alias("g"), F.rand(1).alias("x"), (F.col("id") % 3).alias("y"))
    monkeypatch.setattr(rk, "SMALL", 3)
    got = rk.residualized(df, "g", ["x"], ["y"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 400 and "hashpartitioning(g#" not in plan and "SortMergeJoin" not in plan


def test_rounding_is_that_of_sql(spark):
    """By a product of doubles, not by decimals, which round 0.1283035 up."""
    import duckdb

    x = [0.1283035, -0.1283035, 2.0462195, 1 / 128, -1 / 128, 0.0, -0.0, -1e-9, float("inf"), 1e300, 5e9 + 0.25, None]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").orderBy("k").select(f.r6(F.col("x"))).collect()]
    assert got == [duckdb.execute("select round(cast(? as double), 6) + 0.0", [v]).fetchone()[0] for v in x]
    assert math.isnan(spark.range(1).select(f.r6(F.lit(float("nan")))).first()[0])
