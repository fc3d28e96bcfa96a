"""Inference over runs and subjects: exact sign flips, leave-one-out, influence, Monte-Carlo nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .ranks import numbered

#: Fixed value: means closer than this count as equal to the observed one.
TIE = 1e-15


#: Values up to which every sign pattern is a row; more are met in the middle.
FEW = 20


def signed_sums(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """rows with one row a sign pattern of an array column: the signed sum. Patterns are dealt in two steps, so that none is a
    list of all of them."""
    half = F.floor(F.size(values) / 2)
    patterns = lambda n: F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1)
    rows = rows.withColumn("__high", F.explode(patterns(F.size(values) - half))).repartition("__high").withColumn("__low", F.explode(patterns(half)))
    signs = F.col("__high") * F.pow(F.lit(2.0), half).cast("long") + F.col("__low")
    return rows.withColumn(name, F.aggregate(F.transform(values, lambda x, i: F.when(F.floor(signs / F.pow(F.lit(2.0), i)) % 2 == 1, -x).otherwise(x)), F.lit(0.0), lambda t, x: t + x)).drop("__high", "__low")


def met_in_the_middle(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, p) of rows (key, v, n, mean): the values' halves give two tables of 2**(n/2) signed sums. For each sum of the
    first, the sums of the second that reach the observed total with it are those from its place on in their order; places come
    from ranges of sums, numbered in parallel, and the rows before each range."""
    half = F.floor(F.col("n") / 2).cast("int")
    ask = signed_sums(rows.select(key, "n", "mean", F.slice("v", F.lit(1), half).alias("h")), F.col("h"), "s").select(key, (F.col("n") * (F.col("mean") - TIE) - F.col("s")).alias("s"), F.lit(0).alias("own"))
    have = signed_sums(rows.select(key, F.slice("v", half + 1, F.col("n").cast("int")).alias("h")), F.col("h"), "s").select(key, "s", F.lit(1).alias("own"))
    # of equal numbers the asking one comes first, as an equal sum counts
    both = numbered(ask.union(have), key, "place", "s", "own", parts=int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the asking rows' places less those among themselves, 0 + 1 + ..., are the rows of the second table before them
    front = both.where("own = 0").groupBy(key).agg(F.sum(F.col("place").cast("decimal(38,0)")).alias("places"), F.count("*").alias("asked"))
    second = both.where("own = 1").groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("second"))
    front = front.join(second, F.col(key).eqNullSafe(F.col("__k"))).drop("__k").withColumnRenamed(key, "__k")
    m = F.col("asked").cast("decimal(19,0)")
    reach = m * F.col("second").cast("decimal(18,0)") - F.col("places") + m * (m - 1) / 2
    return rows.join(front, rows[key].eqNullSafe(F.col("__k"))).select(key, "n", "mean", (reach.cast("double") / F.pow(F.lit(2.0), F.col("n"))).alias("p"))


def signflip(effects: DataFrame, key: str, value: str, few: int = FEW) -> DataFrame:
    """(key, n, mean, p): the exact share of all 2**n sign patterns whose mean is at least the observed one, up to TIE.

    Up to `few` values, every pattern is a row; keys with more meet in the middle, with 2**(n/2) rows for each half.
    """
    rows = effects.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"), F.count("*").alias("n"), F.avg(value).alias("mean"))
    one = signed_sums(rows.where(F.col("n") <= few), F.col("v"), "s").withColumn("flipped", F.col("s") / F.col("n"))
    one = one.groupBy(key).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.avg((F.col("flipped") >= F.col("mean") - TIE).cast("double")).alias("p"))
    large = rows.where(F.col("n") > few)
    return one if large.isEmpty() else one.unionByName(met_in_the_middle(kept(large), key))


def leave_one_out(effects: DataFrame, keys: list[str], value: str) -> DataFrame:
    """effects with the mean of the others; null where there is no other."""
    w = Window.partitionBy(*keys)
    return effects.withColumn("others", F.try_divide(F.sum(value).over(w) - F.col(value), F.count("*").over(w) - 1))


def run_summary(effects: DataFrame) -> DataFrame:
    """(run, n, mean, median, positive) of effects (run, subject, effect)."""
    return effects.groupBy("run").agg(F.count("*").alias("n"), F.avg("effect").alias("mean"), F.percentile("effect", 0.5).alias("median"), F.count_if(F.col("effect") > 0).alias("positive"))


def common_subjects(effects: DataFrame) -> DataFrame:
    """(subject, runs, mean): subjects that every run has."""
    runs = effects.agg(F.count_distinct("run").alias("all_runs"))
    got = effects.groupBy("subject").agg(F.count_distinct("run").alias("runs"), F.avg("effect").alias("mean"))
    return got.join(F.broadcast(runs), F.col("runs") == F.col("all_runs")).drop("all_runs")


def influence(effects: DataFrame) -> DataFrame:
    """(subject, runs_present, mean_without, delta): the mean of run means with one subject left out of each; a run that
    doesn't have the subject stays as it is, so only its runs are looked at."""
    w = Window.partitionBy("run")
    rows = effects.withColumn("total", F.sum("effect").over(w)).withColumn("n", F.count("*").over(w))
    means = run_summary(effects).agg(F.sum("mean").alias("all"), F.count("*").alias("runs"))
    change = F.coalesce(F.try_divide(F.col("total") - F.col("effect"), F.col("n") - 1), F.lit(0.0)) - F.col("total") / F.col("n")
    got = rows.withColumn("change", change).groupBy("subject").agg(F.count("*").alias("runs_present"), F.sum("change").alias("change"))
    got = got.join(F.broadcast(means))
    return got.select("subject", "runs_present", ((F.col("all") + F.col("change")) / F.col("runs")).alias("mean_without"), (F.col("change") / F.col("runs")).alias("delta"))


def crossrun_null(nulls: DataFrame, draws: int, pick: Column) -> DataFrame:
    """(draw, mean): for each draw one null value of each run (run, perm, stat), chosen by `pick` from (draw, run, n), averaged.

    Draws are rows, dealt over tasks; the nulls are looked up by an equi-join.
    """
    runs = nulls.groupBy("run").agg(F.count("*").alias("n"))
    plan = nulls.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(runs))
    return plan.withColumn("perm", pick).join(nulls, ["run", "perm"]).groupBy("draw").agg(F.avg("stat").alias("mean"))
