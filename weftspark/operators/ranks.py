"""Average ranks, rank association, and association with nuisances taken out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept

#: Rows of a group that one task ranks as arrays. With a larger group, rows are ranked by ranges of values instead.
SMALL = 1 << 20
#: Rows of a table that is sent to all tasks rather than joined by its keys, of which each would be one task's.
FEW = 1 << 16


def small(df: DataFrame, group: str, most: int | None = None) -> bool:
    """Whether no group has over SMALL rows. Both ways give the same rows, so this only chooses a plan."""
    n = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (n or 0) <= (SMALL if most is None else most)


def average_ranks(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """1 for the least, ties share their mean; nulls are a value before all others, NaN one after them."""
    out = np.full(len(x), (missing.sum() + 1) / 2.0)
    _, inverse, n = np.unique(x[~missing], return_inverse=True, return_counts=True)
    out[~missing] = (missing.sum() + np.cumsum(n) - (n - 1) / 2.0)[inverse]
    return out


def by_group(df: DataFrame, group: str, values: list[str], added: list[str], fn: Callable[[dict[str, np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """df with columns that fn(ranks of each value) gives for a group, by one shuffle."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.DoubleType()) for x in added)])
    own, names = [f"__v_{v}" for v in values], df.columns
    rows = df.withColumns({x: F.col(v).cast("double") for x, v in zip(own, values)})

    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(x).combine_chunks() for x in own]
        ranks = {v: average_ranks(np.asarray(x.fill_null(0.0)), np.asarray(x.is_null())) for v, x in zip(values, cols)}
        return pa.Table.from_arrays([*(table.column(x) for x in names), *map(pa.array, fn(ranks))], names=schema.names)

    return rows.groupBy(F.col(group).alias("__by")).applyInArrow(run, schema)


def scores(name: str, rank: np.ndarray) -> np.ndarray:
    sd = rank.std()
    if not sd > 0:
        raise ValueError(f"{name} is constant in a group")
    return (rank - rank.mean()) / sd


def ranked(df: DataFrame, group: str, *values: str) -> DataFrame:
    """df with the average rank of each value in its group as r_<value>: 1 for the least, ties share their mean.

    By plain windows, for groups that one task can sort and for values of any type; ranked_wide() has no such bound.
    """
    for v in values:
        at, ties = Window.partitionBy(group).orderBy(v), Window.partitionBy(group, v)
        df = df.withColumn(f"r_{v}", F.rank().over(at) + (F.count("*").over(ties) - 1) / 2.0)
    return df


def rank_table(df: DataFrame, group: str, *values: str, parts: int | None = None) -> DataFrame:
    """(group, name, value, n, rank) of the distinct values of number columns, for groups of any size: values are counted
    before a range shuffle, ranges are numbered in parallel, and only their totals (a row a range and group) are summed in order.
    There are as many ranges as the session's shuffles have partitions."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values))
    counts = df.select(F.col(group).alias("grp"), F.explode(every).alias("x")).groupBy("grp", "x.name", "x.value").agg(F.count("*").alias("n"))
    counts = kept(counts.repartitionByRange(parts, "grp", "name", "value").withColumn("part", F.spark_partition_id()))
    totals = counts.groupBy("grp", "name", "part").agg(F.sum("n").alias("total"))
    before = totals.select(F.col("grp").alias("g"), F.col("name").alias("v"), F.col("part").alias("p"), (F.sum("total").over(Window.partitionBy("grp", "name").orderBy("part")) - F.col("total")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("grp", "name", "part").orderBy("value"))
    own = F.col("grp").eqNullSafe(F.col("g")) & (F.col("name") == F.col("v")) & (F.col("part") == F.col("p"))
    return counts.join(before, own).select("grp", "name", "value", "n", (F.col("before") + upto - (F.col("n") - 1) / 2.0).alias("rank"))


def sent_if_few(table: DataFrame) -> DataFrame:
    """table, kept, for a join with rows: few keys, which many rows have, don't deal these rows."""
    table = kept(table)
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def with_ranks(df: DataFrame, group: str, table: DataFrame, value: str, **columns) -> DataFrame:
    own = table.where(F.col("name") == value).select(F.col("grp").alias("__g"), F.col("value").alias("__v"), *(c.alias(n) for n, c in columns.items()))
    return df.join(sent_if_few(own), df[group].eqNullSafe(F.col("__g")) & df[value].cast("double").eqNullSafe(F.col("__v"))).drop("__g", "__v")


def numbered(df: DataFrame, group: str, name: str, *order: str, parts: int | None = None) -> DataFrame:
    """df with name: a row's number from 0 in its group, in the order of the given columns, for groups of any size.

    Rows go into ranges of (group, order), each range is numbered by itself, and the rows before it in its group, a sum a range,
    are added. The ranges are kept once, so a retry gives the same numbers. Rows alike in all of these columns follow each other
    in any order; nulls come first, and a null group is one of its own. Small groups are numbered by a plain window.
    """
    if parts is None and small(df, group):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()))
    totals = rows.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = totals.select("__g", "__p", (F.sum("__n").over(Window.partitionBy("__g").orderBy("__p")) - F.col("__n")).alias("__before"))
    within = rows.withColumn("__at", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1)
    own = within[group].eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    return within.join(before, own).withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__g", "__p", "__before", "__at")


def ranked_wide(df: DataFrame, group: str, *values: str, parts: int | None = None) -> DataFrame:
    """ranked() for number columns and groups of any size. Nulls are a value before all others.

    Small groups are ranked as arrays, by one shuffle. Else df is kept once, as its values have to be the same bit by bit when
    ranks are joined to them.
    """
    if parts is None and small(df, group):
        return by_group(df, group, list(values), [f"r_{v}" for v in values], lambda ranks: [ranks[v] for v in values])
    df = kept(df)
    table = rank_table(df, group, *values, parts=parts)
    for v in values:
        df = with_ranks(df, group, table, v, **{f"r_{v}": F.col("rank")})
    return df


def rank_z(df: DataFrame, group: str, *values: str, parts: int | None = None) -> DataFrame:
    """df with z_<value>: ranks less their mean, over their population deviation. A constant value is an error.

    With large groups, mean and deviation come from the counts of distinct values, so no task holds a group, and df is kept once, as in ranked_wide().
    """
    if parts is None and small(df, group):
        return by_group(df, group, list(values), [x for v in values for x in (f"r_{v}", f"z_{v}")], lambda ranks: [x for v in values for x in (ranks[v], scores(v, ranks[v]))])
    df = kept(df)
    table = kept(rank_table(df, group, *values, parts=parts))
    size = table.groupBy(F.col("grp").alias("g"), F.col("name").alias("v")).agg(((F.sum("n") + 1) / 2.0).alias("mean"))
    both = table.join(size, F.col("grp").eqNullSafe(F.col("g")) & (F.col("name") == F.col("v")))
    spread = both.groupBy("grp", "name", "mean").agg(F.sqrt(F.sum(F.col("n") * (F.col("rank") - F.col("mean")) ** 2) / F.sum("n")).alias("sd"))
    for v in values:
        own = spread.where(F.col("name") == v).select(F.col("grp").alias("__gs"), "mean", F.col("sd").alias("__sd"))
        df = with_ranks(df, group, table, v, **{f"r_{v}": F.col("rank")})
        df = df.join(sent_if_few(own), df[group].eqNullSafe(F.col("__gs"))).withColumn(f"z_{v}", F.when(F.col("__sd") > 0, (F.col(f"r_{v}") - F.col("mean")) / F.col("__sd")).otherwise(F.raise_error(F.lit(f"{v} is constant in a group")))).drop("__gs", "mean", "__sd")
    return df


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, rho)."""
    return ranked_wide(df.select(group, x, y), group, x, y).groupBy(group).agg(F.corr(f"r_{x}", f"r_{y}").alias("rho"))


def associations(df: DataFrame, group: str, x: str, others: list[str]) -> DataFrame:
    """(group, other, rho): the rank association of x with each of the others, nothing taken out. Ranks are taken once."""
    rho = F.explode(F.array(*(F.struct(F.lit(o).alias("other"), F.col(f"rho_{o}").alias("rho")) for o in others))).alias("r")
    return ranked_wide(df.select(group, x, *others), group, x, *others).groupBy(group).agg(*(F.corr(f"r_{x}", f"r_{o}").alias(f"rho_{o}") for o in others)).select(group, rho).select(group, "r.other", "r.rho")


def coefficients(df: DataFrame, group: str, targets: list[str], nuisances: list[str]) -> DataFrame:
    """(group, target, beta): least-squares weights of z_<target> on z_<nuisances>, from one aggregate of sums of products.

    The k x k systems, one row a group, are solved by pseudo-inverse, so nuisances may depend on each other.
    """
    z = [f"z_{v}" for v in nuisances]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z)]
    sums += [F.sum(F.col(a) * F.col(f"z_{t}")).alias(f"h_{t}_{i}") for t in targets for i, a in enumerate(z)]
    gram = df.groupBy(F.col(group).alias("group")).agg(*sums)
    kind, k = df.schema[group].dataType.simpleString(), len(z)

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g_{i}_{j}"] for j in range(k)] for i in range(k)])
                rows += [(row["group"], t, (np.linalg.pinv(g) @ np.array([row[f"h_{t}_{i}"] for i in range(k)])).tolist()) for t in targets]
            yield pd.DataFrame(rows, columns=["group", "target", "beta"])

    return gram.mapInPandas(solve, f"group {kind}, target string, beta array<double>")


def left_over(z: dict[str, np.ndarray], targets: list[str], nuisances: list[str]) -> list[np.ndarray]:
    """What is left of each target's scores after least squares on the nuisances', over its deviation."""
    n = np.array([z[v] for v in nuisances]).reshape(len(nuisances), -1)
    inverse, out = np.linalg.pinv(n @ n.T), []
    for t in targets:
        e = z[t] - (inverse @ (n @ z[t])) @ n
        sd = e.std()
        out.append((e - e.mean()) / sd if sd > 0 else np.full(len(e), np.nan))
    return out


def residualized(df: DataFrame, group: str, targets: list[str], nuisances: list[str], parts: int | None = None) -> DataFrame:
    """df with r_ and z_ of all values, and e_<target>: what is left of the rank-z target after least squares on the rank-z
    nuisances, over its deviation. Small groups take one shuffle."""
    if parts is None and small(df, group):
        every = [*targets, *nuisances]

        def fn(ranks: dict[str, np.ndarray]) -> list[np.ndarray]:
            z = {v: scores(v, ranks[v]) for v in every}
            return [*(x for v in every for x in (ranks[v], z[v])), *left_over(z, targets, nuisances)]

        return by_group(df, group, every, [*(x for v in every for x in (f"r_{v}", f"z_{v}")), *(f"e_{t}" for t in targets)], fn)
    df = kept(rank_z(df, group, *targets, *nuisances, parts=parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # read twice: for the sums, and for what is left
    beta = coefficients(df, group, targets, nuisances).select(F.col("group").alias(group), F.concat(F.lit("b_"), "target").alias("name"), "beta")
    beta = beta.groupBy(F.col(group).alias("__gb")).pivot("name", [f"b_{t}" for t in targets]).agg(F.first("beta"))
    df = df.join(sent_if_few(beta), df[group].eqNullSafe(F.col("__gb"))).drop("__gb")
    for t in targets:
        df = df.withColumn(f"e_{t}", F.col(f"z_{t}") - sum((F.col(f"b_{t}")[i] * F.col(f"z_{v}") for i, v in enumerate(nuisances)), F.lit(0.0)))
    scale = df.groupBy(F.col(group).alias("__gs")).agg(*(c.alias(n) for t in targets for n, c in ((f"m_{t}", F.avg(f"e_{t}")), (f"s_{t}", F.stddev_pop(f"e_{t}")))))
    df = df.join(sent_if_few(scale), df[group].eqNullSafe(F.col("__gs"))).drop("__gs")
    for t in targets:
        df = df.withColumn(f"e_{t}", F.try_divide(F.col(f"e_{t}") - F.col(f"m_{t}"), F.col(f"s_{t}")))
    return df.drop(*(f"{x}_{t}" for t in targets for x in "bms"))


def partial_spearman(df: DataFrame, group: str, x: str, y: str, nuisances: list[str]) -> DataFrame:
    """(group, rho): the mean product of the two standardised residuals."""
    return residualized(df.select(group, x, y, *nuisances), group, [x, y], nuisances).groupBy(group).agg(F.avg(F.col(f"e_{x}") * F.col(f"e_{y}")).alias("rho"))


def partial_spearman_of_residuals(df: DataFrame, group: str, x: str, y: str, nuisances: list[str]) -> DataFrame:
    """(group, rho): the residuals ranked again, then correlated. Another number than partial_spearman()."""
    rest = residualized(df.select(group, x, y, *nuisances), group, [x, y], nuisances).select(group, F.round(f"e_{x}", 9).alias("x"), F.round(f"e_{y}", 9).alias("y"))
    return spearman(rest, group, "x", "y")
