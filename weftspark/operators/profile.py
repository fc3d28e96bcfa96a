"""Profiles of tables: frequencies, top values, inventories, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as f


def frequencies(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def profile(rows: DataFrame, value: str, order: str, top: int = 30) -> DataFrame:
    """(n_nonmissing, n_unique, top_values): the most common values, of equal ones the first seen; a report of `top` values."""
    counts = rows.where(f.present(F.col(value))).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nonmissing"), F.count("*").alias("n_unique"))
    best = counts.orderBy(F.desc("n"), "first").limit(top)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("value")))).alias("t"))
    return totals.join(F.broadcast(listed)).select("n_nonmissing", "n_unique", F.transform("t", lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("n"))).alias("top_values"))


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def inventory(rows: DataFrame, path: str, size: str) -> DataFrame:
    """(extension, n, bytes), "<none>" for files without one."""
    extension = F.coalesce(F.nullif(suffix(F.col(path)), F.lit("")), F.lit("<none>"))
    return rows.groupBy(extension.alias("extension")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def listed(rows: DataFrame, path: str, size: str) -> DataFrame:
    """inventory() in the order of reports: the most frequent first, then by name."""
    return inventory(rows, path, size).orderBy(F.desc("n"), "extension")


def totals(rows: DataFrame, size: str, subject: str, signal) -> DataFrame:
    """One row: files, bytes, subjects (nulls and empty ones don't count), signal files and their bytes, GiB of all."""
    s = F.col(size)
    return rows.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(s), F.lit(0)).alias("bytes"), F.count_distinct(F.nullif(F.col(subject), F.lit(""))).alias("subjects"),
        F.count_if(signal).alias("signal_files"), F.coalesce(F.sum(F.when(signal, s)), F.lit(0)).alias("signal_bytes"), f.gib(F.coalesce(F.sum(s), F.lit(0))).alias("gib"))


def ranges(rows: DataFrame, group: str, *values: str) -> DataFrame:
    """(group, min_<value>, max_<value>), NaN left out as nulls are; null where nothing is left."""
    out = []
    for v in values:
        x = F.when(~F.isnan(F.col(v).cast("double")), F.col(v))
        out += [F.min(x).alias(f"min_{v}"), F.max(x).alias(f"max_{v}")]
    return rows.groupBy(group).agg(*out)


def signal_quality(signal: DataFrame, run: str, channel: str, value: str) -> DataFrame:
    """(run, n_channels, finite_share, n_flat: channels without variance, median_sd), deviations over the finite values.

    Channels are summed up first, so a run's samples never meet in one task.
    """
    x = F.col(value).cast("double")
    good = F.when(f.finite(x), x)
    by = signal.groupBy(run, channel).agg(F.count("*").alias("n"), F.count(good).alias("good"), F.stddev_pop(good).alias("sd"))
    return by.groupBy(run).agg(F.count("*").alias("n_channels"), (F.sum("good") / F.sum("n")).alias("finite_share"), F.count_if(F.col("sd") == 0).alias("n_flat"), F.percentile("sd", 0.5).alias("median_sd"))


def seen(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n, ids): the distinct ids of each group in order; meant for ids of subjects or runs, which are few."""
    return rows.groupBy(group).agg(F.count_distinct(key).alias("n"), F.sort_array(F.collect_set(key)).alias("ids"))


def preview(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first rows of a report."""
    return rows.orderBy(order).limit(n)


def head(signal: DataFrame, sample: str, rate: float, seconds: float) -> DataFrame:
    """The samples of the first seconds, by number: a filter that reaches the scan."""
    return signal.where(F.col(sample) < int(rate * seconds))


def parsed(rows: DataFrame, text: str, policy: str = "abort") -> DataFrame:
    """rows with `text` as a number. A text that is none stops the query ("abort"), takes its row with it ("skip") or
    makes the whole column null ("column")."""
    x = F.trim(F.col(text)).try_cast("double")
    if policy == "abort":
        return rows.withColumn(text, f.number_or_abort(F.col(text)))
    if policy == "skip":
        return rows.withColumn(text, x).where(F.col(text).isNotNull())
    bad = rows.agg(F.count_if(F.col(text).isNotNull() & x.isNull()).alias("__bad"))
    return rows.crossJoin(F.broadcast(bad)).withColumn(text, F.when(F.col("__bad") == 0, x)).drop("__bad")  # one row


def latest(artifacts: DataFrame, key: str, stamp: str, tiebreak: str, priority=None) -> DataFrame:
    """The newest artifact of each key; with a priority, of the lowest priority that the key has."""
    order = ([priority.asc()] if priority is not None else []) + [F.desc(stamp), F.desc(tiebreak)]
    return artifacts.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def availability(expected: DataFrame, present: DataFrame, subject: str, file: str) -> DataFrame:
    """(subject, expected, present, status): complete, partial or unavailable, by which expected files are there."""
    there = present.select(subject, file).distinct().withColumn("there", F.lit(1))
    rows = expected.join(there, [subject, file], "left").groupBy(subject).agg(F.count("*").alias("expected"), F.count("there").alias("present"))
    return rows.withColumn("status", F.when(F.col("present") == F.col("expected"), "complete").when(F.col("present") > 0, "partial").otherwise("unavailable"))


def missing(expected: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    return expected.join(present, list(keys), "left_anti")


def checks(row: DataFrame, *names: str) -> DataFrame:
    """(check, value) rows of a one-row frame; a null value is a check that could not be made."""
    return row.select([F.col(n).cast("string").alias(n) for n in names]).unpivot([], list(names), "check", "value")
