"""Ordered event streams: anchoring, pairing of start and end events, context carried forward, aligned manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as f


def after_anchor(events: DataFrame, stream: str, order: str, is_anchor: Column) -> DataFrame:
    """The events of each stream from its first anchor on; none of a stream without one."""
    first = F.min(F.when(is_anchor, F.col(order))).over(Window.partitionBy(stream))
    return events.withColumn("__first", first).where(F.col(order) >= F.col("__first")).drop("__first")


def with_context(events: DataFrame, stream: str, order: str, value: Column, name: str) -> DataFrame:
    """events with the last non-null value so far in the stream, its own included."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def paired(events: DataFrame, stream: str, order: str, kind: str, start: str, end: str, time: str, context: str | None = None) -> DataFrame:
    """Start and end events with what stands next to each in the start/end sequence:
    (stream, order, kind, time, before, before_time, before_order, after[, before_context])."""
    w = Window.partitionBy(stream).orderBy(order)
    rows = events.where(F.col(kind).isin(start, end))
    more = [F.lag(context).over(w).alias("before_context")] if context else []
    return rows.select(stream, order, kind, time, F.lag(kind).over(w).alias("before"), F.lag(time).over(w).alias("before_time"), F.lag(order).over(w).alias("before_order"), F.lead(kind).over(w).alias("after"), *more)


def segments(events: DataFrame, stream: str, order: str, kind: str, start: str, end: str, time: str, context: str | None = None) -> DataFrame:
    """(stream, segment, start_order, end_order, start_time, end_time[, context]): an end right after a start; the context is the start's."""
    rows = paired(events, stream, order, kind, start, end, time, context).where((F.col(kind) == end) & (F.col("before") == start))
    number = F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1
    more = [F.col("before_context").alias(context)] if context else []
    return rows.select(stream, number.cast("long").alias("segment"), F.col("before_order").alias("start_order"), F.col(order).alias("end_order"), F.col("before_time").alias("start_time"), F.col(time).alias("end_time"), *more)


def malformed(events: DataFrame, stream: str, order: str, kind: str, start: str, end: str, time: str) -> DataFrame:
    """(stream, order, problem): a start before the last one ended, an end without a start, a start that never ends."""
    rows = paired(events, stream, order, kind, start, end, time)
    problem = (
        F.when((F.col(kind) == start) & (F.col("before") == start), "start_before_previous_end")
        .when((F.col(kind) == end) & (F.coalesce(F.col("before"), F.lit("")) != start), "end_without_start")
    )
    open_ = F.when((F.col(kind) == start) & F.col("after").isNull(), "unclosed_start")
    return rows.select(stream, order, F.explode(F.array_compact(F.array(problem, open_))).alias("problem"))


def strict(problems: DataFrame) -> None:
    """An error if there is any problem; the counts are in its text."""
    found = {r["problem"]: r["n"] for r in problems.groupBy("problem").agg(F.count("*").alias("n")).collect()}  # three rows at most
    if found:
        raise ValueError(f"malformed events: {found}")


def manifest(rows: DataFrame, spans: DataFrame, vectors: DataFrame, run: str, index: str) -> DataFrame:
    """Text rows, segments and vectors of a run joined 1:1 by position; rows: (run, index, text, is_chapter).

    A position that one side lacks comes out with its problem, so the caller can see it or refuse it.
    """
    joined = rows.join(spans, [run, index], "full").join(vectors, [run, index], "full")
    n = F.count("*").over(Window.partitionBy(run))
    return joined.withColumns({
        "run_position_fraction": F.col(index) / F.greatest(F.lit(1), n - 1),
        "char_count": F.length("text"),
        "semantic_eligible": ~F.col("is_chapter"),
        "duration": F.col("end_time") - F.col("start_time"),
        "complete": F.col("text").isNotNull() & F.col("start_time").isNotNull() & F.col("has_vector").isNotNull(),
    })


def eligible(rows: DataFrame, flag: Column, include_structural: bool = False) -> DataFrame:
    return rows.where(F.coalesce(flag, F.lit(False)) | F.lit(include_structural))


def numeric_chapter(value: Column, kind: Column) -> Column:
    """The chapter number of a cell by its kind (int, float, bool, str): whole floats count, booleans don't, texts must be digits."""
    number = value.try_cast("double")
    return (
        F.when(kind == "int", value.try_cast("long"))
        .when((kind == "float") & (number == F.floor(number)), number.cast("long"))
        .when((kind == "str") & f.whole_number_text(value), F.trim(value).try_cast("long"))
    )
