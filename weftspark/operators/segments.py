"""Segment features of a sampled signal (stream, sample, channel, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as f


def sampled(spans: DataFrame, rate: float, samples: str) -> DataFrame:
    """spans (start_sec, end_sec, and a column with the recording's number of samples) with start and stop by sample, rounded half to
    even and cut to the recording, and clipped: whether the end lay beyond it. A span without a sample stops the query."""
    cut = lambda x: F.greatest(F.lit(0), F.least(x, F.col(samples))).cast("long")
    at = {x: F.rint(F.col(x) * rate).cast("long") for x in ("start_sec", "end_sec")}
    rows = spans.withColumns({"start": cut(at["start_sec"]), "stop": cut(at["end_sec"]), "clipped": at["end_sec"] > F.col(samples)})
    bad = F.raise_error(F.concat(F.lit("a segment without a sample: "), F.col("start"), F.lit(" to "), F.col("stop")))
    return rows.withColumn("stop", F.when(F.coalesce(F.col("stop") > F.col("start"), F.lit(False)), F.col("stop")).otherwise(bad.cast("long")))


def scan(signal: DataFrame, spans: DataFrame, stream: str, bins: int, onset: int) -> DataFrame:
    """(stream, segment, channel, clipped, n, mean, sd, onset_mean, bin_means) of spans as sampled() gives them: all features by one
    pass over the signal. A value that is null or not finite stops the query, as a mean would hide it; onset_mean is NaN in a
    segment of fewer samples, and a bin without a sample is null.
    """
    bad = F.raise_error(F.concat(F.lit("not a finite value at sample "), F.col("sample"))).cast("double")
    rows = in_segments(signal, spans, stream).withColumn("value", F.when(f.finite(F.col("value")), F.col("value")).otherwise(bad))
    n = F.col("stop") - F.col("start")
    edge = lambda k: F.rint(F.lit(float(k)) * n / F.lit(float(bins)))
    high = lambda k: F.when(edge(k + 1) <= edge(k), F.greatest(edge(k + 1), F.least(n, edge(k) + 1))).otherwise(edge(k + 1))
    means = [F.avg(F.when((F.col("offset") >= edge(k)) & (F.col("offset") < high(k)), F.col("value"))) for k in range(bins)]
    first = F.when(F.max(n) >= onset, F.avg(F.when(F.col("offset") < onset, F.col("value")))).otherwise(F.lit(float("nan")))
    return rows.groupBy(stream, "segment", "channel").agg(F.max("clipped").alias("clipped"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), first.alias("onset_mean"), F.array(*means).alias("bin_means"))


def in_segments(signal: DataFrame, spans: DataFrame, stream: str, block: int = 256) -> DataFrame:
    """signal rows with the segment (stream, segment, start, stop) that holds their sample: start <= sample < stop.

    An interval join as an equi-join: segments name the blocks they touch, samples know their block.
    """
    spans = spans.where("stop > start").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    rows = signal.withColumn("block", F.floor(F.col("sample") / block))
    return rows.join(spans, [stream, "block"]).where("sample >= start and sample < stop").drop("block").withColumn("offset", F.col("sample") - F.col("start"))


def mean_std(signal: DataFrame, spans: DataFrame, stream: str) -> DataFrame:
    """(stream, segment, channel, n, mean, sd): population deviation."""
    return in_segments(signal, spans, stream).groupBy(stream, "segment", "channel").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def bin_edges(spans: DataFrame, bins: int) -> DataFrame:
    """spans with one row a bin: (bin, lo, hi) by offset, edges rounded half to even; a bin without a sample is widened to one
    sample where there is one, so bins may share samples."""
    n = F.col("stop") - F.col("start")
    rows = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = rows.withColumn("lo", F.rint(F.col("bin") * n / F.lit(float(bins))).cast("long")).withColumn("hi", F.rint((F.col("bin") + 1) * n / F.lit(float(bins))).cast("long"))
    return rows.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.greatest("hi", F.least(n, F.col("lo") + 1))).otherwise(F.col("hi")))


def relative_bins(signal: DataFrame, spans: DataFrame, stream: str, bins: int = 8) -> DataFrame:
    """(stream, segment, bin, channel, mean). A bin that stays empty has no row; empty_bins() names it."""
    edges = bin_edges(spans, bins).select(stream, "segment", "bin", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("stop"))
    return in_segments(signal, edges, stream).groupBy(stream, "segment", "bin", "channel").agg(F.avg("value").alias("mean"))


def empty_bins(spans: DataFrame, bins: int = 8) -> DataFrame:
    return bin_edges(spans, bins).where("hi <= lo")


def onset_mean(signal: DataFrame, spans: DataFrame, stream: str, samples: int) -> DataFrame:
    """(stream, segment, channel, available, mean): the mean of the first samples; NaN in a segment with fewer."""
    rows = in_segments(signal, spans, stream).where(F.col("offset") < samples)
    enough = F.max(F.col("stop") - F.col("start")) >= samples
    return rows.groupBy(stream, "segment", "channel").agg(enough.alias("available"), F.when(enough, F.avg("value")).otherwise(F.lit(float("nan"))).alias("mean"))
