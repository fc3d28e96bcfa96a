"""Pooling of token states (row, layer, token, hidden: array, attended, special) to one vector a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(long: DataFrame, key: str) -> DataFrame:
    """(key, vector) from (key, dim, x)."""
    rows = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return rows.select(key, F.col("v.x").alias("vector"))


def masked_mean(states: DataFrame, key: str, hidden: str, mask: Column) -> DataFrame:
    """(key, vector): the mean of the states under the mask; zeros where none is, as the divisor is 1 at least."""
    m = F.coalesce(mask.cast("double"), F.lit(0.0))
    long = states.select(key, m.alias("m"), F.posexplode(F.col(hidden).cast("array<double>")).alias("dim", "h"))
    return gathered(long.groupBy(key, "dim").agg((F.sum(F.col("h") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("x")), key)


def first_token(states: DataFrame, key: str, token: str, hidden: str) -> DataFrame:
    return states.where(F.col(token) == 0).select(key, F.col(hidden).cast("array<double>").alias("vector"))


def last_token(states: DataFrame, key: str, token: str, hidden: str, attended: Column) -> DataFrame:
    """The state of the last attended token, whichever side is padded."""
    return states.where(attended).groupBy(key).agg(F.max_by(F.col(hidden).cast("array<double>"), token).alias("vector"))


def last_layers(states: DataFrame, key: str, layer: str, token: str, hidden: str, mask: Column, layers: int = 4) -> DataFrame:
    """The mean over the last layers of each token, then the masked mean over tokens."""
    top = states.agg(F.max(layer).alias("top"))
    rows = states.join(F.broadcast(top), F.col(layer) > F.col("top") - layers)
    long = rows.select(key, token, mask.alias("m"), F.posexplode(F.col(hidden).cast("array<double>")).alias("dim", "h")).groupBy(key, token, "m", "dim").agg(F.avg("h").alias("h"))
    m = F.coalesce(F.col("m").cast("double"), F.lit(0.0))
    return gathered(long.groupBy(key, "dim").agg((F.sum(F.col("h") * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("x")), key)


def truncated(rows: DataFrame, plain: Column, special: int, most: int) -> DataFrame:
    """(min_tokens, max_tokens, truncated): rows whose tokens with the special ones pass the model's length."""
    n = plain + special
    return rows.agg(F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.count_if(n > most).alias("truncated"))


def embedded(texts: DataFrame, text: str, encode, prefix: str = "", batch: int = 32) -> DataFrame:
    """texts with `vector`, by an encoder that takes a list of texts and returns a matrix; it is made once a worker by encode()."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    def make():
        model = encode()
        return lambda inputs: model(list(inputs))

    return texts.withColumn("vector", predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))))
