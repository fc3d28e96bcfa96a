"""Helpers shared by the corpus operators: Arrow slices, vectorised words and hashes, storage, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; the arrays beside it take some 50 times as much.
SLICE_BYTES = 1 << 19
#: The largest share of all rows that one key takes into one task of spread_join().
SHARE = 1024
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, and sees that checkpoints have a folder that all executors share."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftspark-"))  # one machine, as in tests


# ---------------------------------------------------------------- Arrow


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(raw: np.ndarray, off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with up to `most` bytes; a longer row comes alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


# ---------------------------------------------------------------- words and hashes

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * SLICE_BYTES)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over bytes or 64-bit codes; span_hash() takes differences."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], alike wherever the span stands."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross rows: starts, ends, and the first run of each row (with one more at the end)."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off)


#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i+w] for each i with a whole window, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < w:
        x = np.minimum(x[: len(x) - (w - have)], x[w - have :])
    return x


# ---------------------------------------------------------------- joins on keys of which few may be hot


def spread_join(big: DataFrame, small: DataFrame, key: str, total: int, by: str | None = None) -> DataFrame:
    """big left joined with small, which has one row a key and in `n` the number of big's rows with it; total is that of all.

    Keys with over 1 / SHARE of all rows are dealt out in parts of about that size. There are fewer than SHARE of them, which
    bounds the table that is broadcast. The parts go by the hash of the column `by`, which tells a key's rows apart; without it
    by the order of big's rows, so big has to come from a scan or a checkpoint then.
    """
    own, salt = (fresh(x, big, small) for x in ("__parts", "__salt"))
    parts = F.when(F.col("n") * SHARE > total, F.ceil(F.col("n") * SHARE / max(1, total))).otherwise(1).cast("int")
    hot = F.broadcast(small.where(F.col("n") * SHARE > total).select(key, parts.alias(own)))
    dealt = F.monotonically_increasing_id() if by is None else F.xxhash64(by)
    left = big.join(hot, key, "left").withColumn(salt, F.pmod(dealt, F.coalesce(own, F.lit(1))).cast("int")).drop(own)
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return left.join(right, [key, salt], "left").drop(salt)


def fresh(name: str, *frames: DataFrame) -> str:
    """A name that no column of the frames has."""
    while any(name in df.columns for df in frames):
        name += "_"
    return name


# ---------------------------------------------------------------- components


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks the larger root of each pair to the smaller, in place; label[i] <= i stays a root's index."""
    while len(a):
        ra, rb = label[a], label[b]
        keep = ra != rb
        if not keep.any():
            return
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b: long) reaches.

    Large-star and small-star steps in turn; a step's links are no more than those before it, and each is
    cut by checkpoint(). Nothing but two numbers a round comes to the driver. Nodes without an edge are left out.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = small.where("u <> v").distinct().checkpoint()
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == state:
            break
        state = after
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
