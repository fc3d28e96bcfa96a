"""All-pairs distances of the items of a group: the condensed upper triangle as rows (group, i, j, distances).

A group's items are dealt into tiles, and each pair of tiles is a cell of the group's pair matrix, taken by one task as matrix
products. So no task holds more than two tiles, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import columns as f

#: Items of a tile, about.
TILE = 512
#: A group has so many tiles, larger ones, or as many as tiles of LARGE items make, as its items are sent once for each of them.
SIDES, LARGE = 8, 4096

# ---------------------------------------------------------------- metrics: values of items -> cells of (distances, where they are null)

Cell = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def either(missing: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return missing[a][:, None] | missing[b][None, :]


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows filled with zeros, sizes, which are null or hold a null)."""
    off = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(off[0], off[-1] - off[0])
    size, missing = np.diff(off), np.asarray(column.is_null())
    row = np.repeat(np.arange(len(size)), size)
    if values.null_count:
        missing = missing.copy()
        missing[row[np.asarray(values.is_null())]] = True
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.fill_null(values.cast(pa.float64()), 0.0))
    return out, size, missing


def centered(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    inside = np.arange(x.shape[1]) < size[:, None]
    return np.where(inside, x - (x.sum(axis=1) / np.maximum(size, 1))[:, None], 0.0)


def unit(x: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their lengths; a zero row has no direction, so it counts as missing."""
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length == 0, 1.0, length)[:, None], missing | (length == 0)


def angle(center: bool) -> Callable[[pa.Array], Cell]:
    def prepare(column: pa.Array) -> Cell:
        x, size, missing = vectors(column)
        x, missing = unit(centered(x, size) if center else x, missing)
        return lambda a, b: (1.0 - x[a] @ x[b].T, either(missing, a, b) | (size[a][:, None] != size[b][None, :]))

    return prepare


def euclidean(column: pa.Array) -> Cell:
    x, size, missing = vectors(column)

    def cell(a, b):
        out = np.empty((len(a), len(b)))
        for at in range(0, len(a), 32):  # differences rather than products, which cancel
            d = x[a[at : at + 32]][:, None, :] - x[b][None, :, :]
            out[at : at + 32] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        return out, either(missing, a, b) | (size[a][:, None] != size[b][None, :])

    return cell


def cityblock(column: pa.Array) -> Cell:
    missing, x = np.asarray(column.is_null()), np.asarray(pc.fill_null(column.cast(pa.float64()), 0.0))
    return lambda a, b: (np.abs(x[a][:, None] - x[b][None, :]), either(missing, a, b))


def hamming(column: pa.Array) -> Cell:
    missing, code = np.asarray(column.is_null()), np.asarray(pc.fill_null(column.dictionary_encode().indices, -1))
    return lambda a, b: ((code[a][:, None] != code[b][None, :]).astype(float), either(missing, a, b))


def bitmaps(texts: list[str]) -> np.ndarray:
    """Which characters of all the texts each has, as rows of 64-bit words."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    known, at = np.unique(points, return_inverse=True)
    out = np.zeros((len(texts), len(known) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def jaccard(column: pa.Array) -> Cell:
    """1 - |a and b| / |a or b| of the texts' characters; two texts without any are alike, a null has none."""
    bits = bitmaps(pc.fill_null(column, "").to_pylist())

    def cell(a, b):
        both, any_ = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), np.int64)
        for one, other in zip(bits[a].T, bits[b].T):
            both += np.bitwise_count(one[:, None] & other[None, :])
            any_ += np.bitwise_count(one[:, None] | other[None, :])
        return np.where(any_ == 0, 0.0, 1.0 - both / np.maximum(any_, 1)), np.zeros(both.shape, bool)

    return cell


def binwise(column: pa.Array) -> Cell:
    """The mean over bins of 1 - correlation."""
    off = np.asarray(column.offsets).astype(np.int64)
    x, size, missing = vectors(column.values.slice(off[0], off[-1] - off[0]))
    x, missing = unit(centered(x, size), missing)
    bins = np.diff(off)
    most = max(1, int(bins.max(initial=0)))
    row = np.repeat(np.arange(len(bins)), bins)
    place = np.arange(len(row)) - np.repeat(np.cumsum(bins) - bins, bins)
    flat, width = np.zeros((len(bins), most, x.shape[1])), np.zeros((len(bins), most), np.int64)
    flat[row, place], width[row, place] = x, size
    lost = np.asarray(column.is_null()) | (bins == 0)
    lost[row[missing]] = True
    flat = flat.reshape(len(bins), -1)
    unlike = lambda a, b: (width[a][:, None, :] != width[b][None, :, :]).any(axis=2)
    return lambda a, b: (1.0 - flat[a] @ flat[b].T / np.maximum(bins[a], 1)[:, None], either(lost, a, b) | (unlike(a, b) if len(np.unique(width)) > 1 else False))


#: metric -> (what Spark does to a column, what numpy makes of its values).
METRICS = {
    "correlation": (f.doubles, angle(True)),
    "cosine": (f.doubles, angle(False)),
    "euclidean": (f.doubles, euclidean),
    "cityblock": (lambda v: v.cast("double"), cityblock),
    "hamming": (lambda v: v, hamming),
    "jaccard": (lambda v: v.cast("string"), jaccard),
    "binwise": (lambda v: v.cast("array<array<double>>"), binwise),
}

# ---------------------------------------------------------------- cells


def parted(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """rows with __parts: the tiles of their group. Only groups over one tile are looked up, rows / tile of them at most."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > tile)
    sizes = sizes.select(group, F.ceil(F.col("n") / tile).cast("int").alias("__parts"))
    return rows.join(sizes, group, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))


def sided(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """rows with __parts: the tiles of their group, which are larger ones where these would be over SIDES."""
    wide = F.greatest(F.lit(SIDES), F.ceil(F.col("__parts") * tile / max(tile, LARGE)).cast("int"))
    return parted(rows, group, tile).withColumn("__parts", F.least("__parts", wide))


def cells(metrics: dict[str, str], schema: T.StructType, tile: int):
    """One cell's pairs, block by block. Items are ordered by their own order, so i < j holds whatever their type; equal ones make no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        item = table.column("__item").combine_chunks()
        rank = np.asarray(pc.rank(item, sort_keys="ascending", tiebreaker="dense")).astype(np.int64)
        part, a, b = np.asarray(table.column("__part")), table.column("__a")[0].as_py(), table.column("__b")[0].as_py()
        order = np.argsort(rank, kind="stable")
        left, right = order[part[order] == a], order[part[order] == b]
        each = {name: METRICS[metric][1](table.column(name).combine_chunks()) for name, metric in metrics.items()}
        for u in range(0, len(left), tile):
            for v in range(u if a == b else 0, len(right), tile):
                yield block(each, table, item, rank, left[u : u + tile], right[v : v + tile], a == b)

    def block(each, table, item, rank, left, right, same) -> pa.RecordBatch:
        own = rank[left][:, None], rank[right][None, :]
        p, q = np.nonzero(own[0] < own[1] if same else own[0] != own[1])
        i, j = left[p], right[q]
        i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        out = [pa.repeat(table.column("__group")[0], len(i)), item.take(pa.array(i)), item.take(pa.array(j))]
        for cell in each.values():
            d, missing = cell(left, right)
            out.append(pa.array(d[p, q], mask=missing[p, q]))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    return run


def distances(items: DataFrame, group: str, item: str, tile: int = TILE, **metrics: tuple[str, Column]) -> DataFrame:
    """(group, i, j, one column a metric) for i < j; metrics: name = (metric, column of items).

    Items are dealt into tiles by hash, and every pair of a group's tiles meets in one task, which all metrics share, and which gives its pairs by
    blocks of tile items; an item is sent once for each tile of its group. Items with a null group or number have no pairs. The number of pairs is what the
    operator is asked for. A null value, a zero vector (where directions are compared) and vectors of unlike sizes give nulls.
    """
    ready = items.select(F.col(group).alias("__group"), F.col(item).alias("__item"), *(METRICS[m][0](x).alias(name) for name, (m, x) in metrics.items())).where("__group is not null and __item is not null")
    kind = {x.name: x.dataType for x in ready.schema}
    schema = T.StructType([T.StructField(group, kind["__group"]), T.StructField("i", kind["__item"]), T.StructField("j", kind["__item"]), *(T.StructField(name, T.DoubleType()) for name in metrics)])
    rows = sided(ready, "__group", tile).withColumn("__part", F.pmod(F.xxhash64("__item"), F.col("__parts")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).withColumn("__a", F.least("__part", "__other")).withColumn("__b", F.greatest("__part", "__other"))
    keys, n = ("__group", "__a", "__b"), int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.drop("__parts", "__other").repartition(n, *keys)  # by number, as partitions that read little, and would be put together, give many rows
    return rows.groupBy(*keys).applyInArrow(cells({name: m for name, (m, _) in metrics.items()}, schema, tile), schema)


# ---------------------------------------------------------------- standard scores

SPREADS = "n array<double>, mean array<double>, square array<double>"
#: Groups of which a task holds moments before it sends them on, and parts that a group's are added up in first.
HELD, FIRST = 256, 32


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values by row and place, where there is one, row and place of each value in turn)."""
    off = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(off[0], off[-1] - off[0])
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x, there = (np.zeros((len(size), max(1, int(size.max(initial=0)))), kind) for kind in (float, bool))
    x[row, at], there[row, at] = np.asarray(pc.fill_null(values.cast(pa.float64()), 0.0)), np.asarray(values.is_valid())
    return x, there, row, at


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, (0, width - len(x)))


def spreads_together(one: tuple, other: tuple) -> tuple:
    """Numbers, means and squares around the means of two sets of rows together, place by place."""
    width = max(len(one[0]), len(other[0]))
    (n, mean, square), (m, other_mean, other_square) = ([widened(x, width) for x in side] for side in (one, other))
    both, gap = np.maximum(n + m, 1.0), other_mean - mean
    return n + m, np.where(n > 0, mean + gap * (m / both), other_mean), square + other_square + np.where((n > 0) & (m > 0), gap * gap * (n * m / both), 0.0)


def spreads(names: list[str], kind: pa.DataType):
    """The spreads of the vectors of each group that a task sees."""

    def rows(held: dict) -> pa.RecordBatch:
        cols = [pa.array(list(held), kind), *(pa.array([v[k].tolist() for v in held.values()], pa.list_(pa.float64())) for k in range(3))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        held = {}
        for batch in batches:
            x, there, *_ = places(batch.column(1))
            group = batch.column(0).dictionary_encode()
            code = np.asarray(group.indices)
            for k, name in enumerate(group.dictionary.to_pylist()):
                own, here = x[code == k], there[code == k]
                n = here.sum(axis=0).astype(float)
                mean = own.sum(axis=0) / np.maximum(n, 1)
                new = (n, mean, (np.where(here, own - mean, 0.0) ** 2).sum(axis=0))
                held[name] = spreads_together(held[name], new) if name in held else new
            if len(held) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def spreads_added(table: pa.Table) -> pa.Table:
    total = None
    for side in zip(*(table.column(x).to_pylist() for x in ("n", "mean", "square"))):
        side = tuple(map(np.array, side))
        total = side if total is None else spreads_together(total, side)
    return pa.table({"__group": table.column("__group")[:1], **{x: [v.tolist()] for x, v in zip(("n", "mean", "square"), total)}})


def standardised(rows: pa.Table, model: pa.Table) -> pa.Table:
    column = rows.column("__vector").combine_chunks()
    if rows.num_rows:
        x, there, row, at = places(column)
        n, mean, square = (np.array(model.column(k)[0].as_py()) for k in ("n", "mean", "square"))
        sd = np.sqrt(square / np.maximum(n, 1))
        z = (x - mean[: x.shape[1]]) / np.where(sd == 0, 1.0, sd)[: x.shape[1]]
        off = pa.array(np.asarray(column.offsets) - column.offsets[0].as_py(), pa.int32())
        column = pa.ListArray.from_arrays(off, pa.array(z[row, at], mask=~there[row, at]))
    return pa.Table.from_arrays([rows.column("__group"), rows.column("__item"), column.cast(pa.list_(pa.float64()))], names=["__group", "__item", "__vector"])


def dealt_with(rows: DataFrame, model: DataFrame, tile: int, fn) -> DataFrame:
    """fn(rows, the group's one row of model) over parts of groups of rows (__group, __item, __vector)."""
    rows = parted(rows, "__group", tile)
    model = model.join(rows.groupBy(F.col("__group").alias("__g")).agg(F.max("__parts").alias("__parts")), F.col("__group") == F.col("__g")).drop("__g")
    model = model.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__item"), F.col("__parts")).cast("int")).drop("__parts")
    return rows.groupBy("__group", "__part").cogroup(model.groupBy("__group", "__part")).applyInArrow(fn, rows.drop("__part").schema)


def vectors_of(items: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    return items.select(F.col(group).alias("__group"), F.col(item).alias("__item"), f.doubles(F.col(vector)).alias("__vector")).where("__group is not null and __item is not null and __vector is not null")


def zscored_vectors(items: DataFrame, group: str, item: str, vector: str, tile: int = 8 * TILE) -> DataFrame:
    """(group, item, vector of z): each place over a group's items, by the population deviation; 0 for a constant one, null for a
    null value. Tasks add up spreads, which merge in two steps, and items are scored in parts, each with its group's spreads. Rows
    with a null group, item or vector take no part."""
    rows = vectors_of(items, group, item, vector)
    table = T.StructType([T.StructField("__group", rows.schema["__group"].dataType), *T._parse_datatype_string(SPREADS).fields])
    sums = rows.select("__group", "__vector").mapInArrow(spreads(table.names, to_arrow_type(table["__group"].dataType)), table)
    sums = sums.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(FIRST))).groupBy("__group", "__part").applyInArrow(spreads_added, table)
    model = sums.groupBy("__group").applyInArrow(spreads_added, table)
    scores = dealt_with(rows, model, tile, standardised)
    return scores.select(F.col("__group").alias(group), F.col("__item").alias(item), F.col("__vector").alias(vector))


def zscored(items: DataFrame, group: str, item: str, vector: str) -> DataFrame:
    """(group, item, dim, z) of zscored_vectors()."""
    return zscored_vectors(items, group, item, vector).select(group, item, F.posexplode(vector).alias("dim", "z"))


# ---------------------------------------------------------------- principal components

MOMENTS = "n long, mean array<double>, scatter array<double>"


def merged(one: tuple, other: tuple) -> tuple:
    """Moments (n, mean, scatter around the mean) of two sets of rows together."""
    (n, mean, scatter), (m, other_mean, other_scatter) = one, other
    gap = other_mean - mean
    return n + m, mean + gap * (m / (n + m)), scatter + other_scatter + np.outer(gap, gap) * (n * m / (n + m))


def moments(schema: T.StructType):
    """Moments of the vectors of each group that a task sees."""

    def rows(held: dict) -> pa.RecordBatch:
        cols = [list(held), *zip(*((n, mean.tolist(), scatter.ravel().tolist()) for n, mean, scatter in held.values()))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    kinds = [to_arrow_type(x.dataType) for x in schema]

    def run(batches):
        held = {}
        for batch in batches:
            x, size, missing = vectors(batch.column(1))
            if missing.any() or len(np.unique(size)) > 1:
                raise ValueError("vectors have to be complete and of one size")
            group = batch.column(0).dictionary_encode()
            names, code = group.dictionary.to_pylist(), np.asarray(group.indices)
            for k, name in enumerate(names):
                own = x[code == k]
                mean = own.mean(axis=0)
                new = (len(own), mean, (own - mean).T @ (own - mean))
                held[name] = merged(held[name], new) if name in held else new
            if len(held) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def added(pdf: pa.Table) -> tuple:
    total = None
    for n, mean, scatter in zip(*(pdf.column(x).to_pylist() for x in ("n", "mean", "scatter"))):
        one = (n, np.array(mean), np.array(scatter).reshape(len(mean), len(mean)))
        total = one if total is None else merged(total, one)
    return total


def added_up(table: pa.Table) -> pa.Table:
    n, mean, scatter = added(table)
    return pa.table({"__group": table.column("__group")[:1], "n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})


def axes(k: int):
    """The means, and the leading directions of standardised vectors, over the deviations: p x k, row by row."""

    def run(table: pa.Table) -> pa.Table:
        n, mean, scatter = added(table)
        if k > min(n - 1, len(mean)):
            raise ValueError("too many components")
        sd = np.sqrt(np.diag(scatter) / n)
        sd[sd == 0] = 1.0
        _, v = np.linalg.eigh(scatter / np.outer(sd, sd))
        return pa.table({"__group": table.column("__group")[:1], "mean": [mean.tolist()], "axes": [(v[:, ::-1][:, :k] / sd[:, None]).ravel().tolist()]})

    return run


def projected(k: int):
    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        if rows.num_rows:
            mean = np.array(model.column("mean")[0].as_py())
            y = (vectors(rows.column("__vector").combine_chunks())[0] - mean) @ np.array(model.column("axes")[0].as_py()).reshape(len(mean), k)
        else:
            y = np.zeros((0, k))
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(y.ravel()))
        return pa.Table.from_arrays([rows.column("__group"), rows.column("__item"), v], names=["__group", "__item", "__vector"])

    return run


def principal_distances(items: DataFrame, group: str, item: str, vector: str, k: int, tile: int = TILE) -> DataFrame:
    """(group, i, j, d): Euclidean distances of a group's first k principal components, of z-scored vectors.

    Tasks add up moments (count, mean, p x p scatter), which merge in two steps; one task a group solves the p x p problem, and
    items are projected in parts, each with its group's axes. Rows with a null group, item or vector take no part.
    """
    rows = vectors_of(items, group, item, vector)
    table = T.StructType([T.StructField("__group", rows.schema["__group"].dataType), *T._parse_datatype_string(MOMENTS).fields])
    sums = rows.select("__group", "__vector").mapInArrow(moments(table), table)
    sums = sums.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(FIRST))).groupBy("__group", "__part").applyInArrow(added_up, table)
    model = sums.groupBy("__group").applyInArrow(axes(k), T.StructType([table["__group"], T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("axes", T.ArrayType(T.DoubleType()))]))
    scores = dealt_with(rows, model, tile, projected(k))
    return distances(scores.select(F.col("__group").alias(group), F.col("__item").alias(item), "__vector"), group, item, tile, d=("euclidean", F.col("__vector")))
