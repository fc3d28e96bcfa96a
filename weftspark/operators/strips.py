"""Ranks and sums over all pairs of a group's items, for groups whose pair table is too large to be written.

Items of a group are numbered from 0 to n - 1. Its pairs lie by lag: lag d has the pairs (k, k + d mod n) in order of k, and lags from 1
to n / 2 are all pairs. Neighbouring lags are a strip, which one task takes; strips are gone through in blocks of about BLOCK pairs. A
strip's distances are computed again wherever they are needed, so what is shuffled are items, once a strip, and what ranking takes.

Ranks are exact: each block sends its distinct values, sorted, to slices of the value range; a slice ranks them and sends the ranks back.
Both go as differences of a sorted list, byte by byte, compressed: some five bytes a pair in place of a row.
A circular shift of the items rotates each lag in place, so a strip has all that its permuted pairs need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from . import cells as ce
from . import pairs as pr
from . import ranks as rk
from . import slices as sl

#: Pairs of a block, and strips of a group at most.
BLOCK, MOST = 1 << 21, 128
#: Values that a strip shows, from which the bounds of slices are taken; bounds only balance slices.
SHOWN = 512
#: A distance that is null; it ranks before all others.
NULL = -np.inf

NOTE = "strip int, block int, name string, slice int, base long, payload binary"

# ---------------------------------------------------------------- sorted lists as bytes


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of x, NaN last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def packed(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as planes of the bytes of their differences, compressed."""
    step = np.diff(x.astype(np.int64).view(np.uint64), prepend=np.uint64(0))
    raw = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


# ---------------------------------------------------------------- distances along a lag

Along = Callable[[int, int], np.ndarray]


def masked(missing: np.ndarray, size: np.ndarray, fn: Along) -> Along:
    """fn with nulls where an item is missing or sizes differ."""
    if not missing.any() and len(np.unique(size)) <= 1:
        return fn
    m, s = np.tile(missing, 2), np.tile(size, 2)
    return lambda d, w: np.where(m[:w] | m[d : d + w] | (s[:w] != s[d : d + w]), NULL, fn(d, w))


def angle(center: bool):
    def prepare(column: pa.Array) -> Along:
        x, size, missing = pr.vectors(column)
        x, missing = pr.unit(pr.centered(x, size) if center else x, missing)
        x = np.concatenate((x, x))
        return masked(missing, size, lambda d, w: 1.0 - np.einsum("ij,ij->i", x[:w], x[d : d + w]))

    return prepare


def euclidean(column: pa.Array) -> Along:
    x, size, missing = pr.vectors(column)
    x = np.concatenate((x, x))

    def fn(d, w):
        gap = x[:w] - x[d : d + w]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    return masked(missing, size, fn)


def cityblock(column: pa.Array) -> Along:
    missing, x = np.asarray(column.is_null()), np.tile(np.asarray(pc.fill_null(column.cast(pa.float64()), 0.0)), 2)
    return masked(missing, np.zeros(len(missing)), lambda d, w: np.abs(x[:w] - x[d : d + w]))


def hamming(column: pa.Array) -> Along:
    missing, x = np.asarray(column.is_null()), np.tile(np.asarray(pc.fill_null(column.dictionary_encode().indices, -1)), 2)
    return masked(missing, np.zeros(len(missing)), lambda d, w: (x[:w] != x[d : d + w]).astype(float))


ALONG = {"correlation": angle(True), "cosine": angle(False), "euclidean": euclidean, "cityblock": cityblock, "hamming": hamming}

# ---------------------------------------------------------------- strips and blocks


class Block:
    """Neighbouring lags of a strip: arrays of (lags, pairs of a lag)."""

    def __init__(self, strip: Strip, number: int, lags: range, width: int):
        self.strip, self.number, self.lags, self.width, self.held = strip, number, lags, width, {}

    def value(self, name: str) -> np.ndarray:
        if name not in self.held:
            own = self.strip.derived.get(name)
            self.held[name] = own(self) if own else np.array([self.strip.along[name](d, self.width) for d in self.lags])
        return self.held[name]

    def rank(self, name: str) -> np.ndarray:
        """Average ranks of the group's values, less their middle."""
        if ("rank", name) not in self.held:
            self.held["rank", name] = looked_up(self.value(name), self.strip.ranks[self.number, name]) - (self.strip.total + 1) / 2.0
        return self.held["rank", name]

    def model(self, name: str) -> np.ndarray:
        return self.strip.models[name]


def looked_up(x: np.ndarray, notes: list) -> np.ndarray:
    """The ranks that slices, (slice, rows before it, payload), gave to x."""
    distinct, inverse = np.unique(ordered(x.ravel()), return_inverse=True)
    ranks = np.concatenate([unpacked(p) / 2.0 + base for _, base, p in sorted(notes)])
    if len(ranks) != len(distinct):
        raise ValueError("distances are not what they were when they were ranked")
    return ranks[inverse].reshape(x.shape)


class Strip:
    def __init__(self, rows: pa.Table, notes: pa.Table, metrics: dict[str, str], derived: dict, block: int):
        rows = rows.sort_by("__item")
        self.along = {name: ALONG[m](rows.column(name).combine_chunks()) for name, m in metrics.items()}
        self.n, self.number, self.strips = rows.num_rows, rows.column("__strip")[0].as_py(), rows.column("__strips")[0].as_py()
        self.total, self.derived, self.block = self.n * (self.n - 1) // 2, derived, block
        self.ranks, self.models = {}, {}
        for b, name, s, base, p in zip(*(notes.column(x).to_pylist() for x in ("block", "name", "slice", "base", "payload"))):
            if b < 0:
                self.models[name] = np.frombuffer(p)
            else:
                self.ranks.setdefault((b, name), []).append((s, base, p))

    def blocks(self) -> Iterator[Block]:
        every = self.n // 2
        first, last = (every * k // self.strips + 1 for k in (self.number, self.number + 1))
        full = min(last, (self.n + 1) // 2)  # lag n / 2 has each pair once, so it is a block of its own
        step = max(1, self.block // max(1, self.n))
        for number, d in enumerate(range(first, full, step)):
            yield Block(self, number, range(d, min(d + step, full)), self.n)
        if full < last:
            yield Block(self, 1 << 30, range(full, last), self.n // 2)


def large(items: DataFrame, group: str) -> bool:
    """Whether a group has more pairs than a task ranks as arrays. Both ways give the same rows, so this only chooses a plan."""
    n = items.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return n * (n - 1) // 2 > rk.SMALL


class Pairs:
    """All pairs of the items (group, item from 0), their distances by name (as in pairs.distances()), and what is known of them so far."""

    def __init__(self, items: DataFrame, group: str, item: str, block: int = 0, **metrics: tuple[str, Column]):
        self.group, self.metrics, self.block = group, {name: m for name, (m, _) in metrics.items()}, block or BLOCK
        self.derived: dict[str, Callable[[Block], np.ndarray]] = {}
        self.made: dict[str, tuple[str, list[str], int]] = {}
        self.ranked: set[str] = set()
        rows = items.select(F.col(group).alias("__group"), F.col(item).alias("__item"), *(pr.METRICS[m][0](x).alias(name) for name, (m, x) in metrics.items())).where("__group is not null and __item is not null")
        n = F.count("*")
        strips = F.least(F.lit(MOST), F.greatest(F.lit(1), F.least(F.floor(n / 2), F.ceil(n * (n - 1) / 2 / self.block)))).cast("int")
        self.strips = rows.groupBy(F.col("__group").alias("__g")).agg(strips.alias("__strips")).withColumn("__strip", F.explode(F.sequence(F.lit(0), F.col("__strips") - 1)))
        self.rows = rows.join(self.strips, F.col("__group") == F.col("__g")).drop("__g")
        self.items = rows.withColumnsRenamed({name: f"m_{name}" for name in metrics})
        self.kind = rows.schema["__group"]
        self.notes = items.sparkSession.createDataFrame([], self.schema(NOTE))

    def schema(self, fields: str) -> T.StructType:
        return T.StructType([T.StructField("__group", self.kind.dataType), *T._parse_datatype_string(fields).fields])

    def each(self, fn: Callable[[Strip], Iterator[tuple]], fields: str) -> DataFrame:
        """(group, fields) of the rows that fn gives for each strip."""
        schema, metrics, derived, block = self.schema(fields), self.metrics, self.derived, self.block
        names = schema.names[1:]

        def run(rows: pa.Table, notes: pa.Table) -> pa.Table:
            got = list(fn(Strip(rows, notes, metrics, derived, block))) if rows.num_rows else []
            group = rows.column("__group") if rows.num_rows else notes.column("__group")
            return pa.table({"__group": pa.repeat(group[0], len(got)), **{x: pa.array([g[k] for g in got], pr.to_arrow_type(schema[x].dataType)) for k, x in enumerate(names)}})

        return self.rows.groupBy("__group", "__strip").cogroup(self.notes.withColumn("__strip", F.col("strip")).groupBy("__group", "__strip")).applyInArrow(run, schema)

    def know(self, name: str, model: DataFrame) -> None:
        """Tells all strips a group's array (group, payload)."""
        model = kept(model).join(self.strips, F.col("__group") == F.col("__g"))
        self.notes = self.notes.unionByName(model.select("__group", F.col("__strip").alias("strip"), F.lit(-1).alias("block"), F.lit(name).alias("name"), F.lit(0).alias("slice"), F.lit(0).cast("long").alias("base"), "payload"))

    def shift(self, shifts: DataFrame) -> None:
        """Tells all strips their group's shifts (group, shifts: one a permutation, in order)."""

        def run(table: pa.Table) -> pa.Table:
            return pa.table({"__group": table.column("__group"), "payload": pa.array([np.array(s, float).tobytes() for s in table.column("shifts").to_pylist()], pa.binary())})

        rows = shifts.select(F.col(self.group).alias("__group"), "shifts")
        self.know("shifts", rows.groupBy("__group").applyInArrow(run, self.schema("payload binary")))

    def rank(self, *names: str) -> None:
        """Ranks values within their group, for Block.rank(); once each."""
        names = tuple(x for x in names if x not in self.ranked)
        if not names:
            return
        self.ranked.update(names)

        def shown(strip: Strip):
            for b in strip.blocks():
                for x in names:
                    yield x, strip.total, show(b.value(x))
                return

        def sent(strip: Strip):
            for b in strip.blocks():
                for x in names:
                    for s, values, counts in cut(b.value(x), b.model(f"bounds {x}")):
                        yield strip.number, b.number, x, s, values, counts

        bounds = self.bounds(self.each(shown, SHOW))
        for x in names:
            self.know(f"bounds {x}", bounds.where(F.col("name") == x).select("__group", "payload"))
        self.notes = self.notes.unionByName(ranked_slices(self.each(sent, SENT), self.schema(NOTE)))

    def bounds(self, shown: DataFrame) -> DataFrame:
        """(group, name, payload): where the slices of a group's values begin, about a block's pairs in each."""
        size, kind = self.block, self.schema("name string, payload binary")

        def run(table: pa.Table) -> pa.Table:
            every = np.sort(np.concatenate([np.frombuffer(p, np.int64) for p in table.column("payload").to_pylist()]))
            k = max(1, -(-table.column("total")[0].as_py() // size))
            at = np.unique(every[np.arange(1, k) * len(every) // k]) if len(every) else every
            return pa.table({"__group": table.column("__group")[:1], "name": table.column("name")[:1], "payload": pa.array([at.tobytes()], pa.binary())})

        return kept(shown.groupBy("__group", "name").applyInArrow(run, kind))

    def sums(self, fn: Callable[[Block], np.ndarray]) -> DataFrame:
        """(group, payload): an array that adds up over a group's blocks."""

        def run(strip: Strip):
            total = sum((fn(b) for b in strip.blocks()), 0.0)
            if strip.total:
                yield (np.asarray(total, float).tobytes(),)

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(p) for p in table.column("payload").to_pylist()], axis=0)
            return pa.table({"__group": table.column("__group")[:1], "payload": pa.array([total.tobytes()], pa.binary())})

        return self.each(run, "payload binary").groupBy("__group").applyInArrow(add, self.schema("payload binary"))

    def products(self, names: list[str]) -> DataFrame:
        """(group, payload): mean products of centred ranks over the group's number of pairs, names by names, and that number."""

        def fn(b: Block) -> np.ndarray:
            m = np.array([b.rank(x).ravel() / b.strip.total for x in names])
            return np.append((m @ m.T / b.strip.total).ravel(), m.shape[1])

        return self.sums(fn)

    def summed(self, names: list[str]) -> DataFrame:
        """products() by slices, or by ranks that are exchanged."""
        got = self.ranked_products(names)
        if got is None:
            self.rank(*names)
            got = self.products(names)
        return got

    def sizes(self) -> dict:
        return dict(sorted((r["__group"], r["n"]) for r in self.items.groupBy("__group").agg(F.count("*").alias("n")).collect()))

    def by_size(self, most: int, slices: Callable, cells: Callable, *more) -> dict | None:
        """What slices(items, sizes, *more) gives for groups of so many pairs at most, and cells() for the others; None where one does not take its groups."""
        out: dict = {}
        sizes = self.sizes()
        over = {g for g, n in sizes.items() if n * (n - 1) // 2 > most}
        for fn, own in ((slices, {g: n for g, n in sizes.items() if g not in over}), (cells, {g: n for g, n in sizes.items() if g in over})):
            if own or not sizes:
                got = fn(self.items, own, *more)
                if got is None:
                    return None
                out |= got
        return out

    def alike(self) -> dict | None:
        """sizes() of subjects with the same items."""
        sizes = self.sizes()
        return sizes if len(set(sizes.values())) == 1 else None

    def pairs_of(self, sizes: dict) -> int:
        n = next(iter(sizes.values()))
        return n * (n - 1) // 2

    def ranked_products(self, names: list[str], moved: str | None = None, shifts: DataFrame | None = None) -> DataFrame | None:
        """products() of values as they are, and with shifts those of each shift's moved value with the others, by slices; None where these don't take it."""
        by = None if shifts is None else {r[self.group]: r["shifts"] for r in shifts.select(self.group, "shifts").collect()}
        got = self.by_size(ce.ALONE, sl.of_groups, ce.of_groups, {x: self.metrics[x] for x in names}, names, moved, by)
        return None if got is None else self.rows.sparkSession.createDataFrame([(g, bytearray(x.tobytes())) for g, x in got.items()], self.schema("payload binary"))

    def answers(self, sums: DataFrame, fn: Callable[[np.ndarray], Iterator[tuple]], fields: str) -> DataFrame:
        """(group, fields) of the rows that fn makes of a group's array."""
        schema = self.schema(fields)

        def run(table: pa.Table) -> pa.Table:
            got = list(fn(np.frombuffer(table.column("payload")[0].as_py())))
            return pa.table({"__group": pa.repeat(table.column("__group")[0], len(got)), **{x: pa.array([g[k] for g in got], pr.to_arrow_type(schema[x].dataType)) for k, x in enumerate(schema.names[1:])}})

        return sums.groupBy("__group").applyInArrow(run, schema).withColumnRenamed("__group", self.group)


# ---------------------------------------------------------------- slices

SHOW = "name string, total long, payload binary"
SENT = "strip int, block int, name string, slice int, values binary, counts binary"


def show(x: np.ndarray) -> bytes:
    x = np.sort(ordered(x.ravel()))
    return x[np.linspace(0, len(x) - 1, min(len(x), SHOWN)).astype(np.int64)].tobytes()


def cut(x: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(slice, distinct values, how often each is there if any is there twice) by a group's bounds."""
    distinct, counts = np.unique(ordered(x.ravel()), return_counts=True)
    at = np.concatenate(([0], np.searchsorted(distinct, bounds.view(np.int64)), [len(distinct)]))
    for s in range(len(at) - 1):
        lo, hi = at[s], at[s + 1]
        if lo < hi:
            own = counts[lo:hi]
            yield s, packed(distinct[lo:hi]), own.astype(np.int64).tobytes() if (own > 1).any() else None


def rank_slice(table: pa.Table) -> pa.Table:
    """Twice the ranks within the slice of each block's values, and how many rows the slice has."""
    lists = [unpacked(p) for p in table.column("values").to_pylist()]
    counts = [np.ones(len(x), np.int64) if c is None else np.frombuffer(c, np.int64) for x, c in zip(lists, table.column("counts").to_pylist())]
    distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
    twice = (2 * np.cumsum(n) - n + 1)[inverse]
    at = np.cumsum([0, *map(len, lists)])
    payload = pa.array([packed(twice[a:b]) for a, b in zip(at, at[1:])], pa.binary())
    return pa.table({**{x: table.column(x) for x in ("__group", "strip", "block", "name", "slice")}, "base": pa.repeat(pa.scalar(int(n.sum()), pa.int64()), table.num_rows), "payload": payload})


def ranked_slices(sent: DataFrame, schema: T.StructType) -> DataFrame:
    """The notes that slices send back; base is the number of rows before a slice."""
    got = kept(sent.groupBy("__group", "name", "slice").applyInArrow(rank_slice, schema))
    sizes = got.groupBy(F.col("__group").alias("__g"), F.col("name").alias("__m"), F.col("slice").alias("__s")).agg(F.first("base").alias("__rows"))
    before = sizes.withColumn("__before", F.sum("__rows").over(Window.partitionBy("__g", "__m").orderBy("__s")) - F.col("__rows"))  # a row a slice
    own = (F.col("__group") == F.col("__g")) & (F.col("name") == F.col("__m")) & (F.col("slice") == F.col("__s"))
    return got.join(F.broadcast(before), own).select("__group", "strip", "block", "name", "slice", F.col("__before").alias("base"), "payload")


# ---------------------------------------------------------------- association


def pearson(g: np.ndarray, a: int, b: int) -> float | None:
    return float(g[a, b] / np.sqrt(g[a, a] * g[b, b])) if g[a, a] > 0 and g[b, b] > 0 else None


def square(payload: np.ndarray, k: int) -> np.ndarray:
    return payload[: k * k].reshape(k, k)


def weights(g: np.ndarray, targets: int, names: list[str]) -> np.ndarray:
    """Least-squares weights (targets by nuisances) of the first ranks on the others."""
    sd = np.sqrt(np.diag(g))
    for name, x in zip(names, sd):
        if not x > 0:
            raise ValueError(f"{name} is constant in a group")
    z = g / np.outer(sd, sd)
    return z[:targets, targets:] @ np.linalg.pinv(z[targets:, targets:]) * sd[:targets, None] / sd[None, targets:]


def rest_of(g: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Products of what nuisances leave of the targets."""
    t = len(beta)
    return g[:t, :t] - beta @ g[t:, :t]


def associations(pairs: Pairs, x: str, others: list[str]) -> DataFrame:
    """(group, other, rho), as ranks.associations()."""
    names = [x, *others]
    return pairs.answers(pairs.summed(names), lambda p: ((o, pearson(square(p, len(names)), 0, k)) for k, o in enumerate(others, 1)), "other string, rho double")


def partial_spearman(pairs: Pairs, x: str, y: str, nuisances: list[str]) -> DataFrame:
    """(group, rho), as ranks.partial_spearman()."""
    names = [x, y, *nuisances]

    def fn(p: np.ndarray):
        g = square(p, len(names))
        yield (pearson(rest_of(g, weights(g, 2, names)), 0, 1),)

    return pairs.answers(pairs.summed(names), fn, "rho double")


def fitted(names: list[str], targets: int) -> Callable[[np.ndarray], np.ndarray]:
    """Mean products of ranks -> the weights of nuisances by target, and the targets' deviations."""

    def fit(g: np.ndarray) -> np.ndarray:
        beta = weights(g, targets, names)
        return np.append(beta.ravel(), np.sqrt(np.maximum(np.diag(rest_of(g, beta)), 0.0)))

    return fit


def residuals(pairs: Pairs, targets: list[str], nuisances: list[str], places: int | None = None) -> None:
    """Adds values e_<target>: what the nuisances' ranks leave of the target's, over its deviation, to so many places. All are ranked."""
    names, k = [*targets, *nuisances], len(targets)
    pairs.rank(*names)

    def fit(p: np.ndarray):
        yield (fitted(names, k)(square(p, len(names))).tobytes(),)

    group = pairs.group
    pairs.know("residuals", pairs.answers(pairs.products(names), fit, "payload binary").withColumnRenamed(group, "__group"))

    def rest(at: int):
        def fn(b: Block) -> np.ndarray:
            model = b.model("residuals")
            beta, sd = model[: k * len(nuisances)].reshape(k, -1), model[k * len(nuisances) :]
            e = b.rank(targets[at]) - sum(w * b.rank(x) for w, x in zip(beta[at], nuisances))
            e = e / b.strip.total / sd[at] if sd[at] > 0 else np.full(e.shape, np.nan)
            return e if places is None else np.round(e, places)

        return fn

    pairs.derived |= {f"e_{t}": rest(at) for at, t in enumerate(targets)}


def residual(pairs: Pairs, name: str, target: str, nuisances: list[str], places: int) -> None:
    """residuals() of one target as value name, made where it is asked for."""
    pairs.made[name] = target, nuisances, places


def made(pairs: Pairs, name: str) -> None:
    if name in pairs.made and name not in pairs.derived:
        target, nuisances, places = pairs.made[name]
        residuals(pairs, [target], nuisances, places)
        pairs.derived[name] = pairs.derived[f"e_{target}"]


def partial_spearman_of_residuals(pairs: Pairs, x: str, y: str, nuisances: list[str]) -> DataFrame:
    """(group, rho), as ranks.partial_spearman_of_residuals(), by slices, or by ranks that are exchanged."""
    got = pairs.by_size(ce.OVER, sl.of_residuals, ce.of_residuals, pairs.metrics, [x, y], nuisances, fitted([x, y, *nuisances], 2), 9)
    if got is not None:
        return pairs.rows.sparkSession.createDataFrame([(g, pearson(m, 0, 1)) for g, m in got.items()], pairs.schema("rho double")).withColumnRenamed("__group", pairs.group)
    residuals(pairs, [x, y], nuisances, 9)
    names = [f"e_{x}", f"e_{y}"]
    pairs.rank(*names)
    return pairs.answers(pairs.products(names), lambda p: [(pearson(square(p, 2), 0, 1),)], "rho double")


def shifted_statistics(pairs: Pairs, shifts: DataFrame, x: str, y: str, nuisances: list[str]) -> tuple[DataFrame, DataFrame]:
    """((group, perm, stat), (group, rho)): the partial association of x with y whose items are shifted in a circle, as
    permute.null_statistics() gives it for such plans, and without a shift. shifts: (group, shifts: one a permutation, in order)."""
    names, k = [x, y, *nuisances], len(nuisances)

    def fn(b: Block) -> np.ndarray:
        """The ranks' products, and each permutation's products of the moved y with x and the nuisances."""
        m = np.array([b.rank(v).ravel() / b.strip.total for v in names])
        own, moved = np.delete(m, 1, axis=0), m[1].reshape(len(b.lags), b.width)
        each = [own @ np.roll(moved, int(s) % b.width, axis=1).ravel() for s in b.model("shifts")]
        return np.concatenate(((m @ m.T).ravel(), *each)) / b.strip.total

    def stats(p: np.ndarray):
        g = square(p, k + 2)
        beta = weights(g, 2, names)
        e = rest_of(g, beta)
        yield -1, pearson(e, 0, 1)
        inverse = np.linalg.pinv(g[2:, 2:])
        for perm, h in enumerate(p[(k + 2) ** 2 :].reshape(-1, k + 1)):
            rest = g[1, 1] - h[1:] @ inverse @ h[1:]
            yield perm, float((h[0] - beta[0] @ h[1:]) / np.sqrt(e[0, 0] * rest)) if rest > 1e-12 * g[1, 1] and e[0, 0] > 0 else 0.0

    sums = pairs.ranked_products(names, y, shifts)
    if sums is None:
        pairs.rank(*names)
        pairs.shift(shifts)
        sums = pairs.sums(fn)
    every = kept(pairs.answers(sums, stats, "perm long, stat double"))
    return every.where("perm >= 0"), every.where("perm < 0").select(pairs.group, F.col("stat").alias("rho"))


# ---------------------------------------------------------------- subjects together


def met(pairs: Pairs, value: Callable[[Block], np.ndarray], fn: Callable, fields: str, notes: DataFrame | None = None, lags: int | None = None) -> DataFrame:
    """Rows (fields) of fn(subjects, their arrays (lags, pairs), shifts by subject, pairs of a subject, notes, strip, block) for each block of pairs, where all groups' arrays meet.
    Groups are subjects with the same items; lags: only so many of a block."""

    def sent(strip: Strip):
        for b in strip.blocks():
            shifts = strip.models.get("shifts", np.zeros(1))
            yield strip.number, b.number, b.width, strip.total, shifts.tobytes(), pa.Codec("zstd", 1).compress(value(b)[:lags].astype(float).tobytes(), asbytes=True), value(b)[:lags].size

    schema = T.StructType([pairs.kind, *T._parse_datatype_string(fields).fields])
    left = pairs.each(sent, "strip int, block int, width int, total long, shifts binary, payload binary, size long").groupBy("strip", "block")
    right = (pairs.notes.limit(0) if notes is None else notes).groupBy("strip", "block")

    def run(rows: pa.Table, notes: pa.Table) -> pa.Table:
        got = []
        if rows.num_rows:
            rows = rows.sort_by("__group")
            width = rows.column("width")[0].as_py()
            arrays = [np.frombuffer(pa.Codec("zstd").decompress(p, 8 * n, asbytes=True)).reshape(-1, width) for p, n in zip(rows.column("payload").to_pylist(), rows.column("size").to_pylist())]
            known: dict = {}
            for g, name, s, base, p in zip(*(notes.column(x).to_pylist() for x in ("__group", "name", "slice", "base", "payload"))):
                known.setdefault((g, name), []).append((s, base, p))
            shifts = [np.frombuffer(s).astype(np.int64) for s in rows.column("shifts").to_pylist()]
            got = list(fn(rows.column("__group").to_pylist(), arrays, shifts, rows.column("total")[0].as_py(), known, rows.column("strip")[0].as_py(), rows.column("block")[0].as_py()))
        return pa.table({x.name: pa.array([g[k] for g in got], pr.to_arrow_type(x.dataType)) for k, x in enumerate(schema)})

    return left.cogroup(right).applyInArrow(run, schema)


def rests(arrays: list[np.ndarray], shifts: list[np.ndarray], perm: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(own, mean of the others) of each subject, shifted; a null stays one and adds nothing."""
    moved = [np.roll(x, int(s[perm]) % x.shape[1], axis=1) for x, s in zip(arrays, shifts)]
    total = sum(np.where(x == NULL, 0.0, x) for x in moved)
    for x in moved:
        yield x, np.where(x == NULL, NULL, (total - np.where(x == NULL, 0.0, x)) / (len(moved) - 1) if len(moved) > 1 else NULL)


def relative(by: dict, n: int) -> tuple[dict, list[list[int]]]:
    """(shifts less the first group's, which are taken once each; the permutations that have them). What all groups are shifted alike reorders
    their pairs, and changes no rank."""
    groups, alike = list(by), {}
    for perm, each in enumerate(zip(*by.values())):
        alike.setdefault(tuple((int(s) - int(each[0])) % max(1, n) for s in each), []).append(perm)
    return {g: [own[k] for own in alike] for k, g in enumerate(groups)}, list(alike.values())


def leave_one_out(pairs: Pairs, value: str, shifts: DataFrame | None = None) -> DataFrame:
    """(perm, subject, rho): each subject's value against the mean of the others', as reliability.leave_one_out(), and as
    permute.rotated_leave_one_out() if shifts (group, shifts: one a permutation, in order) are given."""
    sizes = pairs.alike()
    if sizes is not None and (value in pairs.metrics or value in pairs.made):
        by = {g: [0] for g in sizes} if shifts is None else {r[pairs.group]: r["shifts"] for r in shifts.select(pairs.group, "shifts").collect()}
        by, alike = relative(by, next(iter(sizes.values())))
        got, n = None, pairs.pairs_of(sizes)
        if value in pairs.made:
            target, nuisances, places = pairs.made[value]
            if n > sl.WHOLE:
                got = ce.of_subjects(pairs.items, sizes, pairs.metrics, target, by, ce.Residual(nuisances, fitted([target, *nuisances], 1), places))
        elif n > ce.OVER:
            got = ce.of_subjects(pairs.items, sizes, pairs.metrics, value, by)
        else:
            got = sl.of_subjects(pairs.items, sizes, (value, pairs.metrics[value]), by)
        if got is not None:
            got = [(perm, g, rho) for p, g, rho in got for perm in alike[p]]
            return pairs.rows.sparkSession.createDataFrame(got, T.StructType([T.StructField("perm", T.IntegerType()), T.StructField(pairs.group, pairs.kind.dataType), T.StructField("rho", T.DoubleType())]))
    made(pairs, value)
    pairs.rank(value)
    if shifts is not None:
        pairs.shift(shifts)
    own = lambda b: b.value(value)
    kind = pairs.kind

    def shown(subjects, arrays, shifts, total, known, strip, block):
        for perm in range(len(shifts[0])):
            for s, (_, rest) in zip(subjects, rests(arrays, shifts, perm)):
                yield s, f"rest {perm}", total, show(rest)

    limits = pairs.bounds(met(pairs, own, shown, SHOW, lags=1))
    places = pairs.notes.where(F.col("block") >= 0).select("__group", "strip", "block").distinct()
    limits = limits.join(places, "__group").select("__group", "strip", "block", "name", F.lit(0).alias("slice"), F.lit(0).cast("long").alias("base"), "payload")

    def sent(subjects, arrays, shifts, total, known, strip, block):
        for perm in range(len(shifts[0])):
            for s, (_, rest) in zip(subjects, rests(arrays, shifts, perm)):
                for k, values, counts in cut(rest, np.frombuffer(known[s, f"rest {perm}"][0][2])):
                    yield s, strip, block, f"rest {perm}", k, values, counts

    notes = ranked_slices(met(pairs, own, sent, SENT, limits), pairs.schema(NOTE))
    notes = notes.unionByName(pairs.notes.where((F.col("block") >= 0) & (F.col("name") == value)))

    def corr(subjects, arrays, shifts, total, known, strip, block):
        middle = (total + 1) / 2.0
        rank = [(looked_up(x, known[s, value]) - middle) / total for s, x in zip(subjects, arrays)]
        for perm in range(len(shifts[0])):
            for s, r, k, (_, rest) in zip(subjects, rank, shifts, rests(arrays, shifts, perm)):
                a, b = np.roll(r, int(k[perm]) % r.shape[1], axis=1).ravel(), ((looked_up(rest, known[s, f"rest {perm}"]) - middle) / total).ravel()
                yield s, perm, float(a @ b), float(a @ a), float(b @ b)

    sums = met(pairs, own, corr, "perm int, xy double, xx double, yy double", notes).groupBy("perm", kind.name).agg(*(F.sum(x).alias(x) for x in ("xy", "xx", "yy")))
    return sums.select("perm", F.col(kind.name).alias(pairs.group), F.try_divide("xy", F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("rho"))


def subject_matrix(pairs: Pairs, value: str) -> DataFrame:
    """(subject_a, subject_b, rho) for a < b, as reliability.subject_matrix(). value has to be ranked."""
    fields = f"other {pairs.kind.dataType.simpleString()}, n double, x double, y double, xx double, yy double, xy double"

    def products(subjects, arrays, shifts, total, known, strip, block):
        r = np.array([x.ravel() for x in arrays])
        there = np.isfinite(r).astype(float)
        r = np.where(there > 0, r, 0.0)
        square = r * r
        sums = there @ there.T, r @ there.T, there @ r.T, square @ there.T, there @ square.T, r @ r.T
        for a in range(len(subjects)):
            for b in range(a + 1, len(subjects)):
                yield (subjects[a], subjects[b], *(float(s[a, b]) for s in sums))

    ranks = lambda b: np.where(b.value(value) == NULL, np.nan, b.rank(value) / b.strip.total)
    names = sl.MEETING
    sums = met(pairs, ranks, products, fields).groupBy("__group", "other").agg(*(F.sum(x).alias(x) for x in names))
    return sums.select(F.col("__group").alias("subject_a"), F.col("other").alias("subject_b"), agreed().alias("rho"))


def agreement(pairs: Pairs, value: str) -> DataFrame:
    """subject_matrix(), by cells where groups have too many pairs to send them."""
    sizes = pairs.alike()
    if value in pairs.metrics and sizes is not None and pairs.pairs_of(sizes) > sl.WHOLE:
        got = ce.matrices(pairs.items, sizes, pairs.metrics, value)
        if got is not None:
            return named(pairs, *got).drop("kind")
    made(pairs, value)
    pairs.rank(value)
    return subject_matrix(pairs, value)


def named(pairs: Pairs, groups: list, sums: DataFrame) -> DataFrame:
    name = F.array(*(F.lit(g).cast(pairs.kind.dataType) for g in groups))
    return sums.select("kind", F.get(name, F.col("a")).alias("subject_a"), F.get(name, F.col("b")).alias("subject_b"), agreed().alias("rho"))


def agreed() -> Column:
    n, x, y, xx, yy, xy = (F.col(c) for c in sl.MEETING)
    return F.try_divide(n * xy - x * y, F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y))


def agreement_of_residuals(pairs: Pairs, value: str, nuisances: list[str]) -> DataFrame | None:
    """(kind, subject_a, subject_b, rho): subject_matrix() of a value (raw) and of its residuals() to nine places (residual), by slices; None where these don't take it."""
    sizes = pairs.alike()
    if sizes is None:
        return None
    fit = fitted([value, *nuisances], 1)
    if pairs.pairs_of(sizes) > ce.OVER:
        got = ce.matrices(pairs.items, sizes, pairs.metrics, value, ce.Residual(nuisances, fit, 9))
    else:
        got = sl.matrices(pairs.items, sizes, pairs.metrics, value, nuisances, fit, 9)
    return None if got is None else named(pairs, *got)
