"""Sums of products of ranks over all pairs of a group's items, where no pair leaves its task.

Items are numbered from 0, and pairs are gone through by tiles of items. A table of the group's gives each value a bucket, of BUCKETS that are
about equally full, and counting them gives the mean rank of a bucket's pairs. With u and v the means of a pair's two ranks, and e and f what
the ranks have besides, the sum over pairs of (u + e) (v + f) has three parts:

- sum of u v: pairs are dealt by tiles;
- sums of e v and u f: buckets are dealt into slices of about SLICE pairs. A task goes through all its group's pairs, keeps the values of its
  slice, and ranks them exactly. A bucket whose pairs have one value, however many they are, has no e and is in no slice;
- sum of e f: not computed, but it is at most sqrt(sum of e e * sum of f f), and a bucket of n pairs has n^3 / 12 of these sums at most. Where
  that is over BOUND of the ranks' own sums, or a bucket alone is over a slice, nothing is returned, and the caller ranks pairs by exchanging them.

A group of up to WHOLE pairs is one task's.

Distances are computed again by each slice, so the work is pairs * pairs / SLICE, and what goes to disk are the items and the counts.

Values that are made of a pair's exact ranks (residuals) need them for every pair. A pair's bucket is known by its value, so a slice leaves the places
within buckets only, in the order of pairs: about a byte for each pair and value, which are written once and which tasks of the group read (Placed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import pairs as pr

BUCKETS, TILE, PART, SLICE, BOUND = 1 << 16, 512, 1 << 23, 1 << 23, 1e-9
#: Pairs of a group that one task ranks as they are. Over fewer pairs than these, buckets of two would be too many for BOUND.
WHOLE = 1 << 20
#: Pairs of a group whose places within buckets a task may hold, as they are compressed.
PLACED = 1 << 27
#: A distance that is null; it ranks before all others.
NULL = -np.inf

# ---------------------------------------------------------------- buckets


def zipped(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + x.dtype.char.encode() + pa.Codec("zstd", 1).compress(x.tobytes(), asbytes=True)


def unzipped(raw: bytes) -> np.ndarray:
    n, kind = int.from_bytes(raw[:8], "little"), np.dtype(raw[8:9].decode())
    return np.frombuffer(pa.Codec("zstd").decompress(raw[9:], n * kind.itemsize, asbytes=True), kind)


def planed(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as planes of their bytes, compressed."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return zipped(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), kind.itemsize).T).ravel()) + bytes([kind.itemsize])


def unplaned(raw: bytes) -> np.ndarray:
    size = raw[-1]
    planes = unzipped(raw[:-1]).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel()


class Buckets:
    """Bucket 0 is for nulls, the last one for NaN. The range of values has cells of one width, and a cell as many buckets as it takes."""

    def __init__(self, model: np.ndarray):
        self.low, self.scale, self.base = model[0], model[1], model[2:].astype(np.int32)
        self.inside, self.size = np.diff(self.base).astype(float), int(self.base[-1]) + 2

    @staticmethod
    def model(x: np.ndarray, buckets: int) -> np.ndarray:
        """From some of the values; they only balance buckets."""
        x, cells = x[np.isfinite(x)], max(1, buckets >> 4)
        low, high = (x.min(), x.max()) if len(x) else (0.0, 0.0)
        scale = cells / (high - low) if high > low and np.isfinite(cells / (high - low)) else 0.0
        n = np.bincount(np.minimum((x - low) * scale, cells - 1).astype(np.int64), minlength=cells)
        inside = 4 + (n * max(0, buckets - 4 * cells - 2) // max(1, len(x)))
        return np.concatenate(([low, scale, 1], 1 + np.cumsum(inside)))

    def range(self, low: int, high: int) -> tuple[float, float]:
        """Values outside are in no bucket from low to high - 1; a cell more on each side, so that rounding doesn't matter."""
        a, b = np.searchsorted(self.base, low, side="right") - 2, np.searchsorted(self.base, high, side="left") + 1
        return self.low + a / self.scale if a > 0 else -np.inf, self.low + b / self.scale if b < len(self.inside) else np.inf

    def of(self, x: np.ndarray) -> np.ndarray:
        odd = ~np.isfinite(x)
        some = odd.any()
        t = (np.where(odd, np.where(x == np.inf, self.low + (len(self.inside) / self.scale if self.scale else 0.0), self.low), x) if some else x) - self.low
        t *= self.scale
        np.clip(t, 0, len(self.inside) - 1e-6, out=t)
        cell = t.astype(np.int32)
        t -= cell
        t *= self.inside[cell]
        out = self.base[cell] + t.astype(np.int32)
        if some:
            out[x == NULL] = 0
            out[np.isnan(x)] = self.size - 1
        return out


class Counts:
    """How many pairs a bucket has, and whether they have one value."""

    def __init__(self, size: int):
        self.n, self.mixed, self.one = np.zeros(size, np.int64), np.zeros(size, bool), np.full(size, np.nan)

    def add(self, x: np.ndarray, code: np.ndarray) -> None:
        self.n += np.bincount(code, minlength=len(self.n))
        left = np.flatnonzero(~self.mixed[code])
        if len(left):
            code, x = code[left], x[left]
            new = np.isnan(self.one[code])
            self.one[code[new]] = x[new]
            self.mixed[code[(x != self.one[code]) & ~np.isnan(x)]] = True

    def merge(self, n: np.ndarray, mixed: np.ndarray, one: np.ndarray) -> None:
        self.n = self.n + n
        self.mixed = self.mixed | mixed | ((self.one != one) & ~np.isnan(self.one) & ~np.isnan(one))
        self.one = np.where(np.isnan(self.one), one, self.one)

    def packed(self) -> bytes:
        return b"".join(len(x).to_bytes(8, "little") + x for x in (zipped(self.n), zipped(self.mixed), zipped(np.where(self.mixed, np.nan, self.one))))

    @staticmethod
    def unpacked(raw: bytes) -> list[np.ndarray]:
        out = []
        while raw:
            n = int.from_bytes(raw[:8], "little")
            out.append(unzipped(raw[8 : 8 + n]))
            raw = raw[8 + n :]
        return out


def means(n: np.ndarray) -> np.ndarray:
    """Mean rank of each bucket less that of all, over their number."""
    total = max(1, int(n.sum()))
    return (np.cumsum(n) - (n - 1) / 2.0 - (total + 1) / 2.0) / total


# ---------------------------------------------------------------- values of tiles


class View:
    """Values of tiles by site, computed once a tile."""

    n: int

    def told(self, notes: dict) -> None:
        """Takes what is known of tables, by (name, stage)."""

    def at(self, a: np.ndarray, b: np.ndarray, tile: int | None = None) -> None:
        self.a, self.b, self.tile, self.held = a, b, tile, {}
        self.mask = a[:, None] < b[None, :] if a[0] == b[0] else None

    def shifted(self, cell: pr.Cell, shift: int) -> np.ndarray:
        d, missing = cell((self.a - shift) % self.n, (self.b - shift) % self.n)
        d = np.where(missing, NULL, d) if missing.any() else d
        return d[self.mask] if self.mask is not None else d.ravel()

    def value(self, site: tuple) -> np.ndarray:
        if site not in self.held:
            self.held[site] = self.made(site)
        return self.held[site]


def euclidean(column: pa.Array) -> pr.Cell:
    """By products, and by differences where these would cancel."""
    x, size, missing = pr.vectors(column)
    square = np.einsum("ij,ij->i", x, x)

    def cell(a, b):
        both = square[a][:, None] + square[b][None, :]
        d = both - 2.0 * (x[a] @ x[b].T)
        p, q = np.nonzero(~(d > 1e-3 * both))
        for k in range(0, len(p), 1 << 16):
            gap = x[a[p[k : k + (1 << 16)]]] - x[b[q[k : k + (1 << 16)]]]
            d[p[k : k + (1 << 16)], q[k : k + (1 << 16)]] = np.einsum("ij,ij->i", gap, gap)
        return np.sqrt(d), pr.either(missing, a, b) | (size[a][:, None] != size[b][None, :])

    return cell


def cell_of(metric: str, column: pa.ChunkedArray) -> pr.Cell:
    return (euclidean if metric == "euclidean" else pr.METRICS[metric][1])(column.combine_chunks())


class Group(View):
    """Sites (name, shift): a distance of one group's items, each taken by the item so many places before."""

    def __init__(self, items: pa.Table, metrics: dict[str, str], group):
        items = items.filter(pc.equal(items.column("__group"), pa.scalar(group, items.schema.field("__group").type))).sort_by("__item")
        self.n, self.cells = items.num_rows, {x: cell_of(m, items.column(f"m_{x}")) for x, m in metrics.items()}

    def made(self, site):
        return self.shifted(self.cells[site[0]], site[1])


class Placed(View):
    """Sites ("value", name), ("rank", name): exact ranks less their middle, over the number of pairs, ("e", target): what the weights of the
    nuisances' ranks leave of the target's, over its deviation, and ("rank e", target): its ranks in turn. A group without counts is small, and is ranked here; of pairs that
    are not a tile's, ranks are their buckets' means."""

    def __init__(self, items: pa.Table, metrics: dict[str, str], group, targets: list[str], nuisances: list[str], places: int):
        self.own = Group(items, metrics, group)
        self.n, self.targets, self.nuisances, self.places = self.own.n, targets, nuisances, places

    @staticmethod
    def table(notes: dict, name: str, total: int) -> tuple:
        n, mixed = notes[name, "counts"][:2]
        return Buckets(notes[name, "buckets"][0]), means(n), (np.cumsum(n) - n - (total + 1) / 2.0) / total, mixed

    @staticmethod
    def counted(x: list[np.ndarray]) -> tuple:
        values, n = np.unique(np.concatenate(x) if x else np.zeros(0), return_counts=True)
        return values, means(n)

    def told(self, notes):
        self.tables, self.exact, self.left, total = {}, {}, {}, max(1, self.n * (self.n - 1) // 2)
        for name in self.own.cells:
            if (name, "counts") in notes:
                self.tables[name] = self.table(notes, name, total)
            else:
                self.exact[name] = self.counted([self.own.value((name, 0)) for _ in tiles(self.own)])
        for (name, stage), raw in notes.items():
            if stage[0].isdigit():
                tile, low, high = map(int, stage.split())
                self.left.setdefault((name, tile), []).append((low, high, raw))
        self.weights = notes.get(("weights", "weights"), [None])[0]
        for t in self.targets if self.weights is not None else ():
            if (f"e {t}", "counts") in notes:
                self.tables[f"e {t}"] = self.table(notes, f"e {t}", total)
            elif self.exact:
                self.exact[f"e {t}"] = self.counted([self.value(("e", t)) for _ in tiles(self)])

    def at(self, a, b, tile=None):
        super().at(a, b, tile)
        self.own.at(a, b, tile)

    def made(self, site):
        kind, name = site
        if kind == "value":
            self.own.mask = self.mask
            return self.own.value((name, 0))
        if kind == "rank":
            return self.ranked(name, self.value(("value", name)))
        if kind == "rank e":
            return self.ranked(f"e {name}", self.value(("e", name)))
        k, at = len(self.nuisances), self.targets.index(name)
        beta, sd = self.weights[at * k : (at + 1) * k], self.weights[len(self.targets) * k + at]
        e = self.value(("rank", name)) - sum(w * self.value(("rank", x)) for w, x in zip(beta, self.nuisances))
        return np.round(e / sd, self.places) if sd > 0 else np.full(e.shape, np.nan)

    def ranked(self, name, x):
        if name in self.exact:
            values, mean = self.exact[name]
            return mean[np.minimum(np.searchsorted(values, x), len(values) - 1)]
        held, mean, floor, mixed = self.tables[name]
        code = held.of(x)
        out = mean[code]
        if self.tile is None:
            return out
        at = np.flatnonzero(mixed[code]).astype(np.int32)
        code, seen = code[at], 0
        for low, high, raw in self.left.get((name, self.tile), []):
            own = np.flatnonzero((code >= low) & (code < high))
            twice = unplaned(raw)
            if len(twice) != len(own):
                raise ValueError("distances are not what they were when they were counted")
            out[at[own]] = floor[code[own]] + twice / (self.n * (self.n - 1.0))
            seen += len(own)
        if seen != len(at):
            raise ValueError("distances are not what they were when they were ranked")
        return out


class Subjects(View):
    """All groups, with the same items. Sites ("own", group, shift) and ("rest", group, shifts of all groups in order): the mean of the others.
    A null stays one and adds nothing."""

    def __init__(self, items: pa.Table, metric: tuple[str, str], groups: list):
        self.groups, (name, kind) = groups, metric
        each = [items.filter(pc.equal(items.column("__group"), pa.scalar(g, items.schema.field("__group").type))).sort_by("__item") for g in groups]
        self.n, self.cells = each[0].num_rows, [cell_of(kind, t.column(f"m_{name}")) for t in each]

    def made(self, site):
        kind, k, shift = site
        if kind == "own":
            return self.shifted(self.cells[k], shift)
        if kind == "total":
            out = 0.0
            for j, s in enumerate(shift):
                x = self.value(("own", j, s))
                lost = x == NULL
                out = out + (np.where(lost, 0.0, x) if lost.any() else x)
            return out
        own = self.value(("own", k, shift[k]))
        lost = own == NULL
        others = len(self.cells) - 1
        if not others:
            return np.full(len(own), NULL)
        return np.where(lost, NULL, (self.value(("total", None, shift)) - np.where(lost, 0.0, own)) / others)


def tiles(view: View, part: int = 0, parts: int = 1, tile: int = TILE) -> Iterator[int]:
    """Moves view from tile to tile."""
    a, b = np.triu_indices(-(-view.n // tile))
    for k in range(len(a) * part // parts, len(a) * (part + 1) // parts):
        view.at(*(np.arange(x * tile, min(view.n, (x + 1) * tile)) for x in (a[k], b[k])), k)
        yield k


# ---------------------------------------------------------------- work


class Work:
    """What is asked of the groups that are looked at together: view(items), sites by table, whose values the table ranks; products
    (key, (table, site), (table, site)); partners by table, in the space of its site: (key, (table, site))."""

    def __init__(self, view: Callable[[pa.Table], View], n: int, sites: dict, products: list, partners: dict):
        self.view, self.n, self.sites, self.products, self.partners = view, n, sites, products, partners

    @property
    def pairs(self) -> int:
        return self.n * (self.n - 1) // 2

    def look(self, items: pa.Table, notes: dict, unit: int) -> View:
        view = self.view(items)
        view.told({(name, stage): x for (u, name, stage), x in notes.items() if u == unit})
        return view


NOTE = "unit int, name string, stage string, payload binary"


def task_sample(work: Work, items: pa.Table, notes: dict, unit: int, buckets: int):
    """From items far apart, and fewer from neighbours, which may be alike."""
    view = work.look(items, notes, unit)
    far = np.linspace(0, view.n - 1, min(view.n, TILE))
    apart = np.unique(far.astype(np.int64)), np.unique((far + view.n / TILE / 2).astype(np.int64) % view.n)
    near = np.arange(min(view.n, TILE))
    held: dict = {x: [] for x in work.sites}
    for a, b, step in ((*apart, 1), (near, near, 8)):
        view.at(a, b)
        view.mask = a[:, None] != b[None, :]
        for name, site in work.sites.items():
            x = view.value(site)
            held[name] += [x[::step], np.sort(x)[[0, -1]] if len(x) else x]
    for name, x in held.items():
        yield unit, name, "buckets", zipped(Buckets.model(np.concatenate(x), buckets))


def task_counts(work: Work, items: pa.Table, notes: dict, unit: int, part: int, parts: int):
    view, held = work.look(items, notes, unit), {x: Buckets(notes[unit, x, "buckets"][0]) for x in work.sites}
    counts = {x: Counts(b.size) for x, b in held.items()}
    for _ in tiles(view, part, parts):
        for name, site in work.sites.items():
            x = view.value(site)
            counts[name].add(x, held[name].of(x))
    for name, c in counts.items():
        yield unit, name, "counts", c.packed()


def task_means(work: Work, items: pa.Table, notes: dict, unit: int, part: int, parts: int):
    view, held = work.look(items, notes, unit), {x: Buckets(notes[unit, x, "buckets"][0]) for x in work.sites}
    mean, total = {x: means(notes[unit, x, "counts"][0]) for x in work.sites}, {}
    for _ in tiles(view, part, parts):
        ranks: dict = {}
        for key, *sides in work.products:
            for name, site in sides:
                if (name, site) not in ranks:
                    ranks[name, site] = mean[name][held[name].of(view.value(site))]
            total[key] = total.get(key, 0.0) + float(ranks[sides[0]] @ ranks[sides[1]])
    for key, x in total.items():
        yield unit, key, x


def within(work: Work, view: View, notes: dict, unit: int, name: str, low: int, high: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(values of the pairs in mixed buckets from low to high - 1, their places in each tile, the buckets' numbers)."""
    held, own = Buckets(notes[unit, name, "buckets"][0]), work.sites[name]
    n, mixed = notes[unit, name, "counts"][:2]
    wanted = mixed.copy()
    wanted[:low], wanted[high:] = False, False
    values, places, (least, greatest) = [], [], held.range(low, high)
    for _ in tiles(view):
        x = view.value(own)
        at = np.flatnonzero((x >= least) & (x <= greatest)).astype(np.int32)
        at = at[wanted[held.of(x[at])]]
        values.append(x[at])
        places.append(at)
    x, n = np.concatenate(values), n[wanted]
    if len(x) != n.sum():
        raise ValueError("distances are not what they were when they were counted")
    return x, places, n


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of x, where its runs of one value begin, and the end)."""
    order = np.argsort(x)
    x = x[order]
    return order, np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))


def task_slice(work: Work, items: pa.Table, notes: dict, unit: int, name: str, low: int, high: int):
    view = work.look(items, notes, unit)
    held = {x: Buckets(notes[unit, x, "buckets"][0]) for x in {t for _, (t, _) in work.partners[name]}}
    mean = {x: means(notes[unit, x, "counts"][0]) for x in held}
    x, places, n = within(work, view, notes, unit, name, low, high)
    order, edge = runs(x)
    e = np.empty(len(x))
    del x
    e[order] = (np.repeat((edge[:-1] + edge[1:] + 1) / 2.0, np.diff(edge)) - np.repeat(np.cumsum(n) - (n - 1) / 2.0, n)) / work.pairs
    del order
    sums = {f"= {name}": float(e @ e)}
    done = 0
    for k in tiles(view):
        at = places[k]
        rest, done = e[done : done + len(at)], done + len(at)
        for key, (other, site) in work.partners[name]:
            sums[key] = sums.get(key, 0.0) + float(rest @ mean[other][held[other].of(view.value(site)[at])])
    for key, s in sums.items():
        yield unit, key, s


def task_places(work: Work, items: pa.Table, notes: dict, unit: int, name: str, low: int, high: int):
    """Twice the ranks within buckets of a slice's pairs, tile by tile."""
    x, places, n = within(work, work.look(items, notes, unit), notes, unit, name, low, high)
    order, edge = runs(x)
    twice = np.empty(len(x), np.int64)
    del x
    twice[order] = np.repeat(edge[:-1] + edge[1:] + 1, np.diff(edge)) - 2 * np.repeat(np.cumsum(n) - n, n)
    done = 0
    for k, at in enumerate(places):
        if len(at):
            yield unit, name, f"{k} {low} {high}", planed(twice[done : done + len(at)])
        done += len(at)


def task_products(work: Work, items: pa.Table, notes: dict, unit: int, part: int, parts: int):
    """Sums of products of exact ranks."""
    view, names, total = work.look(items, notes, unit), list(work.sites), 0.0
    for _ in tiles(view, part, parts):
        m = np.array([view.value(("rank", x)) for x in names])
        total = total + m @ m.T
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            yield unit, f"{a} {b}", float(total[i, j]) if np.ndim(total) else 0.0


def task_whole(work: Work, items: pa.Table, notes: dict, unit: int):
    view, held = work.look(items, notes, unit), {x: [] for x in work.sites}
    for _ in tiles(view):
        for name, site in work.sites.items():
            held[name].append(view.value(site))
    ranks = {}
    for name, x in held.items():
        values, n = np.unique(np.concatenate(x) if x else np.zeros(0), return_counts=True)
        ranks[name] = values, means(n)
        yield unit, f"= {name}", float(n @ ranks[name][1] ** 2)
    sums = {key: 0.0 for key, *_ in work.products}
    for _ in tiles(view):
        got: dict = {}
        for key, *sides in work.products:
            for name, site in sides:
                if (name, site) not in got:
                    values, mean = ranks[name]
                    got[name, site] = mean[np.minimum(np.searchsorted(values, view.value(site)), len(values) - 1)]
            sums[key] += float(got[sides[0]] @ got[sides[1]])
    for key, x in sums.items():
        yield unit, key, x


def task_ranks(work: Work, items: pa.Table, notes: dict, unit: int, target: str, part: int, parts: int):
    """Twice the ranks of each tile's pairs, of the target and of what nuisances leave of it; 0 for a null."""
    view, total = work.look(items, notes, unit), work.pairs
    for k in tiles(view, part, parts):
        lost = view.value(("value", target)) == NULL
        for kind, site in (("raw", ("rank", target)), ("residual", ("rank e", target))):
            twice = np.rint(2 * total * view.value(site)).astype(np.int64) + total + 1
            yield unit, f"{kind} {k}", str(total), planed(np.where(lost, 0, twice) if kind == "raw" else twice)


MEETING = ("n", "x", "y", "xx", "yy", "xy")


def meeting(table: pa.Table) -> pa.Table:
    """Sums for each two units of a tile's pairs that both have, of ranks less their middle over the number of pairs."""
    table = table.sort_by("unit")
    units, total = table.column("unit").to_pylist(), int(table.column("stage")[0].as_py())
    r = np.array([unplaned(p) for p in table.column("payload").to_pylist()], np.int64)
    there = (r > 0).astype(float)
    r = np.where(r > 0, (r - (total + 1)) / (2.0 * total), 0.0)
    square = r * r
    sums = there @ there.T, r @ there.T, there @ r.T, square @ there.T, there @ square.T, r @ r.T
    a, b = np.triu_indices(len(units), 1)
    kind = table.column("name")[0].as_py().split(" ")[0]
    return pa.table({"kind": [kind] * len(a), "a": pa.array(np.array(units)[a], pa.int32()), "b": pa.array(np.array(units)[b], pa.int32()), **{x: v[a, b] for x, v in zip(MEETING, sums)}})


def done(rows: DataFrame | dict, works: list[Work], fn, specs: list[tuple], fields: str) -> DataFrame:
    """(fields) of the rows that fn(work, items, notes, *spec) gives, a task a spec; the first of a spec is the work's number. Each task reads
    rows: the items, and notes (NOTE) of the stages before; where rows are given by unit, its own only."""
    if isinstance(rows, dict):
        each = [done(own, works, fn, mine, fields) for u, own in rows.items() if (mine := [x for x in specs if x[0] == u])]
        return reduce(DataFrame.unionByName, each)
    spark, names = rows.sparkSession, [x.split(" ")[0] for x in fields.split(", ")]
    shared = spark.sparkContext.broadcast(works)
    unit = F.element_at(F.array(*(F.lit(s[0]) for s in specs)), F.col("id").cast("int") + 1)
    left = spark.range(0, len(specs), 1, len(specs)).select(F.col("id").alias("__task"), unit.alias("__unit"))
    own = F.abs(F.col("__unit") - F.col("unit")) < 1  # no equality, so that rows are read by each task and not shuffled
    rows = left.join(rows.coalesce(1).hint("shuffle_replicate_nl"), own).drop("__unit")

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        for task in pc.unique(table.column("__task")).to_pylist():
            own, notes, spec = table.filter(pc.equal(table.column("__task"), task)), {}, specs[task]
            said = own.filter(pc.is_valid(own.column("name")))
            for name, stage, raw in zip(*(said.column(x).to_pylist() for x in ("name", "stage", "payload"))):
                notes[spec[0], name, stage] = Counts.unpacked(raw) if stage == "counts" else raw if stage[0].isdigit() else [unzipped(raw)]
            got = list(fn(shared.value[spec[0]], own.filter(pc.is_null(own.column("name"))), notes, *spec))
            for a in range(0, len(got), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x) if k else pa.array(x, pa.int32()) for k, x in enumerate(zip(*got[a : a + 64]))], names=names)

    return rows.mapInArrow(run, fields)


def added(table: pa.Table) -> pa.Table:
    total = None
    for raw in table.column("payload").to_pylist():
        x = Counts.unpacked(raw)
        total = Counts(len(x[0])) if total is None else total
        total.merge(*x)
    return pa.table({**{x: table.column(x)[:1] for x in ("unit", "name", "stage")}, "payload": pa.array([total.packed()], pa.binary())})


def cuts(most: int):
    """What the driver needs to know of a table: the sum of its buckets' squared means, a bound of what exact ranks add to it, the fullest mixed
    bucket, and where slices begin and end."""

    def run(batches):
        for batch in batches:
            out = []
            for unit, name, raw in zip(*(batch.column(x).to_pylist() for x in ("unit", "name", "payload"))):
                n, mixed, _ = Counts.unpacked(raw)
                own = np.where(mixed, n, 0)
                upto, total = np.cumsum(own), max(1.0, float(n.sum()))
                at = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], most), side="right")) if upto[-1] else np.zeros(0, np.int64)
                out.append((unit, name, float(n @ means(n) ** 2), float(((own / total) ** 3).sum() * total / 12), int(own.max()), [*at.tolist(), len(n)] if len(at) else []))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())))], names=["unit", "name", "square", "loose", "most", "cuts"])

    return run


def with_notes(items: DataFrame, notes: list[DataFrame], more: dict | None = None) -> DataFrame | dict:
    """items and notes as one table, or by unit with each unit's further notes."""
    out = items.withColumns({**{x: F.lit(None).cast("string") for x in ("name", "stage")}, "payload": F.lit(None).cast("binary")})
    for x in notes:
        out = out.unionByName(x, allowMissingColumns=True)
    return out if more is None else {u: out.where(F.col("unit") == u).unionByName(x, allowMissingColumns=True) for u, x in more.items()}


def shares(works: list[Work], units: list[int], part: int) -> list[tuple]:
    return [(k, p, parts) for k in units for parts in [max(1, -(-works[k].pairs * len(works[k].sites) // (5 * part)))] for p in range(parts)]


def counted(items: DataFrame, works: list[Work], units: list[int], buckets: int, part: int, most: int, more: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(buckets, counts, {(unit, table): what the driver needs to know of it})."""
    models = kept(done(with_notes(items, [], more), works, task_sample, [(k, buckets) for k in units], NOTE))
    counts = done(with_notes(items, [models], more), works, task_counts, shares(works, units, part), NOTE)
    counts = kept(counts.groupBy("unit", "name").applyInArrow(added, NOTE))
    return models, counts, {(r["unit"], r["name"]): r for r in counts.mapInArrow(cuts(most), "unit int, name string, square double, loose double, most long, cuts array<long>").collect()}


def sliced(known: dict) -> list[tuple]:
    return [(k, name, lo, hi) for (k, name), r in known.items() for lo, hi in zip(r["cuts"], r["cuts"][1:])]


def totals(parts: list[DataFrame]) -> dict:
    got: dict = {}
    for one in parts:
        for r in one.groupBy("unit", "key").agg(F.sum("value").alias("value")).collect():
            got[r["unit"], r["key"]] = got.get((r["unit"], r["key"]), 0.0) + r["value"]
    return got


def summed(items: DataFrame, works: list[Work], buckets: int = 0, part: int = 0, most: int = 0, bound: float | None = None, more: dict | None = None) -> tuple[dict, dict] | None:
    """({(number of the work, key): sum}, {(number, table): sum of squares}) of centred ranks over the number of pairs; None where the bound does not hold.
    items: (unit: number of the work, __group, __item, m_<name> for each metric); more: notes for the views by unit. Only counts of tables and these sums come to the driver."""
    buckets, part, most, bound = buckets or BUCKETS, part or PART, most or SLICE, BOUND if bound is None else bound
    items, large = kept(items), [k for k, w in enumerate(works) if w.pairs > WHOLE]
    fields, sums, known = "unit int, key string, value double", [], {}
    if large:
        models, counts, known = counted(items, works, large, buckets, part, most, more)
        for k in large:
            for _, (one, _), (other, _) in works[k].products:
                a, b = known[k, one], known[k, other]
                if (a["loose"] * b["loose"]) ** 0.5 > bound * (a["square"] * b["square"]) ** 0.5 or max(a["most"], b["most"]) > most:
                    return None
        rows = with_notes(items, [models, counts], more)
        sums.append(done(rows, works, task_means, shares(works, large, part), fields))
        specs = sliced(known)
        if specs:
            sums.append(done(rows, works, task_slice, specs, fields))
    if len(large) < len(works):
        sums.append(done(with_notes(items, [], more), works, task_whole, [(k,) for k in range(len(works)) if k not in set(large)], fields))
    got = totals(sums)
    return got, {(k, x): (known[k, x]["square"] if (k, x) in known else 0.0) + got.get((k, f"= {x}"), 0.0) for k, w in enumerate(works) for x in w.sites}


def placed(items: DataFrame, works: list[Work], more: dict | None = None, buckets: int = 0, part: int = 0, most: int = 0) -> dict | None:
    """{unit: its notes: buckets, counts and places of each table}; None where a bucket is over a slice, or a group has too many pairs."""
    buckets, part, most = buckets or BUCKETS, part or PART, most or SLICE
    items, large = kept(items), [k for k, w in enumerate(works) if w.pairs > WHOLE]
    if any(w.pairs > PLACED for w in works):
        return None
    none = items.sparkSession.createDataFrame([], NOTE)
    out = {k: none for k in range(len(works))} if more is None else dict(more)
    if large:
        models, counts, known = counted(items, works, large, buckets, part, most, more)
        if any(r["most"] > most for r in known.values()):
            return None
        rows, specs = with_notes(items, [models, counts], more), sliced(known)
        for k in large:
            own = models.unionByName(counts).where(F.col("unit") == k)
            if mine := [x for x in specs if x[0] == k]:
                own = own.unionByName(kept(done(rows if more is None else rows[k], works, task_places, mine, NOTE)))
            out[k] = out[k].unionByName(own)
    return out


# ---------------------------------------------------------------- what is asked


def numbered(items: DataFrame, groups: list) -> DataFrame:
    """items with the unit of their group, its number."""
    units = items.sparkSession.createDataFrame([(g, k) for k, g in enumerate(groups)], f"__g {items.schema['__group'].dataType.simpleString()}, unit int")
    return items.join(F.broadcast(units), F.col("__group") == F.col("__g")).drop("__g")


def of_groups(items: DataFrame, sizes: dict, metrics: dict[str, str], names: list[str], moved: str | None = None, shifts: dict | None = None, **bounds) -> dict | None:
    """{group: [mean products of names by names, then of each shift's moved name with the others]}, as strips.Pairs.products() has them, or None."""
    works, others = [], [x for x in names if x != moved]
    for g, n in sizes.items():
        products, partners = [], {x: [] for x in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                products.append((f"{a} {b}", (a, (a, 0)), (b, (b, 0))))
                partners[a].append((f"{a} {b}", (b, (b, 0))))
                partners[b].append((f"{a} {b}", (a, (a, 0))))
        for p, s in enumerate(shifts[g] if shifts else ()):
            for a in others:
                products.append((f"{p} {a}", (moved, (moved, s)), (a, (a, 0))))
                partners[moved].append((f"{p} {a}", (a, (a, -s))))
                partners[a].append((f"{p} {a}", (moved, (moved, s))))
        works.append(Work(partial(Group, metrics=metrics, group=g), n, {x: (x, 0) for x in names}, products, partners))
    got = summed(numbered(items, list(sizes)), works, **bounds)
    if got is None:
        return None
    sums, squares, out = *got, {}
    for k, (g, n) in enumerate(sizes.items()):
        both = lambda a, b: squares[k, a] if a == b else sums[k, f"{a} {b}" if names.index(a) < names.index(b) else f"{b} {a}"]  # noqa: E731, B023
        total = n * (n - 1) // 2
        out[g] = np.array([both(a, b) for a in names for b in names] + [sums[k, f"{p} {a}"] for p in range(len(shifts[g]) if shifts else 0) for a in others]) / total
    return out


def of_subjects(items: DataFrame, sizes: dict, metric: tuple[str, str], shifts: dict, **bounds) -> list[tuple] | None:
    """(perm, group, rho) of each group's value against the mean of the others', all shifted, or None."""
    groups = list(sizes)
    n, perms = sizes[groups[0]], range(len(shifts[groups[0]]))
    sites, products, partners = {}, [], {f"own {k}": [] for k in range(len(groups))}
    for k in range(len(groups)):
        sites[f"own {k}"] = ("own", k, 0)
        for p in perms:
            here = tuple(int(shifts[g][p]) % n for g in groups)
            seen = tuple((s - here[k]) % n for s in here)
            own, rest = (f"own {k}", ("own", k, here[k])), (f"rest {k} {p}", ("rest", k, here))
            sites[rest[0]] = rest[1]
            products.append((f"{k} {p}", own, rest))
            partners[own[0]].append((f"{k} {p}", (rest[0], ("rest", k, seen))))
            partners[rest[0]] = [(f"{k} {p}", own)]
    got = summed(items.withColumn("unit", F.lit(0)), [Work(partial(Subjects, metric=metric, groups=groups), n, sites, products, partners)], **bounds)
    if got is None:
        return None
    sums, squares = got

    def rho(k, p):
        a, b = squares[0, f"own {k}"], squares[0, f"rest {k} {p}"]
        return float(sums[0, f"{k} {p}"] / np.sqrt(a * b)) if a > 0 and b > 0 else None

    return [(p, g, rho(k, p)) for k, g in enumerate(groups) for p in perms]


Residuals = tuple[DataFrame, list, list[Work], dict]


def residuals(items: DataFrame, sizes: dict, metrics: dict[str, str], targets: list[str], nuisances: list[str], fit: Callable[[np.ndarray], np.ndarray], places: int, **bounds) -> Residuals | None:
    """(items, groups, works whose views know residuals by ("e", target), notes by unit), or None. fit: mean products of ranks, targets and then
    nuisances -> the weights of nuisances by target, and the targets' deviations."""
    names = [*targets, *nuisances]
    groups = [g for g, n in sizes.items() if n > 1]
    works = [Work(partial(Placed, metrics={x: metrics[x] for x in names}, group=g, targets=targets, nuisances=nuisances, places=places), sizes[g], {x: ("value", x) for x in names}, [], {}) for g in groups]
    items = kept(numbered(items, groups))
    more = placed(items, works, **bounds)
    if more is None or not works:
        return None
    got = totals([done(with_notes(items, [], more), works, task_products, shares(works, list(range(len(works))), bounds.get("part") or PART), "unit int, key string, value double")])
    model = [(k, "weights", "weights", bytearray(zipped(fit(np.array([[got[k, f"{a} {b}"] for b in names] for a in names]) / w.pairs)))) for k, w in enumerate(works)]
    model = items.sparkSession.createDataFrame(model, NOTE)
    return items, groups, works, {k: x.unionByName(model.where(F.col("unit") == k)) for k, x in more.items()}


def of_residuals(items: DataFrame, sizes: dict, metrics: dict[str, str], targets: list[str], nuisances: list[str], fit: Callable[[np.ndarray], np.ndarray], places: int, **bounds) -> dict | None:
    """{group: (sums of squares and products, targets by targets) of the ranks of what nuisances leave of the targets}, or None. As residuals()."""
    known = residuals(items, sizes, metrics, targets, nuisances, fit, places, **{x: v for x, v in bounds.items() if x != "bound"})
    if known is None:
        return None
    items, groups, works, more = known
    tables = {f"e {x}": ("e", x) for x in targets}
    both = [(a, b) for i, a in enumerate(targets) for b in targets[i + 1 :]]
    products = [(f"{a} {b}", (f"e {a}", ("e", a)), (f"e {b}", ("e", b))) for a, b in both]
    partners = {f"e {x}": [(f"{a} {b}", (f"e {b if x == a else a}", ("e", b if x == a else a))) for a, b in both if x in (a, b)] for x in targets}
    got = summed(items, [Work(w.view, w.n, tables, products, partners) for w in works], more=more, **bounds)
    if got is None:
        return None
    sums, squares = got
    both = lambda k, a, b: squares[k, f"e {a}"] if a == b else sums[k, f"{a} {b}" if targets.index(a) < targets.index(b) else f"{b} {a}"]
    return {g: np.array([[both(k, a, b) for b in targets] for a in targets]) for k, g in enumerate(groups)}


def matrices(items: DataFrame, sizes: dict, metrics: dict[str, str], target: str, nuisances: list[str], fit: Callable[[np.ndarray], np.ndarray], places: int, **bounds) -> tuple[list, DataFrame] | None:
    """(groups, (kind: raw or residual, a < b: numbers of two groups, MEETING: sums over their common pairs)), or None. Groups have the same items. As
    residuals(); the ranks of a tile meet, by some three bytes a pair."""
    known = residuals(items, sizes, metrics, [target], nuisances, fit, places, **bounds)
    if known is None:
        return None
    items, groups, works, more = known
    more = placed(items, [Work(w.view, w.n, {f"e {target}": ("e", target)}, [], {}) for w in works], more, **bounds)
    if more is None:
        return None
    specs = [(k, target, p, parts) for k, p, parts in shares(works, list(range(len(works))), bounds.get("part") or PART)]
    ranks = done(with_notes(items, [], more), works, task_ranks, specs, NOTE)
    sums = ranks.groupBy("name").applyInArrow(meeting, "kind string, a int, b int, " + ", ".join(f"{x} double" for x in MEETING))
    return groups, sums.groupBy("kind", "a", "b").agg(*(F.sum(x).alias(x) for x in MEETING))
