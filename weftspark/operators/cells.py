"""Sums of products of ranks over all pairs of a group's items, for groups of over OVER pairs: ranks are looked up in tables.

A table cuts the range of a group's values into some CELLS cells, and counting all pairs gives each cell the mean rank of its pairs, which
stands for the rank of each. So every pair counts, equal values have equal ranks, and what is left out is the order within a cell: a rank is off by
half a cell's pairs at most, up or down whatever the other side is, so that sums over P pairs are off by some 1 / (CELLS sqrt(P)) of a
correlation. That is not assumed but tried: the same sums are taken with cells four times as wide, and where a correlation moves by over AGREE,
nothing is returned, and the caller ranks pairs by exchanging them.

Values may be distances, what nuisances leave of them (made of ranks), and means over other subjects. They are made again from the items by each
pass, of which there is one to count and one to add up, so work grows with the pairs, and what goes to disk are items, counts and sums.
A task has its groups' items (of queries on subjects together: all subjects'), the tables it looks up, and a tile of pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import slices as sl

CELLS, TILE, AGREE = 1 << 20, 512, 2e-8
#: Pairs of a group over which subjects and residuals are taken by cells; groups alone, whose exact slices need no residuals, are over ALONE.
OVER, ALONE = 1 << 24, 1 << 27
#: Values that a task looks up, about, and tasks of a stage at most.
PART, TASKS = 1 << 25, 256
#: Values of a table that take fewer cells.
FEW = 64

NOTE = sl.NOTE


@dataclass
class Job:
    """Groups that are looked at together, by number. Sites are ("d", group, name, shift), ("e", group, target, shift) and ("rest", group, "", permutation);
    tables, products (key, (table, site), (table, site)) and shifts (of each group) go by permutation; matrices: kind -> (table, site) of each group."""

    groups: list[int]
    n: int
    metrics: dict[str, str]
    targets: list[str] = field(default_factory=list)
    nuisances: list[str] = field(default_factory=list)
    places: int = 9
    source: tuple[str, str] = ("d", "")
    shifts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    tables: list[dict[str, tuple]] = field(default_factory=list)
    products: list[list[tuple]] = field(default_factory=list)
    matrices: dict[str, list[tuple]] = field(default_factory=dict)

    @property
    def pairs(self) -> int:
        return self.n * (self.n - 1) // 2


class Sight(sl.View):
    def __init__(self, job: Job, items: dict[int, list], notes: dict):
        self.job, self.notes, self.known, self.cells = job, notes, {}, {}
        for k in sorted(items):
            rows = pa.Table.from_batches(items.pop(k)).sort_by("__item")
            self.n = rows.num_rows
            self.cells[k] = {x: sl.cell_of(m, rows.column(f"m_{x}")) for x, m in job.metrics.items()}

    def made(self, site):
        kind, k, name, shift = site
        if kind == "d":
            return self.shifted(self.cells[k][name], shift)
        if kind == "e":
            beta, sd = self.weights(k, name)
            if not sd > 0:
                return np.full(self.value(("d", k, name, shift)).shape, np.nan)
            e = self.ranked(k, name, shift)
            for w, x in zip(beta, self.job.nuisances):
                e -= w * self.ranked(k, x, shift)
            e /= sd
            return np.round(e, self.job.places, out=e)
        if kind == "total":
            out = 0.0
            for j in self.job.groups:
                x = self.own(j, shift)
                lost = x == sl.NULL
                out = out + (np.where(lost, 0.0, x) if lost.any() else x)
            return out
        own, others = self.own(k, shift), len(self.job.groups) - 1
        if not others:
            return np.full(len(own), sl.NULL)
        lost = own == sl.NULL
        if lost.any():
            return np.where(lost, sl.NULL, (self.value(("total", 0, "", shift)) - np.where(lost, 0.0, own)) / others)
        return (self.value(("total", 0, "", shift)) - own) / others

    def own(self, k: int, perm: int) -> np.ndarray:
        kind, name = self.job.source
        return self.value((kind, k, name, self.job.shifts[perm].get(k, 0)))

    def weights(self, k: int, target: str) -> tuple[np.ndarray, float]:
        w, at, count = self.note(f"w {k}", "weights"), self.job.targets.index(target), len(self.job.nuisances)
        return w[at * count : (at + 1) * count], w[len(self.job.targets) * count + at]

    def note(self, name: str, stage: str) -> np.ndarray:
        if (name, stage) not in self.known:
            self.known[name, stage] = sl.unzipped(self.notes.pop((name, stage)))
        return self.known[name, stage]

    def held_of(self, table: str) -> sl.Buckets:
        if (table, "held") not in self.known:
            self.known[table, "held"] = sl.Buckets(sl.unzipped(self.notes.pop((table, "buckets"))))
        return self.known[table, "held"]

    def value(self, site):
        return self.made(site) if site[0] == "rest" else super().value(site)  # asked for once a tile

    def means_of(self, table: str) -> tuple[np.ndarray, np.ndarray]:
        """Mean ranks by cells, and by cells four times as wide; of 32 bits each, as a task may look up the tables of many groups."""
        if (table, "means") not in self.known:
            n = sl.unplaned(self.notes.pop((table, "cells"))).astype(np.int64)
            wide = np.pad(n, (0, -len(n) % 4)).reshape(-1, 4).sum(axis=1)
            self.known[table, "means"] = sl.means(n).astype(np.float32), sl.means(wide).astype(np.float32)
            pa.default_memory_pool().release_unused()
        return self.known[table, "means"]

    def ranked(self, k: int, name: str, shift: int) -> np.ndarray:
        """Ranks of which residuals are made."""
        table = f"d {k} {name}"
        return self.means_of(table)[0][self.held_of(table).of(self.made(("d", k, name, shift)))].astype(float)

    def ranks(self, table: str, site: tuple) -> tuple[np.ndarray, np.ndarray]:
        code = self.held_of(table).of(self.value(site))
        mean, wide = self.means_of(table)
        return mean[code].astype(float), wide[code >> 2].astype(float)


# ---------------------------------------------------------------- tasks


def task_models(job: Job, view: Sight, unit: int, perm: int):
    """As slices.task_sample()."""
    far = np.linspace(0, view.n - 1, min(view.n, sl.TILE))
    apart = np.unique(far.astype(np.int64)), np.unique((far + view.n / sl.TILE / 2).astype(np.int64) % view.n)
    near = np.arange(min(view.n, sl.TILE))
    held: dict = {x: [] for x in job.tables[perm]}
    for a, b, step in ((*apart, 1), (near, near, 8)):
        view.at(a, b)
        view.mask = a[:, None] != b[None, :]
        for name, site in job.tables[perm].items():
            x = view.value(site)
            held[name] += [x[::step], np.sort(x)[[0, -1]] if len(x) else x]
    for name, x in held.items():
        yield unit, name, "buckets", sl.zipped(sl.Buckets.model(x := np.concatenate(x), CELLS if len(np.unique(x)) > FEW else CELLS >> 4))


def task_cells(job: Job, view: Sight, unit: int, perm: int, part: int, parts: int):
    """How many pairs each cell has. Codes are kept until they are as many as cells."""
    total, codes = {}, {x: [] for x in job.tables[perm]}

    def counted(name):
        n = np.bincount(np.concatenate(codes[name]) if codes[name] else np.zeros(0, np.int32), minlength=view.held_of(name).size).astype(np.int32)
        total[name] = total[name] + n if name in total else n
        codes[name] = []

    for _ in sl.tiles(view, part, parts, TILE):
        for name, site in job.tables[perm].items():
            codes[name].append(view.held_of(name).of(view.value(site)))
            if sum(map(len, codes[name])) > CELLS:
                counted(name)
    for name in codes:
        counted(name)
        yield unit, name, "cells", sl.planed(total.pop(name))


def task_sums(job: Job, view: Sight, unit: int, perm: int, part: int, parts: int):
    """Sums of products of ranks by cells, and by wide ones."""
    total, uses = {}, Counter(side for _, *sides in job.products[perm] for side in set(sides))
    for _ in sl.tiles(view, part, parts, TILE):
        held: dict = {}

        def ranks(side):
            if side in held:
                return held[side]
            got = view.ranks(*side)  # noqa: B023
            if uses[side] > 1:
                held[side] = got  # noqa: B023
            return got

        for key, one, other in job.products[perm]:
            a, b = ranks(one), ranks(other)
            total[key] = total.get(key, 0.0) + np.array([a[0] @ b[0], a[1] @ b[1]])
    for key, x in total.items():
        yield unit, key, float(x[0]), float(x[1])


def task_meeting(job: Job, view: Sight, unit: int, perm: int, part: int, parts: int):
    """Sums for each two groups over the pairs of items that both have; the last one is xy by wide cells."""
    total: dict = {}
    for _ in sl.tiles(view, part, parts, TILE):
        for kind, sides in job.matrices.items():
            r, wide = (np.array(x) for x in zip(*(view.ranks(*side) for side in sides)))
            there = np.array([view.value(site) != sl.NULL for _, site in sides], float)
            r, wide = r * there, wide * there
            square = r * r
            total[kind] = total.get(kind, 0.0) + np.array([there @ there.T, r @ there.T, there @ r.T, square @ there.T, there @ square.T, r @ r.T, wide @ wide.T])
    for kind, sums in total.items():
        for i, a in enumerate(job.groups):
            for j, b in enumerate(job.groups[i + 1 :], i + 1):
                yield (kind, a, b, *map(float, sums[:, i, j]))


# ---------------------------------------------------------------- stages


def dealt(rows: dict[int, DataFrame], jobs: dict[int, Job], fn, specs: list[tuple], fields: str) -> DataFrame:
    """(fields) of what fn(job, view, *spec) gives, a task a spec; each reads its unit's rows: items and notes."""
    return reduce(DataFrame.unionByName, [one_unit(rows[u], jobs[u], fn, mine, fields) for u in jobs if (mine := [s for s in specs if s[0] == u])])


def one_unit(rows: DataFrame, job: Job, fn, specs: list[tuple], fields: str) -> DataFrame:
    spark, names = rows.sparkSession, [x.split(" ")[0] for x in fields.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[x.split(" ")[1]] for x in fields.split(", ")]
    shared = spark.sparkContext.broadcast((job, specs))
    left = spark.range(0, len(specs), 1, len(specs)).select(F.col("id").alias("__task"))
    rows = left.crossJoin(rows.coalesce(1).hint("shuffle_replicate_nl"))  # rows are read by each task and not shuffled

    def run(batches):
        job, specs = shared.value
        items, notes, spec = {}, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            spec = specs[batch.column("__task")[0].as_py()]
            name, stage, raw = (batch.column(x) for x in ("name", "stage", "payload"))
            for at in np.flatnonzero(np.asarray(name.is_valid())).tolist():
                if not (said := name[at].as_py()).startswith("rest ") or said in job.tables[spec[1]]:
                    notes[said, stage[at].as_py()] = raw[at].as_py()
            own = batch.select(["k", "__item", *(f"m_{x}" for x in job.metrics)]).filter(name.is_null())
            for k in pc.unique(own.column("k")).to_pylist():
                items.setdefault(k, []).append(own.filter(pc.equal(own.column("k"), k)))
        if spec is None:
            return
        got = list(fn(job, Sight(job, items, notes), *spec))
        for a in range(0, len(got), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*got[a : a + 64]), kinds)], names=names)

    return rows.mapInArrow(run, fields)


def added(table: pa.Table) -> pa.Table:
    total = 0
    for raw in table.column("payload"):
        total = total + sl.unplaned(raw.as_py()).astype(np.int64)
    return pa.table({**{x: table.column(x)[:1] for x in ("unit", "name", "stage")}, "payload": pa.array([sl.planed(total)], pa.binary())})


def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [sl.unplaned(x.as_py()).astype(np.int64) for x in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("name"), pa.array([float(x @ sl.means(x) ** 2) for x in n], pa.float64())], names=["unit", "name", "square"])


def shares(jobs: dict[int, Job], load: Callable[[Job, int], int]) -> list[tuple]:
    """(unit, permutation, part, parts) for what is asked of the permutations, load values a pair."""
    asked = [(u, p, load(job, p)) for u, job in jobs.items() for p in range(len(job.shifts)) if load(job, p)]
    most = max(1, TASKS // max(1, len(asked)))
    return [(u, p, x, parts) for u, p, k in asked for parts in [max(1, min(most, -(-jobs[u].pairs * k // PART)))] for x in range(parts)]


def with_notes(rows: dict[int, DataFrame], notes: DataFrame) -> dict[int, DataFrame]:
    return {u: x.unionByName(notes.where(F.col("unit") == u), allowMissingColumns=True) for u, x in rows.items()}


def tabled(rows: dict[int, DataFrame], jobs: dict[int, Job]) -> tuple[DataFrame, dict]:
    """(notes of the jobs' tables, {(unit, table): sum of squared ranks})."""
    models = kept(dealt(rows, jobs, task_models, [(u, p) for u, job in jobs.items() for p, t in enumerate(job.tables) if t], NOTE))
    cells = dealt(with_notes(rows, models), jobs, task_cells, shares(jobs, lambda job, p: len(job.tables[p])), NOTE)
    cells = kept(cells.groupBy("unit", "name").applyInArrow(added, NOTE))
    return models.unionByName(cells), {(r["unit"], r["name"]): r["square"] for r in cells.mapInArrow(squared, "unit int, name string, square double").collect()}


def summed(rows: dict[int, DataFrame], jobs: dict[int, Job], squares: dict) -> dict | None:
    """{(unit, key): sum of products}; None where wide cells give another."""
    got = dealt(rows, jobs, task_sums, shares(jobs, lambda job, p: len({x for _, *sides in job.products[p] for x in sides})), "unit int, key string, value double, wide double")
    got = {(r["unit"], r["key"]): (r["value"], r["wide"]) for r in got.groupBy("unit", "key").agg(F.sum("value").alias("value"), F.sum("wide").alias("wide")).collect()}
    for u, job in jobs.items():
        for key, (one, _), (other, _) in (x for each in job.products for x in each):
            value, wide = got[u, key]
            if abs(value - wide) > AGREE * (squares[u, one] * squares[u, other]) ** 0.5:
                return None
    return {k: v for k, (v, _) in got.items()}


def numbered(items: DataFrame, groups: list) -> DataFrame:
    """(k: number of the group, unit: the same, __item, m_<name>, and a note's columns)."""
    rows = sl.numbered(items, groups).withColumn("k", F.col("unit")).drop("__group")
    return kept(rows.withColumns({**{x: F.lit(None).cast("string") for x in ("name", "stage")}, "payload": F.lit(None).cast("binary")}))


def apart(rows: DataFrame, groups: list) -> dict[int, DataFrame]:
    return {k: rows.where(F.col("k") == k) for k in range(len(groups))}


def of_names(k: int, names: list[str]) -> tuple[dict, list]:
    """(tables, products of each two) of a group's distances."""
    sides = {x: (f"d {k} {x}", ("d", k, x, 0)) for x in names}
    return {t: site for t, site in sides.values()}, [(f"{a} {b}", sides[a], sides[b]) for i, a in enumerate(names) for b in names[i + 1 :]]


# ---------------------------------------------------------------- what is asked


def of_groups(items: DataFrame, sizes: dict, metrics: dict[str, str], names: list[str], moved: str | None = None, shifts: dict | None = None) -> dict | None:
    """As slices.of_groups()."""
    groups, others, jobs = list(sizes), [x for x in names if x != moved], {}
    for k, g in enumerate(groups):
        tables, products = of_names(k, names)
        for p, s in enumerate(shifts[g] if shifts else ()):
            products += [(f"{p} {a}", (f"d {k} {moved}", ("d", k, moved, int(s))), (f"d {k} {a}", ("d", k, a, 0))) for a in others]
        jobs[k] = Job([k], sizes[g], {x: metrics[x] for x in names}, tables=[tables], products=[products])
    rows = apart(numbered(items, groups), groups)
    notes, squares = tabled(rows, jobs)
    sums = summed(with_notes(rows, notes), jobs, squares)
    if sums is None:
        return None
    out = {}
    for k, g in enumerate(groups):
        both = lambda a, b: squares[k, f"d {k} {a}"] if a == b else sums[k, f"{a} {b}" if names.index(a) < names.index(b) else f"{b} {a}"]  # noqa: E731, B023
        out[g] = np.array([both(a, b) for a in names for b in names] + [sums[k, f"{p} {a}"] for p in range(len(shifts[g]) if shifts else 0) for a in others]) / jobs[k].pairs
    return out


Fit = Callable[[np.ndarray], np.ndarray]


def residuals(rows: DataFrame, groups: list, sizes: dict, metrics: dict[str, str], targets: list[str], nuisances: list[str], fit: Fit) -> tuple[DataFrame, dict] | None:
    """(notes by unit, from which views make residuals, squares of the distances' ranks), or None. fit: as in slices.residuals()."""
    names, jobs = [*targets, *nuisances], {}
    for k, g in enumerate(groups):
        tables, products = of_names(k, names)
        jobs[k] = Job([k], sizes[g], {x: metrics[x] for x in names}, tables=[tables], products=[products])
    each = apart(rows, groups)
    notes, squares = tabled(each, jobs)
    sums = summed(with_notes(each, notes), jobs, squares)
    if sums is None:
        return None
    model = []
    for k, job in jobs.items():
        g = np.array([[squares[k, f"d {k} {a}"] if i == j else sums[k, f"{names[min(i, j)]} {names[max(i, j)]}"] for j in range(len(names))] for i, a in enumerate(names)])
        model.append((k, f"w {k}", "weights", bytearray(sl.zipped(fit(g / job.pairs)))))
    return notes.unionByName(rows.sparkSession.createDataFrame(model, NOTE)), squares


def of_residuals(items: DataFrame, sizes: dict, metrics: dict[str, str], targets: list[str], nuisances: list[str], fit: Fit, places: int) -> dict | None:
    """As slices.of_residuals()."""
    groups, names = list(sizes), [*targets, *nuisances]
    rows = numbered(items, groups)
    known = residuals(rows, groups, sizes, metrics, targets, nuisances, fit)
    if known is None:
        return None
    jobs = {}
    for k, g in enumerate(groups):
        sides = {x: (f"e {k} {x}", ("e", k, x, 0)) for x in targets}
        products = [(f"{a} {b}", sides[a], sides[b]) for i, a in enumerate(targets) for b in targets[i + 1 :]]
        jobs[k] = Job([k], sizes[g], {x: metrics[x] for x in names}, targets, nuisances, places, tables=[dict(sides.values())], products=[products])
    each = with_notes(apart(rows, groups), known[0])
    notes, squares = tabled(each, jobs)
    sums = summed(with_notes(each, notes), jobs, squares)
    if sums is None:
        return None
    both = lambda k, a, b: squares[k, f"e {k} {a}"] if a == b else sums[k, f"{a} {b}" if targets.index(a) < targets.index(b) else f"{b} {a}"]
    return {g: np.array([[both(k, a, b) for b in targets] for a in targets]) for k, g in enumerate(groups)}


@dataclass
class Residual:
    """What residuals are made of: of one target."""

    nuisances: list[str]
    fit: Fit
    places: int


def together(items: DataFrame, sizes: dict, metrics: dict[str, str], target: str, residual: Residual | None) -> tuple[DataFrame, dict] | None:
    """(rows of all groups as unit 0, with notes that residuals are made of; squares by (0, table) so far), or None."""
    groups = list(sizes)
    rows, squares = numbered(items, groups), {}
    every = rows.withColumn("unit", F.lit(0))
    if residual is not None:
        known = residuals(rows, groups, sizes, metrics, [target], residual.nuisances, residual.fit)
        if known is None:
            return None
        every = every.unionByName(known[0].withColumn("unit", F.lit(0)), allowMissingColumns=True)
        squares = {(0, t): x for (_, t), x in known[1].items()}
    return every, squares


def job_of(sizes: dict, metrics: dict[str, str], target: str, residual: Residual | None, source: str) -> Job:
    groups, nuisances = list(sizes), residual.nuisances if residual else []
    names = [target, *nuisances]
    return Job(list(range(len(groups))), sizes[groups[0]], {x: metrics[x] for x in names}, [target], nuisances, residual.places if residual else 9, (source, target))


def of_subjects(items: DataFrame, sizes: dict, metrics: dict[str, str], target: str, shifts: dict, residual: Residual | None = None) -> list[tuple] | None:
    """As slices.of_subjects(), of distances or of what nuisances leave of them."""
    groups, kind = list(sizes), "d" if residual is None else "e"
    known = together(items, sizes, metrics, target, residual)
    if known is None:
        return None
    job, perms = job_of(sizes, metrics, target, residual, kind), range(len(shifts[groups[0]]))
    job.shifts = [{k: int(shifts[g][p]) % job.n for k, g in enumerate(groups)} for p in perms]
    own = {k: f"{kind} {k} {target}" for k in job.groups}
    job.tables = [{**({t: (kind, k, target, 0) for k, t in own.items()} if p == 0 else {}), **{f"rest {k} {p}": ("rest", k, "", p) for k in job.groups}} for p in perms]
    job.products = [[(f"{k} {p}", (own[k], (kind, k, target, job.shifts[p][k])), (f"rest {k} {p}", ("rest", k, "", p))) for k in job.groups] for p in perms]
    notes, squares = tabled({0: known[0]}, {0: job})
    sums = summed(with_notes({0: known[0]}, notes), {0: job}, squares)
    if sums is None:
        return None

    def rho(k, p):
        a, b = squares[0, own[k]], squares[0, f"rest {k} {p}"]
        return float(sums[0, f"{k} {p}"] / np.sqrt(a * b)) if a > 0 and b > 0 else None

    return [(p, g, rho(k, p)) for k, g in enumerate(groups) for p in perms]


def matrices(items: DataFrame, sizes: dict, metrics: dict[str, str], target: str, residual: Residual | None = None) -> tuple[list, DataFrame] | None:
    """As slices.matrices(); without a residual, of the raw distances only."""
    known = together(items, sizes, metrics, target, residual)
    if known is None:
        return None
    rows, job = {0: known[0]}, job_of(sizes, metrics, target, residual, "d")
    sides = {kind: [(f"{s} {k} {target}", (s, k, target, 0)) for k in job.groups] for kind, s in (("raw", "d"), ("residual", "e"))[: 1 if residual is None else 2]}
    job.tables, job.matrices = [dict(sides["raw" if residual is None else "residual"])], sides
    rows = with_notes(rows, tabled(rows, {0: job})[0])
    fields = "kind string, a int, b int, " + ", ".join(f"{x} double" for x in (*sl.MEETING, "wide"))
    sums = dealt(rows, {0: job}, task_meeting, shares({0: job}, lambda job, p: sum(map(len, sides.values()))), fields)
    sums = kept(sums.groupBy("kind", "a", "b").agg(*(F.sum(x).alias(x) for x in (*sl.MEETING, "wide"))))
    if sums.where(F.abs(F.col("xy") - F.col("wide")) > AGREE * F.sqrt(F.col("xx") * F.col("yy"))).limit(1).count():
        return None
    return list(sizes), sums.drop("wide")
