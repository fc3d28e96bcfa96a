"""Hard negatives by vantage-point trees over norm-augmented vectors.

One more component, sqrt(M - |x|^2), gives all of a shard's vectors the length sqrt(M), so a query's inner product falls as the
distance grows: nearest first is highest score first, and a window of scores is an annulus around the query. Leaves of the tree
are visited nearest first, many queries at a time, as long as the annulus and the rows found so far leave room for more. Scores
are compared as whole numbers; distances only tell which leaves to visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

POSITIVES, NEGATIVES = 5, 3
#: 50 positive_score <= 100 negative_score <= 95 positive_score.
LOW, HIGH = 50, 95
ANCHORS, NOISY, SCALE = 50, 7, 256
#: Rows of a leaf, of a shard at least and at most, and anchors that meet a shard in one task.
LEAF, LEAST_ROWS, MOST_ROWS, BLOCK = 256, 2048, 1 << 16, 1 << 15
#: Queries and windows whose scores with a leaf are held at a time.
STEP = 2048
SPARE = 1e-6  # of rounding, in squared distances as a share of the largest


@dataclass
class Tree:
    """Leaves, as ranges of rows in ascending id, and for each the intervals of distances from the vantage points above it."""

    x: np.ndarray  # whole numbers, by leaf
    ids: np.ndarray
    labels: np.ndarray
    edges: np.ndarray  # first row of each leaf and the end
    points: np.ndarray  # vantage points
    above: list[list[tuple[int, float, float]]]  # of each leaf: (vantage point, least distance, largest)
    top: float

    @staticmethod
    def of(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
        y = x.astype(np.float64)
        square = (y * y).sum(axis=1)
        top = float(square.max())
        extra = np.sqrt(np.maximum(top - square, 0))
        order, points, ranges, above, todo = np.arange(len(x)), [], [], [], [(0, len(x), [])]
        while todo:
            a, b, path = todo.pop()
            if b - a <= leaf:
                ranges.append((a, b))
                above.append(path)
                continue
            own = order[a:b]
            v = int(own[np.argmax(square[own])])  # a far one, as vectors of one direction lie together
            d = np.sqrt(np.maximum(2 * top - 2 * (y[own] @ y[v] + extra[own] * extra[v]), 0))
            middle = (b - a) // 2
            split = np.argpartition(d, middle)
            order[a:b], d = own[split], d[split]
            points.append(v)
            for lo, hi in ((0, middle), (middle, b - a)):
                todo.append((a + lo, a + hi, [*path, (len(points) - 1, float(d[lo:hi].min()), float(d[lo:hi].max()))]))
        at = np.concatenate([order[a:b][np.argsort(ids[order[a:b]], kind="stable")] for a, b in ranges])
        edges = np.concatenate(([0], np.cumsum([b - a for a, b in ranges])))
        return Tree(x[at], ids[at], labels[at], edges, np.column_stack((y, extra))[np.array(points, np.int64)], above, top)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(squares of the queries' lengths, least and largest distance that a row of each leaf can have from each query)."""
        q = q.astype(np.float64)
        square = (q * q).sum(axis=1)
        least, most = np.zeros((len(q), len(self.above))), np.full((len(q), len(self.above)), np.inf)
        d = np.sqrt(np.maximum(square[:, None] + self.top - 2 * q @ self.points[:, :-1].T, 0)) if len(self.points) else np.zeros((len(q), 0))
        for k, path in enumerate(self.above):
            for v, lo, hi in path:
                np.maximum(least[:, k], np.maximum(d[:, v] - hi, lo - d[:, v]), out=least[:, k])
                np.minimum(most[:, k], d[:, v] + hi, out=most[:, k])
        return square, least, most

    def nearest(self, q: np.ndarray, k: int, allowed, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, whether there) of the first k rows of each query by score and id, of those that allowed(queries, rows) and
        whose score is from low to high, if given."""
        square, least, most = self.bounds(q)
        n, slack = len(q), SPARE * (square + self.top)
        outer = np.full(n, np.inf) if low is None else square + self.top - 2 * low.astype(np.float64)
        inner = np.full(n, -np.inf) if high is None else square + self.top - 2 * high.astype(np.float64)
        score, ids, there = np.zeros((n, k), self.x.dtype), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        order, size = np.argsort(least, axis=1, kind="stable"), np.diff(self.edges)
        live = np.arange(n)
        for step in range(len(size)):
            leaf = order[live, step]
            live = live[least[live, leaf] ** 2 <= outer[live] + slack[live]]
            leaf = order[live, step]
            reached = most[live, leaf] ** 2 >= inner[live] - slack[live]
            for one in np.unique(leaf[reached]).tolist():
                a, b = self.edges[one], self.edges[one + 1]
                own = live[reached & (leaf == one)]
                got = q[own] @ self.x[a:b].T
                good = allowed(own, slice(a, b))
                if low is not None:
                    good &= (got >= low[own, None]) & (got <= high[own, None])
                full = there[own, k - 1]
                good &= ~full[:, None] | (got >= score[own, k - 1][:, None])
                hit, col = np.nonzero(good)
                if not len(hit):
                    continue
                # the rows found before and those of the leaf, in order of query, score, id
                old, place = np.nonzero(there[own])
                who = np.concatenate((old, hit))
                value = np.concatenate((score[own[old], place], got[hit, col]))
                name = np.concatenate((ids[own[old], place], self.ids[a:b][col]))
                rank = np.lexsort((name, -value, who))
                who, value, name = who[rank], value[rank], name[rank]
                nth = np.arange(len(who)) - np.searchsorted(who, who)
                keep = nth < k
                who, nth = own[who[keep]], nth[keep]
                score[who, nth], ids[who, nth], there[who, nth] = value[keep], name[keep], True
                full = own[there[own, k - 1]]
                outer[full] = np.minimum(outer[full], square[full] + self.top - 2 * score[full, k - 1].astype(np.float64))
            if not len(live):
                break
        return score, ids, there


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(SCALE x) as whole numbers, shorter vectors filled with zeros: as doubles while their products stay exact, else as Python's."""
    vectors = vectors.combine_chunks()
    off = np.asarray(vectors.offsets).astype(np.int64)
    out = np.zeros((len(vectors), width))
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(SCALE * np.asarray(vectors.values)[off[0] : off[-1]].astype(np.float64))
    return out


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    most = max((float(np.abs(p).max()) for p in parts if p.size), default=0.0)
    if most * most * max(p.shape[1] for p in parts) < 2**52:
        return list(parts)
    return [np.array([[int(v) for v in row] for row in p], object).reshape(p.shape) for p in parts]


def met(find):
    """One shard and one block of queries; find(tree, queries, vectors) gives a table for each run of queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = find.schema.empty_table()
        if not rows.num_rows or not queries.num_rows:
            return empty
        width = max(int(pa.compute.max(pa.compute.list_value_length(t.column("vector"))).as_py() or 0) for t in (rows, queries)) or 1
        x, q = exact(matrix(rows.column("vector"), width), matrix(queries.column("vector"), width))
        tree = Tree.of(x, rows.column("vec_id").to_numpy(), rows.column("label").to_numpy())
        out = [find(tree, queries.slice(a, STEP), q[a : a + STEP]) for a in range(0, len(q), STEP)]
        return pa.concat_tables([empty, *out])

    return run


class Positives:
    """The first rows of each anchor's label."""

    schema = pa.schema([("anchor", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def __init__(self, k: int):
        self.k = k

    def __call__(self, tree: Tree, queries: pa.Table, q: np.ndarray) -> pa.Table:
        label, own = queries.column("label").to_numpy(), queries.column("vec_id").to_numpy()
        score, ids, there = tree.nearest(q, self.k, lambda i, rows: (tree.labels[rows] == label[i, None]) & (tree.ids[rows] != own[i, None]))
        i, k = np.nonzero(there)
        return pa.table([pa.array(queries.column("anchor").to_numpy()[i]), pa.array(ids[i, k]), pa.array(whole(score[i, k]))], schema=self.schema)


class Negatives:
    """The first rows of other labels in each window of scores."""

    schema = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def __call__(self, tree: Tree, queries: pa.Table, q: np.ndarray) -> pa.Table:
        scores = queries.column("scores").combine_chunks()
        off = np.asarray(scores.offsets).astype(np.int64)
        p = np.asarray(scores.values)[off[0] : off[-1]]
        who, place = np.repeat(np.arange(len(q)), np.diff(off)), np.arange(len(p)) - np.repeat(off[:-1] - off[0], np.diff(off))
        if q.dtype == object or (len(p) and np.abs(p).max() > 1 << 56):
            p = np.array(p.tolist(), object)
        lo, hi = -((-self.low * p) // 100), (self.high * p) // 100
        some = np.flatnonzero(lo <= hi)
        who, place, lo, hi = who[some], place[some], lo[some], hi[some]
        label, out = queries.column("label").to_numpy(), [[np.zeros(0, np.int64)] * 4]
        for a in range(0, len(who), STEP):
            part = slice(a, a + STEP)
            own = who[part]
            score, ids, there = tree.nearest(q[own], self.k, lambda i, rows: tree.labels[rows] != label[own][i, None], lo[part], hi[part])
            i, k = np.nonzero(there)
            out.append([queries.column("anchor").to_numpy()[own[i]], place[part][i], ids[i, k], whole(score[i, k])])
        anchor, place, ids, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(ids), pa.array(score)], schema=self.schema)


def whole(score: np.ndarray) -> np.ndarray:
    return score.astype(np.int64)


def ready(vectors: DataFrame, noisy: int = NOISY, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, equal ones once; every `noisy`-th id has the next of ten labels."""
    x, bad = F.col(vector_col), F.lit(float("inf"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull())
    rows = rows.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != bad)))
    label = F.col(label_col).cast("long")
    if noisy:
        label = F.when(F.col(id_col) % noisy == 0, (label + 1) % 10).otherwise(label)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), x.alias("vector")).distinct()


def dealt(rows: DataFrame, queries: DataFrame, shards: int, blocks: int, find) -> DataFrame:
    """find() for every shard of rows and block of queries (the rows' columns, anchor, and what find needs)."""
    shard, block = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")
    a = rows.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    queries = queries.select(*(F.col(x).alias(x) for x in queries.columns))  # rows and queries may come from one table
    b = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard", "block")
    names = {pa.int64(): "long", pa.int32(): "int"}
    return a.cogroup(b).applyInArrow(met(find), ", ".join(f"{x.name} {names[x.type]}" for x in find.schema))


def hard_negatives(vectors: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, noisy: int = NOISY, shard_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    Anchors are the rows whose vec_id `every` divides. An anchor's positives are its first rows of one label; for each, the
    first rows of other labels whose score is from low to high percent of the positive's are its negatives. A score is the inner
    product of the vectors' floor(256 x), higher first, then the smaller vec_id. All rows are compared with all anchors, in blocks.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Equal rows are one; unlike rows of one
    id are rows of their own, and none is a positive of its id. Shorter vectors end in zeros. A score beyond 64 bits is an error.
    """
    c.prepare(vectors.sparkSession)
    rows = ready(vectors, noisy).checkpoint()  # read three times, and equal in all
    n = rows.count()
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // (shard_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-n // tasks))))))
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.xxhash64("vec_id", "label", "vector"))
    blocks = 1 + anchors.count() // block
    first = dealt(rows, anchors, shards, blocks, Positives(positives))
    by = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")  # `positives` rows a shard
    first = first.withColumn("place", F.row_number().over(by) - 1).where(F.col("place") < positives).checkpoint()
    scores = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("s")).select("anchor", F.col("s.score").alias("scores"))
    found = dealt(rows, anchors.join(scores, "anchor"), shards, blocks, Negatives(negatives, low, high))
    by = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    found = found.select("anchor", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    first = first.select("anchor", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(first, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(c.table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {NOISY} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHORS} = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= {NEGATIVES}
"""
