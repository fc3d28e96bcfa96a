"""Agreement of subjects' pair tables (subject, i, j, d)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import ranked_wide, spearman

#: Sums of a pair of subjects over the pairs of items that both have.
SUMS = ["n", "x", "y", "xx", "yy", "xy"]
#: Pairs of subjects of which a task holds sums before it sends them on.
HELD = 1 << 20


def co_moments(schema: T.StructType):
    """For rows of arrays (subjects, values), one a pair of items, the SUMS of all pairs of subjects that a task sees: products of a
    matrix of pairs by subjects, added up over batches."""

    def run(batches):
        names: dict = {}
        total = np.zeros((len(SUMS), 0, 0))
        kind = None

        def sent():
            every = list(names)
            a, b = np.nonzero(total[0] > 0)
            low = np.array([every[p] < every[q] for p, q in zip(a.tolist(), b.tolist())], bool)
            a, b = a[low], b[low]
            return pa.RecordBatch.from_arrays([pa.array([every[p] for p in a], kind), pa.array([every[q] for q in b], kind), *(pa.array(t[a, b]) for t in total)], names=schema.names)

        for batch in batches:
            lists, values = batch.column(0), batch.column(1)
            kind, off = lists.type.value_type, np.asarray(lists.offsets).astype(np.int64)
            code = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
            col = np.array([names.setdefault(x, len(names)) for x in code.dictionary.to_pylist()], np.int64)[np.asarray(code.indices)]
            row, x = np.repeat(np.arange(len(lists)), np.diff(off)), np.asarray(values.values.slice(off[0], off[-1] - off[0]))
            there, r = np.zeros((len(lists), len(names))), np.zeros((len(lists), len(names)))
            there[row, col], r[row, col] = 1.0, x
            total = np.pad(total, ((0, 0), *((0, len(names) - total.shape[1]),) * 2))
            square = r * r
            total += np.stack((there.T @ there, r.T @ there, there.T @ r, square.T @ there, there.T @ square, r.T @ r))
            if len(names) ** 2 > HELD:
                yield sent()
                names, total = {}, np.zeros((len(SUMS), 0, 0))
        if names:
            yield sent()

    return run


def subject_matrix(pairs: DataFrame, value: str = "d") -> DataFrame:
    """(subject_a, subject_b, rho) for a < b: ranks once a subject; then a pair of items has its subjects' ranks as one row, and
    tasks add up matrices of products, which merge by sums. Subjects are compared on the pairs of items that both have.

    Ranks are taken from their middle, so that sums of squares lose no digits.
    """
    rows = ranked_wide(pairs.where(F.col(value).isNotNull()).select("subject", "i", "j", value), "subject", value)
    middle = rows.groupBy(F.col("subject").alias("__s")).agg(((F.count("*") + 1) / 2.0).alias("middle"))
    rows = rows.join(middle, F.col("subject") == F.col("__s")).select("subject", "i", "j", (F.col(f"r_{value}") - F.col("middle")).alias("r"))
    lists = rows.groupBy("i", "j").agg(F.collect_list(F.struct("subject", "r")).alias("g")).select(F.col("g.subject").alias("subjects"), F.col("g.r").alias("ranks"))  # an entry a subject
    kind = pairs.schema["subject"].dataType
    schema = T.StructType([T.StructField("subject_a", kind), T.StructField("subject_b", kind), *(T.StructField(x, T.DoubleType()) for x in SUMS)])
    sums = lists.mapInArrow(co_moments(schema), schema).groupBy("subject_a", "subject_b").agg(*(F.sum(x).alias(x) for x in SUMS))
    n, x, y, xx, yy, xy = (F.col(c) for c in SUMS)
    return sums.select("subject_a", "subject_b", F.try_divide(n * xy - x * y, F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y)).alias("rho"))


def leave_one_out(pairs: DataFrame, value: str = "d", within: tuple[str, ...] = ()) -> DataFrame:
    """(subject, rho): each subject against the mean of the others' raw distances, which is ranked only then."""
    w = Window.partitionBy(*within, "i", "j")
    rest = (F.sum(value).over(w) - F.col(value)) / (F.count("*").over(w) - 1)
    return spearman(pairs.withColumn("rest", rest), "subject", value, "rest")


def summary(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, median, min, max, n)."""
    return values.groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))


def common_items(items: DataFrame, subject: str, order: str) -> DataFrame:
    """items with item: the row's place in its subject, for places that all subjects have."""
    items = items.withColumn("item", F.row_number().over(Window.partitionBy(subject).orderBy(order)) - 1)
    sizes = items.groupBy(subject).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return items.join(F.broadcast(sizes), F.col("item") < F.col("least")).drop("least")


def mismatches(rows: DataFrame, item: str, *values: str) -> DataFrame:
    """Items that not all subjects agree on: (item, how many different values of each column)."""
    got = rows.groupBy(item).agg(*(F.count_distinct(F.coalesce(F.col(v).cast("string"), F.lit("\0"))).alias(f"n_{v}") for v in values))
    return got.where(" or ".join(f"n_{v} > 1" for v in values))
