"""Document fingerprints by invertible Bloom lookup tables.

A text's paragraphs (lines, cut at sentence ends and at words chosen by their hash) become 64-bit digests, repeated ones told
apart by number. Each digest goes to one cell in each of three parts of a table; a cell holds a count, a sum of digests and a
sum of check hashes. Subtracting two tables leaves what differs, and peeling cells with one digest recovers it. Where that
fails, a larger table is tried. All texts of a slice are worked on together.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Cells in each of the three parts of the first table; the fingerprint is this table.
BASE_CELLS = 4
GROWTH = 4
PARTS = 3
#: One in so many words ends a paragraph.
CUT = np.uint64(16)
#: Text that one bucket of neighbouring documents holds, about.
BUCKET_BYTES = 2 << 20
#: The driver holds one id a bucket; over so many, buckets grow instead. A task reads its buckets as a stream.
MAX_BUCKETS = 1 << 16
END = np.zeros(256, bool)
END[[0x21, 0x2E, 0x3F]] = True  # ! . ?


def digests(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest of each paragraph, row of each), sorted by row and digest; repeats have digests of their own."""
    prefix = c.prefix_sums(raw)
    start, end, _ = c.spans(~c.SPACE[raw], off)
    chosen = end[c.span_hash(prefix, start, end) % CUT == 0]
    inside = raw != 0x0A
    if len(raw):
        after = np.zeros(len(raw) + 1, bool)
        after[1:] = END[raw]
        after[chosen] = True
        inside &= ~(c.SPACE[raw] & after[:-1])
    start, end, first = c.spans(inside, off)
    key = c.span_hash(prefix, start, end)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    again = np.zeros(len(key), np.int64)
    same = np.concatenate(([False], (key[1:] == key[:-1]) & (row[1:] == row[:-1]))) if len(key) else np.zeros(0, bool)
    run = np.flatnonzero(~same)
    again = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    return np.where(again > 0, c.mix(key + again.astype(np.uint64) * np.uint64(c.BASE)), key), row


def check_of(key: np.ndarray) -> np.ndarray:
    return c.mix(key ^ np.uint64(0xA5A5A5A5DEADBEEF)) & np.uint64(0xFFFFFFFF)


def cells_of(key: np.ndarray, size: int) -> np.ndarray:
    """[part, key]: the cell of each key in each part of a table of PARTS * size cells."""
    return np.stack([j * size + (c.mix(key + np.uint64(c.BASE * (size * PARTS + j + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64) for j in range(PARTS)])


class Tables:
    """Tables of several rows, [row, cell]."""

    def __init__(self, rows: int, size: int):
        self.size = size
        self.count = np.zeros((rows, PARTS * size), np.int64)
        self.key = np.zeros((rows, PARTS * size), np.uint64)
        self.check = np.zeros((rows, PARTS * size), np.uint64)

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray) -> None:
        unsigned, check = sign.astype(np.uint64), check_of(key)  # -1 wraps around
        for cell in cells_of(key, self.size):
            at = row * self.count.shape[1] + cell
            np.add.at(self.count.reshape(-1), at, sign)
            np.add.at(self.key.reshape(-1), at, key * unsigned)
            np.add.at(self.check.reshape(-1), at, check * unsigned)

    def minus(self, left: np.ndarray, right: np.ndarray) -> Tables:
        out = Tables(0, self.size)
        out.count, out.key, out.check = self.count[left] - self.count[right], self.key[left] - self.key[right], self.check[left] - self.check[right]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, sign of each recovered key; whether a row came out empty). Empties the tables."""
        rows, keys, signs = [], [], []
        while True:
            row, cell = np.nonzero(np.abs(self.count) == 1)
            sign = self.count[row, cell]
            key = self.key[row, cell] * sign.astype(np.uint64)
            pure = self.check[row, cell] * sign.astype(np.uint64) == check_of(key)
            row, key, sign = row[pure], key[pure], sign[pure]
            if not len(row):
                break
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
            row, key, sign = row[new], key[new], sign[new]
            self.add(row, key, -sign)
            rows.append(row)
            keys.append(key)
            signs.append(sign)
        none = [np.zeros(0, np.int64)]
        empty = ~(self.count.any(axis=1) | self.key.any(axis=1))
        return np.concatenate(rows or none), np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(signs or none), empty


def differences(key: np.ndarray, row: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Tables]:
    """For pairs of rows: (pair, key, sign of each digest in one only; cells used for each pair; the first tables)."""
    out, used, size, base = [], np.zeros(len(left), np.int64), BASE_CELLS, None
    first = np.searchsorted(row, np.arange(n + 1))
    open_ = np.arange(len(left))
    while len(open_) or base is None:
        need = np.unique(np.concatenate((left[open_], right[open_]))) if base is not None else np.arange(n)
        at = np.zeros(n, np.int64)
        at[need] = np.arange(len(need))
        count = np.diff(first)[need]
        of = np.repeat(first[need], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        tables = Tables(len(need), size)
        tables.add(at[row[of]], key[of], np.ones(len(of), np.int64))
        base = base or tables
        rows, keys, signs, empty = tables.minus(at[left[open_]], at[right[open_]]).peel()
        good = empty[rows]
        out.append((open_[rows[good]], keys[good], signs[good]))
        used[open_] = PARTS * size
        open_ = open_[~empty]
        size *= GROWTH
    return *(np.concatenate(x) for x in zip(*out)), used, base


def likeness(key, row, n, left, right):
    """(share of digests that two rows have in common: 1 if both have none; differing digests; cells; first tables)."""
    pair, _, _, used, base = differences(key, row, n, left, right)
    differing = np.bincount(pair, minlength=len(left))
    size = np.bincount(row, minlength=n)
    total = size[left] + size[right]
    return np.where(total > 0, (total - differing) / np.maximum(total, 1), 1.0), differing, used, base


def written(tables: Tables) -> list[str]:
    """Each row's cells as base64: count, sum of digests, sum of checks, in 4, 8 and 4 bytes."""
    cell = np.zeros(tables.count.shape, np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
    cell["count"], cell["key"], cell["check"] = tables.count, tables.key, tables.check & np.uint64(0xFFFFFFFF)
    return [base64.b64encode(x.tobytes()).decode() for x in cell]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def compared(batches):
    """Rows (left, right): likeness, and the digests that only one side has."""
    for batch in batches:
        both = [(batch.column(k).to_pylist()) for k in range(2)]
        n = batch.num_rows
        key, row = digests(*joined([x or "" for x in both[0] + both[1]]))
        pair, keys, signs, used, _ = differences(key, row, 2 * n, np.arange(n), np.arange(n) + n)
        near, *_ = likeness(key, row, 2 * n, np.arange(n), np.arange(n) + n)
        sides = []
        for sign in (1, -1):
            own = signs == sign
            order = np.argsort(pair[own], kind="stable")
            sides.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(pair[own][order], np.arange(n + 1)), pa.int32()), pa.array(keys[own][order].view(np.int64))))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(near), *sides, pa.array(used)], names=[*batch.schema.names[2:], "near", "only_left", "only_right", "cells"])


def compare(versions: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """For two texts a row: (near, only_left, only_right: array<long> of paragraph digests, cells), after the other columns, in place
    of those of these names.

    Null texts count as empty; two empty ones have near = 1.
    """
    c.prepare(versions.sparkSession)
    rest = [x for x in versions.columns if x not in (left, right, "near", "only_left", "only_right", "cells")]
    rows = versions.select(left, right, *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(compared, schema + ", " * bool(schema) + "near double, only_left array<long>, only_right array<long>, cells long")


# ---------------------------------------------------------------- neighbours in the order of ids

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_changed long, n_cells long"


def edits(ids: list, texts: list[str]) -> pa.RecordBatch:
    """For texts[:-1], each with the one after it as its next."""
    own, n = texts[:-1], len(texts) - 1
    changed = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, texts[1:])]
    raw, off = joined(texts + changed)
    key, row = digests(raw, off)
    left = np.arange(n)
    near, differing, used, base = likeness(key, row, 2 * n + 1, np.tile(left, 2), np.concatenate((left + n + 1, left + 1)))
    prints = written(base)
    data = memoryview(raw.tobytes())
    shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[n + 1 : -1].tolist(), off[n + 2 :].tolist())]
    cols = [pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), c.strings(shas), c.strings(prints[:n]), c.strings(prints[n + 1 :]), pa.array(near[:n]), pa.array(near[n:]), pa.array(differing[:n]), pa.array(used[:n])]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])


def neighbours(batches):
    """Rows (bucket, guest, doc_id, text) in order; the guest at a bucket's end is the first row of the next one."""
    bucket, over, ids, texts, size = None, False, [], [], 0
    for batch in batches:
        for b, guest, doc_id, text in zip(*(x.to_pylist() for x in batch.columns)):
            if b != bucket:
                bucket, over, ids, texts, size = b, False, [], [], 0
            if over:
                continue
            over = guest == 1
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if len(texts) > 1 and (size > c.SLICE_BYTES or over or len(texts) > 512):
                yield edits(ids[:-1], texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def edited_neighbours(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For each row of docs (doc_id, text): its text's fingerprint, that of the text edited with the next row, and how like
    its own the edited one's and the next row's are.

    Next goes by ascending doc_id, a null id first, equal ids by text; the last row's next is the first, and a single row's
    is itself. Null texts are empty. Rows are dealt by ranges of ids, once; the first row of a range is also sent to the
    range before it.
    """
    spark = docs.sparkSession
    c.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(1 + total // bucket_bytes, MAX_BUCKETS)
    bounds = np.unique(rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids):
        out = np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).min).astype("int64"), "right")
        return ids.__class__(out.astype("int32"))

    rows = rows.withColumn("bucket", bucket_of(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    starts = sorted((r["bucket"], r["low"]) for r in rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("low")).collect())  # a row a bucket
    before = {low: starts[k - 1][0] for k, (_, low) in enumerate(starts)}
    lows = np.array(sorted(before), np.int64)
    to = np.array([before[x] for x in lows.tolist()], np.int32)

    @F.pandas_udf("int")
    def guest_of(ids):
        at = np.minimum(np.searchsorted(lows, ids), max(0, len(lows) - 1))
        return ids.__class__(np.where(lows[at] == ids.to_numpy(), to[at], -1).astype("int32"))

    if not starts:
        return spark.createDataFrame([], RESULT)
    rows = rows.withColumn("to", guest_of(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    one = F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))
    two = F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest")))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("to") >= 0, two).otherwise(one)).alias("place"))
    rows = rows.select("place.bucket", "place.guest", "doc_id", "text").repartition(len(starts), "bucket")
    return rows.sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "text").mapInArrow(neighbours, RESULT)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(c.table(spark, sf_dir, "documents"))
