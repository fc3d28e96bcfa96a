"""What substring operators share: chunks of documents, anchors that equal passages have in common, and answers by chunk.

A window's anchor is the place of its least k-gram hash, so equal windows have equal anchors at equal places. Each anchor
stands for a run of windows, a piece. Only pieces whose anchor occurs twice in the corpus are exchanged. An anchor with very
many unlike pieces (a common line in unlike surroundings) is split: its pieces go as single windows, dealt by the hash of the
whole window, and again only those that occur twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Text in a chunk, and in what one range of anchors gathers, about.
CHUNK_BYTES = 4 << 20
#: Unlike pieces that one anchor (or block) gathers in a range; those of one with more are split.
HOT = 1024
LOWEST = np.iinfo(np.int64).min
KEYS = "key long, chunk int, n int"
#: Kinds of known keys: of whole pieces, of pieces to be split, of blocks, of blocks to be split, of single windows.
WHOLE, SPLIT, BLOCK, SPLIT_BLOCK, WINDOW = range(5)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, tie, text) and the number of chunks. Rows are dealt by id and tie, a hash of the text, so that many
    rows of one id are no single chunk; only rows that are equal are always together."""
    c.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(LOWEST)), "tie"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "tie", "text"), n


def laid(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk in order of id (null first) and tie: (ids, ids with null as the lowest, ties, bytes, offsets)."""
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("tie", "ascending")], null_placement="at_start"))
    ids = table.column("doc_id").combine_chunks()
    raw, off = c.texts_of(table.column("text"))
    return ids, pc.fill_null(ids, LOWEST).to_numpy(), table.column("tie").to_numpy(), raw, off


def anchors(gram: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From k-gram hashes at each place of rows (first), in order: the anchor of each run of windows with one anchor, and the
    first and last start of its windows. Of equal least hashes the leftmost is the anchor."""
    none = np.zeros(0, np.int64)
    n = int(first[-1])
    if n < window:
        return none, none, none
    low = np.uint64((1 << n.bit_length()) - 1)
    least = c.window_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), window - k + 1)
    past = np.zeros(n + 1, np.int64)
    np.add.at(past, np.maximum(first[:-1], first[1:] - window + 1), 1)
    np.add.at(past, first[1:], -1)
    start = np.flatnonzero(np.cumsum(past[: len(least)]) == 0)
    if not len(start):
        return none, none, none
    at = (least[start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    return at[new], start[new], start[np.append(new[1:], len(at)) - 1]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass
class Pieces:
    """Runs of windows: key and place of the anchor, first and last start; prefix sums of the bytes or words they are made of;
    the size of a window and the most windows that have one anchor."""

    key: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    prefix: np.ndarray
    window: int
    most: int

    def content(self) -> np.ndarray:
        return c.span_hash(self.prefix, self.low, self.high + self.window) + c.mix((self.at - self.low).astype(np.uint64))

    def blocks(self) -> Pieces:
        """The pieces cut into blocks of windows, the square root of what an anchor stands for at most."""
        return self.cut(max(2, math.isqrt(self.most)))

    def cut(self, width: int) -> Pieces:
        """The pieces cut into runs of windows whose anchors are at places of one multiple of width, keyed by that multiple and
        what all such windows share; so equal windows are in runs of one key."""
        last = (self.at - self.low) // width
        n = last - (self.at - self.high) // width + 1
        of = np.repeat(np.arange(len(n)), n)
        place = (last[of] - np.arange(len(of)) + (np.cumsum(n) - n)[of]) * width
        at, end = self.at[of], self.at[of] - place
        begin = end - width + 1
        key = c.mix(c.span_hash(self.prefix, end, begin + self.window) + place.astype(np.uint64))
        return Pieces(key, at, np.maximum(self.low[of], begin), np.minimum(self.high[of], end), self.prefix, self.window, self.most)

    def of(self, keys: np.ndarray) -> Pieces:
        there = among(self.key, keys)
        return Pieces(self.key[there], self.at[there], self.low[there], self.high[there], self.prefix, self.window, self.most)

    def known(self, keys: dict[int, np.ndarray]) -> Pieces:
        """The pieces that are exchanged, in order of their starts."""
        blocks = self.of(keys[SPLIT]).blocks()
        parts = [self.of(keys[WHOLE]), blocks.of(keys[BLOCK]), blocks.of(keys[SPLIT_BLOCK]).cut(1).of(keys[WINDOW])]
        order = np.argsort(np.concatenate([p.low for p in parts]), kind="stable")
        return Pieces(*(np.concatenate([getattr(p, x) for p in parts])[order] for x in ("key", "at", "low", "high")), self.prefix, self.window, self.most)


def known_keys(table: pa.Table) -> dict[int, np.ndarray]:
    key, kind = table.column("key").to_numpy().view(np.uint64), table.column("kind").to_numpy()
    return {k: np.sort(key[kind == k]) for k in (WHOLE, SPLIT, BLOCK, SPLIT_BLOCK, WINDOW)}


def summed(found: list[Pieces], chunk: int) -> pa.Table:
    """The keys of a chunk's pieces with their numbers of unlike pieces. A key that the chunk holds twice goes out with ~chunk."""
    key, content = (np.concatenate(x) for x in zip(*((p.key, p.content()) for p in found))) if found else [np.zeros(0, np.uint64)] * 2
    _, index, count = np.unique(content, return_index=True, return_counts=True)
    keys, inverse, n = np.unique(key[index], return_inverse=True, return_counts=True)
    total = np.bincount(inverse, count, len(keys))
    return pa.table({"key": keys.view(np.int64), "chunk": np.where(total > 1, ~chunk, chunk).astype(np.int32), "n": n.astype(np.int32)})


def keys_of(pieces):
    """pieces(bytes, offsets) gives a chunk's Pieces as the first of its results."""

    def run(table: pa.Table) -> pa.Table:
        _, _, _, raw, off = laid(table)
        return summed([pieces(r, o)[0] for _, _, r, o in c.slices(raw, off)], table.column("chunk")[0].as_py())

    return run


def parts_of(pieces, single: bool):
    """The same of the blocks of a chunk's pieces whose keys are to be split, or of the single windows of blocks that are; most
    chunks have none."""

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        if not docs.num_rows or not keys.num_rows:
            return summed([], 0)
        _, _, _, raw, off = laid(docs)
        known = known_keys(keys)
        found = [pieces(r, o)[0].of(known[SPLIT]).blocks() for _, _, r, o in c.slices(raw, off)]
        return summed([p.of(known[SPLIT_BLOCK]).cut(1) for p in found] if single else found, docs.column("chunk")[0].as_py())

    return run


def met(hot: int | None, few: int, many: int):
    """(chunk, key, kind) of the keys of a partition that occur twice; kind is many for those of over hot unlike pieces."""

    def run(batches):
        got = [tuple(np.asarray(b.column(x)) for x in ("key", "chunk", "n")) for b in batches]
        if not sum(len(x[0]) for x in got):
            return
        key, chunk, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(key)
        key, chunk, n = key[order], chunk[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rows = np.diff(np.append(first, len(key)))
        twice = np.repeat((rows > 1) | np.logical_or.reduceat(chunk < 0, first), rows)
        kind = np.full(len(first), few) if hot is None else np.where(np.add.reduceat(n.astype(np.int64), first) > hot, many, few)
        key, chunk, kind = key[twice], chunk[twice], np.repeat(kind, rows)[twice].astype(np.int32)
        chunk = np.where(chunk < 0, ~chunk, chunk)
        for a in range(0, len(key), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in (chunk, key, kind)], names=["chunk", "key", "kind"])

    return run


def resolved(docs: DataFrame, chunks: int, pieces, cut, cut_schema: str, resolve, finish, finish_schema: str, hot: int = HOT) -> DataFrame:
    """docs (chunk, doc_id, tie, text) -> finish(chunk, what resolve() says about it).

    cut(chunk, known keys) makes rows of cut_schema; resolve() turns their DataFrame into rows (chunk, start, end: binary). The
    text is shuffled once: the five uses of docs share its exchange. A partition of keys has those of about 16 chunks.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + chunks // 16)

    def twice(keys: DataFrame, hot: int | None, few: int, many: int) -> DataFrame:
        return keys.repartition(parts, "key").mapInArrow(met(hot, few, many), "chunk int, key long, kind int")

    def parted(keys: DataFrame, single: bool) -> DataFrame:
        return by_chunk_.cogroup(keys.groupBy("chunk")).applyInArrow(parts_of(pieces, single), KEYS)

    by_chunk_ = docs.groupBy("chunk")
    keys = twice(by_chunk_.applyInArrow(keys_of(pieces), KEYS), hot, WHOLE, SPLIT)
    split = keys.where(F.col("kind") == SPLIT)
    blocks = twice(parted(split, False), hot, BLOCK, SPLIT_BLOCK)
    single = twice(parted(split.union(blocks.where(F.col("kind") == SPLIT_BLOCK)), True), None, WINDOW, WINDOW)
    rows = by_chunk_.cogroup(keys.union(blocks).union(single).groupBy("chunk")).applyInArrow(cut, cut_schema)
    return by_chunk_.cogroup(resolve(rows).groupBy("chunk")).applyInArrow(finish, finish_schema)


SPANS = "chunk int, start binary, end binary"


def by_chunk(chunk: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk, start, end = chunk[order], start[order].astype(np.int32), end[order].astype(np.int32)
    edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))).tolist() if len(chunk) else []
    parts = list(zip(edge, [*edge[1:], len(chunk)]))
    return pa.table({"chunk": pa.array([int(chunk[a]) for a, _ in parts], pa.int32()), "start": pa.array([start[a:b].tobytes() for a, b in parts], pa.binary()), "end": pa.array([end[a:b].tobytes() for a, b in parts], pa.binary())})


def covered(n: int, spans: pa.Table) -> np.ndarray:
    """Which of n places are in a span."""
    depth = np.zeros(n + 1, np.int64)
    for sign, name in ((1, "start"), (-1, "end")):
        for x in spans.column(name).to_pylist():
            np.add.at(depth, np.frombuffer(x, np.int32), sign)
    return np.cumsum(depth)[:-1] > 0


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key; in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
