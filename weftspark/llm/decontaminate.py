"""Benchmark decontamination by winnowing.

Words are hashed in numpy. Of the k-grams of words, the least hash of each w neighbours is kept (k + w - 1 = window), so
any span of `window` words that a document and an item share holds a fingerprint of both. Where a document's fingerprint is
one of the benchmark's, the windows around it are looked up among the benchmark's distinct windows and compared word by word;
each of these has a list of its items, so a prompt that all items share is one window and not all pairs of its occurrences.
Items of fewer words are found by one hash over all their words, at every place of a document.

A benchmark of up to BLOCK_BYTES is broadcast. Windows of a larger one are joined by a shuffle of fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Lower-case words: bytes of digits, a to z, and of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: The largest benchmark that is broadcast, in bytes of text.
BLOCK_BYTES = 8 << 20
#: Items that one batch of results lists, but for a single document with more.
LISTED = 1 << 20

RESULT = "doc_id long, n_words long, n_hit long, spans array<int>, items array<string>"


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end)."""
    low = c.LOWER[raw]
    start, end, first = c.spans(WORD[low], off)
    return c.span_hash(c.prefix_sums(low), start, end), first


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, without regard to rows."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(c.BASE) + hashes[j : j + n]
    return c.mix(out)


def fits(first: np.ndarray, size: int) -> np.ndarray:
    """For each word, whether `size` words from there on are in its row."""
    n = np.diff(first)
    left = np.repeat(first[1:], n) - np.arange(first[0], first[-1])
    return left >= size


def least_grams(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of whole windows in their rows, the least k-gram of each)."""
    gram = grams(hashes, k)
    w = window - k + 1
    least = c.window_min(gram, w) if len(gram) >= w else gram[:0]
    start = np.flatnonzero(fits(first, window)[: len(least)])
    return start, least[start]


def fingerprinted(hashes: np.ndarray, first: np.ndarray, size: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, fingerprints) of all spans of `size` words; a span of fewer words than a window is its own fingerprint."""
    if size == window:
        return least_grams(hashes, first, k, window)
    gram = grams(hashes, size)
    start = np.flatnonzero(fits(first, size)[: len(gram)])
    return start, gram[start]


def span_hashes(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for j in range(size):
        out = out * np.uint64(c.BASE) + hashes[start + j]
    return c.mix(out + np.uint64(size))


def item_spans(hashes: np.ndarray, first: np.ndarray, k: int, window: int):
    """(size, starts, fingerprints) of the spans that count: windows of items, and whole items of fewer words."""
    size = np.diff(first)
    yield window, *least_grams(hashes, first, k, window)
    for n in np.unique(size[(size > 0) & (size < window)]).tolist():
        at = first[:-1][size == n]
        yield n, at, grams(hashes, n)[at]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted array, or -1. Runs of equal values are looked up once."""
    if not len(known) or not len(values):
        return np.full(len(values), -1)
    run = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    at = np.minimum(np.searchsorted(known, values[run]), len(known) - 1)
    return np.repeat(np.where(known[at] == values[run], at, -1), np.diff(np.append(run, len(values))))


class Index:
    """The distinct spans of some items by their fingerprints, each with the list of its items."""

    def __init__(self, names: list[str], hashes: np.ndarray, first: np.ndarray, k: int, window: int):
        self.names, self.hashes, self.k, self.window = names, hashes, k, window
        item = np.repeat(np.arange(len(names)), np.diff(first))
        self.tables, begin, items, spans = {}, [], [], 0
        for size, start, prints in item_spans(hashes, first, k, window):
            keys, at, of = np.unique(span_hashes(hashes, start, size), return_index=True, return_inverse=True)
            pairs = np.unique(of * len(names) + item[start])
            self.tables[size] = np.unique(prints), keys, start[at], spans
            begin.append(np.searchsorted(pairs // len(names), np.arange(len(keys))) + sum(map(len, items)))
            items.append(pairs % len(names))
            spans += len(keys)
        self.items = np.concatenate(items)
        self.begin = np.append(np.concatenate(begin), len(self.items))  # of each span's list

    def hits(self, hashes: np.ndarray, first: np.ndarray):
        """(first word, word after the last, number of the span) of what documents share with items."""
        for size, (prints, keys, places, base) in self.tables.items():
            start, own = fingerprinted(hashes, first, size, self.k, self.window)
            start = start[among(own, prints) >= 0]
            span = among(span_hashes(hashes, start, size), keys)
            start, span = start[span >= 0], span[span >= 0]
            same = np.ones(len(start), bool)
            for j in range(size):
                same &= hashes[start + j] == self.hashes[places[span] + j]
            start = start[same]
            yield start, start + size, span[same] + base

    def listed(self, row: np.ndarray, span: np.ndarray, rows: int):
        """(first row, last row + 1, items of each row as an Arrow array), in batches of about LISTED items."""
        pairs = np.unique(row * len(self.begin) + span)
        row, span = pairs // len(self.begin), pairs % len(self.begin)
        n = self.begin[span + 1] - self.begin[span]
        size = np.concatenate(([0], np.cumsum(np.bincount(row, n, rows)))).astype(np.int64)
        lo = 0
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + LISTED, "right")) - 1)
            a, b = np.searchsorted(row, (lo, hi))
            m = n[a:b]
            item = self.items[np.repeat(self.begin[span[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            both = np.unique((np.repeat(row[a:b], m) - lo) * max(1, len(self.names)) + item)
            of = np.searchsorted(both // max(1, len(self.names)), np.arange(hi - lo + 1))
            yield lo, hi, pa.ListArray.from_arrays(pa.array(of, pa.int32()), c.strings([self.names[i] for i in (both % max(1, len(self.names))).tolist()]))
            lo = hi


def covered(begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each row (words first[i] to first[i + 1]): the number of words in a span, and runs of them."""
    depth = np.zeros(first[-1] + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    hit = np.cumsum(depth)[:-1] > 0
    s, e, run_of = c.spans(hit, first)
    within = np.repeat(first[:-1], np.diff(run_of))
    flat = np.stack((s - within, e - within), 1).ravel().astype(np.int32)
    return np.diff(np.concatenate(([0], np.cumsum(hit)))[first]), pa.ListArray.from_arrays(pa.array(2 * run_of, pa.int32()), pa.array(flat))


def searched(index):
    def run(batches):
        held: Index = index.value
        for batch in batches:
            for lo, hi, raw, off in c.slices(*c.texts_of(batch.column(1))):
                hashes, first = words(raw, off)
                begin, end, span = (np.concatenate(x) for x in zip(*held.hits(hashes, first)))
                n_hit, spans = covered(begin, end, first)
                n_words = np.diff(first)
                for a, b, items in held.listed(np.searchsorted(first, begin, "right") - 1, span, hi - lo):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), pa.array(n_words[a:b]), pa.array(n_hit[a:b]), spans.slice(a, b - a), items], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return run


def unhit(index, at: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, raw, off in c.slices(*c.texts_of(batch.column(at))):
                hashes, first = words(raw, off)
                for begin, _, _ in index.value.hits(hashes, first):
                    keep[lo + np.searchsorted(first, begin, "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def items_of(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """(item, text) and the bytes of all texts."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def broadcast_index(items: DataFrame, window: int, k: int):
    """Of items of at most BLOCK_BYTES, which the callers have seen to."""
    rows = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Index(rows.column("item").to_pylist(), *words(*c.texts_of(rows.column("text"))), k, window))


# ---------------------------------------------------------------- a benchmark too large to broadcast


def dealt_items(k: int, window: int):
    """(size, print, span, item) of each span of items."""

    def run(batches):
        for batch in batches:
            for lo, _, raw, off in c.slices(*c.texts_of(batch.column(1))):
                hashes, first = words(raw, off)
                for size, start, prints in item_spans(hashes, first, k, window):
                    item = batch.column(0).take(pa.array(lo + np.searchsorted(first, start, "right") - 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), size, np.int32)), pa.array(prints.view(np.int64)), pa.array(span_hashes(hashes, start, size).view(np.int64)), item], names=["size", "print", "span", "item"])

    return run


def dealt_texts(sizes: list[int], k: int, window: int):
    """(text, n_bytes, size, print, span, start) of each span of texts (hash, size in bytes, text)."""

    def run(batches):
        for batch in batches:
            for lo, _, raw, off in c.slices(*c.texts_of(batch.column(2))):
                hashes, first = words(raw, off)
                for size in sizes:
                    start, prints = fingerprinted(hashes, first, size, k, window)
                    row = np.searchsorted(first, start, "right") - 1
                    of = pa.array(lo + row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.full(len(start), size, np.int32)), pa.array(prints.view(np.int64)), pa.array(span_hashes(hashes, start, size).view(np.int64)), pa.array((start - first[row]).astype(np.int32))], names=["key", "n_bytes", "size", "print", "span", "start"])

    return run


def joined_spans(texts: DataFrame, items: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits (key, n_bytes, size, span, start), spans of items (size, print, span, item)) of texts (key, n_bytes, text)."""
    found = items.mapInArrow(dealt_items(k, window), "size int, print long, span long, item string").distinct()
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # at most `window` numbers
    own = texts.mapInArrow(dealt_texts(sizes, k, window), "key long, n_bytes int, size int, print long, span long, start int")
    hits = own.join(found.select("size", "print", "span").distinct(), ["size", "print", "span"], "left_semi")
    return hits.select("key", "n_bytes", "size", "span", "start"), found


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __text_key and __text_bytes. What is found depends on the text alone, so results are joined back by it."""
    return docs.withColumn("__text_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__text_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)))


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.groupBy(F.col("__text_key").alias("key"), F.col("__text_bytes").alias("n_bytes")).agg(F.first(text_col).alias("text"))


def counted(batches):
    """(key, n_bytes, doc_id, n_words, n_hit, spans, items) of rows with their words' number and the hits of their texts."""
    for batch in batches:
        n_words, n_hit, spans = [], [], []
        for lo, hi, raw, off in c.slices(*c.texts_of(batch.column(1))):
            _, first = words(raw, off)
            hits = batch.column(2).slice(lo, hi - lo).to_pylist()
            begin, size = ([h[k] + (first[i] if k == "start" else 0) for i, row in enumerate(hits) for h in row or ()] for k in ("start", "size"))
            begin = np.array(begin, np.int64)
            n, runs = covered(begin, begin + np.array(size, np.int64), first)
            n_words.append(np.diff(first))
            n_hit.append(n)
            spans.append(runs)
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_hit)), pa.concat_arrays(spans), batch.column(3)], names=["doc_id", "n_words", "n_hit", "spans", "items"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a window of an item, as of contamination(). Each row is decided by its own text, so
    rows with a null or a repeated id don't go with others. Nothing is shuffled unless the benchmark has over block_bytes."""
    c.prepare(docs.sparkSession)
    items, total = items_of(benchmark, item_col, item_text_col)
    if total <= block_bytes:
        return docs.mapInArrow(unhit(broadcast_index(items, window, k), docs.columns.index(text_col)), docs.schema)
    rows = keyed(docs, text_col)
    hits, _ = joined_spans(distinct_texts(rows, text_col), items, window, k)
    bad = hits.select(F.col("key").alias("__text_key"), F.col("n_bytes").alias("__text_bytes")).distinct()
    return rows.join(bad, ["__text_key", "__text_bytes"], "left_anti").select(docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each row of docs.

    spans: runs of hit words as first, last + 1, first, ... by word; items: distinct ids of items of which a window occurs.
    A null text has no words and is never hit; an item without words is never found; a null item id reads "null". Ids may
    repeat; each row gives one row. A benchmark of up to block_bytes is broadcast; spans of a larger one are joined by a
    shuffle, where each distinct text is searched once.
    """
    c.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items, total = items_of(benchmark, item_col, item_text_col)
    if total <= block_bytes:
        return rows.mapInArrow(searched(broadcast_index(items, window, k)), RESULT)
    rows = keyed(rows, "text")
    hits, found = joined_spans(distinct_texts(rows, "text"), items, window, k)
    names = hits.select("key", "n_bytes", "size", "span").distinct().join(found.select("size", "span", "item").distinct(), ["size", "span"])
    names = names.groupBy("key", "n_bytes").agg(F.collect_set("item").alias("items"))
    hits = hits.groupBy("key", "n_bytes").agg(F.collect_list(F.struct("start", "size")).alias("hits")).join(names, ["key", "n_bytes"])
    hits = hits.select(F.col("key").alias("__text_key"), F.col("n_bytes").alias("__text_bytes"), "hits", "items")
    out = rows.join(hits, ["__text_key", "__text_bytes"], "left").select("doc_id", "text", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.mapInArrow(counted, RESULT)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.array_distinct("items")), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
