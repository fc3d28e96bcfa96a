"""Quality classifier by nearest-neighbour voting.

Terms are hashed words, trigrams of character shapes, and repeated words. Document frequencies are counted over all
documents; labelled rows, at most `max_labelled` of them, give latent-semantic vectors, which are broadcast. Each document's
cosines with all of them are computed exactly, in blocks, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Buckets of shape trigrams, of words, and of all terms with the one for repeated words.
SHAPES, WORDS = 2048, 2047
TERMS = SHAPES + WORDS + 1
#: The bound on labelled rows that are broadcast: the first by hash of doc_id.
MAX_LABELLED = 4000
RANK, NEIGHBOURS, THRESHOLD = 64, 15, 0.3
BLOCK = 256


def shapes() -> np.ndarray:
    """Small letters and bytes beyond ASCII are one class, capitals and digits two more; other bytes their own."""
    out = np.arange(256, dtype=np.uint8)
    out[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0x61
    out[0x41:0x5B] = 0x41
    out[0x30:0x3A] = 0x30
    return out


SHAPE = shapes()


def term_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts [row, term] of whole texts."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    s = SHAPE[raw].astype(np.uint32)
    code = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:] if len(s) > 2 else s[:0]
    within = row[: len(code)] == row[len(row) - len(code) :]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    out = np.bincount((row[: len(code)] * TERMS + bucket)[within], minlength=n * TERMS)
    low = c.LOWER[raw]
    start, end, first = c.spans(~c.SPACE[low], off)
    word = c.span_hash(c.prefix_sums(low), start, end)
    row = np.repeat(np.arange(n), np.diff(first))
    out += np.bincount(row * TERMS + SHAPES + (word % np.uint64(WORDS)).astype(np.int64), minlength=n * TERMS)
    again = np.zeros(len(word), bool)
    for k in (1, 2):
        again[k:] |= (word[k:] == word[: len(word) - k]) & (row[k:] == row[: len(row) - k])
    out += np.bincount(row[again] * TERMS + TERMS - 1, minlength=n * TERMS)
    return out.reshape(n, TERMS)


def blocks(column: pa.Array):
    """(first row, last row + 1, counts) of at most BLOCK rows each."""
    for lo, hi, raw, off in c.slices(*c.texts_of(column)):
        for a in range(0, hi - lo, BLOCK):
            b = min(a + BLOCK, hi - lo)
            yield lo + a, lo + b, term_counts(raw[off[a] : off[b]], off[a : b + 1] - off[a])


def frequencies(batches):
    total, rows = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for _, _, counts in blocks(batch.column(0)):
            total += (counts > 0).sum(axis=0)
            rows += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], rows))], names=["term", "n"])


def counted(batches):
    for batch in batches:
        for lo, hi, counts in blocks(batch.column(2)):
            row, term = np.nonzero(counts)
            off = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(off, pa.array(term, pa.int32())), pa.ListArray.from_arrays(off, pa.array(counts[row, term], pa.int32()))], names=["label", "doc_id", "terms", "counts"])


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # [term, RANK]
    vectors: np.ndarray  # [RANK, labelled row], of length 1
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        z = self.weighted(counts) @ self.axes
        cosine = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)) @ self.vectors
        k = min(k, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        prior = self.labels.mean()
        return np.clip(np.where(total > 1e-9, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), prior), 0, 1)


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, by a randomised range finder with a fixed seed."""
    y = x.T @ np.random.default_rng(1).standard_normal((len(x), rank + 16)).astype(np.float32)
    for _ in range(4):
        y = x.T @ (x @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :rank])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from docs (doc_id, text), all of which count for document frequencies, and labels (doc_id, quality).

    Labelled rows over the bound are chosen by hash, so alike at every size. Null labels and ids are left out; of several
    labels of an id, the largest counts. Without any labelled row, every score is 0.5.
    """
    c.prepare(docs.sparkSession)
    df = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS rows at most
    n = dict(zip(df.column("term").to_pylist(), df.column("n").to_pylist()))
    idf = np.array([np.log((1 + n.get(-1, 0)) / (1 + n.get(t, 0))) + 0.1 for t in range(TERMS)], np.float32)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.checkpoint()
    # twice the bound's share of hashes holds the bound's smallest, so the top-k sort sees few rows more than it gives
    share = 2 * max_labelled / max(1, chosen.count())
    low = chosen.where(F.xxhash64("doc_id") < F.lit(int(-(2**63) + 2**64 * share))) if share < 0.9 else chosen
    chosen = low.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).checkpoint()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", F.col("doc_id").cast("long"), "text").mapInArrow(counted, "label int, doc_id long, terms array<int>, counts array<int>")
    # rows of terms are bounded in bytes, and so is the top-k sort; copies of an id don't pass the bound
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms", "counts")).limit(max_labelled).toArrow()
    y = np.asarray(got.column("label").to_pylist(), np.float64)
    x = np.zeros((len(y), TERMS), np.float32)
    for i, (t, k) in enumerate(zip(got.column("terms"), got.column("counts"))):
        x[i, t.values.to_numpy()] = k.values.to_numpy()
    model = Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((1, 0), np.float32), y)
    if len(y):
        x = model.weighted(x)
        model.axes = latent(x, min(RANK, len(y)))
        z = x @ model.axes
        model.vectors = np.ascontiguousarray((z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).T)
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score (0 to 1, higher: label 1 likelier) as last column, in place of one of that name. Null and empty texts
    get the share of label 1."""
    docs = docs.drop(name)
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(model), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, counts in blocks(batch.column(at)):
                out[lo:hi] = shared.value.scores(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, c.table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
