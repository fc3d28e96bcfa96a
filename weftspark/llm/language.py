"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds a mask of languages in each slot; the AND of an n-gram's slots is the set of languages that
may contain it. A text's n-grams give one popcount per language, which is corrected for the filter's false positives and for
how often texts of the language hit at all; the largest share decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Slots of a filter at least and at most, as powers of two. The filter holds every n-gram that was seen; with more than fit well, it takes
#: more absent ones for present, which is known and corrected. So what is broadcast has a bound that doesn't depend on the corpus.
LEAST_SLOTS, MOST_SLOTS = 16, 24
HASHES = 3
#: Languages of one mask; more languages take more masks.
MOST = 64
NGRAM = 4
LETTER = regex.compile(r"\p{L}")
FACTORS = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]


def plain() -> np.ndarray:
    """Small ASCII letters and bytes beyond ASCII stay; capitals become small; all else is a space."""
    out = np.full(256, 0x20, np.uint8)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


PLAIN = plain()


def ngrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each n-gram of NGRAM bytes, its row); none spans rows, and none has two spaces in a row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    x = np.full(len(raw) + 2 * (len(off) - 1), 0x20, np.uint32)  # a space before and after each row
    x[np.arange(len(raw)) + 2 * row + 1] = PLAIN[raw]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off) + 2)
    n = max(0, len(x) - NGRAM + 1)
    code = np.zeros(n, np.uint32)
    for j in range(NGRAM):
        code = (code << np.uint32(8)) | x[j : j + n]
    gap = (x[:-1] == 0x20) & (x[1:] == 0x20) if len(x) else np.zeros(0, bool)
    keep = row[:n] == row[NGRAM - 1 :][:n]
    for j in range(NGRAM - 1):
        keep &= ~gap[j : j + n]
    return code[keep], row[:n][keep]


def counted(batches):
    """Counts of n-grams by language, summed over all of a task's rows before they leave it."""
    held: dict[str, list] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, raw, off in c.slices(*c.texts_of(batch.column(1))):
            code, row = ngrams(raw, off)
            names = sorted({x for x in langs[lo:hi]})
            of = np.array([names.index(x) for x in langs[lo:hi]])[row] if len(row) else row
            for k, name in enumerate(names):
                codes, n = np.unique(code[of == k], return_counts=True)
                held.setdefault(name, []).append((codes, n))
                if len(held[name]) > 16:
                    held[name] = [summed(held[name])]
    for name, parts in held.items():
        codes, n = summed(parts)
        for a in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes[a : a + (1 << 16)]), pa.string()), pa.array(codes[a : a + (1 << 16)].astype(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["lang", "gram", "n"])


def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    out, inverse = np.unique(codes, return_inverse=True)
    return out, np.bincount(inverse, n, len(out)).astype(np.int64)


def slots_of(code: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of n-grams in a filter of 2**bits."""
    return [(code ^ (code >> np.uint32(15))) * np.uint32(f) >> np.uint32(32 - bits) for f in FACTORS[:HASHES]]


def masked(languages: list[str], bits: int):
    """(word of masks, slot, mask) of n-grams (lang, gram), a row for each of their slots that a batch fills."""

    def run(batches):
        place = {x: j for j, x in enumerate(languages)}
        for batch in batches:
            j = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            at = np.concatenate(slots_of(np.asarray(batch.column(1)).astype(np.uint32), bits)).astype(np.int64)
            word, mask = np.tile(j // MOST, HASHES), np.tile(np.uint64(1) << (j % MOST).astype(np.uint64), HASHES)
            order = np.lexsort((at, word))
            at, word, mask = at[order], word[order], mask[order]
            first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (word[1:] != word[:-1])))) if len(at) else at
            mask = np.bitwise_or.reduceat(mask, first) if len(at) else mask
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(at[first].astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "slot", "mask"])

    return run


@dataclass
class Model:
    languages: list[str]
    slots: list[np.ndarray]  # masks of languages, MOST of them each
    false: np.ndarray  # share of absent n-grams that the filter takes for present, by language
    prior: np.ndarray  # share of all n-grams counted; decides between equal shares

    def masks(self, code: np.ndarray) -> list[np.ndarray]:
        out, at = [], slots_of(code, int(np.log2(len(self.slots[0]))))
        for slots in self.slots:
            got = slots[at[0]]
            for other in at[1:]:
                got = got & slots[other]
            out.append(got)
        return out

    def predict(self, raw: np.ndarray, off: np.ndarray, texts: list) -> tuple[list, np.ndarray]:
        n, k = len(off) - 1, len(self.languages)
        code, row = ngrams(raw, off)
        masks = self.masks(code)
        total = np.bincount(row, minlength=n)
        hits = np.stack([np.bincount(row[(m >> m.dtype.type(j % MOST)) & m.dtype.type(1) != 0], minlength=n) for j in range(k) for m in (masks[j // MOST],)], 1)
        true = np.maximum(hits - total[:, None] * self.false, 0) / np.maximum(1 - self.false, 1e-9)
        share = true / np.maximum(total, 1)[:, None]
        best = np.argmax(share + 1e-9 * self.prior, axis=1)
        names = [self.languages[b] if text and LETTER.search(text) else "und" for b, text in zip(best.tolist(), texts)]
        score = np.clip(share[np.arange(n), best], 0, 1)
        return names, np.where([x == "und" for x in names], 0.0, score)


def fit(docs: DataFrame, most: int = MOST_SLOTS) -> Model:
    """A model from (text, lang); rows with a null in either are left out. All n-grams of a language's texts are in its filter; masks
    are put together in tasks, and the driver gets a row a slot, 2**most for each MOST languages at most. Without any labelled
    text, everything is "und"."""
    c.prepare(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).checkpoint()
    totals = {r["lang"]: (r["total"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(totals)
    if not languages:
        return Model([], [np.zeros(2, np.uint8)], np.zeros(0), np.zeros(0))
    bits = min(most, max(LEAST_SLOTS, int(np.ceil(np.log2(8 * sum(n for _, n in totals.values()))))))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(MOST, len(languages)))
    got = counts.select("lang", "gram").mapInArrow(masked(languages, bits), "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    model = Model(languages, [np.zeros(1 << bits, kind) for _ in range(0, len(languages), MOST)], np.zeros(len(languages)), np.array([totals[x][0] for x in languages]) / max(1, sum(t for t, _ in totals.values())))
    word, slot, mask = (got.column(x).to_numpy() for x in ("word", "slot", "mask"))
    for k, slots in enumerate(model.slots):
        slots[slot[word == k]] = mask[word == k].view(np.uint64).astype(kind)
    for j in range(len(languages)):
        model.false[j] = ((model.slots[j // MOST] >> kind(j % MOST)) & kind(1)).mean() ** HASHES
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1: the share of n-grams in the language, as a share of what its own texts have).

    Columns of these names are replaced. "und" with score 0 if the text is null or has no letter; of languages with equal shares, the one with more text.
    """
    docs = docs.drop("lang_pred", "score")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts, names, scores = batch.column(at), [], []
            for lo, hi, raw, off in c.slices(*c.texts_of(texts)):
                name, score = shared.value.predict(raw, off, texts.slice(lo, hi - lo).to_pylist()) if shared.value.languages else (["und"] * (hi - lo), np.zeros(hi - lo))
                names += name
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, c.strings(names), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
