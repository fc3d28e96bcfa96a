"""Token counts: batches of distinct pieces are encoded in Arrow functions, which return lengths only.

A safe boundary is a place that no token can span. For a SentencePiece BPE model that puts a mark in front of words and changes nothing
else, it is a space behind a character that is no space or mark, if no token has a mark behind another character: merges stay on
either side of it, and the mark that a piece gets in front stands for the space. Texts are cut at all such places, the distinct
pieces of a slice are encoded once, and texts over `long` bytes are dealt over tasks as runs of pieces of about `piece` bytes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Texts of more bytes are dealt over tasks, in parts of about PIECE bytes.
LONG, PIECE = 1 << 20, 1 << 18
#: Tokens that a context holds.
LIMIT = 4096
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizer:
    """The library for a model file: sentencepiece for .model, tokenizers for .json."""

    def __init__(self, path: str):
        self.safe = False
        if path.endswith(".json"):
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths_of = lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths_of = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            proto = sentencepiece_model_pb2.ModelProto()
            with open(path, "rb") as f:
                proto.ParseFromString(f.read())
            norm, train = proto.normalizer_spec, proto.trainer_spec
            plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not train.treat_whitespace_as_suffix
            own = [p.piece for p in proto.pieces if p.type == p.USER_DEFINED]
            self.safe = bool(plain and train.model_type == train.BPE and not own and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces))

    def boundaries(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The spaces of rows (off) that are safe boundaries; none in front or at the end of a row."""
        if not self.safe:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(raw == 0x20)
        row = np.searchsorted(off, at, "right") - 1
        at = at[(at > off[row]) & (at + 1 < off[row + 1])]
        mark = (raw[at - 1] == 0x81) & (raw[at - 2] == 0x96) & (raw[at - 3] == 0xE2)  # a row's first bytes are never the rest of a character
        return at[(raw[at - 1] != 0x20) & ~mark]

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of tokens of each row."""
        at, some = self.boundaries(raw, off), np.diff(off) > 0
        start, end = np.sort(np.concatenate((off[:-1][some], at + 1))), np.sort(np.concatenate((off[1:][some], at)))
        if not len(start):
            return np.zeros(len(off) - 1, np.int64)
        _, index, inverse = np.unique(c.span_hash(c.prefix_sums(raw), start, end), return_index=True, return_inverse=True)
        data = raw.tobytes()
        each = np.array(self.lengths_of([data[a:b].decode() for a, b in zip(start[index].tolist(), end[index].tolist())]), np.int64)
        return np.bincount(np.searchsorted(off, start, "right") - 1, each[inverse], len(off) - 1).astype(np.int64)

    def parts(self, text: bytes, piece: int) -> list[bytes]:
        """A text cut at safe boundaries into parts of `piece` bytes or, up to the next boundary, more."""
        raw = np.frombuffer(text, np.uint8)
        at, out, start = self.boundaries(raw, np.array([0, len(raw)])), [], 0
        while (k := int(np.searchsorted(at, start + piece))) < len(at):
            out.append(text[start : at[k]])
            start = int(at[k]) + 1
        return [*out, text[start:]]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def measured(path: str):
    """Batches whose last column is a text, with its number of tokens instead."""

    def run(batches):
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for lo, hi, raw, off in c.slices(*c.texts_of(text)):
                rest = [x.slice(lo, hi - lo) for x in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(tokenizer(path).lengths(raw, off))], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def dealt(path: str, piece: int):
    """Parts of long texts, numbered; `deal` differs between a task's rows, so that parts of equal rows are dealt as well."""

    def run(batches):
        deal = 0
        for batch in batches:
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                parts, deal = tokenizer(path).parts(text.as_py().encode(), piece), deal + 1
                same = [pa.array([x[k].as_py()] * len(parts), x.type) for x in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), deal % (1 << 31), np.int32)), c.strings([p.decode() for p in parts])], names=[*batch.schema.names[:-1], "no", "deal", "text"])

    return run


def count(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row: the tokens that the library gives for the whole text, without added ones.

    Null and empty texts have none. Ids may be null or repeat: each row gives one row. Other columns are not read. A text is exact at
    any length; one without a safe boundary, and every text of a .json model, for which none are known, is encoded as a whole.
    """
    c.prepare(docs.sparkSession)
    path = model or default_model()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    short = rows.where(F.col("n_bytes") <= long).mapInArrow(measured(path), "doc_id long, n_bytes long, n_tokens long")
    parts = rows.where(F.col("n_bytes") > long).select(F.xxhash64("text").alias("hash"), "doc_id", "n_bytes", "text")
    parts = parts.mapInArrow(dealt(path, piece), "hash long, doc_id long, n_bytes long, no int, deal int, text string").repartition("hash", "no", "deal")
    parts = parts.select("hash", "doc_id", "n_bytes", "no", "text").mapInArrow(measured(path), "hash long, doc_id long, n_bytes long, no int, n_tokens long")
    # equal rows come as one group, of `rows` rows
    whole = parts.groupBy("hash", "doc_id", "n_bytes").agg(F.count_if(F.col("no") == 0).alias("rows"), F.sum("n_tokens").alias("n"))
    whole = whole.select("doc_id", "n_bytes", F.expr("n div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row")).drop("row")
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(c.table(spark, sf_dir, "documents"))
