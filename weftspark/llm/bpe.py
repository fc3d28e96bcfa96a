"""Byte-level BPE encoding and decoding by overlapping chunks.

Pre-tokens are found in numpy from a table of character classes; a text over `chunk` characters is dealt out
as overlapping chunks, whose pre-token boundaries are stitched where those of two neighbours agree. The distinct
pre-tokens of a slice are merged together by the ranks, a round at a time. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

# Code points with Unicode's White_Space property, and the endings that go with an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, BLANK = range(4)
#: Pieces over so many bytes are merged alone.
LONG_PIECE = 512
NEVER = np.iinfo(np.int32).max


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    out[WHITE] = BLANK
    return out


def boundaries(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in rows of code points (rows: off), the end of the last row added.

    The rules of the pattern: letters, numbers and other characters form runs, each with one space before it;
    of blanks before a run, all but the last go together; an apostrophe that begins a run of others takes one of ENDINGS.
    """
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[off] = True
    blank = kind == BLANK
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | first[1:-1]
    start = change.copy()
    space = points == 0x20
    # the last blank before a run starts a pre-token, and if it is a space, takes the run in
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:-1]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = space[:-1] & last[:-1]
    start &= ~joined
    # apostrophes
    at = np.flatnonzero((points == 0x27) & change & ~joined)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    if len(at):
        taken = np.zeros(len(at), bool)
        for ending in ENDINGS:
            end = at + 1 + len(ending)
            ok = ~taken & (end <= n)
            for k, letter in enumerate(ending):
                q = np.minimum(at + 1 + k, n - 1)
                ok &= (points[q] == ord(letter)) & ~first[q]
            taken |= ok
            start[at[ok] + 1] = False
            end = end[ok]
            start[end[end < n]] = True  # what follows is never taken in
    return np.append(np.flatnonzero(start), n)


def stitch(parts: list[tuple[int, np.ndarray]], margin: int) -> np.ndarray:
    """Boundaries of a text from those of its overlapping chunks (start, boundaries from there), in order.

    A boundary that two chunks share splits the text alike for both, as matches depend only on what follows; the last
    `margin` characters of a chunk don't count, as its end may have changed them. Where two share none, returns None.
    """
    start, bounds = parts[0]
    done, last = [], bounds + start
    for start, bounds in parts[1:]:
        here = bounds + start
        tail = last[np.searchsorted(last, start, "right") :]
        common = np.intersect1d(tail[tail < last[-1] - margin], here, assume_unique=True)
        if not len(common):
            return None
        done.append(last[: np.searchsorted(last, common[0])])
        last = here[np.searchsorted(here, common[0]) :]
    return np.concatenate([*done, last])


class Pairs:
    """Lookup of a pair of ids in numpy: a few tables by multiplicative hash, each holding what found no place before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels, size = [], 20
        while len(keys):
            factor = np.uint64(c.BASE + 2 * len(self.levels))
            slot = (keys * factor) >> np.uint64(64 - size)
            table, value = np.full(1 << size, -1, np.int64), np.full(1 << size, NEVER, np.int32)
            table[slot], value[slot] = keys.astype(np.int64), values
            self.levels.append((factor, np.uint64(64 - size), table, value))
            left = table[slot] != keys.astype(np.int64)
            keys, values, size = keys[left], values[left], max(10, size - 2)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NEVER, np.int32)
        for factor, shift, table, value in self.levels:
            slot = (keys * factor) >> shift
            out = np.where(table[slot] == keys.astype(np.int64), value[slot], out)
        return out


class Vocabulary:
    """Ranks of a file of base64 tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(left, right, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
        pairs = np.array(pairs, np.uint64).reshape(-1, 3)
        self.pairs = Pairs((pairs[:, 0] << np.uint64(32)) | pairs[:, 1], pairs[:, 2].astype(np.int32))

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces of single-byte ids, symbols[first[i]:first[i+1]]: in each round every piece merges its pair of
        lowest rank, leftmost first, until it has none that is a token. Returns (ids, first id of each piece and the end)."""
        names = np.arange(len(first) - 1)
        done, done_names, done_sizes = [], [], []
        if (long := np.diff(first) > LONG_PIECE).any():
            for i in np.flatnonzero(long).tolist():
                done.append(self.merge_long(symbols[first[i] : first[i + 1]]))
                done_names.append(names[i : i + 1])
                done_sizes.append(np.array([len(done[-1])]))
            symbols, names, size = symbols[~np.repeat(long, np.diff(first))], names[~long], np.diff(first)[~long]
            first = np.concatenate(([0], np.cumsum(size)))
        rank = np.full(len(symbols), NEVER, np.int32)
        if len(symbols):
            rank[:-1] = self.pairs.get(symbols[:-1], symbols[1:])
            rank[first[1:] - 1] = NEVER
        while len(names):
            size = np.diff(first)
            best = np.minimum.reduceat(rank, first[:-1])
            if (over := best == NEVER).any():
                gone = np.repeat(over, size)
                done.append(symbols[gone])
                done_names.append(names[over])
                done_sizes.append(size[over])
                symbols, rank, names, size, best = symbols[~gone], rank[~gone], names[~over], size[~over], best[~over]
                first = np.concatenate(([0], np.cumsum(size)))
                if not len(names):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            piece = np.searchsorted(first, hit, "right") - 1
            at = hit[np.concatenate(([True], piece[1:] != piece[:-1]))]
            symbols[at] = best
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            rank[at] = rank[at + 1]  # whether a right neighbour is there
            symbols, rank, at = symbols[stays], rank[stays], at - np.arange(len(at))
            first = first - np.arange(len(first))
            right = at[at + 1 < first[1:]]
            rank[at] = NEVER
            rank[right] = self.pairs.get(symbols[right], symbols[right + 1])
            left = at[at > first[:-1]] - 1
            rank[left] = self.pairs.get(symbols[left], symbols[left + 1])
        names, size = np.concatenate(done_names), np.concatenate(done_sizes)
        order = np.argsort(names)
        begin = (np.concatenate(([0], np.cumsum(size)))[:-1])[order]
        size = size[order]
        edge = np.concatenate(([0], np.cumsum(size)))
        return np.concatenate(done)[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])], edge

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long piece, by a heap over linked symbols."""
        part, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: int(self.pairs.get(np.array([part[i]]), np.array([part[j]]))[0])
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(self.pairs.get(symbols[:-1], symbols[1:]).tolist()) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            if part[i] != left or (j := after[i]) >= n or part[j] != right:
                continue  # one of the two has been merged since
            part[i], part[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(a, b)) != NEVER:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return np.array([x for x in part if x >= 0], np.int32)

    def encode(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each pre-token and the end) for pre-tokens raw[bounds[i]:bounds[i+1]]."""
        start, end = bounds[:-1], bounds[1:]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        _, index, inverse = np.unique(c.span_hash(c.prefix_sums(data), start, end), return_index=True, return_inverse=True)
        size = (end - start)[index]
        first = np.concatenate(([0], np.cumsum(size)))
        flat, edge = self.merge(self.single[data[np.repeat(start[index] - first[:-1], size) + np.arange(first[-1])]], first)
        count, begin = np.diff(edge)[inverse], edge[:-1][inverse]
        edge = np.concatenate(([0], np.cumsum(count)))
        return flat[np.repeat(begin - edge[:-1], count) + np.arange(edge[-1])], edge

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first byte of each id and the end)."""
        size = self.sizes[ids]
        edge = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.starts[ids] - edge[:-1], size) + np.arange(edge[-1])], edge


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def code_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the first byte of each and the end."""
    if raw.isascii():
        points = np.frombuffer(raw, np.uint8)
        return points.astype(np.uint32), np.arange(len(points) + 1)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return points, np.concatenate(([0], np.cumsum(size)))


def encode_rows(path: str, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each row and the end) of whole texts."""
    data = raw.tobytes()
    points, at = code_points(data)
    rows = np.searchsorted(at, off)
    bounds = boundaries(points, rows)
    ids, edge = vocabulary(path).encode(data, at[bounds])
    return ids, edge[np.searchsorted(bounds, rows)]


IDS, DIGESTS = "doc_id long, ids array<int>", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(words: Vocabulary, batch: pa.RecordBatch, keep: bool) -> pa.RecordBatch:
    """Of rows (doc_id, ids): DIGESTS, and if `keep`, the ids."""
    column = batch.column(1)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    count, one, two = [], [], []
    for lo, hi, _, _ in c.slices(np.zeros(0, np.uint8), off - off[0], 1 << 19):
        ids = np.asarray(column.values)[off[lo] : off[hi]]
        raw, at = words.decode(ids)
        at, edge = at.tolist(), (off[lo : hi + 1] - off[lo]).tolist()
        data, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
        for a, b in zip(edge, edge[1:]):
            count.append(b - a)
            one.append(hashlib.sha256(data[4 * a : 4 * b]).hexdigest())
            two.append(hashlib.sha256(plain[at[a] : at[b]]).hexdigest())
    cols = [batch.column(0), pa.array(count, pa.int64()), c.strings(one), c.strings(two), column]
    return pa.RecordBatch.from_arrays(cols[: 4 + keep], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep])


def encoded(path: str, finish):
    def run(batches):
        for batch in batches:
            for lo, hi, raw, off in c.slices(*c.texts_of(batch.column(1))):
                ids, edge = encode_rows(path, raw, off)
                yield finish(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))], names=["doc_id", "ids"]))

    return run


def cut_up(chunk: int, overlap: int):
    """Overlapping chunks of long texts, in one pass over each."""

    def run(batches):
        for batch in batches:
            for hash_, doc, text in zip(*(x for x in batch.columns)):
                text, step = text.as_py(), max(1, (4 << 20) // chunk)
                starts = list(range(0, len(text), chunk))
                for a in range(0, len(starts), step):
                    part = starts[a : a + step]
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(part), pa.int64()) for x in (hash_, doc)] + [pa.array([k // chunk for k in part], pa.int32()), pa.array(part, pa.int64()), c.strings([text[k : k + chunk + overlap] for k in part])], names=["hash", "doc_id", "no", "start", "part"])

    return run


def chunk_bounds(batches):
    """Pre-tokens of chunks: boundaries by code points, from the chunk's start."""
    for batch in batches:
        out = [c.blob(boundaries(code_points(x.encode())[0], np.array([0, len(x)]))) for x in batch.column("part").to_pylist()]
        yield batch.append_column("bounds", pa.array(out, pa.binary()))


def chunks_encoded(path: str, margin: int, finish):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        starts, texts = group.column("start").to_pylist(), group.column("part").to_pylist()
        parts = [(s, np.frombuffer(b, np.int64)) for s, b in zip(starts, group.column("bounds").to_pylist())]
        text = "".join([x[: s2 - s] for x, s, s2 in zip(texts, starts, [*starts[1:], 1 << 62])])
        points, at = code_points(data := text.encode())
        if (bounds := stitch(parts, margin)) is None:  # no shared boundary in some overlap: one run over the whole text
            bounds = boundaries(points, np.array([0, len(points)]))
        ids, _ = vocabulary(path).encode(data, at[bounds])
        one = pa.RecordBatch.from_arrays([group.column("doc_id")[:1].combine_chunks(), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        return pa.Table.from_batches([finish(one)]).append_column("rows", group.column("rows")[:1])

    return run


def encode(docs: DataFrame, ranks: str | None = None, chunk: int = 32768, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text", digests_only: bool | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row, as byte-level BPE by the ranks would encode its whole text. With digests_only, the rows of
    digests(): without the ids if true, with them if false; made in the same task as the ids, by one Python process.

    Null and empty texts have no ids. Ids may be null or repeat: each row gives one row. Columns other than the two are
    not read. A text of any length is exact: chunks without a shared boundary are done again as one. Chunks find each other by id
    and hash of the text, so a recomputed task changes nothing.
    """
    c.prepare(docs.sparkSession)
    path, margin, schema = ranks or default_ranks(), 8, IDS if digests_only is None else DIGESTS + ", ids array<int>" * (not digests_only)
    finish = (lambda batch: batch) if digests_only is None else (lambda batch: digest(vocabulary(path), batch, not digests_only))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(encoded(path, finish), schema)
    long = rows.where(F.length("text") > chunk).select(F.xxhash64("text").alias("hash"), "doc_id", "text").mapInArrow(cut_up(chunk, overlap), "hash long, doc_id long, no int, start long, part string")
    # equal rows become one with their number, first within each task, so that no key has more than a task's rows
    long = long.groupBy("hash", "doc_id", "no", "start").agg(F.first("part").alias("part"), F.count("*").alias("rows"))
    long = long.mapInArrow(chunk_bounds, "hash long, doc_id long, no int, start long, part string, rows long, bounds binary")
    long = long.groupBy("doc_id", "hash").applyInArrow(chunks_encoded(path, margin, finish), schema + ", rows long")
    return short.union(long.select(*short.columns, F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row")).drop("row"))


def decode(tokens: DataFrame, ranks: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary): the tokens' bytes, one after another; null ids give empty bytes."""
    path = ranks or default_ranks()

    def run(batches):
        for batch in batches:
            words = vocabulary(path)
            out = [words.decode(np.asarray(ids or [], np.int64))[0].tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, bytes binary")


def digests(tokens: DataFrame, ranks: str | None = None, keep: bool = False) -> DataFrame:
    """Of encode()'s rows: the number of ids, their SHA-256 as little-endian 32-bit numbers, that of the decoded bytes, and if `keep`, the ids."""
    path = ranks or default_ranks()

    def run(batches):
        for batch in batches:
            yield digest(vocabulary(path), batch, keep)

    return tokens.mapInArrow(run, DIGESTS + ", ids array<int>" * keep)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(c.table(spark, sf_dir, "documents"), digests_only=True)
