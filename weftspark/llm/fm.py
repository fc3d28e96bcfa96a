"""Substring dedup with a compressed FM-index per shard.

A shard is a range of anchors' hashes and gets the text of the pieces (runs of windows) whose anchors fall into it. Its words
are numbered, and the pieces that a later document could repeat become an FM-index: a wavelet matrix of packed bits over the
transform of their word numbers. The pieces that an earlier document could hold stream through it by backward search. At each
place the search goes on to the left as long as the interval of suffixes has one of a document with a smaller id (a range
minimum), so it ends with the matching statistic against smaller documents; places where that reaches a window are reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as c
from . import exchange as x

#: Words of a window, and of the k-grams that make anchors.
WINDOW, K = 13, 5
#: Text that a shard gathers, about.
SHARD_BYTES = 4 << 20
#: Places that one pass of the backward search works on.
STEP = 1 << 16

CUT = "range int, chunk int, id binary, key binary, at binary, bytes binary, text binary, n_more binary, more binary, other binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans binary"


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word, and the first word of each row and the end."""
    start, end, first = c.spans(~c.SPACE[raw], off)
    return c.span_hash(c.prefix_sums(raw), start, end), start, end, first


def grams(word: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(word) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(c.BASE) + word[j : j + n]
    return c.mix(out)


def pieces(raw: np.ndarray, off: np.ndarray) -> tuple:
    """(pieces by word, first byte of each word, byte after the last, first word of each row) of some rows."""
    word, start, end, first = words(raw, off)
    gram = grams(word, K)
    at, low, high = x.anchors(gram, first, K, WINDOW)
    return x.Pieces(c.mix(gram[at]) if len(at) else gram[:0], at, low, high, c.prefix_sums(word), WINDOW, WINDOW - K + 1), start, end, first


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start+size] of all spans, one after another."""
    return values[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


def cut(shards: int):
    """A chunk's pieces by shard. Equal pieces of a chunk are one, with the places of the others and whether their document is another."""

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        rows = {name.split()[0]: [] for name in CUT.split(", ")}
        if docs.num_rows and keys.num_rows:
            chunk, known = docs.column("chunk")[0].as_py(), x.known_keys(keys)
            _, ids, _, raw, off = x.laid(docs)
            found, base = [], 0
            for lo, _, part, o in c.slices(raw, off):
                p, start, end, first = pieces(part, o)
                p = p.known(known)
                doc = ids[lo + np.searchsorted(first, p.low, "right") - 1]
                found.append((p.key, doc, p.low + base, p.content(), start[p.low] + off[lo], end[p.high + WINDOW - 1] + off[lo]))
                base += len(start)
            key, doc, low, content, begin, end = map(np.concatenate, zip(*found))
            _, index, inverse, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            place = np.argsort(inverse, kind="stable")  # of each content in order; the first has the smallest id
            head = np.cumsum(count) - count
            of = x.range_of(key[index], shards)
            order = np.argsort(of, kind="stable")
            index, head, count, of = index[order], head[order], count[order], of[order]
            edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist() if len(of) else []
            for a, b in zip(edge, [*edge[1:], len(of)]):
                i, extra = index[a:b], count[a:b] - 1
                more = gathered(place, head[a:b] + 1, extra)
                size = end[i] - begin[i]
                values = (int(of[a]), chunk, doc[i], key[i], low[i].astype(np.int32), size.astype(np.int32), gathered(raw, begin[i], size), extra.astype(np.int32), low[more].astype(np.int32), doc[more] != np.repeat(doc[i], extra))
                for name, value in zip(rows, values):
                    rows[name].append(value if isinstance(value, int) else value.tobytes())
        kinds = {name.split()[0]: pa.int32() if name.endswith("int") else pa.binary() for name in CUT.split(", ")}
        return pa.table({name: pa.array(v, kinds[name]) for name, v in rows.items()})

    return run


class Bits:
    """A bit vector of 64-bit words with a running count: rank of ones in front of a place."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1])).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Minima:
    """The least value of any range, from those of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]
        while 2 ** len(self.rows) <= len(values):
            last, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For values[low:high], none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level).tolist():
            on = np.flatnonzero(level == k)
            out[on] = np.minimum(self.rows[k][low[on]], self.rows[k][high[on] - 2**k])
        return out


class Index:
    """FM-index of codes whose suffixes are in order up to `depth` places; it finds patterns up to that length.

    The last code has to be 0, which no pattern holds. owner[i] is a number of the text that place i is of.
    """

    def __init__(self, code: np.ndarray, owner: np.ndarray, depth: int):
        rank = code.astype(np.int64)
        n, have = len(code), 1
        while have < depth:  # order by prefixes of twice the length, or what is missing
            step = min(have, depth - have)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            order = np.argsort(rank * (rank.max() + 2) + after, kind="stable")
            a, b = rank[order], after[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            have += step
        self.suffix = np.argsort(rank, kind="stable").astype(np.int32)
        self.owners = Minima(owner[self.suffix])
        last = code[self.suffix - 1]
        last[self.suffix == 0] = code[-1]
        codes = int(code.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=codes)))).astype(np.int64)
        self.depth = max(1, (codes - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in reversed(range(self.depth)):
            bit = (last >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            last = np.concatenate((last[~bit], last[bit]))  # a wavelet matrix: zeros first
        self.start_of = np.zeros(codes, np.int64)  # where a code's run begins on the last level
        self.start_of = self.rank(np.arange(codes), np.zeros(codes, np.int64))

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each code stands in front of place i of the transform."""
        for k, level in enumerate(reversed(range(self.depth))):
            one = self.levels[k].rank(i)
            i = np.where(code >> level & 1, self.zeros[k] + one, i - one)
        return i - self.start_of[code]

    def search(self, text: np.ndarray, end: np.ndarray, most: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, matched): for patterns that end before text[end], the length (up to `most`) of the longest that is in an
        indexed text with an owner under `below`, and the interval of suffixes that begin with it. A code over the index's is in none."""
        low, high = np.zeros(len(end), np.int64), np.full(len(end), len(self.suffix), np.int64)
        matched = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        for j in range(1, most + 1):
            code = text[end[live] - j]
            inside = code < len(self.first) - 1
            live, code = live[inside], code[inside]
            ends = self.rank(np.concatenate((code, code)), np.concatenate((low[live], high[live]))) if j > 1 else np.concatenate((np.zeros(len(code), np.int64), self.first[code + 1] - self.first[code]))
            a, b = self.first[code] + ends[: len(live)], self.first[code] + ends[len(live) :]
            good = np.flatnonzero(b > a)
            good = good[self.owners.of(a[good], b[good]) < below[live[good]]]
            live = live[good]
            low[live], high[live] = a[good], b[good]
            matched[live] += 1
            if not len(live):
                break
        return low, high, matched


def matches(code: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray, copied: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of distinct pieces of words (code, one after another; size of each) of documents, with the keys of their anchors and whether
    another document has the piece too: (first, end, first run of each piece and the end) of the runs of windows, by the first one's
    place, that a document smaller than the piece's has; and the same for the copies, which may match the piece's document as well.

    Pieces with one window in common have one key. So of a key's pieces, those of the largest document need not be in the
    index, and those of the smallest need not be searched for, unless they have copies.
    """
    _, of = np.unique(key, return_inverse=True)
    least, most = np.full(len(of), np.iinfo(np.int64).max), np.full(len(of), x.LOWEST)
    np.minimum.at(least, of, doc)
    np.maximum.at(most, of, doc)
    kept = np.flatnonzero((doc < most[of]) | copied)
    begin = np.cumsum(size) - size
    runs, none = np.zeros(len(size) + 1, np.int64), np.zeros(0, np.int64)
    if not len(kept):
        return [(none, none, runs)] * 2
    _, number = np.unique(doc, return_inverse=True)
    edge = np.cumsum(size[kept] + 1)
    text = np.zeros(edge[-1], np.int64)
    text[np.arange(edge[-1] - len(kept)) + np.repeat(np.arange(len(kept)), size[kept])] = gathered(code, begin[kept], size[kept])
    index, out = Index(text, np.repeat(number[kept], size[kept] + 1), WINDOW), []
    for asked, smaller in ((np.flatnonzero(doc > least[of]), number), (np.flatnonzero(copied), number + 1)):
        windows = size[asked] - WINDOW + 1
        end = np.repeat(begin[asked] + WINDOW - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        below = np.repeat(smaller[asked], windows)
        gone = np.zeros(len(code), bool)
        for a in range(0, len(end), STEP):
            e = end[a : a + STEP]
            gone[e[index.search(code, e, WINDOW, below[a : a + STEP])[2] == WINDOW] - WINDOW] = True
        out.append(c.spans(gone, np.append(begin, len(code))))
    return out


def resolve(table: pa.Table) -> pa.Table:
    kinds = {"id": np.int64, "key": np.uint64, "at": np.int32, "bytes": np.int32, "text": np.uint8, "n_more": np.int32, "more": np.int32, "other": np.bool_}
    col = {name: np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()}
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(v) // 8 for v in table.column("id").to_pylist()]).astype(np.int64)
    found = [words(part, o) for _, _, part, o in c.slices(col["text"], np.concatenate(([0], np.cumsum(col["bytes"]))).astype(np.int64))]
    size = np.concatenate([np.diff(first) for *_, first in found])
    _, code = np.unique(np.concatenate([word for word, *_ in found]), return_inverse=True)
    code += 1  # 0 ends a piece
    begin = np.cumsum(size) - size
    # equal pieces are one, of its smallest document; copies in other documents have an answer of their own
    content = c.span_hash(c.prefix_sums(code), begin, begin + size)
    order = np.lexsort((col["id"], content))
    head = np.concatenate(([True], content[order][1:] != content[order][:-1]))
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(head) - 1
    chosen = order[head]
    elsewhere = col["id"] != col["id"][chosen][own]
    extra = np.repeat(np.arange(len(order)), col["n_more"])
    more, other = col["more"].astype(np.int64), col["other"] | elsewhere[extra]
    whose, place = np.concatenate((np.arange(len(order)), extra)), np.concatenate((col["at"].astype(np.int64), more))
    copy = np.concatenate((elsewhere, other))
    copied = np.zeros(len(chosen), bool)
    copied[own[whose[copy]]] = True
    base = np.cumsum(size[chosen]) - size[chosen]
    out = []
    for (s, e, first), mine in zip(matches(gathered(code, begin[chosen], size[chosen]), size[chosen], col["id"][chosen], col["key"][chosen], copied), (~copy, copy)):
        piece, at = own[whose[mine]], place[mine]
        n = np.diff(first)[piece]
        run = np.repeat(first[:-1][piece], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shift = np.repeat(at - base[piece], n)
        out.append((chunk[np.repeat(whose[mine], n)], s[run] + shift, e[run] + shift + WINDOW - 1))
    return x.by_chunk(*(np.concatenate(y) for y in zip(*out)))


def finish(docs: pa.Table, spans: pa.Table) -> pa.Table:
    ids, _, _, raw, off = x.laid(docs)
    total, out = 0, []
    for lo, hi, part, o in c.slices(raw, off):
        _, start, end, first = words(part, o)
        out.append((start + off[lo], end + off[lo], first[:-1] + total))
        total += len(start)
    start, end, first = (np.concatenate([y[k] for y in out]) for k in range(3))
    first = np.append(first, total)
    gone = x.covered(total, spans)
    begin, stop, run = c.spans(gone, first)
    removed = np.concatenate(([0], np.cumsum(gone)))[first]
    # kept words, each with the space after it
    start, size = start[~gone], (end - start)[~gone] + 1
    edge = np.concatenate(([0], np.cumsum(size)))
    within = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    text = np.append(raw, np.uint8(0))[np.minimum(np.repeat(start, size) + within, len(raw))]
    text[edge[1:] - 1] = 0x20
    data, at = memoryview(text.tobytes()), edge[first - removed].tolist()
    shift = np.repeat(first[:-1], np.diff(run))
    flat, run = np.stack((begin - shift, stop - shift), 1).astype("<i4"), run.tolist()
    return pa.table({"doc_id": ids, "n_words": np.diff(first), "n_removed": np.diff(removed), "kept_sha256": c.strings([hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]), "spans": pa.array([flat[a:b].tobytes() for a, b in zip(run, run[1:])], pa.binary())})


def repeated_words(docs: DataFrame, chunk_bytes: int = x.CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, hot: int = x.HOT) -> DataFrame:
    """For each row of docs (doc_id, text): the words covered by a window of WINDOW words that also starts in a document with a
    smaller id.

    (doc_id, n_words, n_removed, kept_sha256, spans: pairs of little-endian 32-bit first word and word after the last). Words are what
    stands between ASCII blanks, unchanged; null and empty texts have none. A null id is smaller than all; rows of one id don't
    match each other, but each matches smaller ids.
    """
    rows, n = x.chunked(docs, chunk_bytes)
    shards = 1 + n * chunk_bytes // shard_bytes
    return x.resolved(rows, n, pieces, cut(shards), CUT, lambda cuts: cuts.groupBy("range").applyInArrow(resolve, x.SPANS), finish, RESULT, hot)


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(c.table(spark, sf_dir, "documents")).drop("spans")


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
r AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + {WINDOW})))) AS gone FROM g JOIN f USING (g) WHERE first < doc_id GROUP BY 1),
k AS (SELECT d.doc_id, w, gone, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)) AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(list_transform(kept, lambda p: w[p]), ' '), '')) AS kept_sha256 FROM k
"""
