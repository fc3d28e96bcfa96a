"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

The suffixes sorted are those at anchors whose first k bytes occur twice (so they are told apart no further than needed); each is
cut where its piece ends. A chunk sorts its own and sends them front-coded, dealt by ranges of the hash of their first k
bytes. A range merges its runs with a loser tree that compares common-prefix lengths first and never looks at known prefixes
again. Neighbours' common prefixes, and those of the bytes before the anchors, give the classes of equal windows.

With many chunks a run would be cut into as many ranges, down to single suffixes. So runs go through levels: at each, `fan` runs
meet, are merged, and leave as one run cut into `fan` parts, which keeps a message at a chunk's size over `fan` at any scale.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as c
from . import exchange as x

#: Bytes of a window, and of the k-grams that make anchors.
WINDOW, K = 100, 24
HEAD = 8  # bytes of the hash that stands before each suffix

#: Runs that meet at a level, and parts that they leave in.
FAN = 256
#: One row a run; what is binary has a value a suffix (but for tail, left and more).
KINDS = {"chunk": np.int32, "id": np.int64, "tie": np.int64, "key": np.uint64, "at": np.int32, "left_size": np.uint8, "right_size": np.uint8, "common": np.uint8, "n_more": np.int32}
CUT = "range long, team int, " + ", ".join(f"{x} binary" for x in [*KINDS, "tail", "left", "more"])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def pieces(raw: np.ndarray, off: np.ndarray) -> tuple[x.Pieces]:
    """The pieces of some rows, by byte."""
    if len(raw) < WINDOW:
        none = np.zeros(0, np.int64)
        return (x.Pieces(none.astype(np.uint64), none, none, none, np.zeros(1, np.uint64), WINDOW, WINDOW - K + 1),)
    prefix = c.prefix_sums(raw)
    _, inverse = c.powers(len(prefix))
    gram = (prefix[K:] - prefix[:-K]) * inverse[: len(raw) - K + 1]
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(29)
    at, low, high = x.anchors(gram, off, K, WINDOW)
    return (x.Pieces(c.mix(gram[at]), at, low, high, prefix, WINDOW, WINDOW - K + 1),)


def common_prefixes(strings: list[bytes], most: int) -> np.ndarray:
    """Length of the common prefix of each string with the one before it; 0 for the first."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(strings) + bytes(most), np.uint8)
    out = np.zeros(len(strings), np.int64)
    for a in range(0, len(strings), 1 << 13):
        rows = flat[start[max(0, a - 1) : a + (1 << 13), None] + np.arange(most)]
        lengths = size[max(0, a - 1) : a + (1 << 13)]
        same = np.zeros((max(0, len(rows) - 1), most + 1), bool)
        same[:, :most] = (rows[1:] == rows[:-1]) & (np.arange(most) < np.minimum(lengths[1:], lengths[:-1])[:, None])
        out[max(1, a) : max(1, a) + len(same)] = same.argmin(axis=1)
    return out


def sent(cols: dict[str, np.ndarray], suffixes: list[bytes], lefts: list[bytes], more: np.ndarray, ranges: int, team: int) -> pa.Table:
    """One row for each range of a sorted run: cols by suffix, with `common` as the prefix that each shares with the one before it."""
    rows = {name.split()[0]: [] for name in CUT.split(", ")}
    of = x.range_of(cols["key"], ranges)
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else of
    common = cols["common"].copy()
    common[edge] = 0
    cols = cols | {"common": common}
    place = np.concatenate(([0], np.cumsum(cols["n_more"], dtype=np.int64)))
    cuts = common.tolist()
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(of)]):
        values = {"range": int(of[a]), "team": team, "tail": b"".join([s[k:] for s, k in zip(suffixes[a:b], cuts[a:b])]), "left": b"".join(lefts[a:b]), "more": more[place[a] : place[b]].astype(np.int32).tobytes()}
        values |= {name: cols[name][a:b].astype(kind).tobytes() for name, kind in KINDS.items()}
        for name in rows:
            rows[name].append(values[name])
    kinds = {name.split()[0]: {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[name.split()[1]] for name in CUT.split(", ")}
    return pa.table({name: pa.array(v, kinds[name]) for name, v in rows.items()})


def cut(ranges: int, fan: int):
    """A chunk's sorted run of suffixes, a row for each range. Equal pieces of a chunk are one, its later places with it."""

    def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not docs.num_rows or not keys.num_rows:
            return sent({name: none.astype(kind) for name, kind in KINDS.items()}, [], [], none, ranges, 0)
        chunk, known = docs.column("chunk")[0].as_py(), x.known_keys(keys)
        _, ids, tie, raw, off = x.laid(docs)
        found = []
        for lo, _, part, o in c.slices(raw, off):
            p = pieces(part, o)[0].known(known)
            found.append((p.key, p.content(), p.at + off[lo], p.low + off[lo], p.high + off[lo]))
        key, content, at, low, high = map(np.concatenate, zip(*found))
        _, index, inverse, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        places = np.argsort(inverse, kind="stable")  # of each content in order; the first is the one that is sent
        begin = np.cumsum(count) - count
        key, first, low, high = key[index], at[index], low[index], high[index] + WINDOW
        data, heads = raw.tobytes(), key.astype(">u8").tobytes()
        suffixes = [heads[8 * i : 8 * i + 8] + data[a:e] for i, (a, e) in enumerate(zip(first.tolist(), high.tolist()))]
        order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        suffixes = [suffixes[i] for i in order]
        order = np.array(order, np.int64)
        key, first, low, high, begin, extra = (y[order] for y in (key, first, low, high, begin, count - 1))
        doc = np.searchsorted(off, first, "right") - 1
        more = places[np.repeat(begin + 1 - np.cumsum(extra) + extra, extra) + np.arange(extra.sum())]
        cols = {"chunk": np.full(len(key), chunk), "id": ids[doc], "tie": tie[doc], "key": key, "at": first, "left_size": first - low, "right_size": high - first, "common": common_prefixes(suffixes, HEAD + WINDOW), "n_more": extra}
        return sent(cols, suffixes, [data[p:q] for p, q in zip(low.tolist(), first.tolist())], at[more], ranges, chunk // fan)

    return run


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """(run of each string in merged order, common prefix of each with the one before it) of sorted runs and their own common prefixes.

    A loser tree: `have` is a run's common prefix with the string last put out. Of two, the longer common prefix is the lesser
    string; only where they are equal are bytes compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    place = [0] * width
    have = [-1] * width  # -1: the run is at its end, and loses to all others
    head: list = [b""] * width
    for r, (strings, _) in enumerate(runs):
        if strings:
            have[r], head[r] = 0, strings[0]
    tree = [0] * width
    winners = list(range(width))
    while len(winners) > 1:  # the first round of matches
        after = []
        for i in range(0, len(winners), 2):
            a, b = winners[i : i + 2]
            if have[a] == have[b] and have[a] >= 0:
                k = mismatch(head[a], head[b], have[a])
                if head[a][k : k + 1] > head[b][k : k + 1]:
                    a, b = b, a
                have[b] = k
            elif have[b] > have[a]:
                a, b = b, a
            tree[len(winners) // 2 + len(after)] = b
            after.append(a)
        winners = after
    best = winners[0]
    out, common = [], []
    total = sum(len(s) for s, _ in runs)
    for _ in range(total):
        out.append(best)
        common.append(have[best])
        strings, own = runs[best]
        place[best] = i = place[best] + 1
        if i < len(strings):
            have[best], head[best] = own[i], strings[i]
        else:
            have[best] = -1
        node, mine = (width + best) >> 1, have[best]
        while node:
            other = tree[node]
            theirs = have[other]
            if theirs > mine:
                tree[node], best, mine = best, other, theirs
            elif theirs == mine and mine >= 0:
                a, b = head[best], head[other]
                k = mismatch(a, b, mine)
                if a[k : k + 1] > b[k : k + 1]:
                    have[best] = k
                    tree[node], best = best, other
                else:
                    have[other] = k
            node >>= 1
    return out, common


def mismatch(a: bytes, b: bytes, k: int) -> int:
    """The first place from k on where a and b differ, or the end of the shorter."""
    n = min(len(a), len(b))
    x_, y_ = a[k:n], b[k:n]
    if x_ == y_:
        return n
    return k + ((n - k) * 8 - (int.from_bytes(x_) ^ int.from_bytes(y_)).bit_length()) // 8


def unpacked(table: pa.Table):
    """The runs of a range as (suffixes, common prefixes), the bytes before the suffixes, and the columns, joined in the runs' order."""
    cols = {name: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).astype(kind if name == "key" else np.int64) for name, kind in [*KINDS.items(), ("more", np.int32)]}
    sizes = [len(v) for v in table.column("common").to_pylist()]
    runs, lefts, i = [], [], 0
    for n, tail, left in zip(sizes, table.column("tail").to_pylist(), table.column("left").to_pylist()):
        own, a, b, last, strings = slice(i, i + n), 0, 0, b"", []
        common = cols["common"][own].tolist()
        for k, r, m in zip(common, cols["right_size"][own].tolist(), cols["left_size"][own].tolist()):
            last = last[:k] + tail[a : (a := a + HEAD + r - k)]
            strings.append(last)
            lefts.append(left[b : (b := b + m)])
        runs.append((strings, common))
        i += n
    return runs, lefts, cols


def in_order(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each suffix in the runs' order, common prefix with the one before it) in merged order."""
    run, common = merged(runs)
    run = np.array(run, np.int64)
    base = np.cumsum([0, *(len(s) for s, _ in runs)])[:-1]
    seen = np.argsort(run, kind="stable")
    within = np.empty(len(run), np.int64)
    within[seen] = np.arange(len(run)) - np.repeat(np.searchsorted(run[seen], np.arange(len(runs))), np.bincount(run, minlength=len(runs)))
    return base[run] + within, np.array(common, np.int64)


def level(ranges: int, fan: int):
    """Runs that meet, as one run cut by finer ranges for the next level."""

    def run(table: pa.Table) -> pa.Table:
        runs, lefts, cols = unpacked(table)
        order, common = in_order(runs)
        strings = [s for part, _ in runs for s in part]
        place = np.cumsum(cols["n_more"]) - cols["n_more"]
        extra = cols["n_more"][order]
        more = cols["more"][np.repeat(place[order] - np.cumsum(extra) + extra, extra) + np.arange(extra.sum())]
        numbers = order.tolist()
        return sent({name: cols[name][order] for name in KINDS} | {"common": common}, [strings[i] for i in numbers], [lefts[i] for i in numbers], more, ranges, table.column("team")[0].as_py() // fan)

    return run


def duplicates(right: np.ndarray, order: np.ndarray, group: np.ndarray, lefts: list[bytes], left_size: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """[member, o]: whether an earlier member has the window that starts o bytes before the anchor.

    Members are numbered from the earliest to the latest. right[i] is the common prefix of suffixes order[i-1] and order[i] and
    group[m] names members with one anchor.
    """
    n = len(lefts)
    names = [int(g).to_bytes(4) + s for g, s in zip(group.tolist(), lefts)]
    by_left = sorted(range(n), key=names.__getitem__)
    left = common_prefixes([names[i] for i in by_left], 4 + WINDOW) - 4
    by_left = np.array(by_left, np.int64)
    out = np.zeros((n, WINDOW - K + 1), bool)
    of_right, of_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(WINDOW - K + 1):
        valid = np.flatnonzero((left_size >= o) & (right_size >= WINDOW - o))
        if not len(valid):
            continue
        of_right[order] = np.cumsum(right < WINDOW - o)
        of_left[by_left] = np.cumsum(left < o)
        both = (of_right * (n + 1) + of_left)[valid]
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(valid), bool)
        again[first] = False
        out[valid[again], o] = True
    return out


def resolve(table: pa.Table) -> pa.Table:
    runs, lefts, col = unpacked(table)
    order, common = in_order(runs)
    right = common - HEAD
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(right < K)
    many = np.bincount(group)[group] > 1
    # members from the earliest: by id and tie, equal rows are in one chunk, where places go by its rows
    rank = np.lexsort((col["at"], col["tie"], col["id"]))
    rank = rank[many[rank]]
    number = np.full(len(order), -1)
    number[rank] = np.arange(len(rank))
    chosen = many[order]
    # those left out are alone in their groups, so the common prefixes of the others stay right up to a group's edge
    again = duplicates(right[chosen], number[order[chosen]], group[rank], [lefts[i][::-1] for i in rank.tolist()], col["left_size"][rank], col["right_size"][rank])
    edges = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    m, o1 = np.nonzero(edges == 1)
    _, o2 = np.nonzero(edges == -1)
    at = col["at"][rank][m]
    extra = np.repeat(np.arange(len(order)), col["n_more"])
    more = col["more"]
    return x.by_chunk(np.concatenate((col["chunk"][rank][m], col["chunk"][extra])), np.concatenate((at - o2 + 1, more - col["left_size"][extra])), np.concatenate((at - o1 + WINDOW, more + col["right_size"][extra])))


def resolved_in(levels: int, fan: int, chunks: int):
    """Runs to spans: levels that merge and cut again, and a last one that resolves."""

    def run(rows: DataFrame) -> DataFrame:
        for k in range(2, levels + 1):
            rows = rows.groupBy("team", "range").applyInArrow(level(ranges(k, levels, fan, chunks), fan), CUT)
        return rows.groupBy("range").applyInArrow(resolve, x.SPANS)

    return run


def ranges(k: int, levels: int, fan: int, chunks: int) -> int:
    """Ranges that a run is cut into for level k; the last has one a chunk."""
    return chunks if k == levels else fan**k


def finish(docs: pa.Table, spans: pa.Table) -> pa.Table:
    ids, _, _, raw, off = x.laid(docs)
    gone = x.covered(len(raw), spans)
    start, end, first = c.spans(gone, off)
    removed = np.concatenate(([0], np.cumsum(gone)))[off]
    left = memoryview(raw[~gone].tobytes())
    edge = (off - removed).tolist()
    within = np.repeat(off[:-1], np.diff(first))
    flat = np.stack((start - within, end - within), 1).astype("<i4")
    first_ = first.tolist()
    return pa.table({"doc_id": ids, "n_bytes": np.diff(off), "n_removed": np.diff(removed), "n_spans": np.diff(first), "kept_sha256": c.strings([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(edge, edge[1:])]), "spans": pa.array([flat[a:b].tobytes() for a, b in zip(first_, first_[1:])], pa.binary())})


def repeated_bytes(docs: DataFrame, chunk_bytes: int = x.CHUNK_BYTES, fan: int = FAN, hot: int = x.HOT) -> DataFrame:
    """For each row of docs (doc_id, text): the bytes covered by a string of WINDOW bytes that also starts earlier.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: pairs of little-endian 32-bit first byte and byte after the last).
    Texts are UTF-8, null as empty; matches don't cross rows. Earlier is: smaller id, a null id before all; rows of one id go by
    Spark's xxhash64 of their texts, as if one followed the other. All work is dealt by chunks of documents and ranges of
    hashes, which grow in number only.
    """
    rows, n = x.chunked(docs, chunk_bytes)
    levels = 1
    while fan**levels < n:
        levels += 1
    return x.resolved(rows, n, pieces, cut(ranges(1, levels, fan, n), fan), CUT, resolved_in(levels, fan, n), finish, RESULT, hot)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(c.table(spark, sf_dir, "documents")).drop("spans")
