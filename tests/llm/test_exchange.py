"""Pieces of very common anchors go as blocks before they go as single windows, and equal windows stay together."""

import numpy as np
import pyarrow as pa

from weftspark.llm import exchange as x
from weftspark.llm import suffix

LINE = b"All rights reserved; see the file that came with this text. "


def texts(n: int = 60) -> list[bytes]:
    rng = np.random.default_rng(3)
    return [bytes(rng.integers(97, 123, 150, np.uint8)) + LINE + bytes(rng.integers(97, 123, 150, np.uint8)) for _ in range(n)]


def pieces_of(rows: list[bytes]) -> x.Pieces:
    off = np.cumsum([0, *map(len, rows)])
    return suffix.pieces(np.frombuffer(b"".join(rows), np.uint8), off)[0]


def windows(p: x.Pieces) -> list[int]:
    return sorted(s for a, b in zip(p.low.tolist(), p.high.tolist()) for s in range(a, b + 1))


def test_blocks_have_each_window_once():
    p = pieces_of(texts())
    for parts in (p.blocks(), p.cut(1), p.blocks().cut(1)):
        assert windows(parts) == windows(p)
        assert (parts.low <= parts.at).all() and (parts.high >= parts.low).all()


def test_equal_windows_have_one_key():
    rows = texts(8)
    rows += [r[7:] for r in rows] + [b"x" * 40 + r[:200] for r in rows]
    data, p = b"".join(rows), pieces_of(rows)
    for parts in (p.blocks(), p.blocks().cut(1)):
        keys: dict = {}
        for key, a, b in zip(parts.key.tolist(), parts.low.tolist(), parts.high.tolist()):
            for s in range(a, b + 1):
                keys.setdefault(data[s : s + suffix.WINDOW], set()).add(key)
        assert max(map(len, keys.values())) == 1 and len(keys) < len(windows(p))


def test_few_rows_for_a_common_line():
    rows = texts()
    p = pieces_of(rows)
    key, count = np.unique(p.key, return_counts=True)
    hot = key[count == count.max()]
    docs = pa.table({"chunk": pa.array([0] * len(rows), pa.int32()), "doc_id": pa.array(range(len(rows)), pa.int64()), "tie": pa.array([0] * len(rows), pa.int64()), "text": [r.decode() for r in rows]})
    keys = pa.table({"chunk": pa.array([0] * len(hot), pa.int32()), "key": pa.array(hot.view(np.int64)), "kind": pa.array([x.SPLIT] * len(hot), pa.int32())})
    single = len(np.unique(p.of(hot).cut(1).key))
    assert len(hot) == 1 and single > 500  # a row a window before
    got = x.parts_of(suffix.pieces, False)(docs, keys)
    assert 0 < got.num_rows < single / 6
