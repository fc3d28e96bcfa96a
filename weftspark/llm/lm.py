"""LM scoring by masked pseudo-likelihood.

Texts become symbols: words that the corpus has often enough, other words as chunks of four bytes, and other chunks as bytes, so
that every word has a probability of its own and none is capped. A network sees the symbols on both sides of a masked one and
gives the probability of each symbol: that of its class, times that of the symbol within the class, both by softmax on the
hidden values. Classes are cut out of the embeddings, so they follow contexts. A document's score is the sum of the conditional
log-probabilities of all its symbols.

Training is data-parallel in rounds; each document is in one. A round's documents are dealt by hash into shards of a given size,
each shard trains from the round's weights, and the weights are averaged. Neither shards nor rounds depend on how the input is
partitioned, and both grow with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: A word or chunk is known if it occurs at least total ** (2/3) / KNOWN times, so at most KNOWN * total ** (1/3) are.
KNOWN = 280
CHUNK = 4  # bytes
EMBEDDED, HIDDEN = 16, 24
#: Places of the window's symbols from the masked one.
WINDOW = (-2, -1, 1, 2)
#: Training masks one in so many symbols, by place; scoring masks every one in turn.
MASKED = 4
BATCH, SCORED, RATE = 8192, 1 << 15, 0.1
#: Rows of one softmax over all classes, which then stays in a processor's cache.
ROWS = 512
#: Text of a shard, at least; and at least so many times the weights, of which each shard returns a copy.
SHARD_BYTES, PER_WEIGHT = 8 << 20, 2
#: Steps that a shard makes at least, by going through a small one repeatedly.
STEPS = 60
BLOCKS, FAN = 32, 64
#: Distinct words that a task sums before it sends them on.
HELD_WORDS = 1 << 20
NONE = np.float32(-1e4)  # bias of a place in a class that no symbol has


def words(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, byte after the last, first word of each row and the end) of lower-case bytes."""
    start, end, first = c.spans(~c.SPACE[low], off)
    return c.span_hash(c.prefix_sums(low), start, end), start, end, first


def chunks(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, first byte, byte after the last) of the words' chunks. The last chunk of a word is told apart from others."""
    n = -(-(end - start) // CHUNK)
    word = np.repeat(np.arange(len(n)), n)
    begin = start[word] + CHUNK * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(begin + CHUNK, end[word])
    padded = np.append(low, np.zeros(CHUNK, np.uint8)).astype(np.uint64)
    code = (stop == end[word]).astype(np.uint64)
    for k in range(CHUNK):
        code = code * np.uint64(257) + np.where(begin + k < stop, padded[begin + k] + np.uint64(1), np.uint64(0))
    return c.mix(code), word, begin, stop


def counted(batches):
    """Counts of words, and of the chunks of words longer than one, summed in the task."""
    held: list = []

    def out():
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def rows(keys, n):
        for a in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["word", "n"])

    for batch in batches:
        for _, _, raw, off in c.slices(*c.texts_of(batch.column(0))):
            low = c.LOWER[raw]
            key, start, end, _ = words(low, off)
            long = end - start > CHUNK
            held.append(np.unique(np.concatenate((key, chunks(low, start[long], end[long])[0])), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD_WORDS:
                held = [out()]
                if len(held[0][0]) > HELD_WORDS // 2:
                    yield from rows(*held.pop())
    if held:
        yield from rows(*out())


@dataclass
class Vocabulary:
    """Symbols: known words and chunks by index, then bytes (twice: inside and at the end of a word), then one for what lies
    beyond a text. Each symbol but the last has a class and a place in it."""

    keys: np.ndarray  # sorted
    count: np.ndarray  # of each symbol that is predicted
    group: np.ndarray
    place: np.ndarray

    @property
    def beyond(self) -> int:
        return len(self.count)

    @property
    def classes(self) -> int:
        return 1 << max(1, round(np.log2(self.beyond) / 2))

    @property
    def width(self) -> int:
        """Places of a class."""
        return -(-self.beyond // self.classes)

    def known(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1)
        if "starts" not in self.__dict__:  # keys are hashes: their leading bits lead near their places
            self.shift = np.uint64(62 - len(self.keys).bit_length())
            self.starts = np.searchsorted(self.keys, np.arange(4 << len(self.keys).bit_length(), dtype=np.uint64) << self.shift)
            self.ended = np.append(self.keys, np.uint64(2**64 - 1))
        at = self.starts[key >> self.shift]
        less = np.flatnonzero(self.ended[at] < key)
        while len(less):
            at[less] += 1
            less = less[self.ended[at[less]] < key[less]]
        return np.where((self.ended[at] == key) & (at < len(self.keys)), at, -1)

    def symbols(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first symbol of each row and the end)."""
        low = c.LOWER[raw]
        key, start, end, first = words(low, off)
        whole = self.known(key)
        rare = np.flatnonzero(whole < 0)
        key, word, begin, stop = chunks(low, start[rare], end[rare])
        part = self.known(key)
        parts = np.where(part < 0, stop - begin, 1)
        size = np.ones(len(whole), np.int64)
        size[rare] = np.bincount(word, parts, len(rare)).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(at[-1], np.int64)
        out[at[:-1][whole >= 0]] = whole[whole >= 0]
        own = size[rare]
        before = np.cumsum(parts) - parts  # of a rare word's chunks, within all rare words
        place = at[rare][word] + before - (np.cumsum(own) - own)[word]
        out[place[part >= 0]] = part[part >= 0]
        spelled = np.flatnonzero(part < 0)
        n = (stop - begin)[spelled]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        byte = np.repeat(begin[spelled], n) + step
        out[np.repeat(place[spelled], n) + step] = len(self.keys) + 2 * low[byte].astype(np.int64) + (byte + 1 == np.repeat(end[rare][word[spelled]], n))
        return out, at[first]

    def classed(self, vectors: np.ndarray) -> Vocabulary:
        """Classes of equal size by halving the symbols along the direction in which their vectors differ most."""
        group = np.zeros(self.beyond, np.int64)
        x = vectors[: self.beyond].astype(np.float64)
        bound = self.width * self.classes  # as if there were so many
        parts = [(np.arange(self.beyond), bound)]
        while parts[0][1] > self.width:
            after = []
            for at, room in parts:
                y = x[at] - x[at].mean(axis=0) if len(at) else x[at]
                axis = np.linalg.eigh(y.T @ y)[1][:, -1]
                axis = axis * (1 if axis[np.argmax(np.abs(axis))] > 0 else -1)
                order = at[np.argsort(np.round(y @ axis, 6), kind="stable")]
                after += [(order[: min(room // 2, len(at) - len(at) // 2)], room // 2), (order[min(room // 2, len(at) - len(at) // 2) :], room // 2)]
            parts = after
        place = np.zeros(self.beyond, np.int64)
        for k, (at, _) in enumerate(parts):
            group[at], place[at] = k, np.arange(len(at))
        return Vocabulary(self.keys, self.count, group, place)


def cutoff(total: int) -> int:
    return max(2, int(total ** (2 / 3) / KNOWN))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From docs (text), with the words and chunks of all of them; how many are known grows with the corpus as stated at KNOWN."""
    c.prepare(docs.sparkSession)
    counts = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where(F.col("n") >= cutoff(total)).toArrow()  # at most total / cutoff rows
    keys, n = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(keys)
    rest = max(0, total - int(n.sum()))
    count = np.concatenate((n[order].astype(np.float64), np.full(512, 1 + rest / 512)))
    random = np.random.default_rng(3).standard_normal((len(count), 2))
    return Vocabulary(keys[order], count, count, count).classed(random)


def softmax(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, their exp, its sum by row). Values are taken as they are, less their maximum only where that overflows."""
    e = np.exp(y)
    total = e @ np.ones(y.shape[1], np.float32)
    if not (np.isfinite(total) & (total > 1e-30)).all():
        y = y - y.max(axis=1, keepdims=True)
        e = np.exp(y)
        total = e.sum(axis=1)
    return y, e, total


class Network:
    """symbols of a window -> embeddings -> tanh of a sum by place -> classes, and symbols of a class; trained by Adagrad."""

    def __init__(self, held: Vocabulary):
        rng, self.held = np.random.default_rng(5), held
        v, k, m = held.beyond, held.classes, held.width
        self.shapes = [(v + 1, EMBEDDED), (len(WINDOW), EMBEDDED, HIDDEN), (HIDDEN,), (k, HIDDEN + 1), (k, m, HIDDEN + 1)]  # the last hidden value is 1
        self.weights = [(rng.standard_normal(s) * s[-2] ** -0.5 if j < 2 else np.zeros(s)).astype(np.float32) for j, s in enumerate(self.shapes)]
        self.weights[0] *= np.float32((v + 1) ** 0.5 * 0.3)
        share = np.full((k, m), 0.0)
        share[held.group, held.place] = held.count
        self.weights[3][:, HIDDEN] = np.log(np.maximum(share.sum(axis=1), 1e-9) / share.sum())
        self.weights[4][:, :, HIDDEN] = np.where(share > 0, np.log(np.maximum(share, 1e-9) / np.maximum(share.sum(axis=1, keepdims=True), 1e-9)), NONE)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    @classmethod
    def of(cls, held: Vocabulary, flat: np.ndarray) -> Network:
        net, at = cls(held), 0
        for k, s in enumerate(net.shapes):
            net.weights[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
            at += int(np.prod(s))
        return net

    def classed(self) -> Network:
        """With classes by the embeddings, and what predicts them at its start again."""
        net = Network(self.held.classed(self.weights[0]))
        net.weights[:3] = self.weights[:3]
        return net

    def hidden(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings side by side, hidden values) of windows [target, place]; all places are one product."""
        flat = self.weights[1].reshape(-1, HIDDEN)
        x = self.weights[0].take(at, axis=0).reshape(-1, len(flat))
        y = x @ flat
        y += self.weights[2]
        y *= 2
        np.minimum(y, 80, out=y)
        np.exp(y, out=y)
        y += 1
        h = np.ones((len(y), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] -= 2 / y  # tanh
        return x, h

    def runs(self, target: np.ndarray) -> tuple[np.ndarray, list]:
        """(order of targets by class, (class, first, end) of each run)."""
        group = self.held.group[target]
        order = np.argsort(group.astype(np.uint16) if self.held.classes <= 1 << 16 else group, kind="stable")
        group = group[order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
        return order, list(zip(group[edge].tolist(), edge, [*edge[1:], len(group)]))

    def log_probability(self, window: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target in its window [place, target]."""
        out = np.empty(len(target))
        order, runs = self.runs(target)
        target = target[order]
        group, place, at = self.held.group[target], self.held.place[target], window.T[order]
        h, row = np.empty((len(target), HIDDEN + 1), np.float32), np.arange(max(ROWS, len(target)))
        got, total = np.empty(len(target)), np.empty(len(target))
        for a in range(0, len(target), ROWS):
            _, h[a : a + ROWS] = self.hidden(at[a : a + ROWS])
            y, _, total[a : a + ROWS] = softmax(h[a : a + ROWS] @ self.weights[3].T)
            got[a : a + ROWS] = y[row[: len(y)], group[a : a + ROWS]]
        got -= np.log(total)
        for k, a, b in runs:
            y, _, total[a:b] = softmax(h[a:b] @ self.weights[4][k].T)
            got[a:b] += y[row[: b - a], place[a:b]]
        out[order] = got - np.log(total)
        return out

    def train(self, window: np.ndarray, target: np.ndarray, squares: list[np.ndarray]) -> None:
        def step(j, at, grad):
            squares[j][at] += grad * grad
            self.weights[j][at] -= np.float32(RATE) * grad / np.sqrt(squares[j][at])

        order, runs = self.runs(target)
        window, target = window.T[order], target[order]
        n, place = len(target), self.held.place[target]
        x, h = self.hidden(window)
        _, g, total = softmax(h @ self.weights[3].T)
        g *= (1 / total)[:, None]
        g[np.arange(n), self.held.group[target]] -= 1
        back = g @ self.weights[3]
        for k, a, b in runs:
            _, z, total = softmax(h[a:b] @ self.weights[4][k].T)
            z *= (1 / total)[:, None]
            z[np.arange(b - a), place[a:b]] -= 1
            back[a:b] += z @ self.weights[4][k]
            step(4, k, z.T @ h[a:b])
        step(3, ..., g.T @ h)
        back = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
        at = window.ravel()
        used = np.flatnonzero(np.bincount(at, minlength=len(self.weights[0])))
        wide = (back @ self.weights[1].reshape(-1, HIDDEN).T).reshape(-1, EMBEDDED)
        step(1, ..., (x.T @ back).reshape(self.shapes[1]))
        step(2, ..., back.sum(axis=0))
        step(0, used, np.stack([np.bincount(at, wide[:, j], len(self.weights[0]))[used] for j in range(EMBEDDED)], 1).astype(np.float32))


def windows(held: Vocabulary, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of each window [place, symbol], symbol, first symbol of each row and the end)."""
    symbol, first = held.symbols(raw, off)
    pad = max(map(abs, WINDOW))
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    at = np.arange(len(symbol)) + pad * (row + 1)
    line = np.full(len(symbol) + pad * len(off), held.beyond)
    line[at] = symbol
    return np.stack([line[at + p] for p in WINDOW]), symbol, first


def trained(shared, steps: int):
    """The weights after a shard's texts, whose order is by their hashes, in BLOCKS parts."""

    def run(table: pa.Table) -> pa.Table:
        held, flat = shared.value
        net = Network.of(held, flat)
        squares = [np.full(w.shape, 0.1, np.float32) for w in net.weights]
        table = table.sort_by([("hash", "ascending"), ("text", "ascending")])
        parts = []
        for _, _, raw, off in c.slices(*c.texts_of(table.column("text"))):
            window, symbol, first = windows(held, raw, off)
            place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
            chosen = np.flatnonzero((place + np.repeat(np.arange(len(off) - 1), np.diff(first))) % MASKED == 0)
            parts.append((window[:, chosen].astype(np.int32), symbol[chosen].astype(np.int32)))
        window, symbol = np.concatenate([w for w, _ in parts], axis=1), np.concatenate([s for _, s in parts])
        n, rng, done = len(symbol), np.random.default_rng(11), 0
        batch = min(BATCH, max(128, n // 16))
        while n and done < steps:
            order = rng.permutation(n)
            for a in range(0, n, batch):
                at = order[a : a + batch]
                net.train(window[:, at], symbol[at], squares)
                done += 1
        blocks = np.array_split(net.flat(), BLOCKS)
        shard = table.column("shard")[0].as_py()
        return pa.table({"block": pa.array(range(BLOCKS), pa.int32()), "shard": pa.array([shard] * BLOCKS, pa.int32()), "fan": pa.array([shard % FAN] * BLOCKS, pa.int32()), "weights": pa.array(blocks, pa.list_(pa.float32())), "n": [float(n)] * BLOCKS})

    return run


def averaged(group: pa.Table) -> pa.Table:
    group = group.sort_by([("fan", "ascending"), ("shard", "ascending")])
    n = group.column("n").to_numpy()
    w = np.zeros(len(group.column("weights")[0]))
    for part, k in zip(group.column("weights"), n):
        w += part.values.to_numpy() * (k / max(1.0, n.sum()))
    return pa.table({**{x: group.column(x)[:1] for x in ("block", "shard", "fan")}, "weights": pa.array([w.astype(np.float32)], pa.list_(pa.float32())), "n": [n.sum()]})


def train(docs: DataFrame, held: Vocabulary, shard_bytes: int = SHARD_BYTES, steps: int = STEPS) -> Network:
    """A network from docs (doc_id, text), each of which is in one of the rounds: two, and one more for each doubling of the
    text over four shards. After the first round, classes are cut out of the embeddings.

    Weights are averaged in two steps, of a shard's number modulo FAN and of these; the driver gets one copy, whose size
    depends on the vocabulary alone. Without any text, the network gives the shares of symbols.
    """
    spark, net, schema = docs.sparkSession, Network(held), "block int, shard int, fan int, weights array<float>, n double"
    rows = docs.where("text is not null").select("text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("hash"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bytes = max(shard_bytes, PER_WEIGHT * net.flat().nbytes)
    rounds = 2 + int(np.log2(1 + total / (4 * shard_bytes)))
    shards = 1 + total // (rounds * shard_bytes)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net.held, net.flat()))
        part = rows.where(F.pmod("hash", F.lit(rounds)) == r).withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int"))
        got = part.groupBy("shard").applyInArrow(trained(shared, steps), schema)
        for keys in (["block", "fan"], ["block"]):
            got = got.groupBy(*keys).applyInArrow(lambda t: averaged(t), schema)
        got = got.toArrow().sort_by("block")
        if got.num_rows and got.column("n")[0].as_py():
            net = Network.of(net.held, np.concatenate([x.values.to_numpy() for x in got.column("weights")]))
        if r == 0:
            net = net.classed()
        shared.unpersist()
    return net


def scored(shared):
    def run(batches):
        net = Network.of(*shared.value)
        for batch in batches:
            for lo, hi, raw, off in c.slices(*c.texts_of(batch.column(1))):
                window, symbol, first = windows(net.held, raw, off)
                got = np.zeros(len(symbol))
                for a in range(0, len(symbol), SCORED):
                    got[a : a + SCORED] = net.log_probability(window[:, a : a + SCORED], symbol[a : a + SCORED])
                total = np.concatenate(([0], np.cumsum(got)))
                total, n = total[first[1:]] - total[first[:-1]], np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(total), pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0))], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for each row of docs (doc_id, text), a token being a symbol.

    Null and empty texts have no tokens and zeros. Words that the corpus does not have are scored by their chunks and bytes.
    Ids may be null or repeat. Other columns are not read.
    """
    c.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net.held, net.flat()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored(shared), "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, vocabulary(docs)))
