"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that agree on the bits of a table's key are compared in blocks of 64: the blocks' bit planes lie upright,
carry-save counters add up 64 distances at a time, and a query leaves a block once all its distances pass the radius.
A task returns a spanning forest of the links it finds, never all pairs; star contraction joins the forests.

Near-duplicates by Jaccard similarity take these groups, at a wider radius, as proposals only: the sets of shingles of each
group's texts meet in a task, which joins those that are similar indeed. A large group is dealt in parts, each with the group's
first text; only texts that this one does not reach within their part are then compared with the other parts.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SEED = 42
#: Rows of one key that are compared in one task; more are dealt out as pairs of parts.
MAX_KEY = 1 << 16
#: Rows that a task holds, besides those of one key.
HELD = 1 << 16
#: Texts of one proposed group whose shingles are compared in one task; a larger group is dealt out in parts.
MAX_PART = 512
#: Sets of so few shingles are also proposed by their rarest shingles, as fingerprints say little about them.
FEW = 64
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each shingle, first shingle of each text and the end)."""
    out, count, digest = [], [0], xxhash.xxh64_digest
    for text in texts:
        words = text.lower().split()  # bytes: A-Z only, and ASCII blanks
        if len(words) <= size:
            out += [digest(b" ".join(words), SEED)] if words else []
            count.append(bool(words))
            continue
        joined = b" ".join(words)
        gap = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        start, end = [0, *(gap[: len(words) - size] + 1).tolist()], [*gap[size - 1 :].tolist(), len(joined)]
        out += [digest(joined[a:b], SEED) for a, b in zip(start, end)]
        count.append(len(start))
    return np.frombuffer(b"".join(out), ">u8").astype(np.uint64), np.cumsum(count)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row hashes[first[i]:first[i+1]], the bits that are set in over half of them; 0 without any."""
    size = np.diff(first)
    parts = -(-size // 255)
    row = np.repeat(np.arange(len(size)), parts)
    begin = first[:-1][row] + 255 * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(parts)
    if not len(full):
        return out
    edge = (np.cumsum(parts) - parts)[full]
    for j in range(8):  # bit j of each byte, as eight counters in a word
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & LANES, begin)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), edge, axis=0)
        for byte in range(8):
            out[full] |= (2 * count[:, byte] > size[full]).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprinted(shingle: int, words: int):
    def run(batches):
        for batch in batches:
            raw, off = c.texts_of(batch.column(1))
            for lo, hi, data, at in c.slices(raw, off):
                plain, at = data.tobytes(), at.tolist()
                hashes, first = shingle_hashes([plain[a:b] for a, b in zip(at, at[1:])], shingle)
                cols = [majority(c.mix(hashes + np.uint64(j)) if j else hashes, first).view(np.int64) for j in range(words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, cols)], names=["doc_id", *(f"f{j}" for j in range(words))])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0 .. f{words-1}: long) for each row: SimHash of 64 bits a word, over word shingles, repeats included.

    The first word is by XXH64 alone. Texts of fewer words are one shingle; null and empty texts have zeros.
    """
    c.prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fingerprinted(shingle, words), "doc_id long, " + ", ".join(f"f{j} long" for j in range(words)))


def pigeonhole(radius: int = 3) -> list[list[int]]:
    """Tables for 64 bits that miss no pair: of radius + 1 parts one is equal, and so of radius + 1 parts of the rest."""
    out, n = [], radius + 1
    for part in np.array_split(np.arange(64), n):
        rest = np.setdiff1d(np.arange(64), part)
        out += [[*part.tolist(), *sub.tolist()] for sub in np.array_split(rest, n)]
    return out


def sampled(bits: int, key_bits: int, tables: int) -> list[list[int]]:
    """Tables of key_bits bits each, drawn by a fixed seed."""
    rng = np.random.default_rng(7)
    return [rng.choice(bits, key_bits, replace=False).tolist() for _ in range(tables)]


def keyed(tables: list[list[int]], words: int):
    def run(batches):
        for batch in batches:
            f = [np.asarray(batch.column(f"f{j}")).view(np.uint64) for j in range(words)]
            for t, bits in enumerate(tables):
                key = np.zeros(len(f[0]), np.uint64)
                for p in bits:
                    key = (key << np.uint64(1)) | ((f[p // 64] >> np.uint64(p % 64)) & np.uint64(1))
                key = c.mix(key * np.uint64(2 * len(tables)) + np.uint64(t))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", *batch.schema.names])

    return run


def planes_of(f: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 words: [block, bit], lane i from word i."""
    n = -(-len(f) // 64)
    whole = np.zeros(64 * n, np.uint64)
    whole[: len(f)] = f
    bits = np.unpackbits(whole.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(n, 64)


def near(f: list[np.ndarray], planes: list[np.ndarray], query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int):
    """(query, row) of the lanes of each query's block within the radius."""
    depth = max(1, radius.bit_length())
    counters = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    for p in range(64 * len(f)):
        word, bit = divmod(p, 64)
        carry = planes[word][block, bit] ^ (np.uint64(0) - ((f[word][query] >> np.uint64(bit)) & np.uint64(1)))
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        lanes = lanes & ~carry  # over 2**depth - 1
        if p % 8 == 7:
            left = lanes != 0
            if not left.all():
                query, block, lanes, counters = query[left], block[left], lanes[left], [x[left] for x in counters]
            if not len(query):
                break
    more, equal = np.zeros(len(query), np.uint64), ~np.zeros(len(query), np.uint64)
    for k in reversed(range(depth)):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more, equal = more | (equal & counters[k]), equal & ~counters[k]
    lanes = lanes & ~more
    at, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[at], 64 * block[at] + lane


def forest(key: np.ndarray, f: list[np.ndarray], radius: int, step: int = 1 << 14) -> np.ndarray:
    """For rows sorted by key, the first row that each reaches by links within its key."""
    n, label = len(key), np.arange(len(key))
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    end = np.repeat(edge[1:], np.diff(edge))
    planes = [planes_of(x) for x in f]
    query = np.flatnonzero(end - np.arange(n) > 1)
    shift = 0
    while len(query):
        for at in range(0, len(query), step):
            i = query[at : at + step]
            block = i // 64 + shift
            lo = np.maximum(i + 1 - 64 * block, 0).astype(np.uint64)
            hi = np.minimum(end[i] - 64 * block, 64).astype(np.int64)
            some = hi > lo.astype(np.int64)
            i, block, lo, hi = i[some], block[some], lo[some], hi[some]
            lanes = (~np.uint64(0) >> (np.uint64(64) - (hi.astype(np.uint64) - lo))) << lo
            if len(i):
                c.merge_labels(label, *near(f, planes, i, block, lanes, radius))
        shift += 1
        query = query[64 * (query // 64 + shift) < end[query]]
    return label


def linked(radius: int, words: int):
    """Forests of rows that come sorted by key; a task holds whole keys of about HELD rows at a time."""

    def links_of(got: list) -> pa.RecordBatch:
        key, node, *f = map(np.concatenate, zip(*got))
        label = forest(key, f, radius)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], names=["a", "b"])

    def run(batches):
        got, rows = [], 0
        for b in batches:
            part = (np.asarray(b.column("key")), np.asarray(b.column("node")), *(np.asarray(b.column(f"f{j}")).view(np.uint64) for j in range(words)))
            if rows + b.num_rows > HELD and b.num_rows:
                last = int(np.searchsorted(part[0], part[0][-1]))  # the batch's last key may go on
                if last or (got and got[-1][0][-1] != part[0][0]):
                    yield links_of([*got, tuple(x[:last] for x in part)])
                    got, rows, part = [], 0, tuple(x[last:] for x in part)
            got.append(part)
            rows += len(part[0])
        if rows:
            yield links_of(got)

    return run


def links(nodes: DataFrame, cols: list[str], radius: int, tables: list[list[int]], max_key: int = MAX_KEY) -> DataFrame:
    """(a, b): a spanning forest a task of the nodes (node, fingerprint in cols) within the radius."""
    schema = "key long, node long, " + ", ".join(f"{x} long" for x in cols)
    rows = nodes.select("node", *cols).mapInArrow(keyed(tables, len(cols)), schema)
    hot = rows.groupBy("key").count().where(F.col("count") > max_key).checkpoint()
    if not hot.isEmpty():
        rows = rows.join(hot.select("key", F.ceil(F.col("count") / max_key).cast("int").alias("parts")), "key", "left")
        part, other = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))), F.col("other")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        rows = rows.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(part, other), F.greatest(part, other))).alias("key"), "node", *cols)
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(linked(radius, len(cols)), "a long, b long")


def groups(prints: DataFrame, radius: int = 3, tables: list[list[int]] | None = None, max_key: int = MAX_KEY) -> DataFrame:
    """(doc_id, f0 .., component_id): the smallest doc_id that each row reaches by fingerprints within the radius.

    With pigeonhole tables (the default, for one word) no link is missed. Rows with equal fingerprints are one node, so that
    copies meet in an aggregate, and are told their component in parts. A key of over max_key rows is dealt out as pairs of parts. Null ids are kept; they are
    the component's id only where it has no other. Repeated ids are kept as rows.
    """
    c.prepare(prints.sparkSession)
    cols = [x for x in prints.columns if x != "doc_id"]
    tables = tables or pigeonhole(radius)
    node = F.col("f0") if len(cols) == 1 else F.xxhash64(*cols)
    prints = prints.withColumn("node", node).checkpoint()
    nodes = prints.groupBy("node", *cols).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    found = c.components(links(nodes, cols, radius, tables, max_key))
    total = prints.count()
    merged = nodes.select("node", "least").join(found, "node")
    least = merged.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = c.spread_join(merged, least, "component", total, by="node").select("node", "component_id")
    alone = nodes.select("node", "least", "n").join(named, "node", "left").select("node", "n", F.coalesce("component_id", "least").alias("component_id"))
    return c.spread_join(prints, alone, "node", total).select("doc_id", *cols, "component_id")


def plan_for(similarity: float, words: int, rows: int, miss: float = 0.001, slack: float = 4) -> tuple[int, list[list[int]]]:
    """(radius, tables) for shingle sets of at least this Jaccard similarity, by fingerprints of 64 * words bits.

    Two sets' bits differ with probability acos(2 s / (1 + s)) / pi; the radius lies `slack` standard deviations over the
    expected distance. Keys have so many bits that about 64 unlike rows share one, and so many tables are drawn that a pair
    at the threshold misses all of them with probability `miss`.
    """
    p, bits = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 64 * words
    key_bits = max(12, int(np.ceil(np.log2(max(2, rows)))) - 6)
    tables = int(np.ceil(np.log(miss) / np.log1p(-((1 - p) ** key_bits))))
    return int(bits * p + slack * np.sqrt(bits * p * (1 - p))), sampled(bits, key_bits, tables)


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in order, and the first of each row and the end."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1)))).astype(np.int64)


def sets_of(column: pa.Array, shingle: int):
    """(first row, last row + 1, distinct shingle hashes, first of each text and the end) of slices of a column of texts."""
    for lo, hi, data, at in c.slices(*c.texts_of(column)):
        plain, at = data.tobytes(), at.tolist()
        yield lo, hi, *distinct(*shingle_hashes([plain[a:b] for a, b in zip(at, at[1:])], shingle))


def sketched(shingle: int, words: int):
    def run(batches):
        for batch in batches:
            for lo, hi, hashes, first in sets_of(batch.column(2), shingle):
                size = np.diff(first)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(hashes), dtype=np.uint64)))
                node = c.mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))
                own = np.where(size <= FEW, size, 0)
                edge = np.concatenate(([0], np.cumsum(own)))
                few = hashes[np.repeat(first[:-1] - edge[:-1], own) + np.arange(edge[-1])]
                cols = [majority(c.mix(hashes + np.uint64(j)) if j else hashes, first).view(np.int64) for j in range(words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(node.view(np.int64)), *map(pa.array, cols), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(few.view(np.int64)))],
                    names=["key", "doc_id", "node", *(f"f{j}" for j in range(words)), "few"],
                )

    return run


def shingled(shingle: int):
    def run(batches):
        for batch in batches:
            for lo, hi, hashes, first in sets_of(batch.column(0), shingle):
                rest = [x.slice(lo, hi - lo) for x in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))], names=[*batch.schema.names[1:], "hashes"])

    return run


def alike(hashes: np.ndarray, first: np.ndarray, similarity: float, rows_asked: np.ndarray | None = None) -> np.ndarray:
    """For rows of distinct hashes, the first row that each reaches by links of at least this Jaccard similarity. With rows_asked,
    only their links count."""
    n, size = len(first) - 1, np.diff(first)
    label, asked = np.arange(n), np.zeros(n, bool)
    _, ids = np.unique(hashes, return_inverse=True)
    edge = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    rows = np.repeat(np.arange(n), size)[np.argsort(ids, kind="stable")]

    def ask(i: int) -> None:
        asked[i] = True
        own = ids[first[i] : first[i + 1]]
        many = edge[own + 1] - edge[own]
        common = np.bincount(rows[np.repeat(edge[own] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)
        near = np.flatnonzero(common >= similarity * (size[i] + size - common) - 1e-9)
        c.merge_labels(label, np.full(len(near), i), near)

    if rows_asked is not None:
        for i in rows_asked.tolist():
            ask(i)
        return label
    for i in range(n):
        if label[i] == i:
            ask(i)
    one = int(np.argmax(np.bincount(label)[label]))  # of the largest group; a link between two groups has a row outside of it
    for i in range(n):
        if label[i] != label[one] and not asked[i]:
            ask(i)
    return label


def distinct_sets(table: pa.Table, *flags: str) -> tuple:
    """(nodes in order, hashes, first of each and the end, each flag's any) of the rows of one group, a node once."""
    every = np.asarray(table.column("node"))
    node, at, inverse = np.unique(every, return_index=True, return_inverse=True)
    lists = table.column("hashes").combine_chunks().take(pa.array(at))
    marks = [np.bincount(inverse, np.asarray(table.column(x)), len(node)) > 0 for x in flags]
    return node, np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64), *marks


def forest_of(node: np.ndarray, label: np.ndarray) -> pa.Table:
    child = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": node[child], "b": node[label[child]]})


def confirmed(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        node, hashes, first = distinct_sets(table)
        return forest_of(node, alike(hashes, first, similarity))

    return run


def confirmed_by_part(similarity: float):
    """(node, root, left) of one part of a large group, which has the group's first text as well: root is the first that a node
    reaches in its part, left those that don't reach the first text."""

    def run(table: pa.Table) -> pa.Table:
        node, hashes, first = distinct_sets(table)
        label = alike(hashes, first, similarity)
        lead = int(np.searchsorted(node, table.column("block")[0].as_py()))
        rest = np.flatnonzero(np.arange(len(node)) != lead)
        return pa.table({"block": pa.repeat(table.column("block")[0], len(rest)), "node": node[rest], "root": node[label[rest]], "left": label[rest] != label[lead]})

    return run


def confirmed_across(similarity: float):
    """The links between a part of a large group and some of the texts left."""

    def run(table: pa.Table) -> pa.Table:
        node, hashes, first, asks = distinct_sets(table, "asks")
        return forest_of(node, alike(hashes, first, similarity, np.flatnonzero(asks)))

    return run


def across_parts(sets: DataFrame, similarity: float, max_part: int) -> DataFrame:
    """(a, b): links that join what is alike in groups over max_part, for sets (node, block, parts, hashes), block being the group's
    least node. A group of copies of one text costs its own size; only texts that don't reach the first one are sent to all parts."""
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    lead = sets.where("node = block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = sets.where("node <> block").withColumn("part", part).unionByName(lead)
    local = rows.groupBy("block", "part").applyInArrow(confirmed_by_part(similarity), "block long, node long, root long, left boolean").checkpoint()
    left = local.where("left").select("node", "block")
    asking = left.groupBy("block").agg(F.ceil(F.count("*") / max_part).cast("int").alias("turns"))
    every = sets.join(asking, "block").withColumn("part", part)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = every.withColumn("turn", upto("turns")).withColumn("asks", F.lit(0)).select("block", "part", "turn", "node", "hashes", "asks")
    asks = every.join(left.select("node"), "node", "left_semi").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")).withColumn("part", upto("parts"))
    cells = asked.unionByName(asks.withColumn("asks", F.lit(1)).select(asked.columns))
    cross = cells.groupBy("block", "part", "turn").applyInArrow(confirmed_across(similarity), "a long, b long")
    return local.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(cross)


def rarest(prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b): proposals for sets of few shingles (node, few: array of hashes). Two sets of the similarity share one of the first
    size - ceil(similarity * size) + 1 shingles of each, in any order that is common to all; in that of their numbers, rarest first,
    a passage that many texts have proposes only texts that are little else. Each is linked to the least node of a shingle."""
    sets = prints.where(F.size("few") > 0).select("node", "few").dropDuplicates(["node"]).checkpoint()
    total = sets.agg(F.sum(F.size("few"))).first()[0] or 0
    each = sets.select("node", F.size("few").alias("size"), F.explode("few").alias("hash"))
    number = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").withColumn("on", F.col("n"))
    shared = c.spread_join(each, number, "hash", total, by="node").where("on is not null")
    shared = shared.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("on", "hash"))).alias("s"))  # FEW at most
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("s"))  # those of one text come first
    keys = shared.select("node", F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("node", "x.hash")
    lead = keys.groupBy("hash").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    return c.spread_join(keys, lead, "hash", total, by="node").where("node <> b").select(F.col("node").alias("a"), "b")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row of documents by its id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 8, max_part: int = MAX_PART) -> DataFrame:
    """(key, doc_id, component_id, component) for docs (doc_id, text), key as of row_key(): groups of texts that links join, each
    with its smallest doc_id and a number of its own (ids may repeat, so two groups can have one smallest id). A link is a
    Jaccard similarity of at least `similarity` of two texts' sets of word shingles.

    Fingerprints of the distinct shingles propose groups, and for sets of few shingles also a common one of their rarest; each
    group's sets are then compared (by 64-bit hashes of shingles), so no group has a text without such a link. A link at the
    threshold is missed with probability 0.001, one over it still less, one of few shingles never. Equal sets always meet.
    Null and empty texts are one group. Null ids are a component's id only where it has no other.
    """
    c.prepare(docs.sparkSession)
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cols = [f"f{j}" for j in range(words)]
    prints = docs.mapInArrow(sketched(shingle, words), "key long, doc_id long, node long, " + "".join(f"{x} long, " for x in cols) + "few array<long>").checkpoint()
    nodes = prints.groupBy("node", *cols).agg(F.min("key").alias("key"))
    total = prints.count()
    radius, tables = plan_for(similarity, words, total)
    proposed = c.components(links(nodes, cols, radius, tables).union(rarest(prints, similarity)))
    proposed = proposed.select("node", F.col("component").alias("block")).checkpoint()
    parts = proposed.groupBy("block").agg(F.ceil(F.count("*") / max_part).cast("int").alias("parts"), F.count("*").alias("n"))
    rows = c.spread_join(proposed, parts, "block", total, by="node")
    rows = docs.select("key", "text").join(nodes.select("node", "key").join(rows, "node"), "key").select("text", "node", "block", "parts")
    sets = rows.mapInArrow(shingled(shingle), "node long, block long, parts int, hashes array<long>")
    if not parts.where("parts > 1").isEmpty():
        sets = sets.checkpoint()
        found = sets.where("parts = 1").groupBy("block").applyInArrow(confirmed(similarity), "a long, b long").union(across_parts(sets.where("parts > 1"), similarity, max_part))
    else:
        found = sets.groupBy("block").applyInArrow(confirmed(similarity), "a long, b long")
    found = c.components(found)
    copies = prints.groupBy("node").agg(F.count("*").alias("n")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = c.spread_join(prints.select("key", "doc_id", "node"), copies, "node", total).select("key", "doc_id", "component").checkpoint()
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    return c.spread_join(named, least, "component", total).select("key", "doc_id", "component_id", "component")


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays, of rows with that id one, and of
    equal rows one. A null id comes after all others. Rows of one id with unlike texts are in several groups, so each stays."""
    found = near_duplicates(docs, similarity)
    keep = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("__row_key")).select("__row_key")
    rows = docs.withColumn("__row_key", row_key())
    return rows.join(keep, "__row_key", "left_semi").dropDuplicates(["__row_key"]).select(docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(fingerprints(c.table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
