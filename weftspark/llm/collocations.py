"""Phrase collocations by Apriori passes.

Level k counts the phrases of k words of which both overlapping phrases of k - 1 words are frequent; these are broadcast as sorted
hashes while their number has the bound MOST, and beyond it phrases are counted first and cut by frequency afterwards, which
gives the same tables. All scores then come from joins of the level tables, in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common as c

LEAST, LONGEST, TOP = 10, 3, 2000
#: A candidate goes if a longer one that holds it has at least this share of its occurrences, in percent.
SHARE = 50
#: Frequent phrases of a level that are broadcast, 8 bytes each.
MOST = 1 << 21
#: Distinct phrases that a task holds before it sends its counts on.
HELD = 1 << 17
BREAK, GAP = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP[[0x20, 0x09]] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, first byte, byte after the last, row, piece) of each word; a piece is never in two rows."""
    low = c.LOWER[raw]
    start, end, first = c.spans(~(GAP[low] | BREAK[low]), off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return low, start, end, row, (np.cumsum(BREAK[low]) if len(low) else np.zeros(0, np.int64))[start] + row


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct row of keys stands first, the sum of its n)."""
    if not len(n):
        return np.zeros(0, np.int64), n
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(n), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return np.minimum.reduceat(order, first), np.add.reduceat(n[order], first)


def together(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return c.mix(one * np.uint64(c.BASE) + other)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def language_code(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode())


def salted(word: np.ndarray, seed: int) -> np.ndarray:
    return c.mix(word + np.uint64(seed))


def counted(k: int, seed: int, known: Callable[[], np.ndarray | None]):
    """Counts of a task's phrases of k words: (lang, w1 .. wk, n), and the word itself if k is 1. Hashes of words are mixed with a seed;
    known() gives the sorted codes of frequent phrases of k - 1 words, or None to count all."""

    def run(batches):
        frequent, names, held, size = known(), {}, [], 0

        def merged() -> list[np.ndarray]:
            cols = [np.concatenate(x) for x in zip(*held)]
            index, n = summed(cols[: k + 1], cols[-1])
            return [*(x[index] for x in cols[:-1]), n]

        def sent(cols: list[np.ndarray]):
            name = np.array(list(names), object)
            for a in range(0, len(cols[0]), 1 << 16):
                part = [x[a : a + (1 << 16)] for x in cols]
                texts = [c.strings(part[k + 1].tolist())] if k == 1 else []
                yield pa.RecordBatch.from_arrays([c.strings(name[part[0]].tolist()), *(pa.array(x.view(np.int64)) for x in part[1 : k + 1]), *texts, pa.array(part[-1])], names=["lang", *(f"w{i + 1}" for i in range(k)), *["word"] * (k == 1), "n"])

        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            code = np.array([language_code(x) for x in names], np.uint64)
            for lo, hi, raw, off in c.slices(*c.texts_of(batch.column(1))):
                low, start, end, row, piece = words(raw, off)
                word = salted(c.span_hash(c.prefix_sums(low), start, end), seed)
                own = lang[lo:hi][row]
                grams, at = [code[own] + word] if len(word) else [word], np.arange(max(0, len(word) - k + 1))
                for _ in range(k - 2):  # codes of phrases of k - 1 words
                    grams.append(together(grams[-1][:-1], grams[0][len(grams) :]))
                at = at[piece[at] == piece[at + k - 1]] if len(at) else at
                if frequent is not None and k > 1:
                    there = among(grams[-1], frequent)
                    at = at[there[at] & there[at + 1]]
                cols = [own[at], *(word[at + i] for i in range(k))]
                index, n = summed(cols, np.ones(len(at), np.int64))
                cols = [x[index] for x in cols]
                if k == 1:
                    data, i = low.tobytes(), at[index]
                    texts = np.empty(len(i), object)
                    texts[:] = [data[a:b].decode() for a, b in zip(start[i].tolist(), end[i].tolist())]
                    cols.append(texts)
                held.append([*cols, n])
                size += len(n)
                if size > 2 * HELD:
                    held = [merged()]
                    size = len(held[0][-1])
                    if size > HELD:
                        yield from sent(held[0])
                        held, size = [], 0
        if held:
            yield from sent(merged())

    return run


def level(rows: DataFrame, k: int, seed: int, known: np.ndarray | None) -> DataFrame:
    """(lang, w1 .. wk, n) of rows (lang, text); for k = 1 also the word."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    cols = [f"w{i + 1}" for i in range(k)]
    found = rows.mapInArrow(counted(k, seed, lambda: shared.value), "lang string, " + ", ".join(f"{x} long" for x in cols) + ", word string" * (k == 1) + ", n long")
    return found.groupBy("lang", *cols, *["word"] * (k == 1)).agg(F.sum("n").alias("n"))


def coded(k: int):
    """The codes of phrases (lang, w1 .. wk), as counted() makes them."""

    def run(batches):
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code = np.array([language_code(x) for x in lang.dictionary.to_pylist()], np.uint64)[np.asarray(lang.indices)]
            out = reduce(together, [code + np.asarray(x).view(np.uint64) for x in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["code"])

    return run


def codes_of(table: DataFrame, k: int, most: int) -> np.ndarray | None:
    """Sorted codes of a level's phrases; None if they are over the bound."""
    if table.count() > most:
        return None
    codes = table.select("lang", *(f"w{i + 1}" for i in range(k))).mapInArrow(coded(k), "code long").toArrow()  # at most `most` numbers
    return np.sort(codes.column("code").to_numpy().view(np.uint64))


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """(tables of frequent phrases of 1 to `longest` words, (lang, n) with the number of all word occurrences).

    Two words with one hash are seen when words are counted, which is then done again with another seed.
    """
    c.prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for seed in range(1, 9):
        every = level(rows, 1, seed, None).select("lang", "w1", "n", F.when(F.col("n") >= least, F.col("word")).alias("word")).checkpoint()
        if every.groupBy("lang", "w1").count().where("count > 1").isEmpty():
            break
    out = [every.where(F.col("n") >= least).select("lang", "w1", "n", "word")]
    for k in range(2, longest + 1):
        out.append(level(rows, k, seed, codes_of(out[-1], k - 1, most)).where(F.col("n") >= least).checkpoint())
    return out, every.groupBy("lang").agg(F.sum("n").alias("n"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts of up to 15 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", (a * a) * F.lit(1000000).cast("decimal(7,0)"), left * right)


def looked_up(rows: DataFrame, table: DataFrame, words: list[int], name: str, value: str = "n") -> DataFrame:
    """rows with a value of the phrase that these of its words form."""
    keys = [F.col(f"w{i + 1}").alias(f"w{j}") for i, j in enumerate(words)]
    return rows.join(table.select("lang", *keys, F.col(value).alias(name)), ["lang", *(f"w{j}" for j in words)])


def candidates(tables: list[DataFrame], share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the frequent phrases of two words or more that no longer one takes in."""
    out = None
    for k in range(2, len(tables) + 1):
        rows = tables[k - 1].withColumnRenamed("n", "a")
        for cut in range(1, k):
            rows = looked_up(looked_up(rows, tables[cut - 1], [*range(1, cut + 1)], f"l{cut}"), tables[k - cut - 1], [*range(cut + 1, k + 1)], f"r{cut}")
        every = F.array(*(F.struct(score(F.col("a"), F.col(f"l{cut}"), F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")) for cut in range(1, k)))
        rows = rows.withColumn("best", F.array_min(every))  # the least score, then the first cut
        own = ["lang", *(f"w{i + 1}" for i in range(k))]
        longer = [tables[m - 1].select("lang", *(F.col(f"w{at + i + 1}").alias(f"w{i + 1}") for i in range(k)), F.col("n").alias("longer")) for m in range(k + 1, len(tables) + 1) for at in range(m - k + 1)]
        if longer:
            rows = rows.join(reduce(DataFrame.union, longer).groupBy(*own).agg(F.max("longer").alias("longer")), own, "left").where(f"longer is null or 100 * cast(longer as decimal(15,0)) < {share} * cast(a as decimal(15,0))")
        for i in range(1, k + 1):
            rows = looked_up(rows, tables[0], [i], f"text{i}", "word")
        rows = rows.select("lang", F.concat_ws(" ", *(f"text{i + 1}" for i in range(k))).alias("phrase"), "a", "best.l", "best.r", "best.score")
        out = rows if out is None else out.union(rows)
    return out


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """found with rank, from 1, for the first `top` of each language. Languages are dealt in parts first, so the last task of one gets 8 times `top` rows at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in (int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8, 1):
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, a, and phrase in byte order.

    Texts in small ASCII letters are cut into pieces at marks and line breaks, and pieces into words at spaces and tabs. A null lang is
    "und", a null or empty text has no words, equal rows count as often as they stand there, and other columns are not read.
    """
    tables, totals = levels(docs, least, longest, most)
    best = ranked(candidates(tables, share), top)  # languages meet their totals only now, `top` rows each
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(c.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (SELECT unnest(range(1, {LONGEST} + 1)) AS k)) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
q AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
y AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lg, array_to_string(w[cut + 1:], ' ') AS rg FROM q, (SELECT unnest(range(1, {LONGEST})) AS cut) WHERE cut < k),
x AS (SELECT y.lang, y.k, phrase, a, cut, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM y JOIN f AS l ON l.lang = y.lang AND l.k = cut AND l.g = lg JOIN f AS r ON r.lang = y.lang AND r.k = y.k - cut AND r.g = rg),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM q, (SELECT unnest(range(2, {LONGEST})) AS m), (SELECT unnest(range(1, {LONGEST})) AS s) WHERE m < k AND s + m - 1 <= k GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a)
WHERE rank <= {TOP}
"""
