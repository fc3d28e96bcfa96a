"""Token counts, phrases and hard negatives against brute force, the libraries and SQL, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftspark.llm import collocations, fingerprint, negatives, tokens

DOCS = "doc_id long, text string, lang string, hash string, n_bytes string, no string, deal string, n_tokens string, row string, rows string, n string, w1 string, word string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, *"abcdefghij") for d, t, lang in rows], DOCS)


def odd():
    texts = [None, "", "   \n ", "Ab cde. " * 40000, "a", "<s> x</s>", "é漢 \U0001F600\x00!", "x" * 3000, "the same text", "the same text"]
    rows = [(i, t, ["en", None, "fr"][i % 3]) for i, t in enumerate(texts)]
    return [*rows, (None, "no id at all", None), (None, None, None), (4, "a", "en"), (3, texts[3], "en"), (3, texts[3], "en")]


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def library():
    sentencepiece, models = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    return sentencepiece.SentencePieceProcessor(model_file=models.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\t▁▁aetn<s>/é漢　"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_lengths_of_any_text(library, texts):
    raw, off = fingerprint.joined(texts)
    assert tokens.tokenizer(tokens.default_model()).lengths(raw, off).tolist() == [len(library.encode(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("  \n▁aetnés"), max_size=300), st.integers(1, 40))
def test_parts_of_a_text_add_up(library, text, piece):
    parts = tokens.tokenizer(tokens.default_model()).parts(text.encode(), piece)
    assert " ".join(p.decode() for p in parts) == text and sum(len(library.encode(p.decode())) for p in parts) == len(library.encode(text))


@pytest.mark.parametrize("long, piece", [(tokens.LONG, tokens.PIECE), (5, 7), (1000, 500)])
def test_token_counts(spark, library, long, piece):
    rng = random.Random(4)
    rows = odd() + [(100 + i, "".join(rng.choices(["the ", " ", "cat", "é", "\n", "▁", "sat. "], k=rng.randint(0, 400))), "en") for i in range(40)]
    got = Counter(map(tuple, tokens.count(documents(spark, rows), limit=50, long=long, piece=piece).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    size = {t: len(library.encode(t or "")) for _, t, _ in rows}
    assert got == Counter((d, len((t or "").encode()), size[t], size[t] > 50) for d, t, _ in rows)


def test_token_counts_of_a_json_model(spark):
    library, models = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = models.path("byte_bpe_50k.json")
    model = library.Tokenizer.from_file(path)
    got = Counter(map(tuple, tokens.count(documents(spark, odd()), path, long=100).select("doc_id", "n_tokens").collect()))
    assert got == Counter((d, len(model.encode(t or "", add_special_tokens=False))) for d, t, _ in odd())


def test_no_token_counts_of_an_empty_table(spark):
    assert tokens.count(documents(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- phrases


def phrases(rows, least, longest, share, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n, out = Counter(), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    inside = defaultdict(int)
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, *w[i : i + k]] = max(inside[lang, *w[i : i + k]], a)
    by = defaultdict(list)
    for (lang, *w), a in found.items():
        if 100 * inside[lang, *w] >= share * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        by[lang].append((-s, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    for lang, got in by.items():
        for rank, (s, a, phrase, left, right) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return Counter(out)


def spoken(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "the", "of", "New", "York", "é", "漢", "İ", "cat", "\x0b", "q.", "x,", "a!b", " "])
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randint(0, len(text)), rng.choice(["New York City", "in spite of", "hot dog"]))
        rows.append((i, rng.choice([" ", "\t", "  "]).join(text) if i % 17 else None, ["en", "fr", None, "und"][rng.choice([0, 0, 0, 1, 2, 3])]))
    return rows + rows[:20]


@pytest.mark.parametrize("longest, most, top", [(3, 1 << 22, 2000), (3, 0, 2000), (4, 1 << 22, 5), (2, 3, 7)])
def test_phrases(spark, longest, most, top):
    rows = spoken(longest) + odd()
    got = collocations.collocations(documents(spark, rows).repartition(5), 4, longest, 50, top, most)
    assert Counter(map(tuple, got.collect())) == phrases(rows, 4, longest, 50, top)


def test_phrases_when_tasks_send_often(spark, monkeypatch):
    rows = spoken(9)
    monkeypatch.setattr(collocations, "HELD", 5)
    monkeypatch.setattr(collocations.c, "SLICE_BYTES", 64)
    held = list(collocations.counted(1, 3, lambda: None)(documents(spark, rows).select("lang", "text").where("lang is not null and text is not null")._collect_as_arrow()))
    n = Counter()
    for b in held:
        for lang, word, k in zip(*(b.column(x).to_pylist() for x in ("lang", "word", "n"))):
            n[lang, word] += k
    want = Counter()
    for _, text, lang in rows:
        if lang is not None and text is not None:
            low = "".join(x.lower() if x.isascii() else x for x in text)
            want.update((lang, w) for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", low))
    assert n == want and len(held) > 1


def test_scores_beyond_64_bits(spark):
    rows = [(3_000_000_019, 3_000_000_037, 4_000_000_007), (999_999_999_989, 999_999_999_989, 999_999_999_999), (10, 10, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r["s"] for r in df.orderBy(F.desc("a")).collect()] == [1000000 * a * a // (x * y) for a, x, y in sorted(rows, reverse=True)]


def test_no_phrases_of_an_empty_table(spark):
    assert collocations.collocations(documents(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- hard negatives


def by_hand(rows, every=50, positives=5, k=3, noisy=7):
    ready = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready[i, (label + 1) % 10 if i % noisy == 0 else label, tuple(math.floor(256 * float(x)) for x in v)] = 0
    ready, out = list(ready), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in ready:
        if i % every:
            continue
        scored = [(-dot(v, w), j, other) for j, other, w in ready]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:positives]:
            inside = sorted((t, m) for t, m, other in scored if other != label and -50 * s <= -100 * t <= -95 * s)
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(inside[:k], 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, shard string, block string, anchor string, place string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcde") for i, v, label in rows], VECTORS)


def pointed(seed, n=900, dim=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * 4) / 16 + rng.integers(0, 2, (n, 1)) * 0.5  # many ties
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    inf, nan = float("inf"), float("nan")
    return rows + rows[:30] + [(None, [1.0] * dim, 1), (1000, None, 1), (1050, [1.0] * dim, None), (1100, [1.0, None], 1), (1150, [nan] * dim, 1), (1200, [inf] * dim, 2), (1250, [], 3), (1300, [2.0, 1.0], 3), (50, [0.5] * dim, 3)]


@pytest.mark.parametrize("seed, shard_rows, block, leaf", [(1, 100, 4, 8), (2, 5000, 1000, 16), (3, 300, 1, 256)])
def test_negatives(spark, monkeypatch, seed, shard_rows, block, leaf):
    rows = pointed(seed)
    got = negatives.hard_negatives(vectors(spark, rows), shard_rows=shard_rows, block=block)
    assert Counter(map(tuple, got.collect())) == by_hand(rows)


def test_negatives_of_one_vector(spark):
    """All rows but a few are alike, so nothing but ids tells them apart."""
    rows = [(i, [0.5, 0.25], i % 3) for i in range(700)] + [(1000 + i, [0.46, 0.25], i % 3) for i in range(30)]
    assert Counter(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect())) == by_hand(rows)


def test_negatives_of_large_numbers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 3) * 1e5 for _ in range(3)], i % 3) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert Counter(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect())) == by_hand(rows)


def test_no_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(vectors(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, 7, 256])
def test_tree_finds_what_all_rows_give(leaf):
    rng = np.random.default_rng(leaf)
    x = rng.integers(-9, 9, (500, 4)).astype(float)
    ids, labels = rng.permutation(500), rng.integers(0, 3, 500)
    tree = negatives.Tree.of(x, ids, labels, leaf)
    q = rng.integers(-9, 9, (40, 4)).astype(float)
    low, high = np.full(40, 5.0), np.full(40, 60.0)
    score, found, there = tree.nearest(q, 3, lambda i, rows: np.ones((len(i), rows.stop - rows.start), bool) & (tree.labels[rows] == 1), low, high)
    for k in range(40):
        want = sorted((-s, i) for s, i, label in zip((x @ q[k]).tolist(), ids.tolist(), labels.tolist()) if label == 1 and 5 <= s <= 60)[:3]
        assert [(-score[k, j], found[k, j]) for j in range(3) if there[k, j]] == want
