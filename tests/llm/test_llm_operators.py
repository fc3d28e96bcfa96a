"""The corpus operators against brute force on small tables, and on odd rows."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftspark.llm import bpe, decontaminate, fingerprint, fm, language, lines, lm, quality, queries, simhash, suffix
from weftspark.llm import common as c

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key string, row string, label string, score string"
LONG = "Ab cde. " * 40000


def documents(spark, rows):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, s, len(t) if t else None, "x", "y", "z", "l", "s") for d, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and blank texts, a very long one, repeated ids and rows, no words, bytes of all kinds."""
    texts = [None, "", "   \n ", LONG, "a", "A b", "é漢 \U0001F600\x00!", "the same text of some length here\nand a second line", "the same text of some length here\nand a second line"]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s", None][i % 2]) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None), (None, None, None, None), (4, "a", "en", "s"), (4, "other text", "en", "s"), (8, texts[8], "en", None)]
    return documents(spark, rows)


def planted(seed=5):
    """Rows that share passages, some with a word changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(5, 120))] for _ in range(25)]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) - 1)
            part = list(b[a : a + rng.randint(8, 60)])
            if rng.random() < 0.4:
                part[rng.randint(0, len(part) - 1)] = word()
            text += " ".join(part) + rng.choice([" ", "\n", ". ", "  "]) + word() * rng.randint(0, 2) + " "
        rows.append((i * 3 % 140 if i < 145 else None, text if i % 37 else None, "en", "s"))
    return rows + [(500, "ab " * 300, "en", "s"), (501, "x" * 250 + "ab " * 90, "en", "s"), (503, "x" * 350, "en", "s"), (503, "x" * 350, "en", "s")]


def pairs(df):
    return df.select("doc_id", "text").collect()


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def reference_bpe():
    import base64

    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strvemld19aé²!　"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=30), max_size=6))
def test_bpe_encodes_any_text(reference_bpe, texts):
    raw, off = fingerprint.joined(texts)
    ids, edge = bpe.encode_rows(bpe.default_ranks(), raw, off)
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [reference_bpe.encode_ordinary(t) for t in texts]


def test_bpe_of_long_pieces(reference_bpe):
    for text in ("ab" * 3000, "".join(random.Random(1).choices("abcdetns", k=3000)), "a" * 2000):
        raw, off = fingerprint.joined([text])
        assert bpe.encode_rows(bpe.default_ranks(), raw, off)[0].tolist() == reference_bpe.encode_ordinary(text)


def test_bpe_chunks_are_stitched(spark, odd, reference_bpe):
    rng = random.Random(3)
    text = "".join(rng.choices(["don't", " ", "  ", "\n", "we'll", "x1y", "!!", "é", "aaa"], k=4000))
    df = documents(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (None, text[:2000], "en", "s"), (2, " " * 5000, "en", "s"), (3, "z" * 5000, "en", "s")]).union(odd)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(df, chunk=200, overlap=40).collect())
    assert got == Counter((r["doc_id"], tuple(reference_bpe.encode_ordinary(r["text"] or ""))) for r in pairs(df))


def test_bpe_cuts_long_texts_in_time_that_grows_with_their_length():
    """Cutting and stitching alone: four times the text takes some four times as long."""
    import time

    import pyarrow as pa

    took = []
    for n in (1 << 21, 1 << 23):
        text = "ab c" * (n // 4)
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["hash", "doc_id", "text"])
        began = time.perf_counter()
        parts = [(s, len(p)) for b in bpe.cut_up(32768, 512)([batch]) for s, p in zip(b.column("start").to_pylist(), b.column("part").to_pylist())]
        bounds = [(s, np.arange(0, k + 1, 2)) for s, k in parts]
        assert len(bpe.stitch(bounds, 8)) == n // 2 + 1
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_bpe_round_trip(spark, odd):
    got = Counter((r["doc_id"], bytes(r["bytes"])) for r in bpe.decode(bpe.encode(odd)).collect())
    assert got == Counter((r["doc_id"], (r["text"] or "").encode()) for r in pairs(odd))


# ---------------------------------------------------------------- repeated substrings


def repeated_bytes(rows, n=100):
    """rows: (doc_id, text, xxhash64 of the text)"""
    rows = [r[:2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        runs = len(re.findall(b"\1+", gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def ordered(df):
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


def crowded():
    """Many rows with a null id or one id, and a common line in unlike surroundings."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line = "this is the very common line that stands between unlike words in about a third of all the texts, and it is long enough for windows"
    rows = []
    for i in range(240):
        own = " ".join(word() for _ in range(25))
        text = f"{own} {line} {' '.join(word() for _ in range(25))}" if i % 3 == 0 else own
        rows.append(([None, 7, i][i % 3 if i % 2 else 2], text if i % 50 else None, "en", "s"))
    return rows + rows[:40]


@pytest.mark.parametrize("chunk, fan, hot", [(3000, 256, 1024), (1 << 22, 256, 1024), (2000, 3, 1024), (3000, 256, 5), (2000, 4, 0)])
def test_suffix_removes_what_starts_earlier(spark, chunk, fan, hot):
    for rows in (planted(), crowded()):
        df = documents(spark, rows)
        got = Counter(map(tuple, suffix.repeated_bytes(df, chunk, fan, hot).drop("spans").collect()))
        assert got == repeated_bytes(ordered(df))


def test_suffix_on_odd_rows(spark, odd):
    df = odd.where(F.length("text") < 1000).union(odd.where("text is null"))
    assert Counter(map(tuple, suffix.repeated_bytes(df).drop("spans").collect())) == repeated_bytes(ordered(df))
    assert suffix.repeated_bytes(odd).where(f"n_bytes = {len(LONG)}").first()["n_removed"] == len(LONG) - 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=6).map(str.encode), max_size=8).map(sorted), min_size=1, max_size=7))
def test_loser_tree(runs):
    prefix = lambda s: suffix.common_prefixes(s, 8).tolist() if s else []
    order, common = suffix.merged([(s, prefix(s)) for s in runs])
    heads = [iter(s) for s in runs]
    got = [next(heads[r]) for r in order]
    assert got == sorted(sum(runs, [])) and common[1:] == prefix(got)[1:]


def repeated_words(rows, n=13):
    least, out = {}, []
    key = lambda d: -1 << 63 if d is None else d
    words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            least[g] = min(least.get(g, 1 << 63), key(d))
    for d, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < key(d):
                gone[i : i + n] = b"\1" * n
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunk, hot", [(3000, 1024), (1 << 22, 1024), (3000, 3), (3000, 0)])
def test_fm_index_removes_what_starts_in_an_earlier_document(spark, odd, chunk, hot):
    for df in (documents(spark, planted()).union(odd), documents(spark, crowded())):
        got = Counter(map(tuple, fm.repeated_words(df, chunk, 2 * chunk, hot).drop("spans").collect()))
        assert got == repeated_words([tuple(r) for r in pairs(df)])


def test_fm_index_gives_matching_statistics():
    """The longest match that ends at each place, in texts with a smaller owner only, and where it is."""
    rng = np.random.default_rng(4)
    parts = [rng.integers(1, 5, n) for n in rng.integers(13, 60, 40)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    owner = np.repeat(np.arange(40) % 17, [len(p) + 1 for p in parts])
    index = fm.Index(text, owner, 13)
    other = rng.integers(1, 6, 400)  # 5 is in no text
    for below in (1, 6, 17):
        end = np.arange(13, 400)
        low, high, matched = index.search(other, end, 13, np.full(len(end), below))
        for e, a, b, m in zip(end.tolist(), low, high, matched.tolist()):
            places = lambda k: [i for i in range(len(text) - k + 1) if (text[i : i + k] == other[e - k : e]).all()]
            least = lambda k: min((owner[i] for i in places(k)), default=99)
            assert (m == 0 or least(m) < below) and (m == 13 or least(m + 1) >= below)
            if m:
                assert sorted(index.suffix[a:b].tolist()) == places(m)


def test_fm_index_decides(monkeypatch):
    """Windows that the backward search does not report stay."""
    size, doc, key = np.array([40, 40]), np.array([3, 9]), np.array([1, 1], np.uint64)
    code = np.array([*range(1, 41), *range(1, 31), *range(60, 70)])
    (s, e, first), (cs, ce, cfirst) = fm.matches(code, size, doc, key, np.array([False, True]))
    assert (s.tolist(), e.tolist(), first.tolist()) == ([40], [40 + 18], [0, 0, 1])
    assert (cs.tolist(), ce.tolist(), cfirst.tolist()) == ([40], [40 + 28], [0, 0, 1])  # copies find the piece's own document
    search = fm.Index.search
    monkeypatch.setattr(fm.Index, "search", lambda *a: (*search(*a)[:2], np.minimum(search(*a)[2], 12)))
    assert not any(len(s) for s, _, _ in fm.matches(code, size, doc, key, np.array([True, True])))


def test_fm_index_decides_on_copies_too(monkeypatch):
    """With a search that finds nothing, nothing goes: neither near copies nor exact ones, in one chunk or in several."""
    monkeypatch.setattr(fm.Index, "search", lambda self, text, end, most, below: (np.zeros(len(end), np.int64),) * 3)
    text = " ".join(f"w{i}" for i in range(60)).encode()
    tables = {k: [] for k in fm.CUT.replace(" binary", "").replace(" int", "").split(", ")}
    for chunk, doc, more in ((0, 4, 1), (1, 9, 0)):
        row = dict(range=0, chunk=chunk, id=np.int64(doc), key=np.uint64(5), at=np.int32(3), bytes=np.int32(len(text)), text=text, n_more=np.int32(more), more=np.full(more, 90, np.int32), other=np.ones(more, bool))
        for k, v in row.items():
            tables[k].append(v if isinstance(v, int | bytes) else v.tobytes())
    import pyarrow as pa

    assert fm.resolve(pa.table(tables)).num_rows == 0


# ---------------------------------------------------------------- near-duplicates


def test_simhash_groups(spark, odd):
    rng = random.Random(8)
    base = [[str(rng.randint(0, 50)) for _ in range(rng.randint(1, 200))] for _ in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else "Zz" for w in rng.choice(base)), "en", "s") for i in range(160)]
    df = documents(spark, rows).union(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000))
    prints = {}
    for d, t in pairs(df):
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.setdefault(d, set()).add(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    nodes = sorted(set().union(*prints.values()))
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for d, f in prints.items():
        for x in f:
            least[root(x)] = min(d, least.get(root(x), d))
    for max_key in (1 << 16, 3):
        got = {(r["doc_id"], r["f0"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(simhash.fingerprints(df), max_key=max_key).collect()}
        assert got == {(d, x, least[root(x)]) for d, f in prints.items() for x in f}


def test_simhash_of_crowded_ids(spark):
    """Many rows with a null id or one id, and a fingerprint that a third of all rows have."""
    df = documents(spark, crowded() + [(i, "one text that many rows have", "en", "s") for i in range(1000, 1200)] + [(None, None, None, None)] * 50)
    rows = simhash.groups(simhash.fingerprints(df), max_key=40).collect()
    assert len(rows) == df.count()
    by_print = {}
    for r in rows:
        by_print.setdefault(r["f0"], []).append(r)
    for f, same in by_print.items():
        assert len({r["component_id"] for r in same}) == 1
        near = [r["doc_id"] for o, x in by_print.items() if ((f ^ o) & (1 << 64) - 1).bit_count() <= 3 for r in x if r["doc_id"] is not None]
        assert not near or same[0]["component_id"] <= min(near)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    f = [rng.integers(0, 1 << 64, 150, dtype=np.uint64) for _ in range(2)]
    for radius in (3, 40, 57):
        planes, n = [simhash.planes_of(x) for x in f], len(f[0])
        q, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(3), indexing="ij"))
        lanes = np.where(b == 2, np.uint64((1 << (n - 128)) - 1), ~np.uint64(0))
        got = set(zip(*(x.tolist() for x in simhash.near(f, planes, q, b, lanes, radius))))
        distance = sum(np.bitwise_count(x[:, None] ^ x[None]).astype(int) for x in f)
        assert got == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_one_of_each(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=150)) for _ in range(20)]
    near = [t.replace(t.split()[70], "changed", 1) for t in texts[:10]]
    df = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts + near + texts[:5])] + [(3, texts[3], "en", "s"), (None, "x", None, None), (None, "x", None, None), (None, texts[5], None, None), (None, "y", None, None)])
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in simhash.one_of_each(df).collect())
    assert got == [(False, 0), (False, 0)] + [(True, i) for i in range(20)]  # of rows without an id, one of each text that no other row has


def test_one_of_each_decides_by_row(spark):
    texts = [" ".join(f"w{k * 40 + i}" for i in range(40)) for k in range(4)]
    near = texts[0] + " end"
    rows = [(1, texts[0]), (7, near), (7, texts[1]), (7, texts[2]), (7, texts[2]), (9, texts[1] + " end"), (None, texts[3])]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.one_of_each(documents(spark, [(d, t, "en", "s") for d, t in rows])).collect())
    assert got == Counter([(1, texts[0]), (7, texts[1]), (7, texts[2]), (None, texts[3])])


def jaccard_groups(rows, similarity=0.8, n=5):
    """{doc_id: the smallest that it reaches by links of this similarity}"""
    sets = {d: {tuple(w[i : i + n]) for w in [t.lower().split()] for i in range(max(1, len(w) - n + 1))} for d, t in rows}
    least = {d: d for d in sets}
    for _ in sets:
        before = dict(least)
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


@pytest.mark.parametrize("max_part", [2048, 5, 2])
def test_near_duplicates_by_jaccard(spark, max_part):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = words(24)
    texts = [" ".join(words(84) + shared * 10) for _ in range(2)]  # a repeated passage, otherwise unlike
    texts += [" ".join(x) for base in [words(200)] for k in (1, 10) for x in [base + shared * k]]
    for size in (3, 5, 6, 8, 12, 20, 40, 70, 150, 300):  # edits at both sides of the threshold
        for _ in range(4):
            base = words(size)
            texts.append(" ".join(base))
            for edits in (0.01, 0.02, 0.03, 0.04):
                texts.append(" ".join(w if rng.random() > edits else "edited" for w in base))
            texts += [" ".join(base + words(max(1, size // k))) for k in (3, 4, 5, 6, 9)]
    rows = list(enumerate(texts))
    df = documents(spark, [(d, t, "en", "s") for d, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, max_part=max_part).collect()}
    assert got == jaccard_groups(rows) and got[0] != got[1]


# ---------------------------------------------------------------- decontamination


def contaminated(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, gone, found = words(t), set(), set()
        for name, text in items:
            x = words(text)
            k = min(n, len(x))
            grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    gone |= set(range(i, i + k))
                    found.add(name)
        out.append((d, len(w), len(gone), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_decontamination(spark, odd, block):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 11, 40])))) for k in range(40)] + [("i0", None), ("e", ""), ("e2", "?!")]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1] or ""
            w[rng.randint(0, len(w)) : 0] = x.upper().split()[: rng.choice([100, 9, 10])]
        rows.append((i, rng.choice([" ", ", "]).join(w), "en", "s"))
    df = documents(spark, rows).union(odd)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, doc_id int")
    got = decontaminate.contamination(df.orderBy(F.rand(1)), bench, block_bytes=block).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(set(r["items"])))) for r in got) == contaminated([tuple(r) for r in pairs(df)], items)
    assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_items_that_share_a_prompt(spark):
    """Each shared window is one, however many items have it."""
    prompt = [f"p{i}" for i in range(12)]
    items = [(f"i{k}", " ".join([*prompt, *(f"q{k}x{i}" for i in range(6))])) for k in range(20000)]
    raw, off = fingerprint.joined([t for _, t in items])
    index = decontaminate.Index([n for n, _ in items], *decontaminate.words(raw, off), 5, 10)
    assert len(index.begin) - 1 == 3 + 6 * len(items)
    hashes, first = decontaminate.words(*fingerprint.joined([t for _, t in items[:3000]]))
    assert sum(len(begin) for begin, _, _ in index.hits(hashes, first)) == 9 * 3000
    docs = documents(spark, [(1, "so " + " ".join(prompt) + " end", "en", "s"), (2, items[7][1], "en", "s"), (3, " ".join(prompt[3:]), "en", "s")])
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 23, 1000):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench, block_bytes=block).select("doc_id", "n_hit", F.size("items").alias("items")).collect()}
        assert got == {1: (12, 20000), 2: (18, 20000), 3: (0, 0)}


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_clean_decides_by_row(spark, odd, block):
    items = [(f"i{k}", " ".join(f"v{k * 20 + i}" for i in range(12))) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(d, t, "en", "s") for d in (None, 4) for t in [f"so: {items[0][1]} it is", items[3][1].upper(), "a clean text", None]]
    df = documents(spark, rows).union(odd)
    got = decontaminate.clean(df, bench, block_bytes=block)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, documents(spark, [r for r in rows if r[1] in ("a clean text", None)]).union(odd).collect()))


# ---------------------------------------------------------------- lines


def test_line_dedup(spark, odd):
    rows = [(i, f"Menu\n\nown {i}\n Menu \nshared {i % 2}", "en", "a") for i in range(6)] + [(10 + i, "Menu\nx", "en", "b") for i in range(3)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.dedup_documents(documents(spark, rows)).collect()}
    assert got == {i: (t := f"\nown {i}\nshared {i % 2}", len(t)) for i in range(6)} | {10 + i: ("Menu\nx", 6) for i in range(3)}
    out = lines.dedup_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_line_dedup_of_sources(spark):
    """Planted boilerplate on 4 % of a source's documents goes; unique lines, copied documents and near copies stay."""
    own = lambda i: "\n".join(f"line {k} of document {i}" for k in range(4))
    rows = [(i, own(i) + ("\nAll rights  reserved." if i % 25 == 0 else ""), "en", "a") for i in range(200)]
    rows += [(300 + i, "a text that is copied\nwith two lines", "en", "a") for i in range(20)]
    rows += [(400 + i, own(500) + f"\nedit {i}", "en", "a") for i in range(20)]
    rows += [(600, "a text that is copied\n" + own(600), "en", "a"), (700, None, None, None), (701, "", "en", "a")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_documents(documents(spark, rows)).collect()}
    assert got == {d: t and t.removesuffix("\nAll rights  reserved.") for d, t, *_ in rows}


def test_hosts(spark):
    urls = ["http://u:p@WWW.Example.org:80/x?y", "https://a.b", "no url", None, "ftp://h#f"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", lines.host_of(F.col("u")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == ["www.example.org", "a.b", "", "", "h"]


def test_line_dedup_without_an_over_half_rule(spark):
    """Boilerplate goes from texts that are little else as well; near copies keep their lines though they are many."""
    own = lambda i: "\n".join(f"line {k} of document {i}" for k in range(4))
    rows = [(i, own(i) + "\nAll rights reserved by the owner", "en", "a") for i in range(40)]
    rows += [(100, "short\nAll rights reserved by the owner", "en", "a"), (101, "All rights reserved by the owner", "en", "a")]
    rows += [(200 + i, own(500) + f"\nedit {i}", "en", "a") for i in range(150)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_documents(documents(spark, rows)).collect()}
    assert got == {d: t.replace("\nAll rights reserved by the owner", "").replace("All rights reserved by the owner", "") for d, t, *_ in rows}


# ---------------------------------------------------------------- fingerprints


def likeness(a, b):
    """Common digests of two texts' paragraphs, by sets."""
    left, right = (set(fingerprint.digests(*fingerprint.joined([t]))[0].tolist()) for t in (a, b))
    return round(2 * len(left & right) / (len(left) + len(right)), 9) if left or right else 1.0


def test_fingerprints_of_neighbours(spark, odd):
    df = documents(spark, planted()).union(odd)
    for bucket in (1 << 24, 2000):
        got = [(*tuple(r)[:3], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprint.edited_neighbours(df, bucket).collect()]
        rows = sorted((tuple(r) for r in pairs(df)), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))
        want = []
        for (d, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
            a, b = a or "", b or ""
            edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            want.append((d, len(a), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, edited), likeness(a, b)))
        assert Counter(got) == Counter(want)


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(4)
    lines_ = [f"paragraph number {i} of the text" for i in range(400)]
    left = "\n".join(lines_)
    right = "\n".join(x if rng.random() > 0.3 else x + " changed" for x in lines_)
    df = spark.createDataFrame([(1, left, right), (2, left, left), (3, None, ""), (4, "a", "b")], "k int, left string, right string")
    got = {r["k"]: r for r in fingerprint.compare(df).collect()}
    key = [set(fingerprint.digests(*fingerprint.joined([t]))[0].view(np.int64).tolist()) for t in (left, right)]
    assert set(got[1]["only_left"]) == key[0] - key[1] and set(got[1]["only_right"]) == key[1] - key[0]
    assert got[1]["cells"] > got[2]["cells"] and got[2]["near"] == got[3]["near"] == 1.0 and got[4]["near"] == 0.0
    total, common = len(key[0]) + len(key[1]), len(key[0] & key[1])
    assert got[1]["near"] == pytest.approx(2 * common / total)


# ---------------------------------------------------------------- models


def test_language_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs.where(language.held_out()), language.fit(docs.where(~language.held_out())))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    out = language.predict(odd, language.fit(docs))
    assert out.count() == odd.count()
    assert {r["lang_pred"] for r in out.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_language_filter_has_no_false_negative():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
    model = language.Model(["a", "b"], [np.zeros(1 << 16, np.uint8)], np.zeros(2), np.ones(2) / 2)
    for f in language.FACTORS[: language.HASHES]:
        np.bitwise_or.at(model.slots[0], (grams ^ (grams >> np.uint32(15))) * np.uint32(f) >> np.uint32(16), np.uint8(2))
    assert (model.masks(grams)[0] == 2).all()


def test_full_language_filters_still_tell_languages_apart(spark):
    """With far more n-grams than slots, most absent n-grams count as present, and are corrected for; none is left out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()), most=16)
    assert len(model.slots[0]) == 1 << 16
    got = language.predict(docs.where(language.held_out()), model)
    assert got.where("lang = lang_pred").count() >= 0.95 * got.where("lang is not null").count()


def test_more_languages_than_a_mask_holds(spark):
    """130 languages, each with letters of its own."""
    text = lambda k, rng: " ".join("".join(rng.choices([chr(0x4E00 + 50 * k + i) for i in range(5)], k=5)) for _ in range(60))
    rng = random.Random(4)
    docs = documents(spark, [(k * 3 + j, text(k, rng), f"l{k}", "s") for k in range(130) for j in range(3)])
    model = language.fit(docs)
    assert len(model.slots) == 3
    got = language.predict(documents(spark, [(k, text(k, rng), f"l{k}", "s") for k in range(130)]), model)
    assert got.where("lang = lang_pred").count() == 130


def test_quality_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    out = quality.score(docs.where(quality.held_out()), model).join(labels, "doc_id")
    rates = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg((F.col("score") >= quality.THRESHOLD).cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.1
    got = quality.score(odd, model)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.score(odd, quality.fit(odd, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.fit(docs.limit(50), labels, max_labelled=5).vectors.shape[1] <= 5


def invented(rng, n, size=90):
    """Sentences over some hundred words, each of which depends on the two before it."""
    words = ["".join(random.Random(k).choices("abcdefgh", k=4 + k % 5)) + str(k) for k in range(400)]
    texts = []
    for _ in range(n):
        at, text = rng.randrange(400), []
        for _ in range(size):
            text.append(words[at])
            at = (at * 7 + rng.choice([1, 2, 3])) % 400
        texts.append(" ".join(text))
    return texts


def test_lm_learns_context(spark, odd):
    rng = random.Random(1)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(invented(rng, 150))])
    held = lm.vocabulary(docs)
    net, plain = lm.train(docs, held), lm.Network(held)
    fresh = invented(rng, 20)
    mixed = [" ".join(rng.sample(t.split(), 90)) for t in fresh]
    probe = documents(spark, [(i + 100, t, "en", "s") for i, t in enumerate(fresh + mixed)])
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(probe, net).collect()}
    before = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(probe, plain).collect()}
    mean = lambda x, ids: sum(x[i] for i in ids) / len(ids)
    assert mean(got, range(100, 120)) > mean(got, range(120, 140)) + 1  # its words in another order
    assert mean(got, range(100, 120)) > mean(before, range(100, 120)) + 1  # the shares of words alone
    out = lm.score(odd, net)
    assert out.count() == odd.count() and {(r["n_tokens"], r["log_likelihood"]) for r in out.where("doc_id in (0, 1, 2)").collect()} == {(0, 0.0)}


def test_lm_scores_by_brute_force(spark):
    """Sums of conditional log-probabilities, each of them from softmaxes over all classes and all symbols of a class."""
    texts = invented(random.Random(2), 30)
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    net = lm.train(docs, lm.vocabulary(docs), steps=3)
    held, (e, a, b, u, w) = net.held, [x.astype(float) for x in net.weights]
    rows = texts[:3] + ["UNKNOWN-words 12", "é"]
    got = {r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in lm.score(documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)]), net).collect()}
    log_softmax = lambda y: y - np.log(np.exp(y - y.max()).sum()) - y.max()
    for i, text in enumerate(rows):
        symbols = held.symbols(*fingerprint.joined([text]))[0].tolist()
        line, total = [held.beyond] * 2 + symbols + [held.beyond] * 2, 0.0
        for k, s in enumerate(symbols):
            h = np.append(np.tanh(sum(e[line[k + 2 + p]] @ a[j] for j, p in enumerate(lm.WINDOW)) + b), 1)
            every = [log_softmax(u @ h)[held.group[v]] + log_softmax(w[held.group[v]] @ h)[held.place[v]] for v in range(held.beyond)] if k == 0 else None
            if every:
                assert np.exp(every).sum() == pytest.approx(1)
            total += log_softmax(u @ h)[held.group[s]] + log_softmax(w[held.group[s]] @ h)[held.place[s]]
        assert got[i][0] == len(symbols) and got[i][1] == pytest.approx(total, rel=1e-4)


def test_lm_symbols_tell_words_apart(spark):
    """Each text's symbols can be read back, whether words are known or not."""
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(invented(random.Random(3), 40))])
    held = lm.vocabulary(docs)
    texts = ["", "a", "ab cd", "abcd", "abc d", "abcdefgh", "abcd efgh", "abcde fgh", "ünïcode wörds", *invented(random.Random(4), 5)]
    symbols, first = held.symbols(*fingerprint.joined(texts))
    seen = [tuple(symbols[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert len(set(seen)) == len(texts) and len(seen[-1]) == 90  # its words are known
    assert seen == [tuple(held.symbols(*fingerprint.joined([t.upper() if t.isascii() else t]))[0].tolist()) for t in texts]
    assert len(set(zip(held.group.tolist(), held.place.tolist()))) == held.beyond and held.place.max() < held.width


def test_lm_does_not_depend_on_partitions(spark):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(invented(random.Random(5), 60))])
    scores = []
    for df in (docs.repartition(1), docs.repartition(8)):
        net = lm.train(df, lm.vocabulary(df), shard_bytes=8000, steps=5)
        scores.append({r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(df, net).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


# ---------------------------------------------------------------- all


def test_empty_tables(spark, odd):
    none, pages = odd.limit(0), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        suffix.repeated_bytes(none), fm.repeated_words(none), bpe.digests(bpe.encode(none)), bpe.decode(bpe.encode(none)), simhash.one_of_each(none), simhash.groups(simhash.fingerprints(none)),
        decontaminate.contamination(none, pages.select(F.col("page_id").alias("item_id"), F.col("html").alias("text"))), lines.dedup_documents(none), fingerprint.edited_neighbours(none),
        language.predict(none, language.fit(none)), quality.score(none, quality.fit(none, labels)), lm.score(none, lm.train(none, lm.vocabulary(none))),
    ]
    assert [df.count() for df in frames] == [0] * len(frames)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_output_names_as_input_columns(spark):
    """Documents may have columns of any name, those that operators give or use themselves among them."""
    from weftspark.llm import collocations, tokens

    names = "near only_left only_right cells fingerprint edited_fingerprint component component_id node block parts part few hash hashes n n_words n_hit n_items n_removed n_spans spans kept_sha256 n_tokens n_bytes ids bounds start rows deal over_limit lang_pred score quality predicted held_out word phrase rank vector terms counts page_id host line lines bad copy pages size __parts __salt".split()
    df = spark.createDataFrame([(i, f"Menu\nsome words of text number {i % 3} for all", "en", "s", 40) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.withColumns({x: F.lit("x") for x in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    items = df.select(F.col("doc_id").alias("item_id"), "text", F.lit("x").alias("n"), F.lit("x").alias("key"))
    assert simhash.one_of_each(wide).count() == 3 and simhash.groups(simhash.fingerprints(wide)).count() == 6
    assert lines.dedup_documents(wide).columns == wide.columns and bpe.encode(wide).count() == tokens.count(wide).count() == 6
    assert quality.score(wide, quality.fit(wide, labels), "__quality").count() == language.predict(wide, language.fit(wide)).count() == 6
    assert fm.repeated_words(wide).count() == suffix.repeated_bytes(wide).count() == fingerprint.edited_neighbours(wide).count() == 6
    assert decontaminate.contamination(wide, items).count() == 6 and decontaminate.clean(wide, items).columns == wide.columns
    assert collocations.collocations(wide, least=2).count() > 0 and lm.score(wide, lm.train(wide, lm.vocabulary(wide))).count() == 6
    versions = wide.select("*", F.col("text").alias("left"), F.col("text").alias("right"))
    assert {r["near"] for r in fingerprint.compare(versions).collect()} == {1.0}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())


def test_pipeline_by_brute_force(spark, reference_bpe):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    rows = [{r["doc_id"]: r for r in df.collect()} for df in kept]
    assert all(df.columns == docs.columns for df in kept[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = [labels[d] for d in rows[0].keys() - rows[1].keys() if d in labels]
    assert all(d in rows[1] for d, q in labels.items() if q == 1 and d in rows[0]) and all(q == 0 for q in gone)
    by_source = {}
    for r in rows[1].values():
        by_source.setdefault(r["source"], []).append([x.strip(" ") for x in r["text"].split("\n")])
    for d, r in rows[1].items():
        pages = by_source[r["source"]]
        pages = {tuple(page) for page in pages}
        bad = {x for x, k in Counter(x for page in pages for x in set(page) if x).items() if k >= lines.SOURCE_LEAST and k > lines.SOURCE_RATIO * len(pages)}
        own = [page for page in pages if sum(len(x) for x in page if x not in bad) > lines.OWN * sum(map(len, page))]
        bad = {x for x, k in Counter(x for page in own for x in set(page) & bad).items() if k >= lines.SOURCE_LEAST and k > lines.SOURCE_RATIO * len(pages)}
        assert rows[2][d]["text"] == "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in bad)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    sets = {d: shingles(r["text"]) for d, r in rows[2].items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(rows[3])
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(a, b) >= 0.8]
    for d in rows[2].keys() - rows[3].keys():
        assert max(near(d, o) for o in rows[2] if o != d) >= 0.8
    hit = {d for (d, _, n, _) in contaminated([(d, r["text"]) for d, r in rows[3].items()], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]) if n}
    assert rows[4].keys() == rows[3].keys() - hit
    assert {d: r["ids"] for d, r in rows[5].items()} == {d: reference_bpe.encode_ordinary(r["text"]) for d, r in rows[4].items()}
