"""Queries over the test tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as f
from ..operators import events as ev
from ..operators import inference as inf
from ..operators import pairs as pr
from ..operators import permute as pm
from ..operators import pooling as po
from ..operators import profile as pf
from ..operators import ranks as rk
from ..operators import reliability as rel
from ..operators import segments as sg
from ..operators import strips as st
from . import geometry as gm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUISANCES = ["position", "size", "kind"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: f.r6(F.col(n)) for n in names})


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# ---------------------------------------------------------------- SQL fragments

EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def centered(v: str) -> str:
    return f"list_transform({v}, lambda x: x - list_avg({v}))"


def ranks(source: str, keys: list[str], values: list[str], rest: str = "*") -> str:
    part = ", ".join(keys)
    return f"SELECT {rest}, " + ", ".join(f"rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0 AS r_{v}" for v in values) + f" FROM {source}"


def projected(source: str, keys: list[str], targets: list[str], nuisances: list[str], rest: list[str] = ()) -> str:
    """CTEs ending in p_last: v_<target> with centred nuisance ranks taken out one after another."""
    part, rest = ", ".join(keys), [*keys, *rest]
    every = targets + nuisances
    out = [f"p_rank AS ({ranks(source, keys, every)})", "p_0 AS (SELECT " + ", ".join(rest) + ", " + ", ".join(f"r_{v} - avg(r_{v}) OVER (PARTITION BY {part}) AS v_{v}" for v in every) + " FROM p_rank)"]
    for k, q in enumerate(nuisances):
        left = targets + nuisances[k + 1 :]
        out.append(f"p_{k + 1} AS (SELECT " + ", ".join(rest) + ", " + ", ".join(f"v_{t} - v_{q} * (sum(v_{t} * v_{q}) OVER (PARTITION BY {part}) / nullif(sum(v_{q} * v_{q}) OVER (PARTITION BY {part}), 0)) AS v_{t}" for t in left) + f" FROM p_{k})")
    return ",\n".join([*out, f"p_last AS (SELECT * FROM p_{len(nuisances)})"])


# ---------------------------------------------------------------- pair distances


def embedding_pairs(metric: str, sql: str):
    def run(spark, sf):
        return rounded(pr.distances(read(spark, sf, "embeddings"), "label", "vec_id", d=(metric, F.col("embedding"))), "d")

    run.__name__ = f"rdm_{metric}"
    query(f"WITH {EMB} SELECT a.label, a.vec_id AS i, b.vec_id AS j, {r(sql)} AS d FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id")(run)


embedding_pairs("correlation", f"1 - list_cosine_similarity({centered('a.v')}, {centered('b.v')})")
embedding_pairs("cosine", "list_cosine_distance(a.v, b.v)")
embedding_pairs("euclidean", "list_distance(a.v, b.v)")


@query(f"""WITH {EMB}, s AS (SELECT *, unnest(range(0, 8)) AS bin FROM e), b AS (SELECT vec_id, label, bin, v[bin * 8 + 1 : bin * 8 + 8] AS v FROM s)
SELECT a.label, a.vec_id AS i, b.vec_id AS j, {r(f"avg(1 - list_cosine_similarity({centered('a.v')}, {centered('b.v')}))")} AS d FROM b a JOIN b b ON a.label = b.label AND a.bin = b.bin AND a.vec_id < b.vec_id GROUP BY 1, 2, 3""")
def rdm_binwise_mean(spark, sf):
    items = read(spark, sf, "embeddings").withColumn("b", f.bins(F.col("embedding"), 8))
    return rounded(pr.distances(items, "label", "vec_id", d=("binwise", F.col("b"))), "d")


TEXT_METRICS = {"cityblock": F.length, "hamming": lambda _: F.col("role"), "jaccard": lambda t: t, "punct": f.punctuation_count}
MARKS = (f.ASCII_MARKS + f.CJK_MARKS).replace("'", "''")


def text_pairs(name: str, metric: str, column, sql: str):
    def run(spark, sf):
        rows = read(spark, sf, "conversations")
        return rounded(pr.distances(rows, "conv_id", "turn", d=(metric, column())), "d")

    run.__name__ = f"rdm_{name}"
    query(f"SELECT a.conv_id, a.turn AS i, b.turn AS j, {r(sql)} AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")(run)


CHARS = "list_distinct(string_split({}.text, ''))"
text_pairs("cityblock", "cityblock", lambda: F.length("text"), "CAST(abs(length(a.text) - length(b.text)) AS DOUBLE)")
text_pairs("hamming", "hamming", lambda: F.col("role"), "CAST(CAST(a.role <> b.role AS INTEGER) AS DOUBLE)")
text_pairs("jaccard_chars", "jaccard", lambda: F.col("text"), f"1.0 - len(list_intersect({CHARS.format('a')}, {CHARS.format('b')})) / len(list_distinct(list_concat({CHARS.format('a')}, {CHARS.format('b')})))")
text_pairs("punct", "cityblock", lambda: f.punctuation_count(F.col("text")), f"CAST(abs((length(a.text) - length(translate(a.text, '{MARKS}', ''))) - (length(b.text) - length(translate(b.text, '{MARKS}', '')))) AS DOUBLE)")


@query(f"""WITH {EMB}, l AS (SELECT label, vec_id, unnest(range(0, 64)) AS dim, v FROM e), x AS (SELECT label, vec_id, dim, v[dim + 1] AS x FROM l)
SELECT label, vec_id, CAST(dim AS INTEGER) AS dim, {r("(x - avg(x) OVER (PARTITION BY label, dim)) / coalesce(nullif(stddev_pop(x) OVER (PARTITION BY label, dim), 0), 1)")} AS z FROM x""")
def zscore_columns(spark, sf):
    return rounded(pr.zscored(read(spark, sf, "embeddings"), "label", "vec_id", "embedding"), "z")


@query()
def pca_euclidean(spark, sf):
    return rounded(pr.principal_distances(read(spark, sf, "embeddings"), "label", "vec_id", "embedding", 16), "d")


def features(spark, sf) -> DataFrame:
    """Features of a recording's rows: labels as subjects, 8 bins of 8 channels, their means and deviations over bins."""
    rows = read(spark, sf, "embeddings").withColumn("relative", f.bins(f.doubles(F.col("embedding")), 8)).withColumnsRenamed({"label": "subject", "vec_id": "row"})
    channel = lambda fold: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: fold(F.transform("relative", lambda b: F.get(b, c))))
    mean = lambda v: f.total(v) / F.size(v)
    spread = lambda v: F.sqrt(f.total(F.transform(f.centered(v), lambda x: x * x)) / F.size(v))
    return rows.select("subject", "row", "relative", channel(mean).alias("row_mean"), channel(spread).alias("row_std"))


@query(f"""WITH {EMB}, k AS (SELECT label, vec_id, v, unnest(range(0, 64)) AS k FROM e), x AS (SELECT label, vec_id, k, v[k + 1] AS x FROM k),
m AS (SELECT label, vec_id, k % 8 AS k, avg(x) AS mean, stddev_pop(x) AS sd FROM x GROUP BY 1, 2, 3),
u AS (SELECT 'flat' AS name, * FROM x UNION ALL SELECT 'row_mean', label, vec_id, k, mean FROM m UNION ALL SELECT 'row_std', label, vec_id, k, sd FROM m),
z AS (SELECT name, label, vec_id, k, (x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS z FROM u WINDOW w AS (PARTITION BY name, label, k)),
s AS (SELECT name, label, vec_id, 0 AS bin, list(z ORDER BY k) AS v FROM z GROUP BY 1, 2, 3 UNION ALL SELECT 'bin', label, vec_id, k // 8, list(z ORDER BY k) FROM z WHERE name = 'flat' GROUP BY 2, 3, 4),
d AS (SELECT a.name, a.label, a.vec_id AS i, b.vec_id AS j, avg(1 - list_cosine_similarity({centered('a.v')}, {centered('b.v')})) AS d FROM s a JOIN s b ON a.name = b.name AND a.label = b.label AND a.bin = b.bin AND a.vec_id < b.vec_id GROUP BY 1, 2, 3, 4)
SELECT CASE name WHEN 'bin' THEN 'binwise_correlation_mean' ELSE name || '_correlation' END AS variant, label AS subject, i, j, {r('d')} AS d FROM d""")
def representation_variants(spark, sf):
    """The representations of a row side by side; the principal components' own query is pca_euclidean."""
    return rounded(gm.variants(features(spark, sf), ()), "d")


def spectrum(texts: list[str]):
    """A stand-in for a model: the numbers of vowels, of other ASCII letters, and of the rest."""
    import numpy as np

    out = np.zeros((len(texts), 3), np.float32)
    for row, text in zip(out, texts):
        vowels, letters = sum(text.count(c) for c in "aeiou"), sum("a" <= c <= "z" for c in text)
        row[:] = vowels, letters - vowels, len(text) - letters
    return out


@query("""WITH t AS (SELECT conv_id, turn, 'query: ' || coalesce(text, '') AS t FROM conversations),
c AS (SELECT *, length(t) - length(translate(t, 'aeiou', '')) AS vowels, length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) AS letters FROM t)
SELECT conv_id, turn, vowels, letters - vowels AS consonants, length(t) - letters AS other FROM c""")
def batched_encoding(spark, sf):
    """Texts with a prefix through an encoder, in batches; the encoder stands in for a model that counts the same characters."""
    got = po.embedded(read(spark, sf, "conversations"), F.col("text"), lambda: spectrum, "query: ")
    return got.select("conv_id", "turn", *(F.col("vector")[k].cast("long").alias(name) for k, name in enumerate(("vowels", "consonants", "other"))))


# ---------------------------------------------------------------- ranks and association


@query(f"SELECT l_orderkey, l_linenumber, r_l_extendedprice AS rank FROM ({ranks('lineitem', ['l_returnflag'], ['l_extendedprice'])})")
def rank_average(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rk.ranked_wide(rows, "l_returnflag", "l_extendedprice").select("l_orderkey", "l_linenumber", F.col("r_l_extendedprice").alias("rank"))


@query(f"SELECT l_orderkey, l_linenumber, {r('(q - avg(q) OVER (PARTITION BY l_returnflag)) / stddev_pop(q) OVER (PARTITION BY l_returnflag)')} AS z FROM (SELECT *, r_l_quantity AS q FROM ({ranks('lineitem', ['l_returnflag'], ['l_quantity'])}))")
def rank_z(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rounded(rk.rank_z(rows, "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", F.col("z_l_quantity").alias("z")), "z")


@query(f"SELECT l_returnflag, {r('corr(r_l_quantity, r_l_extendedprice)')} AS rho FROM ({ranks('lineitem', ['l_returnflag'], ['l_quantity', 'l_extendedprice'])}) GROUP BY 1")
def spearman(spark, sf):
    return rounded(rk.spearman(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"), "rho")


@query(f"""WITH {projected('lineitem', ['l_returnflag'], ['l_extendedprice'], ['l_quantity', 'l_discount', 'l_tax'], ['l_orderkey', 'l_linenumber'])}
SELECT l_orderkey, l_linenumber, {r('v_l_extendedprice / stddev_pop(v_l_extendedprice) OVER (PARTITION BY l_returnflag)')} AS residual FROM p_last""")
def residualize_ranked(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    got = rk.residualized(rows, "l_returnflag", ["l_extendedprice"], ["l_quantity", "l_discount", "l_tax"])
    return rounded(got.select("l_orderkey", "l_linenumber", F.col("e_l_extendedprice").alias("residual")), "residual")


def pair_table(items: DataFrame, group: str, item: str, metrics: dict) -> DataFrame | st.Pairs:
    """The pairs as rows, or as strips where a group has too many to be written."""
    return st.Pairs(items, group, item, **metrics) if st.large(items, group) else pr.distances(items, group, item, **metrics)


def geometry(spark, sf) -> DataFrame | st.Pairs:
    """Pairs of a label's vectors: distance of the first halves (x) and of the second (y), and three nuisance distances."""
    items = read(spark, sf, "embeddings").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    v = F.col("embedding")
    return pair_table(items, "label", "place", {"x": ("correlation", F.slice(v, 1, 32)), "y": ("cosine", F.slice(v, 33, 32)), "position": ("cityblock", F.col("place")), "size": ("cityblock", F.round(f.norm(f.doubles(F.slice(v, 1, 32))), 6)), "kind": ("hamming", F.col("vec_id") % 3)})


GEOMETRY = f"""e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings),
n AS (SELECT *, v[1:32] AS h, v[33:64] AS t, round(sqrt(list_inner_product(v[1:32], v[1:32])), 6) AS size FROM e),
g AS (SELECT a.label, a.place AS i, b.place AS j, 1 - list_cosine_similarity({centered('a.h')}, {centered('b.h')}) AS x, list_cosine_distance(a.t, b.t) AS y,
  CAST(abs(a.place - b.place) AS DOUBLE) AS position, abs(a.size - b.size) AS size, CAST(CAST(a.vec_id % 3 <> b.vec_id % 3 AS INTEGER) AS DOUBLE) AS kind
  FROM n a JOIN n b ON a.label = b.label AND a.place < b.place)"""


@query(f"WITH {GEOMETRY}, {projected('g', ['label'], ['x', 'y'], NUISANCES)} SELECT label, {r('corr(v_x, v_y)')} AS rho FROM p_last GROUP BY 1")
def partial_spearman(spark, sf):
    g = geometry(spark, sf)
    if isinstance(g, st.Pairs):
        return rounded(st.partial_spearman(g, "x", "y", NUISANCES), "rho")
    return rounded(rk.partial_spearman(g, "label", "x", "y", NUISANCES), "rho")


@query(f"""WITH {GEOMETRY}, {projected('g', ['label'], ['x', 'y'], NUISANCES)},
s AS (SELECT label, round(v_x / stddev_pop(v_x) OVER (PARTITION BY label), 9) AS x, round(v_y / stddev_pop(v_y) OVER (PARTITION BY label), 9) AS y FROM p_last)
SELECT label, {r('corr(r_x, r_y)')} AS rho FROM ({ranks('s', ['label'], ['x', 'y'])}) GROUP BY 1""")
def partial_spearman_exploratory(spark, sf):
    g = geometry(spark, sf)
    if isinstance(g, st.Pairs):
        return rounded(st.partial_spearman_of_residuals(g, "x", "y", NUISANCES), "rho")
    return rounded(rk.partial_spearman_of_residuals(g, "label", "x", "y", NUISANCES), "rho")


# ---------------------------------------------------------------- reliability


def subject_pairs(spark, sf, metric: str = "correlation", column=None) -> DataFrame | st.Pairs:
    items = rel.common_items(read(spark, sf, "embeddings"), "label", "vec_id").withColumnRenamed("label", "subject")
    return pair_table(items, "subject", "item", {"d": (metric, F.col("embedding") if column is None else column)})


def agreement(pairs: DataFrame | st.Pairs, value: str = "d") -> DataFrame:
    """(subject_a, subject_b, rho)."""
    if isinstance(pairs, st.Pairs):
        return st.agreement(pairs, value)
    return rel.subject_matrix(pairs, value)


def left_out(pairs: DataFrame | st.Pairs, value: str = "d") -> DataFrame:
    """(subject, rho)."""
    if isinstance(pairs, st.Pairs):
        return st.leave_one_out(pairs, value).drop("perm")
    return rel.leave_one_out(pairs, value)


SUBJECTS = f"""{EMB}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS item FROM e),
c AS (SELECT * FROM o WHERE item < (SELECT min(n) FROM (SELECT count(*) AS n FROM e GROUP BY label))),
d AS (SELECT a.label AS subject, a.item AS i, b.item AS j, 1 - list_cosine_similarity({centered('a.v')}, {centered('b.v')}) AS d FROM c a JOIN c b ON a.label = b.label AND a.item < b.item)"""
LOO = f"""t AS (SELECT *, (sum(d) OVER (PARTITION BY i, j) - d) / (count(*) OVER (PARTITION BY i, j) - 1) AS rest FROM d),
loo AS (SELECT subject, corr(r_d, r_rest) AS rho FROM ({ranks('t', ['subject'], ['d', 'rest'])}) GROUP BY 1)"""


@query(f"""WITH {SUBJECTS}, k AS ({ranks('d', ['subject'], ['d'])})
SELECT a.subject AS subject_a, b.subject AS subject_b, {r('corr(a.r_d, b.r_d)')} AS rho FROM k a JOIN k b ON a.i = b.i AND a.j = b.j AND a.subject < b.subject GROUP BY 1, 2""")
def spearman_matrix(spark, sf):
    return rounded(agreement(subject_pairs(spark, sf)), "rho")


@query(f"""WITH {SUBJECTS}, k AS ({ranks('d', ['subject'], ['d'])}),
m AS (SELECT a.subject AS subject_a, b.subject AS subject_b, corr(a.r_d, b.r_d) AS rho FROM k a JOIN k b ON a.i = b.i AND a.j = b.j AND a.subject < b.subject GROUP BY 1, 2),
s AS (SELECT unnest([subject_a, subject_b]) AS subject, rho FROM m)
SELECT subject, {r('avg(rho)')} AS mean, {r('median(rho)')} AS median, {r('min(rho)')} AS min, {r('max(rho)')} AS max, count(*) AS n FROM s GROUP BY 1""")
def reliability_pairwise(spark, sf):
    """Each subject's agreement with every other one."""
    pairs = agreement(subject_pairs(spark, sf))
    each = pairs.select(F.explode(F.array("subject_a", "subject_b")).alias("subject"), "rho")
    return rounded(rel.summary(each, "subject", "rho"), "mean", "median", "min", "max")


@query(f"""WITH {GEOMETRY}, k AS ({ranks('g', ['label'], ['x', *NUISANCES])}),
m AS (SELECT label, {', '.join(f'corr(r_x, r_{n}) AS {n}' for n in NUISANCES)} FROM k GROUP BY 1)
SELECT label, other, {r('rho')} AS rho FROM (UNPIVOT m ON {', '.join(NUISANCES)} INTO NAME other VALUE rho)""")
def nuisance_association(spark, sf):
    g = geometry(spark, sf)
    if isinstance(g, st.Pairs):
        return rounded(st.associations(g, "x", NUISANCES), "rho")
    return rounded(rk.associations(g, "label", "x", NUISANCES), "rho")


@query(f"WITH {SUBJECTS}, {LOO} SELECT subject, {r('rho')} AS rho FROM loo")
def reliability_loo(spark, sf):
    return rounded(left_out(subject_pairs(spark, sf)), "rho")


@query(f"""WITH {EMB}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS item FROM e),
c AS (SELECT * FROM o WHERE item < (SELECT min(n) FROM (SELECT count(*) AS n FROM e GROUP BY label))),
d AS (SELECT variant, a.label AS subject, a.item AS i, b.item AS j, CASE variant WHEN 'correlation' THEN 1 - list_cosine_similarity({centered('a.v')}, {centered('b.v')}) WHEN 'cosine' THEN list_cosine_distance(a.v, b.v) ELSE list_distance(a.v, b.v) END AS d
  FROM c a JOIN c b ON a.label = b.label AND a.item < b.item, (SELECT unnest(['correlation', 'cosine', 'euclidean']) AS variant)),
t AS (SELECT *, (sum(d) OVER (PARTITION BY variant, i, j) - d) / (count(*) OVER (PARTITION BY variant, i, j) - 1) AS rest FROM d),
loo AS (SELECT variant, subject, corr(r_d, r_rest) AS rho FROM ({ranks('t', ['variant', 'subject'], ['d', 'rest'])}) GROUP BY 1, 2),
m AS (SELECT variant, avg(rho) AS mean, median(rho) AS median, min(rho) AS min, max(rho) AS max FROM loo GROUP BY 1)
SELECT variant, {r('mean')} AS mean, {r('median')} AS median, {r('min')} AS min, {r('max')} AS max, CAST(row_number() OVER (ORDER BY mean DESC, variant) AS INTEGER) AS place FROM m""")
def reliability_ranking(spark, sf):
    got = None
    for variant in ("correlation", "cosine", "euclidean"):
        one = left_out(subject_pairs(spark, sf, variant)).withColumn("variant", F.lit(variant))
        got = one if got is None else got.unionByName(one)
    means = rel.summary(got, "variant", "rho")
    place = F.row_number().over(Window.orderBy(F.desc("mean"), "variant"))  # a row a variant
    return rounded(means.withColumn("place", place).drop("n"), "mean", "median", "min", "max")


@query("""WITH o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS item FROM embeddings)
SELECT item, count(DISTINCT vec_id % 3) AS n_kind FROM o GROUP BY 1 HAVING count(DISTINCT vec_id % 3) > 1""")
def identity_mismatch(spark, sf):
    items = read(spark, sf, "embeddings").select((F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("item"), (F.col("vec_id") % 3).alias("kind"))
    return rel.mismatches(items, "item", "kind")


# ---------------------------------------------------------------- events and segments

PAIR = """r AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, lag(event_type) OVER w AS before, lag(epoch_us(ts) / 1e6) OVER w AS before_t, lag(event_id) OVER w AS before_id, lead(event_type) OVER w AS after
  FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def stream(spark, sf) -> DataFrame:
    return read(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(f"WITH {PAIR} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS segment, before_id AS start_order, event_id AS end_order, {r('t - before_t')} AS duration FROM r WHERE event_type = 'purchase' AND before = 'signup'")
def event_pairing(spark, sf):
    got = ev.segments(stream(spark, sf), "user_id", "event_id", "event_type", "signup", "purchase", "t")
    return rounded(got.withColumn("duration", F.col("end_time") - F.col("start_time")).drop("start_time", "end_time"), "duration")


@query(f"""WITH {PAIR} SELECT user_id, event_id, 'start_before_previous_end' AS problem FROM r WHERE event_type = 'signup' AND before = 'signup'
UNION ALL SELECT user_id, event_id, 'end_without_start' FROM r WHERE event_type = 'purchase' AND coalesce(before, '') <> 'signup'
UNION ALL SELECT user_id, event_id, 'unclosed_start' FROM r WHERE event_type = 'signup' AND after IS NULL""")
def event_malformed(spark, sf):
    return ev.malformed(stream(spark, sf), "user_id", "event_id", "event_type", "signup", "purchase", "t")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS chapter FROM events")
def chapter_carry_forward(spark, sf):
    mark = F.when(F.col("event_type") == "error", F.col("value"))
    return ev.with_context(read(spark, sf, "events"), "user_id", "event_id", mark, "chapter").select("event_id", "user_id", "chapter")


@query("SELECT event_id, user_id FROM events e WHERE event_id >= (SELECT min(event_id) FROM events a WHERE a.user_id = e.user_id AND trim(a.event_type) = 'signup')")
def start_anchor(spark, sf):
    return ev.after_anchor(read(spark, sf, "events"), "user_id", "event_id", F.trim("event_type") == "signup").select("event_id", "user_id")


def signal(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(user's events as a signal of one sample an event and two channels, segments by sample)."""
    rows = read(spark, sf, "events").withColumn("sample", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    spans = ev.segments(rows, "user_id", "sample", "event_type", "signup", "purchase", "sample").select("user_id", "segment", F.col("start_order").alias("start"), F.col("end_order").alias("stop"))
    return rows.select("user_id", "sample", (F.col("event_id") % 2).alias("channel"), "value"), spans


SIGNAL = """o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sample FROM events),
sig AS (SELECT user_id, sample, event_id % 2 AS channel, value FROM o),
p AS (SELECT user_id, sample, event_type, lag(event_type) OVER w AS before, lag(sample) OVER w AS start FROM o WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY sample)),
spans AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sample) - 1 AS segment, start, sample AS stop FROM p WHERE event_type = 'purchase' AND before = 'signup')"""


@query(f"WITH {SIGNAL} SELECT s.user_id, segment, channel, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS sd FROM spans s JOIN sig g ON s.user_id = g.user_id AND sample >= start AND sample < stop GROUP BY 1, 2, 3")
def segment_mean_std(spark, sf):
    return rounded(sg.mean_std(*signal(spark, sf), "user_id"), "mean", "sd")


@query(f"""WITH {SIGNAL}, k AS (SELECT *, unnest(range(0, 4)) AS bin, stop - start AS n FROM spans),
b AS (SELECT *, CAST(round_even(bin * n / 4.0, 0) AS BIGINT) AS lo, CAST(round_even((bin + 1) * n / 4.0, 0) AS BIGINT) AS h FROM k),
w AS (SELECT *, CASE WHEN h <= lo THEN greatest(h, least(n, lo + 1)) ELSE h END AS hi FROM b)
SELECT w.user_id, segment, CAST(bin AS INTEGER) AS bin, channel, {r('avg(value)')} AS mean FROM w JOIN sig g ON w.user_id = g.user_id AND sample >= start + lo AND sample < start + hi GROUP BY 1, 2, 3, 4""")
def segment_relative_bins(spark, sf):
    return rounded(sg.relative_bins(*signal(spark, sf), "user_id", 4), "mean")


@query(f"WITH {SIGNAL} SELECT s.user_id, segment, channel, max(stop - start) >= 3 AS available, CASE WHEN max(stop - start) >= 3 THEN {r('avg(value)')} END AS mean FROM spans s JOIN sig g ON s.user_id = g.user_id AND sample >= start AND sample < least(stop, start + 3) GROUP BY 1, 2, 3")
def segment_onset_mean(spark, sf):
    got = sg.onset_mean(*signal(spark, sf), "user_id", 3)
    return rounded(got.withColumn("mean", F.when(F.col("available"), F.col("mean"))), "mean")


@query(f"""WITH {SIGNAL}, t AS (SELECT user_id, count(*) - 1 AS samples FROM events GROUP BY 1),
k AS (SELECT s.user_id, segment, start, least(stop + 1, samples) AS stop, stop + 1 > samples AS clipped FROM spans s JOIN t USING (user_id)),
g AS (SELECT k.*, channel, sample - start AS o, value, stop - start AS n FROM k JOIN sig USING (user_id) WHERE sample >= start AND sample < stop),
b AS (SELECT *, unnest(range(0, 2)) AS bin FROM g),
w AS (SELECT *, CAST(round_even(bin * n / 2.0, 0) AS BIGINT) AS lo, CAST(round_even((bin + 1) * n / 2.0, 0) AS BIGINT) AS h FROM b),
m AS (SELECT user_id, segment, channel, avg(value) FILTER (bin = 0 AND o >= lo AND o < CASE WHEN h <= lo THEN greatest(h, least(n, lo + 1)) ELSE h END) AS bin0, avg(value) FILTER (bin = 1 AND o >= lo AND o < CASE WHEN h <= lo THEN greatest(h, least(n, lo + 1)) ELSE h END) AS bin1 FROM w GROUP BY 1, 2, 3)
SELECT user_id, segment, channel, bool_or(clipped) AS clipped, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS sd, CASE WHEN max(n) >= 3 THEN {r('avg(value) FILTER (o < 3)')} END AS onset_mean, {r('any_value(bin0)')} AS bin0, {r('any_value(bin1)')} AS bin1
FROM g JOIN m USING (user_id, segment, channel) GROUP BY 1, 2, 3""")
def segment_scan(spark, sf):
    """All features of a segment by one pass; recordings end a sample early, so that some segments are clipped."""
    rows, spans = signal(spark, sf)
    samples = rows.groupBy("user_id").agg((F.max("sample")).alias("samples"))
    spans = sg.sampled(spans.join(samples, "user_id").withColumns({"start_sec": F.col("start") / 256.0, "end_sec": (F.col("stop") + 1) / 256.0}), 256.0, "samples")
    got = sg.scan(rows, spans.select("user_id", "segment", "start", "stop", "clipped"), "user_id", 2, 3)
    got = got.select("user_id", "segment", "channel", "clipped", "n", "mean", "sd", F.nanvl("onset_mean", F.lit(None).cast("double")).alias("onset_mean"), F.col("bin_means")[0].alias("bin0"), F.col("bin_means")[1].alias("bin1"))
    return rounded(got, "mean", "sd", "onset_mean", "bin0", "bin1")


@query(f"""WITH {SIGNAL}, c AS (SELECT (SELECT count(*) FROM events WHERE event_type = 'signup') AS starts, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS ends, (SELECT count(*) FROM spans) AS segments)
SELECT 'starts_equal_ends' AS "check", CAST(starts = ends AS VARCHAR) AS value FROM c UNION ALL SELECT 'segments', CAST(segments AS VARCHAR) FROM c UNION ALL SELECT 'positive_durations', (SELECT CAST(bool_and(stop > start) AS VARCHAR) FROM spans)""")
def checks_long(spark, sf):
    rows, (_, spans) = read(spark, sf, "events"), signal(spark, sf)
    row = rows.agg((F.count_if(F.col("event_type") == "signup") == F.count_if(F.col("event_type") == "purchase")).alias("starts_equal_ends"))
    row = row.join(F.broadcast(spans.agg(F.count("*").alias("segments"), F.bool_and(F.col("stop") > F.col("start")).alias("positive_durations"))))
    return pf.checks(row, "starts_equal_ends", "segments", "positive_durations")


@query(f"""WITH {PAIR}, s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, before_t AS start_time, t AS end_time FROM r WHERE event_type = 'purchase' AND before = 'signup'),
v AS (SELECT label AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, true AS has_vector FROM embeddings),
t AS (SELECT conv_id AS run, turn AS idx, text, role <> 'user' AS is_chapter FROM conversations)
SELECT run, idx, round(idx / greatest(1, count(*) OVER (PARTITION BY run) - 1), 6) + 0.0 AS run_position_fraction, length(text) AS char_count, NOT is_chapter AS semantic_eligible, {r('end_time - start_time')} AS duration,
  text IS NOT NULL AND start_time IS NOT NULL AND has_vector IS NOT NULL AS complete FROM t FULL JOIN s USING (run, idx) FULL JOIN v USING (run, idx)""")
def manifest_align(spark, sf):
    text = read(spark, sf, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("idx"), "text", (F.col("role") != "user").alias("is_chapter"))
    spans = ev.segments(stream(spark, sf), "user_id", "event_id", "event_type", "signup", "purchase", "t").select(F.col("user_id").alias("run"), F.col("segment").alias("idx"), "start_time", "end_time")
    vectors = read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("run"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("idx"), F.lit(True).alias("has_vector"))
    got = ev.manifest(text, spans, vectors, "run", "idx").withColumn("char_count", F.col("char_count").cast("long"))
    return rounded(got.select("run", "idx", "run_position_fraction", "char_count", "semantic_eligible", "duration", "complete"), "run_position_fraction", "duration")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 2 THEN p_size WHEN 3 THEN NULL ELSE NULL END AS chapter FROM part""")
def numeric_chapter_flag(spark, sf):
    k = F.col("p_partkey") % 4
    kind = F.element_at(F.array(*map(F.lit, ("int", "bool", "str", "str"))), (k + 1).cast("int"))
    size = F.col("p_size").cast("string")
    value = F.when(k == 1, F.lit("true")).when(k == 2, F.concat(F.lit(" "), size, F.lit(" "))).when(k == 3, F.concat(F.lit("a"), size)).otherwise(size)
    return read(spark, sf, "part").select("p_partkey", ev.numeric_chapter(value, kind).cast("int").alias("chapter"))


@query("SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def eligibility_filter(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    return ev.eligible(rows, F.col("quality") == 1).select("doc_id", "n_chars")


# ---------------------------------------------------------------- profiles and artifacts


@query("""WITH c AS (SELECT event_type AS value, count(*) AS n, min(event_id) AS first FROM events WHERE event_type NOT IN ('', 'n/a', 'NA', 'NaN', 'nan') GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, first LIMIT 3)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n_nonmissing, (SELECT count(*) FROM c) AS n_unique, (SELECT string_agg(value || ':' || n, ',' ORDER BY n DESC, first) FROM t) AS top_values""")
def profile_topk(spark, sf):
    got = pf.profile(read(spark, sf, "events"), "event_type", "event_id", 3)
    return got.withColumn("top_values", F.array_join(F.transform("top_values", lambda x: F.concat(x["value"], F.lit(":"), x["n"])), ","))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def freq_tables(spark, sf):
    return pf.frequencies(read(spark, sf, "documents"), "lang", "source")


@query("""SELECT coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.][^/]*?(\\.[^./]+)$', 1)), ''), '<none>') AS extension, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1""")
def inventory_by_suffix(spark, sf):
    rows = read(spark, sf, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return pf.inventory(rows, "path", "size")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_artifact(spark, sf):
    return pf.latest(read(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_with_fallback(spark, sf):
    scoped = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return pf.latest(read(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", scoped).select("o_custkey", "o_orderkey")


@query("""SELECT source, count(*) AS expected, count(quality) AS present, CASE WHEN count(quality) = count(*) THEN 'complete' WHEN count(quality) > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def availability_gate(spark, sf):
    docs = read(spark, sf, "documents").select("source", "doc_id")
    return pf.availability(docs, docs.join(read(spark, sf, "labels").where("quality is not null"), "doc_id", "left_semi"), "source", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_files(spark, sf):
    return pf.missing(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id")


# ---------------------------------------------------------------- permutations


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
s AS (SELECT *, (k - CASE WHEN m > 1 THEN 1 + (3 * 7919 + conv_id * 104729) % (m - 1) ELSE 0 END) AS d FROM c)
SELECT s.conv_id, s.turn, o.turn AS source FROM s JOIN c o ON s.conv_id = o.conv_id AND o.k = ((s.d % s.m) + s.m) % s.m""")
def shift_within_group(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn")
    shift = pm.arithmetic_shift(F.lit(3), F.col("conv_id"), F.col("__n"))
    return pm.shifted(rows, ["conv_id"], "turn", shift)


@query("""WITH c AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS m FROM embeddings)
SELECT c.label, c.vec_id, o.vec_id AS source FROM c JOIN c o ON c.label = o.label AND o.k = (((c.k - (5 * 7919 + c.label * 104729) % c.m) % c.m) + c.m) % c.m""")
def shift_whole_run(spark, sf):
    rows = read(spark, sf, "embeddings").select("label", "vec_id")
    return pm.shifted(rows, ["label"], "vec_id", pm.arithmetic_shift(F.lit(5), F.col("label"), F.col("__n"), identity=True))


PERMUTATIONS = 10


def shifts(sizes: DataFrame, group: str, permutations: int, identity: bool = False) -> DataFrame:
    """(group, shifts: one a permutation) of (group, m)."""
    perms = F.sequence(F.lit(0).cast("long"), F.lit(permutations - 1).cast("long"))
    return sizes.select(group, F.transform(perms, lambda p: pm.arithmetic_shift(p, F.col(group), F.col("m"), identity)).alias("shifts"))


def nulls(spark, sf) -> tuple[DataFrame, DataFrame]:
    """((label, perm, stat), (label, rho) without a shift)."""
    pairs = geometry(spark, sf)
    if isinstance(pairs, st.Pairs):
        sizes = read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("m"))
        return st.shifted_statistics(pairs, shifts(sizes, "label", PERMUTATIONS), "x", "y", NUISANCES)
    g = rk.residualized(pairs, "label", ["x", "y"], NUISANCES)
    items = read(spark, sf, "embeddings").select("label", "vec_id").join(read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("m")), "label")
    items = rk.numbered(items, "label", "item", "vec_id").withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PERMUTATIONS - 1).cast("long"))))
    # places are the items themselves, so a shift is arithmetic
    plan = items.withColumn("source", F.pmod(F.col("item") - pm.arithmetic_shift(F.col("perm"), F.col("label"), F.col("m")), F.col("m")))
    return pm.null_statistics(g, plan, "label", "e_x", "z_y", [f"z_{n}" for n in NUISANCES]), rk.partial_spearman(pairs, "label", "x", "y", NUISANCES)


NULLS = f"""{GEOMETRY}, perms AS (SELECT unnest(range(0, {PERMUTATIONS})) AS perm), sizes AS (SELECT label, count(*) AS m FROM embeddings GROUP BY 1),
maps AS (SELECT e.label, perm, place, (((place - (1 + (perm * 7919 + e.label * 104729) % (m - 1))) % m) + m) % m AS source FROM e JOIN sizes USING (label), perms),
moved AS (SELECT g.label, a.perm, g.i, g.j, g.x, h.y, g.position, g.size, g.kind FROM g JOIN maps a ON a.label = g.label AND a.place = g.i JOIN maps b ON b.label = g.label AND b.perm = a.perm AND b.place = g.j
  JOIN g h ON h.label = g.label AND h.i = least(a.source, b.source) AND h.j = greatest(a.source, b.source)),
{projected('moved', ['label', 'perm'], ['x', 'y'], NUISANCES)}, stats AS (SELECT label, perm, corr(v_x, v_y) AS stat FROM p_last GROUP BY 1, 2)"""


@query(f"WITH {NULLS} SELECT label, perm, {r('stat')} AS stat FROM stats")
def perm_null_partial(spark, sf):
    return rounded(nulls(spark, sf)[0], "stat")


OBSERVED = projected("g", ["label"], ["x", "y"], NUISANCES).replace("p_", "o_")


@query(f"""WITH {NULLS}, {OBSERVED}, obs AS (SELECT label, corr(v_x, v_y) AS observed FROM o_last GROUP BY 1)
SELECT label, {r('observed')} AS observed, count(*) AS n, {r('avg(stat)')} AS null_mean, {r('stddev_pop(stat)')} AS null_sd, {r('quantile_cont(stat, 0.95)')} AS q95, {r('quantile_cont(stat, 0.99)')} AS q99,
  {r('(1 + count(*) FILTER (stat >= observed)) / (count(*) + 1)')} AS p, {r('avg(CAST(CAST(stat < observed AS INTEGER) AS DOUBLE))')} AS percentile FROM stats JOIN obs USING (label) GROUP BY label, observed""")
def perm_pvalue(spark, sf):
    stats, observed = nulls(spark, sf)
    got = pm.null_summary(stats, observed.withColumnRenamed("rho", "observed"), "label")
    return rounded(got, "observed", "null_mean", "null_sd", "q95", "q99", "p", "percentile")


def loo_null(source: str, value: str, start: str) -> str:
    """The mean leave-one-out agreement of subjects whose items are shifted, for five permutations."""
    return f"""WITH {start}, perms AS (SELECT unnest(range(0, 5)) AS perm), m AS (SELECT max(j) + 1 AS m FROM {source}),
maps AS (SELECT DISTINCT label AS subject, perm, item, (((item - (perm * 7919 + label * 104729) % m) % m) + m) % m AS source FROM c, perms, m),
q AS (SELECT d.subject, a.perm, d.i, d.j, h.{value} AS d FROM {source} d JOIN maps a ON a.subject = d.subject AND a.item = d.i JOIN maps b ON b.subject = d.subject AND b.perm = a.perm AND b.item = d.j
  JOIN {source} h ON h.subject = d.subject AND h.i = least(a.source, b.source) AND h.j = greatest(a.source, b.source)),
t AS (SELECT *, (sum(d) OVER (PARTITION BY perm, i, j) - d) / (count(*) OVER (PARTITION BY perm, i, j) - 1) AS rest FROM q),
loo AS (SELECT perm, subject, corr(r_d, r_rest) AS rho FROM ({ranks('t', ['perm', 'subject'], ['d', 'rest'])}) GROUP BY 1, 2)
SELECT perm, {r('avg(rho)')} AS stat FROM loo GROUP BY 1"""


def rotated_null(pairs: DataFrame | st.Pairs, value: str) -> DataFrame:
    """pairs (subject, i, j, value) of subjects with the same items: by lag, so that shifts rotate arrays."""
    if isinstance(pairs, st.Pairs):
        sizes = pairs.rows.groupBy(F.col("__group").alias("subject"), "__strip").agg(F.count("*").alias("m")).where("__strip = 0")
        loo = st.leave_one_out(pairs, value, shifts(sizes, "subject", 5, identity=True))
        return rounded(loo.groupBy("perm").agg(F.avg("rho").alias("stat")), "stat")
    items = pairs.groupBy("subject").agg((F.max("j") + 1).alias("n"))
    plan = items.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("perm", "subject", pm.arithmetic_shift(F.col("perm"), F.col("subject"), F.col("n"), identity=True).alias("shift"))
    loo = pm.rotated_leave_one_out(pm.by_lag(pairs, items, "subject", value), plan, "subject")
    return rounded(loo.groupBy("perm").agg(F.avg("rho").alias("stat")), "stat")


@query(loo_null("d", "d", SUBJECTS))
def perm_null_loo(spark, sf):
    return rotated_null(subject_pairs(spark, sf), "d")


RESIDUAL_NUISANCES = ["position", "size", "kind"]


def nuisance_pairs(spark, sf) -> DataFrame | st.Pairs:
    """(subject, i, j, d, nuisances): subjects' distances."""
    items, v = rel.common_items(read(spark, sf, "embeddings"), "label", "vec_id").withColumnRenamed("label", "subject"), F.col("embedding")
    return pair_table(items, "subject", "item", {"d": ("correlation", v), "position": ("cityblock", F.col("item")), "size": ("cityblock", F.round(f.norm(f.doubles(F.slice(v, 1, 32))), 6)), "kind": ("hamming", F.col("vec_id") % 3)})


def residual_pairs(pairs: DataFrame | st.Pairs) -> DataFrame | st.Pairs:
    """(subject, i, j, d, e) of nuisance_pairs(): also what nuisances leave of distances, to nine places so that ties are ties."""
    if isinstance(pairs, st.Pairs):
        st.residual(pairs, "e", "d", RESIDUAL_NUISANCES, 9)
        return pairs
    rest = rk.residualized(pairs, "subject", ["d"], RESIDUAL_NUISANCES)
    return rest.select("subject", "i", "j", "d", F.round("e_d", 9).alias("e"))


RESIDUALS = f"""{SUBJECTS}, k0 AS (SELECT *, round(sqrt(list_inner_product(v[1:32], v[1:32])), 6) AS size FROM c),
g AS (SELECT d.*, CAST(abs(d.i - d.j) AS DOUBLE) AS position, abs(a.size - b.size) AS size, CAST(CAST(a.vec_id % 3 <> b.vec_id % 3 AS INTEGER) AS DOUBLE) AS kind FROM d JOIN k0 a ON a.label = d.subject AND a.item = d.i JOIN k0 b ON b.label = d.subject AND b.item = d.j),
{projected('g', ['subject'], ['d'], RESIDUAL_NUISANCES, ['i', 'j'])},
res AS (SELECT subject, i, j, round(v_d / stddev_pop(v_d) OVER (PARTITION BY subject), 9) AS e FROM p_last)"""


@query(f"""WITH {RESIDUALS}, t AS (SELECT *, (sum(e) OVER (PARTITION BY i, j) - e) / (count(*) OVER (PARTITION BY i, j) - 1) AS rest FROM res)
SELECT subject, {r('corr(r_e, r_rest)')} AS rho FROM ({ranks('t', ['subject'], ['e', 'rest'])}) GROUP BY 1""")
def residual_loo(spark, sf):
    """Each subject's residual geometry against the mean of the others'."""
    return rounded(left_out(residual_pairs(nuisance_pairs(spark, sf)), "e"), "rho")


@query(loo_null("res", "e", RESIDUALS))
def perm_null_residual_loo(spark, sf):
    return rotated_null(residual_pairs(nuisance_pairs(spark, sf)), "e")


@query(f"""WITH {RESIDUALS}, sides AS (SELECT 'raw' AS kind, subject, i, j, d AS x FROM d UNION ALL SELECT 'residual', subject, i, j, e FROM res),
k AS ({ranks('sides', ['kind', 'subject'], ['x'])}),
m AS (SELECT a.kind, a.subject AS sa, b.subject AS sb, corr(a.r_x, b.r_x) AS rho FROM k a JOIN k b ON a.kind = b.kind AND a.i = b.i AND a.j = b.j AND a.subject < b.subject GROUP BY 1, 2, 3)
SELECT kind, count(*) AS n, {r('avg(rho)')} AS mean FROM m GROUP BY 1""")
def pairwise_means(spark, sf):
    """The mean agreement of pairs of subjects, of raw and of residual geometries side by side."""
    pairs, out = nuisance_pairs(spark, sf), None
    if isinstance(pairs, st.Pairs) and (both := st.agreement_of_residuals(pairs, "d", RESIDUAL_NUISANCES)) is not None:
        return rounded(both.groupBy("kind").agg(F.count("*").alias("n"), F.avg("rho").alias("mean")), "mean").select("n", "mean", "kind")
    pairs = residual_pairs(pairs)
    for kind, value in (("raw", "d"), ("residual", "e")):
        one = agreement(pairs, value).agg(F.count("*").alias("n"), F.avg("rho").alias("mean")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean")


# ---------------------------------------------------------------- runs and subjects

EFFECTS = "f AS (SELECT year(l_shipdate) AS run, l_suppkey % 8 AS subject, avg(l_discount) - 0.05 AS effect FROM lineitem GROUP BY 1, 2)"


def effects(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.year("l_shipdate").cast("long").alias("run"), (F.col("l_suppkey") % 8).alias("subject"), "l_discount")
    return rows.groupBy("run", "subject").agg((F.avg("l_discount") - 0.05).alias("effect"))


@query(f"""WITH {EFFECTS}, v AS (SELECT run, list(effect) AS v, count(*) AS n, avg(effect) AS mean FROM f GROUP BY 1), s AS (SELECT *, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS signs FROM v),
t AS (SELECT run, n, mean, list_sum(list_transform(v, lambda x, i: CASE WHEN (signs >> CAST(i - 1 AS BIGINT)) % 2 = 1 THEN -x ELSE x END)) / n AS flipped FROM s)
SELECT run, n, {r('mean')} AS mean, {r('avg(CAST(CAST(flipped >= mean - 1e-15 AS INTEGER) AS DOUBLE))')} AS p FROM t GROUP BY run, n, mean""")
def signflip_exact(spark, sf):
    return rounded(inf.signflip(effects(spark, sf), "run", "effect"), "mean", "p")


@query(f"WITH {EFFECTS} SELECT run, count(*) AS n, {r('avg(effect)')} AS mean, {r('median(effect)')} AS median, count(*) FILTER (effect > 0) AS positive FROM f GROUP BY 1")
def crossrun_aggregate(spark, sf):
    return rounded(inf.run_summary(effects(spark, sf)), "mean", "median")


@query(f"WITH {EFFECTS}, m AS (SELECT run, avg(effect) AS mean FROM f GROUP BY 1) SELECT run, {r('(sum(mean) OVER () - mean) / nullif(count(*) OVER () - 1, 0)')} AS others FROM m")
def leave_one_run_out(spark, sf):
    means = inf.run_summary(effects(spark, sf)).withColumn("all", F.lit(1))  # a row a run
    return rounded(inf.leave_one_out(means, ["all"], "mean").select("run", "others"), "others")


@query(f"""WITH {EFFECTS}, t AS (SELECT run, sum(effect) AS total, count(*) AS n FROM f GROUP BY 1), s AS (SELECT DISTINCT subject FROM f),
w AS (SELECT s.subject, t.run, CASE WHEN f.effect IS NULL THEN total / n ELSE (total - f.effect) / (n - 1) END AS mean, total / n AS base, f.effect IS NOT NULL AS present FROM s CROSS JOIN t LEFT JOIN f ON f.run = t.run AND f.subject = s.subject)
SELECT subject, count(*) FILTER (present) AS runs_present, {r('avg(mean)')} AS mean_without, {r('avg(mean) - avg(base)')} AS delta FROM w GROUP BY 1""")
def subject_influence(spark, sf):
    return rounded(inf.influence(effects(spark, sf)), "mean_without", "delta")


@query(f"WITH {EFFECTS} SELECT subject, count(DISTINCT run) AS runs, {r('avg(effect)')} AS mean FROM f GROUP BY 1 HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM f)")
def common_subjects(spark, sf):
    return rounded(inf.common_subjects(effects(spark, sf)), "mean")


@query(f"""WITH v AS (SELECT CAST(floor(l_orderkey / 4) AS BIGINT) % 7 AS run, row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 4) AS BIGINT) % 7 ORDER BY l_orderkey, l_linenumber, l_discount) - 1 AS perm, l_discount - 0.05 AS stat FROM lineitem),
n AS (SELECT run, count(*) AS n FROM v GROUP BY 1), p AS (SELECT draw, run, (draw * 7919 + run * 104729) % n AS perm FROM n, (SELECT unnest(range(0, 10000)) AS draw))
SELECT draw, {r('avg(stat)')} AS mean FROM p JOIN v USING (run, perm) GROUP BY 1""")
def crossrun_mc_null(spark, sf):
    run = (F.floor(F.col("l_orderkey") / 4) % 7).alias("run")
    rows = read(spark, sf, "lineitem").select(run, "l_orderkey", "l_linenumber", (F.col("l_discount") - 0.05).alias("stat"))
    rows = rk.numbered(rows, "run", "perm", "l_orderkey", "l_linenumber", "stat").select("run", "perm", "stat")
    return rounded(inf.crossrun_null(rows, 10000, (F.col("draw") * 7919 + F.col("run") * 104729) % F.col("n")), "mean")


# ---------------------------------------------------------------- pooling


def states(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return rows.select("label", (F.col("place") % 6).alias("layer"), F.floor(F.col("place") / 6).alias("token"), "place", "embedding", (F.col("vec_id") % 5 != 0).alias("attended"))


STATES = """o AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings),
s AS (SELECT label, place % 6 AS layer, place // 6 AS token, place, v, vec_id % 5 <> 0 AS attended, unnest(range(1, 65)) AS k FROM o), x AS (SELECT * EXCLUDE (v), v[k] AS x FROM s)"""


def exploded(df: DataFrame) -> DataFrame:
    return rounded(df.select("label", F.posexplode("vector").alias("dim", "x")), "x")


@query(f"WITH {STATES} SELECT label, CAST(k - 1 AS INTEGER) AS dim, {r('sum(CASE WHEN attended THEN x ELSE 0 END) / greatest(count(*) FILTER (attended), 1)')} AS x FROM x GROUP BY 1, 2")
def pool_masked_mean(spark, sf):
    return exploded(po.masked_mean(states(spark, sf), "label", "embedding", F.col("attended")))


@query(f"WITH {STATES} SELECT label, CAST(k - 1 AS INTEGER) AS dim, {r('x')} AS x FROM x WHERE place = 0")
def pool_cls(spark, sf):
    return exploded(po.first_token(states(spark, sf), "label", "place", "embedding"))


@query(f"WITH {STATES} SELECT label, CAST(k - 1 AS INTEGER) AS dim, {r('max_by(x, place)')} AS x FROM x WHERE attended GROUP BY 1, 2")
def pool_last_token(spark, sf):
    return exploded(po.last_token(states(spark, sf), "label", "place", "embedding", F.col("attended")))


@query(f"""WITH {STATES}, l AS (SELECT label, token, k, avg(x) AS x FROM x WHERE layer > (SELECT max(layer) - 4 FROM x) GROUP BY 1, 2, 3)
SELECT label, CAST(k - 1 AS INTEGER) AS dim, {r('sum(CASE WHEN token % 3 <> 0 THEN x ELSE 0 END) / greatest(count(*) FILTER (token % 3 <> 0), 1)')} AS x FROM l GROUP BY 1, 2""")
def pool_last4(spark, sf):
    return exploded(po.last_layers(states(spark, sf), "label", "layer", "token", "embedding", F.col("token") % 3 != 0))


@query(f"WITH {EMB}, k AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n, unnest(range(1, 65)) AS k FROM e) SELECT vec_id, CAST(k - 1 AS INTEGER) AS dim, {r('v[k] / greatest(n, 1e-12)')} AS x FROM k")
def l2_normalize(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.posexplode(f.l2_normalized(f.doubles(F.col("embedding")))).alias("dim", "x"))
    return rounded(rows, "x")


@query("SELECT min(n) AS min_tokens, max(n) AS max_tokens, count(*) FILTER (n > 64) AS truncated FROM (SELECT CAST(len(string_split(text, ' ')) AS BIGINT) + 2 AS n FROM documents)")
def truncation_count(spark, sf):
    return po.truncated(read(spark, sf, "documents"), F.size(F.split("text", " ")).cast("long"), 2, 64)


# ---------------------------------------------------------------- reports and gates


@query("""SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(DISTINCT source) AS subjects, count_if(lang = 'en') AS signal_files,
  CAST(coalesce(sum(n_chars) FILTER (lang = 'en'), 0) AS BIGINT) AS signal_bytes, round(sum(n_chars) / 1073741824.0, 3) AS gib FROM documents""")
def inventory_totals(spark, sf):
    return pf.totals(read(spark, sf, "documents"), "n_chars", "source", F.coalesce(F.col("lang") == "en", F.lit(False)))


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events)
SELECT event_type, min(value) FILTER (NOT isnan(value)) AS min_value, max(value) FILTER (NOT isnan(value)) AS max_value FROM v GROUP BY 1""")
def nan_ranges(spark, sf):
    rows = read(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return pf.ranges(rows, "event_type", "value")


@query(f"""WITH s AS (SELECT l_returnflag, l_linenumber, CASE WHEN l_linenumber = 3 THEN 1.0 WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END AS x FROM lineitem),
c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, count(x) AS good, stddev_pop(x) AS sd FROM s GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS n_channels, {r('sum(good) / sum(n)')} AS finite_share, count_if(sd = 0) AS n_flat, {r('median(sd)')} AS median_sd FROM c GROUP BY 1""")
def signal_quality(spark, sf):
    x = F.when(F.col("l_linenumber") == 3, F.lit(1.0)).when(F.col("l_partkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return rounded(pf.signal_quality(read(spark, sf, "lineitem").withColumn("x", x), "l_returnflag", "l_linenumber", "x"), "finite_share", "median_sd")


@query("SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, array_to_string(list_sort(list(DISTINCT s_suppkey)), ',') AS ids FROM supplier GROUP BY 1")
def seen_ids(spark, sf):
    return pf.seen(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


MARKER = "CASE event_id % 5 WHEN 0 THEN 'CH' || (event_id % 13) WHEN 1 THEN 'CH' || lpad((event_id % 100)::VARCHAR, 2, '0') WHEN 2 THEN 'CHx' || event_id WHEN 3 THEN 'ch12' END"


@query(f"""WITH m AS (SELECT event_type, {MARKER} AS t FROM events)
SELECT event_type, count_if(coalesce(regexp_full_match(t, 'CH[0-9]+'), false)) AS n_any, count_if(coalesce(regexp_full_match(t, 'CH[0-9][0-9]+'), false)) AS n_long FROM m GROUP BY 1""")
def marker_patterns(spark, sf):
    e = F.col("event_id")
    two = F.lpad((e % 100).cast("string"), 2, "0")
    text = F.when(e % 5 == 0, F.concat(F.lit("CH"), e % 13)).when(e % 5 == 1, F.concat(F.lit("CH"), two)).when(e % 5 == 2, F.concat(F.lit("CHx"), e)).when(e % 5 == 3, F.lit("ch12"))
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_if(f.is_marker(text)).alias("n_any"), F.count_if(f.is_long_marker(text)).alias("n_long"))


@query(f"""WITH t AS (SELECT l_returnflag, CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS x, CAST(l_quantity AS VARCHAR) AS y FROM lineitem)
SELECT 'skip' AS policy, l_returnflag, count(TRY_CAST(x AS DOUBLE)) AS n, {r('sum(TRY_CAST(x AS DOUBLE))')} AS total FROM t GROUP BY 2
UNION ALL SELECT 'column', l_returnflag, 0, NULL FROM t GROUP BY 2
UNION ALL SELECT 'abort', l_returnflag, count(y), {r('sum(CAST(y AS DOUBLE))')} FROM t GROUP BY 2""")
def cast_policies(spark, sf):
    y = F.col("l_quantity").cast("string")
    rows = read(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_partkey") % 9 == 0, F.lit("n/a")).otherwise(y).alias("x"), y.alias("y"))
    out = None
    for policy, name in (("skip", "x"), ("column", "x"), ("abort", "y")):
        one = pf.parsed(rows, name, policy).groupBy("l_returnflag").agg(F.count(name).alias("n"), F.sum(name).alias("total")).select(F.lit(policy).alias("policy"), "l_returnflag", "n", "total")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "total")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'none' END AS found FROM orders""")
def fallback_keys(spark, sf):
    k = F.col("o_orderkey") % 3
    keys = F.when(k == 0, F.create_map(F.lit("mean_rho"), "o_orderpriority", F.lit("mean"), "o_orderstatus")).when(k == 1, F.create_map(F.lit("mean"), "o_orderstatus")).otherwise(F.create_map(F.lit("other"), "o_orderstatus"))
    return read(spark, sf, "orders").select("o_orderkey", f.first_of(keys, ["mean_rho", "mean"], F.lit("none")).alias("found"))


@query("SELECT event_id, greatest(0, least(1000, CAST(round_even(value * 4.5, 0) AS BIGINT))) AS sample FROM events")
def sample_indices(spark, sf):
    """Seconds as sample numbers, half to even, within the recording."""
    return read(spark, sf, "events").select("event_id", f.sample_index(F.col("value"), 4.5, 1000).alias("sample"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 1 THEN 'CH' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN p_partkey % 7 = 1 THEN '' END AS marker FROM part)
SELECT p_partkey, coalesce(marker, '<none>') AS marker, CASE WHEN coalesce(marker, '') = '' THEN 0 ELSE CAST(substr(marker, 3) AS INTEGER) END AS chapter FROM m""")
def chapter_markers(spark, sf):
    """Markers made of numbers and read again; none and an empty one are chapter 0."""
    k = F.col("p_partkey") % 7
    marker = F.when(k > 1, f.chapter_marker(F.col("p_size"))).when(k == 1, F.lit(""))
    return read(spark, sf, "part").select("p_partkey", F.coalesce(marker, F.lit("<none>")).alias("marker"), f.chapter_number(marker).alias("chapter"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || ' ' WHEN 1 THEN translate(CAST(o_custkey AS VARCHAR), '0123456789', '０１２３４５６７８９') WHEN 2 THEN o_custkey || '.0' END AS t FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN TRY_CAST(translate(trim(t), '０１２３４５６７８９', '0123456789') AS BIGINT) END AS number FROM t""")
def whole_numbers(spark, sf):
    """Digits of any script as numbers; other texts have none."""
    key, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), key, F.lit(" "))).when(k == 1, F.translate(key, "0123456789", "０１２３４５６７８９")).when(k == 2, F.concat(key, F.lit(".0")))
    return read(spark, sf, "orders").select("o_orderkey", f.whole_number(text).alias("number"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_id < 256 GROUP BY 1")
def head_seconds(spark, sf):
    return pf.head(read(spark, sf, "events"), "event_id", 128.0, 2.0).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
