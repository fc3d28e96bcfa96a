"""From features and vectors to a run's result, as one plan: distances, association without nuisances, its null, a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as f
from ..operators import checks
from ..operators import pairs as pr
from ..operators import permute as pm
from ..operators import ranks as rk
from ..operators import reliability as rel

NUISANCES = ["n_position", "n_duration", "n_char_count", "n_chapter", "n_orthographic", "n_punctuation"]


@dataclass
class Result:
    by_subject: DataFrame  # (target, subject, rho)
    null: DataFrame  # (target, perm, stat), the mean over subjects
    summary: DataFrame  # (target, observed, n, null_mean, null_sd, q95, q99, p, percentile)


def pair_table(features: DataFrame, vectors: DataFrame, targets: list[str]) -> DataFrame:
    """(subject, i, j, d_neural, d_<target>, nuisances) of features (subject, row, embedding_index, row_mean, text, chapter, duration, position)
    and vectors (row_index, one array a target). All distances come from one join, so none has to be matched to another."""
    rows = checks.all_found(features, vectors, "embedding_index", "row_index").join(vectors, F.col("embedding_index") == F.col("row_index"))
    z = pr.zscored_vectors(rows, "subject", "row", "row_mean").withColumnRenamed("row_mean", "z")
    rows = rows.join(z, ["subject", "row"])
    return pr.distances(
        rows, "subject", "row", d_neural=("correlation", F.col("z")), n_position=("cityblock", F.col("position")), n_duration=("cityblock", F.col("duration")), n_char_count=("cityblock", F.length("text")),
        n_chapter=("hamming", f.chapter_number(F.col("chapter"))), n_orthographic=("jaccard", F.col("text")), n_punctuation=("cityblock", f.punctuation_count(F.col("text"))), **{f"d_{t}": ("cosine", F.col(t)) for t in targets})


def semantic_association(features: DataFrame, vectors: DataFrame, targets: list[str], permutations: int, seed: int, nuisances: list[str] = NUISANCES) -> Result:
    """Partial Spearman of each subject's geometry with each target's, and its null from shifts within chapters.

    Every subject has the same rows, numbered from 0. A permutation's shifts depend on seed, permutation and chapter only, so all
    subjects and targets share them; a chapter of one row stays.
    """
    checks.parameters(permutations=permutations)
    checks.at_least(features, "subject", 2)
    pairs, out, nulls = pair_table(features, vectors, targets), None, None
    items = features.select("subject", "row", f.chapter_number(F.col("chapter")).alias("grp"))
    moves = items.withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(permutations - 1).cast("long"))))  # the plan itself: an item's source in each permutation
    moves = pm.shifted(moves, ["subject", "perm", "grp"], "row", pm.seeded_shift(seed, F.col("perm"), F.col("grp"), F.col("__n"))).withColumnRenamed("row", "item")
    for t in targets:
        both = rk.residualized(pairs, "subject", ["d_neural", f"d_{t}"], nuisances)
        rho = both.groupBy("subject").agg(F.avg(F.col("e_d_neural") * F.col(f"e_d_{t}")).alias("rho")).withColumn("target", F.lit(t))
        null = pm.null_statistics(both, moves, "subject", "e_d_neural", f"z_d_{t}", [f"z_{n}" for n in nuisances]).groupBy("perm").agg(F.avg("stat").alias("stat")).withColumn("target", F.lit(t))
        out, nulls = (rho, null) if out is None else (out.unionByName(rho), nulls.unionByName(null))
    observed = out.groupBy("target").agg(F.avg("rho").alias("observed"))
    return Result(out, nulls, pm.null_summary(nulls, observed, "target"))


def variants(features: DataFrame, components: tuple[int, ...] = (16, 32, 64)) -> DataFrame:
    """(variant, subject, i, j, d) of features (subject, row, row_mean, row_std, relative: bins of channels): the flattened bins, the
    mean over bins, row means, row deviations, and principal components of the flattened bins."""
    rows = features.withColumn("flat", F.flatten("relative"))
    out = None

    def add(name: str, df: DataFrame) -> None:
        nonlocal out
        df = df.withColumn("variant", F.lit(name))
        out = df if out is None else out.unionByName(df)

    for name, column in (("flat_correlation", "flat"), ("row_mean_correlation", "row_mean"), ("row_std_correlation", "row_std")):
        add(name, pr.distances(pr.zscored_vectors(rows, "subject", "row", column), "subject", "row", d=("correlation", F.col(column))))
    z = pr.zscored_vectors(rows, "subject", "row", "flat").join(rows.select("subject", "row", F.size("relative").alias("bins")), ["subject", "row"])
    size = (F.size("flat") / F.col("bins")).cast("int")
    z = z.withColumn("relative", F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda b: F.slice("flat", b * size + 1, size)))
    add("binwise_correlation_mean", pr.distances(z, "subject", "row", d=("binwise", F.col("relative"))))
    for k in components:
        add(f"pca{k}_euclidean", pr.principal_distances(rows, "subject", "row", "flat", k))
    return out


def ranked_variants(pairs: DataFrame) -> DataFrame:
    """(variant, place, mean, median, min, max, n) by leave-one-out agreement of subjects, best first."""
    keyed = pairs.withColumn("subject", F.struct("variant", "subject"))
    loo = rel.leave_one_out(keyed, "d", ("variant",)).select(F.col("subject.variant").alias("variant"), "rho")
    means = rel.summary(loo, "variant", "rho")
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "variant")))  # a row a variant
