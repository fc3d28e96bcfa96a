"""Gates: what must hold before a result counts. Each raises ValueError with the numbers found; none drops rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as f

#: The run that stays sealed, and the least numbers of permutations and draws.
SEALED_RUNS = [7]
LEAST_PERMUTATIONS, LEAST_DRAWS = 100, 10_000


def finite(df: DataFrame, *names: str) -> DataFrame:
    """df, if the named columns (numbers or arrays of numbers) are finite throughout."""
    bad = []
    for n in names:
        array = df.schema[n].dataType.typeName() == "array"
        bad.append(F.count_if(F.coalesce(~F.forall(n, f.finite) if array else ~f.finite(F.col(n)), F.lit(True))).alias(n))
    found = {k: v for k, v in df.agg(*bad).first().asDict().items() if v}
    if found:
        raise ValueError(f"rows that aren't finite: {found}")
    return df


def all_found(rows: DataFrame, table: DataFrame, row_key: str, table_key: str) -> DataFrame:
    """rows, if each has its key in the table."""
    missing = rows.join(table, F.col(row_key) == F.col(table_key), "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows without a match by {row_key}")
    return rows


def open_runs(df: DataFrame, run: str = "run", sealed: list[int] = SEALED_RUNS) -> DataFrame:
    """df, if it has no sealed run: such a run is refused, not left out."""
    if df.where(F.col(run).isin(sealed)).limit(1).count():
        raise ValueError(f"runs {sealed} are sealed")
    return df


def at_least(df: DataFrame, key: str, least: int) -> DataFrame:
    """df, if the key has so many different values."""
    n = df.agg(F.count_distinct(key).alias("n")).first()["n"]
    if n < least:
        raise ValueError(f"{n} values of {key}, {least} are needed")
    return df


def parameters(runs=(), permutations=None, draws=None, bins=None) -> None:
    """Bounds on what a caller asks for."""
    twice = [r for r, n in Counter(runs).items() if n > 1]
    if twice:
        raise ValueError(f"runs given twice: {twice}")
    for name, value, least in (("permutations", permutations, LEAST_PERMUTATIONS), ("draws", draws, LEAST_DRAWS), ("bins", bins, 2)):
        if value is not None and value < least:
            raise ValueError(f"{name} is {value}, at least {least} are needed")


def nulls(df: DataFrame, keys: list[str], stat: str, least: int = 1000) -> DataFrame:
    """df, if each null distribution is long enough and finite."""
    short = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~f.finite(F.col(stat))).alias("bad")).where((F.col("n") < least) | (F.col("bad") > 0)).limit(1).collect()
    if short:
        raise ValueError(f"a null distribution is too short or not finite: {short[0].asDict()}")
    return df


def same_mean(summary: DataFrame, stored: str, recomputed: str, atol: float = 1e-10, rtol: float = 1e-8) -> DataFrame:
    """summary, if stored means are those of their parts."""
    off = summary.where(~F.coalesce(f.nearly(F.col(stored), F.col(recomputed), rtol, atol), F.lit(False))).count()
    if off:
        raise ValueError(f"{off} stored means differ from their parts")
    return summary
