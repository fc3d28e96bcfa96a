"""Where results go."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, sep: str = ",", bom: bool = False) -> None:
    """A header and one file; for reports. A folder that is there already is an error, as results are never written over.
    With bom, the file begins with a byte order mark, for spreadsheets."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True, sep=sep)


def matrix(pairs: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """A square table with 8 places, one column a name, from (row, column, value); the names bound it."""
    wide = pairs.groupBy(row).pivot(column, names).agg(F.first(value))
    return wide.select(row, *(F.format_string("%.8f", F.col(f"`{n}`").cast("double")).alias(n) for n in names)).orderBy(row)


def text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).coalesce(1).write.mode("errorifexists").text(path)


def stamped(df: DataFrame, root: str, stamp: str) -> None:
    """Parquet, arrays and all, in a folder of its own."""
    df.write.mode("errorifexists").parquet(f"{root}/stamp={stamp}")


def summary_json(row: DataFrame) -> str:
    """A one-row summary as indented JSON, other scripts' letters kept."""
    return json.dumps(json.loads(row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]), ensure_ascii=False, indent=2)


def texts_json(df: DataFrame, path: str, *columns: str) -> None:
    """The texts that vectors were made of, a JSON object a row."""
    df.select(*columns).write.mode("errorifexists").json(path)


def npy(df: DataFrame, path: str, row: str, values: str, parts: int = 8) -> DataFrame:
    """Writes the vectors of a column, in order of `row`, as part-00000.npy and so on below path; returns a plan of (part,
    first_row, rows) that writes where it is run. Parts are ranges of rows, each written by its task under a name of its own and then moved, so that a task that
    runs again leaves the same file. The path is a folder in any store that Arrow knows."""

    def write(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        part = got[0].column("part")[0].as_py()
        x = np.concatenate([np.stack(b.column("values").to_numpy(zero_copy_only=False)) for b in got])
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        store.create_dir(at)
        name, held = f"{at}/part-{part:05d}.npy", io.BytesIO()
        np.save(held, x)
        own = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(held.getvalue())
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([got[0].column("row")[0].as_py()], pa.int64()), pa.array([len(x)], pa.int64())], names=["part", "first_row", "rows"])

    rows = df.select(F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("values")).repartitionByRange(parts, "row").sortWithinPartitions("row")
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(write, "part int, first_row long, rows long")


def report(title: str, counts: DataFrame, checks: DataFrame, tables: dict[str, tuple[DataFrame, str]], rows: int = 10) -> str:
    """A report: the counts of one row as a list, checks (check, value) as a list, and the first rows of each table by its
    order. What comes to the driver is one row, the checks and `rows` rows a table."""
    numbers = counts.limit(1).collect()
    out = [f"# {title}", "", "## Counts", "", *(f"- {k}: {v}" for r in numbers for k, v in r.asDict().items()), "", "## Checks", ""]
    out += [f"- {r['check']}: {r['value']}" for r in checks.orderBy("check").limit(1000).collect()]
    return "\n".join(out) + "\n\n" + "\n".join(markdown(df, name, order, rows) for name, (df, order) in tables.items())


def markdown(df: DataFrame, title: str, order: str, rows: int = 10) -> str:
    """A report's table of the first rows."""
    got = df.orderBy(order).limit(rows).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"## {title}", "", *head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)]) + "\n"
