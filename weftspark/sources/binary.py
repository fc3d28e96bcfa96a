"""Matrices, workbooks and recordings: files are read as bytes by Spark, and parsed in numpy inside tasks."""

from __future__ import annotations

import configparser
import hashlib
import io
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of files, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def opened(file: str):
    """A file in any store that Arrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(quote(file if ":/" in file else f"file://{file}", safe=":/"))
    return store.open_input_file(at)


def range_of(file: str, start: int, size: int) -> bytes:
    with opened(file) as f:
        f.seek(start)
        return f.read(size)


def streamed(paths: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(path, sha256) of files of any size, a block at a time; files are dealt over tasks."""

    def run(batches):
        for pdf in batches:
            for name in pdf["path"]:
                digest = hashlib.sha256()
                with opened(name) as f:
                    while data := f.read(block):
                        digest.update(data)
                yield pd.DataFrame({"path": [name], "sha256": [digest.hexdigest()]})

    return paths.repartition("path").mapInPandas(run, "path string, sha256 string")


def matrix_header(head: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, whether by columns, kind of number, first byte of the data) of a matrix file's first bytes."""
    at = io.BytesIO(head)
    version = np.lib.format.read_magic(at)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(at, max_header_size=len(head))
    if kind.hasobject or kind.names or not shape:
        raise ValueError("not a matrix of numbers")
    return shape, by_columns, kind, at.tell()


MATRIX = "path string, rows long, width long, by_columns boolean, kind string, data long, shape array<long>"


def npy(spark: SparkSession, path: str, pattern: str = "*.npy", start: int = 0, stop: int | None = None, block: int = 8 << 20) -> DataFrame:
    """(path, row_index, values: array<double>) of matrices, from row start up to stop; more than two dimensions are flattened row by row.

    Headers are read first; then ranges of rows, of about `block` bytes, are dealt over tasks, each of which reads its own bytes.
    So a file may have any size, and a slice costs what it holds.
    """

    def heads(batches):
        for pdf in batches:
            for name in pdf["path"]:
                shape, by_columns, kind, at = matrix_header(range_of(name, 0, 1 << 20))
                yield pd.DataFrame({"path": [name], "rows": shape[0], "width": int(np.prod(shape[1:], dtype=np.int64)), "by_columns": by_columns, "kind": kind.str, "data": at, "shape": [list(shape)]})

    files = listed(spark, path, pattern).select("path").repartition("path").mapInPandas(heads, MATRIX)
    size = F.greatest(F.lit(1), F.floor(F.lit(block) / F.greatest(F.lit(1), F.col("width") * F.substring("kind", 3, 9).cast("long")))).cast("long")
    end = F.col("rows") if stop is None else F.least("rows", F.lit(stop))
    ranges = files.withColumn("end", end.cast("long")).where(F.col("end") > start).withColumn("size", size)
    ranges = ranges.withColumn("first", F.explode(F.sequence(F.lit(start).cast("long"), F.col("end") - 1, F.col("size")))).repartition("path", "first")

    def parse(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                kind, n = np.dtype(row.kind), min(row.size, row.end - row.first)
                if row.by_columns:  # every column has its rows side by side
                    columns = np.arange(row.width).reshape(tuple(row.shape[1:]) or (1,), order="F").ravel()
                    x = np.stack([np.frombuffer(range_of(row.path, row.data + (k * row.rows + row.first) * kind.itemsize, n * kind.itemsize), kind) for k in columns.tolist()], 1) if row.width else np.zeros((n, 0))
                else:
                    x = np.frombuffer(range_of(row.path, row.data + row.first * row.width * kind.itemsize, n * row.width * kind.itemsize), kind).reshape(n, row.width)
                yield pd.DataFrame({"path": row.path, "row_index": np.arange(row.first, row.first + n), "values": list(x.astype(float))})

    return ranges.mapInPandas(parse, "path string, row_index long, values array<double>")


def workbook_rows(content: bytes) -> list[tuple[int, str, str]]:
    """(row, value, kind) of the first column of a workbook's active sheet, from row 2 on, empty cells left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        view = book.find(f"{SHEET}bookViews/{SHEET}workbookView")
        sheet = book.findall(f"{SHEET}sheets/{SHEET}sheet")[int(view.get("activeTab", 0)) if view is not None else 0]
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(LINK)].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{SHEET}t")) for x in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for cell in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{SHEET}c"):
            ref, kind, value = cell.get("r"), cell.get("t"), cell.find(f"{SHEET}v")
            if not ref or ref.rstrip("0123456789") != "A" or int(ref[1:]) < 2:
                continue
            if kind == "inlineStr":
                out.append((int(ref[1:]), "".join(t.text or "" for t in cell.iter(f"{SHEET}t")), "str"))
            elif value is None:
                continue
            elif kind == "s":
                out.append((int(ref[1:]), shared[int(value.text)], "str"))
            elif kind == "b":
                out.append((int(ref[1:]), "true" if value.text == "1" else "false", "bool"))
            else:
                out.append((int(ref[1:]), value.text, "str" if kind == "str" else "int" if value.text.lstrip("-").isdigit() else "float"))
    return out


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, excel_row, value, value_kind)."""

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = workbook_rows(content)
                yield pd.DataFrame({"path": [name] * len(rows), "excel_row": [x[0] for x in rows], "value": [x[1] for x in rows], "value_kind": [x[2] for x in rows]})

    return files(spark, path, "*.xlsx").mapInPandas(parse, "path string, excel_row int, value string, value_kind string")


HEADER = "stem string, data_file string, orientation string, format string, rate double, channels array<string>, resolution array<double>"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(stem, data_file, orientation, format, rate, channels, resolution) of header files; no data is read."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    head = files(spark, path, "*.vhdr").select(stem.alias("stem"), "content")

    def parse(batches):
        for pdf in batches:
            rows = []
            for name, header in zip(pdf["stem"], pdf["content"]):
                text = header.decode("utf-8-sig", "replace")
                ini = configparser.ConfigParser(interpolation=None, strict=False, comment_prefixes=(";",), allow_no_value=True)
                ini.optionxform = str
                ini.read_string(text[text.index("[") :].split("[Comment]")[0])
                common = ini["Common Infos"]
                parts = [ini["Channel Infos"][f"Ch{k + 1}"].split(",") for k in range(int(common["NumberOfChannels"]))]
                data = f"{name.rsplit('/', 1)[0]}/{common.get('DataFile') or name.rsplit('/', 1)[1] + '.eeg'}".replace("$b", name.rsplit("/", 1)[1])
                rows.append((name, data, common["DataOrientation"], ini["Binary Infos"]["BinaryFormat"], 1e6 / float(common["SamplingInterval"]), [p[0] for p in parts], [float(p[2]) if len(p) > 2 and p[2] else 1.0 for p in parts]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEADER.split(", ")])

    return head.mapInPandas(parse, HEADER)


def brainvision(spark: SparkSession, path: str, block: int = 256, start: int = 0, stop: int | None = None) -> DataFrame:
    """(stem, block, start_sample, rate, channels, data: array of samples of array of channels) of header and data files, from
    sample start up to stop.

    Each task reads the byte ranges of its blocks and no more, so recordings may have any size, and a slice costs what it
    holds. The header says the sample format, the order and each channel's resolution.
    """
    sizes = listed(spark, path, "*.eeg").withColumnRenamed("path", "data_file")
    width = F.when(F.col("format") == "INT_16", 2).otherwise(4)
    rows = headers(spark, path).join(sizes, "data_file").withColumn("samples", F.floor(F.col("length") / (width * F.size("channels"))))
    end = F.col("samples") if stop is None else F.least("samples", F.lit(stop))
    rows = rows.withColumn("end", end).where(F.col("end") > start)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(start // block).cast("long"), F.floor((F.col("end") - 1) / block))))
    rows = rows.repartition(F.col("stem"), F.floor(F.col("block") / 64)).select("stem", "data_file", "orientation", "format", "rate", "channels", "resolution", "samples", "end", "block")

    def parse(batches):
        kinds = {"INT_16": np.dtype("<i2"), "IEEE_FLOAT_32": np.dtype("<f4"), "INT_32": np.dtype("<i4")}
        for pdf in batches:
            for row in pdf.itertuples():
                kind, n = kinds[row.format], len(row.channels)
                a, b = max(start, row.block * block), min(row.end, (row.block + 1) * block)
                if row.orientation == "MULTIPLEXED":
                    x = np.frombuffer(range_of(row.data_file, a * n * kind.itemsize, (b - a) * n * kind.itemsize), kind).reshape(-1, n)
                else:
                    x = np.stack([np.frombuffer(range_of(row.data_file, (k * row.samples + a) * kind.itemsize, (b - a) * kind.itemsize), kind) for k in range(n)], 1)
                yield pd.DataFrame({"stem": [row.stem], "block": [row.block], "start_sample": [a], "rate": [row.rate], "channels": [list(row.channels)], "data": [(x * np.asarray(row.resolution)).tolist()]})

    return rows.mapInPandas(parse, "stem string, block int, start_sample long, rate double, channels array<string>, data array<array<double>>")


def as_signal(blocks: DataFrame) -> DataFrame:
    """(stem, sample, channel, value) of brainvision()."""
    rows = blocks.select("stem", "start_sample", F.posexplode("data").alias("k", "x"))
    return rows.select("stem", (F.col("start_sample") + F.col("k")).alias("sample"), F.posexplode("x").alias("channel", "value"))
