"""Delimited, JSON and list files as frames, and inventories of folders. All go through Spark's readers, so any store will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import suffix
from .binary import streamed

# Suffixes of signal files and of texts that are hashed, the size up to which they are, and the sidecar keys.
SIGNAL_SUFFIXES = [".bdf", ".edf", ".set", ".fdt", ".vhdr", ".eeg", ".fif", ".cnt"]
TEXT_SUFFIXES = [".tsv", ".json", ".txt", ".md"]
HASHED_BYTES = 50 * 1024 * 1024
SIDECAR_KEYS = ["TaskName", "SamplingFrequency", "EEGChannelCount", "EOGChannelCount", "ECGChannelCount", "EMGChannelCount", "EEGReference", "PowerLineFrequency", "SoftwareFilters", "HardwareFilters"]


def tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table whose header names the columns, every field a text; an empty field is an empty text, not a null."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding="UTF-8", nullValue="\0", emptyValue="")
    return df.select([F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(x) for x in df.columns])


def lenient_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of tsv(), for reports that go on without a table: one that is missing, unreadable or without these
    columns is empty."""
    try:
        return tsv(spark, path).select(*(f"`{x}`" for x in columns))
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"`{x}` string" for x in columns))


def indexed_tsv(spark: SparkSession, path: str, name: str = "event_index") -> DataFrame:
    """tsv() with path, and each file's rows numbered from 0 by their place in the file.

    A split of a file says where it begins, and a task reads its rows in order. So the rows of each split are counted, and the sums
    over the splits before it number them: however files are split, nothing is sorted, and no file is read by one task.
    """
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False, encoding="UTF-8", nullValue="\0", emptyValue="")
    fields = [F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(x) for x in rows.columns]
    rows = rows.select(*fields, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    splits = rows.groupBy(F.col("path").alias("__path"), F.col("__block").alias("__start")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__path").orderBy("__start")) - F.col("__n")  # a row a split
    splits = splits.select("__path", "__start", (before - F.col("__first")).alias("__shift"))
    return rows.join(splits, (F.col("path") == F.col("__path")) & (F.col("__block") == F.col("__start"))).withColumn(name, F.col("__at") + F.col("__shift")).drop("__block", "__at", "__path", "__start", "__shift")


def csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A manifest or metadata table; texts may hold quotes and line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, the allowed keys as texts, error) of JSON files; a file that can't be parsed has its text as error."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    row = text.withColumn("m", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}))
    return row.select("path", *(F.col("m")[k].alias(k) for k in SIDECAR_KEYS), F.when(F.col("m").isNull(), F.col("value")).alias("error"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Result summaries: (run, target, mean, median, by_subject: map)."""
    return spark.read.schema("run string, target string, mean double, median double, by_subject map<string,double>").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, name) of a list file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("v"))
    return whole.select("path", F.posexplode("v").alias("ordinal", "name"))


def inventory(spark: SparkSession, root: str, hash_all: bool = False) -> DataFrame:
    """(path, size_bytes, extension, is_signal, sha256) of the files below root; version-control files are left out.

    Names and sizes come from a listing that reads no content. Only files that are hashed (small texts, or all on request) are
    read: small ones by a second scan whose name pattern and size limit the reader applies before it opens a file, larger ones
    block by block, so a file of any size takes one block of memory.
    """
    def listing(pattern: str = "*") -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).where(~F.col("path").contains("/.git/"))

    extension = suffix(F.col("path"))
    files = listing().select("path", F.col("length").alias("size_bytes"), extension.alias("extension"), extension.isin(SIGNAL_SUFFIXES).alias("is_signal"))
    either = ",".join("".join(f"[{x}{x.upper()}]" for x in name[1:]) for name in TEXT_SUFFIXES)
    hashed = listing("*" if hash_all else f"*.{{{either}}}").where(F.col("length") <= HASHED_BYTES).select("path", F.sha2("content", 256).alias("sha256"))
    if hash_all:
        hashed = hashed.union(streamed(listing().where(F.col("length") > HASHED_BYTES).select("path")))
    return files.join(hashed, "path", "left").withColumn("sha256", F.coalesce("sha256", F.lit("")))


def subjects(files: DataFrame) -> DataFrame:
    """The distinct sub-* folders of an inventory."""
    return files.select(F.regexp_extract("path", "/(sub-[^/]+)/", 1).alias("subject")).where("subject <> ''").distinct()
