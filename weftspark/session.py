"""Where intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df, cut from its lineage, in the folder named by spark.checkpoint.dir; a folder of its own where none is set, as in tests."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftspark-"))
    return df.checkpoint()
