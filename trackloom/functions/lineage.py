"""Cutting the lineage of a DataFrame at a table that outlives executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder (see cut).

    The folder is the one that the cluster names in spark.checkpoint.dir; where that is unset, a session on one
    machine, as in tests, takes a temporary folder, and a session on a cluster is an error.
    """
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{folder.get()}/tables/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared checkpoint folder: later jobs read it, whatever executors are lost."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def dropped(table: DataFrame) -> None:
    """Deletes the table of a DataFrame that cut returned; nothing may read it, or what is made of it, afterwards.

    For loops that write a table a round: a round's table goes when the next one is written.
    """
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
