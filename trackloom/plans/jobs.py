"""Runs over many videos with a ledger: what is done is not done again, and a failure is a row."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.lineage import cut
from trackloom.functions.text import failure_cause

#: What must agree for an earlier run to count.
SAME = ["version", "settings", "bytes", "language"]
#: Videos of one run: the work is set-wise, so that a run is as parallel as its videos together.
TOGETHER = 256
LEDGER = "video string, version string, settings string, bytes bigint, language string, state string, cause string, message string, run string"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The last outcome of each video: the row of the latest run that names it; empty where there is no ledger yet."""
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    fields = [c.split()[0] for c in LEDGER.split(", ") if not c.startswith("video ")]
    return rows.groupBy("video").agg(F.max_by(F.struct(*fields), "run").alias("one")).select("video", "one.*")


def todo(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs that no finished run answers with equal version, settings, size and language."""
    return jobs.join(done.filter("state = 'done'"), ["video", *SAME], "left_anti")


def process(spark: SparkSession, jobs: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, together: int = TOGETHER) -> DataFrame:
    """Does the jobs (video and SAME) that are not done and returns the ledger.

    work(videos) gives the rows of some videos in one plan; they are written to folder/results, a folder a run, and
    then named in folder/ledger, so that rows without a ledger entry do not count.  A run that fails is halved until
    the videos at fault stand alone; these are written down with their cause, and the others go on.  Stopped anywhere,
    the next call does what is missing.  A message that holds failure[path] or failure[path system] names its cause
    (see failure_cause); any other one is unexpected.
    """
    waiting = cut(todo(jobs, ledger(spark, folder)))
    names = [r["video"] for r in waiting.select("video").orderBy("video").collect()]
    groups = [names[k:k + together] for k in range(0, len(names), together)]
    while groups:
        own = groups.pop(0)
        run = f"{_next(spark, folder):012d}-{uuid.uuid4().hex[:8]}"
        rows = waiting.filter(F.col("video").isin(own))
        try:
            work(rows).write.mode("errorifexists").parquet(f"{folder}/results/run={run}")
        except Exception as error:
            # whatever the work raises is the outcome of its videos
            if len(own) > 1:
                groups = [own[:len(own) // 2], own[len(own) // 2:], *groups]
                continue
            _noted(rows, "failed", str(error)[:2000], run, folder)
            continue
        _noted(rows, "done", None, run, folder)
    return ledger(spark, folder)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the runs that the ledger names as the last ones of videos that are done."""
    done = ledger(spark, folder).filter("state = 'done'").select("video", "run")
    return spark.read.option("basePath", f"{folder}/results").parquet(f"{folder}/results").join(done, ["video", "run"], "left_semi").drop("run")


def _next(spark: SparkSession, folder: str) -> int:
    last = ledger(spark, folder).agg(F.max("run")).first()[0]
    return int(last.split("-")[0]) + 1 if last else 0


def _noted(rows: DataFrame, state: str, message: str | None, run: str, folder: str) -> None:
    said = F.lit(message).cast("string")
    part = lambda k: F.regexp_extract(said, r"failure\[([a-z/-]+)(?: ([a-z-]+))?\]", k)
    cause = F.lit(None).cast("string") if message is None else failure_cause(part(1), part(2))
    rows.select("video", *SAME, F.lit(state).alias("state"), cause.alias("cause"), said.alias("message"), F.lit(run).alias("run")).coalesce(1).write.mode(
        "append").parquet(f"{folder}/ledger")
