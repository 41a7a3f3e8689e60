"""Result folders: their documents, and a page that lists them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.text import html

TRACK = "STRUCT<id BIGINT, start_s DOUBLE, duration_s DOUBLE, color STRING, summary STRING, clip STRING, zoom STRING, start_xy ARRAY<DOUBLE>, trace STRING>"
PARAMS = (f"video STRING, fps DOUBLE, ignored_s DOUBLE, damaged_s ARRAY<ARRAY<DOUBLE>>, damaged_frames BIGINT, version STRING, state STRING, "
          f"track_count BIGINT, length_s DOUBLE, not_analysed_s DOUBLE, elapsed_s DOUBLE, video_bytes BIGINT, language STRING, date TIMESTAMP, "
          f"summaries ARRAY<STRUCT<file STRING, start_s DOUBLE, end_s DOUBLE>>, tracks ARRAY<{TRACK}>")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """The documents of result folders, one row each, with the path they were read from.  A document that
    cannot be read is a row of nulls with its text in broken: the folder counts as unfinished."""
    return spark.read.schema(PARAMS + ", broken STRING").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken").json(path).withColumn(
        "path", F.input_file_name())


def write_params(df: DataFrame, path: str) -> None:
    """One JSON document per row and line; written last, as a whole, and never over what is there."""
    df.write.mode("errorifexists").json(path)


def page_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), html(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def page(results: DataFrame, title: str, columns: list[str], order: str) -> DataFrame:
    """Lines of an HTML page with a table of results: k (0 head, 1 rows, 2 foot), o, value.

    Rows are made where the data are; only writing them in order brings them together.
    """
    head = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), html(F.lit(title)), F.lit("</title><table><tr>"),
                    *(F.concat(F.lit("<th>"), html(F.lit(c)), F.lit("</th>")) for c in columns), F.lit("</tr>"))
    rows = results.select(F.lit(1).alias("k"), F.col(order).cast("string").alias("o"), page_row([F.col(c) for c in columns]).alias("value"))
    ends = results.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast("string").alias("o"), head.alias("value")).unionByName(
        results.sparkSession.range(1).select(F.lit(2).alias("k"), F.lit(None).cast("string").alias("o"), F.lit("</table>").alias("value")))
    return ends.unionByName(rows)


def write_page(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("k", "o").select("value").write.mode("errorifexists").text(path)
