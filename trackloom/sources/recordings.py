"""Recordings, tables and result folders: readers with explicit schemas, and writers.

Readers fail on the first malformed line.  Paths are only ever opened by Spark, so any store will do.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASURES = "x DOUBLE, y DOUBLE, left DOUBLE, top DOUBLE, width DOUBLE, height DOUBLE, area DOUBLE, amplitude DOUBLE, strength STRING"
FRAMES = f"frame BIGINT, pts BIGINT, key_frame BOOLEAN, decode_error BOOLEAN, detections ARRAY<STRUCT<{MEASURES}>>"
TRACKS = f"id BIGINT, points ARRAY<STRUCT<frame BIGINT, {MEASURES}>>"
TABLE = ("id BIGINT, start STRING, end STRING, start_s DOUBLE, duration_s DOUBLE, hits BIGINT, chord_px DOUBLE, path_px DOUBLE, "
         "speed_px_s DOUBLE, max_area_px BIGINT, peak_amplitude DOUBLE, filled_frames BIGINT")
SPANS = "ARRAY<ARRAY<BIGINT>>"
VIDEO = ("format_version INT, reference STRING, video STRUCT<name STRING, bytes BIGINT, sha256 STRING>, "
         "stream STRUCT<width INT, height INT, r_frame_rate STRING, avg_frame_rate STRING, time_base STRING, nb_frames STRING>, "
         "ffprobe STRUCT<frame_count BIGINT, error_frames ARRAY<BIGINT>, gap_frames ARRAY<BIGINT>>, "
         "decoder STRUCT<error_frames ARRAY<BIGINT>, gap_frames ARRAY<BIGINT>, losses STRUCT<before_first BIGINT, after_last BIGINT>>, "
         f"background_half_window INT, damaged_spans {SPANS}, unstable_spans {SPANS}, "
         "counts STRUCT<frames BIGINT, detections BIGINT, detections_kept BIGINT, damaged_frames_reported BIGINT, tracks BIGINT, track_points BIGINT>, "
         "files STRUCT<frames STRING, tracks STRING, csv STRING>, versions MAP<STRING, STRING>")
TARGETS = ("id BIGINT, motion STRING, amplitude DOUBLE, sigma DOUBLE, start_frame BIGINT, positions ARRAY<ARRAY<DOUBLE>>, "
           "amplitudes ARRAY<DOUBLE>, effective ARRAY<ARRAY<DOUBLE>>")
BENCH_FRAMES = f"frame BIGINT, detections ARRAY<STRUCT<{MEASURES}>>"


def checked(value: Column, right: Column, message: str) -> Column:
    """value where right holds; else the query fails with the message."""
    return F.when(right, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, gzip by the file's ending; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    """One JSON object a line; refuses a folder that is there."""
    df.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").json(path)


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames (empty ones too) and detections (with det_idx, the place in the frame; no strength: strong)."""
    lines = read_lines(spark, path, FRAMES)
    found = lines.select("frame", F.posexplode("detections").alias("det_idx", "d")).select("frame", F.col("det_idx").cast("long").alias("det_idx"), "d.*")
    return lines.drop("detections"), found.withColumn("strength", F.coalesce("strength", F.lit("strong")))


def not_dense(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose number is not their place, from 0: empty for a sound recording."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    return frames.withColumn("place", place).filter("place <> frame").select(*keys, "frame", "place")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Points of tracks: track, frame, measures; frames must grow along a track."""
    lines = read_lines(spark, path, TRACKS)
    frames = F.transform("points", lambda p: p["frame"])
    grows = F.forall(F.zip_with(F.slice(frames, 1, F.size(frames) - 1), F.slice(frames, 2, F.size(frames)), lambda a, b: a < b), lambda ok: ok)
    sound = lines.withColumn("ok", checked(F.lit("ok"), (F.size("points") > 0) & ((F.size("points") == 1) | grows), "a track is empty or out of order"))
    out = sound.filter("ok = 'ok'").select(F.col("id").alias("track"), F.explode("points").alias("p")).select("track", "p.*")
    return out.withColumn("strength", F.coalesce("strength", F.lit("strong")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of tracks: the twelve named columns, typed; anything else fails."""
    return spark.read.schema(TABLE).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)


def decimal_text(value: Column) -> Column:
    """A number that always has a decimal point."""
    text = value.cast("string")
    return F.when(text.rlike(r"[.eEN]|Inf"), text).otherwise(F.concat(text, F.lit(".0")))


#: Rows of a file of a table: more are dealt to several files by ranges of their order.
FILE_ROWS = 200_000


def write_ordered(head: DataFrame, lines: DataFrame, path: str) -> None:
    """Lines (k, o, value) in order of o as text with CRLF, below the line of head; refuses what is there.

    A table of FILE_ROWS lines is one file; a longer one is several, in order of their names, each with the head, so
    that no task sorts or writes a whole table.
    """
    files = -(-lines.count() // FILE_ROWS)
    if files <= 1:
        out = head.unionByName(lines).coalesce(1).sortWithinPartitions("k", "o").select("value")
    else:
        # one row
        first = head.first()["value"]

        def headed(batches):
            for k, batch in enumerate(batches):
                if not k:
                    yield pa.RecordBatch.from_arrays([pa.array([first], batch.schema.field(0).type)], schema=batch.schema)
                yield batch

        out = lines.repartitionByRange(files, "o").sortWithinPartitions("o").select("value").mapInArrow(headed, "value string")
    out.write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """The table as CSV with CRLF and a header, ordered by its first column; see write_ordered()."""
    kinds = dict(df.dtypes)
    cells = [decimal_text(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string") for c in df.columns]
    lines = df.select(F.lit(1).alias("k"), F.col(df.columns[0]).alias("o"), F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in cells)).alias("value"))
    write_ordered(df.sparkSession.createDataFrame([(0, None, ",".join(df.columns))], lines.schema), lines, path)


# Separator, decimal mark and byte-order mark of each dialect.
DIALECTS = {"en": (",", ".", ""), "fr": (";", ",", "﻿")}


def localised(df: DataFrame, headings: list[str], dialect: str, places: int = 2, order: list[Column] | None = None) -> DataFrame:
    """Lines of a CSV in a dialect: k (0: the header), o (what lines are ordered by: the first column, or others), value;
    numbers rounded with the dialect's mark."""
    from trackloom.functions.text import decimal, quoted

    separator, mark, bom = DIALECTS[dialect]
    kinds = dict(df.dtypes)
    cells = [decimal(F.col(c), places, mark) if kinds[c] == "double" else quoted(F.col(c).cast("string"), separator) for c in df.columns]
    lines = df.select(F.lit(1).alias("k"), F.struct(*(order or [F.col(df.columns[0])])).alias("o"),
                      F.concat_ws(separator, *(F.coalesce(c, F.lit("")) for c in cells)).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast(lines.schema["o"].dataType).alias("o"), F.lit(bom + separator.join(headings)).alias("value"))
    return head.unionByName(lines)


def read_video(spark: SparkSession, path: str) -> DataFrame:
    """Documents of recordings; version 1 needs what was probed and the table, version 2 what was decoded."""
    rows = spark.read.schema(VIDEO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    first = (F.col("format_version") == 1) & F.col("ffprobe").isNotNull() & F.col("files.csv").isNotNull()
    second = (F.col("format_version") == 2) & F.col("decoder").isNotNull() & F.col("ffprobe").isNull() & F.col("files.csv").isNull()
    return rows.withColumn("reference", checked(F.col("reference"), F.coalesce(first | second, F.lit(False)), "a recording's version does not fit its sections"))


def read_bench(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A run of the bench: targets, and detections of the reference and of the injected frames."""
    return {"targets": read_lines(spark, f"{folder}/bats.jsonl.gz", TARGETS), "reference": read_lines(spark, f"{folder}/reference.jsonl.gz", BENCH_FRAMES),
            "injected": read_lines(spark, f"{folder}/injected.jsonl.gz", BENCH_FRAMES)}


def write_bench(run: dict[str, DataFrame], folder: str) -> None:
    """A run of the bench as read_bench() reads it; refuses tables that are there."""
    for name, table in (("bats", "targets"), ("reference", "reference"), ("injected", "injected")):
        write_lines(run[table], f"{folder}/{name}.jsonl.gz", gzip=True)


def target_points(targets: DataFrame) -> DataFrame:
    """Points of targets: id, frame, x, y, amplitude."""
    rows = targets.select("id", "start_frame", F.posexplode(F.arrays_zip("positions", "amplitudes")).alias("k", "p"))
    return rows.select("id", (F.col("start_frame") + F.col("k")).alias("frame"), F.col("p.positions")[0].alias("x"), F.col("p.positions")[1].alias("y"), F.col("p.amplitudes").alias("amplitude"))


def sniffed(first_line: str) -> str:
    """The separator of a user's CSV: the most frequent of ; , and tab in its first line."""
    return max(";,\t", key=lambda s: (first_line.count(s), -";,\t".index(s)))


#: Rows of verdicts that are given on at once.
GIVEN = 10_000
# The columns of a table of verdicts.
VERDICT_COLUMNS = ["video", "track", "start", "start_s", "verdict", "species", "start_x", "start_y"]


def decoded(content: bytes) -> str:
    """UTF-8 where it is, else Windows-1252, whose free places are control characters; without byte-order mark."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1").translate({k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)})
    return text.removeprefix("\ufeff")


def verdict_rows(content: bytes) -> Iterator[dict] | None:
    """The rows of one file of verdicts as texts by VERDICT_COLUMNS; None where its columns cannot be told."""
    text = decoded(content)
    separator = sniffed(text[:len(text) if (end := re.search(r"[\r\n]", text)) is None else end.start()])
    rows = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if any(cell.strip() for cell in r))
    head = ["".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum()) for c in next(rows, [])]
    at = [head.index(c.replace("_", "")) if c.replace("_", "") in head else None for c in VERDICT_COLUMNS]
    if at[VERDICT_COLUMNS.index("video")] is None or at[VERDICT_COLUMNS.index("start_s")] is None:
        if len(head) != len(VERDICT_COLUMNS):
            return None
        at = list(range(len(head)))
    cells = ({c: r[k].strip() if k is not None and k < len(r) else "" for c, k in zip(VERDICT_COLUMNS, at)} for r in rows)
    return (r for r in cells if any(r.values()))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Users' verdicts of a file or a folder of files, each in its own encoding, dialect and order of columns.

    Columns go by folded name, by place only where video or start_s is not named and there are eight.  A file whose
    columns cannot be told fails the query.  A file's bytes are whole in a task, its rows are given on as they are read.
    """
    arrow = pa.schema([(c, pa.string()) for c in VERDICT_COLUMNS])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = verdict_rows(batch.column(1)[k].as_py())
                if rows is None:
                    raise ValueError(f"{batch.column(0)[k].as_py()}: these are not the columns of a table of verdicts")
                while some := list(itertools.islice(rows, GIVEN)):
                    yield pa.RecordBatch.from_pylist(some, arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    texts = files.mapInArrow(run, ", ".join(f"{c} string" for c in VERDICT_COLUMNS))
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double").alias(c)
    return texts.select(*(number(c) if c in ("start_s", "start_x", "start_y") else F.nullif(F.col(c), F.lit("")).alias(c) for c in VERDICT_COLUMNS))


def write_verdicts(df: DataFrame, path: str, dialect: str = "fr") -> None:
    """Verdicts as a localised CSV, ordered by video and start (none: 0), CRLF; see write_ordered()."""
    lines = localised(df.select(*VERDICT_COLUMNS), VERDICT_COLUMNS, dialect, order=[F.col("video"), F.coalesce(F.col("start_s"), F.lit(0.0)).alias("start_s")])
    write_ordered(lines.filter("k = 0"), lines.filter("k = 1"), path)


def publish(df: DataFrame, path: str) -> None:
    """df as a table that is whole or absent: the commit protocol renames, and what is there is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
