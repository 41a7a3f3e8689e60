"""Readers and writers: round trips and malformed input."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.sources import recordings as rec

MEASURES = {"x": 1.5, "y": 2.0, "left": 0.0, "top": 0.0, "width": 3.0, "height": 4.0, "area": 9.0, "amplitude": 20.0}


def lines(path, rows, zipped=False):
    data = "".join(json.dumps(r) + "\n" for r in rows).encode()
    path.write_bytes(gzip.compress(data[:10]) + gzip.compress(data[10:]) if zipped else data)
    return str(path)


def test_frames_keep_empty_ones(spark, tmp_path):
    rows = [{"frame": 0, "pts": 0, "key_frame": True, "decode_error": False, "detections": [MEASURES, MEASURES | {"strength": "weak"}]},
            {"frame": 1, "pts": None, "key_frame": False, "decode_error": True, "detections": []}]
    frames, found = rec.read_frames(spark, lines(tmp_path / "frames.jsonl.gz", rows, True))
    assert frames.count() == 2 and [r["strength"] for r in found.orderBy("det_idx").collect()] == ["strong", "weak"]
    assert rec.not_dense(frames.withColumn("case", F.lit(1)), ["case"]).count() == 0
    assert rec.not_dense(frames.filter("frame = 1").withColumn("case", F.lit(1)), ["case"]).count() == 1


def test_malformed_lines_fail(spark, tmp_path):
    path = tmp_path / "frames.jsonl"
    path.write_text('{"frame": 0, "detections": []}\n{"frame": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        rec.read_frames(spark, str(path))[0].collect()


def test_tracks_in_order(spark, tmp_path):
    good = {"id": 1, "points": [MEASURES | {"frame": f} for f in (3, 5, 6)]}
    assert [r["frame"] for r in rec.read_tracks(spark, lines(tmp_path / "a.jsonl", [good])).orderBy("frame").collect()] == [3, 5, 6]
    bad = {"id": 2, "points": [MEASURES | {"frame": f} for f in (3, 3)]}
    with pytest.raises(Exception, match="out of order"):
        rec.read_tracks(spark, lines(tmp_path / "b.jsonl", [good, bad])).collect()


def test_lines_are_written_once(spark, tmp_path):
    df = spark.range(3)
    rec.write_lines(df, str(tmp_path / "out"), gzip=True)
    assert rec.read_lines(spark, str(tmp_path / "out"), "id BIGINT").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        rec.write_lines(df, str(tmp_path / "out"))
    rec.publish(df, str(tmp_path / "table"))
    with pytest.raises(Exception, match="(?i)exist"):
        rec.publish(df, str(tmp_path / "table"))


def table(spark):
    return spark.createDataFrame([(2, "0:00:01", "0:00:02", 1.5, 1.0, 7, 45.25, 50.0, 50.0, 12, 30.5, 0), (1, "0:00:00", "0:00:01", 0.0, 1.0, 6, 45.0, 46.0, 46.0, 11, 31.0, 2)], rec.TABLE)


def test_table_round_trip(spark, tmp_path):
    rec.write_table(table(spark), str(tmp_path / "t"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("part-*")))
    assert data.startswith(b"id,start,end,start_s") and b"\r\n1,0:00:00,0:00:01,0.0," in data and data.endswith(b"\r\n")
    assert sorted(map(tuple, rec.read_table(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, table(spark).collect()))
    (tmp_path / "bad.csv").write_text("id,begin\n1,2\n")
    with pytest.raises(Exception):
        rec.read_table(spark, str(tmp_path / "bad.csv")).collect()


def test_localised_lines(spark):
    own = table(spark).select("id", "start", "chord_px")
    got = [r["value"] for r in rec.localised(own, ["n", "début", "corde"], "fr").orderBy("k", "o").collect()]
    assert got == ["﻿n;début;corde", "1;0:00:00;45,0", "2;0:00:01;45,25"]


def test_videos_by_version(spark, tmp_path):
    one = {"format_version": 1, "reference": "r", "ffprobe": {"frame_count": 2, "error_frames": [], "gap_frames": []}, "files": {"frames": "f", "tracks": "t", "csv": "c"}}
    two = {"format_version": 2, "reference": "s", "decoder": {"error_frames": [1], "gap_frames": []}, "files": {"frames": "f", "tracks": "t"}}
    for k, (doc, good) in enumerate([(one, True), (two, True), (two | {"ffprobe": one["ffprobe"]}, False), (one | {"format_version": 3}, False)]):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=1))
        if good:
            assert rec.read_video(spark, str(tmp_path / f"{k}.json")).first()["reference"] == doc["reference"]
        else:
            with pytest.raises(Exception, match="version"):
                rec.read_video(spark, str(tmp_path / f"{k}.json")).collect()


def test_bench_folder(spark, tmp_path):
    target = {"id": 1, "motion": "pass", "amplitude": 20, "sigma": 1.5, "start_frame": 7, "positions": [[1, 2], [3, 4]], "amplitudes": [18.0, 19.0], "effective": [[7, 9.5]]}
    lines(tmp_path / "bats.jsonl.gz", [target], True)
    for name in ("reference", "injected"):
        lines(tmp_path / f"{name}.jsonl.gz", [{"frame": 0, "detections": [MEASURES]}], True)
    run = rec.read_bench(spark, str(tmp_path))
    assert [tuple(r) for r in rec.target_points(run["targets"]).orderBy("frame").collect()] == [(1, 7, 1.0, 2.0, 18.0), (1, 8, 3.0, 4.0, 19.0)]
    assert run["reference"].count() == run["injected"].count() == 1
    rec.write_bench(run, str(tmp_path / "again"))
    again = rec.read_bench(spark, str(tmp_path / "again"))
    assert all(again[k].collect() == run[k].collect() for k in run)
    with pytest.raises(Exception):
        rec.write_bench(run, str(tmp_path / "again"))


def test_verdicts_of_any_dialect(spark, tmp_path):
    (tmp_path / "fr.csv").write_text('﻿Video;Track;Start;Start (s);Verdict;Species;Start_X;start y\r\na;1;0:01;"1,5";oui;;"10,25";3\r\n')
    (tmp_path / "any.csv").write_text("a,b,c,d,e,f,g,h\nv,2,0:02,2.5,no,,1,2\n")
    a = rec.read_verdicts(spark, str(tmp_path / "fr.csv")).first()
    assert (a["track"], a["start_s"], a["start_x"], a["verdict"]) == ("1", 1.5, 10.25, "oui")
    assert rec.read_verdicts(spark, str(tmp_path / "any.csv")).first()["start_s"] == 2.5
    rec.write_verdicts(rec.read_verdicts(spark, str(tmp_path / "fr.csv")), str(tmp_path / "out"))
    assert rec.read_verdicts(spark, str(tmp_path / "out")).first()["start_x"] == 10.25
    assert rec.sniffed("a\tb\tc;d") == "\t"


def test_text_forms(spark):
    row = spark.range(1).select(
        text.region(F.lit("1,2, 3,4")).alias("r"), text.region(F.lit("1,2,x,4")).alias("bad"), text.rational(F.lit("6/-4")).alias("q"), text.rational(F.lit("1/0")).alias("z"),
        text.points_text(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(1.0).alias("y")) for x in (1.2, 1.4, 2.6)))).alias("p"), text.decimal(F.lit(-0.001), 2, ",").alias("d")).first()
    assert row["r"] == [1, 2, 3, 4] and row["bad"] is None and tuple(row["q"]) == (-3, 2) and row["z"] is None and row["p"] == "1,1 3,1" and row["d"] == "0,0"


def test_long_tables_are_several_ordered_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rec, "FILE_ROWS", 100)
    rows = [((k * 37) % 1000, "0:00:01", "0:00:02", k / 2, 1.0, k, 45.25, 50.0, 50.0, 12, 30.5, 0) for k in range(1000)]
    df = spark.createDataFrame(rows, rec.TABLE)
    rec.write_table(df, str(tmp_path / "t"))
    parts = [p.read_bytes().decode().split("\r\n") for p in sorted((tmp_path / "t").glob("part-*"))]
    assert len(parts) > 5 and max(map(len, parts)) < 300 and all(p[0].startswith("id,start,end") and p[-1] == "" for p in parts)
    assert [int(line.split(",")[0]) for p in parts for line in p[1:-1]] == list(range(1000))
    assert sorted(map(tuple, rec.read_table(spark, str(tmp_path / "t")).collect())) == sorted(rows)


def test_long_verdicts_are_several_files_and_read_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rec, "FILE_ROWS", 100)
    rows = [(f"é{k % 3}", str(k), "", float(k), "oui", "x", k / 4, 2.0) for k in range(1000)]
    df = spark.createDataFrame(rows, "video string, track string, start string, start_s double, verdict string, species string, start_x double, start_y double")
    rec.write_verdicts(df, str(tmp_path / "out"))
    parts = [p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert len(parts) > 5 and all(p.startswith("﻿video;track") and len(p) < 12_000 for p in parts)
    assert [tuple(line.split(";")[:2]) for p in parts for line in p.split("\r\n")[1:-1]] == [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0], r[3]))]
    assert sorted((r["video"], int(r["track"])) for r in rec.read_verdicts(spark, str(tmp_path / "out")).collect()) == sorted((r[0], int(r[1])) for r in rows)
    assert not isinstance(rec.verdict_rows(parts[0].encode()), list)
