"""Plane files and clips, recorded runs, jobs that resume, users' tables of any dialect."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from trackloom.operators import golden
from trackloom.plans import jobs
from trackloom.sources import planes, recordings


def planes_folder(folder, frames=20, keys=(0, 6, 12), wrong=None):
    folder.mkdir()
    record = 8 + 6
    (folder / "planes.bin").write_bytes(b"".join(struct.pack("<q", f) + bytes([f] * 6) for f in range(frames)))
    offsets = [[k, k * record, "planes.bin"] for k in keys]
    for k, offset in (wrong or {}).items():
        offsets[k][1] = offset
    (folder / "index.json").write_text(json.dumps({"size": 6, "frames": frames, "keys": offsets}))
    return str(folder)


def test_ranges_open_only_their_intervals(spark, tmp_path):
    folder = planes_folder(tmp_path / "v")
    whole = planes.read_planes(spark, folder)
    assert sorted((r["frame"], bytes(r["luma"])) for r in whole.collect()) == [(f, bytes([f] * 6)) for f in range(20)]
    assert whole.rdd.getNumPartitions() == 3
    some = whole.filter("frame >= 7 AND frame < 12")
    assert some.rdd.getNumPartitions() == 1 and sorted(r["frame"] for r in some.collect()) == [7, 8, 9, 10, 11]
    reader = planes.PlaneReader(folder)
    assert list(reader.pushFilters([planes.GreaterThan(("frame",), 11), planes.LessThanOrEqual(("frame",), 13)])) == []
    assert [(i.first, i.last, i.offset) for i in reader.partitions()] == [(12, 13, 12 * 14)]
    assert whole.filter("frame = 40").collect() == [] and [r["frame"] for r in whole.filter("frame = 13 AND length(luma) = 6").collect()] == [13]


def test_an_index_that_overshoots_falls_back_to_the_start(spark, tmp_path):
    folder = planes_folder(tmp_path / "v", wrong={1: 9 * 14})
    assert sorted(r["frame"] for r in planes.read_planes(spark, folder).collect()) == list(range(20))
    (tmp_path / "v" / "planes.bin").write_bytes((tmp_path / "v" / "planes.bin").read_bytes()[:-2])
    with pytest.raises(Exception, match="cut short"):
        planes.read_planes(spark, folder).collect()


def frames_of(folder):
    data = b"".join(p.read_bytes() for p in sorted(folder.glob("*.bin")))
    return [struct.unpack_from("<q", data, k)[0] for k in range(0, len(data), 14)]


def test_clips_overlap_and_appear_together(spark, tmp_path):
    frames = spark.range(50).select(F.col("id").alias("frame"), F.unhex(F.lpad(F.hex("id"), 12, "0")).alias("luma")).repartition(4)
    clips = [("a", 0, 20), ("b", 10, 30), ("none", 100, 110), ("c", 20, 20)]
    planes.write_clips(frames, str(tmp_path), clips)
    assert {n: frames_of(tmp_path / n) for n, _, _ in clips} == {n: [f for f in range(50) if a <= f <= b] for n, a, b in clips}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c", "none"]
    for name, a, b in clips:
        assert sorted(r["frame"] for r in planes.read_planes(spark, str(tmp_path / name)).filter("frame <= 22").collect()) == [f for f in range(50) if a <= f <= min(b, 22)]
    with pytest.raises(Exception, match="there already"):
        planes.write_clips(frames, str(tmp_path), [("d", 0, 5), ("a", 0, 1)])
    assert not (tmp_path / "d").exists()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    frames = spark.range(50).select(F.col("id").alias("frame"), F.when(F.col("id") < 45, F.unhex(F.lpad(F.hex("id"), 12, "0"))).otherwise(
        F.raise_error(F.lit("broken")).cast("binary")).alias("luma"))
    with pytest.raises(Exception, match="broken"):
        planes.write_clips(frames, str(tmp_path), [("a", 0, 49)])
    spark.dataSource.register(planes.PlaneSource)
    plain = frames.coalesce(1).write.format("planes").option("clips", json.dumps([("a", 0, 49)])).mode("append")
    with pytest.raises(Exception, match="broken"):
        plain.save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def run_rows(spark, changed=(), missing=(), frames=3000):
    rows = spark.range(frames * 2).select((F.col("id") % 2).alias("video"), F.expr("id div 2").alias("frame"), (F.col("id") * 0.5).alias("x"))
    x = F.col("x")
    for v, f in changed:
        x = F.when((F.col("video") == v) & (F.col("frame") == f), x + 1).otherwise(x)
    for v, f in missing:
        rows = rows.filter(~((F.col("video") == v) & (F.col("frame") == f)))
    return rows.withColumn("x", x).unionByName(rows.filter("frame % 10 = 3").withColumn("x", F.lit(7.0)))


@pytest.mark.parametrize("fan", [4, 64])
def test_differing_frames_of_recordings(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(golden, "FAN", fan)
    changed, missing = [(0, 5), (0, 255), (1, 256), (1, 2999)], [(0, 1000), (0, 2999)]
    golden.record(run_rows(spark), str(tmp_path / "a"))
    golden.record(run_rows(spark), str(tmp_path / "same"))
    golden.record(run_rows(spark, changed, missing), str(tmp_path / "b"))
    golden.record(run_rows(spark, frames=5000), str(tmp_path / "longer"))
    diff = lambda a, b: {tuple(r) for r in golden.differing_frames(spark, str(tmp_path / a), str(tmp_path / b)).collect()}
    assert diff("a", "same") == set() and diff("a", "b") == {*changed, *missing}
    assert diff("a", "longer") == {(v, f) for v in (0, 1) for f in range(3000, 5000)}
    ranges = golden.differing(*(spark.read.parquet(str(tmp_path / n / "tree")) for n in ("a", "b")))
    assert {tuple(r) for r in ranges.collect()} == {(0, 0), (0, 3), (0, 11), (1, 1), (1, 11)}
    # only files of differing ranges are read
    read = golden.recorded_rows(spark, str(tmp_path / "a"), ranges)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "node" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")] and read.select("video", "frame").distinct().count() == 4 * 256 + 2 * (3000 - 11 * 256) - 256
    with pytest.raises(Exception, match="exists"):
        golden.record(run_rows(spark), str(tmp_path / "a"))


def test_verdicts_of_runs(spark):
    frames = spark.createDataFrame([(v, f) for v in (0, 1) for f in [*range(100, 130), 7]], "video long, frame long")
    damaged = spark.createDataFrame([(0, 0, 10), (0, 5, 50), (1, 90, 200), (1, 0, 7)], "video long, first long, last long")
    inputs = spark.createDataFrame([(v, f, f * 3, f % 5 == 0) for v in (0, 1, 2, 3) for f in range(20)], "video long, frame long, pts long, key_frame boolean")
    other = inputs.withColumn("pts", F.when((F.col("video") == 2) & (F.col("frame") > 11), 1).otherwise(F.col("pts"))).filter("NOT (video = 2 AND frame = 19)")
    gaps = golden.first_gaps(inputs, other, ["pts", "key_frame"])
    assert [tuple(r) for r in gaps.collect()] == [(2, "pts", 12)]
    got = {r["video"]: tuple(r)[1:] for r in golden.verdicts(inputs, gaps, frames, damaged).collect()}
    assert got == {0: ("differs", None, None, 1, 30, ",".join(map(str, range(100, 110))), 20, 2, 51), 1: ("same", None, None, 31, 0, "", 0, 2, 119),
                   2: ("inputs differ", "pts", 12, 0, 0, "", 0, 0, 0), 3: ("same", None, None, 0, 0, "", 0, 0, 0)}


def test_jobs_resume_and_failures_are_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    wanted = spark.createDataFrame([(f"v{k}", "1.0", "s", k, "fr") for k in range(9)], "video string, version string, settings string, bytes long, language string")
    seen = []

    def work(videos):
        names = sorted(r["video"] for r in videos.collect())
        seen.append(names)
        bad = F.raise_error(F.concat(F.lit("failure[detection/input/decode/read] "), "video")).cast("long")
        return videos.select("video", F.when(F.col("video").isin("v3", "v7"), bad).otherwise(F.length("video")).alias("n"))

    states = lambda rows: {r["video"]: (r["state"], r["cause"]) for r in rows.collect()}
    expected = {f"v{k}": ("failed", "damaged") if k in (3, 7) else ("done", None) for k in range(9)}
    assert states(jobs.process(spark, wanted, work, folder, together=4)) == expected
    assert {r["video"] for r in jobs.results(spark, folder).collect()} == {v for v, s in expected.items() if s[0] == "done"}
    # only what failed is tried again
    seen.clear()
    jobs.process(spark, wanted, lambda v: (seen.append(sorted(r["video"] for r in v.collect())), v.select("video", F.lit(1).alias("n")))[1], folder)
    assert seen == [["v3", "v7"]] and {s for s, _ in states(jobs.ledger(spark, folder)).values()} == {"done"}
    # other settings are other jobs, and a stop in the middle keeps what is done
    changed, calls = wanted.withColumn("settings", F.lit("t")), []

    def stopped(videos):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return videos.select("video", F.lit(2).alias("n"))

    with pytest.raises(KeyboardInterrupt):
        jobs.process(spark, changed, stopped, folder, together=4)
    assert jobs.todo(changed, jobs.ledger(spark, folder)).count() == 5
    jobs.process(spark, changed, lambda v: v.select("video", F.lit(2).alias("n")), folder, together=4)
    assert sorted((r["video"], r["n"]) for r in jobs.results(spark, folder).collect()) == [(f"v{k}", 2) for k in range(9)]


def test_a_folder_of_mixed_dialects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = ["Vidéo", "Track", "Start", "Start (s)", "Verdict", "Species", "Start_X", "start y"]
    (tmp_path / "in" / "a.csv").write_bytes(("﻿" + ";".join(head) + '\r\nété;1;0:01;"1,5";oui;"a ""b"";\r\nc";10,25;3\r\n;;;;;;;\r\n').encode())
    (tmp_path / "in" / "b.csv").write_bytes("video\tstart_s\tverdict\nhiver €\t2\tno\n".encode("cp1252"))
    (tmp_path / "in" / "c.csv").write_bytes("video,track,start,start_s,verdict,species,start_x,start_y\nd\x81\xe9,2,,x,,,1e1,\n".encode("latin-1"))
    got = sorted((tuple(r) for r in recordings.read_verdicts(spark, str(tmp_path / "in")).collect()), key=str)
    assert got == [("d\x81é", "2", None, None, None, None, 10.0, None), ("hiver €", None, None, 2.0, "no", None, None, None),
                   ("été", "1", "0:01", 1.5, "oui", 'a "b";\r\nc', 10.25, 3.0)]
    (tmp_path / "bad.csv").write_text("one,two\n1,2\n")
    with pytest.raises(Exception, match="bad.csv"):
        recordings.read_verdicts(spark, str(tmp_path / "bad.csv")).collect()


def test_verdicts_are_written_by_video_and_start(spark, tmp_path):
    rows = [("b", "1", "", 2.0), ("a", "2", "", 30.0), ("a", "3", "", 2.0), ("a", "4", "", 11.0), ("a", "5", "", None), ("a", "10", "", -1.0)]
    df = spark.createDataFrame(rows, "video string, track string, start string, start_s double").select(
        "*", *(F.lit("x").alias(c) for c in ("verdict", "species")), *(F.lit(1.0).alias(c) for c in ("start_x", "start_y")))
    recordings.write_verdicts(df, str(tmp_path / "out"), "en")
    text = "".join(p.read_text() for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert [tuple(line.split(",")[:2]) for line in text.splitlines()[1:]] == [("a", "10"), ("a", "5"), ("a", "3"), ("a", "4"), ("a", "2"), ("b", "1")]
