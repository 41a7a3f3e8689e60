"""Uncompressed planes in files: a data source of frames by ranges, and a writer of clips with a two-phase commit.

A video is a folder with files of records, one a frame (its number as eight bytes, low byte first, then the bytes of its
plane), and index.json: size (bytes of a plane), frames (one more than the last number) and keys, the places of key
frames as [frame, offset, file].
Folders are opened through pyarrow's file systems, so that any store that it knows will do; on a cluster that is
one which all executors share.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

FRAMES = "frame bigint, luma binary"
HEAD = struct.Struct("<q")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Interval(InputPartition):
    """Frames first to last (inclusive), after the key frame that stands at an offset of a file."""

    first: int
    last: int
    offset: int
    file: str


class PlaneReader(DataSourceReader):
    """One partition for each interval between key frames that the range of frames in the filter meets."""

    def __init__(self, path: str) -> None:
        store, folder = opened(path)
        self.path = path
        self.index = json.loads(store.open_input_stream(f"{folder}/index.json").read())
        self.low, self.high = 0, self.index["frames"] - 1

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            bounds = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if bounds is None or f.attribute != ("frame",):
                yield f
                continue
            if bounds[0] is not None:
                self.low = max(self.low, f.value + bounds[0])
            if bounds[1] is not None:
                self.high = min(self.high, f.value + bounds[1])

    def partitions(self) -> list[Interval]:
        keys = sorted((frame, offset, file) for frame, offset, file in self.index["keys"])
        ends = [*(k[0] for k in keys[1:]), self.index["frames"]]
        # what stands before the first key frame is read from the start of its file
        begins = [0, *(k[0] for k in keys[1:])]
        out = [Interval(max(begin, self.low), min(end - 1, self.high), offset if begin == key else 0, file)
               for (key, offset, file), begin, end in zip(keys, begins, ends)]
        # at least one, which may be empty
        return [i for i in out if i.first <= i.last] or [Interval(0, -1, 0, "")]

    def read(self, partition: Interval) -> Iterator[pa.RecordBatch]:
        if partition.first > partition.last:
            return
        store, folder = opened(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as file:
            yield from self.walked(file, partition, partition.offset)

    def walked(self, file, span: Interval, offset: int) -> Iterator[pa.RecordBatch]:
        """Records from an offset on; an index that leads beyond the first frame wanted is not followed, but its file
        is read from the start."""
        size = self.index["size"]
        file.seek(offset)
        landed = None
        while head := file.read(HEAD.size):
            (frame,) = HEAD.unpack(head)
            if landed is None:
                landed = frame
                if frame > span.first and offset:
                    yield from self.walked(file, span, 0)
                    return
            if frame > span.last:
                return
            luma = file.read(size)
            if len(luma) != size:
                raise ValueError(f"{self.path}: frame {frame} is cut short")
            if frame >= span.first:
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), pa.array([luma], pa.binary())], names=["frame", "luma"])


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: by clip its staged file, the first and the last frame and the bytes of a plane."""

    files: dict


class ClipWriter(DataSourceWriter):
    """One pass over frames into clips that may overlap: a frame goes to each clip whose range holds it.  A clip is a
    folder that read_planes reads; each of its files begins with what counts as a key frame.

    Tasks write files below a hidden folder of their own run.  When all of them have ended well, each clip's folder is
    renamed into place; a clip that is there already is refused, before anything is written and again before the
    renaming, and a failure leaves nothing that can be seen.
    """

    def __init__(self, path: str, clips: list[tuple[str, int, int]], schema) -> None:
        self.path, self.clips = path, sorted((first, last, name) for name, first, last in clips)
        self.fields = schema.fieldNames()
        self.staging = f".{uuid.uuid4().hex}.partial"
        self.refuse()

    def refuse(self) -> None:
        store, folder = opened(self.path)
        for info in store.get_file_info([f"{folder}/{name}" for _, _, name in self.clips]):
            if info.type != pafs.FileType.NotFound:
                raise FileExistsError(f"{info.path} is there already")

    def write(self, iterator: Iterator) -> Part:
        store, folder = opened(self.path)
        files, streams, starts = {}, {}, [first for first, _, _ in self.clips]
        try:
            for row in iterator:
                frame, luma = row["frame"], row["luma"]
                for first, last, name in self.clips[:bisect.bisect_right(starts, frame)]:
                    if last < frame:
                        continue
                    if name not in streams:
                        where = f"{folder}/{self.staging}/{name}"
                        store.create_dir(where, recursive=True)
                        files[name] = [f"{frame:020d}-{uuid.uuid4().hex}.bin", frame, frame, len(luma)]
                        streams[name] = store.open_output_stream(f"{where}/{files[name][0]}")
                    if len(luma) != files[name][3]:
                        raise ValueError(f"{name}: planes of different sizes")
                    files[name][2] = frame
                    streams[name].write(HEAD.pack(frame) + luma)
        finally:
            for stream in streams.values():
                stream.close()
        return Part(files)

    def commit(self, messages: list) -> None:
        self.refuse()
        store, folder = opened(self.path)
        kept = {name: {m.files[name][0]: m.files[name] for m in messages if m and name in m.files} for _, _, name in self.clips}
        for name, files in kept.items():
            staged = f"{folder}/{self.staging}/{name}"
            store.create_dir(staged, recursive=True)
            for info in store.get_file_info(pafs.FileSelector(staged)):
                # of an attempt that did not count
                if info.base_name not in files:
                    store.delete_file(info.path)
            index = {"size": max((f[3] for f in files.values()), default=0), "frames": max((f[2] + 1 for f in files.values()), default=0),
                     "keys": [[first, 0, file] for file, first, _, _ in sorted(files.values())]}
            with store.open_output_stream(f"{staged}/index.json") as out:
                out.write(json.dumps(index).encode())
            store.move(staged, f"{folder}/{name}")
        store.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/{self.staging}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.staging}")


class PlaneSource(DataSource):
    """spark.read.format("planes").load(folder): frame, luma; df.write.format("planes").option("clips", ...).save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "planes"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ClipWriter:
        return ClipWriter(self.options["path"], json.loads(self.options["clips"]), schema)


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a folder; a filter on a range of frames opens only the intervals between key frames that it meets."""
    spark.dataSource.register(PlaneSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("planes").load(folder)


def write_clips(frames: DataFrame, folder: str, clips: list[tuple[str, int, int]]) -> None:
    """Clips (name, first, last) of frames (frame, luma), in one pass: see ClipWriter.

    Rows are ordered within ranges of frames, so that the files of a clip in order of their names are the clip.
    """
    frames.sparkSession.dataSource.register(PlaneSource)
    ranges = frames.select("frame", "luma").repartitionByRange("frame").sortWithinPartitions("frame")
    ranges.write.format("planes").option("clips", json.dumps(clips)).mode("append").save(folder)
