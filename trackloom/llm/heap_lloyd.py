"""Vector code compression: codebooks per part of the vectors by Lloyd's rounds over heaps, in integers.

Vectors are cut into parts, and each part position has a codebook of entries.  Rows are packed into blocks.
In a block every entry of a codebook has a heap of the parts assigned to it, keyed by a lower bound of the
distance to the second-nearest entry minus an upper bound of the distance to its own: its slack, plus what
the entry had drifted when the part came in.  After a round an entry's cumulative drift grows by its own
step and the longest step of the others; only parts whose key it has reached can have another nearest entry,
and these are popped and scanned exactly.  Sums follow the parts that move.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.lineage import cut, dropped
from trackloom.llm.frames import fresh, named
from trackloom.llm.vectors import floored, sound
from trackloom.llm.workers import mapped

#: Rows of a block, bits of a row's place in a heap key, units of a distance in one.
BLOCK, PLACE, UNIT = 4096, 12, 256
FAR = 1 << 48
#: Labels up to which the sums by label are broadcast; beyond, they are joined in SALTS parts.
BROADCAST_LABELS, SALTS = 1_000_000, 16

STATE = "values binary, width int, heaps binary, sizes binary, moved array<bigint>"


def reach(dims: int) -> int:
    """The integers of vectors are held within this, so that squared distances are exact in 64 bits."""
    return isqrt((1 << 62) // dims) // 2


@dataclass
class Codebooks:
    """entries[part, entry, place] as integers of floor(scale * x); dims is the length of the vectors."""

    entries: np.ndarray
    dims: int
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def cut_up(values: np.ndarray, parts: int) -> np.ndarray:
    """Rows by dims as rows by parts by places; zeros fill the last part of vectors that parts do not divide."""
    places = -(-values.shape[1] // parts)
    return np.pad(values, ((0, 0), (0, parts * places - values.shape[1]))).reshape(len(values), parts, places)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, as int64."""
    if not len(x):
        return np.zeros((0, len(entries)), np.int64)
    largest = int(max(np.abs(x).max(), np.abs(entries).max()))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 53:
        # whole numbers below 2^53: products of doubles are exact in any order
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.concatenate([((x[k:k + 512, None, :] - entries) ** 2).sum(2) for k in range(0, len(x), 512)])


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of equal ones, and its slack in units, rounded down."""
    own = d.argmin(1)
    rows = np.arange(len(d))
    upper = np.ceil(np.sqrt(d[rows, own].astype(np.float64)) * UNIT).astype(np.int64) + 1
    if d.shape[1] == 1:
        return own, np.full(len(d), FAR)
    others = d.copy()
    others[rows, own] = np.iinfo(np.int64).max
    lower = np.floor(np.sqrt(others.min(1).astype(np.float64)) * UNIT).astype(np.int64) - 1
    return own, lower - upper


class Block:
    """Some rows' parts and the heaps over them."""

    def __init__(self, x: np.ndarray, entries: int, heaps: list[list[list[int]]] | None = None) -> None:
        self.x, self.entries = x, entries
        self.fresh = heaps is None
        self.heaps = heaps or [[[] for _ in range(entries)] for _ in range(x.shape[1])]

    @classmethod
    def read(cls, row: dict, parts: int, places: int, entries: int) -> Block:
        x = np.frombuffer(row["values"], dtype=f"<i{row['width']}").astype(np.int64).reshape(-1, parts, places)
        keys, sizes = np.frombuffer(row["heaps"], "<i8"), np.frombuffer(row["sizes"], "<i4")
        ends = np.cumsum(sizes)
        # an array that was a heap when it was written is one
        lists = [keys[end - size:end].tolist() for end, size in zip(ends.tolist(), sizes.tolist())]
        return cls(x, entries, [lists[p * entries:(p + 1) * entries] for p in range(parts)])

    def due(self, part: int, drift: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows whose slack is used up, taken off their heaps, and the entries they were with."""
        rows, old = [], []
        for entry, (heap, limit) in enumerate(zip(self.heaps[part], drift)):
            before = len(rows)
            while heap and heap[0] >> PLACE <= limit:
                rows.append(heapq.heappop(heap) & (1 << PLACE) - 1)
            old += [entry] * (len(rows) - before)
        return np.array(rows, np.int64), np.array(old, np.int64)

    def step(self, books: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """One assignment; returns the change of counts and sums by part and entry."""
        moved = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for part in range(len(books)):
            if self.fresh:
                rows, old = np.arange(len(self.x)), None
            else:
                rows, old = self.due(part, drift[part].tolist())
            own, slack = nearest(distances(self.x[rows, part], books[part]))
            keys = (slack + drift[part][own] << PLACE) + rows
            for entry in range(self.entries):
                here = own == entry
                heap, new = self.heaps[part][entry], keys[here].tolist()
                if len(new) > len(heap) // 8:
                    heap += new
                    heapq.heapify(heap)
                else:
                    for key in new:
                        heapq.heappush(heap, key)
                came = rows[here] if old is None else rows[here & (old != entry)]
                moved[part, entry, 0] += len(came)
                moved[part, entry, 1:] += self.x[came, part].sum(0)
                if old is not None:
                    left = rows[~here & (old == entry)]
                    moved[part, entry, 0] -= len(left)
                    moved[part, entry, 1:] -= self.x[left, part].sum(0)
        self.fresh = False
        return moved

    def written(self, moved: np.ndarray) -> dict:
        most = int(np.abs(self.x).max(initial=0))
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        flat = [h for part in self.heaps for h in part]
        return {"values": self.x.astype(f"<i{width}").tobytes(), "width": width,
                "heaps": np.fromiter((k for h in flat for k in h), "<i8").tobytes(),
                "sizes": np.array([len(h) for h in flat], "<i4").tobytes(), "moved": moved.ravel().tolist()}


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16,
        rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of the vectors of df; None where no row has one (see sound for those that count).

    Entries start as the parts of the rows with the least ids, ascending (nulls last, ties by the vector; fewer
    rows make fewer entries).  Repeated rows and ids count each.  Components are floor(scale * x), held within
    reach(dims).  Each round writes the blocks once, vectors and heaps together, and drops the blocks before;
    the changes of sums are added up by Spark, and as many numbers as the codebooks have come to the driver.
    """
    kept, dims = sound(df.select(vec_id, vector), vector)
    if not dims:
        return None
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).collect()
    most = reach(dims)
    values = np.clip(np.floor(np.array([r[vector] for r in first], np.float64) * scale), -most, most).astype(np.int64)
    books = np.ascontiguousarray(cut_up(values, parts).transpose(1, 0, 2))
    entries, places = books.shape[1:]
    sums, drift = np.zeros((parts, entries, places + 1), np.int64), np.zeros((parts, entries), np.int64)
    names = ["values", "width", "heaps", "sizes", "moved"]
    arrow = pa.schema([("values", pa.binary()), ("width", pa.int32()), ("heaps", pa.binary()), ("sizes", pa.binary()), ("moved", pa.list_(pa.int64()))])

    def begun(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                x = cut_up(floored(batch.column(0).slice(k, BLOCK), dims, scale, most), parts)
                block = Block(x, entries)
                yield pa.RecordBatch.from_pylist([block.written(block.step(books, drift))], arrow)

    def going_on(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.read(batch.slice(k, 1).to_pylist()[0], parts, places, entries)
                yield pa.RecordBatch.from_pylist([block.written(block.step(books, drift))], arrow)

    blocks = None
    for k in range(rounds):
        made = mapped(kept.select(vector), begun, STATE) if blocks is None else mapped(blocks.select(*names), going_on, STATE)
        before, blocks = blocks, cut(made) if k + 1 < rounds else None
        change = (made if blocks is None else blocks).select(F.posexplode("moved").alias("at", "by")).groupBy("at").agg(F.sum("by").alias("by"))
        for row in change.collect():
            sums.ravel()[row["at"]] += row["by"]
        if before is not None:
            dropped(before)
        counts = sums[:, :, :1]
        after = np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), books)
        steps = np.ceil(np.sqrt(((after - books) ** 2).sum(2).astype(np.float64)) * UNIT).astype(np.int64) + (after != books).any(2)
        if entries > 1:
            others = np.stack([np.delete(steps, e, 1).max(1) for e in range(entries)], 1)
            # new arrays: the plan of the round before may still hold the old ones
            drift = drift + steps + others
        books = after
    return Codebooks(books, dims, scale)


def encode(df: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The rows of df whose vector counts (see sound), with code binary, the nearest entry of each part, and error
    long, the squared distances to these summed; one narrow pass.  Without codebooks there is no row."""
    code, error = fresh(df.columns, "code", "error")
    schema = T.StructType([*df.schema.fields, T.StructField(code, T.BinaryType()), T.StructField(error, T.LongType())])
    kept, dims = sound(df, vector)
    if books is None or dims != books.dims:
        return df.sparkSession.createDataFrame([], schema)
    schema = T.StructType([*kept.schema.fields, *schema.fields[-2:]])
    at = kept.columns.index(vector)

    def run(batches):
        for batch in batches:
            x = cut_up(floored(batch.column(at), dims, books.scale, reach(dims)), len(books.entries))
            codes, errors = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
            for part, entries in enumerate(books.entries):
                d = distances(x[:, part], entries)
                codes[:, part] = d.argmin(1)
                errors += d.min(1, initial=np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], names=schema.names)

    return mapped(kept, run, schema)


def with_sums(df: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of equal label, nulls together, at most the largest long.

    Sums are made before they meet the rows; few labels are broadcast, of many each is repeated SALTS times, so
    that the rows of one label are many tasks."""
    key, salt = fresh(df.columns, "key", "salt")
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = cut(df.groupBy(named(F.col(label)).alias(key)).agg(total.alias(name)))
    keyed = df.withColumn(key, named(F.col(label)))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return keyed.join(F.broadcast(sums), key).select(*df.columns, name)
    dealt = sums.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn(salt, F.floor(F.rand(3) * SALTS).cast("int")).join(dealt, [key, salt]).select(*df.columns, name)


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **settings) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of the rows whose vector counts; no rows where
    none does."""
    books = fit(df, vec_id, vector, **settings)
    own = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    coded = cut(encode(own, books, "vector").select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    return with_sums(coded, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
