"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Pieces come from the vectorised pre-tokeniser; each distinct piece is merged once per worker and kept
in a bounded cache.  The byte offsets of the tokens go with the ids where they are asked for: by them any
range of bytes is decoded without what stands before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackloom.llm.pretokens import in_groups, split
from trackloom.llm.workers import mapped

CACHE_PIECES = 120_000
CACHED_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank", read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the pair of lowest rank is merged first, the leftmost among equals.

    A heap over a linked list: n log n, so that pieces of any length are encoded whole.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapify(heap)
    while heap:
        _, left, right, end = heappop(heap)
        # stale unless both halves still stand as they were when the pair was entered
        if not alive[left] or right >= n or not alive[right] or after[left] != right or after[right] != end:
            continue
        alive[right] = False
        after[left] = end
        if end < n:
            before[end] = left
            rank = ranks.get(piece[left:after[end]])
            if rank is not None:
                heappush(heap, (rank, left, end, after[end]))
        prior = before[left]
        if prior >= 0:
            rank = ranks.get(piece[prior:end])
            if rank is not None:
                heappush(heap, (rank, prior, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by one set of ranks.  A full cache becomes the older one, from which pieces that are
    met again come back: frequent ones outlive any number of rare ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        self.widths: np.ndarray | None = None

    def ids_of(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.older.get(piece) or tuple(merge_piece(piece, self.ranks))
            if len(piece) <= CACHED_BYTES:
                if len(self.cache) >= CACHE_PIECES:
                    self.older = dict(self.cache)
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        cache, ids_of = self.cache, self.ids_of
        for first, last in in_groups(texts):
            data, cuts, counts = split(texts[first:last])
            bounds = cuts.tolist()
            at = 0
            for count in counts.tolist():
                ids: list[int] = []
                extend, get = ids.extend, cache.get
                for a, b in zip(bounds[at:at + count], bounds[at + 1:at + count + 1]):
                    piece = data[a:b]
                    extend(get(piece) or ids_of(piece))
                at += count
                yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte offset at which each token of a text begins, and the end."""
        if self.widths is None:
            self.widths = np.zeros(max(self.tokens) + 1, dtype=np.int64)
            for i, token in self.tokens.items():
                self.widths[i] = len(token)
        out = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.widths[np.asarray(ids, dtype=np.int64)], out=out[1:])
        return out

    def decode_range(self, ids: list[int], offsets: np.ndarray, begin: int, end: int) -> bytes:
        """The bytes from begin to end (exclusive) of a text; only the tokens that reach into them are read."""
        begin, end = max(0, begin), min(end, int(offsets[-1]))
        if begin >= end:
            return b""
        first, last = np.searchsorted(offsets, begin, side="right") - 1, np.searchsorted(offsets, end, side="left")
        return self.decode(ids[first:last])[begin - int(offsets[first]):end - int(offsets[first])]


_codecs: dict[str, Codec] = {}


def _codec(key: str, broadcast) -> Codec:
    """One codec per worker and vocabulary; it outlives tasks where Spark reuses workers."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value)
    return _codecs[key]


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def _appended(df: DataFrame, text: str, ranks: dict[bytes, int], added: list[tuple[str, T.DataType]], rows) -> DataFrame:
    """df with columns that rows(codec, texts) yields per text, by a pass over Arrow batches; no shuffle."""
    fields = [T.StructField(free_name(df.columns, name), kind) for name, kind in added]
    schema = T.StructType([*df.schema.fields, *fields])
    broadcast = df.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    place = df.columns.index(text)
    arrow = [pa.int64() if isinstance(k, T.LongType) else pa.string() if isinstance(k, T.StringType)
             else pa.list_(pa.int32()) if isinstance(k, T.ArrayType) else pa.binary() for _, k in added]
    def run(batches):
        codec = _codec(key, broadcast)
        for batch in batches:
            for piece in slices(batch, place):
                texts = [t or "" for t in piece.column(place).to_pylist()]
                columns = list(zip(*rows(codec, texts))) or [() for _ in arrow]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(c, type=t) for c, t in zip(columns, arrow))],
                    names=[f.name for f in schema.fields])
        # the next task starts with an empty cache, which fills at once; an idle worker holds none
        codec.cache.clear()
        codec.older.clear()

    return mapped(df, run, schema)


def slices(batch: pa.RecordBatch, place: int, most: int = 2 << 20):
    """Parts of a batch of about so many bytes of text; bounds what a worker holds."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def encode(df: DataFrame, ranks: dict[bytes, int], text: str = "text", offsets: bool = False) -> DataFrame:
    """df with token_ids array<int>, and with token_offsets array<int> if asked for: where each token begins, in
    bytes.  A null text counts as empty and has no ids; rows, repeated ones too, pass one to one; where df has
    a column token_ids, the new one is _token_ids."""
    kind = T.ArrayType(T.IntegerType())
    if not offsets:
        return _appended(df, text, ranks, [("token_ids", kind)],
                         lambda codec, texts: ((ids,) for ids in codec.encode_batch(texts)))
    return _appended(df, text, ranks, [("token_ids", kind), ("token_offsets", kind)],
                     lambda codec, texts: ((ids, codec.offsets(ids)[:-1]) for ids in codec.encode_batch(texts)))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids") -> DataFrame:
    """df with decoded binary, the bytes of the tokens in order; null ids decode to no bytes."""
    name = free_name(df.columns, "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    broadcast = df.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    place = df.columns.index(ids)
    def run(batches):
        codec = _codec(key, broadcast)
        for batch in batches:
            out = pa.array([codec.decode(x or []) for x in batch.column(place).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[f.name for f in schema.fields])

    return mapped(df, run, schema)


#: Bytes that are decoded at a time by the offsets of their tokens.
WINDOW = 1 << 16


def round_trip(df: DataFrame, ranks: dict[bytes, int], text: str = "text", ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the bytes decoded from
    these ids, window by window, each through the offsets of the tokens that reach into it) and offsets_sha256 (of
    the offsets at which tokens begin, and the end, eight bytes each, low byte first), and with token_ids if asked
    for, in one pass.  A null text counts as empty: no ids, one offset."""
    def rows(codec: Codec, texts: list[str]):
        for own in codec.encode_batch(texts):
            offsets, decoded = codec.offsets(own), hashlib.sha256()
            for begin in range(0, int(offsets[-1]), WINDOW):
                decoded.update(codec.decode_range(own, offsets, begin, begin + WINDOW))
            digests = (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), decoded.hexdigest(),
                       hashlib.sha256(offsets.astype("<i8").tobytes()).hexdigest())
            yield (*digests, own) if ids else digests

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("offsets_sha256", T.StringType())]
    return _appended(df, text, ranks, [*added, ("token_ids", T.ArrayType(T.IntegerType()))] if ids else added, rows)
