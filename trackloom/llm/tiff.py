"""TIFF media columns: 8-bit grey pages in strips or tiles, read from and written to binary columns.

Reading follows the chain of image directories, decodes each strip or tile (none, PackBits, LZW or
deflate), undoes horizontal differencing, places tiles, and gives one row per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackloom.llm.byte_bpe import free_name, slices
from trackloom.llm.workers import mapped

# Tag numbers, compression schemes and field types of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257


class TiffError(ValueError):
    """What a file says cannot be followed."""


def pack_bits(row: bytes) -> bytes:
    """PackBits of bytes: runs of 3 and more are repeated, the rest is literal."""
    data = np.frombuffer(row, dtype=np.uint8)
    n = len(data)
    if not n:
        return b""
    edges = np.flatnonzero(np.diff(data)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.append(starts, n))
    long = lengths >= 3
    out = bytearray()
    literal = 0

    def literals(to: int) -> None:
        for a in range(literal, to, 128):
            b = min(a + 128, to)
            out.append(b - a - 1)
            out.extend(row[a:b])

    for start, length in zip(starts[long].tolist(), lengths[long].tolist()):
        literals(start)
        value = row[start]
        literal = start + length
        while length:
            k = min(length, 128)
            # a run of one is a literal of one
            out.extend((257 - k, value) if k > 1 else (0, value))
            length -= k
    literals(n)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, 0
    while n < size:
        if i >= len(data):
            raise TiffError("PackBits data end early")
        code = data[i]
        if code < 128:
            part = data[i + 1:i + 2 + code]
            if len(part) != code + 1:
                raise TiffError("PackBits data end early")
            i += code + 2
        elif code > 128:
            part = data[i + 1:i + 2] * (257 - code)
            i += 2
        else:
            i += 1
            continue
        out.append(part)
        n += len(part)
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widths change one code early."""
    bits, held, out = 0, 0, bytearray()
    table: dict[tuple[int, int], int] = {}
    following, width = 258, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits = bits << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(CLEAR)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[prefix, byte] = following
        following += 1
        if following == 4094:
            put(CLEAR)
            table.clear()
            following, width = 258, 9
        elif following > (1 << width) - 1:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(END)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, bits, held = list(first), 9, 0, 0
    out, made, last = [], 0, None
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            if code >= 256:
                raise TiffError("LZW data begin with a code not yet made")
            entry = first[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code not yet made")
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        last = entry
        if made >= size:
            break
    if made < size:
        raise TiffError("LZW data end early")
    return b"".join(out)[:size]


def compress(data: bytes, scheme: int) -> bytes:
    if scheme == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: lambda d: d, LZW: lzw_encode, PACKBITS: pack_bits}[scheme](data)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    elif scheme == PACKBITS:
        out = unpack_bits(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme == NONE:
        out = data[:size]
    else:
        raise TiffError(f"compression {scheme} is not known")
    if len(out) != size:
        raise TiffError("data end early")
    return out


@dataclass(frozen=True)
class Layout:
    """How a page is stored: rows per strip, or a tile's side lengths."""

    compression: int = DEFLATE
    predictor: int = 1
    rows_per_strip: int = 64
    tile: tuple[int, int] | None = None


def write(pages: list[tuple[np.ndarray, Layout]]) -> bytes:
    """A little-endian file of grey pages (rows x columns, uint8)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image, layout in pages:
        height, width = image.shape
        if layout.tile:
            across, down = layout.tile
            blocks = []
            for y in range(0, height, down):
                for x in range(0, width, across):
                    block = np.zeros((down, across), dtype=np.uint8)
                    part = image[y:y + down, x:x + across]
                    block[:part.shape[0], :part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [image[y:y + layout.rows_per_strip] for y in range(0, height, layout.rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if layout.predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = compress(block.tobytes(), layout.compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) & 1)
        place = ([(TILE_WIDTH, 4, [layout.tile[0]]), (TILE_LENGTH, 4, [layout.tile[1]]),
                  (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if layout.tile else
                 [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [layout.rows_per_strip]),
                  (STRIP_COUNTS, 4, counts)])
        tags = sorted([(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]),
                       (COMPRESSION, 3, [layout.compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]),
                       (PREDICTOR, 3, [layout.predictor]), *place])
        entries = b""
        for tag, kind, values in tags:
            packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                field = struct.pack("<I", len(out))
                out += packed
            else:
                field = packed.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + field
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The integer fields of each image directory in the chain; a chain that returns to itself is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("the chain of directories is broken")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 2 + 12 * n + 4 > len(data):
            raise TiffError("a directory ends early")
        fields = {}
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = FIELD_SIZES.get(kind, 0) * count
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if kind in (1, 3, 4):
                if where + size > len(data):
                    raise TiffError("a field ends early")
                fields[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
        yield fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page(data: bytes, fields: dict[int, tuple[int, ...]]) -> np.ndarray:
    """The samples of one page: rows x columns (x samples where there are several), uint8."""
    try:
        width, height = fields[WIDTH][0], fields[LENGTH][0]
        samples = fields.get(SAMPLES, (1,))[0]
        if any(b != 8 for b in fields.get(BITS, (1,))):
            raise TiffError("only 8-bit samples are read")
        scheme, predictor = fields.get(COMPRESSION, (1,))[0], fields.get(PREDICTOR, (1,))[0]
        if TILE_OFFSETS in fields:
            across, down = fields[TILE_WIDTH][0], fields[TILE_LENGTH][0]
            corners = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
            offsets, counts = fields[TILE_OFFSETS], fields[TILE_COUNTS]
        else:
            across, down = width, min(height, fields.get(ROWS_PER_STRIP, (height,))[0])
            corners = [(y, 0) for y in range(0, height, max(1, down))]
            offsets, counts = fields[STRIP_OFFSETS], fields[STRIP_COUNTS]
    except KeyError as e:
        raise TiffError(f"tag {e.args[0]} is missing") from e
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not known")
    if len(corners) != len(offsets) or len(offsets) != len(counts):
        raise TiffError("the number of strips or tiles does not fit the page")
    image = np.empty((height, width, samples), dtype=np.uint8)
    for (y, x), offset, count in zip(corners, offsets, counts):
        rows = down if TILE_OFFSETS in fields else min(down, height - y)
        raw = decompress(data[offset:offset + count], scheme, rows * across * samples)
        block = np.frombuffer(raw, dtype=np.uint8).reshape(rows, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[y:y + down, x:x + across] = block[:height - y, :width - x]
    return image[:, :, 0] if samples == 1 else image


def read(data: bytes) -> list[np.ndarray]:
    """All pages of a file."""
    return [page(data, fields) for fields in directories(data)]


PAGES = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()),
])


def read_pages(df: DataFrame, media: str, keys: list[str]) -> DataFrame:
    """One row per page of the files in a binary column: keys, page (from 0), width, height, samples,
    pixels (row by row) and error.

    A null file has no rows; one that cannot be followed has the pages before the fault and then a row
    of nulls with the error.  Repeated rows give repeated pages; a key named like a new column keeps
    its name, and the new one gets underscores before it.
    """
    names = []
    for f in PAGES.fields:
        names.append(free_name([*keys, *names], f.name))
    schema = T.StructType([*(df.schema[k] for k in keys),
                           *(T.StructField(n, f.dataType) for n, f in zip(names, PAGES.fields))])

    def pages_of(data: bytes):
        k = 0
        try:
            for fields in directories(data):
                image = page(data, fields)
                yield k, image.shape[1], image.shape[0], image.shape[2] if image.ndim == 3 else 1, image.tobytes(), None
                k += 1
        except (TiffError, struct.error) as e:
            yield k, None, None, None, None, str(e)
    def run(batches):
        kinds = [pa.int32()] * 4 + [pa.binary(), pa.string()]
        for batch in batches:
            for part in slices(batch, len(keys)):
                for i, data in enumerate(part.column(len(keys)).to_pylist()):
                    if data is None:
                        continue
                    rows = list(pages_of(data))
                    held = [part.column(c).slice(i, 1).take(pa.array([0] * len(rows))) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays(
                        [*held, *(pa.array([r[c] for r in rows], kinds[c]) for c in range(6))],
                        names=[f.name for f in schema.fields])

    return mapped(df.select(*keys, media), run, schema)


#: Bytes of a payload in a row of samples, rows of a page.
ROW_BYTES, PAGE_ROWS, UNIT = 192, 192, 576

#: Pages of a file take these in turn, so that each way of storing is written and read.
LAYOUTS = (
    Layout(DEFLATE, 2, rows_per_strip=96),
    Layout(PACKBITS, 1, tile=(64, 64)),
    Layout(LZW, 2, rows_per_strip=48),
    Layout(DEFLATE, 1, tile=(96, 48)),
)


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def store(payload: bytes) -> bytes:
    """A payload of whole rows as pages of at most PAGE_ROWS rows."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW_BYTES)
    return write([(samples[y:y + PAGE_ROWS], LAYOUTS[k % len(LAYOUTS)])
                  for k, y in enumerate(range(0, len(samples), PAGE_ROWS))])


def feature(pages: list[np.ndarray]) -> str:
    """Pages, mean sample, mean absolute step along rows and a 16-bin histogram (per mille), of all samples."""
    total = sum(p.size for p in pages)
    bins = sum(np.bincount(p.reshape(-1) >> 4, minlength=16) for p in pages)
    mean = sum(int(p.sum(dtype=np.int64)) for p in pages) / total
    step = sum(int(np.abs(np.diff(p.astype(np.int16), axis=1)).sum(dtype=np.int64)) for p in pages) / total
    return f"{len(pages)};{mean:.4f};{step:.4f};" + ",".join(str(int(b) * 1000 // total) for b in bins)


DIGEST = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()),
          ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()),
          ("feature", T.StringType())]


def stored_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column of TIFF files that hold the UTF-8 of each text (null: empty), padded."""
    name = free_name(df.columns, media)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    place = df.columns.index(text)
    def run(batches):
        for batch in batches:
            for part in slices(batch, place):
                files = [store(padded((t or "").encode())) for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())],
                                                 names=[f.name for f in schema.fields])

    return mapped(df, run, schema)


def digests(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: its text stored as TIFF, the stored bytes read back page by page, and digests of both.

    One narrow pass; the files stay in the worker.  A null text counts as empty: a payload of 576
    bytes 255.  Equal texts have equal values; rows pass one to one.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, k) for n, k in DIGEST)])

    def one(value: str | None):
        data = (value or "").encode()
        media = store(padded(data))
        pages = read(media)
        payload = b"".join(p.tobytes() for p in pages)
        return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), feature(pages))
    def run(batches):
        for batch in batches:
            for part in slices(batch, len(keys)):
                rows = [one(t) for t in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keys)],
                     *(pa.array([r[c] for r in rows], pa.string() if isinstance(k, T.StringType) else pa.int64())
                       for c, (_, k) in enumerate(DIGEST))], names=[f.name for f in schema.fields])

    return mapped(df.select(*keys, text), run, schema)
