"""TIFF writing and reading: exact round trips, foreign layouts and broken files."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from trackloom.llm import tiff


@pytest.mark.parametrize("size", [0, 1, 2, 127, 128, 129, 5000, 70_000])
@pytest.mark.parametrize("letters", [1, 2, 5, 256])
def test_codecs_restore_bytes(size, letters):
    draw = random.Random(size * 1000 + letters)
    data = bytes(draw.randrange(letters) for _ in range(size))
    assert tiff.unpack_bits(tiff.pack_bits(data), size) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data
    for scheme in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        assert tiff.decompress(tiff.compress(data, scheme), scheme, size) == data


@pytest.mark.parametrize("layout", [
    tiff.Layout(tiff.NONE, 1, 7), tiff.Layout(tiff.PACKBITS, 2, 1000), tiff.Layout(tiff.LZW, 2, tile=(16, 32)),
    tiff.Layout(tiff.DEFLATE, 2, tile=(64, 16)), tiff.Layout(tiff.DEFLATE, 1, 1)])
def test_pages_come_back(layout):
    image = np.random.Generator(np.random.PCG64(4)).integers(0, 256, (45, 70), dtype=np.uint8)
    other = np.tile(np.arange(30, dtype=np.uint8), (3, 1))
    pages = tiff.read(tiff.write([(image, layout), (other, tiff.Layout())]))
    assert (pages[0] == image).all() and (pages[1] == other).all()


def test_big_endian_file_by_hand():
    data = b"\x01\x02\x03\x04\x05\x06"
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 6)]
    file = struct.pack(">2sHI", b"MM", 42, 14) + data + struct.pack(">H", len(tags))
    for tag, kind, value in tags:
        file += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    pages = tiff.read(file + struct.pack(">I", 0))
    assert len(pages) == 1 and pages[0].tolist() == [[1, 2, 3], [4, 5, 6]]


def test_read_pages_rows(spark):
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    good = tiff.write([(image, tiff.Layout()), (image + 1, tiff.Layout(tiff.LZW))])
    cyclic = bytearray(good)
    struct.pack_into("<I", cyclic, len(good) - 4, struct.unpack_from("<I", good, 4)[0])
    rows = [(1, good), (1, good), (2, None), (3, b"no file"), (4, bytes(cyclic)), (5, good[:60])]
    out = tiff.read_pages(spark.createDataFrame(rows, "page long, media binary"), "media", ["page"]).collect()
    by = {}
    for r in out:
        by.setdefault(r["page"], []).append(r)
    assert [r["_page"] for r in by[1]] == [0, 1, 0, 1] and bytes(by[1][0]["pixels"]) == image.tobytes()
    assert 2 not in by and by[3][0]["error"] == "not a TIFF file" and by[3][0]["pixels"] is None
    assert len(by[4]) == 3 and by[4][2]["error"] and by[5][-1]["error"]
    assert tiff.read_pages(spark.createDataFrame([], "k long, media binary"), "media", ["k"]).count() == 0


def test_digests(spark):
    long = "xyz é " * 40_000
    rows = [(1, "abc"), (2, None), (3, ""), (4, long), (5, "abc")]
    out = {r["doc_id"]: r for r in tiff.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        payload = tiff.padded((text or "").encode())
        assert len(payload) % 576 == 0 and out[doc_id]["payload_bytes"] == len(payload) and out[doc_id]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert out[1]["media_sha256"] == out[5]["media_sha256"] and out[2]["feature"] == out[3]["feature"]
    assert int(out[4]["feature"].split(";")[0]) == len(tiff.read(tiff.store(tiff.padded(long.encode())))) > 4
    stored = tiff.stored_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert tiff.read_pages(stored, "media", ["doc_id"]).filter("error IS NOT NULL").count() == 0
