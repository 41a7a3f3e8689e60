"""Pre-tokens, byte-level BPE and trie counts against a pattern, the tokeniser library and brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from trackloom.llm import byte_bpe, pretokens, trie_counts

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["'", "s", "re", "ll", "'ve", " ", "  ", "\n", "é", "1", "²", "!", "?", "　", "\t", "a", "中", "'d", "'t", "x", "😀", " '", "l", "́", "\x85"]


def texts(n: int, seed: int, most: int = 80) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_pieces_are_the_matches_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for given in (texts(3000, 1), ["a" * 1000, " " * 999, "", "'" * 700, "''s 'll", "\n\n a", "a'sb"], texts(20, 2, 5000)):
        data, cuts, counts = pretokens.split(given)
        bounds, at = cuts.tolist(), 0
        for text, n in zip(given, counts.tolist()):
            assert [data[a:b].decode() for a, b in zip(bounds[at:at + n], bounds[at + 1:at + n + 1])] == pattern.findall(text)
            at += n


def test_scan_of_functions_agrees_with_the_single_state_sweep(monkeypatch):
    given = texts(300, 3, 400)
    joined = "".join(given)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in given])
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    expected = pretokens.piece_starts(points, begins)
    monkeypatch.setattr(pretokens, "BLOCK", 4)  # so short that blocks keep several states open
    assert (pretokens.piece_starts(points, begins) == expected).all()


def test_every_code_point_is_classed_as_the_library_does():
    codec = byte_bpe.Codec(RANKS)
    given = [f"{side}{chr(c)}{side}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 for side in "a1"]
    assert [list(x) for x in codec.encode_batch(given[::7])] == [LIBRARY.encode_ordinary(t) for t in given[::7]]
    assert [list(x) for x in codec.encode_batch(given[:60000])] == [LIBRARY.encode_ordinary(t) for t in given[:60000]]


@pytest.mark.parametrize("piece", [b"", b"a", b"ab" * 5000, "中文".encode() * 100, bytes(range(256)), b"aaaaaaaaaaaaaaaa"])
def test_merges_are_the_librarys(piece):
    own = byte_bpe.merge_piece(piece, RANKS) if piece else []
    assert b"".join(byte_bpe.Codec(RANKS).tokens[i] for i in own) == piece
    if piece and piece.isascii() and piece.isalpha():
        assert own == LIBRARY.encode_ordinary(piece.decode())


def test_encode_and_decode_columns(spark):
    rows = [(1, "hello world's é", 7), (1, "hello world's é", 7), (2, None, 8), (3, "", None), (None, "x" * 300_000 + " y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS, "_token_ids").collect()
    assert [r["doc_id"] for r in out] == [r[0] for r in rows] and [r["token_ids"] for r in out] == [r[2] for r in rows]
    for r in out:
        assert r["_token_ids"] == LIBRARY.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    digests = byte_bpe.round_trip(df.drop("token_ids"), RANKS).collect()
    assert [d["decoded_sha256"] for d in digests] == [hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows]
    assert byte_bpe.encode(df.filter("doc_id = 99"), RANKS).count() == 0


def test_offsets_are_kept_for_decoding():
    codec = byte_bpe.Codec(RANKS)
    ids = next(codec.encode_batch(["naïve words"]))
    assert codec.offsets(ids)[0] == 0 and codec.offsets(ids)[-1] == len("naïve words".encode())
    text = "naïve 🙂 words, and more of them 123"
    ids, data = next(codec.encode_batch([text])), text.encode()
    offsets = codec.offsets(ids)
    for begin in range(-2, len(data) + 2):
        for end in range(begin, len(data) + 3):
            assert codec.decode_range(ids, offsets, begin, end) == data[max(0, begin):max(0, end)]
    assert codec.decode_range([], codec.offsets([]), 0, 5) == b""


@pytest.mark.parametrize("window", [1, 7, 1 << 16])
def test_round_trip_decodes_by_offsets(spark, monkeypatch, window):
    monkeypatch.setattr(byte_bpe, "WINDOW", window)
    texts = [None, "", "naïve 🙂 words", "a" * 500, "one two  three\n\n4567", "é" * 40]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in byte_bpe.round_trip(df, RANKS, ids=True).collect()}
    names = {i: b for b, i in RANKS.items()}
    for k, text in enumerate(texts):
        data, at = (text or "").encode(), [0]
        for i in found[k]["token_ids"]:
            assert data[at[-1]:at[-1] + len(names[i])] == names[i]
            at.append(at[-1] + len(names[i]))
        assert found[k]["decoded_sha256"] == hashlib.sha256(data).hexdigest() and at[-1] == len(data)
        assert found[k]["offsets_sha256"] == hashlib.sha256(b"".join(x.to_bytes(8, "little") for x in at)).hexdigest()


def test_offsets_column(spark):
    df = spark.createDataFrame([(1, "naïve words"), (2, None), (3, "")], "doc_id long, text string")
    for r in byte_bpe.encode(df, RANKS, offsets=True).collect():
        codec = byte_bpe.Codec(RANKS)
        assert r["token_offsets"] == codec.offsets(r["token_ids"])[:-1].tolist()


def brute_tokens(piece: bytes, scores: dict[bytes, float]) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        ways = [(-(best[s][0] + scores[piece[s:end]]), best[s][1] + 1) for s in range(end) if piece[s:end] in scores]
        top = min(ways)
        best.append((-top[0], top[1]))
    return best[-1][1]


def test_trie_counts_are_those_of_the_plain_programme(monkeypatch):
    scores = trie_counts.zipf_scores(RANKS)
    assert abs(sum(np.exp(list(scores.values()))) - 1) < 1e-6
    draw = random.Random(5)
    words = [bytes(draw.choice(b" thaonerqusiXZ\xc3\xa9") for _ in range(draw.randint(1, 90))) for _ in range(400)]
    counter = trie_counts.TrieCounter(scores)
    assert [counter.count(w) for w in words] == [brute_tokens(w, scores) for w in words]
    monkeypatch.setattr(trie_counts, "TRIE_NODES", 50)  # a trie that is cleared all the time
    assert [counter.count(w) for w in words] == [brute_tokens(w, scores) for w in words]


def test_trie_shares_prefixes():
    counter = trie_counts.TrieCounter(trie_counts.zipf_scores(RANKS))
    counter.count(b"international")
    nodes = len(counter.best)
    counter.count(b"internation")
    assert len(counter.best) == nodes


def test_token_count_column(spark):
    scores = trie_counts.zipf_scores(RANKS)
    rows = [(1, "some words here", 5), (2, None, 6), (3, "", 7), (1, "some words here", 5)]
    out = trie_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int"), scores).collect()
    pattern = regex.compile(public_tokenizers.PATTERN)
    for r in out:
        pieces = pattern.findall(r["text"] or "")
        assert r["_n_tokens"] == sum(brute_tokens(p.encode(), scores) for p in pieces) and r["n_pieces"] == len(pieces)
    assert trie_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), scores).count() == 0


def test_scores_must_cover_all_bytes():
    with pytest.raises(ValueError):
        trie_counts.TrieCounter({b"a": -1.0})


def test_long_pieces_share_the_trie():
    draw = random.Random(4)
    scores = trie_counts.zipf_scores({bytes([b]): b for b in range(256)} | {b"ab": 256, b"bca": 257, b"aaaa": 258, b"cab" * 5: 259})
    counter = trie_counts.TrieCounter(scores)
    for _ in range(200):
        piece = bytes(draw.choice(b"abc") for _ in range(draw.randint(60, 300)))
        assert counter.count(piece) == brute_tokens(piece, scores)
    assert max(map(len, counter.terminal), default=0) <= trie_counts.TRIE_BYTES < 300
