"""Codebooks against Lloyd's rounds without bounds, whitening against numpy on whole tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from trackloom.llm import heap_lloyd, queries, whitening

INF, NAN = float("inf"), float("nan")


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Plain rounds over (id, vector, label) rows of one length: id, code, error, label error, digest."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    most = heap_lloyd.reach(len(rows[0][1]))
    cut = [[max(-most, min(most, math.floor(scale * x))) for x in r[1]] for r in rows]
    wide = -(-len(cut[0]) // parts)
    cut = [v + [0] * (parts * wide - len(v)) for v in cut]
    cut = [[v[p * wide:(p + 1) * wide] for p in range(parts)] for v in cut]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    sums = {}
    for r, f in zip(rows, found):
        sums[r[2]] = sums.get(r[2], 0) + sum(d for d, _ in f)
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[r[2]], digest) for r, f in zip(rows, found)), key=repr)


def table(draw, count, dims, spread=1.0):
    centres = [[draw.gauss(0, spread) for _ in range(dims)] for _ in range(9)]
    rows = [(k, [float(np.float32(c + draw.gauss(0, 0.2 * spread))) for c in draw.choice(centres)], draw.choice([1, 2, None])) for k in range(count)]
    rows += [(k, list(rows[k][1]), 3) for k in range(0, count, 7)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * (dims - 1) + [None], 1), (903, [NAN] * dims, 1), (904, [INF] + [0.0] * (dims - 1), 1), (905, [1.0] * (dims + 8), 1)]
    return rows, bad


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("count", "dims", "spread"), [(300, 16, 1.0), (700, 64, 0.1), (9, 8, 1.0), (40, 12, 1.0), (60, 8, 1e30), (1, 3, 1.0)])
def test_codes_are_those_of_plain_rounds(spark, count, dims, spread):
    rows, bad = table(random.Random(count), count, dims, spread)
    rows.append((None, list(rows[0][1]), None))
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in heap_lloyd.compressed(df).collect()), key=repr)
    assert found == lloyd(rows)


def test_equal_distances_go_to_the_lower_entry(spark):
    rows = [(k, [float(k % 3), 0.0] * 8, 1) for k in range(40)]
    found = sorted((tuple(r) for r in heap_lloyd.compressed(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert found == lloyd(rows)


def test_only_violated_parts_are_scanned():
    draw = np.random.Generator(np.random.PCG64(3))
    x = draw.integers(-4000, 4000, (2000, 2, 4))
    books = np.ascontiguousarray(x[:8].transpose(1, 0, 2))
    block = heap_lloyd.Block(x, 8)
    block.step(books, np.zeros((2, 8), np.int64))
    still = heap_lloyd.Block.read(block.written(np.zeros(1, np.int64)), 2, 4, 8)
    due, _ = still.due(0, [0] * 8)
    # without drift only ties and near-ties are due
    d = np.sort(np.sqrt(heap_lloyd.distances(x[:, 0], books[0]).astype(float)), 1)
    assert set(due.tolist()) <= set(np.flatnonzero(d[:, 1] - d[:, 0] < 0.02).tolist()) and len(due) < 20


def test_many_labels_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(heap_lloyd, "BROADCAST_LABELS", 1)
    df = spark.createDataFrame([(k % 3 or None, 2 ** 62) for k in range(30)], "label int, error long")
    rows = heap_lloyd.with_sums(df, "label", "error", "total").collect()
    assert len(rows) == 30 and {r["total"] for r in rows} == {2 ** 63 - 1}


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [NAN], 2)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert heap_lloyd.compressed(df).collect() == [] and whitening.whitened(df).collect() == []


def test_symmetric_qr_is_an_eigenbasis():
    draw = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 3, 10, 64):
        for rank in {n, max(1, n // 2)}:
            a = draw.normal(size=(n, rank))
            a = a @ a.T
            values, q = whitening.symmetric_qr(a)
            assert np.allclose(q @ q.T, np.eye(n), atol=1e-12) and np.allclose((q.T * values) @ q, a, atol=1e-10 * max(1, np.abs(a).max()))
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-9 * max(1.0, values[0]))
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([1.0, 3.0, 2.0])):
        values, q = whitening.symmetric_qr(a)
        assert np.allclose((q.T * values) @ q, a)


def test_merged_moments_are_those_of_the_whole():
    x = np.random.Generator(np.random.PCG64(2)).normal(1e6, 1, (500, 5))
    whole = whitening.Moments(5)
    for k in (0, 3, 3, 250, 500):
        part = whitening.Moments(5)
        part.add(x[whole.n:k])
        whole.merge(part)
    assert whole.n == 500 and np.allclose(whole.m2 / 500, np.cov(x.T, bias=True), rtol=1e-9)


@pytest.mark.parametrize(("count", "dims", "shift"), [(300, 6, 0.0), (700, 64, 50.0), (50, 3, 0.0), (2, 5, 0.0), (1, 4, 0.0)])
def test_whitened_rows(spark, count, dims, shift):
    rows, bad = table(random.Random(count), count, dims)
    rows = [(k, [x + shift for x in v], label) for k, v, label in rows]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(4)
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, sums, k = len(fit), fit.sum(0), min(4, dims)
    values, basis = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(dims, dims))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    some = values > 1e-9 * max(values[0], 1)
    found = whitening.whitened(df).collect()
    assert len(found) == len(rows) * k and {r["component"] for r in found} == set(range(1, k + 1)) and {r["n"] for r in found} == {n}
    own = {}
    for r in found:
        own.setdefault(r["vec_id"], {}).setdefault(r["component"], r)
    for (key, _, _), row in zip(rows, x):
        for c in range(k):
            r = own[key][c + 1]
            assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) and r["identity_error"] < 1e-8
            if some[c]:
                assert math.isclose(abs(r["whitened"]), abs((row - sums / n) @ basis[:, c]) / math.sqrt(values[c]), rel_tol=1e-6, abs_tol=1e-6)
                assert math.isclose(r["explained"], values[c] / np.trace(np.cov(fit.T.astype(float), bias=True).reshape(dims, dims)), rel_tol=1e-9)
            else:
                assert r["whitened"] is None


def test_deviations_beyond_a_long():
    x = np.array([[1 << 53, 0], [3, 4]])
    assert whitening.deviations(x, 10 ** 6, [5, 6]) == [None, (3 * 10 ** 6 - 5) ** 2 + (4 * 10 ** 6 - 6) ** 2]


def test_registered_queries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_heap_lloyd(spark, folder).collect()), key=repr) == lloyd(rows)
    white = queries.op13_whitening(spark, folder)
    assert white.count() == 4 * len(rows)
