"""Co-training, near-duplicates and the pipeline on small tables."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import cotraining, weighted_minhash as wm

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def prose(draw, n, junk=False):
    words = ["".join(draw.choice("aeioustrnl") for _ in range(draw.randint(2, 8))) for _ in range(n)]
    return " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words).capitalize() + "."


def corpus(n, seed=1):
    draw = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = draw.random() < 0.3
        text = prose(draw, draw.randint(5, 60), bad)
        source = draw.choice(["spam", "x"]) if bad else draw.choice(["x", "y", "z"])
        docs.append((k, text, "en", source, len(text)))
        labels.append((k, int(not bad), 0))
    return docs, labels


def test_classifier_on_rows_without_labels(spark):
    docs, labels = corpus(900)
    df = spark.createDataFrame(docs, DOCS)
    model = cotraining.fit(df, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"), labelled=300)
    out = {r["doc_id"]: r for r in cotraining.score(df, model).collect()}
    right = [out[k]["keep"] == bool(quality) for k, quality, _ in labels[300:]]
    assert np.mean(right) > 0.97 and model.held_out["both_accuracy"] > 0.9 and model.held_out["rows"] == 100
    spam = [out[k]["p_meta"] for k, _, _, source, _ in docs if source == "spam"]
    rest = [out[k]["p_meta"] for k, _, _, source, _ in docs if source == "y"]
    assert np.mean(spam) < np.mean(rest)


def two_views(draw, n, noise):
    """A pair of views of a class: one feature each that tells it but for noise, and others that do not."""
    y = draw.integers(0, 2, n)
    views = [np.concatenate([np.clip(y[:, None] * 0.6 + 0.2 + draw.normal(0, s, (n, 1)), 0, 1), draw.random((n, 20))], axis=1) for s in noise]
    return y, *(np.round(v * cotraining.FINE).astype(np.float32) / cotraining.FINE for v in views)


def test_each_view_helps_the_other():
    better = {0: [], 1: []}
    for seed in range(6):
        for weak in (0, 1):  # the other view is the sure one
            draw = np.random.Generator(np.random.PCG64(seed))
            noise = [0.05, 0.05]
            noise[weak] = 0.35
            y, a, b = two_views(draw, 4000, noise)
            alone = cotraining.cotrain(a[:90], b[:90], y[:90], a[:0], b[:0])
            helped = cotraining.cotrain(a[:90], b[:90], y[:90], a[90:2500], b[90:2500])
            views = lambda m: ((m.text, a), (m.meta, b))
            right = lambda m: ((views(m)[weak][0].raw(views(m)[weak][1][2500:]) > 0) == (y[2500:] == 1)).mean()
            assert min(helped.exchange[0][weak]) > 100
            better[weak].append(right(helped) - right(alone))
    assert np.mean(better[0]) > 0.02 and np.mean(better[1]) > 0.02


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    docs, labels = corpus(900, 5)
    marks = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    made = [cotraining.fit(spark.createDataFrame(docs, DOCS).repartition(n, key), marks, labelled=200) for n, key in ((1, "doc_id"), (7, "text"))]
    assert made[0].exchange == made[1].exchange and made[0].held_out == made[1].held_out
    assert np.array_equal(made[0].text.weights, made[1].text.weights) and np.array_equal(made[0].meta.weights, made[1].meta.weights)
    assert sum(map(sum, made[0].exchange[0])) > 300


def test_all_documents_are_offered_pseudo_labels(spark):
    docs, labels = corpus(900, 4)
    hashed = [r["id"] for r in spark.range(900).filter("id >= 300").orderBy(F.xxhash64("id").desc()).limit(60).collect()]
    draw = random.Random(8)
    for k in hashed:  # junk of a source that has no label, with the largest id hashes
        text = prose(draw, 60, True)
        docs[k] = (k, text, "en", "rare", len(text))
    df = spark.createDataFrame(docs, DOCS)
    model = cotraining.fit(df, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"), labelled=300)
    given = [sum(r[1]) for r in model.exchange]  # what the text view names, of 600 documents without label
    assert max(given) > 450


def test_confidence_follows_the_share_of_a_class():
    bar = cotraining.bars(np.array([1.0] * 90 + [0.0] * 10))
    p = {k: 1 / (1 + np.exp(-v)) for k, v in bar.items()}
    assert abs(p[1.0] - 0.98) < 1e-9 and abs(p[0.0] - 0.82) < 1e-9


def test_auc_is_that_of_all_pairs():
    draw = np.random.Generator(np.random.PCG64(3))
    p, y = np.round(draw.random(80), 1), draw.integers(0, 2, 80)
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert abs(cotraining.auc(p, y) - np.mean(pairs)) < 1e-12


def test_nulls_repeats_and_no_labels(spark):
    docs, labels = corpus(200)
    rows = [*docs, docs[0], (None, None, None, None, None), (777, "", None, "x", -1), (778, "long " * 30_000, "en", None, 2**31 - 1)]
    df = spark.createDataFrame([(*r, True) for r in rows], DOCS + ", keep boolean")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scored = cotraining.score(df, cotraining.fit(df, marks))
    assert scored.count() == len(rows) and scored.columns[-1] == "_keep" and scored.filter("p_quality IS NULL").count() == 0
    nothing = cotraining.fit(df, marks.limit(0))
    assert nothing.text is None and cotraining.score(df, nothing).filter("_keep").count() == len(rows)
    assert cotraining.score(df.limit(0), nothing).count() == 0


def brute_classes(texts: dict[int, str]):
    """Classes by all pairs of weighted Jaccard similarities over dictionaries."""
    total = len(texts)
    documents = defaultdict(int)
    for t in texts.values():
        for w in set(t.lower().split()):
            documents[w] += 1

    def vector(t):
        words = t.lower().split()
        out = defaultdict(float)
        for i in range(max(1, len(words) - 4) if words else 0):
            run = tuple(words[i:i + 5])
            out[run] += sum(1 + np.log1p(min(total / documents[w], wm.RARE)) / np.log1p(wm.RARE) for w in run) / len(run)
        return out

    vectors = {k: vector(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b:
                x, y = vectors[a], vectors[b]
                shared = sum(min(v, y[s]) for s, v in x.items() if s in y)
                both = sum(x.values()) + sum(y.values()) - shared
                if (shared / both if both else 1.0) >= wm.SIMILARITY:
                    i, j = sorted((find(a), find(b)))
                    root[j] = i
    return {k: find(k) for k in texts}


def test_classes_are_those_of_all_pairs(spark):
    draw = random.Random(3)
    texts = {}
    for g in range(25):
        base = prose(draw, draw.choice([3, 6, 30, 120])).split()
        for _ in range(draw.choice([1, 2, 6, 12])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 3])):
                words[draw.randrange(len(words))] = "edit" + str(draw.randrange(1000))
            texts[len(texts) * 3 + 1] = " ".join(words)
    texts |= {1000: "", 1001: " \n", 1002: "one", 1003: "ONE"}
    rows = [(k, t, "s") for k, t in texts.items()] + [(1004, None, "s"), (None, "x", "s"), (1, texts[1], "s")]
    out = wm.classes(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert got.pop(None) is None and got.pop(1004) == 1000
    assert got == brute_classes(texts)


def test_hot_group_of_near_copies_is_one_class(spark):
    draw = random.Random(5)
    base = prose(draw, 150).split()
    rows = []
    for k in range(250):
        words = list(base)
        for _ in range(draw.choice([1, 2, 4])):
            words[draw.randrange(150)] = f"edit{draw.randrange(10 ** 6)}"
        rows.append((k, " ".join(words)))
    rows += [(k, prose(draw, 100)) for k in range(250, 300)]
    got = {r["doc_id"]: r["class_id"] for r in wm.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute_classes(dict(rows))
    assert got == expected and 150 < sum(v == 0 for v in got.values()) < 250


def test_samples_agree_as_often_as_the_similarity():
    draw = np.random.Generator(np.random.PCG64(2))
    shingles = np.sort(draw.integers(0, 2**63, 400, dtype=np.uint64))
    a = draw.gamma(2, 1, 400).astype(np.float32)
    b = np.where(draw.random(400) < 0.3, a * draw.gamma(2, 0.5, 400), a).astype(np.float32)
    own = wm.signatures(np.array([400, 400]), np.concatenate([shingles, shingles]), np.concatenate([a, b]))
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((own[0] == own[1]).mean() - expected) < 0.15
    assert abs(wm.similarity((shingles, a), (shingles, b)) - expected) < 1e-5


def test_an_id_on_two_texts_ties_their_classes(spark):
    draw = random.Random(7)
    one, two = prose(draw, 40), prose(draw, 40)
    rows = [(1, one), (2, two), (3, one), (3, two)]
    got = {r["doc_id"]: r["class_id"] for r in wm.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_empty_corpus(spark):
    assert wm.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(260, 9)
    clean = next(d for d in docs if labels[d[0]][1] == 1 and len(d[1]) > 150)
    docs += [(900, clean[1], "en", "y", 5), (901, clean[1] + " card 4111111111111111", "en", "y", 5)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = frame
        assert k == 4 or frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in seen["quality classifier"].collect()}
    assert np.mean([(k in kept) == bool(q) for k, q, _ in labels]) > 0.95
    once = {r["doc_id"] for r in seen["near duplicates"].collect()}
    assert clean[0] in once and 900 not in once
    assert seen["personal data"].filter(F.col("text").contains("4111111111111111")).count() == 0
    assert seen["byte BPE"].count() == seen["source mixing"].count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["byte BPE"].count()
