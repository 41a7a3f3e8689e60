"""Mixing, sharding, personal data, fingerprints and reply trees against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trackloom.llm import frames, kd_shards, mixing, one_permutation, personal_data, reply_trees


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ranks

def test_ranks_have_no_gaps_even_in_one_large_group(spark):
    df = spark.range(500).select(F.lit("hot").alias("g"), F.col("id"), (F.col("id") % 7).alias("part"))
    out = rows_of(frames.ranked(df, ["g"], "part", ["id"], "rank"))
    assert sorted(r["rank"] for r in out) == list(range(500))
    assert [r["part"] for r in sorted(out, key=lambda r: r["rank"])] == sorted(r["part"] for r in out)


# mixing

def brute_targets(sizes, cycle=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    total, left, out = sum(sizes.values()), set(order), {}
    rest = float(total)
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            left.discard(s)
    return out


def test_targets_are_those_of_repeated_sharing(spark):
    draw = random.Random(1)
    for k in range(4):
        sizes = {f"s{i}": draw.choice([0, 1, 5, 100, 10_000]) for i in range(9)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in rows_of(mixing.targets(df, "source", "size"))}
        expected = brute_targets(sizes)
        assert all(abs(got[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in sizes), k


def test_mix_emits_once_per_boundary(spark):
    draw = random.Random(2)
    docs = [(i, draw.choice(["a", "b", None, "c"]), "w " * draw.choice([0, 1, 10, 40]), i % 3) for i in range(800)]
    df = spark.createDataFrame([*docs, docs[5], (None, "a", None, 1)], "doc_id long, source string, text string, mix_size int")
    out = rows_of(mixing.mix(df, "source", mixing.words(F.col("text")), "doc_id", splits=8))
    assert len(out) == 802 and all(r["mix_copies"] <= 3 for r in out)
    again = rows_of(mixing.mix(df.repartition(7), "source", mixing.words(F.col("text")), "doc_id", splits=8))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["mix_copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    for source in ("a", "b", None, "c"):
        own = [r for r in out if r["source"] == source]
        taken = sum(r["_mix_size"] * r["mix_copies"] for r in own)
        assert abs(taken - own[0]["mix_target"]) <= 60, (source, taken, own[0]["mix_target"])
        assert abs(sum(r["mix_copies"] for r in own) - len(own) * own[0]["mix_target"] / own[0]["mix_source_size"]) <= 1
    emitted = mixing.emitted(mixing.mix(df, "source", mixing.words(F.col("text")), "doc_id", splits=8), df.columns)
    assert emitted.count() == sum(r["mix_copies"] for r in out) and emitted.columns == df.columns
    assert mixing.mix(df.limit(0), "source", mixing.words(F.col("text")), "doc_id").count() == 0


def shuffles_of(df, column) -> int:
    """How many exchanges of the plan carry a column."""
    def visit(node):
        below = [node.children().apply(k) for k in range(node.children().size())]
        output = node.output()
        names = [output.apply(k).name() for k in range(output.size())]
        return (node.nodeName() == "Exchange" and column in names) + sum(map(visit, below))

    return visit(df._jdf.queryExecution().executedPlan())


def test_mix_shuffles_texts_once(spark):
    """What belongs to a source meets the offsets: texts never go to one task per source."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.createDataFrame([(i, f"s{i % 2}", f"some words {i}") for i in range(20)], "doc_id long, source string, text string")
        assert shuffles_of(mixing.emitted(mixing.mix(df, "source", mixing.words(F.col("text")), "doc_id"), df.columns), "text") == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


# sharding

def test_shards_balance_bytes_and_number_rows(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 5, 50, 900]), "hot" if i % 3 else f"s{i % 11}", None if i % 50 == 0 else i % 4) for i in range(4000)]
    rows += [(7, 900, "hot", 1)] * 20
    df = spark.createDataFrame(rows, "shard long, bytes long, source string, lang long")
    dims = {"bytes": F.col("bytes"), "source": kd_shards.coded(F.col("source")), "lang": F.col("lang")}
    out = rows_of(kd_shards.shard(df, F.col("bytes"), F.col("shard"), dims, 16, ["shard"]))
    assert len(out) == len(rows)
    sums = [sum(r["size"] for r in out if r["_shard"] == s) for s in range(16)]
    # repeated rows share a tie: at most their bytes, and a row per level, go astray
    assert max(sums) - min(sums) <= 20 * 900 + 4 * 900 and min(sums) > 0
    for s in range(16):
        assert sorted(r["slot"] for r in out if r["_shard"] == s) == list(range(sum(r["_shard"] == s for r in out)))


def test_one_value_may_hold_all_rows(spark):
    df = spark.range(3000).select(F.col("id"), F.lit(10).alias("bytes"), F.lit("x").alias("source"))
    dims = {"bytes": F.col("bytes"), "source": kd_shards.coded(F.col("source"))}
    out = kd_shards.shard(df, F.col("bytes"), F.col("id"), dims, 8, ["id"]).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(out) == 8 and max(r["n"] for r in out) - min(r["n"] for r in out) <= 40


def test_target_bytes_set_the_depth(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(10).alias("bytes"))
    for target, leaves in ((10_000, 1), (9_999, 2), (2_500, 4), (2_000, 8)):
        out = kd_shards.shard(df, F.col("bytes"), F.col("id"), {"id": F.col("id")}, None, ["id"], target_bytes=target)
        assert out.select("shard").distinct().count() == leaves


@pytest.mark.parametrize(("planned", "leaves"), [(1024, 5), (0, 4)])
def test_splits_in_tables(spark, monkeypatch, planned, leaves):
    """Any number of leaves, with hot values, ids at both ends of long, nulls and repeated rows."""
    monkeypatch.setattr(kd_shards, "PLANNED", planned)
    draw = random.Random(8)
    rows = [(draw.choice([-2**63, 2**63 - 1, 5, 5, 5, draw.randint(-2**63, 2**63 - 1)]), i % 7 or None, draw.choice([1, 5, 90]), i) for i in range(3000)]
    rows += [(5, 1, 90, 7)] * 5
    df = spark.createDataFrame(rows, "wide long, few long, bytes long, id long")
    out = rows_of(kd_shards.shard(df, F.col("bytes"), F.col("id"), {"wide": F.col("wide"), "few": F.col("few")}, leaves, ["wide", "few", "id"]))
    assert len(out) == len(rows)
    sums = [sum(r["size"] for r in out if r["shard"] == s) for s in range(leaves)]
    assert max(sums) - min(sums) <= 5 * 90 + 3 * 2 * 90
    for s in range(leaves):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    places = {}
    for r in out:
        places.setdefault((r["wide"], r["few"], r["id"], r["size"]), set()).add(r["shard"])
    assert all(len(p) == 1 for p in places.values())


def test_splits_are_weighted_medians(spark):
    draw = random.Random(4)
    rows = [(draw.choice([1, 3, 9]), draw.randrange(1 << 20), draw.randrange(50), draw.randrange(10 ** 12)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "size long, tie long, a long, b long").cache()
    _, splits = kd_shards.tree(df, ["a", "b"], 2)
    s = splits[1]
    k = {"a": 2, "b": 3}[s.dimension]
    left = sum(r[0] for r in rows if (r[k], r[1]) < (s.value, s.tie))
    assert abs(left - sum(r[0] for r in rows) / 2) <= 10


def test_ids_at_both_ends_of_long(spark):
    draw = random.Random(2)
    ids = [-2**63, 2**63 - 1, -2**63 + 1, 2**63 - 2, *(draw.randint(-2**63, 2**63 - 1) for _ in range(400))]
    df = spark.createDataFrame([(i, 10) for i in ids], "doc_id long, octets long")
    out = rows_of(kd_shards.shard(df, F.col("octets"), F.col("doc_id"), {"doc_id": F.col("doc_id")}, 4, ["doc_id"]))
    held = {k: [r["doc_id"] for r in out if r["shard"] == k] for k in range(4)}
    assert len(out) == len(ids) and all(abs(len(v) - len(ids) / 4) <= 1 for v in held.values())
    assert all(max(held[k]) < min(held[k + 1]) for k in range(3))


def test_empty_table_has_no_shards(spark):
    df = spark.createDataFrame([], "id long, bytes long")
    assert kd_shards.shard(df, F.col("bytes"), F.col("id"), {"bytes": F.col("bytes")}, 4, ["id"]).count() == 0


# personal data

def luhn(number):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(number)))) % 10 == 0


CHECKED = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute_base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx, ok in CHECKED for m in re.finditer(rx, text) if ok(m[0])]


def test_base_spans_are_the_patterns(spark):
    draw = random.Random(6)
    parts = ["a@b.cd", "x_y@mail.example.com", ".", "@", "é", "😀", " ", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111",
             "+1 (743) 555-3824", "+", "12", "-", "%", "007.08.1.255", "\n", "a", "5500-0000-0000-0004", "@x.y", "1.2.3"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(1500)]
    texts += ["", "9" * 50_000, "a" * 50_000, "+1" * 2000, "1." * 3000, "a@" * 3000, "4111111111111111 " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.expr(personal_data.base("text")).alias("b")).select("id", personal_data.listed("b").alias("s"))
    for r in df.collect():
        assert r["s"] == ",".join(brute_base(texts[r["id"]])), texts[r["id"]]


def test_trees_learn_and_calibrate():
    good = {"kind": 2, "digits": 6, "marks": 0, "checked": 1, "before": 1, "after": 1, "cue": 0}
    bad = good | {"checked": 0}
    model = personal_data.boost([(good, 90.0, 1.0), (bad, 2.0, 400.0)])
    assert model.value(good) > 1 > -1 > model.value(bad)
    fitted = personal_data.calibrated(model, [(good, 60.0, 0.0), (bad, 0.0, 100.0)], 0.98, 20)
    assert model.value(bad) < fitted.threshold <= model.value(good)
    assert personal_data.calibrated(model, [(good, 5.0, 0.0)], 0.98, 20).threshold == float("inf")
    assert personal_data.boost([(good, 3.0, 0.0)]).threshold == float("inf")


def number(k):
    body = f"4{k:014d}"
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def test_method_adds_spans_and_leaves_clean_texts(spark):
    rows = [(k, f"some words {number(k)} and more") for k in range(300)] + [(k, f"order {k} of 1234567890123456 pieces {k * 7}") for k in range(300, 900)]
    rows += [(1000, f"two cards {number(5)} {number(6)} here"), (1001, None), (1002, ""), (1003, "nothing at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal_data.fit(df)
    out = personal_data.analysed(df, "text", model)
    spans = {r["doc_id"]: r["s"] for r in out.select("doc_id", personal_data.listed("all_spans").alias("s")).collect()}
    assert all(set(brute_base(t or "")) <= set(spans[k].split(",")) for k, t in rows)
    assert spans[1000] == "card:10:26,card:27:43" and spans[1001] == spans[1002] == spans[1003] == ""
    assert all(spans[k] == "" for k in range(300, 900))
    clean = {r["doc_id"]: r["t"] for r in out.select("doc_id", personal_data.redacted("text", "all_spans").alias("t")).collect()}
    assert clean[1000] == "two cards [CARD] [CARD] here" and clean[1001] is None and clean[1003] == "nothing at all" and clean[3] == "some words [CARD] and more"


def test_rewritten_spans_are_found_in_documents(spark):
    """Base spans of the documents in forms of this test's own, in their context: what share is found, what else is added."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"]]
    models = personal_data.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert all(f["recall"] >= 0.9 and f["precision"] >= 0.9 for f in models.figures.values()), models.figures
    forms = {"email": lambda v: v.replace("@", "[at]").replace(".", " (dot) "), "ip": lambda v: v.replace(".", "[.]"),
             "card": lambda v: "/".join((v[:4], v[4:8], v[8:12], v[12:])), "phone": lambda v: v.lstrip("+").replace(" ", ".")}
    planted = []
    for _, text in docs:
        for span in brute_base(text):
            kind, start, end = span.split(":")
            value = forms[kind](text[int(start):int(end)])
            planted.append((text[:int(start)] + value + text[int(end):], f"{kind}:{start}:{int(start) + len(value)}"))
    out = personal_data.analysed(spark.createDataFrame(planted, "text string, expected string"), "text", models)
    rows = out.select("expected", personal_data.listed("all_spans").alias("s"), personal_data.listed("base_spans").alias("b")).collect()
    hit = [r["expected"] in r["s"].split(",") for r in rows]
    assert len(rows) > 50 and sum(hit) >= 0.9 * len(rows)
    added = [x for r in rows for x in r["s"].split(",") if x and x not in r["b"].split(",")]
    assert sum(hit) >= 0.9 * len(added)


def test_added_spans_overlap_nothing_and_long_texts_stay_linear(spark):
    import time

    draw = random.Random(12)
    parts = ["a@b.com ", "x (at) y (dot) org ", "1.2.3.4 ", "9[.]8[.]7[.]6 ", "+1 555 123-4567 ", "tel 555-123-4567 ", number(3) + " ", "/".join((number(4)[:8], number(4)[8:])) + " ", "word ", "é "]
    rows = [(k, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = personal_data.fit(df)
    assert all(m.threshold < float("inf") for m in models.kinds)
    for r in personal_data.analysed(df, "text", models).select("text", personal_data.listed("base_spans").alias("b"), personal_data.listed("all_spans").alias("s"),
                                                               personal_data.redacted("text", "all_spans").alias("clean")).collect():
        known = brute_base(r["text"])
        assert r["b"].split(",") == known or known == []
        every = [(k, int(a), int(e)) for k, a, e in (x.split(":") for x in r["s"].split(",") if x)]
        more = [x for x in every if "%s:%d:%d" % x not in known]
        assert len(every) == len(set(every)) and every == sorted(every, key=lambda x: (personal_data.KINDS.index(x[0]), x[1], x[2]))
        for x in more:
            assert not any(y != x and x[1] < y[2] and y[1] < x[2] for y in every), (r["text"], x)
        clean, at = [], 0
        for kind, start, end in sorted(every, key=lambda x: (x[1], x[2], personal_data.KINDS.index(x[0]))):
            if end > at:
                clean += [r["text"][at:max(at, start)], f"[{kind.upper()}]"]
                at = end
        assert r["clean"] == "".join(clean) + r["text"][at:]
    long = spark.createDataFrame([(" ".join(f"a{k}@b.com" for k in range(20_000)),)], "text string")
    began = time.perf_counter()
    found = personal_data.analysed(long, "text", models).select(F.size("all_spans").alias("n"), personal_data.redacted("text", "all_spans").alias("t")).first()
    assert found["n"] == 20_000 and found["t"] == " ".join(["[EMAIL]"] * 20_000) and time.perf_counter() - began < 60


def test_forms_that_base_lacks_are_returned(spark):
    forms = {
        "email": ["ann{0} (at) mail{0} (dot) com", "bob{0}[at]site{0}[dot]org", "joe{0} @host{0}.com"],
        "ip": ["10[.]{1}[.]3[.]{1}", "10(.){1}(.)3(.)7"],
        "phone": ["555-{2}-4567", "(555) {2}-4567"],
    }
    leads = {"email": "write to ", "ip": "seen from ", "phone": "please call "}
    rows = [(kind, f"{leads[kind]}", form.format(k, k % 256, 100 + k % 900)) for k in range(300) for kind in forms for form in forms[kind]]
    rows += [("email", "write to ", f"x{k}@plain.example.com") for k in range(300)] + [("phone", "ring ", f"+1 (555) {100 + k}-4567") for k in range(300)]
    clean = [f"table {2000 + k} 300-{100 + k}-4567 row" for k in range(300)] + [f"see you @ home{k}. Then we go" for k in range(300)]
    clean += [f"build 300[.]{300 + k}[.]1[.]2 done" for k in range(300)]
    docs = [(k, lead + span + ". Then more", f"{kind}:{len(lead)}:{len(lead + span)}") for k, (kind, lead, span) in enumerate(rows)]
    docs += [(len(docs) + k, t, "") for k, t in enumerate(clean)]
    df = spark.createDataFrame(docs, "doc_id long, text string, expected string")
    models = personal_data.fit(df)
    out = personal_data.analysed(df, "text", models).select("text", "expected", personal_data.listed("all_spans").alias("s")).collect()
    assert [(r["text"], r["s"]) for r in out if r["s"] != r["expected"]] == []


def test_no_candidates_no_model(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.fit(df).threshold == float("inf")


# fingerprints

def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_fingerprints_estimate_jaccard(spark):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 3, 8, 60, 400, 2000]))) for _ in range(60)]
    texts += [texts[-1], None, "é 😀 " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in one_permutation.compared(df, parts=5).collect()}
    assert len(out) == len(texts)
    errors = []
    for k, text in enumerate(texts):
        own, following = text or "", texts[k - 1] or ""
        part = len(own) // 3
        edited = own[:len(own) - part] + following[:part]
        assert out[k]["n_chars"] == len(own) and out[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = shingles(own), shingles(other)
            errors.append(out[k][name] - len(a & b) / len(a | b))
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors) / len(errors)) < 0.02
    assert out[60]["fingerprint"] == out[59]["fingerprint"]


def test_next_rows_over_gaps_and_repeats(spark):
    ids = [5, 5, 1, 900, 901, 10 ** 12, -7, 2**63 - 1, -2**63]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    ordered = sorted(((i, f"t{k}") for k, i in enumerate(ids)))
    expected = {ordered[k]: ordered[k - 1][1] for k in range(len(ordered))}
    for parts in (1, 3, 50):
        got = one_permutation.with_next(df, "doc_id", ["text"], parts).collect()
        assert {(r["doc_id"], r["text"]): r["next_text"] for r in got} == expected
        # null ids stand below all others
        more = df.unionByName(spark.createDataFrame([(None, "n1"), (None, "n2")], df.schema))
        got = {(r["doc_id"], r["text"]): r["next_text"] for r in one_permutation.with_next(more, "doc_id", ["text"], parts).collect()}
        assert got[None, "n1"] == expected[-2**63, "t8"] and got[None, "n2"] == "n1" and got[-2**63, "t8"] == "n2"


def test_ranges_of_ids_hold_as_many_rows(spark):
    # all but one id lie close together, far from the last: ranges of equal width would hold them all in one
    df = spark.range(2000).select("id", F.lit("t").alias("text")).unionByName(spark.createDataFrame([(2**62, "t")], "id long, text string"))
    plan = one_permutation.with_next(df, "id", ["text"], 20)
    largest = plan.groupBy(F.expr("id div 100")).count().agg(F.max("count")).first()[0]
    assert plan.count() == 2001 and largest == 100
    bounds = df.agg(F.expr("percentile_approx(id, array(0.05D, 0.5D, 0.95D), 10000)")).first()[0]
    assert bounds == [100, 1000, 1900]


def test_next_of_a_single_row(spark):
    df = spark.createDataFrame([(900, "t3")], "doc_id long, text string")
    single = one_permutation.with_next(df, "doc_id", ["text"], 8).collect()
    assert [r["next_text"] for r in single] == ["t3"]
    assert one_permutation.compared(df.limit(0)).count() == 0


# reply trees

def test_escapes_are_reversible(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice(["\\", "<", "[", "l", "b", "n", "\n", "</turn>", "<turn>", "é"]) for _ in range(draw.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", reply_trees.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", reply_trees.unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and "<" not in r["e"] and "[" not in r["e"]


def test_paths_branches_and_masks(spark):
    rows = [("t", 1, None, "user", "q<turn>", 1.0), ("t", 2, 1, "assistant", "a\\l", 0.1), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "us\ner", None, 0.9),
            ("t", 5, 4, "assistant", "", None), ("u", 1, 99, None, "orphan", None), ("c", 1, 2, "user", "x", None), ("c", 2, 1, "user", "y", None),
            ("c", 3, 2, "user", "z", None), (None, 1, None, "user", "x", None)]
    rows += [("deep", k, k - 1 if k else None, "assistant" if k % 2 else "user", f"m{k}", None) for k in range(150)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = reply_trees.conversations(df).withColumn("turns", reply_trees.turns_of(F.col("formatted"))).withColumn(
        "loss", reply_trees.under_mask(F.col("formatted"), F.col("loss_spans"))).collect()
    by = {(r["tree"], r["leaf"]): r for r in out}
    assert {k for k in by if k[0] != "c"} == {("t", 2), ("t", 5), ("u", 1), ("deep", 149), (None, 1)}
    assert [tuple(x) for x in by["t", 5]["turns"]] == [("user", "q<turn>"), ("assistant", "b"), ("us\ner", ""), ("assistant", "")]
    assert by["t", 5]["loss"] == "b" and by["t", 2]["loss"] == "a\\l" and [tuple(x) for x in by["u", 1]["turns"]] == [("", "orphan")]
    assert by["deep", 149]["loss"] == "".join(f"m{k}" for k in range(1, 150, 2)) and len(by["deep", 149]["turns"]) == 150
    assert by["t", 5]["branch"] == 1 and by["t", 2]["branch"] == 2
    best = reply_trees.conversations(df.filter("tree = 't'"), branches=1).collect()
    assert [r["leaf"] for r in best] == [5]
    assert reply_trees.conversations(df.limit(0)).count() == 0


def test_chained_turns_keep_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = reply_trees.conversations(reply_trees.chained(df, "conv_id", "turn")).select(reply_trees.turns_of(F.col("formatted")).alias("t")).collect()
    assert [tuple(x) for x in made[0]["t"]] == [("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "")]


def test_null_tree_is_a_tree_and_branches_are_ranked_before_paths(spark):
    rows = [(None, 1, None, "user", "a", 1.0), (None, 2, 1, "assistant", "b", 0.0), (7, 1, None, "user", "c", None), (7, None, 1, "user", "lost", 5.0)]
    out = {r["tree"]: r for r in reply_trees.conversations(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")).collect()}
    assert set(out) == {None, 7} and out[None]["score"] == 0.5 and out[None]["formatted"].count("<turn>") == 2
    # a comb: a spine of messages, each with a leaf of its own; and a cycle, under which nothing is a path
    comb = [("c", k, k - 1 if k else None, "user", f"s{k}", float(k % 7)) for k in range(120)]
    comb += [("c", 1000 + k, k, "assistant", f"l{k}", float((k * 31) % 11)) for k in range(120)]
    comb += [("c", 5000, 5001, "user", "x", 99.0), ("c", 5001, 5000, "user", "y", 99.0), ("c", 5002, 5001, "user", "z", 99.0)]
    df = spark.createDataFrame(comb, "tree string, node long, parent long, role string, text string, score double")
    parent, score = {n: p for _, n, p, _, _, _ in comb}, {n: x for _, n, _, _, _, x in comb}

    def mean(n):
        seen = []
        while n is not None:
            seen.append(score[n])
            n = parent[n]
        return sum(seen) / len(seen)

    inner = {p for p in parent.values()}
    expected = sorted(((-mean(n), n) for n in parent if n not in inner and n < 5000))[:5]
    best = sorted(reply_trees.conversations(df, branches=5).collect(), key=lambda r: r["branch"])
    assert [r["leaf"] for r in best] == [n for _, n in expected]
    assert all(abs(r["score"] + m) < 1e-9 for r, (m, _) in zip(best, expected))


def test_masks_of_long_conversations_stay_linear(spark):
    import time

    rows = [(1, k, "assistant" if k % 2 else "user", f"turn <{k}>") for k in range(4000)]
    messages = reply_trees.chained(spark.createDataFrame(rows, "c long, turn int, role string, text string"), "c", "turn")
    began = time.perf_counter()
    out = reply_trees.conversations(messages).select(reply_trees.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert out["m"] == "".join(t for _, k, _, t in rows if k % 2) and time.perf_counter() - began < 100


#: Lines with numbers and words that are nobody's; fitting never sees their like but for some kinds of numbers.
HARMLESS = [
    "ISBN 978-3-16-148410-0 is a placeholder", "the debt is 1 000 000 000 euros", "lat 48.8566 2.3522 near the river", "years 1990 1991 1992 1993 were dry", "row 100 200 300 400 500 of the table",
    "invoice 2024 0015 7781 was paid", "meet at noon dot com was a pun", "card 4111 1111 1111 1112 fails its check", "version 2.10.3.1204 of the tool", "the ratio is 0.123456789012 or so",
    "ISSN 0317-8471 and 1050-124X", "CAS 7732-18-5 is water", "pi is 3.14159265358979", "lottery 04 11 19 23 38 42 07", "population 67 391 582 in 2020", "from 1914-1918 and 1939-1945",
    "at 12:30:45 and 23:59:59 it rang", "between 10:15 - 11:45 on 03.04.2021", "score 21-19 18-21 15-13 in the end", "part no. 8872 4410 2291 x", "serial 00012345678 printed", "barcode 4006381333931 scanned",
    "tracking 9400 1000 0000 0000 0000 00", "add 250 ml, 500 g and 1500 g", "sizes 38 39 40 41 42 43 44", "coordinates 40.7128, -74.0060", "ids 10001 10002 10003 10004", "on 2021-03-04 2021-03-05 2021-03-06",
    "EUR 12.500.000,00 were granted", "USD 3,456,789,012 in total", "page 112-118, 230-245 and 301", "flight 1234 at gate 56 row 78 90", "1 2 3 4 5 6 7 8 9 10 11 12", "the matrix 11 12 13 21 22 23 31 32 33",
    "chapters 1.2.3 and 4.5.6 and 7.8.9", "look at this dot or that one", "arrive at berlin dot then rest", "half at home dot half at work", "DOI 10.1000/182 and 10.1038/171737", "hash 8843d7f92416211de9ebb963ff4ce281",
    "zip 75001 75002 75003 75004", "binary 01010101 10101010 11110000", "a run of 12345678901234567890", "seats 120-140-160 in rows", "temperatures -12 -8 -3 0 4 9 15", "article 1240 1241 1242 code",
    "the sum 999 999 999 999 is wrong", "in 2019/2020 and 2020/2021", "unix time 1700000000 passed", "sequence 1123581321345589",
]
#: Personal data in forms that neither base patterns match nor fitting rewrites them into.
FORMS = [
    "write to bob AT example DOT com soon", "contact: anna.lee at mail dot example dot org", "ping jo_hn(AT)site(DOT)net", "mail me: kim {at} host {dot} org", "x.y [ at ] z [ dot ] com works", "reach sam99 AT corp.example.com",
    "server 10 . 1 . 2 . 3 is up", "host 10{.}1{.}2{.}3 down", "from 192(DOT)168(DOT)7(DOT)9 again", "at 172 [.] 16 [.] 0 [.] 44", "node 8 dot 8 dot 4 dot 4 answers", "ip 203{dot}0{dot}113{dot}7",
    "card 4111  1111  1111  1111 ok", "pay 4111 - 1111 - 1111 - 1111", "visa 5500,0000,0000,0004 used", "num 4012:8888:8888:1881", "use 6011_1111_1111_1117 today", "try 5105.1051.0510.5100 now",
    "tel 555 867 5309 ext", "call 0171 234 5678 today", "phone: 0049 30 1234567", "fax 030/1234567-89", "mobile (0151) 23456789", "dial 1-800-555-0199", "ring (212) 555-0187 now", "whatsapp 00447911123456",
]


def test_harmless_lines_stay_and_foreign_forms_are_found(spark):
    """At most one of fifty harmless lines gets a span; nine of ten foreign forms do, and redaction leaves lines without a span alone."""
    models = personal_data.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    df = spark.createDataFrame([(line, True) for line in HARMLESS] + [(line, False) for line in FORMS], "text string, harmless boolean")
    rows = personal_data.analysed(df, "text", models).select("text", "harmless", F.size("all_spans").alias("n"), F.size("base_spans").alias("b"),
                                                              personal_data.redacted("text", "all_spans").alias("clean")).collect()
    assert sum(r["n"] > 0 for r in rows if r["harmless"]) <= len(HARMLESS) // 50
    assert all(r["b"] == 0 for r in rows) and sum(r["n"] > 0 for r in rows if not r["harmless"]) >= 0.9 * len(FORMS)
    assert all(r["clean"] == r["text"] for r in rows if not r["n"])
