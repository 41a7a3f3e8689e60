"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles: a shingle weighs its count in the text times the mean
inverse document frequency of its words.  Signatures sample the set so that two texts agree at a place
with the probability of their weighted Jaccard similarity; banded signatures propose candidates, and
the exact similarity of the two texts decides.

Texts that agree in a band meet in a bucket.  A bucket of n texts may join n * n / 2 pairs, but classes
are wanted, not pairs: in each round every bucket compares its members with one of them, drawn anew,
and what is linked is merged; only buckets that still hold several classes go on.  What these rounds
leave apart in a bucket is then joined exactly, by the prefixes of the shingles, so that no link between
classes is lost and no group is compared pair by pair.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.byte_bpe import slices
from trackloom.llm.frames import cut
from trackloom.llm.pretokens import in_groups
from trackloom.llm.workers import mapped

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair is missed with a probability of (1 - 0.8^4)^20, 3 in 100,000.
BANDS, ROWS = 20, 4
#: Words in fewer than 1 / RARE of the documents share one inverse document frequency: the table of the
#: others has at most RARE times the mean number of distinct words of a document, whatever the corpus.
RARE = 4096
ROUNDS = 3
#: Tables of ids are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
TASK_WORDS = 150_000
#: Code points of texts that are signed together: their arrays stay in a core's cache.
GROUP = 500_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors by which the words of a shingle are told apart by place.
_FACTORS = np.array([3, 5, 7, 11, 13], dtype=np.uint64) * _STEP | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Lexicon:
    """Inverse document frequencies by word hash, between 1 and 2; see RARE."""

    def __init__(self, hashes: np.ndarray, documents: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = np.minimum(total / np.maximum(1, documents[order]), RARE)
        self.values = (1 + np.log1p(share) / np.log1p(RARE)).astype(np.float32)

    def of(self, hashed: np.ndarray) -> np.ndarray:
        """The values of word hashes; 2 for those that the table lacks."""
        at = np.searchsorted(self.hashes, hashed)
        at[at == len(self.hashes)] = 0
        if not len(self.hashes):
            return np.full(len(hashed), 2, dtype=np.float32)
        return np.where(self.hashes[at] == hashed, self.values[at], np.float32(2))


class Words(dict):
    """Places of words in columns of their hashes and inverse document frequencies.

    The columns grow in steps, so that a batch costs what its own words cost, not what is held.
    """

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.new: list[str] = []
        self.hashes = np.zeros(1 << 12, dtype=np.uint64)
        self.values = np.zeros(1 << 12, dtype=np.float32)

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place

    def begin(self) -> None:
        """Before a batch: what is held starts anew when it is too much."""
        if len(self) > TASK_WORDS:
            self.clear()

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and values by place, those of new words made at once."""
        if self.new:
            size = len(self)
            if size > len(self.hashes):
                more = max(size, 2 * len(self.hashes))
                self.hashes = np.concatenate([self.hashes, np.zeros(more - len(self.hashes), dtype=np.uint64)])
                self.values = np.concatenate([self.values, np.zeros(more - len(self.values), dtype=np.float32)])
            hashed = np.fromiter(map(word_hash, self.new), dtype=np.uint64, count=len(self.new))
            self.hashes[size - len(self.new):size] = hashed
            self.values[size - len(self.new):size] = self.lexicon.of(hashed)
            self.new.clear()
        return self.hashes, self.values


def vectors(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its distinct shingles, in order of their hashes: counts per text, hashes, worth of one, weights.

    Words are lower-case runs between white space; a text of one to four words is one shingle, a text
    without words has none.
    """
    words.begin()
    tokens = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    places = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(lengths.sum()))
    hashes, values = words.columns()
    hashed, value = hashes[places], values[places]
    # runs of WORDS words at every place of all texts; those that run into the next text are not read
    n = max(0, len(places) - WORDS + 1)
    run, worth = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.float32)
    for k in range(WORDS):
        run += hashed[k:k + n] * _FACTORS[k]
        worth += value[k:k + n]
    run, worth = mixed(run), worth / np.float32(WORDS)
    counts = np.zeros(len(texts), dtype=np.int64)
    shingles, worths, weights = [], [], []
    end = 0
    for i, length in enumerate(lengths.tolist()):
        begin, end = end, end + length
        if length >= WORDS:
            own, weight = run[begin:end - WORDS + 1], worth[begin:end - WORDS + 1]
            order = own.argsort()
            own = own[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            times = np.diff(np.append(first, len(own)))
            own, one = own[first], weight[order[first]]
            weight = one * times
        elif length:
            own = mixed((hashed[begin:end] * _FACTORS[:length]).sum(dtype=np.uint64, keepdims=True) + np.uint64(length))
            weight = one = value[begin:end].mean(keepdims=True)
        else:
            continue
        counts[i] = len(own)
        shingles.append(own)
        worths.append(one)
        weights.append(weight.astype(np.float32))
    if not shingles:
        return counts, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.float32)
    return counts, np.concatenate(shingles), np.concatenate(worths), np.concatenate(weights)


@cache
def samples() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries of r and c of gamma(2, 1) and beta uniform; and odd multipliers.

    A shingle's numbers at a place are the entry that its hash times the place's multiplier names.
    """
    source = np.random.Generator(np.random.PCG64(20))
    r = source.gamma(2.0, 1.0, 1 << 16)
    beta = source.random(1 << 16)
    log_c = np.log(source.gamma(2.0, 1.0, 1 << 16))
    odd = source.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    entries = {"r": r, "inverse": 1 / r, "beta": beta, "high": log_c, "low": log_c - r}
    return {k: v.astype(np.float32) for k, v in entries.items()}, odd


def signatures(counts: np.ndarray, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The samples of each text that has shingles: texts x places, uint64.

    With log a = log c - r (t - beta + 1) and t = floor(log w / r + beta), log a lies between
    log c - r - log w and log c - log w: only shingles whose lower bound is below the least upper
    bound of their text are worked out.
    """
    entry, odd = samples()
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), len(odd)), dtype=np.uint64)
    if not len(counts):
        return out
    log_weight = np.log(weights)
    owner = np.repeat(np.arange(len(counts)), counts)
    named = np.empty(len(shingles), dtype=np.uint64)
    high, low = (np.empty(len(shingles), dtype=np.float32) for _ in range(2))
    for k, factor in enumerate(odd):
        np.multiply(shingles, factor, out=named)
        np.right_shift(named, np.uint64(48), out=named)
        at = named.view(np.int64)
        np.subtract(np.take(entry["high"], at, out=high, mode="clip"), log_weight, out=high)
        np.subtract(np.take(entry["low"], at, out=low, mode="clip"), log_weight, out=low)
        # rounding must not lose the least one
        able = np.flatnonzero(low <= np.repeat(np.minimum.reduceat(high, starts) + np.float32(1e-3), counts))
        own, r, beta = at[able], entry["r"][at[able]], entry["beta"][at[able]]
        t = np.floor(log_weight[able] * entry["inverse"][own] + beta)
        a = entry["high"][own] - r * (t - beta + np.float32(1))
        text = owner[able]
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        least = np.repeat(np.minimum.reduceat(a, begins), np.diff(np.append(begins, len(text))))
        hit = np.flatnonzero(a == least)
        chosen = mixed(shingles[able[hit]] + t[hit].astype(np.int64).view(np.uint64) * _STEP + np.uint64(k))
        # entries shared by shingles tie; the least value is as good a choice for all texts
        out[:, k] = np.minimum.reduceat(chosen, np.searchsorted(hit, begins))
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: texts x BANDS, int64."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two vectors (hashes in order, weights); 1 for two without shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    both = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / both if both else 1.0


def frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(word, documents): in how many rows each word occurs, by word hash; counted per task before the shuffle."""
    def run(batches):
        counts: Counter[str] = Counter()

        def rows():
            hashed = np.fromiter(map(word_hash, counts), dtype=np.uint64, count=len(counts)).view(np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array(hashed), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(set((value or "").lower().split()))
                if len(counts) > TASK_WORDS:
                    yield rows()
        yield rows()

    counted = mapped(docs.select(text), run, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("documents"))


def lexicon(docs: DataFrame, text: str = "text") -> Lexicon:
    """The inverse document frequencies of all words but the rare ones, which need no table."""
    total = docs.count()
    common = frequencies(docs, text).filter(F.col("documents") * RARE >= total).toArrow()
    words, documents = (np.array(common.column(k).to_numpy()) for k in (0, 1))
    return Lexicon(words.view(np.uint64), documents, total)


def signed(docs: DataFrame, lexicon_: Lexicon, row_id: str, text: str) -> DataFrame:
    """(node, digest, bands) per row: a narrow pass.  Texts without words have one digest and no bands."""
    broadcast = docs.sparkSession.sparkContext.broadcast(lexicon_)
    def run(batches):
        words = Words(broadcast.value)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                keys: list[list[int]] = []
                for first, last in in_groups(texts, GROUP):
                    counts, shingles, _, weights = vectors(texts[first:last], words)
                    own = iter(bands(signatures(counts, shingles, weights)).tolist())
                    keys.extend(next(own) if n else [] for n in counts.tolist())
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass") if k else b"", digest_size=16).digest()
                           for t, k in zip(texts, keys)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["node", "digest", "bands"])

    return mapped(docs.select(F.col(row_id).cast("long").alias("node"), text), run, "node long, digest binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, lexicon_: Lexicon) -> DataFrame:
    """(a, b, similar) of pairs (a, b) by the exact similarity of their texts (node, text)."""
    broadcast = texts.sparkSession.sparkContext.broadcast(lexicon_)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    def run(batches):
        words = Words(broadcast.value)
        known: dict[int, list] = {}

        def vector(node: int, text: str):
            for own, v in known.get(node, ()):
                if own == text:
                    return v
            if len(known) > 512:
                known.clear()
            _, shingles, _, weights = vectors([text], words)
            known.setdefault(node, []).append((text, (shingles, weights)))
            return shingles, weights

        for batch in batches:
            for part in slices(batch, 2):
                a, b, x, y = (c.to_pylist() for c in part.columns)
                near = [similarity(vector(i, s), vector(j, t)) >= SIMILARITY - 1e-9 for i, j, s, t in zip(a, b, x, y)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.bool_())],
                                                 names=["a", "b", "similar"])

    return mapped(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), run, "a long, b long, similar boolean")


def weighed(texts: DataFrame, lexicon_: Lexicon) -> DataFrame:
    """(node, class, total, shingle, weight): all shingles of each text of texts (node, class, text)."""
    broadcast = texts.sparkSession.sparkContext.broadcast(lexicon_)
    def run(batches):
        words = Words(broadcast.value)
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                nodes, labels, own = (c.to_pylist() for c in part.columns)
                counts, shingles, _, weights = vectors([t or "" for t in own], words)
                held = [np.repeat(np.array(x, dtype=np.int64), counts) for x in (nodes, labels, range(len(nodes)))]
                totals = np.bincount(held[2], weights, minlength=len(nodes))[held[2]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held[0]), pa.array(held[1]), pa.array(totals), pa.array(shingles.view(np.int64)),
                     pa.array(weights.astype(np.float64))], names=["node", "class", "total", "shingle", "weight"])

    return mapped(texts.select("node", "class", "text"), run, "node long, class long, total double, shingle long, weight double")


def prefix_pairs(texts: DataFrame, lexicon_: Lexicon) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that may be similar: an exact join by prefixes.

    In an order of all shingles, the rarest among these texts first, a text's prefix ends where what
    follows weighs less than SIMILARITY of its total.  Two texts of that similarity share more than
    either's rest, so they share a shingle of both prefixes, and from the first one on neither's rest is too
    small for what they share.  What only one text holds comes first and meets nothing: edited copies meet only if few edits are their own.
    """
    rows = cut(weighed(texts, lexicon_))
    spread = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"))
    along = Window.partitionBy("node").orderBy("texts", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(along), F.lit(0.0))
    first = rows.join(spread, "shingle").withColumn("before", before).filter(
        # rounding must not end a prefix early
        (F.col("before") <= (1 - SIMILARITY) * F.col("total") * (1 + 1e-6)) & (F.col("texts") > 1))
    held = cut(first.select("node", "class", "total", "shingle", (F.col("total") - F.col("before")).alias("rest")))
    several = held.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    a = held.join(several.select("shingle"), "shingle", "left_semi")
    b = a.select("shingle", F.col("node").alias("b"), F.col("class").alias("class_b"), F.col("total").alias("total_b"), F.col("rest").alias("rest_b"))
    # from the first shared shingle on, what follows in both must hold all that they share
    needed = SIMILARITY / (1 + SIMILARITY) * (F.col("total") + F.col("total_b")) * (1 - 1e-6)
    met = a.join(b, "shingle").filter((F.col("node") < F.col("b")) & (F.col("class") != F.col("class_b"))
                                      & (F.least("rest", "rest_b") >= needed))
    return met.select(F.col("node").alias("a"), "b")


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of the component of each node of links (a, b).

    Every round a node takes the least label of its neighbours and of the node that its label names, so
    that labels travel ever further; links of a hub are reduced map-side.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("next"))
    both = cut(ends.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("least")))
    while True:
        sent = both.join(labels, "node").select(F.col("next").alias("node"), "least")
        near = sent.unionByName(labels).groupBy("node").agg(F.min("least").alias("near"))
        named = labels.select(F.col("node").alias("near"), F.col("least").alias("beyond"))
        new = cut(near.join(named, "near").select("node", F.least("near", "beyond").alias("least")))
        changed = new.join(labels, ["node", "least"], "left_anti").isEmpty()
        labels = new
        if changed:
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, class) after links (a, b) between nodes; a node without label is a class of its own."""
    if labels is None:
        return components(links).select("node", F.col("least").alias("class"))
    a = labels.select(F.col("node").alias("a"), F.col("class").alias("class_a"))
    b = labels.select(F.col("node").alias("b"), F.col("class").alias("class_b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).filter("a <> b")
    moved = components(between)
    known = labels.join(moved.select(F.col("node").alias("class"), "least"), "class", "left").select(
        "node", F.coalesce("least", "class").alias("class"))
    new = moved.join(labels, "node", "left_anti").select("node", F.col("least").alias("class"))
    return cut(known.unionByName(new))


def semi(df: DataFrame, ids: DataFrame, column: str, kind: str = "left_semi") -> DataFrame:
    """df joined with ids (a written table of one column) by broadcast if they are few, else by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, column, kind)


def classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) per row: the least id of its class of equal and near-duplicate texts.

    Links are pairs of similarity SIMILARITY and more, classes their connected components.  A null text
    counts as empty, and texts without words are equal.  Rows of one id, whatever their texts, are one
    document and share a class; a null id is in no class (class_id null).  Rows pass one to one.
    """
    own = docs.filter(F.col(row_id).isNotNull())
    lexicon_ = lexicon(own, text)
    rows = cut(signed(own, lexicon_, row_id, text))
    # equal texts go on as the least id among them
    firsts = cut(rows.groupBy("digest").agg(F.min("node").alias("first")))
    spread = rows.join(firsts.select(F.col("first").alias("node")).distinct(), "node", "left_semi").select(
        "node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    buckets = cut(spread.join(shared.select("band"), "band").distinct())
    nodes = cut(buckets.select("node").distinct())
    texts = cut(semi(own.select(F.col(row_id).cast("long").alias("node"), F.col(text).alias("text")), nodes, "node"))

    labels: DataFrame | None = None
    compared: DataFrame | None = None
    for k in range(ROUNDS + 1):
        held = buckets.withColumn("class", F.col("node")) if labels is None else buckets.join(
            labels, "node", "left").select("band", "node", F.coalesce("class", "node").alias("class"))
        drawn = held.groupBy("band").agg(
            F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("draw"), "node", "class")).alias("one"),
            F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
        if k < ROUNDS:
            met = held.join(drawn.select("band", "one"), "band").filter(F.col("class") != F.col("one")["class"]).select(
                F.col("node").alias("a"), F.col("one")["node"].alias("b"))
        else:
            # what is still apart although it meets in a bucket: the exact join of these texts
            apart = held.join(drawn.select("band"), "band", "left_semi").select("node", "class").distinct()
            met = prefix_pairs(texts.join(apart, "node"), lexicon_)
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        done = cut(verified(pairs, texts, lexicon_))
        links = done.filter("similar").select("a", "b")
        compared = done.select("a", "b") if compared is None else compared.unionByName(done.select("a", "b"))
        if done.isEmpty():
            if k < ROUNDS:
                continue
            break
        if not links.isEmpty():
            labels = merged(labels, links)
    named = firsts if labels is None else firsts.join(
        labels.select(F.col("node").alias("first"), "class"), "first", "left").select(
        "digest", F.coalesce("class", "first").alias("first"))
    placed = rows.select("node", "digest").join(named, "digest").select(
        F.col("node").alias(row_id), F.col("first").alias("class_id"))
    # an id that stands on rows of several texts ties their classes
    repeated = placed.distinct().groupBy(row_id).agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a <> b")
    ties = cut(repeated.select("a", "b"))
    if not ties.isEmpty():
        joined = components(ties).select(F.col("node").alias("class_id"), "least")
        placed = placed.join(joined, "class_id", "left").select(row_id, F.coalesce("least", "class_id").alias("class_id"))
    absent = docs.filter(F.col(row_id).isNull()).select(
        F.col(row_id).cast("long").alias(row_id), F.lit(None).cast("long").alias("class_id"))
    return placed.unionByName(absent)
