"""A quality classifier by co-training of two views.

One view sees only what a text consists of, the other only a page's metadata.  Both are fitted on a third
of a bounded sample of labelled rows.  In each round both score all other documents in one pass, and each
document of whose class one view is confident counts as a pseudo-label of the other: the pass returns the
exact sums of the other view's gradient over them, so that every confident document of the corpus counts,
however many there are, and only sums reach the driver.  Pseudo-labels of a class weigh together as much as
its labelled rows, at every size of the corpus.  Confidence is judged after calibration on the second third
of the sample, on which the calibrated views are also combined; the last third gives the figures.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.byte_bpe import slices
from trackloom.llm.frames import cut, fresh
from trackloom.llm.pretokens import in_groups
from trackloom.llm.workers import mapped, release

#: Bound of the labelled rows that are fitted on: those of the smallest hashes of their ids.
LABELLED = 12_000
#: A view is confident of a class if it errs at most this share of what naming that class blindly errs.
ERROR = 0.2
#: Rounds of exchange, and the weight of all pseudo-labels of a class against its labelled rows.
ROUNDS, PSEUDO = 4, 1.0
#: Features and residuals are multiples of 1 / FINE and 1 / FINER: sums of their products are exact in any order.
FINE, FINER = 1024, 4096

# Classes of code points in the text view; the rest are letters by case, digits, white space.
MARKS = "!|#$%&*.,;:?\"'()-_/<>=@"
CLASSES = 32
LOWER, UPPER, DIGIT, BLANK, BREAK, OTHER = range(6)
#: Cells into which words are hashed.
WORDS = 1 << 9
TEXT_FEATURES = CLASSES * CLASSES + WORDS + 6
SOURCES, LANGS, CROSSES, LENGTHS = 128, 32, 256, 48
META_FEATURES = SOURCES + LANGS + CROSSES + LENGTHS


@cache
def _classes() -> np.ndarray:
    table = np.full(0x10000, OTHER, dtype=np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.isspace():
            table[c] = BREAK if x in "\n\r" else BLANK
        elif x.isdigit():
            table[c] = DIGIT
        elif x.isalpha():
            table[c] = UPPER if x.isupper() else LOWER
    for k, x in enumerate(MARKS):
        table[ord(x)] = 6 + k
    return table


@cache
def _cell(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))


#: Odd factors by which the code points of a word are told apart by place.
_FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(points: np.ndarray, blank: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (a run without blanks, within a text) starts, and its hash; begins: first places of texts."""
    start = ~blank
    start[1:] &= blank[:-1]
    start[begins] = ~blank[begins]
    at = np.flatnonzero(start)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    place = np.arange(len(points))
    place -= np.maximum.accumulate(np.where(start, place, 0))
    own = (points.astype(np.uint64) + np.uint64(1)) * _FACTORS[place & 63]
    own[blank] = 0
    h = np.add.reduceat(own, at)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return at, h ^ (h >> np.uint64(29))


def text_features(texts: list[str]) -> np.ndarray:
    """Frequencies of pairs of adjacent code-point classes and of words by cell, repetition of words and
    lines, lengths; multiples of 1 / FINE from 0 to 1."""
    out = np.zeros((len(texts), TEXT_FEATURES), dtype=np.float32)
    pairs = CLASSES * CLASSES
    for first, last in in_groups(texts):
        part = texts[first:last]
        n = len(part)
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _classes()[np.minimum(points, 0xFFFF)].astype(np.int64)
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=n)
        row = np.repeat(np.arange(n), lengths)
        inside = row[1:] == row[:-1]
        at = (row[:-1] * pairs + kinds[:-1] * CLASSES + kinds[1:])[inside]
        counts = np.bincount(at, minlength=n * pairs).reshape(n, pairs)
        out[first:last, :pairs] = np.sqrt(counts / np.maximum(1, lengths - 1)[:, None])
        begins = (np.cumsum(lengths) - lengths)[lengths > 0]
        starts, hashes = word_hashes(points, (kinds == BLANK) | (kinds == BREAK), begins)
        owner = row[starts]
        words = np.bincount(owner, minlength=n)
        cells = np.bincount(owner * WORDS + (hashes >> np.uint64(55)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        some = np.maximum(1, words)
        out[first:last, pairs:pairs + WORDS] = np.sqrt(cells / some[:, None])
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=n)
        lines = np.array([(len(set(own)) / len(own)) for own in (t.split("\n") for t in part)])
        out[first:last, pairs + WORDS:] = np.stack(
            [distinct / np.sqrt(some) / 20, lines, lengths / some / 20, np.log1p(words) / 10, distinct / some, words == 0], axis=1)
    return np.round(np.minimum(out, 1) * FINE) / FINE


def meta_features(sources: list[str | None], langs: list[str | None], lengths: list[int | None]) -> np.ndarray:
    """One-hot source, language and both together, by a hash, and the half binary order of the length; null has
    cells of its own."""
    cell = lambda value, cells: 0 if value is None else 1 + _cell(value) % (cells - 1)
    out = np.zeros((len(sources), META_FEATURES), dtype=np.float32)
    for k, (s, g, n) in enumerate(zip(sources, langs, lengths)):
        out[k, cell(s, SOURCES)] = 1
        out[k, SOURCES + cell(g, LANGS)] = 1
        out[k, SOURCES + LANGS + cell(f"{s!r} {g!r}", CROSSES)] = 1
        order = 0 if n is None else 1 + int(2 * math.log2(1 + max(0, int(n))))
        out[k, SOURCES + LANGS + CROSSES + min(LENGTHS - 1, order)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (the last one the bias) of ridge logistic regression, by Newton steps."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    d = x.shape[1]
    w, h = np.zeros(d + 1), np.empty((d + 1, d + 1))
    penalty = np.full(d + 1, ridge)
    penalty[d] = 1e-3
    for _ in range(steps):
        p = sigmoid((x @ w[:d].astype(np.float32)).astype(np.float64) + w[d])
        v = np.maximum(p * (1 - p), 1e-6).astype(np.float32)
        scaled = x * v[:, None]
        h[:d, :d] = scaled.T @ x
        h[d, :d] = h[:d, d] = scaled.sum(axis=0, dtype=np.float64)
        h[d, d] = v.sum(dtype=np.float64)
        slope = np.append((y - p).astype(np.float32) @ x, (y - p).sum()) - penalty * w
        step = np.linalg.solve(h + np.diag(penalty), slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class View:
    """A linear classifier on the features that vary, and the line that calibrates its margins."""

    used: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        # rounded, so that equal features have equal margins in whatever batch they are
        part = x[:, self.used].astype(np.float32) @ self.weights[:-1].astype(np.float32)
        return np.round(part.astype(np.float64) + self.weights[-1], 4)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def calibrate(self, held: np.ndarray, truth: np.ndarray) -> None:
        line = logistic(self.raw(held)[:, None], truth, ridge=1e-2)
        self.slope, self.shift = float(max(0.0, line[0])), float(line[1])

    def stepped(self, x: np.ndarray, y: np.ndarray, pseudo: np.ndarray, ridge: float = 1.0) -> None:
        """One step down the loss of labelled rows and pseudo-labels, given the negative gradient of the latter;
        the curvature is that of the labelled rows, counted for both."""
        own = np.ascontiguousarray(x[:, self.used], dtype=np.float32)
        p = sigmoid(self.raw(x))
        v = np.maximum(p * (1 - p), 1e-3).astype(np.float32)
        scaled = own * v[:, None]
        h = np.empty((len(self.used) + 1,) * 2)
        h[:-1, :-1] = scaled.T @ own
        h[-1, :-1] = h[:-1, -1] = scaled.sum(axis=0, dtype=np.float64)
        h[-1, -1] = v.sum(dtype=np.float64)
        penalty = np.full(len(self.weights), ridge)
        penalty[-1] = 1e-3
        slope = np.append((y - p).astype(np.float32) @ own, (y - p).sum()) + pseudo - penalty * self.weights
        self.weights = self.weights + np.linalg.solve((1 + PSEUDO) * h + np.diag(penalty), slope)


def fitted(x: np.ndarray, y: np.ndarray, held: np.ndarray, truth: np.ndarray) -> View:
    used = np.flatnonzero(np.ptp(x, axis=0) > 0)
    view = View(used, logistic(x[:, used], y))
    view.calibrate(held, truth)
    return view


@dataclass
class Model:
    """Both views, their weights in the sum of calibrated margins, and its bias; text and meta None: a constant."""

    text: View | None
    meta: View | None
    parts: tuple[float, float]
    bias: float
    #: Figures on labelled rows that neither fitted nor calibrated, and per round how many documents each view
    #: took over from the other, by receiving view (text, metadata) and class (0, 1).
    held_out: dict[str, float] = field(default_factory=dict)
    exchange: list = field(default_factory=list)

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            constant = np.full(len(text), sigmoid(np.array([self.bias]))[0])
            return constant, constant, constant
        a, b = self.text.margin(text), self.meta.margin(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.parts[0] * a + self.parts[1] * b + self.bias)


def bars(truth: np.ndarray) -> dict[float, float]:
    """The calibrated margin from which a class is named with confidence, by its share of the calibration rows."""
    share = {value: float((truth == value).mean()) for value in (1.0, 0.0)}
    least = {value: 1 - ERROR * (1 - n) for value, n in share.items()}
    return {value: math.log(p / (1 - p)) for value, p in least.items()}


#: By receiving view (0 text, 1 metadata) and class (0, 1): how many rows, and the sums of residual times feature.
Sums = tuple[np.ndarray, list[np.ndarray]]


def no_sums(models: list[View]) -> Sums:
    return np.zeros((2, 2), dtype=np.int64), [np.zeros((2, len(m.weights)), dtype=np.int64) for m in models]


def add_sums(sums: Sums, models: list[View], bar: dict[float, float], text: np.ndarray, meta: np.ndarray) -> None:
    """Adds the rows that each view passes to the other; where both are confident of different classes, neither does."""
    views = (text, meta)
    margins = [m.margin(x) for m, x in zip(models, views)]
    named = [np.where(g >= bar[1.0], 1, np.where(-g >= bar[0.0], 0, -1)) for g in margins]
    apart = (named[0] >= 0) & (named[1] >= 0) & (named[0] != named[1])
    for to in (0, 1):
        for value in (0, 1):
            at = np.flatnonzero((named[1 - to] == value) & ~apart)
            if len(at):
                x = views[to][at][:, models[to].used].astype(np.float64) * FINE
                residual = np.round((value - sigmoid(models[to].raw(views[to][at]))) * FINER)
                sums[0][to, value] += len(at)
                sums[1][to][value] += np.append(residual @ x, residual.sum() * FINE).astype(np.int64)


def cotrain(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model:
    """Co-training on labelled rows and an unlabelled pool in memory."""
    def passed(models, bar):
        sums = no_sums(models)
        add_sums(sums, models, bar, pool_text, pool_meta)
        return sums

    return exchanged(text, meta, label, passed)


def exchanged(text: np.ndarray, meta: np.ndarray, label: np.ndarray, passed: Callable[[list[View], dict], Sums]) -> Model:
    """Co-training on labelled rows, of which every third one calibrates and every third one judges, and on the sums
    over the documents that pass in each round.

    With fewer than two rows of either class in one of these parts the model is the constant 1: nothing is
    rejected without evidence.
    """
    part = [np.arange(len(label)) % 3 == k for k in range(3)]
    y, truth, last = (label[at].astype(float) for at in part)
    if min((v == value).sum() for v in (y, truth, last) for value in (1, 0)) < 2:
        return Model(None, None, (0.0, 0.0), 40.0)
    fits, calibration, judge = ([x[at] for x in (text, meta)] for at in part)
    models = [fitted(x, y, h, truth) for x, h in zip(fits, calibration)]
    bar, exchange = bars(truth), []
    for _ in range(ROUNDS):
        counts, sums = passed(models, bar)
        exchange.append(counts.tolist())
        if not counts.any():
            break
        for m, x, h, n, total in zip(models, fits, calibration, counts, sums):
            pull = sum((PSEUDO * (y == value).sum() / n[value] * total[value] / (FINE * FINER) for value in (0, 1) if n[value]),
                       np.zeros(len(m.weights)))
            if n.any():
                m.stepped(x, y, pull)
                m.calibrate(h, truth)
    margins = np.stack([m.margin(h) for m, h in zip(models, calibration)], axis=1)
    joint = logistic(margins, truth, ridge=1e-2)
    done = Model(*models, (float(joint[0]), float(joint[1])), float(joint[2]))
    figures = {"rows": float(len(last))}
    for name, p in zip(("text", "meta", "both"), done.probabilities(*judge)):
        kept = p >= 0.5
        figures |= {f"{name}_accuracy": float((kept == (last == 1)).mean()), f"{name}_low_kept": float(kept[last == 0].mean()),
                    f"{name}_good_kept": float(kept[last == 1].mean()), f"{name}_auc": auc(p, last)}
    done.held_out, done.exchange = figures, exchange
    return done


def auc(p: np.ndarray, truth: np.ndarray) -> float:
    """The share of pairs of a good and a low row in which the good one scores higher; ties count half."""
    good, low = np.sort(p[truth == 1]), p[truth == 0]
    above = len(good) - np.searchsorted(good, low, side="right")
    ties = np.searchsorted(good, low, side="right") - np.searchsorted(good, low, side="left")
    return float((above + ties / 2).sum() / (len(good) * len(low)))


FEATURES = "doc_id long, label int, text_view binary, meta_view binary"


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """A model for docs (doc_id, text, lang, source, n_chars) by labels (doc_id, quality 0 or 1).

    At most `labelled` labelled documents, those of the smallest id hashes, are gathered on the driver as
    feature vectors; that is the whole bound.  All other documents with an id may pass pseudo-labels, each
    round in one pass that returns sums.  Of repeated labels the lowest counts, of repeated labelled
    documents one; null labels and ids are left out.
    """
    judged = cut(labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
                 .agg(F.min("quality").cast("int").alias("label")))
    used = docs.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL")
    present = docs.select("doc_id").distinct()
    # at most `labelled` rows of two numbers
    known = F.broadcast(judged.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    ids, marks, a, b = _gathered(used.join(known, "doc_id"))
    # of repeated documents one, whatever order they come in
    order = np.lexsort((*b.T[:4], *a.T[:4], ids))
    _, one = np.unique(ids[order], return_index=True)
    # not in order of ids: folds should not follow a pattern in them
    one = order[one[np.argsort(ids[order[one]] * 0x9E3779B1 % 2**31, kind="stable")]]
    taken = np.unique(ids)
    a, b, marks = a[one], b[one], marks[one]
    model = exchanged(a, b, marks, lambda models, bar: _passed(used, taken, models, bar))
    release()
    return model


def _passed(used: DataFrame, taken: np.ndarray, models: list[View], bar: dict[float, float]) -> Sums:
    """The sums over all documents but those of the ids taken: each task adds up its own and sends one row a feature."""
    widths = [len(m.weights) for m in models]

    def run(batches):
        sums = no_sums(models)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                part = part.filter(pa.array(~np.isin(np.array(part.column(0).to_pylist(), dtype=np.int64), taken)))
                _, texts, langs, sources, sizes = (c.to_pylist() for c in part.columns)
                if texts:
                    add_sums(sums, models, bar, text_features([t or "" for t in texts]), meta_features(sources, langs, sizes))
        flat = np.concatenate([sums[0].reshape(-1), *(x.reshape(-1) for x in sums[1])])
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(flat[slots])], names=["slot", "value"])

    flat = np.zeros(4 + 2 * sum(widths), dtype=np.int64)
    # at most four rows and one per class and feature
    for r in mapped(used, run, "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        flat[r["slot"]] = r["value"]
    ends = np.cumsum([4, *(2 * w for w in widths)])
    return flat[:4].reshape(2, 2), [flat[i:j].reshape(2, -1) for i, j in zip(ends, ends[1:])]


def _gathered(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the features of both views of a bounded sample (doc_id, text, lang, source, n_chars, label)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts, langs, sources, sizes, marks = (c.to_pylist() for c in part.columns)
                a = text_features([t or "" for t in texts]).astype(np.float16)
                b = meta_features(sources, langs, sizes).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array([x.tobytes() for x in a], pa.binary()),
                     pa.array([x.tobytes() for x in b], pa.binary())], names=["doc_id", "label", "text_view", "meta_view"])

    table = mapped(sample, run, FEATURES).toArrow()
    ids, marks = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in (0, 1))
    made = ids, marks, *(_matrix(table.column(c), n) for c, n in ((2, TEXT_FEATURES), (3, META_FEATURES)))
    del table
    release()
    return made


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of bytes as a matrix, chunk by chunk: the driver holds them once beside the table."""
    out, at = np.empty((len(column), width), dtype=np.float16), 0
    for chunk in column.chunks:
        out[at:at + len(chunk)] = np.frombuffer(b"".join(chunk.to_pylist()), dtype=np.float16).reshape(-1, width)
        at += len(chunk)
    return out


def score(df: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """df (text, lang, source, n_chars) with p_text, p_meta, p_quality and keep (p_quality >= least).

    One narrow pass.  Null and empty texts and null metadata are scored like any other value; rows,
    repeated ones too, pass one to one; new columns get underscores before names that df has.
    """
    names = fresh(df.columns, "p_text", "p_meta", "p_quality", "keep")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:3]),
                           T.StructField(names[3], T.BooleanType())])
    places = [df.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, places[0], 2 << 20):
                texts, sources, langs, sizes = (part.column(p).to_pylist() for p in places)
                done = model.probabilities(text_features([t or "" for t in texts]), meta_features(sources, langs, sizes))
                rounded = [np.round(p.astype(np.float64), 6) for p in done]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(p) for p in rounded), pa.array(rounded[2] >= least)],
                    names=[f.name for f in schema.fields])

    return mapped(df, run, schema)
