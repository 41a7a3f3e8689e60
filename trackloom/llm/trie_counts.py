"""Token counts by a unigram model, with the forward scores of a trie of pre-tokens.

The best segmentation of a pre-token is a dynamic programme over its bytes: the score of a
prefix is the best, over the vocabulary pieces that end there, of the score of the prefix
before the piece plus the piece's log-probability.  Pre-tokens that share a prefix share
those scores, so distinct pre-tokens are inserted in a trie: each node is scored once, from
its ancestors, and the nodes at which pre-tokens end keep the number of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackloom.llm.byte_bpe import free_name, slices
from trackloom.llm.pretokens import in_groups, split
from trackloom.llm.workers import mapped

#: A worker's trie starts anew beyond so many nodes; counts do not depend on what it holds.
TRIE_NODES = 600_000
#: Depth of the trie: what a longer pre-token has beyond it is one compressed edge, scored along arrays that start
#: from the scores of its path and are not kept.
TRIE_BYTES = 64


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities of a ranked vocabulary by Zipf's law: proportional to 1 / (rank + 1)."""
    total = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class TrieCounter:
    """Counts tokens of pre-tokens.  Among segmentations of equal score the fewer tokens win.

    Every single byte has a score, so every pre-token can be segmented.
    """

    def __init__(self, scores: dict[bytes, float]):
        missing = [b for b in range(256) if bytes([b]) not in scores]
        if missing:
            raise ValueError(f"no score for the bytes {missing}")
        if any(s >= 0 for s in scores.values()):
            raise ValueError("scores are logarithms of probabilities below 1")
        self.longest = max(map(len, scores))
        # every end of a piece; None where it is no piece itself: a walk back stops where no piece goes on
        self.parts: dict[bytes, float | None] = {
            piece[-k:]: None for piece in scores for k in range(1, len(piece))} | scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.terminal: dict[bytes, int] = {}

    def count(self, piece: bytes) -> int:
        known = self.terminal.get(piece)
        if known is not None:
            return known
        if len(self.best) >= TRIE_NODES:
            self.clear()
        children, best, tokens = self.children, self.best, self.tokens
        node, path = 0, [0]
        scored: list[float] = [0.0]
        counted: list[int] = [0]
        for depth, byte in enumerate(piece[:TRIE_BYTES], 1):
            edge = node << 8 | byte
            child = children.get(edge)
            if child is None:
                child = children[edge] = len(best)
                if len(scored) < depth:
                    scored = [best[k] for k in path]
                    counted = [tokens[k] for k in path]
                score, n = self._forward(piece, depth, scored, counted)
                best.append(score)
                tokens.append(n)
                scored.append(score)
                counted.append(n)
            path.append(child)
            node = child
        if len(piece) > TRIE_BYTES:
            return self._tail(piece, [best[k] for k in path], [tokens[k] for k in path])
        self.terminal[piece] = tokens[node]
        return tokens[node]

    def _forward(self, piece: bytes, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of piece[:end], from those of its shorter prefixes."""
        top, fewest, get = -math.inf, 0, self.parts.get
        for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
            own = get(piece[begin:end], 0.0)
            if own is None:
                continue
            if own == 0.0:
                break
            score = best[begin] + own
            if score > top or score == top and tokens[begin] + 1 < fewest:
                top, fewest = score, tokens[begin] + 1
        return top, fewest

    def _tail(self, piece: bytes, best: list[float], tokens: list[int]) -> int:
        """Tokens of a piece whose first prefixes are scored."""
        for end in range(len(best), len(piece) + 1):
            score, n = self._forward(piece, end, best, tokens)
            best.append(score)
            tokens.append(n)
        return tokens[-1]

    def count_batch(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Tokens and pre-tokens of each text."""
        for first, last in in_groups(texts):
            data, cuts, counts = split(texts[first:last])
            bounds = cuts.tolist()
            pieces = [data[a:b] for a, b in zip(bounds, bounds[1:])]
            known = {p: self.count(p) for p in sorted(set(pieces))}
            at = 0
            for n in counts.tolist():
                yield sum(map(known.__getitem__, pieces[at:at + n])), n
                at += n


_counters: dict[int, TrieCounter] = {}


def count_tokens(df: DataFrame, scores: dict[bytes, float], text: str = "text") -> DataFrame:
    """df with n_tokens and n_pieces: the tokens of the best unigram segmentation and the pre-tokens.

    A pass over Arrow batches without shuffle.  A null or empty text has 0 of both; rows, repeated
    ones too, pass one to one; a new column whose name df has gets underscores before it.
    """
    names = [free_name(df.columns, "n_tokens"), free_name(df.columns, "n_pieces")]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    broadcast = df.sparkSession.sparkContext.broadcast(scores)
    key = hash(frozenset(scores.items()))
    place = df.columns.index(text)
    def run(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = TrieCounter(broadcast.value)
        counter = _counters[key]
        for batch in batches:
            for part in slices(batch, place):
                counts = list(counter.count_batch([t or "" for t in part.column(place).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c[0] for c in counts], pa.int64()),
                     pa.array([c[1] for c in counts], pa.int64())], names=[f.name for f in schema.fields])

    return mapped(df, run, schema)
