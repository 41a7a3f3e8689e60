"""Keys that need more than built-in functions: normal forms of names, and fingerprints of planes."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset and prime of 64-bit FNV-1a.
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1


def name_key(name: Column | str) -> Column:
    """A name in normal form C and lower case: names that a file system may hold to be the same are equal."""
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n).lower())

    return F.pandas_udf(run, "string")(name)


def _step(state: int, word: int) -> int:
    product = (state ^ word) * PRIME & MASK
    return product ^ product >> 32


def _mixed(state: int, data: bytes) -> int:
    """A state after bytes: whole little-endian words, then single bytes, then the number of bytes."""
    whole = len(data) // 8 * 8
    for k in range(0, whole, 8):
        state = _step(state, int.from_bytes(data[k:k + 8], "little"))
    for byte in data[whole:]:
        state = _step(state, byte)
    return _step(state, len(data))


def plane_key(width: int, height: int, pixels: bytes) -> int:
    """A fingerprint of a plane, the same on every system."""
    state = _mixed(_mixed(OFFSET, width.to_bytes(4, "little")), height.to_bytes(4, "little"))
    return _mixed(state, pixels)


#: Planes of one size from which their words are stepped through together.
TOGETHER = 8


def _stepped(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    product = (states ^ words) * np.uint64(PRIME)
    return product ^ product >> np.uint64(32)


def _keys(width: int, height: int, planes: list[bytes]) -> list[int]:
    """plane_key of planes of one size: the words of a plane follow each other, so that the planes go side by side."""
    if len(planes) < TOGETHER:
        return [plane_key(width, height, p) for p in planes]
    data = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    whole = data.shape[1] // 8 * 8
    states = np.full(len(planes), _mixed(_mixed(OFFSET, width.to_bytes(4, "little")), height.to_bytes(4, "little")), np.uint64)
    for words in np.ascontiguousarray(np.ascontiguousarray(data[:, :whole]).view("<u8").T):
        states = _stepped(states, words)
    for column in range(whole, data.shape[1]):
        states = _stepped(states, data[:, column].astype(np.uint64))
    return _stepped(states, np.full(len(planes), data.shape[1], np.uint64)).tolist()


def plane_keys(width: Column | str, height: Column | str, pixels: Column | str) -> Column:
    """plane_key as 16 hexadecimal digits."""
    def run(w: pd.Series, h: pd.Series, p: pd.Series) -> pd.Series:
        sizes: dict[tuple, list[int]] = {}
        for at, (i, j, x) in enumerate(zip(w, h, p)):
            if x is not None:
                sizes.setdefault((int(i), int(j), len(x)), []).append(at)
        out: list[str | None] = [None] * len(p)
        for (i, j, _), places in sizes.items():
            for at, key in zip(places, _keys(i, j, [bytes(p.iloc[at]) for at in places])):
                out[at] = f"{key:016x}"
        return pd.Series(out)

    return F.pandas_udf(run, "string")(width, height, pixels)
