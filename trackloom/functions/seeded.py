"""Seeded generators whose numbers are the same everywhere: SplitMix64 and xoshiro256**, by their public definitions."""

from __future__ import annotations

from collections.abc import Iterator

MASK = 2**64 - 1


def split_mix(seed: int) -> Iterator[int]:
    """The stream of SplitMix64."""
    while True:
        seed = seed + 0x9E3779B97F4A7C15 & MASK
        z = (seed ^ seed >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        yield z ^ z >> 31


def _left(x: int, by: int) -> int:
    return (x << by | x >> 64 - by) & MASK


class Draws:
    """xoshiro256** seeded by SplitMix64, with draws of floats and of bounded integers."""

    def __init__(self, seed: int):
        stream = split_mix(seed)
        self.state = [next(stream) for _ in range(4)]

    def word(self) -> int:
        a, b, c, d = self.state
        out = _left(b * 5 & MASK, 7) * 9 & MASK
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, c ^ (b << 17 & MASK), _left(d, 45)]
        return out

    def uniform(self, low: float, high: float) -> float:
        return low + (high - low) * ((self.word() >> 11) / 2**53)

    def below(self, bound: int) -> int:
        """Evenly below a bound: words beyond its last multiple are drawn again."""
        most = 2**64 - 2**64 % bound
        while (drawn := self.word()) >= most:
            pass
        return drawn % bound

    def sign(self) -> int:
        return 1 if self.word() >> 63 else -1
