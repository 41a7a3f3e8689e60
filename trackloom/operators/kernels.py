"""Numpy steps on one plane, or on a stack of the same pixels over time; planes are arrays of rows by columns."""

from __future__ import annotations

import math

import numpy as np


def grey(luma: np.ndarray) -> np.ndarray:
    """Limited-range luma as full-range grey, by an arithmetic shift, clamped."""
    table = np.clip((np.arange(256) * 4769 - 81520) >> 12, 0, 255).astype(np.uint8)
    return table[luma]


def shares(source: int, work: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place along the shorter side the source places that it covers, and how much of each: rows by taps.

    In units of 1 / work of a source place; places with no share repeat the last one with weight 0.
    """
    begin, end = np.arange(work) * source, np.arange(1, work + 1) * source
    taps = int(((end - 1) // work - begin // work).max()) + 1
    at = begin[:, None] // work + np.arange(taps)
    weight = np.minimum(end[:, None], (at + 1) * work) - np.maximum(begin[:, None], at * work)
    return np.minimum(at, source - 1), np.maximum(weight, 0)


def averaged(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average with exact integer weights and one rounding."""
    if plane.shape == (height, width):
        return plane
    rows, down = shares(plane.shape[0], height)
    columns, across = shares(plane.shape[1], width)
    kind = np.uint32 if plane.size < 1 << 24 else np.uint64
    down, across = down.astype(kind), across.astype(kind)
    lines = sum(plane[rows[:, k]] * down[:, k, None] for k in range(rows.shape[1]))
    total = sum(np.take(lines, columns[:, k], 1) * across[:, k] for k in range(columns.shape[1]))
    return ((total + kind(plane.size // 2)) // kind(plane.size)).astype(np.uint8)


def blurred(plane: np.ndarray, weights: list[int]) -> np.ndarray:
    """Separable convolution with mirrored borders in integers: units of 1/64 level, rounded once."""
    reach, total = len(weights) // 2, plane.astype(np.uint32)
    for axis in (1, 0):
        wide = np.pad(total, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        n = plane.shape[axis]
        tap = lambda k: wide[:, k:k + n] if axis else wide[k:k + n]  # noqa: B023, E731
        total = tap(reach) * np.uint32(weights[reach])
        for k in range(reach):
            # weights are symmetric
            both = tap(k) + tap(2 * reach - k)
            both *= np.uint32(weights[k])
            total += both
    total += np.uint32(1 << 17)
    return (total >> np.uint32(18)).astype(np.int16)


class SortedStack:
    """The sorted samples of each pixel: a plane a rank.  Samples come and go one plane at a time."""

    def __init__(self, pixels: int, kind) -> None:
        self.rows: list[np.ndarray] = []
        self.spare, self.above = np.empty(pixels, kind), np.empty(pixels, bool)

    def add(self, plane: np.ndarray) -> None:
        """One pass upwards: each rank keeps the lower of its own and the carried value."""
        carried = plane.copy()
        for k, row in enumerate(self.rows):
            low = np.minimum(row, carried, out=self.spare)
            np.maximum(row, carried, out=carried)
            self.rows[k], self.spare = low, row
        self.rows.append(carried)

    def drop(self, plane: np.ndarray) -> None:
        """The ranks from the sample's on take what stands above them."""
        for row, after in zip(self.rows, self.rows[1:]):
            change = np.subtract(after, row, out=self.spare)
            change *= np.greater_equal(row, plane, out=self.above)
            row += change
        self.rows.pop()

    def median(self) -> np.ndarray:
        """The mean of the two middle ranks."""
        low, high = self.rows[(len(self.rows) - 1) // 2], self.rows[len(self.rows) // 2]
        return (low.astype(np.float32) + high) / 2


def window_of(target: int, newest: int, half: int, step: int) -> range:
    """The frames that a window samples: the stride begins at its first frame, which the start of the video cuts off."""
    return range(max(0, target - half), min(newest, target + half) + 1, step)


def windows(planes: dict[int, np.ndarray], targets: list[int], half: int, step: int):
    """(target, samples, background) of each target; planes holds every frame that their windows sample.

    Windows that begin at frames of one remainder by step share all but one or two samples, so that one sorted
    stack follows them: what leaves the window is dropped, what enters is added.
    """
    newest = max(planes)
    for turn in range(step):
        stack, held = None, []
        for target in sorted(t for t in targets if max(0, t - half) % step == turn):
            samples = [f for f in window_of(target, newest, half, step) if f in planes]
            if not samples:
                continue
            if stack is None or not set(held) & set(samples):
                stack, held = SortedStack(len(planes[samples[0]]), planes[samples[0]].dtype), []
            for f in held:
                if f < samples[0]:
                    stack.drop(planes[f])
            for f in samples:
                if not held or f > held[-1]:
                    stack.add(planes[f])
            held = samples
            yield target, samples, stack.median()


def gain(sums: np.ndarray, total: int, count: int, pixels: int) -> np.ndarray:
    """Means of planes less the mean of a window, from exact integer sums."""
    return (sums * count - total) / (count * pixels)


def bars(samples: np.ndarray, background: np.ndarray, gains: np.ndarray, floor: float, factor: float) -> np.ndarray:
    """The floor, raised to factor times the scaled median absolute deviation of the samples (rows) of each pixel."""
    off = samples - background.astype(np.float64) - gains[:, None]
    spread = np.median(np.abs(off - np.median(off, axis=0)), axis=0)
    return np.maximum(floor, factor * 1.4826 * spread)


def disk(radius: float, width: int, height: int) -> list[tuple[int, int]]:
    """(row, half width) of a disk of the rounded radius, cut to the sides of a plane."""
    r = min(math.floor(radius + 0.5), width + height - 2)
    reach = min(r, height - 1)
    return [(dy, min(math.floor(math.sqrt((r - abs(dy)) * (r + abs(dy))) + 0.5), width - 1)) for dy in range(-reach, reach + 1)]


def closed(pixels: np.ndarray, width: int, height: int, rows: list[tuple[int, int]]) -> np.ndarray:
    """Closing of some pixels with a disk: the ascending pixels whose whole disk, as far as it lies in the plane,
    is within a disk of a given one."""
    if not len(pixels):
        return pixels
    dy = np.concatenate([np.full(2 * half + 1, row) for row, half in rows])
    dx = np.concatenate([np.arange(-half, half + 1) for _, half in rows])

    def around(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, x = own[:, None] // width + dy, own[:, None] % width + dx
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return np.where(inside, y * width + x, 0), inside

    at, inside = around(pixels)
    marks = np.zeros(width * height, bool)
    marks[at[inside]] = True
    touched = np.flatnonzero(marks)
    whole = [np.all(marks[at] | ~inside, axis=1) for at, inside in (around(touched[k:k + 4096]) for k in range(0, len(touched), 4096))]
    return touched[np.concatenate(whole)]


def components(pixels: np.ndarray, width: int) -> np.ndarray:
    """For ascending pixels the number of their 8-connected component, in order of first pixels.

    Roots hook to the least root beside them and paths are halved until no edge joins two roots.
    """
    x, ends = pixels % width, []
    for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
        beside = np.flatnonzero((x + dx >= 0) & (x + dx < width))
        there = np.searchsorted(pixels, pixels[beside] + dy * width + dx)
        hit = pixels[np.minimum(there, len(pixels) - 1)] == pixels[beside] + dy * width + dx
        ends.append((beside[hit], there[hit]))
    a, b = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(len(pixels))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return np.unique(root, return_inverse=True)[1]


def measures(pixels: np.ndarray, lit: np.ndarray, magnitude: np.ndarray, strong: np.ndarray, width: int) -> list[dict]:
    """Components of closed pixels: box and centre of all, number and peak of the lit ones, whether one is strong."""
    if not len(pixels):
        return []
    part = components(pixels, width)
    n, x, y = int(part.max()) + 1, pixels % width, pixels // width
    count = np.bincount(part)
    out = {"x": np.bincount(part, x) / count, "y": np.bincount(part, y) / count}
    for name, value in (("left", x), ("top", y)):
        low, high = np.full(n, width * len(pixels) + int(y.max()) + 1), np.full(n, -1)
        np.minimum.at(low, part, value)
        np.maximum.at(high, part, value)
        out[name], out["width" if name == "left" else "height"] = low, high - low + 1
    at = np.searchsorted(pixels, lit)
    held = pixels[np.minimum(at, len(pixels) - 1)] == lit
    own = part[at[held]]
    peak, any_strong = np.zeros(n), np.zeros(n, bool)
    np.maximum.at(peak, own, magnitude[held])
    np.logical_or.at(any_strong, own, strong[held])
    out |= {"hits": np.bincount(own, minlength=n), "peak": peak, "strong": any_strong}
    return [{k: v[i].item() for k, v in out.items()} for i in range(n)]
