"""Folds over arrays as SQL texts, which are parsed once where columns are made of them.

A fold that appends to an array copies it at every step; these fold by blocks of the square root of the
array's length, so that n values cost n * sqrt(n) small copies, not n * n.
"""

from __future__ import annotations

import inspect
import itertools

_names = itertools.count()


def fn(body) -> str:
    """A lambda function of as many parameters as body takes, with names that no other one has."""
    names = [f"v{next(_names)}" for _ in inspect.signature(body).parameters]
    return f"{names[0] if len(names) == 1 else f'({', '.join(names)})'} -> {body(*names)}"


def let(value: str, use) -> str:
    """use(value) with value computed once."""
    return f"transform(array({value}), {fn(use)})[0]"


def each(values: str, use) -> str:
    return f"transform({values}, {fn(use)})"


def where(values: str, test) -> str:
    return f"filter({values}, {fn(test)})"


def none(kind: str) -> str:
    return f"cast(array() as {kind})"


def struct(**fields: str) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"


def in_blocks(values: str, use) -> str:
    """use of consecutive parts of an array, about as many as each is long; values must not be empty."""
    return let(f"cast(ceil(sqrt(size({values}))) as int)", lambda size: each(
        f"sequence(0, cast((size({values}) - 1) div {size} as int))", lambda j: use(f"slice({values}, {j} * {size} + 1, {size})")))


def folded(values: str, state: str, step, items: str) -> str:
    """The items (an array type) that a fold of values gives: step(state, value) is the next state and an array.

    Values are folded block by block, and only the items of a block are copied as it grows.
    """
    def taken(acc: str, value: str) -> str:
        after, more = step(f"{acc}.state", value)
        return struct(state=after, out=f"concat({acc}.out, {more})")

    def block(acc: str, own: str) -> str:
        first = struct(state=f"{acc}.state", out=none(items))
        return let(f"aggregate({own}, {first}, {fn(taken)})", lambda done: struct(
            state=f"{done}.state", out=f"array_append({acc}.out, {done}.out)"))

    def whole(all_: str) -> str:
        start = struct(state=state, out=none(f"array<{items}>"))
        done = f"aggregate({in_blocks(all_, lambda b: b)}, {start}, {fn(block)}, {fn(lambda acc: f'flatten({acc}.out)')})"
        return f"if(size({all_}) = 0, {none(items)}, {done})"

    return let(values, whole)


def running(values: str, use) -> str:
    """Prefixes of an array of integers: use(prefix, value) is the next one, from 0."""
    return folded(values, "0", lambda before, x: (use(before, x), f"array({use(before, x)})"), "array<int>")


def below(starts: str, bound: str) -> str:
    """How many of an ascending array are below the bound: a binary search."""
    def half(acc: str, _: str) -> str:
        return let(f"cast(({acc}.low + {acc}.high) div 2 as int)", lambda middle: (
            f"case when {acc}.low >= {acc}.high then {acc} when {starts}[{middle}] < {bound} "
            f"then {struct(low=f'{middle} + 1', high=f'{acc}.high')} else {struct(low=f'{acc}.low', high=middle)} end"))

    return (f"aggregate(sequence(0, cast(ceil(log2(size({starts}) + 1)) as int)), {struct(low='0', high=f'size({starts})')}, "
            f"{fn(half)}, {fn(lambda acc: f'{acc}.low')})")
