"""Vectorised pre-tokenisation: code-point classes and a scan of transition functions, without regex.

The splitting rule of the rank files

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is a Mealy machine over code-point classes once each symbol also says whether the next
code point is white space and whether an apostrophe is followed by a contraction.  Every
symbol is then a function from states to states, and functions compose associatively: the
code points are cut into blocks, the function of every block is built for all blocks at
once, block functions are scanned, and a second sweep from the now known block states
yields all boundaries.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

# classes of code points
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)

# symbols: the class, seen with one code point of look-ahead
(S_LETTER, S_NUMBER, S_OTHER, S_CONTRACT2, S_CONTRACT3,
 S_SPACE_LAST, S_SPACE_MORE, S_BLANK_LAST, S_BLANK_MORE) = range(9)
SYMBOLS = 9

# states: what the code points read so far have left open
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, SHORT1, SHORT2, CLOSED) = range(9)
STATES = 9

BLOCK = 64

# The White_Space property of Unicode.
WHITE_SPACE = [
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]

# Letters and numbers of Unicode 16, for a Python whose tables are older.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]


@cache
def class_table() -> np.ndarray:
    """The class of each code point, by the general categories of this Python's Unicode tables."""
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    category = unicodedata.category
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        kind = kinds.get(category(chr(c))[0])
        if kind is not None:
            table[c] = kind
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first:last + 1] = kind
    for first, last in WHITE_SPACE:
        table[first:last + 1] = BLANK
    table[0x20] = SPACE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The machine: the next state, and whether a piece starts at this code point."""
    if state == SHORT1:
        return CLOSED, False
    if state == SHORT2:
        return SHORT1, False
    if symbol in (S_SPACE_LAST, S_BLANK_LAST):
        # the last white space before visible text always begins a piece; only U+0020 joins what follows
        return (JOINING if symbol == S_SPACE_LAST else FRESH), True
    if symbol in (S_SPACE_MORE, S_BLANK_MORE):
        return IN_BLANKS, state != IN_BLANKS
    if symbol in (S_CONTRACT2, S_CONTRACT3) and state not in (IN_OTHERS, JOINING):
        return (SHORT1 if symbol == S_CONTRACT2 else SHORT2), True
    now = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return now, state not in (now, JOINING)


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables by symbol * STATES + state.  The symbols from SYMBOLS on are those that begin a text:
    their function is constant, which cuts the scan between texts."""
    to = np.zeros(2 * SYMBOLS * STATES, dtype=np.uint8)
    starts = np.zeros(2 * SYMBOLS * STATES, dtype=np.bool_)
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            to[symbol * STATES + state], starts[symbol * STATES + state] = _step(state, symbol)
            at = (symbol + SYMBOLS) * STATES + state
            to[at], starts[at] = _step(FRESH, symbol)[0], True
    return to, starts


def symbols(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The symbol of each code point; begins: the indexes at which texts begin."""
    n = len(points)
    kind = class_table()[points]
    first = np.zeros(n + 1, dtype=np.bool_)
    first[begins] = True
    first[n] = True
    ends = first[1:]
    blank = kind >= SPACE
    next_visible = np.zeros(n, dtype=np.bool_)
    next_visible[:-1] = ~blank[1:]
    next_visible &= ~ends
    out = kind.copy()
    out[kind == SPACE] = S_SPACE_MORE
    out[kind == BLANK] = S_BLANK_MORE
    out[(kind == SPACE) & next_visible] = S_SPACE_LAST
    out[(kind == BLANK) & next_visible] = S_BLANK_LAST
    at = np.flatnonzero(points == 0x27)
    at = at[at + 1 < n]
    at = at[~ends[at]]
    if len(at):
        one = points[at + 1]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_CONTRACT2
        far = at[at + 2 < n]
        far = far[~ends[far + 1]]
        a, b = points[far + 1], points[far + 2]
        double = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        out[far[double]] = S_CONTRACT3
    out[begins] += SYMBOLS
    return out


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Indexes at which pieces start.  begins: first index of each non-empty text, 0 among them."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    to, starts = machine()
    symbol = symbols(points, begins)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
    padded[:n] = symbol
    # rows: the k-th symbol of every block
    by_place = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) * STATES
    # the function of each block: where each state leads
    leads = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, axis=1)
    for row in by_place:
        leads = to[row[None, :] + leads]
        if (leads == leads[0]).all():
            # every function is constant by now: a single state goes on
            break
    else:
        row = None
    constant = (leads == leads[0]).all()
    if constant:
        # finish the sweep with one state; what the first symbols made constant stays so
        state = np.zeros(blocks, dtype=np.uint8)
        for row in by_place:
            state = to[row + state]
        entry = np.empty(blocks, dtype=np.uint8)
        entry[0] = FRESH
        entry[1:] = state[:-1]
    else:
        entry = scan(leads)
    flags = np.empty((BLOCK, blocks), dtype=np.bool_)
    state = entry
    for k, row in enumerate(by_place):
        at = row + state
        flags[k] = starts[at]
        state = to[at]
    return np.flatnonzero(flags.T.reshape(-1)[:n])


def scan(leads: np.ndarray) -> np.ndarray:
    """Exclusive scan of functions (states x blocks) by doubling; the state in which each block begins."""
    states, blocks = leads.shape
    done = leads.copy()
    shift = 1
    while shift < blocks:
        # done[:, i] becomes done[:, i] after done[:, i - shift]
        later = done[:, shift:]
        earlier = done[:, :-shift]
        done = np.concatenate([done[:, :shift], np.take_along_axis(later, earlier.astype(np.intp), axis=0)], axis=1)
        shift *= 2
    entry = np.empty(blocks, dtype=np.uint8)
    entry[0] = FRESH
    entry[1:] = done[FRESH, :-1]
    return entry


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, the byte offset of each piece (with the end), and the number of pieces of each text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    begins = (ends - lengths)[lengths > 0]
    starts = piece_starts(points, begins)
    width = (np.uint8(1) + (points > 0x7F).view(np.uint8) + (points > 0x7FF).view(np.uint8)
             + (points > 0xFFFF).view(np.uint8))
    offset = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(width, out=offset[1:])
    cuts = np.append(offset[starts], offset[-1])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return joined.encode("utf-8", "surrogatepass"), cuts, counts


def in_groups(texts: list[str], most: int = 1 << 18):
    """Ranges of consecutive texts of about so many code points in all; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)
