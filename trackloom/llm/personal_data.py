"""Personal data: candidate spans, boosted trees over their format and context, calibrated selection.

DataFrame functions only.  Base patterns with their checks are always taken.  High-recall generators
propose further spans, which may overlap.  What the trees learn does not come from the base patterns:
base spans are rewritten into forms that no base pattern matches and, as hard negatives, into forms that
fail their check, and stand in their own context; other candidates of the corpus are labelled by their
own check.  Features are small integers, so that the labelled candidates of a whole corpus reduce to
counts per feature vector (at most VECTORS of them per fold and origin), on which the trees of each kind
are fitted; they are then evaluated as
expressions.

All folds over the matches of a text go by blocks of the square root of their number, so that a text of
n matches costs n * sqrt(n) small steps, not n * n.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.folds import below, each, fn, folded, in_blocks, let, none, running, struct, where
from trackloom.llm.frames import fresh

# Kinds in their order, the base patterns, and the generators of further candidates.
KINDS = ["email", "ip", "card", "phone"]
# Possessive repeats and the look-behind leave the matches as they are and the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Endings that may stand apart from their dot; after other blanks a dot ends a sentence.
ENDINGS = "com|net|org|edu|gov|mil|info|biz"
# The words at and dot in any case; between blanks they are a form of their own.
AT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20)"
WORD_DOT = r"(?:\x20?[\[({]\x20?(?:(?i:dot)|\.)\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
DOT = (rf"(?:{WORD_DOT}|\x20?\.\x20?(?=(?:{ENDINGS})(?![A-Za-z0-9-]))|\.)")
POINT = r"(?:\x20?\.\x20?|\x20?[\[({]\x20?(?:(?i:dot)|\.)\x20?[\])}]\x20?|\x20(?i:dot)\x20)"
# What may stand between the digits of a card.
GAP = r"[\x20._/,:-]{0,3}"
GENERATORS = [
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{WORD_DOT}[A-Za-z0-9._%+-]++)*+{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"),
    ("ip", rf"(?<![0-9])[0-9]++(?:{POINT}[0-9]++){{3}}(?![0-9])"),
    ("card", rf"(?<![0-9])[0-9](?:{GAP}[0-9])++"),
    # one of several numbers side by side
    ("card", rf"(?<![0-9])[0-9]{{4}}{GAP}[0-9]{{4}}{GAP}[0-9]{{4}}{GAP}[0-9]{{4,7}}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:(?:\+|00)?[0-9]{1,3}[\x20./-]?|\+)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9])0[0-9]{8,14}(?![0-9])"),
    ("phone", r"(?<![0-9])\(?[0-9]++\)?(?:[\x20./-]{0,2}\(?[0-9]++\)?)++"),
]
# Forms that tell a phone number without a word such as tel: an international prefix, a trunk 0 before the area, or
# three digits in brackets or before a sign, then three and four; and the dates that look alike.
DIALLED = (r"^(?:\+|00)[1-9]|^\(?0[1-9][0-9]{0,4}\)?(?:[\x20./-]{0,2}[0-9]{2,4}){2,4}$"
           r"|^(?:1[\x20./-]{0,2})?(?:\([0-9]{3}\)[\x20./-]{0,2}[0-9]{3}[\x20./-]|[2-9][0-9]{2}[./-][0-9]{3}[./-])[0-9]{4}$")
DATED = r"^[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|^(?:19|20)[0-9]{2}[./-]?[01][0-9][./-]?[0-3][0-9]"
# Groups of a card: four, four, four and the rest, with one sign between them.
GROUPED = r"^[0-9]{4}([\x20._/,:-]{0,3})[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1?[0-9]{1,3})?$"
# What a text must hold for a base match that passes, and for a candidate that may: a cheap test before the search.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
NEEDS = {"email": r"(?i)@|[\[({]\x20?at\x20?[\])}]|\x20at\x20[A-Za-z0-9-]++(?:\x20?[\[({]?\x20?dot|\.)", "ip": rf"[0-9]{POINT}[0-9]",
         "card": rf"[0-9](?:{GAP}[0-9]){{15}}", "phone": r"[0-9](?:[\x20()./-]{0,4}[0-9]){7}"}
CONTEXT = 24
CUES = r"(?i)mail|contact|tel|phone|call|fax|mobile|card|visa|iban|host|server|addr"
PHONE_CUES = r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|contact|dial|sms|whatsapp)\b"

MAIL_CUES = r"(?i)mail|contact|write\s+to|reach|address"

#: Levels of each feature; their product bounds the vectors that reach the driver.
LEVELS = {"kind": 4, "checked": 2, "digits": 8, "marks": 6, "before": 4, "after": 4, "cue": 3}
VECTORS = math.prod(LEVELS.values())
#: Documents by a hash of their id: two parts fit the trees, one calibrates them, one judges the result.
FOLDS, CALIBRATES, JUDGES = 4, 2, 3

SPAN = "struct<kind:int,start:int,end:int>"


MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def found(text: str, pattern: str) -> str:
    """All matches, leftmost and non-overlapping: array of start, end (code points, end exclusive), value,
    before and after (what stands next to the match, up to CONTEXT code points)."""
    def place(values: str, between: str) -> str:
        lengths = f"flatten({each(values, lambda v, i: f'array(char_length({between}[{i}]), char_length({v}))')})"
        return let(running(lengths, lambda a, x: f"{a} + {x}"), lambda ends: each(values, lambda v, i: struct(
            start=f"{ends}[2 * {i}]", end=f"{ends}[2 * {i} + 1]", value=v,
            before=f"right({between}[{i}], {CONTEXT})", after=f"left({between}[{i} + 1], {CONTEXT})")))

    return let(f"regexp_extract_all({text}, r'{pattern}', 0)", lambda values: (
        f"if(size({values}) = 0, {none(f'array<{MATCH}>')}, "
        f"{let(f"split({text}, r'{pattern}', -1)", lambda between: place(values, between))})"))


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    def added(acc: str, i: str) -> str:
        return let(f"cast(substring({number}, -{i}, 1) as int)", lambda d: (
            f"{acc} + if({i} % 2 = 1, {d}, if({d} > 4, {d} * 2 - 9, {d} * 2))"))

    return f"(aggregate(sequence(1, char_length({number})), 0, {fn(added)}) % 10 = 0)"


def quads(value: str) -> str:
    """Whether all numbers of a string are at most 255."""
    parts = each(f"regexp_extract_all({value}, '[0-9]+', 0)", lambda p: f"regexp_replace({p}, '^0+', '')")
    return f"forall({parts}, {fn(lambda p: f'char_length({p}) <= 3 and coalesce(try_cast({p} as int), 0) <= 255')})"


def carded(value: str) -> str:
    return let(digits(value), lambda d: f"if(char_length({d}) between 16 and 19, {luhn(d)}, false)")


def passes(kind: str, value: str) -> str:
    """The check of a base match."""
    return {"email": "true", "ip": quads(value), "card": carded(value),
            "phone": f"(char_length({digits(value)}) between 8 and 15)"}[kind]


def matches(text: str, kind: str) -> str:
    """The matches of a base pattern, in order, with ok: whether they pass their check.  Where the text lacks
    what a passing match needs, there are none."""
    fields = ("start", "end", "value", "before", "after")
    checked = each(found(text, BASE[kind]), lambda m: struct(**{f: f"{m}.{f}" for f in fields}, ok=passes(kind, f"{m}.value")))
    return f"if({text} rlike r'{BASE_NEEDS[kind]}', {checked}, {none(f'array<{MATCH[:-1]},ok:boolean>>')})"


def spans_of(found_: str, kind: int) -> str:
    """The spans of matches that pass: array of kind (its place in KINDS), start, end."""
    return each(where(found_, lambda m: f"{m}.ok"), lambda m: struct(kind=str(kind), start=f"{m}.start", end=f"{m}.end"))


def base(text: str) -> str:
    """Base spans by kind, then start: array of kind, start, end."""
    return f"concat({', '.join(spans_of(matches(text, kind), k) for k, kind in enumerate(KINDS))})"


def features(kind: int, m: str) -> dict[str, str]:
    """Format and context of a candidate, as integers below LEVELS."""
    value, before, after = f"{m}.value", f"{m}.before", f"{m}.after"
    n = f"char_length({digits(value)})"
    size = let(n, lambda k: f"case {' '.join(f'when {k} < {most} then {level}' for level, most in enumerate((4, 7, 8, 10, 12, 16, 17)))} else 7 end")
    marks = (rf"case when {value} rlike r'[\[({{]\x20?(?:(?i:at|dot)|\.)\x20?[\])}}]|\x20(?:AT|DOT)\x20' then 4 when {value} rlike r'\x20(?i:at|dot)\x20' then 5 "
             rf"when startswith({value}, '+') then 1 when contains({value}, ' ') then 2 when {value} rlike '[-()/_,:]' then 3 else 0 end")
    side = lambda c: rf"case when {c} = '' then 0 when {c} rlike r'\s' then 1 when {c} rlike '[0-9.@+-]' then 3 else 2 end"
    # an ending of letters; a blank or the word "at" needs more than that to be an address, and plain words, which any
    # sentence may hold, a name of more than letters or a word such as mail before them
    ending = (rf"({value} rlike r'(?:\.|[\])}}]|\x20)\x20?[A-Za-z]{{2,}}$' and (not contains({value}, ' ') "
              rf"or {value} rlike r'[\[({{]\x20?(?:(?i:at|dot)|\.)\x20?[\])}}]|\x20(?i:dot)\x20|\x20AT\x20|@.*\.\x20?(?:{ENDINGS}|[a-z]{{2}})$') "
              rf"and (not contains({value}, ' at ') or (contains({value}, 'dot') and ({value} rlike r'^[^\x20]*[0-9._%+-][^\x20]*\x20|[\[({{]' or {before} rlike r'{MAIL_CUES}'))))")
    phone = f"({n} between 8 and 15 and ({before} rlike r'{PHONE_CUES}' or ({value} rlike r'{DIALLED}' and {n} >= 9 and not {value} rlike r'{DATED}')))"
    checked = {"ip": lambda: quads(value), "card": lambda: f"({carded(value)} and {value} rlike r'{GROUPED}')", "phone": lambda: phone,
               "email": lambda: ending}[KINDS[kind]]()
    return {"kind": str(kind), "digits": size, "marks": marks, "checked": f"cast({checked} as int)",
            "before": side(f"right({before}, 1)"), "after": side(f"left({after}, 1)"),
            "cue": f"case when {before} rlike r'{PHONE_CUES}' then {2 if KINDS[kind] == 'phone' else 1} when {before} rlike r'{CUES}' then 1 else 0 end"}


CANDIDATES = f"array<struct<start:int,end:int,{','.join(f'{n}:int' for n in LEVELS)}>>"


def candidates(text: str, kinds: list[str] = KINDS) -> str:
    """Spans of the generators of some kinds: array of start, end and features; they may overlap."""
    def of(kind: str, pattern: str) -> str:
        def of_match(m: str) -> str:
            named = features(KINDS.index(kind), m)
            return struct(start=f"{m}.start", end=f"{m}.end", **{n: named[n] for n in LEVELS})

        own = each(found(text, pattern), of_match)
        return f"if({text} rlike r'{NEEDS[kind]}', {own}, {none(CANDIDATES)})"

    return f"concat({', '.join([none(CANDIDATES), *(of(kind, pattern) for kind, pattern in GENERATORS if kind in kinds)])})"


def rewritten(kind: str, value: str) -> tuple[list[str], list[str]]:
    """A base match in forms that base lacks: personal data still, and no longer (they fail their check)."""
    swapped = lambda x, a, b: f"replace({x}, '{a}', '{b}')"
    if kind == "email":
        name, host = f"substring_index({value}, '@', 1)", f"substring_index({value}, '@', -1)"
        return ([f"concat({swapped(name, '.', ' (dot) ')}, ' (at) ', {swapped(host, '.', ' (dot) ')})", f"concat({name}, '[at]', {swapped(host, '.', '[dot]')})",
                 f"concat({name}, ' [at] ', {host})", f"concat({name}, ' at ', {swapped(host, '.', ' dot ')})"],
                [f"concat({name}, ' at ', {host})", f"concat({name}, ' @ ', substring_index({host}, '.', 1), '.42')"])
    if kind == "ip":
        wide, forms = f"regexp_replace({value}, '^[0-9]+', '738')", ("[.]", "(.)", "[dot]", " dot ")
        return [swapped(value, ".", f) for f in forms], [swapped(wide, ".", f) for f in forms]
    number = digits(value)
    if kind == "card":
        grouped = lambda d, by: f"regexp_replace({d}, r'(?<=^.{{4}}|^.{{8}}|^.{{12}})', '{by}')"
        other = f"concat(left({number}, char_length({number}) - 1), cast((cast(right({number}, 1) as int) + 1) % 10 as string))"
        return [grouped(number, by) for by in "./_"], [other, *(grouped(other, by) for by in "./_")]
    plain, drawn = swapped(value, "+", ""), f"crc32({number})"
    day, month, year = (f"lpad(cast({drawn} % {n} + 1 as string), 2, '0')" if n < 99 else f"cast({drawn} % {n} + 1900 as string)" for n in (28, 12, 130))
    return ([plain, rf"regexp_replace({plain}, r'[\x20()-]+', '.')", rf"regexp_replace({plain}, r'[\x20()-]+', '-')", f"concat('00', {plain})"],
            [f"concat_ws('-', {year}, {month}, {day})", f"concat_ws('.', {day}, {month}, {year})", f"concat_ws('/', {day}, {month}, {year})",
             f"concat_ws(' ', left({number}, 2), substring({number}, 3, 3))"])


def harmless(value: str) -> list[str]:
    """Numbers that are nobody's, drawn by a base phone number: a book's, an amount, years, coordinates, a series, an
    identifier, a count, a time."""
    drawn = f"crc32({value})"
    part = lambda by, most, width: f"lpad(cast(({drawn} div {by}) % {most} as string), {width}, '0')"
    year, step = f"({drawn} % 130 + 1900)", f"({drawn} % 9 + 1) * 100"
    return [f"concat('978-', {part(1, 10, 1)}, '-', {part(10, 100, 2)}, '-', {part(1000, 1000000, 6)}, '-', {part(7, 10, 1)})",
            f"concat_ws(' ', {drawn} % 999 + 1, {part(9, 1000, 3)}, {part(999, 1000, 3)}, {part(99999, 1000, 3)})",
            f"concat_ws(' ', {year}, {year} + 1, {year} + 2, {year} + 3)",
            f"concat({drawn} % 90, '.', {part(3, 10000, 4)}, ' ', {drawn} % 180, '.', {part(77, 10000, 4)})",
            f"concat_ws(' ', {step}, 2 * {step}, 3 * {step}, 4 * {step}, 5 * {step})",
            f"concat_ws(' ', {year}, {part(5, 10000, 4)}, {part(55555, 10000, 4)})",
            f"cast({drawn} + 1000000000 as string)",
            f"concat({year}, {part(2, 12, 2)}, {part(3, 28, 2)}, '-', {part(4, 24, 2)}, {part(5, 60, 2)}, {part(6, 60, 2)})"]


def edges(taken: str) -> str:
    """What meets() searches: starts of spans in order, and the furthest end so far."""
    ordered = f"array_sort({each(taken, lambda s: struct(start=f'{s}.start', end=f'{s}.end'))})"
    return let(ordered, lambda o: struct(starts=each(o, lambda s: f"{s}.start"),
                                         ends=running(each(o, lambda s: f"{s}.end"), lambda a, x: f"greatest({a}, {x})")))


def meets(span: str, known: str) -> str:
    """Whether a span overlaps one of the spans of edges()."""
    return let(below(f"{known}.starts", f"{span}.end"), lambda n: f"if({n} = 0, false, {known}.ends[{n} - 1] > {span}.start)")


@dataclass(frozen=True)
class Stump:
    """A tree of depth two: the feature and bound of the root, and for each side a feature, a bound and two values."""

    root: tuple[str, int]
    left: tuple[str, int, float, float]
    right: tuple[str, int, float, float]


@dataclass(frozen=True)
class Model:
    """Boosted trees with the score from which a candidate is taken (infinite: none is)."""

    bias: float
    trees: tuple[Stump, ...]
    threshold: float

    def score(self, candidate: str) -> str:
        """The score of a struct of features."""
        def side(s):
            return f"if({candidate}.{s[0]} <= {s[1]}, {s[2]!r}D, {s[3]!r}D)"

        trees = [f"if({candidate}.{t.root[0]} <= {t.root[1]}, {side(t.left)}, {side(t.right)})" for t in self.trees]
        return f"({' + '.join([f'{self.bias!r}D', *trees])})"

    def value(self, vector: dict[str, int]) -> float:
        total = self.bias
        for t in self.trees:
            s = t.left if vector[t.root[0]] <= t.root[1] else t.right
            total += s[2] if vector[s[0]] <= s[1] else s[3]
        return total


@dataclass(frozen=True)
class Models:
    """A model for each of KINDS; its threshold is the lowest of theirs.

    figures: by kind, on the documents that neither fitted nor calibrated, the recall on rewritten spans (those
    that no generator proposes count as missed) and the precision among all candidates that may be added.
    """

    kinds: tuple[Model, ...]
    figures: dict[str, dict[str, float]] = field(default_factory=dict, compare=False)

    @property
    def threshold(self) -> float:
        return min(m.threshold for m in self.kinds)


def _leaf(rows: list, l2: float = 1.0) -> tuple[float, float]:
    """Newton step and gain of a leaf; rows: (vector, weight, label share, probability)."""
    g = sum(w * (y - p) for _, w, y, p in rows)
    h = sum(w * p * (1 - p) for _, w, _, p in rows) + l2
    return g / h, g * g / h


def _best(rows: list, names: list[str]) -> tuple[float, str, int, float, float]:
    top = (-1.0, names[0], 0, *(2 * [_leaf(rows)[0]]))
    for name in names:
        for bound in range(LEVELS[name] - 1):
            low = [r for r in rows if r[0][name] <= bound]
            if not low or len(low) == len(rows):
                continue
            (a, ga), (b, gb) = _leaf(low), _leaf([r for r in rows if r[0][name] > bound])
            if ga + gb > top[0]:
                top = (ga + gb, name, bound, a, b)
    return top


def boost(counts: list[tuple[dict[str, int], float, float]], rounds: int = 12, rate: float = 0.5) -> Model:
    """Trees for (vector, positives, negatives), by Newton boosting of the logistic loss."""
    names = list(LEVELS)
    positive, negative = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not positive or not negative:
        return Model(0.0, (), math.inf)
    bias = math.log(positive / negative)
    scores = [bias] * len(counts)
    trees = []
    for _ in range(rounds):
        rows = [(v, a + b, a / (a + b), 1 / (1 + math.exp(-s))) for (v, a, b), s in zip(counts, scores)]
        _, name, bound, _, _ = _best(rows, names)
        sides = []
        for part in ([r for r in rows if r[0][name] <= bound], [r for r in rows if r[0][name] > bound]):
            _, n, b, low, high = _best(part, names) if part else (0, name, 0, 0.0, 0.0)
            sides.append((n, b, round(rate * low, 6), round(rate * high, 6)))
        trees.append(Stump((name, bound), *sides))
        one = Model(0.0, (trees[-1],), 0.0)
        scores = [s + one.value(v) for s, (v, _, _) in zip(scores, counts)]
    return Model(bias, tuple(trees), math.inf)


def calibrated(model: Model, counts: list[tuple[dict[str, int], float, float]], precision: float, least: int) -> Model:
    """The model with the lowest score from which held-out candidates reach the precision.

    Pools of adjacent scores are merged until their precision rises with the score (isotonic
    calibration); a pool is trusted with at least `least` candidates at and above it.
    """
    by_score = sorted(((model.value(v), a, a + b) for v, a, b in counts), key=lambda x: x[0])
    pools: list[list[float]] = []
    for score, a, n in by_score:
        pools.append([score, a, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a2, n2 = pools.pop()
            pools[-1][1] += a2
            pools[-1][2] += n2
    threshold, above = math.inf, 0.0
    for k in reversed(range(len(pools))):
        score, a, n = pools[k]
        above += n
        if a < precision * n:
            break
        if above >= least:
            # halfway to what is refused: vectors that were never met fall to the nearer side
            refused = max((x for x, _, _ in by_score if x < score), default=score - 2)
            threshold = (score + refused) / 2
    return Model(model.bias, model.trees, threshold)


def fit(docs: DataFrame, row_id: str = "doc_id", text: str = "text", precision: float = 0.98, least: int = 20) -> Models:
    """Models for the candidates of all docs; see the head of this module for their labels.

    Of each base span two rewritten forms, by a hash, are positives, unless their check cannot tell them from ordinary
    words and numbers, and one is a hard negative; of each phone number two of harmless() are too.  A candidate
    that a base span of its kind covers is a positive that helps to fit but, as it cannot be added, does not
    calibrate.  Any other candidate of the corpus is labelled by its own check: a plausible ending, octets,
    Luhn in groups of four, 8 to 15 digits after a word such as tel; a phone number by its form alone has no label.  One that overlaps a base span, or is part of a longer
    match which failed its check, such as one of two numbers side by side, has no label.  Counts per
    fold, origin and feature vector, at most 12 * VECTORS rows, reach the driver.  A kind without positive
    candidates selects nothing.  Null texts count as empty; an empty table gives models that add nothing.
    """
    own = docs.selectExpr(f"cast(pmod(xxhash64(`{row_id}`), {FOLDS}) as int) as fold", f"coalesce(`{text}`, '') as t")
    met = own.selectExpr("fold", "t", *(f"{matches('t', k)} as m_{k}" for k in KINDS))
    kept = f"concat({', '.join(spans_of(f'm_{k}', i) for i, k in enumerate(KINDS))})"
    met = met.selectExpr("*", f"{edges(kept)} as taken", *(f"{each(f'm_{k}', lambda m: f'{m}.start')} as s_{k}" for k in KINDS),
                         *(f"{candidates('t', [k])} as c_{k}" for k in KINDS))

    def plain(kind: str) -> str:
        """Labelled candidates of the texts; the one match that may cover a candidate is the last that begins no later."""
        def judged(c: str, at: str) -> str:
            covers = f"coalesce({at}.start <= {c}.start and {at}.end >= {c}.end, false)"
            # a phone number by its form alone may be one or not
            sound = f"if({c}.checked = 0, 0, {f'if({c}.cue = 2, 1, null)' if kind == 'phone' else '1'})"
            label = (f"case when {covers} and {at}.ok then 1 when {covers} and {at}.end - {at}.start > {c}.end - {c}.start then null "
                     f"when {meets(c, 'taken')} then null else {sound} end")
            return let(label, lambda x: struct(
                origin=f"if({covers} and {at}.ok, 'covered', 'plain')", label=x, of=str(KINDS.index(kind)), snippet="''", s="0", e="0",
                                               **{n: f"{c}.{n}" for n in LEVELS}))

        last = lambda c: f"try_element_at(m_{kind}, greatest({below(f's_{kind}', f'{c}.start + 1')}, 1))"
        every = each(f"c_{kind}", lambda c: let(last(c), lambda at: judged(c, at)))
        return where(every, lambda x: f"{x}.label is not null")

    def noisy(kind: str) -> str:
        """Rewritten base spans, as snippets of their context."""
        def forms(m: str) -> str:
            good, bad = rewritten(kind, f"{m}.value")
            one = lambda value, label: struct(
                origin="'rewritten'", label=label, of=str(KINDS.index(kind)), snippet=f"concat({m}.before, {value}, {m}.after)",
                s=f"char_length({m}.before)", e=f"char_length({m}.before) + char_length({value})", **{n: "cast(null as int)" for n in LEVELS})
            # numbers that are nobody's stand in a context without a word such as tel
            free = lambda value: struct(
                origin="'rewritten'", label="0", of=str(KINDS.index(kind)), snippet=f"concat('the ', {value}, ' ')",
                s="4", e=f"4 + char_length({value})", **{n: "cast(null as int)" for n in LEVELS})
            numbers = harmless(f"{m}.value") if kind == "phone" else []
            drawn = f"cast(pmod(xxhash64({m}.value, {m}.start), 12) as int)"
            return let(drawn, lambda k: "array({})".format(", ".join((
                one(f"array({', '.join(good)})[{k} % {len(good)}]", "1"), one(f"array({', '.join(good)})[({k} + 1) % {len(good)}]", "1"),
                one(f"array({', '.join(bad)})[{k} % {len(bad)}]", "0"),
                *(free(f"array({', '.join(numbers)})[({k} + {i}) % {len(numbers)}]") for i in range(2 if numbers else 0))))))

        return f"flatten({each(where(f'm_{kind}', lambda m: f'{m}.ok'), forms)})"

    rows = met.selectExpr("fold", f"explode(concat({', '.join([*map(plain, KINDS), *map(noisy, KINDS)])})) as x")
    proposed = " ".join(f"when x.of = {i} then " + where(candidates("x.snippet", [k]), lambda c: f"{c}.start <= x.s and x.e <= {c}.end")
                        for i, k in enumerate(KINDS))
    rows = rows.selectExpr("fold", "x", f"if(x.origin = 'rewritten', try_element_at(case {proposed} end, 1), null) as c")
    # a rewritten form that its check does not tell from ordinary words and numbers teaches nothing
    rows = rows.filter("not (x.origin = 'rewritten' and x.label = 1 and coalesce(c.checked, 1) = 0)")
    counts = rows.selectExpr("fold", "x.origin", "x.of", "x.label", *(f"coalesce(x.{n}, c.{n}) as {n}" for n in LEVELS)).groupBy(
        "fold", "origin", "of", *LEVELS).agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    fitted: dict[int, dict] = {k: {} for k in range(len(KINDS))}
    late: dict[tuple[int, int], list] = {(f, k): [] for f in (CALIBRATES, JUDGES) for k in range(len(KINDS))}
    missed = [0.0] * len(KINDS)
    for r in sorted(counts.collect(), key=lambda r: tuple((x is not None, x) for x in r)):
        vector_ = {n: r[n] for n in LEVELS}
        if r["kind"] is None:  # no generator proposed it
            missed[r["of"]] += r["yes"] * (r["fold"] == JUDGES)
        elif r["fold"] in (CALIBRATES, JUDGES):
            if r["origin"] != "covered":
                late[r["fold"], r["of"]].append((vector_, float(r["yes"]), float(r["n"] - r["yes"])))
        else:
            key = tuple(vector_.items())
            a, b = fitted[r["of"]].get(key, (0.0, 0.0))
            fitted[r["of"]][key] = (a + r["yes"], b + r["n"] - r["yes"])
    made, figures = [], {}
    for k, kind in enumerate(KINDS):
        model = calibrated(boost([(dict(v), a, b) for v, (a, b) in fitted[k].items()]), _pooled(late[CALIBRATES, k]), precision, least)
        taken = [c for c in late[JUDGES, k] if c[0]["checked"] and model.value(c[0]) >= model.threshold]
        right, all_ = sum(c[1] for c in taken), sum(c[1] for c in late[JUDGES, k]) + missed[k]
        figures[kind] = {"rewritten": all_, "recall": right / all_ if all_ else math.nan,
                         "precision": right / (right + sum(c[2] for c in taken)) if taken else math.nan}
        made.append(model)
    return Models(tuple(made), figures)


def _pooled(counts: list[tuple[dict[str, int], float, float]]) -> list[tuple[dict[str, int], float, float]]:
    """One entry a vector."""
    out: dict[tuple, tuple[float, float]] = {}
    for v, a, b in counts:
        x, y = out.get(tuple(v.items()), (0.0, 0.0))
        out[tuple(v.items())] = (x + a, y + b)
    return [(dict(v), a, b) for v, (a, b) in out.items()]


def analysed(df: DataFrame, text: str, models: Models) -> DataFrame:
    """df with base_spans, the base spans, and all_spans: with, where they overlap none, the candidates that the
    models select (of overlapping ones the first by start, then the longer); what fails its check is never selected.

    Both are arrays of kind, start, end, by kind, then start; a null text has none.  Rows, repeated ones too,
    pass one to one; new columns get underscores before names that df has.
    """
    kept, every, known, picked = fresh(df.columns, "base_spans", "all_spans", "known", "picked")
    value = f"coalesce(`{text}`, '')"
    df = df.selectExpr("*", f"{base(value)} as {kept}")
    active = [(k, m) for k, m in zip(KINDS, models.kinds) if math.isfinite(m.threshold)]
    if not active:
        return df.withColumn(every, F.col(kept))

    def of(kind: str, model: Model) -> str:
        return where(candidates(value, [kind]), lambda c: f"{c}.checked = 1 and {model.score(c)} >= {model.threshold!r}D and not {meets(c, known)}")

    def taken(last: str, c: str) -> tuple[str, str]:
        span = struct(kind=f"{c}.kind", start=f"{c}.start", end=f"-{c}.back")
        return (f"if({c}.start < {last}, {last}, -{c}.back)", f"if({c}.start < {last}, {none(f'array<{SPAN}>')}, array({span}))")

    ordered = each(f"concat({', '.join(of(k, m) for k, m in active)})", lambda c: struct(start=f"{c}.start", back=f"-{c}.end", kind=f"{c}.kind"))
    df = df.selectExpr("*", f"{edges(kept)} as {known}").selectExpr("*", f"array_sort({ordered}) as {picked}")
    more = folded(picked, "-1", taken, f"array<{SPAN}>")
    return df.selectExpr("*", f"if(size({picked}) = 0, {kept}, array_sort(concat({kept}, {more}))) as {every}").drop(known, picked)


def listed(found_spans: str) -> Column:
    """kind:start:end, comma-joined, of a column of spans."""
    names = f"array({', '.join(map(repr, KINDS))})"
    return F.expr(f"array_join({each(found_spans, lambda s: f"concat_ws(':', {names}[{s}.kind], {s}.start, {s}.end)")}, ',')")


def redacted(text: str, found_spans: str) -> Column:
    """The text (a column) with each span replaced by its kind in brackets; of overlapping spans what is left
    after the earlier one.  A text without spans stays as it is, a null text null."""
    names = f"array({', '.join(repr(f'[{k.upper()}]') for k in KINDS)})"
    ordered = f"array_sort({each(found_spans, lambda s: struct(start=f'{s}.start', end=f'{s}.end', kind=f'{s}.kind'))})"
    piece = "array<struct<start:int,end:int,mark:string>>"

    def step(at: str, s: str) -> tuple[str, str]:
        # the clear text before a span, and the mark that follows it
        clear = struct(start=at, end=f"greatest({at}, {s}.start)", mark=f"{names}[{s}.kind]")
        return f"greatest({at}, {s}.end)", f"if({s}.end <= {at}, {none(piece)}, array({clear}))"

    def block(own: str) -> str:
        # a block's part of the text is cut out once, its pieces from that
        part = f"substring({text}, {own}[0].start + 1, element_at({own}, -1).end - {own}[0].start)"
        return let(part, lambda t: f"array_join({each(own, lambda p: (
            f'concat(substring({t}, {p}.start - {own}[0].start + 1, {p}.end - {p}.start), {p}.mark)'))}, '')")

    rest = f"array_max({each(found_spans, lambda s: f'{s}.end')})"
    joined = let(folded(ordered, "0", step, piece), lambda pieces: (
        f"concat(array_join({in_blocks(pieces, lambda b: let(b, block))}, ''), substring({text}, {rest} + 1, char_length({text})))"))
    return F.expr(f"if(size({found_spans}) > 0, {joined}, {text})")
