"""Text forms of numbers, times, names and colours, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def clock_minutes(seconds: Column) -> Column:
    """m:ss, rounded down."""
    s = F.floor(seconds).cast("long")
    return F.concat((F.floor(s / 60)).cast("string"), F.lit(":"), two(s % 60))


def clock_hundredths(seconds: Column) -> Column:
    """mm:ss.hh, rounded to hundredths."""
    h = F.round(seconds * 100).cast("long")
    minutes = F.floor(h / 6000)
    return F.concat(F.when(minutes < 100, two(minutes)).otherwise(minutes.cast("string")), F.lit(":"), two(F.floor(h % 6000 / 100)), F.lit("."), two(h % 100))


def duration_words(seconds: Column) -> Column:
    """1 h 2 min 5 s, without leading parts that are 0."""
    s = F.round(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit(" h"))), F.when(s >= 60, F.concat(m.cast("string"), F.lit(" min"))),
                       F.concat(r.cast("string"), F.lit(" s")))


def hundredths(x: Column) -> Column:
    return F.round(x * 100) / 100


def decimal(x: Column, places: int, mark: str = ".") -> Column:
    """Rounded, never minus zero, always with a fraction, in a dialect's decimal mark."""
    rounded = F.round(x, places) + F.lit(0.0)
    whole = F.regexp_replace(F.format_string(f"%.{places}f", F.when(rounded == 0, 0.0).otherwise(rounded)), "(\\.[0-9]*?[0-9])0+$", "$1")
    return F.replace(whole, F.lit("."), F.lit(mark)) if mark != "." else whole


def quoted(value: Column, separator: str) -> Column:
    """A CSV cell, in quotes only where it has to be."""
    needs = value.contains(separator) | value.contains('"') | value.contains("\n") | value.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def clip_name(number: Column, count: Column, seconds: Column) -> Column:
    """track_NN_MmSSs.mp4; the number has as many digits as the count, two at least."""
    s = F.floor(seconds).cast("long")
    width = F.greatest(F.lit(2), F.length(count.cast("string")))
    return F.concat(F.lit("track_"), F.lpad(number.cast("string"), width, F.lit("0")), F.lit("_"), F.floor(s / 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s.mp4"))


def period_suffix(period: Column, minutes: int = 10) -> Column:
    three = lambda n: F.lpad(n.cast("string"), 3, "0")
    return F.concat(F.lit("_"), three(period * minutes), F.lit("m-"), three((period + 1) * minutes), F.lit("m"))


def part_suffix(part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.concat(F.lit("_"), part.cast("string"), F.lit("_of_"), parts.cast("string"))).otherwise("")


def html(value: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return value


def json_string(value: Column) -> Column:
    """A JSON string that is safe in a page: control characters, <, >, & and the line separators as escapes."""
    quoted = F.regexp_replace(value, r'(["\\])', r"\\$1")
    special = r"[\x00-\x1f\x7f-\x9f<>&\x{2028}\x{2029}]"
    plain = F.split(quoted, special, -1)
    coded = F.transform(F.regexp_extract_all(quoted, F.lit(special), F.lit(0)), lambda c: F.concat(
        F.lit("\\u"), F.lpad(F.lower(F.hex(F.encode(c, "UTF-16BE"))), 4, "0")))
    return F.concat(F.lit('"'), F.array_join(F.transform(plain, lambda p, i: F.concat(p, F.coalesce(F.get(coded, i), F.lit("")))), ""), F.lit('"'))


def url(value: Column) -> Column:
    """Percent-encoded UTF-8, a blank as %20."""
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def base64(value: Column) -> Column:
    return F.regexp_replace(F.base64(value), r"[\r\n]", "")


def in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Whether a point lies in a polygon (array of x, y), by the parity of the edges that a ray to the right crosses."""
    def crossed(a: Column, i: Column) -> Column:
        b = F.element_at(corners, F.when(i == 0, F.size(corners)).otherwise(i))
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(a["y"] == b["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.transform(corners, crossed), lambda c: c)) % 2 == 1


def error_chain(messages: Column) -> Column:
    """Messages of an error and of what caused it, outermost first, as one text."""
    return F.array_join(messages, ": ")


# Causes of a failure by the path of the error (its kinds, outermost first) and the kind of the system's
# error; the first row that matches counts.
CAUSES = [
    ("detection/input/decode/unusable-path", "", "unusable-name"),
    ("detection/input/decode/open", "not-found", "missing"),
    ("detection/input/decode/open", "permission-denied", "read-refused"),
    ("detection/input/decode/(open|no-video-stream)", "", "not-a-video"),
    ("detection/input/decode/(read|decode)", "", "damaged"),
    ("detection/input/decode/.*", "", "unsupported"),
    ("detection/input/(no-announced-frames|frame-count)", "", "damaged"),
    ("detection/input/.*", "", "unexpected"),
    ("detection/.*", "tuned", "settings"),
    ("detection/.*", "", "unsupported"),
    ("disk-space", "", "disk-full"),
    ("video", "not-found", "missing"),
    ("video", "permission-denied", "read-refused"),
    ("video", "", "unexpected"),
    ("previous/remove", "sharing-violation|lock-violation", "in-use"),
    ("encoders/scratch|source", "", "encoding"),
    ("(folder|files|overview|previous|encoders|clips)(/.*)?", "storage-full|quota-exceeded", "disk-full"),
    ("(folder|files|overview|previous|encoders|clips)(/.*)?", "permission-denied|read-only-filesystem", "forbidden"),
    ("(encoders|clips)(/.*)?", "", "encoding"),
    ("too-many-tracks", "", "too-many-tracks"),
    (".*", "", "unexpected"),
]


def failure_cause(error: Column, system: Column) -> Column:
    """The cause that a user is told, by CAUSES; system is null or empty where no system call failed."""
    out = F.lit(None).cast("string")
    for path, kind, cause in reversed(CAUSES):
        met = error.rlike(f"^(?:{path})$") & (F.coalesce(system, F.lit("")).rlike(f"^(?:{kind})$") if kind else F.lit(True))
        out = F.when(met, cause).otherwise(out)
    return out


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    pair = lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")
    return F.concat(F.lit("#"), pair(r), pair(g), pair(b))


def points_text(points: Column) -> Column:
    """"x,y x,y" of an array of points, rounded; repeats of the point before are left out."""
    texts = F.transform(points, lambda p: F.concat_ws(",", F.round(p["x"]).cast("long"), F.round(p["y"]).cast("long")))
    return F.array_join(F.filter(F.transform(texts, lambda p, i: F.when((i == 0) | (p != texts[F.greatest(i - 1, F.lit(0))]), p)), lambda p: p.isNotNull()), " ")


def region(text: Column) -> Column:
    """"a,b,c,d" as an array of four numbers; null if it is anything else."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull()), parts)


def tick_minutes(length: Column, most: int = 10) -> Column:
    """The first of 1, 2, 5 and 10 minutes of which at most so many fit, else the last."""
    steps = F.array(*map(F.lit, (1, 2, 5, 10)))
    return F.coalesce(F.get(F.filter(steps, lambda s: length / (s * 60) <= most), F.lit(0)), F.lit(10))


def rational(text: Column) -> Column:
    """"num/den" as a struct in lowest terms, its sign on num; null for a zero den or anything else."""
    parts = F.split(text, "/")
    num, den = (F.trim(F.get(parts, F.lit(k))).try_cast("long") for k in (0, 1))

    def reduced(p: Column) -> Column:
        # Euclid's remainders of 64-bit numbers end within 92 steps
        step = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(p["n"]).alias("a"), F.abs(p["d"]).alias("b")), lambda acc, _: F.when(
            acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % F.greatest(acc["b"], F.lit(1))).alias("b"))), lambda acc: acc["a"])
        sign = F.when(p["d"] < 0, -1).otherwise(1)
        return F.struct((sign * F.expr("0") + sign * (p["n"] / step)).cast("long").alias("num"), F.abs(p["d"] / step).cast("long").alias("den"))

    whole = F.struct(num.alias("n"), den.alias("d"))
    return F.when((F.size(parts) == 2) & num.isNotNull() & (den != 0), F.transform(F.array(whole), reduced)[0])
