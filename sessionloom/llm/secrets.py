"""Secrets by a battery of randomness tests, in DataFrame expressions alone.

Base spans are assignments to telling names, access keys and long hexadecimal runs. Candidates beyond them are long runs of key
characters. For each value the narrowest encoding that holds its characters is inferred (hexadecimal, base32, base36, base62,
base64), and tests ask whether it could be drawn evenly from that alphabet: chi-squared uniformity of characters and of digits, small
and capital letters, runs above and below the alphabet's middle, and serial correlation of neighbouring characters. The sum of
the squared scores is the value's deviance: 4 to 6 on average for a random string, large for words.

What ordinary text reaches is measured, not assumed: each value gets a decoy, the text just before it, reduced to the same
alphabet and cut to the same length. Decoys tell for each encoding how the deviance of text grows with length, so a value gets a
probability that text of its length looks as random. Benjamini and Hochberg's rule over all values of the corpus then keeps the
part of false discoveries under RATE; short values need more, as their decoys deviate less. A value that fails the tests
of randomness themselves is never kept.

Only sums by encoding and class of length, and counts by class of probability, reach the driver: bounded, for any corpus.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import written

KINDS = ("assign", "access", "hex", "random")
# Base patterns, as the contract fixes them; only the assignment's letters may be of either case.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Least characters of an assigned value, and of a candidate beyond the base.
LEAST_ASSIGNED, LEAST = 6, 16
RANDOM = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RANDOM}
#: Encodings from narrow to wide, with their alphabets in natural order.
DIGITS, UPPER, LOWER = string.digits, string.ascii_uppercase, string.ascii_lowercase
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base36_upper": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64_url": UPPER + LOWER + DIGITS + "-_",
}
KEY = UPPER + LOWER + DIGITS + "+/-_"
#: Text before a value that its decoy is made of, classes of length (of the log), and classes of probability.
BEFORE, LENGTHS, CHANCES = 512, 48, 400
#: Part of false discoveries, and the deviance that a random string exceeds one time in a thousand at most (chi-squared, 6
#: degrees).
RATE, MOST_DEVIANCE = 0.01, 22.46
#: Decoys that the belief before any data counts for: log deviance by log length, and its spread.
PRIOR, SLOPE, START, SPREAD = 8.0, 1.5, 2.5, 0.8

_FOUND = "array<struct<start:int,end:int,m:string,before:string>>"


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def located(text: Column, pattern: str, piece: int = 256) -> Column:
    """The matches of a pattern, leftmost and not overlapping: array of (start, end, match, the text before it back to the last
    match, BEFORE characters at most), in code points. Walked in pieces, so many matches in one text stay cheap."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("long"), m.alias("m"), F.substring(gap, -BEFORE, BEFORE).alias("before")))
    none = F.expr(f"cast(array() as {_FOUND})")

    def cut(pairs: Column) -> Column:
        last = F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / piece).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(pairs, i * piece + 1, piece))

    def starts(pieces: Column) -> Column:
        width = F.transform(pieces, lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x.gap + x.long))
        return F.aggregate(width, F.expr("array(0)"), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        return F.struct((start + x.long).alias("at"), F.concat(acc.spans, F.array(F.struct(start.alias("start"), (start + x.long).alias("end"), x.m.alias("m"), x.before.alias("before")))).alias("spans"))

    def walk(some: Column, at: Column) -> Column:
        return F.when(some.isNull(), none).otherwise(F.aggregate(some, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc.spans))

    return let(F.filter(pairs, lambda x: x.m.isNotNull()), lambda found: let(cut(found), lambda pieces: F.flatten(F.zip_with(pieces, starts(pieces), walk))))


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def encoding(value: Column) -> Column:
    """The place of the narrowest encoding that holds all characters; null for others, for decimal numbers, and for less than
    LEAST_ASSIGNED characters."""
    kind = F.coalesce(*[F.when(value.rlike(f"^[{inside(a)}]+$"), F.lit(i)) for i, a in enumerate(ENCODINGS.values())])
    return F.when(~value.rlike("^[0-9]*$") & (F.length(value) >= LEAST_ASSIGNED), kind)


def inside(alphabet: str) -> str:
    """An alphabet as the inner part of a pattern's brackets."""
    return alphabet.replace("-", r"\-")


def deviance(value: Column, code: Column) -> Column:
    """Sum of the squared scores of the tests, for a value in the encoding at that place; null where that is null."""
    names = list(ENCODINGS.values())
    alphabet = F.element_at(F.array(*[F.lit(a) for a in names]), code + 1)
    halves = F.element_at(F.array(*[F.lit("0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for a in names]), code + 1)
    n, size = F.length(value).cast("double"), F.length(alphabet).cast("double")
    some = lambda x, what: (F.length(x) - F.length(F.replace(x, what, F.lit("")))).cast("double")
    # uniformity: exact mean and variance of the statistic for so few characters
    squares = F.aggregate(characters(alphabet), F.lit(0.0), lambda a, c: a + F.pow(some(value, c), F.lit(2.0)))
    chi = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)

    # uniformity of the kinds of characters
    kinds = "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in KEY)
    here, there = (let(F.call_function("translate", x, F.lit(KEY), F.lit(kinds)), lambda sides: F.array(*[some(sides, F.lit(k)) for k in "dluo"])) for x in (value, alphabet))
    share = F.zip_with(here, there, lambda h, t: F.when(t > 0, F.pow(h - n * t / size, F.lit(2.0)) / (n * t / size)).otherwise(F.lit(0.0)))
    kind = F.aggregate(share, F.lit(0.0), lambda a, x: a + x)

    # runs above and below the middle
    def runs(sides: Column) -> Column:
        zeros = some(sides, F.lit("0"))
        both = 2 * zeros * (n - zeros)
        turns = (some(sides, F.lit("01")) + some(sides, F.lit("10"))) / 2
        spread = both * (both - n) / (n * n * (n - 1))
        return F.when(spread > 0, (turns - both / n) / F.sqrt(spread)).otherwise(F.sqrt(n))  # all on one side

    # correlation of each character with the next, the last with the first
    def serial(x: Column) -> Column:
        start = F.struct(F.element_at(x, -1).alias("last"), F.lit(0.0).alias("total"), F.lit(0.0).alias("square"), F.lit(0.0).alias("lag"))
        more = lambda a, c: F.struct(c.alias("last"), (a["total"] + c).alias("total"), (a.square + c * c).alias("square"), (a.lag + a["last"] * c).alias("lag"))
        spread = lambda a: n * a.square - a["total"] * a["total"]
        r = F.aggregate(x, start, more, lambda a: F.when(spread(a) > 0, (n * a.lag - a["total"] * a["total"]) / spread(a)).otherwise(F.lit(1.0)))
        return (r + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n

    run = let(F.call_function("translate", value, alphabet, halves), runs)
    lag = let(F.transform(characters(value), lambda c: F.instr(alphabet, c).cast("double")), serial)
    two = F.lit(2.0)
    return F.pow(chi, two) + kind + F.pow(run, two) + F.pow(lag, two)


def decoy(before: Column, code: Column, long: Column) -> Column:
    """The text before a value in the value's alphabet and of its length, or less where there is less; other long runs of key
    characters are left out."""
    plain = F.regexp_replace(before, rf"[A-Za-z0-9+/_=-]{{{LEAST},}}", "")
    kept = F.coalesce(*[F.when(code == i, F.regexp_replace(plain, f"[^{inside(a)}]", "")) for i, a in enumerate(ENCODINGS.values())])
    return F.right(kept, F.least(long, F.lit(BEFORE)))


#: Only texts that pass these can have a match; they are cheap.
MAYBE = {
    "assign": lambda t: t.rlike(f"(?i:{NAMES})"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(r"[0-9a-f]{24}"),
    "random": lambda t: t.rlike(rf"[A-Za-z0-9+/_-]{{{LEAST}}}"),
}


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a column secrets: array of start, end, kind (place in KINDS), code (place in ENCODINGS, or null), long
    (characters tested), deviance, decoy_long, decoy_deviance (null where there is no decoy). Spans of kind random that touch a
    base span are left out. Columns named secrets, secrets_base or secrets_more are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def spans(kind: str) -> Column:
        found = located(text, PATTERNS[kind])
        value = lambda x: F.regexp_extract(x.m, ASSIGN, 1) if kind == "assign" else x.m
        if kind == "assign":
            found = F.filter(found, lambda x: F.length(value(x)) >= LEAST_ASSIGNED)

        def tested(x: Column) -> Column:
            return let(F.rtrim(value(x), F.lit("=")), lambda v: let(encoding(v), lambda code: let(decoy(x.before, code, F.length(v)), lambda other: F.struct(
                x.start.alias("start"), x.end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), code.alias("code"), F.length(v).alias("long"), deviance(v, code).alias("deviance"),
                F.when(F.length(other) >= LEAST, F.length(other)).alias("decoy_long"), F.when(F.length(other) >= LEAST, deviance(other, code)).alias("decoy_deviance")))))

        none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,code:int,long:int,deviance:double,decoy_long:int,decoy_deviance:double>>)")
        return F.when(MAYBE[kind](text), F.transform(found, tested)).otherwise(none)

    out = docs.withColumn("secrets_base", F.concat(*[spans(k) for k in KINDS[:3]])).withColumn("secrets_more", spans("random"))
    apart = F.filter("secrets_more", lambda m: ~F.exists("secrets_base", lambda b: (b.start < m.end) & (m.start < b.end)))
    return out.withColumn("secrets", F.concat("secrets_base", apart)).drop("secrets_base", "secrets_more")


def text_deviance(sums: list[tuple[int, float, float, float, float]]) -> list[tuple[float, float, float]]:
    """For each encoding (start, slope, spread): how the log deviance of text goes with the log of its length over LEAST, by
    least squares over decoys with a belief beforehand. sums: code, log length, number, sum and sum of squares of log deviances."""
    out = []
    for code in range(len(ENCODINGS)):
        own = [s for s in sums if s[0] == code]
        at, n, total = (np.array([s[j] for s in own], float) for j in (1, 2, 3))
        x = np.column_stack([np.ones(len(own)), at])
        prior = np.diag([PRIOR, PRIOR])
        w = np.linalg.solve(x.T @ (x * n[:, None]) + prior, x.T @ total + prior @ [START, SLOPE])
        fitted = x @ w
        rest = sum(s[4] for s in own) - 2 * float(fitted @ total) + float((fitted**2) @ n)
        spread = math.sqrt((max(rest, 0.0) + PRIOR * SPREAD**2) / (PRIOR + n.sum()))
        out.append((float(w[0]), float(w[1]), spread))
    return out


def log_length(n: Column) -> Column:
    return F.log(F.greatest(n, F.lit(1)) / LEAST)


def chance_class(s: Column, fitted: list[tuple[float, float, float]]) -> Column:
    """-10 times the log of the probability that text looks as random as this span, cut to whole numbers from 0 to CHANCES: by
    an upper bound of the normal tail."""
    start, slope, spread = (F.element_at(F.array(*[F.lit(f[j]) for f in fitted]), s.code + 1) for j in range(3))
    below = (start + slope * log_length(s.long) - F.log(F.greatest(s.deviance, F.lit(0.05)))) / spread
    log = -below * below / 2 - F.log((below + F.sqrt(below * below + 8 / math.pi)) * math.sqrt(math.pi / 2))
    return F.coalesce(F.when(below > 0, F.least(F.floor(-10 * log), F.lit(CHANCES))), F.lit(0)).cast("int")


def discovered(counts: dict[int, int], rate: float) -> int:
    """The least class of probability that Benjamini and Hochberg's rule keeps; beyond all classes if none."""
    tests, met, least = sum(counts.values()), 0, CHANCES + 1
    for c in sorted(counts, reverse=True):
        met += counts[c]
        if tests * math.exp(-c / 10) <= rate * met:
            least = c
    return least


def train(found: DataFrame, rate: float = RATE) -> tuple[list[tuple[float, float, float]], int]:
    """How text deviates, and the least class of probability that is kept, from the candidates of a corpus (column secrets)."""
    each = found.select(F.explode("secrets").alias("s")).where("s.code is not null")
    near = F.least(F.floor(log_length(F.col("s.decoy_long")) * 8), F.lit(LENGTHS)).cast("int")
    log = F.log(F.greatest(F.col("s.decoy_deviance"), F.lit(0.05)))
    sums = each.where("s.decoy_long is not null").groupBy(F.col("s.code").alias("code"), near.alias("near")).agg(F.avg(log_length(F.col("s.decoy_long"))), F.count("*"), F.sum(log), F.sum(log * log)).collect()
    fitted = text_deviance([(r[0], r[2], r[3], r[4], r[5]) for r in sums])
    counts = each.groupBy(chance_class(F.col("s"), fitted).alias("c")).count().collect()
    return fitted, discovered(dict(map(tuple, counts)), rate)


def accepted(fitted: list[tuple[float, float, float]], least: int) -> Column:
    """The spans that stay, of column secrets: all base ones, and random ones that are discoveries; by place, then kind.
    random tells whether a span passes the tests as a discovery."""
    chance = lambda s: s.code.isNotNull() & (s.deviance <= MOST_DEVIANCE) & (chance_class(s, fitted) >= least)
    shaped = F.transform("secrets", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), F.coalesce(chance(s), F.lit(False)).alias("random"), s.deviance.alias("deviance")))
    return F.array_sort(F.filter(shaped, lambda s: (s.kind < KINDS.index("random")) | s.random))


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id and spans, an array of (start, kind as a place in KINDS, end, random, deviance), by start, then kind.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; decimal numbers and values of no known encoding are
    not tested; equal texts get equal spans; repeated rows give a row each; other columns are ignored; an empty table gives an empty result.
    """
    found = written(candidates(docs.select("doc_id", "text")).drop("text"))
    return found.select("doc_id", accepted(*train(found, rate)).alias("spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
