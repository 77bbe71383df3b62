"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns give candidate spans. Four labelers vote on each: the strict pattern with its checks, a gazetteer (top-level
domains, card prefixes, calling codes), the words before the span, and the span's shape. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is on each kind, and gives every pattern a chance; a
logistic span classifier, fitted to those chances, decides which candidates beyond the strict ones are kept.

The counts of patterns are the only thing that reaches the driver: at most KINDS x 3^4 x 4 rows, for any corpus.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "gazetteer", "context", "shape")
#: Votes of a labeler: against, none, for.
VOTES = (-1, 0, 1)
#: Characters before a span that the context labeler reads.
CONTEXT = 32
#: A candidate beyond the strict ones is kept from this chance on.
KEEP = 0.5

# Strict patterns, as the contract fixes them. Possessive repeats and the condition on the start keep long runs of
# digits or letters from being tried at every place; they match the same spans.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: written-out and bracketed addresses, addresses of eight groups, cards inside longer runs or with other
# separators, national numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|@) ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9 ().-]{7,18}[0-9](?![0-9])",
}
# Only texts that pass these can have a span; they are cheap.
MAYBE = {
    ("strict", "email"): lambda t: t.contains("@"),
    ("strict", "ip"): lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("strict", "card"): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("strict", "phone"): lambda t: t.rlike(r"\+[0-9]"),
    ("wide", "email"): lambda t: t.rlike(r"[\[(] ?(?:at|@) ?[\])]"),
    ("wide", "ip"): lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("wide", "card"): lambda t: t.rlike(r"[0-9]{13}|[0-9]{4}[ ./_-][0-9]{4}"),
    ("wide", "phone"): lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}|00[1-9]"),
}
# Gazetteers and cues: fixed values.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|uk|eu|us|ca|ch|at|it|nl|jp|cn|in|br|ru"
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|62|35)"
CALLING = r"^(?:\+|00)?(?:1|7|20|27|3[0-469]|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {"email": "mail|contact|write|correo|adresse", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|pay|karte|carte|tarjeta", "phone": "phone|call|tel|mobile|fax|ruf|tél|llam"}
CONTRARY = r"version|\bv$|isbn|order|serial|\bid\b|page|sha|token|hash"

_SPAN = "array<struct<kind:int,start:int,end:int,strict:boolean,votes:array<int>,wide:int>>"


def located(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost and not overlapping: array of (start, end, match), in code points."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")
    walk = lambda acc, x: F.struct(
        (acc.at + x.gap + F.length(x.m)).alias("at"),
        F.concat(acc.spans, F.array(F.struct((acc.at + x.gap).alias("start"), (acc.at + x.gap + F.length(x.m)).alias("end"), x.m.alias("m")))).alias("spans"),
    )
    return F.aggregate(F.filter(pairs, lambda x: x.m.isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("spans")), walk, lambda acc: acc.spans)


def luhn(digits: Column) -> Column:
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    twice = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The checks on a strict match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def votes(kind: str, m: Column, before: Column, strict: bool) -> Column:
    """Votes on a candidate in LABELERS' order."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    varied = F.size(F.array_distinct(F.split(digits, ""))) > 2
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    gazetteer = {
        "email": lambda: vote(m.rlike(rf"(?i)(?:\.|dot ?[\])] ?)(?:{DOMAINS})$")),
        "ip": lambda: vote(~m.rlike(r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), m.rlike(r"^0\.0\.")),
        "card": lambda: vote(digits.rlike(CARD_PREFIX), ~digits.rlike(CARD_PREFIX)),
        "phone": lambda: vote(m.startswith("+") & m.rlike(CALLING) | ~m.startswith("+") & digits.rlike("^(?:00)?[2-9]")),
    }[kind]()
    shape = {
        "email": lambda: vote(F.length(m).between(6, 80), F.length(m) > 120),
        "ip": lambda: vote(F.length(m).between(7, 39), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": lambda: vote(luhn(digits) & varied, ~luhn(digits)),
        "phone": lambda: vote(F.length(digits).between(9, 15) & varied, ~varied),
    }[kind]()
    low = F.lower(before)
    context = vote(low.rlike(CUES[kind]), low.rlike(CONTRARY))
    return F.array(F.lit(1 if strict else 0), gazetteer, context, shape)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a column pii of candidate spans: kind (place in KINDS), start, end, strict (a base span), votes,
    wide (0 to 3, the length's class). Wide candidates that touch a strict span are left out. Columns named pii, pii_strict or
    pii_wide are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9]")
    none = F.expr(f"cast(array() as {_SPAN})")

    def spans(how: str, kind: str) -> Column:
        pattern = (STRICT if how == "strict" else WIDE)[kind]
        found = located(text, pattern)
        checked = F.filter(found, lambda x: passes(kind, x.m)) if how == "strict" else found
        shaped = F.transform(checked, lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x.start.alias("start"), x.end.alias("end"), F.lit(how == "strict").alias("strict"),
            votes(kind, x.m, F.substring(text, F.greatest(x.start - CONTEXT, F.lit(0)) + 1, F.least(x.start, F.lit(CONTEXT))), how == "strict").alias("votes"),
            F.least(F.floor((x.end - x.start) / 10).cast("int"), F.lit(3)).alias("wide")))
        gate = MAYBE[how, kind](text)
        return F.when(gate if kind == "email" else digit & gate, shaped).otherwise(none)

    out = docs.withColumn("pii_strict", F.concat(*[spans("strict", k) for k in KINDS])).withColumn("pii_wide", F.concat(*[spans("wide", k) for k in KINDS]))
    apart = F.filter("pii_wide", lambda w: ~F.exists("pii_strict", lambda s: (s.start < w.end) & (w.start < s.end)))
    return out.withColumn("pii", F.concat("pii_strict", apart)).drop("pii_strict", "pii_wide")


def estimate(patterns: dict[tuple, float], rounds: int = 100) -> dict[tuple, float]:
    """Expectation-maximisation over counts of (kind, votes): the chance that a candidate with those votes is personal
    data. Each labeler has, for each kind, a chance of each vote on true and on false candidates, smoothed towards
    votes that tell the truth; the first guess is the balance of votes."""
    out: dict[tuple, float] = {}
    for kind in {k[0] for k in patterns}:
        own = {k: n for k, n in patterns.items() if k[0] == kind}
        chance = {k: min(0.95, max(0.05, 0.5 + sum(k[1]) / (2 * len(LABELERS)))) for k in own}
        lean = {True: {-1: 0.5, 0: 1.0, 1: 2.5}, False: {-1: 2.5, 0: 1.0, 1: 0.5}}  # counts that stand for the belief before any data
        for _ in range(rounds):
            share = (1 + sum(chance[k] * n for k, n in own.items())) / (2 + sum(own.values()))
            rate = {}
            for j, truth in product(range(len(LABELERS)), (True, False)):
                got = {v: lean[truth][v] + sum(n * (chance[k] if truth else 1 - chance[k]) for k, n in own.items() if k[1][j] == v) for v in VOTES}
                rate[j, truth] = {v: x / sum(got.values()) for v, x in got.items()}
            for k in own:
                yes, no = share, 1 - share
                for j, v in enumerate(k[1]):
                    yes, no = yes * rate[j, True][v], no * rate[j, False][v]
                chance[k] = yes / (yes + no)
        out |= chance
    return out


def span_features(kind: int, vote: tuple, wide: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == x) for v in vote for x in (-1, 1)), *(float(wide == w) for w in range(4))]


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from the candidates of a corpus (column pii); zeros if there are none."""
    seen = found.select(F.explode("pii").alias("c")).groupBy("c.kind", "c.votes", "c.wide").agg(F.count("*").alias("n")).collect()
    counts: dict[tuple, float] = {}
    for r in seen:
        counts[r.kind, tuple(r.votes)] = counts.get((r.kind, tuple(r.votes)), 0) + r.n
    chance = estimate(counts)
    size = len(span_features(0, (0,) * len(LABELERS), 0))
    w = np.zeros(size)
    if not seen:
        return w
    x = np.array([span_features(r.kind, tuple(r.votes), r.wide) for r in seen])
    y, n = np.array([chance[r.kind, tuple(r.votes)] for r in seen]), np.array([float(r.n) for r in seen])
    n /= n.sum()
    for _ in range(50):  # Newton's steps on the penalised likelihood of soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(size)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (n * (p - y)) + 1e-3 * w), -3, 3)
    return w


def span_chance(c: Column, w: np.ndarray) -> Column:
    """The span classifier as an expression over a candidate."""
    at = 1 + len(KINDS)
    z = F.lit(float(w[0]))
    for k in range(len(KINDS)):
        z = z + F.when(c.kind == k, float(w[1 + k])).otherwise(0.0)
    for j in range(len(LABELERS)):
        v = F.element_at(c.votes, j + 1)
        z = z + F.when(v == -1, float(w[at + 2 * j])).when(v == 1, float(w[at + 2 * j + 1])).otherwise(0.0)
    at += 2 * len(LABELERS)
    for k in range(4):
        z = z + F.when(c.wide == k, float(w[at + k])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def accepted(w: np.ndarray) -> Column:
    """The spans that stay, of column pii: all strict ones, and wide ones that the classifier holds likely; by kind, then
    place."""
    return F.array_sort(F.transform(F.filter("pii", lambda c: c.strict | (span_chance(c, w) >= KEEP)), lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"), c.strict.alias("strict"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and spans, an array of (kind as a place in KINDS, start, end, strict), by kind and start.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; repeated rows give a row each; other
    columns are ignored; an empty table gives an empty result.
    """
    found = written(candidates(docs.select("doc_id", "text")).drop("text"))
    return found.select("doc_id", accepted(train(found)).alias("spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets, and n_chars set to the new length
    where that column is there. Overlapping spans become one replacement, of the first one's kind.

    Null and empty texts stay; repeated rows stay, each redacted; all columns stay, whatever their names; an empty table gives
    an empty result.
    """
    others = [c for c in docs.columns if c != "text"]
    found = written(candidates(docs.select("text", F.struct(*others).alias("whole_row"))))
    in_order = F.array_sort(F.transform(accepted(train(found)), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    walk = lambda acc, s: F.struct(
        F.greatest(acc.at, s.end).alias("at"),
        F.when(s.start >= acc.at, F.concat(acc.out, text.substr(acc.at + 1, s.start - acc.at), F.element_at(names, s.kind + 1))).otherwise(acc.out).alias("out"),
    )
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), walk, lambda acc: F.concat(acc.out, text.substr(acc.at + 1, F.length(text))))
    some = F.size("spans") > 0
    done = found.select("text", "whole_row", in_order.alias("spans")).withColumn("text", F.when(some, clean).otherwise(text))
    kinds = dict(docs.dtypes)
    own = {c: F.col("whole_row")[c] for c in others} | {"text": text}
    if "n_chars" in own:
        own["n_chars"] = F.when(some, F.length("text").cast(kinds["n_chars"])).otherwise(own["n_chars"])
    return done.select(*[own[c].alias(c) for c in docs.columns])
