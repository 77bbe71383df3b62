"""Language identification by interpolated Kneser-Ney models over characters.

Each language has a model of 4-grams of letters (other characters count as one space). The n-grams of all languages
share sorted arrays of hashes; beside each hash stands one row with the logarithm of its chance in every language, so
one search serves all. The language with the lowest cross-entropy per character is chosen; its chance comes from the
differences of cross-entropies, scaled on documents kept out of the counts, and a floor of that chance, or a ceiling of the
cross-entropy, rejects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import remainder, text_batches

#: Characters of the longest n-gram, and the absolute discount.
ORDER, DISCOUNT = 4, 0.75
#: Documents that teach a language's model, and that scale its chances, at most (as a hash picks them).
MAX_DOCS, MAX_CALIBRATION = 1_500, 300
#: Languages that are learned, the most frequent ones, and distinct n-grams that teach, the most frequent ones, at most.
MAX_LANGUAGES, MAX_GRAMS = 100, 4_000_000
#: Part of the right answers on kept-out documents that rejection may cost.
LOSS = 0.01

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def letters(text: str | None) -> np.ndarray:
    """Lower-cased letters as 16-bit codes, other characters as single spaces; one space in front and at the end.
    Empty without a letter. Letters beyond the first plane share codes."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() > 0xFFFF:
        far = np.unique(codes[codes > 0xFFFF])
        known = far[[chr(c).isalpha() for c in far.tolist()]]
        codes = np.where(codes <= 0xFFFF, codes, np.where(np.isin(codes, known), 0x4E00 + codes % 0x5000, 0x20))
    is_letter = _LETTER[codes]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    codes = np.where(is_letter, codes, 0x20)
    keep = is_letter | np.append(True, is_letter[:-1])
    codes = codes[keep]
    return np.concatenate([[0x20] if codes[0] != 0x20 else [], codes, [0x20] if codes[-1] != 0x20 else []]).astype(np.uint64)


def gram_keys(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A key of ORDER codes for each character after the first space of each row, latest code lowest; and how many."""
    pad = np.full(ORDER - 2, 0x20, np.uint64)
    flat = np.concatenate([np.empty(0, np.uint64), *(x for r in rows if len(r) for x in (pad, r))])
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    keys = flat.copy()
    for k in range(1, ORDER):
        keys[k:] |= flat[:-k] << np.uint64(16 * k)
    full = sizes[sizes > 0] + ORDER - 2
    begin = np.cumsum(full) - full
    inner = np.ones(len(flat), bool)
    for k in range(ORDER - 1):
        inner[begin + k] = False
    return keys[inner], np.maximum(sizes - 1, 0)


def low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * n)) - 1) if n < 4 else keys


def hashed(keys: np.ndarray) -> np.ndarray:
    h = (keys + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class SortedHashes:
    """Sorted hashes of keys and, for their leading bits, where each value begins."""

    hashes: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple[SortedHashes, np.ndarray]:
        """Also the order of the keys in it."""
        h = hashed(keys)
        order = np.argsort(h)
        h = h[order]
        bits = max(4, len(h).bit_length())
        starts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        return cls(np.append(h, np.uint64(2**64 - 1)), starts.astype(np.int32), 64 - bits), order

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        h = hashed(keys)
        at = self.starts[(h >> np.uint64(self.shift)).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        return np.where((self.hashes[at] == h) & (at < len(self.hashes) - 1), at, -1)


@dataclass
class Model:
    languages: list[str]
    grams: list[SortedHashes] = field(default_factory=list)  # of 1 to ORDER characters
    chance: list[np.ndarray] = field(default_factory=list)
    contexts: list[SortedHashes] = field(default_factory=list)  # of 0 to ORDER - 1 characters
    weight: list[np.ndarray] = field(default_factory=list)  # log weight of the shorter context
    base: np.ndarray = field(default_factory=lambda: np.empty(0))
    scale: float = 1.0
    floor: float = 0.0
    ceiling: np.ndarray = field(default_factory=lambda: np.empty(0))

    def log_chance(self, keys: np.ndarray, longest: int = ORDER) -> np.ndarray:
        """A row of logarithms, one for each language, for each key."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for n in range(longest, 0, -1):
            at = self.grams[n - 1].find(low(keys[left], n))
            hit = at >= 0
            out[left[hit]] += self.chance[n - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            at = self.contexts[n - 1].find(low(keys[left] >> np.uint64(16), n - 1))
            out[left[at >= 0]] += self.weight[n - 1][at[at >= 0]]
        out[left] += self.base
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and its number of characters (0 without a letter)."""
        keys, sizes = gram_keys([letters(t) for t in texts])
        full = np.flatnonzero(sizes)
        out = np.zeros((len(texts), len(self.languages)))
        if len(full):
            begin = np.cumsum(sizes[full]) - sizes[full]
            for a in range(0, len(full), 256):  # the rows of a few texts at a time
                some = full[a : a + 256]
                first, last = begin[a], begin[min(a + 256, len(full)) - 1] + sizes[some[-1]]
                sums = np.add.reduceat(self.log_chance(keys[first:last]), begin[a : a + 256] - first, axis=0, dtype=np.float64)
                out[some] = -sums / sizes[some][:, None]
        return out, sizes

    def chances(self, entropy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        z = -self.scale * np.sqrt(np.maximum(sizes, 1))[:, None] * (entropy - entropy.min(1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def kneser_ney(languages: list[str], of: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Model:
    """Models from counts of ORDER-grams by language. Shorter n-grams count the different characters before them."""
    model = Model(languages)
    size = len(languages)
    model.base = np.zeros(size, np.float32)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by length, by language
    for k in range(ORDER, 0, -1):
        rows = []
        for j in range(size):
            if k == ORDER:
                own = of == j
                order = np.argsort(keys[own])
                rows.append((keys[own][order], n[own][order].astype(float)))
            else:
                key, c = np.unique(low(counts[-1][j][0], k), return_counts=True)
                rows.append((key, c.astype(float)))
        counts.append(rows)
    counts.reverse()
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([key for key, _ in counts[k - 1]]))
        context = np.unique(union >> np.uint64(16))
        table, order = SortedHashes.of(union)
        contexts, context_order = SortedHashes.of(context)
        shorter = model.log_chance(union, k - 1) if k > 1 else None
        chance, weight = np.zeros((len(union), size)), np.zeros((len(context), size))
        for j, (key, c) in enumerate(counts[k - 1]):
            node = np.searchsorted(context, key >> np.uint64(16))
            whole, kinds = np.bincount(node, c, len(context)), np.bincount(node, minlength=len(context))
            share = np.where(whole > 0, DISCOUNT * kinds / np.maximum(whole, 1), 1.0)
            weight[:, j] = np.log(share)
            if k == 1:
                model.base[j] = -np.log(len(key) + 1.0)
            under = np.exp(shorter[:, j] if k > 1 else np.full(len(union), model.base[j]))
            at = np.searchsorted(union, key)
            kept = np.zeros(len(union))
            kept[at] = (c - DISCOUNT) / whole[node]
            chance[:, j] = np.log(kept + share[np.searchsorted(context, union >> np.uint64(16))] * under)
        model.grams.append(table)
        model.chance.append(chance[order].astype(np.float32))
        model.contexts.append(contexts)
        model.weight.append(weight[context_order].astype(np.float32))
    return model


def calibrate(model: Model, entropy: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> None:
    """Sets the scale with the best likelihood on kept-out documents, and the floor and ceilings that reject."""
    some = sizes > 0
    entropy, sizes, truth = entropy[some], sizes[some], truth[some]
    model.ceiling = np.full(len(model.languages), np.inf)
    if not len(truth):
        return
    best = -np.inf
    for scale in np.geomspace(0.05, 20, 30):
        model.scale, before = scale, model.scale
        got = np.log(np.clip(model.chances(entropy, sizes)[np.arange(len(truth)), truth], 1e-3, 1)).mean()
        if got > best + 1e-9:
            best = got
        else:
            model.scale = before
    chosen = entropy.argmin(1)
    right = chosen == truth
    if right.any():
        model.floor = float(np.quantile(model.chances(entropy, sizes).max(1)[right], LOSS))
    for j in range(len(model.languages)):
        own = entropy[right & (truth == j), j]
        if len(own) >= 20:
            model.ceiling[j] = np.quantile(own, 1 - LOSS) * 1.25


def train(docs: DataFrame) -> Model | None:
    """Models of the languages in column lang (nulls teach nothing), from a bounded sample of each; None without any. Rows
    equal in id, text and language teach once."""
    text_batches(docs.sparkSession)
    taught = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    shares = docs.sparkSession.createDataFrame([(k, i, MAX_DOCS / sizes[k], MAX_CALIBRATION / sizes[k]) for i, k in enumerate(languages)], "of string, place int, share double, kept double")
    dealt = taught.join(F.broadcast(shares), F.col("lang") == F.col("of")).withColumn("hash", F.xxhash64("doc_id", "text")).withColumn("lot", F.pmod("hash", F.lit(1 << 30)) / float(1 << 30))
    kept = F.least(F.col("kept"), F.lit(0.25))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, many = gram_keys([letters(t) for t in batch.column(1).to_pylist()])
            of = np.repeat(np.asarray(batch.column(0)), many)
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            first = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(of, prepend=-1) != 0))
            yield pa.RecordBatch.from_arrays([pa.array(of[first], pa.int32()), pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))))], names=["place", "key", "n"])

    some = lambda test: dealt.where(test).select("place", "hash", "text").dropDuplicates(["place", "hash"]).select("place", "text")
    grams = some((F.col("lot") >= kept) & (F.col("lot") < kept + F.col("share"))).mapInArrow(run, "place int, key long, n long").groupBy("place", "key").agg(F.sum("n").alias("n"))
    got = grams.orderBy(F.desc("n"), "key", "place").limit(MAX_GRAMS).toArrow()
    of, keys, n = (got[c].to_numpy() for c in ("place", "key", "n"))
    if not len(keys):
        return None
    present = np.unique(of)
    model = kneser_ney([languages[k] for k in present], np.searchsorted(present, of), keys.astype(np.int64).view(np.uint64), n)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, many = held.value.cross_entropies(batch.column(1).to_pylist())
            cuts = pa.array(np.arange(len(many) + 1, dtype=np.int32) * entropy.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.ListArray.from_arrays(cuts, pa.array(entropy.ravel()))], names=["place", "n", "entropy"])

    tried = some(F.col("lot") < kept).mapInArrow(entropies, "place int, n long, entropy array<double>").toArrow()
    rows = tried["entropy"].to_pylist()
    truth = tried["place"].to_numpy()
    known = np.isin(truth, present)
    calibrate(model, np.array(rows).reshape(len(rows), len(present))[known], tried["n"].to_numpy()[known], np.searchsorted(present, truth[known]))
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents' columns but text, and lang_pred, score, rejected, cross_entropy.

    Texts that are null or have no letter are `und` with score 0, rejected; so are all without a model. A rejected text
    keeps the nearest language in lang_pred.
    """
    text_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "rejected", "cross_entropy")]
    if model is None:
        return docs.select(*others, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            entropy, sizes = m.cross_entropies(batch.column(len(others)).to_pylist())
            best = entropy.argmin(1)
            lowest = entropy[np.arange(len(best)), best]
            score = np.where(sizes > 0, m.chances(entropy, sizes).max(1), 0.0)
            named = [m.languages[k] if s else "und" for k, s in zip(best, sizes, strict=True)]
            rejected = (sizes == 0) | (score < m.floor) | (lowest > m.ceiling[best])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(named, pa.string()), pa.array(score), pa.array(rejected), pa.array(lowest, mask=sizes == 0)], names=[*others, "lang_pred", "score", "rejected", "cross_entropy"])

    schema = docs.select(*others).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"), ("cross_entropy", "double")):
        schema = schema.add(name, kind)
    return docs.select(*others, "text").mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy per document; only rows outside the held-out third teach.

    A null id counts as the empty text for the fold; repeated rows are scored each; columns beside doc_id, text and lang
    are ignored; an empty table gives an empty result.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
