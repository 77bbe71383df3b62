"""Scoring texts by prediction by partial matching.

Every training text counts the bytes that follow each context of up to ORDER bytes, and the end of the text as one more
symbol. A text's probability is the product over its bytes and its end: the longest known context predicts the symbol
or escapes to the next shorter one (method C), where symbols that the longer context knew are excluded.

The trie is kept whole, partitioned by the last two symbols of the context: contexts that share them share their shorter
contexts, so each part holds all it needs but the first two orders, which have at most 257 x 257 nodes and travel along.
Each part gives the chance of every distinct n-gram of its contexts, taught or only scored. A text then sums up the chances
of its n-grams: frequent ones (at least 1 / NODES of all symbols, so NODES at most) are broadcast, the others are joined.
Words are counted and looked up in the same two ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .scale import remainder, text_batches, written
from .tables import Counts, Table
from .words import SPACE, binary, chunks, word_hashes, words

#: Bytes of the longest context, bits of a symbol, and the code of the end. Byte b has code b + 1; 0 stands before the text.
ORDER, BITS, END = 4, 9, 257
#: Symbols that can follow: 256 bytes and the end.
SYMBOLS = 257
#: An n-gram or word is broadcast if it has at least this part of all symbols or tokens; the others are joined.
NODES = 1 << 21
#: Distinct n-grams of a part of the trie, about; symbols taken at once.
PART, SLICE = 400_000, 1_000_000
#: The hash that stands for a text's end among the words.
END_WORD = np.uint64(0x5DEECE66D)

_STEP = np.uint64(BITS)
#: What scoring a batch adds to the kept columns.
ADDED = {"n_tokens": "long", "n_common": "long", "common_score": "double", "common_chance": "double", "rare_grams": ArrayType(LongType()), "rare_words": ArrayType(LongType())}


def symbol_keys(text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte and end of the rows, some at a time: the row, and its code in the low bits with the codes of the ORDER
    symbols before above it."""
    sizes = np.diff(offsets)
    n = len(sizes)
    codes = np.zeros(len(text) + n * (ORDER + 1), np.uint16)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes + (ORDER + 1))
    inner = np.ones(len(codes), bool)
    ends = offsets[1:] + np.arange(1, n + 1) * (ORDER + 1)
    for k in range(ORDER):
        inner[ends - np.diff(offsets) - (ORDER + 1) + k] = False
    inner[ends - 1] = False
    codes[inner] = text.astype(np.uint16) + np.uint16(1)
    codes[ends - 1] = END
    for a in range(0, len(codes), SLICE):
        b = min(a + SLICE, len(codes))
        wide = np.zeros(b - a + ORDER, np.uint64)
        wide[max(0, ORDER - a) :] = codes[max(0, a - ORDER) : b]
        keys = wide[ORDER:].copy()
        for k in range(1, ORDER + 1):
            keys |= wide[ORDER - k : len(wide) - k] << np.uint64(BITS * k)
        real = wide[ORDER:] != 0
        yield row[a:b][real], keys[real]


def low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (BITS * (order + 1))) - 1)


@dataclass
class Trie:
    """Per order: n-grams and contexts with their logarithms."""

    grams: list[Table]
    direct: list[np.ndarray]  # log chance of an n-gram if its context is the first tried
    count: list[np.ndarray]  # log count of an n-gram
    contexts: list[Table]
    escape: list[np.ndarray]  # log chance of an escape from a context that is the first tried
    rest: list[np.ndarray]  # log of what the next shorter context has left after exclusion
    rest_escape: list[np.ndarray]  # log chance of its escape
    unseen: float

    def log_chance(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        rest, rest_escape, escaped = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), bool)
        for k in range(ORDER, -1, -1):
            if not len(left):
                break
            own = low(keys[left], k)
            at = self.grams[k].find(own)
            hit = at >= 0
            got, place = left[hit], at[hit]
            out[got] += np.where(escaped[got], self.count[k][place] - rest[got], self.direct[k][place])
            left, own = left[~hit], own[~hit]
            at = self.contexts[k].find(own >> _STEP)
            known = at >= 0
            node, place = left[known], at[known]
            out[node] += np.where(escaped[node], rest_escape[node], self.escape[k][place])
            rest[node], rest_escape[node], escaped[node] = self.rest[k][place], self.rest_escape[k][place], True
        out[left] += self.unseen
        return out


def build(grams: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """The trie of the sorted n-grams of each order and their counts."""
    out: dict = {k: [] for k in ("grams", "direct", "count", "contexts", "escape", "rest", "rest_escape")}
    below: tuple | None = None
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, (key, n) in enumerate(grams):
            context, node, kinds = np.unique(key >> _STEP, return_inverse=True, return_counts=True)
            whole = np.bincount(node, n, len(context))
            table = Table(key)
            out["grams"].append(table)
            out["direct"].append(np.log(n) - np.log(whole + kinds)[node])
            out["count"].append(np.log(n))
            out["contexts"].append(Table(context))
            out["escape"].append(np.log(kinds) - np.log(whole + kinds))
            if below is None:
                out["rest"].append(np.zeros(len(context)))
                out["rest_escape"].append(np.zeros(len(context)))
            else:  # the next shorter context, less the symbols known here
                under = below[1].find(low(key, k - 1))
                shorter = below[2].find(context & np.uint64((1 << (BITS * (k - 1))) - 1))
                new = below[4][shorter] - kinds
                rest = below[3][shorter] - np.bincount(node, below[0][under], len(context)) + new
                out["rest"].append(np.log(np.maximum(rest, 1)))
                out["rest_escape"].append(np.where(rest > 0, np.log(np.maximum(new, 1e-300)) - np.log(np.maximum(rest, 1e-300)), 0.0))
            below = (n, table, out["contexts"][-1], whole, kinds)
    return Trie(**out, unseen=-float(np.log(max(1, SYMBOLS - len(grams[0][0])))))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, node = np.unique(keys, return_inverse=True)
    return key, np.bincount(node, n, len(key)).astype(np.int64)


def gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n, taught): counts of n-grams of the longest order (kind 0) over all texts and over those that teach (column
    teaches), and of words (kind 1) over those that teach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(kind, teaches): Counts() for kind, teaches in ((0, False), (0, True), (1, True))}

        def hand_on(which: tuple[int, bool]) -> pa.RecordBatch:
            keys, counts = held[which].take()
            n = pa.array(counts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), which[0], np.int8)), pa.array(keys.view(np.int64)), n, n if which[1] else pa.array(np.zeros(len(keys), np.int64))], names=["kind", "key", "n", "taught"])

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for teaches in (True, False):
                text, offsets = binary(whole.filter(whole["teaches"] if teaches else pc.invert(whole["teaches"]))["text"].combine_chunks())
                for a, b in chunks(offsets):
                    part, cuts = text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    for _, keys in symbol_keys(part, cuts):
                        if held[0, teaches].add(keys):
                            yield hand_on((0, teaches))
                    if teaches:
                        starts, ends, _ = words(part, cuts, SPACE)
                        if held[1, True].add(np.concatenate([word_hashes(part, starts, ends), np.full(b - a, END_WORD)])):
                            yield hand_on((1, True))
        for which in held:
            yield hand_on(which)

    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "teaches")
    counted = rows.mapInArrow(run, "kind byte, key long, n long, taught long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("taught").alias("taught"))


def arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table that is known to be small."""
    got = df.select(*columns).toArrow()
    return [got.column(c).to_numpy() for c in columns]


@dataclass
class Model:
    """Chances of all n-grams (key, n, chance) and counts of all words (key, n); the frequent ones of both at hand."""

    chances: DataFrame
    words: DataFrame
    tokens: int
    kinds: int
    least_gram: int
    least_word: int
    grams: Table
    gram_chance: np.ndarray
    common: Table
    common_score: np.ndarray


def train(docs: DataFrame) -> Model:
    """The model of the texts that teach (column teaches), with the chances of all n-grams of all texts. Null texts count as
    empty ones."""
    spark = docs.sparkSession
    counts = written(gathered(docs))
    symbols, distinct, tokens, kinds = counts.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)), F.count_if(F.col("kind") == 0), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.lit(0)), F.count_if(F.col("kind") == 1)
    ).first()
    every = counts.where("kind = 0")
    short = every.where("taught > 0").groupBy(F.col("key").bitwiseAND((1 << (2 * BITS)) - 1).alias("key")).agg(F.sum("taught").alias("n"))
    key, n = arrays(short, "key", "n")  # at most 257 x 257 rows
    pairs = summed(key.astype(np.int64).view(np.uint64), n)
    top = spark.sparkContext.broadcast([summed(low(pairs[0], 0), pairs[1]), pairs])
    suffix = F.shiftrightunsigned("key", BITS).bitwiseAND((1 << (2 * BITS)) - 1)
    parts = max(spark.sparkContext.defaultParallelism, -(-distinct // PART))

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(np.asarray(c) for c in b.columns) for b in batches]
        if not held:
            return
        key, n, taught = (np.concatenate(c) for c in zip(*held, strict=True))
        key = key.view(np.uint64)
        known = taught > 0
        trie = build([*top.value, *(summed(low(key[known], k), taught[known]) for k in range(2, ORDER + 1))])
        for a in range(0, len(key), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + SLICE].view(np.int64)), pa.array(n[a : a + SLICE]), pa.array(trie.log_chance(key[a : a + SLICE]))], names=["key", "n", "chance"])

    scored = written(every.select("key", "n", "taught").repartition(parts, suffix).mapInArrow(chances, "key long, n long, chance double"))
    spelled = counts.where("kind = 1").select("key", "n")
    least_gram, least_word = max(1, -(-symbols // NODES)), max(1, -(-tokens // NODES))
    key, chance = arrays(scored.where(F.col("n") >= least_gram), "key", "chance")  # at most NODES rows, as are the words
    word, n = arrays(spelled.where(F.col("n") >= least_word), "key", "n")
    return Model(scored, spelled, tokens, kinds, least_gram, least_word, Table(key.astype(np.int64).view(np.uint64)), chance, Table(word.astype(np.int64).view(np.uint64)), np.log10(n + 1.0))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, and n_tokens, n_known, base_score (smoothed word counts) and score (the model's log10 chance)."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.grams, model.gram_chance, model.common, model.common_score))
    n = len(keep)

    def lists(row: np.ndarray, key: np.ndarray, rows: int) -> pa.ListArray:
        """The keys of each row."""
        order = np.argsort(row, kind="stable")
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)), pa.array(key[order].view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gram_chance, common, common_score = held.value
        for batch in batches:
            text, offsets = binary(batch.column(n))
            for a, b in chunks(offsets):
                part, cuts = text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                chance = np.zeros(b - a)
                rare: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int32), np.empty(0, np.uint64))]
                for row, keys in symbol_keys(part, cuts):
                    at = grams.find(keys)
                    hit = at >= 0
                    chance += np.bincount(row[hit], gram_chance[at[hit]], b - a)
                    rare.append((row[~hit], keys[~hit]))
                starts, ends, many = words(part, cuts, SPACE)
                row = np.concatenate([np.repeat(np.arange(b - a), many), np.arange(b - a)])
                tokens = np.concatenate([word_hashes(part, starts, ends), np.full(b - a, END_WORD)])
                at = common.find(tokens)
                hit = at >= 0
                base = np.bincount(row[hit], common_score[at[hit]], b - a)
                columns = [pa.array(many + 1), pa.array(np.bincount(row[hit], minlength=b - a)), pa.array(base), pa.array(chance / np.log(10))]
                columns += [lists(*(np.concatenate(x) for x in zip(*rare, strict=True)), b - a), lists(row[~hit], tokens[~hit], b - a)]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:n]), *columns], names=[*keep, *ADDED])

    schema = docs.select(*keep).schema
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    scored = written(rows.mapInArrow(run, schema).withColumn("row_no", F.monotonically_increasing_id()))

    def looked_up(column: str, table: DataFrame, *sums: Column) -> DataFrame:
        met = scored.select("row_no", F.explode(column).alias("looked")).join(table, F.col("looked") == F.col("key"))
        return met.groupBy(F.col("row_no").alias(f"{column}_row")).agg(*sums)

    grams = looked_up("rare_grams", model.chances.where(F.col("n") < model.least_gram), F.sum("chance").alias("rare_chance"))
    spelled = looked_up("rare_words", model.words.where(F.col("n") < model.least_word), F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_score"))
    whole = float(np.log10(model.tokens + model.kinds + 1.0))
    joined = scored.join(grams, F.col("row_no") == F.col("rare_grams_row"), "left").join(spelled, F.col("row_no") == F.col("rare_words_row"), "left")
    return joined.select(
        *keep,
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("common_chance") + F.coalesce("rare_chance", F.lit(0.0)) / float(np.log(10))).alias("score"),
    )


def language_model(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Rows teach unless held out (crc32 of the id as text modulo 7 is 2). A null id counts as the empty text for that; null
    texts count as empty, which have one token, their end; repeated rows teach and are scored each; other columns are
    ignored; an empty table gives an empty result.
    """
    held_out = remainder(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    model = train(docs.select("text", (~held_out).alias("teaches")))
    scored = score(docs.select("doc_id", "text", held_out.alias("held_out")), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
