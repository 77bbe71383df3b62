"""SimHash near-dedup with a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of its shingles' hashes do. Two fingerprints link if at most
`max_bits` bits differ. With 64 bits cut into max_bits + 2 blocks, linked fingerprints agree on two blocks at least; so
each distinct fingerprint goes once to each pair of blocks, its bits reordered so that those two lead, and rows that
agree on them meet in one partition. There they are sorted by Gray rank, and a tree is laid over the order: an upper
node factors out the bits that all its rows share, a lower one the bits shared beyond those. A search adds up the
differences on its way down and leaves a group as soon as they exceed `max_bits`. Each partition keeps a spanning
forest of its links, never all pairs of a group; components then follow from the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import components, row_keys, text_batches, written

#: Seed of the shingles' XXH64.
SEED = 42
#: Children of a node, levels of nodes above the rows, and rows searched at once.
FAN, LEVELS, SEARCHED = 8, 3, 2048

#: Bit k of a byte in lane k of a 64-bit word, lanes of 8 bits.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: a bit is 1 if it is in over half of them; 0 for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)  # a lane counts to 255
    part_of = np.repeat(np.arange(len(sizes)), parts)
    within = np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = first[part_of] + 255 * within
    doc_cuts = np.cumsum(parts) - parts
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    found = np.zeros(len(sizes), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes, doc_cuts, axis=0, dtype=np.int64)
        octet = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")[:, 0]
        found |= octet.astype(np.uint64) << np.uint64(8 * k)
    out[full] = found
    return out


def shingle_hashes(text: bytes | None, words: int) -> list[int]:
    """XXH64 of each run of words of a text with A-Z lower-cased; of all its words if they are fewer."""
    w = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [digest(b" ".join(w), SEED)] if w else []
    return [digest(b" ".join(t), SEED) for t in zip(*(w[k:] for k in range(words)), strict=False)]


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (the 64 bits as a long), n_shingles. A null or wordless text has fingerprint 0."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(x, shingle_words) for x in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(flat, sizes).view(np.int64)), pa.array(sizes)], names=[id_col, "fingerprint", "n_shingles"])

    rows = docs.select(id_col, F.col(text_col).cast("binary"))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, fingerprint long, n_shingles long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the order of the binary reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def block_bounds(max_bits: int) -> list[int]:
    """Where the blocks of the 64 bits begin, from the lowest bit, and 64."""
    n = max_bits + 2
    return [64 * k // n for k in range(n + 1)]


def reordered(fp: np.ndarray, leading: tuple[int, int], bounds: list[int]) -> tuple[np.ndarray, int]:
    """The bits with two blocks in front, and the length of those two."""
    order = [k for k in range(len(bounds) - 1) if k not in leading] + list(leading)
    out, at = np.zeros(len(fp), np.uint64), 0
    for k in order:
        width = bounds[k + 1] - bounds[k]
        out |= ((fp >> np.uint64(bounds[k])) & np.uint64((1 << width) - 1)) << np.uint64(at)
        at += width
    return out, sum(bounds[k + 1] - bounds[k] for k in leading)


class GrayTree:
    """A tree over rows in Gray order; the rows of a group (same table, same leading bits) are next to each other."""

    def __init__(self, rows: np.ndarray, ends: np.ndarray):
        self.rows, self.ends, self.n = rows, ends, len(rows)
        self.parent = np.arange(self.n)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # rows of a node, pattern, bits shared beyond the parent's
        shared = None
        for level in range(LEVELS, 0, -1):
            size = FAN**level
            at = np.arange(0, self.n, size)
            every, some = np.bitwise_and.reduceat(rows, at), np.bitwise_or.reduceat(rows, at)
            mask = ~(every ^ some)
            own = mask if shared is None else mask & ~np.repeat(shared, FAN)[: len(at)]
            self.levels.append((size, every & mask, own))
            shared = mask
        self.rest = ~np.repeat(shared, FAN)[: self.n]

    def root(self, x: np.ndarray) -> np.ndarray:
        found = self.parent[x]
        while True:
            up = self.parent[found]
            if (up == found).all():
                self.parent[x] = found
                return found
            found = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def search(self, queries: np.ndarray, max_bits: int, same: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Links of each query row to later rows of its group; same: per level the component that all rows of a node are in, or -1."""
        size = self.levels[0][0]
        lo, hi = (queries + 1) // size, (self.ends[queries] - 1) // size
        many = hi - lo + 1
        q = np.repeat(queries, many)
        node = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        sum_ = np.zeros(len(q), np.int64)
        own = self.root(queries)
        label = np.repeat(own, many) if same is not None else None
        for level, (size, pattern, mask) in enumerate(self.levels):
            sum_ = sum_ + np.bitwise_count((self.rows[q] ^ pattern[node]) & mask[node])
            keep = (sum_ <= max_bits) & (node * size < self.ends[q]) & ((node + 1) * size > q + 1)
            if label is not None:
                keep &= same[level][node] != label
                label = np.repeat(label[keep], FAN)
            q, sum_ = np.repeat(q[keep], FAN), np.repeat(sum_[keep], FAN)
            node = (node[keep][:, None] * FAN + np.arange(FAN)).ravel()
            size //= FAN
            inside = node * size < self.n
            q, sum_, node = q[inside], sum_[inside], node[inside]
            if label is not None:
                label = label[inside]
        d = sum_ + np.bitwise_count((self.rows[q] ^ self.rows[node]) & self.rest[node])
        hit = (d <= max_bits) & (node > q) & (node < self.ends[q])
        return q[hit], node[hit]

    def forest(self, max_bits: int) -> np.ndarray:
        """Links all rows within their groups; afterwards, each row's smallest linked row (by index)."""
        queries = np.flatnonzero(self.ends - np.arange(self.n) > 1)
        same = None
        for k in range(0, len(queries), SEARCHED):
            a, b = self.search(queries[k : k + SEARCHED], max_bits, same)
            self.unite(a, b)
            same = None
            if len(a) > 8 * SEARCHED:  # dense: whole groups of rows are one component by now
                labels, same = self.root(np.arange(self.n)), []
                for size, _, _ in self.levels:
                    at = np.arange(0, self.n, size)
                    low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
                    same.append(np.where(low == high, low, -1))
        return self.root(np.arange(self.n))


def local_forest(table: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of a partition that share a table and its leading bits."""
    bounds = block_bounds(max_bits)
    pairs = list(combinations(range(max_bits + 2), 2))
    edges_a, edges_b = [], []
    for t in np.unique(table):
        own = fp[table == t]
        moved, lead = reordered(own, pairs[t], bounds)
        order = np.argsort(gray_rank(moved), kind="stable")
        own, moved = own[order], moved[order]
        new = np.flatnonzero(np.diff(moved >> np.uint64(64 - lead), prepend=~moved[:1] >> np.uint64(64 - lead)))
        ends = np.repeat(np.append(new[1:], len(moved)), np.diff(np.append(new, len(moved))))
        least = GrayTree(moved, ends).forest(max_bits)
        linked = np.flatnonzero(least != np.arange(len(least)))
        edges_a.append(own[linked])
        edges_b.append(own[least[linked]])
    none = [np.empty(0, np.uint64)]
    return np.concatenate(edges_a or none), np.concatenate(edges_b or none)


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (u, v) that span the components of the distinct fingerprints in column fingerprint."""
    bounds = block_bounds(max_bits)

    def bits(k: int):
        return F.shiftrightunsigned("fingerprint", bounds[k]).bitwiseAND((1 << (bounds[k + 1] - bounds[k])) - 1)

    keys = [F.struct(F.lit(t).cast("int").alias("t"), bits(i).alias("a"), bits(j).alias("b")) for t, (i, j) in enumerate(combinations(range(max_bits + 2), 2))]
    dealt = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key")).select("key.*", "fingerprint").repartition("t", "a", "b").select("t", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)) for b in batches]
        if held:
            a, b = local_forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (long), component_id (the smallest id reachable over links, its own included).

    Null or wordless texts have fingerprint 0 and link like any other; a text of fewer words than a shingle is one
    shingle; equal texts and repeated rows share a component; null ids are passed over as component ids (a component of
    null ids alone has a null one). Other columns are ignored. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, shingle_words, id_col, text_col).select(F.col(id_col).alias("id"), "fingerprint"))
    distinct = written(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    reached = components(links(distinct, max_bits))
    rooted = distinct.join(reached, distinct.fingerprint == reached.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(roots, "root").select(F.col("fingerprint").alias("of"), "component_id"))
    return prints.join(named, prints.fingerprint == named.of).select(F.col("id").alias(id_col), "fingerprint", "component_id")


def similarity(a: bytes | None, b: bytes | None, words: int = 5) -> float:
    """Jaccard similarity of two texts' sets of shingles; 1 for two texts without words."""
    x, y = set(shingle_hashes(a, words)), set(shingle_hashes(b, words))
    return len(x & y) / len(x | y) if x or y else 1.0


#: Texts of a block when a bucket of candidates is searched, and pairs that share a copy of their centre's text.
BLOCK_TEXTS, CENTRE_PAIRS = 256, 1_000


def sketches(docs: DataFrame, keys: list, words: int, bands: int, band_rows: int) -> DataFrame:
    """Per document: file_key, row_index, id, whole (a 128-bit hash of its words), fingerprint (SimHash of its shingles), bands
    (a long for each band of minima over its shingles' hashes; none for a wordless text)."""
    text_batches(docs.sparkSession)
    rng = np.random.default_rng(SEED)
    turn, factor = (rng.integers(0, 1 << 63, bands * band_rows, dtype=np.uint64) for _ in range(2))
    factor = factor * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            whole = [xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split())) for t in texts]
            hashes = [shingle_hashes(t, words) for t in texts]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
            full = sizes > 0
            first = (np.cumsum(sizes) - sizes)[full]
            keys = np.empty((len(first), bands), np.uint64)
            for b in range(bands if len(first) else 0):
                key = np.full(len(first), b, np.uint64)
                for k in range(b * band_rows, (b + 1) * band_rows):
                    least = np.minimum.reduceat((flat ^ turn[k]) * factor[k], first)
                    key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys[:, b] = key
            ends = np.append(0, np.cumsum(full * bands)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(whole, pa.binary()), pa.array(majority(flat, sizes).view(np.int64)), lists], names=["file_key", "row_index", "id", "whole", "fingerprint", "bands"])

    rows = docs.select(*keys, F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"file_key long, row_index long, id {dict(docs.dtypes)['doc_id']}, whole binary, fingerprint long, bands array<long>")


def block_links(sets: list[np.ndarray], labels: np.ndarray, asking: np.ndarray, alike: float) -> list[tuple[int, int]]:
    """Verified links that, with the labels' components, span all links of the sets at the places `asking` with others. Pairs of
    one component need no comparison."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    label = np.unique(labels, return_inverse=True)[1]
    out = []
    for q in asking:
        own = np.zeros(len(shingles), np.int64)
        own[flat[first[q] : first[q] + sizes[q]]] = 1
        both = np.add.reduceat(own[flat], first)
        near = both >= alike * (sizes + sizes[q] - both)
        for x in np.flatnonzero(near):
            if label[x] != label[q]:
                out.append((int(q), int(x)))
                label[label == label[x]] = label[q]
    return out


def centre_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets (key, node) with several nodes: their rows, written, and the pairs (node, other) of each with its bucket's
    centre, which is the node that meets the most others."""
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = written(rows.join(shared, "key"))
    met = held.groupBy("node").agg(F.sum("n").alias("met"))
    centres = held.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", F.xxhash64("node"), "node")).alias("other"))
    return held, held.join(centres, "key").where("node <> other").select("node", "other")


def verified(texts: DataFrame, pairs: DataFrame, words: int, alike: float) -> DataFrame:
    """The pairs (u, v) whose texts' shingles are at least `alike`. A text that many pairs share is copied for each so many of
    them, so no task holds them all."""
    pairs = written(pairs.distinct())
    many = pairs.groupBy(F.col("other").alias("of")).agg(F.ceil(F.count("*") / CENTRE_PAIRS).cast("int").alias("shares"))
    salted = pairs.join(many, F.col("other") == F.col("of")).select("node", "other", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))
    others = texts.join(many, F.col("node") == F.col("of")).select(F.col("of").alias("other"), F.col("text").alias("other_text"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array([similarity(a, b, words) >= alike for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["u", "v"])

    return texts.join(salted, "node").join(others, ["other", "share"]).select("node", "other", "text", "other_text").mapInArrow(run, "u long, v long")


def bucket_links(texts: DataFrame, held: DataFrame, known: DataFrame, words: int, alike: float) -> DataFrame:
    """Further links (u, v) so that, with the components in `known` (node, root), the components are those of all pairs of nodes that
    share a bucket (held: key, node) and are at least `alike`; every link is verified on the texts.

    Only buckets that hold several of the known components are searched: each node outside the bucket's largest
    component is held against the nodes of other components, in blocks of about BLOCK_TEXTS on both sides, so no task holds a
    large bucket, and a block gives no more links than it has texts.
    """
    reached = known.select(F.col("node").alias("of"), F.col("root").alias("label"))
    labelled = held.join(reached, F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("largest"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK_TEXTS).cast("int")
    left = written(labelled.join(mixed, "key").select("key", "node", "label", (F.col("label") != F.col("main")).alias("asks"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("largest")).alias("ask_blocks")))
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asking = left.where("asks").select("key", "node", "label", "asks", own("ask_blocks").alias("asked"), copy("all_blocks").alias("met"))
    asked = left.select("key", "node", "label", F.lit(False).alias("asks"), own("all_blocks").alias("met"), copy("ask_blocks").alias("asked")).select(asking.columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[tuple]) -> pa.RecordBatch:
            nodes = [g[3] for g in group]
            sets = [np.unique(np.array(shingle_hashes(g[6], words), np.uint64)) for g in group]
            links = block_links(sets, np.array([g[4] for g in group]), np.flatnonzero([g[5] for g in group]), alike)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in links], pa.int64()), pa.array([nodes[b] for _, b in links], pa.int64())], names=["u", "v"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield found(group)
                    group = []
                group.append(row)
        if group:
            yield found(group)

    met = asking.unionByName(asked).select("key", "asked", "met", "node", "label", "asks").join(texts, "node")
    block = ["key", "asked", "met"]
    return met.select(*block, "node", "label", "asks", "text").repartition(*block).sortWithinPartitions(*block).mapInArrow(search, "u long, v long")


def keep_representatives(docs: DataFrame, shingle_words: int = 5, alike: float = 0.8, max_bits: int = 3, bands: int = 32, band_rows: int = 6) -> DataFrame:
    """The documents less all but one of each group of near duplicates: a row with the smallest id stays. Columns are kept.

    Two documents are copies if their texts have the same words or their shingles' Jaccard similarity is at least
    `alike`; groups are the components of these links, so two copies of one text go together though they may be less
    alike to each other. Texts with the same words are folded first. Candidates are texts whose fingerprints the Gray-order
    index links (`max_bits` bits), and, as fingerprints of 64 bits miss many pairs at 0.8 at any radius that can be searched,
    texts that share a band of `band_rows` minima over the shingles' hashes: a pair at similarity s is missed by these with a chance of
    (1 - s ** band_rows) ** bands, 0.00006 at 0.8. Every link but that of equal words is verified on the texts.

    Null and wordless texts are copies of each other. Rows that share an id are told apart: different texts stay. Rows with null
    ids take part and stay only if their group has no other. An empty table gives an empty result.
    """
    docs, keys = row_keys(docs)
    prints = written(sketches(docs, keys, shingle_words, bands, band_rows))
    row = F.struct("file_key", "row_index")
    firsts = written(prints.groupBy("whole").agg(F.min_by(F.struct("file_key", "row_index", "fingerprint", "bands"), row).alias("first")).select("whole", "first.*", F.monotonically_increasing_id().alias("node")))
    prints_of = firsts.groupBy("fingerprint").agg(F.min("node").alias("least"))
    named = written(prints_of.withColumnRenamed("fingerprint", "f"))
    gray = links(prints_of.select("fingerprint"), max_bits)
    linked = gray.join(named, F.col("u") == F.col("f")).select(F.col("least").alias("node"), "v").join(named, F.col("v") == F.col("f")).select("node", F.col("least").alias("other"))
    equal = firsts.join(named, F.col("fingerprint") == F.col("f")).where("node <> least").select("node", F.col("least").alias("other"))
    held, starred = centre_pairs(firsts.select("node", F.explode("bands").alias("key")).distinct())
    pairs = written(linked.unionByName(equal).unionByName(starred))
    involved = firsts.join(pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct(), "node").select("node", F.col("file_key").alias("f"), F.col("row_index").alias("r"))
    rows = docs.select(*keys, F.col("text").cast("binary").alias("text"))
    texts = written(rows.join(involved, (F.col("file_key") == F.col("f")) & (F.col("row_index") == F.col("r"))).select("node", "text"))
    stars = written(verified(texts, pairs, shingle_words, alike))
    known = components(stars)
    more = written(bucket_links(texts, held, known, shingle_words, alike))
    if not more.isEmpty():
        known = components(known.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    reached = known.select(F.col("node").alias("of"), "root")
    groups = firsts.join(reached, F.col("node") == F.col("of"), "left").select(F.col("whole").alias("of_whole"), F.coalesce("root", "node").alias("group"))
    stay = prints.join(groups, F.col("whole") == F.col("of_whole")).groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "file_key", "row_index")).alias("best"))
    chosen = written(stay.select(F.col("best.file_key").alias("stay_file"), F.col("best.row_index").alias("stay_row")))
    kept = docs.select(F.struct("*").alias("whole_row"), *keys).join(chosen, (F.col("file_key") == F.col("stay_file")) & (F.col("row_index") == F.col("stay_row")), "left_semi")
    return kept.select("whole_row.*")
