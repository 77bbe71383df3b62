"""The stages' contract, each on its predecessor's rows, and the registered queries' SQL."""

import collections
import math
import re
import struct
import zlib
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from sessionloom.llm import mixing, pii, queries, scale, simhash, toxicity, words
from tests.oracles import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = scale.table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scale.written(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(scale.table(spark, SF, "documents"), scale.table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(scale.table(spark, SF, "documents"), model).where("is_toxic").collect()}
    assert set(kept["toxicity"]) == {r.doc_id for r in scale.table(spark, SF, "documents").collect()} - toxic
    assert set(kept["near_dedup"]) < set(kept["toxicity"]) and len({r.text for r in kept["near_dedup"].values()}) == len(kept["near_dedup"])
    assert set(kept["pii"]) == set(kept["near_dedup"]) == set(kept["mixing"])
    assert not any("@mail" in r.text for r in kept["pii"].values()) and any("[EMAIL]" in r.text or "[PHONE]" in r.text for r in kept["pii"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(kept["mixing"]) and packed.groupby("sequence_id").length.sum().max() <= 1024


def plain_score(model, text):
    """The classifier by a loop over words."""
    raw = (text or "").encode()
    counts = collections.Counter()
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
        for piece, flip in [(m.group(), False)] + [(m.group()[:n], True) for n in toxicity.BEGINNINGS if len(m.group()) > n]:
            data = np.frombuffer(piece, np.uint8)
            [h] = words.word_hashes(data, np.array([0]), np.array([len(data)]))
            counts[int((~h if flip else h) >> np.uint64(64 - toxicity.DIM_BITS))] += 1
    margin = model.bias + sum(float(model.weights[p]) * (1 + 0.5 * math.log(n)) for p, n in counts.items())
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def plain_redaction(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def plain_mix(rows, block_docs=16):
    """Ids in the order of the mix, by a schedule of exact fractions, slot by slot."""
    counts = collections.Counter(s or "" for _, s in rows)
    root = {k: (n / len(rows)) ** 0.5 for k, n in counts.items()}
    target = mixing.whole_parts({k: Fraction(x / sum(root[j] for j in sorted(root))) for k, x in root.items()}, mixing.SLOTS)
    lots = lambda i: (xxhash.xxh64_intdigest(struct.pack("<q", i), 42) % 1024 if i is not None else 42 % 1024, i)
    queue = {k: sorted((i for i, s in rows if (s or "") == k), key=lots) for k in counts}
    w = {k: Fraction(n, mixing.SLOTS) for k, n in target.items()}
    done, order, t = dict.fromkeys(w, 0), [], 0
    while len(order) < len(rows):
        ready = [k for k in w if math.floor(done[k] / w[k]) <= t]
        ends = {k: math.ceil((done[k] + 1) / w[k]) for k in ready}
        k = min(ready, key=lambda k: (ends[k], (done[k] + 1) / w[k] == ends[k], -w[k], k))
        order += queue[k][done[k] * block_docs : (done[k] + 1) * block_docs]
        done[k] += 1
        t += 1
    return order


def test_pipeline_by_brute_force(spark, monkeypatch):
    """Each stage beside plain Python over the rows that it was given, and run() beside the stages."""
    kept = []
    real = scale.written
    monkeypatch.setattr(scale, "written", lambda df: kept.append(real(df)) or kept[-1])
    packed = corpus_pipeline.run(spark, SF).toPandas()
    kept = [df for df in kept if "n_chars" in df.columns]
    clean, near, pii_free, mixed = ([tuple(r) for r in df.select("doc_id", "text", "source", "n_chars").collect()] for df in kept)
    docs = [tuple(r) for r in scale.table(spark, SF, "documents").select("doc_id", "text", "source", "n_chars").collect()]
    model = toxicity.train(scale.table(spark, SF, "documents"), scale.table(spark, SF, "labels"))
    score = {i: plain_score(model, t) for i, t, _, _ in docs}
    assert sorted(i for i, *_ in clean) == sorted(i for i, s in score.items() if s < 0.7) and 0 < len(clean) < len(docs)
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5)) for i, t, *_ in clean}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and (not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                label = {i: label[b] if x == label[a] else x for i, x in label.items()}
    assert sorted(i for i, *_ in near) == sorted(min(i for i in label if label[i] == x) for x in set(label.values())) and len(near) < len(clean)
    spans = {r.doc_id: [(s.start, s.end, pii.KINDS[s.kind]) for s in r.spans] for r in pii.personal_data(kept[1]).collect()}
    want = {i: plain_redaction(t, spans[i]) for i, t, *_ in near}
    assert {i: t for i, t, *_ in pii_free} == want and {i: n for i, *_, n in pii_free if spans[i]} == {i: len(t) for i, t in want.items() if spans[i]}
    order = [r.doc_id for r in kept[3].select("doc_id", scale.row_order(kept[3]).alias("at")).orderBy("at").collect()]
    assert order == plain_mix([(i, s) for i, _, s, _ in pii_free]) and sorted(mixed) == sorted(pii_free)
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in mixed}
    lengths = collections.Counter(x for own in ids.values() for x in [1024] * ((len(own) - 1) // 1024) + [(len(own) - 1) % 1024 + 1])
    assert lengths == collections.Counter(packed.length)
    rooms = []
    for length in sorted(lengths.elements(), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 1024) - length)
    assert sorted(rooms) == sorted(1024 - packed.groupby("sequence_id").length.sum())
    place = {d: k for k, d in enumerate(order)}
    assert packed.assign(at=packed.doc_id.map(place)).groupby("sequence_id")["at"].min().is_monotonic_increasing
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in packed.itertuples())


def test_the_mix_decides_the_sequences(spark, monkeypatch):
    docs = scale.table(spark, SF, "documents")
    found = {}
    for heavy in ("src0", "src1"):
        monkeypatch.setattr(corpus_pipeline.mixing, "tempered_weights", lambda _, heavy=heavy: {heavy: 0.99, "*": 0.01})
        mixed = scale.written(corpus_pipeline.mix_sources(spark, docs, SF))
        order = [r.doc_id for r in mixed.select("doc_id", scale.row_order(mixed).alias("at")).orderBy("at").collect()]
        assert order == [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
        packed = corpus_pipeline.pack_sequences(spark, mixed, SF).toPandas()
        place = {d: k for k, d in enumerate(order)}
        earliest = packed.assign(at=packed.doc_id.map(place)).groupby("sequence_id")["at"].min()
        assert list(earliest.index) == list(range(len(earliest))) and earliest.is_monotonic_increasing
        found[heavy] = sorted(map(tuple, packed.to_numpy().tolist()))
    assert found["src0"] != found["src1"] and [x[:5] for x in found["src0"]] == [x[:5] for x in found["src1"]]


def test_empty_input(spark):
    docs = scale.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if docs.columns[0] == "doc_id" else docs
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == ""
