"""Many markers and scopes with wildcards, beside plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T
from sessionloom.operators import forensics, markers
from sessionloom.sources import sinks
from sessionloom.streaming import streams

LINES = "path string, line_no long, raw string, note string"


def table_of_lines(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab é.\n") for _ in range(rng.randint(0, 9)))
    rows = [(f"p{k % 4}", k, word() * rng.randint(1, 3), None) for k in range(n)]
    asked = [word() for _ in range(40)] + ["a", "ab", "a", "", None, "b a b", "é", "absent word here"]
    return [*rows, ("p0", n, None, "x"), ("p1", n + 1, "", "y"), rows[0], (None, None, "ab", None)], asked


def contained(rows, asked):
    return sorted((str(p), str(k), raw, m) for p, k, raw, _ in rows for m in {*asked} if raw is not None and m is not None and m in raw)


def found(hits):
    return sorted((str(r.path), str(r.line_no), r.raw, r.marker) for r in hits.collect())


def test_one_pass_equals_contains(spark):
    rows, asked = table_of_lines()
    lines, want = spark.createDataFrame(rows, LINES), spark.createDataFrame([(m,) for m in asked], "marker string")
    hits = forensics.marker_hits(lines, want)
    assert found(hits) == contained(rows, asked)
    assert hits.columns == [*lines.columns, "marker"]
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Exchange" not in hits._jdf.queryExecution().toString()
    assert forensics.marker_hits(lines, want.limit(0)).count() == forensics.marker_hits(lines.limit(0), want).count() == 0


def test_groups_of_markers_equal_contains(spark, monkeypatch):
    monkeypatch.setattr(markers, "AUTOMATON", 50)
    monkeypatch.setattr(markers, "BLOCK", 2_000)
    monkeypatch.setattr(markers, "AT_ONCE", 100)
    rows, asked = table_of_lines()
    lines, want = spark.createDataFrame(rows, LINES), spark.createDataFrame([(m,) for m in asked], "marker string")
    assert markers.size_of(want.where("marker is not null")) > 50
    assert found(markers.scan_in_groups(lines, want)) == contained(rows, asked)
    keyed = [r for r in rows[:-2]]  # the word join goes by path and line
    got = forensics.marker_hits(spark.createDataFrame(keyed, LINES), want)
    assert found(got) == contained(keyed, asked) and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert markers.scan_in_groups(lines.limit(0), want).count() == markers.scan_in_groups(lines, want.limit(0)).count() == 0


def test_a_hundred_thousand_markers(spark):
    want = spark.range(100_000).select(F.concat(F.lit("id-"), F.col("id") * 7, F.lit("!")).alias("marker"))
    lines = spark.range(2_000).select(F.lit("p").alias("path"), F.col("id").alias("line_no"), F.concat(F.lit("has id-"), F.col("id"), F.lit("! in it")).alias("raw"))
    hits = forensics.find_markers(lines, want)
    assert {(r.marker, r.line_no, r.byte_offset) for r in hits.collect()} == {(f"id-{k}!", k, 4) for k in range(0, 2_000, 7)}
    at = sinks.shared_folder(spark)
    lines.repartition(3).write.parquet(at)
    got = streams.run_to_table(streams.stream_markers(streams.as_stream(spark, at), want)).collect()
    assert {(r.marker, r.line_no) for r in got} == {(f"id-{k}!", k) for k in range(0, 2_000, 7)}


def test_bytes_that_are_no_text(spark):
    lines = spark.sql("SELECT 'p' AS path, 1L AS line_no, cast(unhex('61FF6264') AS string) AS raw")
    hits = forensics.marker_hits(lines, spark.sql("SELECT explode(array('bd', cast(unhex('FF') AS string), 'x')) AS marker"))
    assert sorted(r[0] for r in hits.select(F.hex("marker")).collect()) == ["6264", "FF"]


SCOPES = ["src/**", "src/*.py", "**/*.py", "*.py", "*", "**", "*/*", "**/x/**", "**/x", "a**b/c", "*x*", "**/*x*", "src/*/deep/*.md", "?[a]*", "/abs/*", "**/deep/a.md", "a*", "*/deep/**", "//*", "long" + "g" * 40 + "*", "*" + "t" * 40]


def test_scopes_with_wildcards(spark):
    rng = random.Random(5)
    parts = ["src", "x", "deep", "a.py", "b.md", "a.md", "ax", "", "abs", "?[a]z", "c", "aqb", "long" + "g" * 45, "t" * 41, "é"]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    scopes = spark.createDataFrame([(s, k) for k, s in enumerate(SCOPES)], "scope string, n int").withColumn("re", T.scope_regex(F.col("scope")))
    regexes = {r.scope: r.re for r in scopes.collect()}
    got = forensics.wild_matches(spark.createDataFrame([(p,) for p in paths], "path string"), scopes)
    assert got.columns == ["path", "scope", "n", "re"]
    assert sorted((r.path, r.scope) for r in got.collect()) == sorted((p, s) for p in paths for s in SCOPES if re.search(regexes[s], p))
    anchors = {r.scope: (r.kind, r.key) for r in scopes.select("scope", forensics.scope_anchor(F.col("scope")).alias("a")).select("scope", "a.kind", "a.key").collect()}
    assert [s for s in SCOPES if anchors[s][0] == "open"] == ["**", "**/*x*"] and anchors["**/*.py"] == ("ends", ".py")
    assert anchors["src/*/deep/*.md"][1] in ("src", "deep") and anchors["**/deep/a.md"] == ("tail", "deep/a.md") and anchors["*/*"] == ("count", "2")
    closed = forensics.wild_matches(spark.createDataFrame([(p,) for p in paths], "path string"), scopes.where("scope not in ('**', '**/*x*')"))
    assert "NestedLoop" not in closed._jdf.queryExecution().toString()
    assert forensics.wild_matches(spark.createDataFrame([("a",)], "path string"), scopes.limit(0)).count() == 0


@pytest.mark.parametrize("scope", ["src/*", "**/z.py"])
def test_affected_by_wildcards(spark, scope):
    changes = spark.createDataFrame([("src/z.py",), ("src/z.py",), (None,), ("doc.md",)], "path string")
    sections = spark.createDataFrame([("doc.md", "s", [scope, "src", scope]), ("other.md", "t", None)], "doc_path string, section_id string, scopes array<string>")
    got = sorted((r.path, r.section_id, r.kind, tuple(r.scopes)) for r in forensics.affected_docs(changes, sections).collect())
    assert got == [("doc.md", "s", "doc", ()), ("src/z.py", "s", "source", tuple(sorted({scope, "src"})))]
