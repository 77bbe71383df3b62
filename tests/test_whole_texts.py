"""Messages whose words stand behind thousands of other characters."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import search
from sessionloom.plans import catalog

from .oracles import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def behind(tmp_path_factory):
    """The conversations with 4,200 or 5,998 characters before each text; a chunk ends within the first word of the latter."""
    d = tmp_path_factory.mktemp("behind")
    before = "CASE WHEN turn % 2 = 0 THEN repeat('zq ', 1400) ELSE repeat('zqz', 1999) || ' ' END"
    duckdb.sql(f"COPY (SELECT conv_id, turn, role, {before} || text AS text FROM '{SF}/conversations.parquet') TO '{d}/conversations.parquet'")
    return str(d)


def by_sql(name, sf, without=()):
    r = connect(sf).sql(catalog.oracle_sql()[name])
    return rows([c for c in r.columns if c not in without], [tuple(v for c, v in zip(r.columns, x) if c not in without) for x in r.fetchall()])


def test_refs_are_found_by_the_ends_of_texts(spark, behind):
    df = catalog.queries()["sr_02b_find_refs"](spark, behind)
    got = [r.asDict() for r in df.collect()]
    taken = [c for c in df.columns if c != "content"]
    assert rows(df.columns, [tuple(r.values()) for r in got]) == by_sql("sr_02b_find_refs", behind)
    assert rows(taken, [tuple(r[c] for c in taken) for r in got]) == by_sql("sr_02b_find_refs", SF, ["content"])


def test_children_are_ranked_by_the_ends_of_texts(spark, behind):
    df = catalog.queries()["sr_04_topic_children"](spark, behind)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == by_sql("sr_04_topic_children", behind) == by_sql("sr_04_topic_children", SF) and got[1]


def test_content_by_line_and_by_handle_has_all_chunks(spark):
    kind = "session_id string, handle string, kind string, line long, raw string"
    cut = [("s", f"e1/content/chunk/{n}", "event_content_chunk", 1, f"{n},") for n in range(12)]
    nodes = spark.createDataFrame([("s", "e1", "message", 1, None), ("s", "e1/content", "event_content", 1, None), *cut], kind)
    refs = spark.createDataFrame([("s", h, "message", 1, "t") for h in ("e1", "e1/content", "e1/content/chunk/3")], "session_id string, handle string, kind string, line long, title string")
    docs = nodes.select("session_id", "handle", F.lit("t").alias("title"), F.lit("x").alias("excerpt"))
    whole = "".join(r[4] for r in cut)
    got = {r.handle: r.content for r in search.hydrate(refs, docs, nodes).collect()}
    assert got == {"e1": whole, "e1/content": whole, "e1/content/chunk/3": "3,"}
