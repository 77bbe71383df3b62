"""What the rollup of trees writes, and its values beside plain Python."""

import random

from sessionloom.functions import usage as U
from sessionloom.operators import ordered, tree


def test_two_orders_are_written_and_sums_are_those_below(spark, monkeypatch):
    tables = []
    for module in (tree, ordered):
        written = module.written
        monkeypatch.setattr(module, "written", lambda df, written=written: tables.append(df.columns) or written(df))
    rng = random.Random(4)
    rows = []
    for s in ("a", "b", "c"):
        for n in range(60):
            up = None if n == 0 else rng.randrange(n)
            kind = "reasoning" if n and rng.random() < 0.1 else "message"
            rows.append((s, f"{s}{n}", None if up is None else f"{s}{up}", n, kind, "x" * rng.randint(1, 9), rng.choice([None, rng.randint(1, 99)]), rng.randint(0, 5), [f"l{rng.randint(0, 4)}"]))
    df = spark.createDataFrame(rows, "session_id string, handle string, parent_handle string, pos long, kind string, raw string, at long, own int, links array<string>")
    df = df.selectExpr("*", "int(if(parent_handle is null, 0, 1)) AS depth", "cast(null as string) AS head", "handle AS title").withColumn("own_usage", U.usage(input=df["own"]))
    got = {r.handle: r for r in tree.rollup_tree(df).collect()}
    before_paths, orders = 2, 2
    paths = sum(c == ["node_no", "above", "path", "up"] for c in tables)
    assert len(tables) == before_paths + paths + orders + 1

    node = {r[1]: r for r in rows}
    below = {h: [r[1] for r in rows if r[2] == h and r[4] != "reasoning"] for h in node}

    def first_time(h, turned):
        if node[h][6] is not None:
            return node[h][6]
        return next((t for c in sorted(below[h], key=lambda c: node[c][3], reverse=turned) if (t := first_time(c, turned)) is not None), None)

    def everything(h):
        return [h, *[x for c in sorted(below[h], key=lambda c: node[c][3]) for x in everything(c)]]

    for h, r in got.items():
        assert (r.start_at, r.end_at) == (first_time(h, False), first_time(h, True))
        assert r.all_links == list(dict.fromkeys(x for c in everything(h) for x in node[c][8]))
        own = node[h][7] if node[h][2] is None and node[h][7] > 0 else sum(node[c][7] for c in everything(h))
        assert r.usage.input == own
        assert r.n_children == len(below[h])
    assert len(got) == len(rows)
