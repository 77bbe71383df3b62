"""The plan of the license scan, and words that are equal only in letters beyond A-Z."""

import re

from sessionloom.llm import licenses


def test_words_are_parted_once_and_joined_by_hash_alone(spark, monkeypatch):
    monkeypatch.setattr(licenses, "written", lambda df: df)
    docs = spark.range(3).selectExpr("id AS doc_id", "concat('the MIT License, ', id) AS text")
    plan = licenses.voted(docs, licenses.TEMPLATES, licenses.K)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    (keys,) = re.findall(r"HashJoin \[([^\]]*)\]", plan)
    assert "xxhash64" in keys and "translate" not in keys


def test_words_of_one_hash_are_compared(spark):
    docs = spark.createDataFrame([(1, "a KIT Work"), (2, "a Kit worK"), (3, None)], "doc_id long, text string")  # Kelvin signs
    got = licenses.licenses(docs, (licenses.Template("k", "kit work", True),))
    assert sorted((r.doc_id, r.n_words, r.n_base, r.labels) for r in got.collect()) == [(1, 3, 1, "k"), (2, 3, 0, ""), (3, 0, 0, "")]
