"""Literal cases of the task, label and package operators."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import lifecycle as L


def test_custom_entities(spark):
    given = ["人名|张三|x\n\n 李四 ", '[{"text": "a", "category": "email"}, 1, {"category": "phone"}]', '{"text": "a"}', None, "", "[]"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").orderBy("i")
    got = [[tuple(e) for e in r[0]] for r in df.select(L.custom_entities(F.col("v"))).collect()]
    assert got == [[("张三|x", "person"), ("李四", "custom")], [("a", "email"), (None, "phone")], [('{"text": "a"}', "custom")], [], [], []]


def test_loopback(spark):
    good = ["http://127.0.0.1:8090", "HTTP://localhost/"]
    bad = ["https://127.0.0.1", "http://a@localhost", "http://localhost/x", "http://localhost?q=1", "http://127.0.0.1.evil.org", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r[0] for r in df.select(L.loopback(F.col("u"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_unknown_category_is_an_error(spark):
    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("planet",)], "c string").select(L.category_or_error(F.col("c"))).collect()


def test_package_faults(spark):
    fine = [("a", "m/W.pdparams", 1), ("a", "m/config.json", 1), ("a", "m/vocab.txt", 1)]
    rows = [(p, e, s, 1, 0, 0o100644) for p, e, s in fine]
    rows += [("b", "../x", 20 << 20, 1, 1, 0o120777), ("b", "T.PY", 1, 1, 0, 0), ("b", "t.py", 1, 1, 0, 0)]
    found = {r["package"]: r for r in L.package_guard(spark.createDataFrame(rows, "package string, entry string, size long, csize long, flags int, mode int")).collect()}
    assert found["a"]["faults"] == [] and found["a"]["n"] == 3
    assert found["b"]["faults"] == ["encrypted", "bad_path", "repeated", "symlink", "blocked", "ratio", "no_weights", "no_config", "no_tokenizer"]


def test_latest_task_first(spark):
    labels = spark.createDataFrame([(1, "b", True, 2), (2, "a", True, 9), (3, "b", True, 1), (4, "a", False, 0)], "id int, category string, active boolean, created_at int")
    assert [r["id"] for r in L.label_listing(labels).collect()] == [2, 3, 1]
