"""Logs of tasks and requests, label changes, fingerprints, payloads, pages and packages against row-by-row Python."""

import datetime as dt
import hashlib
import hmac
import random

from pyspark.sql import functions as F

from maskwright.operators import lifecycle as L
from maskwright.operators import logs, registry
from maskwright.operators.graph import connected
from maskwright.sources import files


def test_one_of_two_claimers_wins(spark):
    rows = [(1, 1, "review"), (1, 2, "claim review"), (1, 3, "claim review"), (1, 4, "cancel"), (1, 5, "interrupted"), (1, 6, "claim review"), (1, 7, "error"), (2, 1, "cancel"), (2, 2, "error"), (2, 3, "nonsense"), (2, 4, None), (None, 9, "interrupted"), (3, 5, "claim processing"), (3, 5, "claim processing")]
    events = spark.createDataFrame(rows, "task int, at long, what string")
    got = {(r.task, r.at, r.kind): (r.accepted, r.status, r.cancel_requested) for r in logs.fold_tasks(events, "task", "at", F.col("what")).collect()}
    assert got[1, 2, "claim review"] == (True, "processing", False) and got[1, 3, "claim review"] == (False, "processing", False)
    assert got[1, 4, "cancel"] == (True, "processing", True) and got[1, 5, "interrupted"] == (True, "review", False)
    assert got[1, 7, "error"] == (True, "review", False) and got[2, 2, "error"] == (True, "failed", False)
    assert got[2, 3, "nonsense"] == (False, "failed", False) and got[2, 4, None] == (False, "failed", False) and got[None, 9, "interrupted"] == (True, "cancelled", False)
    assert logs.fold_tasks(events.limit(0), "task", "at", F.col("what")).collect() == []


def test_log_of_one_hot_task_in_stretches(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.8 else f"t{r.randrange(5)}", i, r.choice(logs.KINDS)) for i in range(1500)]
    state, want = {}, []
    for key, at, kind in rows:
        state[key], ok = logs.after(state.get(key, ("processing", "", False)), kind)
        want.append((key, at, kind, ok, state[key][0], state[key][2]))
    for width in (7, 100, 10_000):
        got = logs.fold_tasks(spark.createDataFrame(rows, "task string, at long, what string").repartition(5), "task", "at", F.col("what"), width=width)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rate_limit(spark):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice(["a", "b", None]), start + dt.timedelta(seconds=r.randrange(400)), r.choice(["GET", "POST"])) for i in range(600)]
    held, want = {"a": [], "b": []}, {}
    for i, who, at, method in sorted(rows, key=lambda x: (x[2], x[1] or "", x[0])):
        if who is None or method in logs.READS:
            want[i] = True
            continue
        recent = [t for t in held[who] if t > at - dt.timedelta(seconds=60)]
        want[i] = len(recent) < 5
        held[who] = recent + [at] * want[i]
    frame = spark.createDataFrame(rows, "_at int, who string, t timestamp, allowed_ string").repartition(3)
    got = logs.rate_limit(frame, "who", "t", (5, 60), ~F.col("allowed_").isin(*logs.READS))
    assert got.columns == [*frame.columns, "allowed"]
    by_time = lambda d: sorted((who or "", at, method, d[i]) for i, who, at, method in rows)
    assert by_time({x["_at"]: x["allowed"] for x in got.collect()}) == by_time(want)
    assert not all(want.values()) and logs.rate_limit(frame.limit(0), "who", "t", logs.UPLOADS).collect() == []


def test_connected(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(350)] + [(-5, -5), (1000, -7), (1000, -7)]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(links)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = connected(spark.createDataFrame(links, "a long, b long").repartition(4))
    assert sorted(map(tuple, got.collect())) == sorted(root.items())


def test_label_changes_in_order(spark):
    r = random.Random(8)
    labels = [(i, f"t{i}", "c", r.random() < 0.7) for i in range(40)]
    changes = [(r.randrange(44), f"t{r.randrange(48)}", r.choice("cc d"), n) for n in range(60)]
    held = {i: [t, c, a] for i, t, c, a in labels}
    for i, text, category, _ in changes:
        if i in held:
            others = sorted(j for j, x in held.items() if j != i and x[:2] == [text, category])
            if others:
                held[others[0]][2], held[i][2] = True, False
            else:
                held[i] = [text, category, True]
    frame, log = spark.createDataFrame(labels, "id int, text string, category string, active boolean"), spark.createDataFrame(changes, "id long, text string, category string, at long")
    got = L.update_labels(frame, log.repartition(5), order="at")
    assert sorted(map(tuple, got.collect())) == sorted((i, *x) for i, x in held.items())
    swap = spark.createDataFrame([(1, "b", "c"), (2, "a", "c")], "id long, text string, category string")
    two = spark.createDataFrame([(1, "a", "c", True), (2, "b", "c", True)], frame.schema)
    assert sorted(map(tuple, L.update_labels(two, swap).collect())) == [(1, "a", "c", True), (2, "b", "c", False)]


def test_fingerprints_and_upserts(spark):
    texts = [("单位", "organization"), ("x" * 500, "custom"), ("", ""), ("a", "b")]
    key = hashlib.sha256(b"secret").digest()
    found = spark.createDataFrame(texts, "text string, category string").select(registry.fingerprint(F.col("text"), F.col("category"), "secret")).collect()
    assert [r[0] for r in found] == [hmac.new(key, f"{c}\0{t}".encode(), hashlib.sha256).hexdigest() for t, c in texts]
    long_key = b"k" * 100
    assert spark.range(1).select(registry.hmac_sha256(long_key, F.lit("m"))).first()[0] == hmac.new(long_key, b"m", hashlib.sha256).hexdigest()
    labels = spark.createDataFrame([], "category string, fingerprint string, cipher string, active boolean")
    new = spark.createDataFrame([("a", "person"), ("a", "person"), ("a", "custom"), (None, "person")], "text string, category string")
    first = registry.upsert_labels(labels, new, "secret")
    rows = first.withColumn("text", registry.decrypt(F.col("cipher"), "secret")).collect()
    assert sorted((r.category, r.text, r.active, r.changed) for r in rows) == [("custom", "a", True, True), ("person", "a", True, True)]
    kept = spark.createDataFrame([tuple(r)[:4] for r in rows], labels.schema)
    again = registry.upsert_labels(kept.withColumn("active", F.col("category") == "person"), new, "secret").collect()
    assert sorted((r.category, r.active, r.changed) for r in again) == [("custom", True, True), ("person", True, False)]


def test_unreadable_annotations_count_nothing(spark):
    shut = lambda s: registry.encrypt(F.lit(s), "k")
    rows = spark.range(1).select(F.explode(F.array(shut('{"entities": ["a", "b"]}'), shut('{"entities": []}'), shut("{}"), shut("no json"), F.lit("???"), F.lit(None).cast("string"), registry.encrypt(F.lit('{"entities": ["a"]}'), "other"))).alias("annotations"))
    got = registry.annotation_counts(rows, "k")
    assert sorted(r[0] for r in got.collect()) == [0, 0, 0, 0, 0, 0, 2] and got.columns == ["annotation_count"]


def test_cached_pages(spark):
    rows = [(1, 0, "第 2 页", "b"), (1, 1, " 第1页 ", "a"), (1, 2, "文件名", "n"), (2, 0, "第 1 页", "a"), (2, 1, "第 3 页", "c"), (3, 0, "文本片段 1", "x"), (4, 0, "第 1 页", "old"), (4, 1, "第 1 页", None), (5, 0, "第 2 页", "b"), (6, 0, "第 99999999999999999999 页", "b")]
    got = files.cached_pages(spark.createDataFrame(rows, "doc int, ix int, location string, text string"), "doc", "ix")
    assert {r.doc: r.pages for r in got.collect()} == {1: ["a", "b"], 2: None, 3: None, 4: [""], 5: None, 6: None}


def test_packages(spark):
    fine = lambda p, *names: [(p, n, 5, 1, 0, 0o100644) for n in names]
    rows = fine("same", "m/./a.pdparams", "m//A.pdparams", "m/config.json", "m/vocab.txt") + fine("folders", "m/", "m/a.pdparams", "m/config.json", "m/vocab.txt", "m/x/")
    rows += fine("deep", "m/x/a.pdparams", "m/config.json", "m/vocab.txt") + fine("flat", "a.pdparams", "config.json", "vocab.txt", "x/y") + fine("mixed", "m/a.pdparams", "n/config.json", "vocab.txt") + fine("only", "m/") + fine("root", "/a", "b\\..\\c")
    e = spark.createDataFrame(rows, "package string, entry string, size long, csize long, flags int, mode int")
    every = spark.createDataFrame([(p,) for p in ("same", "folders", "deep", "flat", "mixed", "only", "root", "none")], "package string")
    got = {r.package: (r.n, r.faults) for r in L.package_guard(e, packages=every).collect()}
    assert got["same"] == (4, ["repeated"]) and got["folders"] == (3, []) and got["flat"] == (4, [])
    assert got["deep"] == (3, ["no_weights"]) and got["mixed"] == (3, ["no_weights", "no_config"])
    assert got["only"] == (0, ["empty"]) and got["none"] == (0, ["empty"]) and got["root"][1][0] == "bad_path"


def test_claims_and_ports(spark):
    tasks = spark.createDataFrame([(1, "review"), (2, "completed"), (3, "review")], "id int, status string")
    seen = spark.createDataFrame([(1, "review"), (1, "review"), (1, "completed"), (2, "review"), (9, "review")], "id int, seen string")
    assert sorted((r.id, r.status, r.claimed) for r in L.claim(tasks, seen).collect()) == [(1, "processing", True), (2, "completed", False), (3, "review", False)]
    urls = spark.createDataFrame([("http://localhost:65535",), ("http://localhost:65536",), ("http://localhost:99999",), ("http://127.0.0.1:",), ("http://localhost:99999999999999999999999",)], "u string")
    assert [r[0] for r in urls.select(L.loopback(F.col("u"))).collect()] == [True, False, False, True, False]
