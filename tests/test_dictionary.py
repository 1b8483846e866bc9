"""The automaton against one search a key, and the sweep over spans against a comparison of all pairs."""

import random
import time

from pyspark.sql import functions as F

from maskwright.functions.matching import Scan, find_all, key_offsets, key_view, match_key, spans_of_keys
from maskwright.operators import spans

LETTERS = ["a", "b", "A", "ａ", "B", " ", "\t", "​", "ß", "ﬁ", "f", "i", "ｆ", "é", "É", "名", "，", "①", "1"]


def plain_places(keys, view):
    out = []
    for i, key in enumerate(keys):
        at = view.find(key) if key else -1
        while at >= 0:
            out.append((i, at, at + len(key)))
            at = view.find(key, at + len(key))
    return sorted(out)


def plain_find_all(text, entries):
    view, found = key_view(text), []
    for n, entry in enumerate(entries):
        for _, a, b in plain_places([match_key(entry)], view.text):
            start, end = view.source(a, b)
            found.append((a - b, start, start - end, n, end, entry))
    out = []
    for _, start, _, _, end, entry in sorted(found):
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, entry))
    return sorted(out)


def test_places_of_random_keys():
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choices(LETTERS, k=r.randrange(60)))
        words = ["".join(r.choices(LETTERS, k=r.randrange(1, 5))) for _ in range(r.randrange(1, 12))]
        keys = [match_key(w) for w in words]
        assert sorted(map(tuple, Scan(keys).places(match_key(text)).tolist())) == plain_places(keys, match_key(text))
        assert len(key_offsets(text)) == len(match_key(text)) and all(text[o] for o in key_offsets(text))
        assert find_all(text, dict.fromkeys(words, "x")) == plain_find_all(text, dict.fromkeys(words))
    assert spans_of_keys(Scan([]), "text").shape == (0, 4) and spans_of_keys(Scan([""]), "").shape == (0, 4)


def test_dictionary_of_several_parts(spark):
    docs = spark.createDataFrame([("d1", "Ｎational  Tobacco\nnational tobacco"), ("d2", None), ("d3", ""), ("d4", "NaTional"), ("d4", "NaTional")], "doc string, t string")
    entries = [(f"entry {i}", "c", i) for i in range(300)] + [("National Tobacco", "b", 2), ("NATIONAL tobacco", "a", 1), ("national", "x", 0), (None, "n", 0), (" ", "n", 0)]
    table = spark.createDataFrame(entries, "value string, category string, rank int")
    for shard in (1000, 40):
        got = sorted(map(tuple, spans.dictionary_spans(docs, "doc", "t", table, by_key=True, shard=shard).collect()))
        assert got == sorted([("d1", 0, 17, 1, "a", "NATIONAL tobacco", "Ｎational  Tobacco"), ("d1", 18, 34, 1, "a", "NATIONAL tobacco", "national tobacco"), ("d1", 0, 8, 0, "x", "national", "Ｎational"), ("d1", 18, 26, 0, "x", "national", "national"), *[("d4", 0, 8, 0, "x", "national", "NaTional")] * 2])
    assert spans.dictionary_spans(docs, "doc", "t", table.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in spans.dictionary_spans(docs, "doc", "t", table.filter("value <> ' '")).collect()] == [("d1", 18, 26)]


def test_greedy_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(d, s, s + r.randrange(1, 9), r.randrange(3), r.choice("ab"), f"v{r.randrange(3)}") for d in range(20) for s in (r.randrange(60) for _ in range(40))]
    frame = spark.createDataFrame(rows + rows[:50], "k long, start int, end int, rank int, category string, value string").repartition(4)
    want = []
    for d in range(20):
        kept = []
        for x in sorted({(s - e, s, rank, e, c, v) for k, s, e, rank, c, v in rows if k == d}):
            if all(x[3] <= y[1] or x[1] >= y[3] for y in kept):
                kept.append(x)
        want += [(d, s, e, c, v) for _, s, _, e, c, v in kept]
    assert sorted(map(tuple, spans.greedy(frame, "k").collect())) == sorted(want)


def test_greedy_of_many_candidates(spark):
    """A hundred thousand candidates of one text take seconds, not the square."""
    frame = spark.range(100_000).select(F.lit("d").alias("k"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"), F.lit(0).alias("rank"), F.lit("c").alias("category"), F.lit("v").alias("value"))
    begun = time.time()
    assert spans.greedy(frame, "k").count() == 50_000
    assert time.time() - begun < 60
