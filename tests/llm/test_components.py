"""Components against union-find, and the life of the files of a cut."""

import gc
import os
import random

import pytest

from maskwright.llm.common import cut
from maskwright.llm.components import components


@pytest.mark.parametrize("seed, n_links, chain, few", [(0, 150, 0, 0), (1, 250, 60, 0), (1, 250, 60, 1000), (2, 0, 0, 1000)])
def test_components(spark, monkeypatch, seed, n_links, chain, few):
    monkeypatch.setattr("maskwright.llm.components.FEW", few)
    rnd = random.Random(seed)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(n_links)] + [(i, i + 1) for i in range(300, 300 + chain)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    found = components(spark.createDataFrame(links + [(7, 7)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {x: root(x) for x in up} and len(found) == len(up)


def test_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    found = components(links).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    spark.sparkContext.setJobGroup("others", "")
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(201)} and len(found) == 201
    # a turn is several jobs, and a chain takes turns by its length's logarithm
    assert jobs <= 8, jobs


def test_files_of_a_cut_stay_while_a_plan_reads_them(spark):
    first = cut(spark.range(10))
    path = first.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    derived = first.filter("id > 2").groupBy("id").count()
    del first
    other = cut(spark.range(3))
    assert os.path.exists(path) and derived.count() == 7 and other.count() == 3
    del derived
    gc.collect()
    for _ in range(3):
        other = cut(spark.range(3))
    assert other.count() == 3 and not os.path.exists(path)
