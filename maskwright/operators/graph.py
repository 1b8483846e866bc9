"""Connected groups of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.shared import written


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``links`` (a long, b long): root is the smallest node that can be reached.

    In turns every node takes the smallest root among its neighbours', and then the root of that root, so that long
    chains shrink by half or more; the minima are combined before the shuffle, and each turn is written.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        # a root passes on what any of its members has met
        met = roots.join(near, "node").select(F.col("root").alias("node"), "theirs").union(near)
        lower = met.groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = roots.join(lower, "node", "left").select("node", F.least("root", F.coalesce("theirs", "root")).alias("root"), F.col("root").alias("was"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = written(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "was"))
        roots = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return roots
