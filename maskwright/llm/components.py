"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import cut

#: Links up to which one task finds all components: turns over so few are jobs of milliseconds, and the driver plans and holds each.
FEW = 100_000


def _roots(batches):
    """(node, root) of all links (u, v) of a partition; the smaller of two roots stays one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the smallest node reachable.

    Up to FEW links go to one task. Else each turn hangs neighbours on the smallest one, first the larger ones, then the smaller
    ones; stars are stable. Minima are combined before the shuffle and joined back; a hub's links do meet in the join, where AQE
    splits them. Turns end when every node hangs on one other that hangs on none: one count by node, not a turn more.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= FEW:
        return cut(edges.coalesce(1).mapInArrow(_roots, "node long, root long"), tidy=False)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        edges = cut(small)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).union(edges.select("v", F.lit(0)))
        loose = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least")).filter("below > 1 or (below = 1 and least = 0)")
        if loose.isEmpty():
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
