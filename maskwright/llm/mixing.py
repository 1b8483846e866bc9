"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's token share p becomes p**a / sum, with one exponent a in [0, 1] for all. The exponent is bisected:
as close to 1 as the target entropy allows, then raised as far as the repetition limit demands. The source
with the largest share is read once, the others (p / largest)**(a - 1) times, so nothing is left out. A
source's copies are laid out as keyed permutations, one per epoch; the run is cut into blocks of equal token
budget, and each block holds every source in its weight. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import HOT_SHARE, cut
from maskwright.llm.quality_rules import words_of

#: Halvings of a bisection, and how many of them one pass over the sources makes.
STEPS = 50
AT_ONCE = 6


def bisect(good, steps: int = STEPS) -> float:
    """The largest a in [0, 1] that ``good`` holds for, to 2**-steps from below, if it holds at 0 and up to some a.

    ``good`` takes the list of the inner points that the next halvings could visit and tells which hold.
    """
    if good([1.0])[0]:
        return 1.0
    low, width, left = 0.0, 1.0, steps
    while left:
        n = 1 << min(AT_ONCE, left)
        left -= min(AT_ONCE, left)
        width /= n
        low += width * sum(good([low + width * i for i in range(1, n)]))
    return low


def solve_exponent(totals: DataFrame, entropy_fraction: float, max_repeat: float) -> tuple[float, int, int]:
    """(exponent, all tokens, tokens of the largest source) for ``totals`` (src, tokens).

    Largest a in [0, 1] whose entropy reaches ``entropy_fraction`` of the uniform one, but no smaller than the
    least a under which no source is repeated more than ``max_repeat`` times. Each pass brings one row of sums to the
    driver, however many sources there are. Without a token in any source the exponent is 1.
    """
    some = totals.filter("tokens > 0")
    n, whole, least, most = some.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0, 1, 1
    share = F.col("tokens") / F.lit(float(whole))

    def even_enough(points):
        power = [F.pow(share, F.lit(a)) for a in points]
        sums = some.agg(*[F.sum(p) for p in power], *[F.sum(p * F.ln(p)) for p in power]).first()
        return [math.log(x) - y / x >= entropy_fraction * math.log(n) for x, y in zip(sums[: len(points)], sums[len(points) :])]

    # 1 - a is what the repetition limit bounds from above
    seldom = 1.0 - bisect(lambda points: [(most / least) ** x <= max_repeat for x in points])
    return max(bisect(even_enough), seldom), int(whole), int(most)


def source_plan(rows: DataFrame, entropy_fraction: float, max_repeat: float, block_tokens: int) -> DataFrame:
    """One row per source: src, tokens, docs, exponent, weight, epochs, budget (tokens), n_blocks. ``rows``: src, n_tokens."""
    totals = cut(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    exponent, whole, most = solve_exponent(totals, entropy_fraction, max_repeat)
    share, top, a = F.col("tokens") / F.lit(float(whole)), F.lit(most / whole), F.lit(exponent)
    norm = totals.filter("tokens > 0").agg(F.sum(F.pow(share, a))).first()[0] or 1.0
    out = totals.withColumns({"exponent": a, "epochs": F.when(F.col("tokens") > 0, F.pow(share / top, a - 1)).otherwise(F.lit(1.0)), "weight": F.when(F.col("tokens") > 0, F.pow(share, a) / F.lit(norm)).otherwise(F.lit(0.0))})
    out = out.withColumn("budget", F.floor(F.col("tokens") * F.col("epochs")).cast("long"))
    run = out.agg(F.coalesce(F.sum("budget"), F.lit(0))).first()[0]
    return out.withColumn("n_blocks", F.lit(max(1, -(-run // block_tokens))).cast("long"))


def schedule(docs: DataFrame, entropy_fraction: float = 0.95, max_repeat: float = 4.0, block_tokens: int = 100_000, seed: str = "mix") -> DataFrame:
    """One row per copy: doc_id, src, epoch, n_tokens, block_no, ``order_key`` (position inside the block), weight, exponent.

    Tokens are words [^\\x20\\x09-\\x0D]+; a null or empty text has none and is read once. A null source is the
    source ''. Every document appears floor(epochs) times at least, once at the least. Equal rows (same
    doc_id) have the same place and all appear; a null doc_id is permuted as ''. An empty table gives an
    empty schedule.

    Running token sums follow the order of a keyed MD5 inside a source and epoch. They are taken in two levels, over ranges
    of the key and within each, of which there are as many as the root of the source's rows; so no task
    holds a source.
    """
    rows = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.size(words_of(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens")))
    plan = cut(source_plan(rows, entropy_fraction, max_repeat, block_tokens))
    # the plan's hot sources, HOT_SHARE at most, are broadcast
    hot = F.col("docs") * HOT_SHARE > F.lit(rows.count())
    few = F.broadcast(plan.filter(hot))
    rest = rows.join(few.select("src"), "src", "left_anti").join(plan.filter(~hot).hint("merge"), "src")
    placed = rows.join(few, "src").unionByName(rest).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil("epochs").cast("long") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string")).cast("binary"))
    ranges = F.ceil(F.sqrt(F.col("docs").cast("double"))).cast("long")
    placed = placed.withColumn("key", key).withColumn("range", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12) * ranges).cast("long"))
    sums = placed.groupBy("src", "epoch", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = sums.withColumn("start", F.sum("in_range").over(Window.partitionBy("src", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("src", "epoch", "range", F.coalesce("start", F.lit(0)).alias("start"))
    within = F.sum("n_tokens").over(Window.partitionBy("src", "epoch", "range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n_tokens").over(Window.partitionBy("src", "epoch", "range", "key"))
    at = placed.withColumn("inner", within).join(before, ["src", "epoch", "range"]).withColumn("at", F.col("epoch") * F.col("tokens") + F.col("start") + F.col("inner"))
    taken = at.filter((F.col("epoch") == 0) | (F.col("at") < F.col("budget")))
    block = F.when(F.col("budget") > 0, F.least(F.col("n_blocks") - 1, F.floor(F.col("at").cast("double") / F.col("budget") * F.col("n_blocks")))).otherwise(F.lit(0)).cast("long")
    return taken.select("doc_id", "src", "epoch", "n_tokens", block.alias("block_no"), F.md5(F.concat("key", block.cast("string")).cast("binary")).alias("order_key"), "weight", "exponent")


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the run reads them: every row once for each of its copies, columns unchanged whatever they are called.

    The schedule is made of ids and counts alone; texts cross the network once, to meet their number of copies.
    Rows of one doc_id, repeated or not, have the copies of the one with most. Those of a hot doc_id (a null one,
    say) meet it by broadcast.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    copies = schedule(docs, **how).groupBy("doc_id").agg(F.count_distinct("epoch").cast("int").alias("copies"), F.count("*").alias("rows"))
    copies = cut(copies.withColumnRenamed("doc_id", "id"))
    total = copies.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") * HOT_SHARE > F.lit(total)
    plain, meets = docs.toDF(*own.values()), F.col(own["doc_id"]).eqNullSafe(F.col("id"))
    few = F.broadcast(copies.filter(hot))
    rest = plain.join(few, meets, "left_anti").join(copies.filter(~hot).hint("merge"), meets)
    each = plain.join(few, meets).unionByName(rest)
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(c).alias(n) for n, c in own.items()])
