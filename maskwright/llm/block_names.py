"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name, from a sort of the distinct
blocks; then adjacent names are paired, equal pairs get one integer name, and so on until each document has
a single name. Two documents have the same (level, name) exactly when their texts are equal: every step gives
one name to equal contents and different names to different ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import cut

BLOCK = 4096
_WS = " \t\n\x0b\x0c\r"


def _print(content, seed: int) -> dict:
    return {"h1": F.xxhash64(F.lit(seed), content), "h2": F.xxhash64(F.lit(seed + 1_000_003), content)}


def _named(keys: DataFrame) -> DataFrame:
    """An integer for each row of ``keys`` (distinct h1, h2), ascending in their order."""
    return keys.sort("h1", "h2").withColumn("name", F.monotonically_increasing_id())


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), _WS, "")


def _blocks(block: int) -> F.Column:
    """The blocks of ``norm``; none of an empty text."""
    n = F.length("norm")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda i: F.substring(F.col("norm"), i * block + 1, F.lit(block)))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))


def identities(base: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows of ``base`` (k1, k2, norm, ...) without norm, as a written table, and (k1, k2, level, name) of each key; the empty text is level -1, name 0.

    Texts are read twice: once for the fingerprints of their blocks, once to bring the blocks themselves
    together. Contents cross the network once, to be made distinct (copies within a task count once before
    that). From there on a 128-bit fingerprint stands for a block, after a count over all distinct blocks
    has shown that no two share it; otherwise the next seed is taken. So names never collide.
    """
    seed = 0
    while True:
        blocks = base.select(F.explode(_blocks(block)).alias("content")).distinct().withColumns(_print(F.col("content"), seed))
        distinct = cut(blocks.groupBy("h1", "h2").agg(F.count("*").alias("n")))
        if distinct.filter("n > 1").isEmpty():
            break
        seed += 1
    names = cut(_named(distinct.select("h1", "h2")))
    prints = F.transform(_blocks(block), lambda c: F.struct(*[x.alias(n) for n, x in _print(c, seed).items()]))
    rows = cut(base.withColumn("prints", prints).drop("norm"))
    row = rows.select("k1", "k2", F.posexplode("prints").alias("at", "p")).select("k1", "k2", "at", "p.h1", "p.h2")
    level, current, done = 0, cut(row.join(names, ["h1", "h2"]).select("k1", "k2", "at", "name")), None
    while True:
        # the last block's number tells when a document has one name left
        last = current.groupBy("k1", "k2").agg(F.max("at").alias("top"), F.min("name").alias("name"))
        single = last.filter("top = 0").select("k1", "k2", F.lit(level).alias("level"), "name")
        done = single if done is None else done.union(single)
        more = last.filter("top > 0").select("k1", "k2")
        rest = current.join(more, ["k1", "k2"], "left_semi")
        pairs = cut(rest.groupBy("k1", "k2", F.shiftright("at", 1).alias("at")).agg(F.max(F.expr("if(at % 2 = 0, name, null)")).alias("h1"), F.coalesce(F.max(F.expr("if(at % 2 = 1, name, null)")), F.lit(-1).cast("long")).alias("h2")))
        if pairs.isEmpty():
            break
        level += 1
        current = cut(pairs.join(_named(pairs.select("h1", "h2").distinct()), ["h1", "h2"]).select("k1", "k2", "at", "name"))
    none = rows.filter(F.size("prints") == 0).select("k1", "k2", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name")).distinct()
    return rows.drop("prints"), done.union(none)


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when they are after deleting every character of [\\x20\\x09-\\x0D]; a null text counts as
    empty, and empty texts are equal. The row with most code points in its original text stays, then the
    smallest doc_id (null last). Rows that repeat doc_id and text count each in group_size; all of them carry
    kept if theirs is the row that stays. Other columns are ignored; an empty table gives an empty result.
    """
    norm = normalised(F.col("text"))
    base = docs.select("doc_id", norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.encode(norm, "utf-8"), 256).alias("text_sha256"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))
    rows, named = identities(base, block)
    placed = cut(rows.join(named, ["k1", "k2"]))
    groups = placed.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("o"))).alias("best")).select("level", "name", "group_size", (-F.col("best.o")).alias("keep_id"), F.col("best.n_chars").alias("most"))
    return placed.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))).alias("kept"), "text_sha256", "n_chars")
