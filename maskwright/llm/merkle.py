"""Merkle manifest of a table: DataFrame levels from the leaves up, proofs from the root down.

A row is a leaf. In each group the leaves get consecutive numbers in the stated order; a number divided by the
fanout, rounded down, is the number of the parent, whose digest is that of the sorted array of its children. The last
parent may have fewer children, even one. What remains of a group is its subroot; the subroots, in the order of
their groups, are the leaves of one more such tree, whose last node is the root.

Going down, each level joins its nodes with the arrays of their children and explodes them, so that every
child gets its siblings in front of what its parent has: the levels shrink by the fanout, and all joins together
read about as many rows as the last one. Numbers are running ones over ranges of the order and their counts, so that no
task gathers a group, and each level is written before the next: a lost executor repeats one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import cut

#: Levels of so many nodes at most, all groups together, are one task's work.
FEW = 4096
_PROOF = "array<struct<before:binary,after:binary>>"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value (integers in decimal)."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    """The digest, as bytes, of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """Digests of an array as one text of hex digits."""
    return F.array_join(F.transform(digests, text_of), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root, as hex text, that a leaf (bytes) and its siblings lead to."""
    up = lambda at, x: F.sha2(F.concat(text_of(x["before"]), at, text_of(x["after"])).cast("binary"), 256)
    return F.aggregate(proof, text_of(leaf), up)


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, from the leaf's to the root's, left to right."""
    each = F.transform(proof, lambda x: F.concat(text_of(x["before"]), text_of(x["after"])))
    return F.sha2(F.array_join(each, "").cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``ix``, 0 to n - 1 in each group by ``order``: positions in sorted ranges plus the counts of the ranges before.

    Rows alike in group and order are told apart by where they lie, so equal rows, however many, are spread too.
    """
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    dealt = placed.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = cut(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("_tie"))
    counts = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row for each range at most, in every group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    return dealt.join(starts, [group, "_range"]).withColumn("ix", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_before")


def _depth(n: Column, fanout: int) -> Column:
    """How many levels stand above ``n`` leaves."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pow(F.lit(float(fanout)), i.cast("double")))
    # a double holds powers of 2 exactly, others up to 2**53, beyond any count of rows
    return F.size(F.filter(ends, lambda p: p < n.cast("double")))


def build(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """From leaves (grp, ix, h) to the children of each level, (grp, ix of the parent, kids), and (grp, depth, h) of what remains of each group."""
    sizes = cut(nodes.groupBy("grp").agg(F.count("*").alias("n")).withColumn("depth", _depth(F.col("n"), fanout)))
    depths = sorted(r[0] for r in sizes.select("depth").distinct().collect())  # 64 at most
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = nodes.join(sizes.select("grp", "depth"), "grp").select("grp", "ix", "h", "depth")
    kids, tops = [], []
    for at in range(max(depths, default=0) + 1):
        if at in depths:
            tops.append(level.filter(F.col("depth") == at).select("grp", "depth", "h"))
        if at == max(depths, default=0):
            break
        if total <= FEW:
            level = level.coalesce(1)
        more = level.filter(F.col("depth") > at).withColumn("p", F.expr(f"ix div {fanout}"))
        up = more.groupBy("grp", "p", "depth").agg(F.array_sort(F.collect_list(F.struct("ix", "h"))).alias("k"))
        up = cut(up.select("grp", F.col("p").alias("ix"), "depth", F.transform("k", lambda x: x["h"]).alias("kids")), tidy=total > FEW)
        kids.append(up.select("grp", "ix", "kids"))
        level = up.select("grp", "ix", F.unhex(F.sha2(_joined(F.col("kids")).cast("binary"), 256)).alias("h"), "depth")
        total = -(-total // fanout)
    out = tops[0] if tops else level.select("grp", "depth", "h").limit(0)
    for more in tops[1:]:
        out = out.union(more)
    return kids, out


def paths(kids: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """(grp, ix, proof, …) of all leaves. ``tops``: (grp, depth, h, proof, …), the proofs of what remains of each group."""
    keep = [c for c in tops.columns if c not in ("grp", "depth", "h", "proof")]
    start = lambda at: tops.filter(F.col("depth") == at).select("grp", F.lit(0).cast("long").alias("ix"), "proof", *keep)
    depths = {r[0] for r in tops.select("depth").distinct().collect()}  # 64 at most
    now = start(len(kids))
    for at in range(len(kids) - 1, -1, -1):
        each = now.join(kids[at], ["grp", "ix"]).select("grp", "ix", "kids", "proof", *keep, F.posexplode("kids").alias("pos", "_h"))
        nothing = F.lit(b"")
        side = lambda a, n: F.array_join(F.transform(F.slice("kids", a, n), F.hex), "")
        own = F.struct(F.coalesce(F.unhex(side(F.lit(1), F.col("pos"))), nothing).alias("before"), F.coalesce(F.unhex(side(F.col("pos") + 2, F.lit(fanout))), nothing).alias("after"))
        down = each.select("grp", (F.col("ix") * fanout + F.col("pos")).alias("ix"), F.concat(F.array(own), "proof").cast(_PROOF).alias("proof"), *keep)
        now = down.unionByName(start(at)) if at in depths else down
    return now


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, fanout: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof (digests as bytes), and the columns of ``carry``.

    The leaf is the digest of the fields of ``columns``; ``carry`` names expressions over the columns of ``docs``.
    Leaves of a group ascend by ``order`` (null first), equal ones by their digest, so repeated rows are leaves of their own.
    Groups ascend by their UTF-8 bytes, null first. proof holds, from the leaf up, the digests that stand ``before`` and
    ``after`` the node among its siblings; a node alone has two empty ones, a tree of one leaf no entry. An empty table
    gives an empty result. Other columns are ignored, whatever they are called; texts of any length count whole.
    """
    carry = carry or {}
    rows = docs.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), leaf_of([F.col(c) for c in columns]).alias("h"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    rows = cut(rows.withColumn("grp", field(F.col("g"))))
    leaves = cut(numbered(rows, "grp", ["o", "h"]))
    kids, tops = build(leaves.select("grp", "ix", "h"), fanout)
    named = leaves.select("grp", "g").distinct()
    subroots = cut(tops.join(named, "grp").withColumn("all", F.lit("")))
    ranked = cut(numbered(subroots.select("all", "g", "grp", "h"), "all", ["g"]))
    above, last = build(ranked.select(F.col("all").alias("grp"), "ix", "h"), fanout)
    last = last.select("grp", "depth", "h", F.array().cast(_PROOF).alias("proof"), F.col("h").alias("root"))
    proven = paths(above, last, fanout).select("ix", "proof", "root").join(ranked.select("ix", "grp"), "ix")
    tops = cut(tops.join(proven.select("grp", "proof", "root"), "grp").withColumn("subroot", F.col("h")))
    found = leaves.join(paths(kids, tops, fanout), ["grp", "ix"])
    return found.select(F.col("o").alias(order), F.col("h").alias("leaf"), "subroot", "root", "proof", *[F.col(f"c{i}").alias(n) for i, n in enumerate(carry)])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every seventh row by its CRC-32 is tampered with, one added to n_chars (null stays null), and its leaf folded
    with the proof of the manifest; verified tells whether that leads to the root.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    rows = manifest(docs, columns, "lang", "doc_id", carry={"fake": F.when(hit, other)})
    rows = rows.withColumn("folded_root", fold(F.coalesce("fake", "leaf"), F.col("proof")))
    return rows.select("doc_id", *[text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == text_of(F.col("root"))).alias("verified"))
