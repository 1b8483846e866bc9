"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule;
versioned policies are bitmasks over it, so that changing a policy or asking what a rule costs never reads a
text again. DataFrame functions only, inside one row: no shuffle, whatever the length of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Rule bits, in order; each is a condition under which a document fails.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "10 * n_symbols > 5 * n_words",
    "duplicate_lines": "n_dup_lines > 2 and 2 * n_dup_lines > n_lines",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 20 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: A policy rejects a document that fails a rule of its mask.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BITS["symbol_heavy"] | BITS["duplicate_lines"] | BITS["short_mean_word"] | BITS["long_mean_word"],
}
CURRENT = "v2"


def let(value, then) -> F.Column:
    """``then(value)`` with the value computed once in the row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text) -> F.Column:
    return F.array_remove(F.split(F.translate(text, _WS, " " * len(_WS)), " "), "")


def repeated_words(words: F.Column) -> F.Column:
    """How many words lie in a window of 8 that occurs twice or more among ``words``."""

    def from_hashes(h):
        def from_sorted(s):
            n = F.size(s)
            alike = F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.get(s, i) == F.get(s, i - 1))
            return F.when(n < 2, F.lit(0)).when(~alike, F.lit(0)).otherwise(covered(h))

        return let(F.sort_array(h), from_sorted)

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def hit(p):
            at = F.filter(p, lambda x, i: (F.get(p, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
            return let(F.sort_array(F.transform(at, lambda x: x["i"])), lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return let(pairs, hit)

    codes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(codes, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - WINDOW), lambda i: F.xxhash64(*[F.get(c, i + j) for j in range(WINDOW)])))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, from_hashes))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row, read from the whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _WS, "")) > 0)

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x):
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        "doc_id",
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.translate(text, _WS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed`` (long), a bit for each rule that the document fails.

    One row per row of ``docs`` (doc_id, text; others ignored). A null or empty text has no words and fails
    few_words. Windows of 8 words are compared by 64-bit hashes within one text. An empty table gives an
    empty ledger.
    """
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measure(docs).withColumn("failed", mask.cast("long"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept: no failed bit inside the policy's mask."""
    return rows.withColumns({"base_failed": F.col("failed").bitwiseAND(F.lit(BASE)) != 0, "kept": F.col("failed").bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0})


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many it alone rejects (so dropping it would keep).

    The ledger is first counted by failure mask, at most 2**rules groups; the rest works on that.
    """
    mask = POLICIES[version]
    by_mask = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BITS.items() if bit & mask])
    each = by_mask.select("m", "n", F.explode(rules).alias("r"))
    fails = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy("r.rule").agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"), F.sum("n").alias("n_docs"))
