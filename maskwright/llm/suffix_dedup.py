"""Repeated passages by a sparse suffix array.

Of each text only the suffixes at minimiser positions are kept: in every stretch of WINDOW consecutive K-word
grams, the one of smallest hash. The choice follows content, so two texts that share LEAST words keep the same
place of them, with at least HEAD words to the right and up to SIDE to the left. Suffixes are ordered by their
first HEAD words, by hash; those whose head no other document has are dropped. A suffix is then extended by SIDE
words to the right and by SIDE words to the left, and compared with its like each time. Where both repeat, all
LEAST-word windows around it do. Otherwise, and for all suffixes with the same head, every window of LEAST words
around the head is compared: the ends of passages, and matches with different documents that only touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import HOT_SHARE, MULTS, buckets, by_bucket, cut, deal, dealt_schema, in_keys, mix, n_buckets, parts, scan_words, window_hash

LEAST = 50
K = 8
WINDOW = 25
#: Words of a suffix that must match: the first minimiser of a passage leaves so many of its LEAST words.
HEAD = LEAST - (WINDOW - 1)
SIDE = WINDOW - 1
_TEXT = ["k1", "k2"]


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions of the minimisers of one text (word hashes) whose head lies inside the text."""
    n = len(words) - K + 1
    if len(words) < LEAST:
        return np.zeros(0, dtype=np.int64)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(K):
        grams += words[j : j + n] * MULTS[j]
    grams = mix(grams)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.unique(np.concatenate([np.unique(view[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(view)))) for i in range(0, len(view), 65536)]))
    return at[at + HEAD <= len(words)]


def _windows(words: np.ndarray, at: np.ndarray, left: int) -> np.ndarray:
    """Hash of the LEAST words that begin ``left`` words before each place; 0 where the text has no such window."""
    start = at - left
    inside = (start >= 0) & (start + LEAST <= len(words))
    out = np.zeros(len(at), dtype=np.uint64)
    out[inside] = window_hash(words, start[inside], LEAST)
    return out


def _sample(batches):
    """Per text: 128-bit identity of its word sequence, number of words; per minimiser its place, head and two windows."""
    for batch in batches:
        for a, b, texts in parts(batch.column(3)):
            words, first = scan_words(texts, lower=False)
            ones, twos, sizes, found = [], [], [], [[] for _ in range(4)]
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                w = words[lo:hi]
                at = minimisers(w)
                sizes.append(hi - lo)
                whole = window_hash(w, np.zeros(1, np.int64), len(w)) if len(w) else np.zeros(1, np.uint64)
                other = window_hash(mix(w), np.zeros(1, np.int64), len(w)) if len(w) else np.zeros(1, np.uint64)
                ones.append(whole.view(np.int64)[0])
                twos.append(other.view(np.int64)[0])
                heads = window_hash(w, at, HEAD) if len(at) else np.zeros(0, np.uint64)
                for column, values in zip(found, (at.astype(np.int32), heads.view(np.int64), _windows(w, at, 0).view(np.int64), _windows(w, at, SIDE).view(np.int64))):
                    column.append(values)
            off = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in found[0]])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(a, b - a) for i in range(3)], pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sizes, pa.int64()), *[pa.ListArray.from_arrays(off, pa.array(np.concatenate(x))) for x in found]],
                ["doc_id", "k1", "k2", "f1", "f2", "n_words", "at", "head", "right", "left"],
            )


_SAMPLE = "doc_id long, k1 long, k2 long, f1 long, f2 long, n_words long, at array<int>, head array<long>, right array<long>, left array<long>"


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(17)) % np.uint64(n)).astype(np.int64)


def _in_two(order: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows brought into the ``order`` of their keys: whether two documents have the row's key."""
    key, doc = key[order], doc[order].view(np.int64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return np.repeat(np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at), np.diff(np.append(at, len(key)))) if len(at) else new


def _around(n: int):
    """Rows (doc_id, k1, k2, text, places): all windows around the heads at these places, dealt by window (asked) or, where a slice of texts tells already that they repeat, by text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b, texts in parts(batch.column(3)):
                words, first = scan_words(texts, lower=False)
                keys, starts, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, lo, hi in zip(range(a, b), first[:-1].tolist(), first[1:].tolist()):
                    w, at = words[lo:hi], batch.column(4)[i].values.to_numpy().astype(np.int64)
                    start = (at[:, None] - np.arange(SIDE + 1)).ravel()
                    start = np.unique(start[(start >= 0) & (start + LEAST <= len(w))])
                    keys.append(window_hash(w, start, LEAST) if len(start) else np.zeros(0, np.uint64))
                    starts.append(start)
                    rows.append(np.full(len(start), i))
                key, start, row = np.concatenate(keys), np.concatenate(starts).view(np.uint64), np.concatenate(rows)
                order = np.argsort(key)
                known = _in_two(order, key, ids[row].view(np.uint64))
                told, open_ = order[known], order[~known]
                # of a window that repeats here, its first and last document stand for all
                ends = np.flatnonzero(np.concatenate([[True], key[told][1:] != key[told][:-1]])) if len(told) else told
                send = np.concatenate([open_, told[ends]])
                for kind, at, columns in ((0, send, None), (1, told, None)):
                    r = row[at]
                    texts_of = (k1[r].view(np.uint64), k2[r].view(np.uint64), start[at], ids[r].view(np.uint64))
                    dealt = deal(_bucket(key[at], n), key[at], *texts_of) if kind == 0 else deal(_bucket(mix(texts_of[0]), n), np.zeros(len(at), np.uint64), *texts_of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(dealt.num_rows, kind, dtype=np.int32)), *dealt.columns], ["kind", *dealt.schema.names])

    return run


def _repeated(n: int):
    """The windows of several documents, dealt by text."""

    def run(batches):
        for _, (key, k1, k2, start, doc) in buckets(batches, 5):
            order = np.argsort(key)
            hit = order[_in_two(order, key, doc)]
            yield deal(_bucket(mix(k1[hit]), n), np.zeros(len(hit), np.uint64), k1[hit], k2[hit], start[hit], doc[hit])

    return run


def _stretches(batches):
    """The stretches that the windows of a text cover, one text after the other."""
    for _, (_, k1, k2, start, doc) in buckets(batches, 5):
        start = start.view(np.int64)
        order = np.lexsort((start, k2, k1))
        k1, k2, start, doc = k1[order], k2[order], start[order], doc[order]
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] > start[:-1] + LEAST)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(k1)) - 1
        yield pa.RecordBatch.from_arrays([*[pa.array(x[at].view(np.int64)) for x in (doc, k1, k2)], pa.array(start[at].astype(np.int32)), pa.array((start[last] + LEAST).astype(np.int32))], ["doc_id", "k1", "k2", "start", "stop"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words), a row per maximal stretch that windows of LEAST words cover which another document has too.

    Words are [^\\x20\\x09-\\x0D]+, compared exactly, by 64-bit hashes, a window also by that of its LEAST words;
    positions count words from 0, end exclusive. Windows that overlap or touch are one stretch, whichever documents
    they are found in; shorter matches don't add up. Repeats inside one document only don't count. Documents with
    equal word sequences of LEAST words or more are repeats of each other over their whole length. Null, empty and
    short texts have no span. Rows that repeat doc_id and text are one document; rows with one doc_id and different
    texts are reported each, and don't make each other repeated; rows without doc_id are left out. Other columns are
    ignored, an empty table gives none. Texts are told apart by 128-bit hashes.
    """
    text = F.col("text").cast("string")
    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(5), "doc_id", text).alias("k2"), text.alias("text"))
    sample = cut(base.mapInArrow(_sample, _SAMPLE))
    long_ones = sample.filter(F.col("n_words") >= LEAST)
    same = ["f1", "f2", "n_words"]
    groups = cut(long_ones.groupBy(*same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct(*_TEXT)).alias("rep"), F.count("*").alias("rows")))
    n_rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    copies = in_keys(long_ones.select(*same, "doc_id", *_TEXT), groups.filter("low < high"), same, F.col("rows") * HOT_SHARE > F.lit(n_rows))
    copies = copies.select("doc_id", *_TEXT, F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")).distinct()

    # one text of each group of equal ones stands for it
    reps = groups.select("rep.k1", "rep.k2")
    single = long_ones.join(reps, _TEXT, "left_semi").select("doc_id", *_TEXT, "at", "head", "right", "left").dropDuplicates(_TEXT)
    suffixes = single.select("doc_id", *_TEXT, F.explode(F.arrays_zip("at", "head", "right", "left")).alias("x")).select("doc_id", *_TEXT, "x.*")

    def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose ``keys`` another document has too."""
        counted = cut(rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).filter("low < high"))
        total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return in_keys(rows, counted, keys, F.col("rows") * HOT_SHARE > F.lit(total))

    place = [*_TEXT, "at"]
    kept = cut(shared(suffixes, ["head"]))
    right = cut(shared(kept.filter("right <> 0").select("doc_id", *place, "head", "right"), ["head", "right"]).select("doc_id", *place))
    left = cut(shared(kept.filter("left <> 0").select("doc_id", *place, "head", "left"), ["head", "left"]).select("doc_id", *place))
    edges = kept.join(right.select(*place).intersect(left.select(*place)), place, "left_anti").select("head").distinct()
    edges = cut(kept.groupBy("head").agg(F.count("*").alias("rows")).join(edges, "head", "left_semi"))
    total = edges.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    wanted = in_keys(kept.select("doc_id", *place, "head"), edges, ["head"], F.col("rows") * HOT_SHARE > F.lit(total)).groupBy("doc_id", *_TEXT).agg(F.collect_list("at").alias("places"))
    n = n_buckets(total * (SIDE + 1))
    texts = base.join(wanted.drop("doc_id"), _TEXT).select("doc_id", *_TEXT, "text", "places").dropDuplicates(_TEXT)
    dealt = cut(texts.mapInArrow(_around(n), "kind int, " + dealt_schema(5)))
    asked = by_bucket(dealt.filter("kind = 0").drop("kind")).mapInArrow(_repeated(n), dealt_schema(5))
    spans = "doc_id long, k1 long, k2 long, start int, stop int"
    around = by_bucket(asked.union(dealt.filter("kind = 1").drop("kind"))).mapInArrow(_stretches, spans)
    found = around.union(right.select("doc_id", *_TEXT, F.col("at").alias("start"), (F.col("at") + LEAST).alias("stop")))
    found = found.union(left.select("doc_id", *_TEXT, (F.col("at") - SIDE).alias("start"), (F.col("at") + HEAD).alias("stop"))).union(copies)

    w = Window.partitionBy(*_TEXT).orderBy("start", "stop")
    fresh = (F.col("start") > F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    pieces = found.withColumn("fresh", fresh).withColumn("piece", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = pieces.groupBy("doc_id", *_TEXT, "piece").agg(F.min("start").cast("long").alias("start_word"), F.max("stop").cast("long").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
