"""Toxicity: a factorization machine over hashed terms.

Terms are a document's distinct words and five-letter word beginnings, hashed into 2**BITS places. The score
is the logistic of a bias, a weight for each present term and, for each pair of present terms, the inner
product of their factors, so that combinations count beyond the sum of their parts. It is fitted by AdaGrad
on a bounded sample of labelled rows; terms that the sample doesn't show to be tied to the label, by themselves or
in a pair whose rate of the label is far from what its two terms let expect, are left out, so that a long text doesn't
drown the few terms that matter.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from maskwright.llm.common import cut, give_back, parts

BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that a fit reads at most, of each label; this bounds what reaches the driver.
MOST_ROWS = {1: 6_000, 0: 12_000}
THRESHOLD = 0.7


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct places of a text's terms."""
    if len(_places) > 200_000:
        _places.clear()
    words = set(_WORD.findall((text or "").lower()))
    words |= {w[:5] + "*" for w in words if len(w) > 5}
    return np.array(sorted({_places[w] for w in words}), dtype=np.int32)


class _Places(dict):
    """Places of recent terms, so that a frequent one is hashed once."""

    def __missing__(self, term: str) -> int:
        self[term] = place = zlib.crc32(term.encode("utf-8", "replace")) >> (32 - BITS)
        return place


_places = _Places()


@dataclass
class Machine:
    """bias, and weight (f,) and factors (f, d) of the terms in ``index`` (sorted places)."""

    bias: float
    index: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def score(self, places: np.ndarray) -> float:
        if not len(self.index) or not len(places):
            return float(1 / (1 + np.exp(-self.bias)))
        at = np.searchsorted(self.index, places)
        at = at[self.index[np.minimum(at, len(self.index) - 1)] == places]
        v = self.factors[at]
        s = v.sum(axis=0)
        z = self.bias + self.weight[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def select_terms(with_1: np.ndarray, with_0: np.ndarray, n1: float, n0: float, least_rows: int = 5, least_z: float = 4.0) -> np.ndarray:
    """Positions of the terms that the sample shows to be tied to the label; ``with_1`` and ``with_0``: rows of either label with each term."""
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    p = (with_1 + with_0) / (n1 + n0)
    z = (with_1 / n1 - with_0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return np.flatnonzero((with_1 + with_0 >= least_rows) & (np.abs(z) >= least_z))


#: A pair is looked at if either term is in one of PAIR_SHARE rows of the sample, so the work is bounded with it.
PAIR_SHARE = 50
PAIR_Z = 7.0
_TERMS, _ROWS = 256, 500


def paired_terms(terms: np.ndarray, ends: np.ndarray, y: np.ndarray, n_terms: int, block: int, least_z: float = PAIR_Z) -> np.ndarray:
    """Terms (0 to n_terms - 1) that a term of one block of _TERMS has an interaction with, and these.

    Row i has the terms[ends[i]:ends[i + 1]]. The log-odds of the label add up over the terms of a pair if they don't
    interact; a pair counts if its rows differ from that by ``least_z`` standard errors.
    """
    lo, hi = block * _TERMS, min(n_terms, (block + 1) * _TERMS)
    both, with_1 = np.zeros((hi - lo, n_terms), np.float32), np.zeros((hi - lo, n_terms), np.float32)
    for at in range(0, len(y), _ROWS):
        part = slice(at, min(at + _ROWS, len(y)))
        size = ends[part.start : part.stop + 1]
        x = np.zeros((len(size) - 1, n_terms), np.float32)
        x[np.repeat(np.arange(len(size) - 1), np.diff(size)), terms[size[0] : size[-1]]] = 1
        toxic = y[part] == 1
        with_1 += x[toxic][:, lo:hi].T @ x[toxic]
        both += x[:, lo:hi].T @ x
    n = np.bincount(terms, minlength=n_terms)
    n1 = np.bincount(terms[np.repeat(y == 1, np.diff(ends))], minlength=n_terms)
    odds = np.log((n1 + 0.5) / (n - n1 + 0.5))
    base = np.log((y.sum() + 0.5) / ((y == 0).sum() + 0.5))
    e = 1 / (1 + np.exp(-(odds[lo:hi, None] + odds[None, :] - base)))
    enough = both * np.minimum(e, 1 - e) >= 5
    z = np.where(enough, (with_1 - both * e) / np.sqrt(np.maximum(both * e * (1 - e), 1e-9)), 0)
    z[np.arange(hi - lo), np.arange(lo, hi)] = 0
    one, two = np.nonzero(np.abs(z) >= least_z)
    return np.unique(np.concatenate([one + lo, two]))


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 40, rate: float = 0.1, decay: float = 1e-4, least_rows: int = 5, least_z: float = 4.0, seed: int = 7, index: np.ndarray | None = None) -> Machine:
    """A machine for rows of term places and 0/1 labels; rows of one label only give a constant score.

    ``index`` (sorted places) names the terms to use where they were selected before.
    """
    y = np.asarray(labels, dtype=np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if index is None:
        with_1, with_0 = (np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == k] or [np.zeros(0, np.int32)]), minlength=1 << BITS) for k in (1, 0))
        index = select_terms(with_1, with_0, n1, n0, least_rows, least_z).astype(np.int32)
    if not n1 or not n0 or not len(index):
        return Machine(bias, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, factors)))
    gen = np.random.Generator(np.random.PCG64(seed))
    w, v = np.zeros(len(index)), gen.normal(0, 0.05, (len(index), factors))
    gw, gv, gb = np.full(len(index), 1e-2), np.full(v.shape, 1e-2), 1e-2
    x = [np.searchsorted(index, np.intersect1d(r, index, assume_unique=True)) for r in rows]
    size = 64
    for _ in range(epochs):
        order = gen.permutation(len(y))
        for lo in range(0, len(y), size):
            part = order[lo : lo + size]
            at, row = np.concatenate([x[i] for i in part]), np.repeat(np.arange(len(part)), [len(x[i]) for i in part])
            vs = v[at]
            s = np.zeros((len(part), factors))
            np.add.at(s, row, vs)
            inter = 0.5 * ((s * s).sum(axis=1) - np.bincount(row, (vs * vs).sum(axis=1), minlength=len(part)))
            out = bias + np.bincount(row, w[at], minlength=len(part)) + inter
            g = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]
            step_b = g.sum()
            gb += step_b * step_b
            bias -= rate * step_b / np.sqrt(gb)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, g[row], minlength=len(used)) + decay * len(part) * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, g[row][:, None] * (s[row] - vs))
            dv += decay * len(part) * v[used]
            gv[used] += dv * dv
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(float(bias), index, w, v)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _featurise(batches):
    for batch in batches:
        rows = [terms(t) for _, _, some in parts(batch.column(2)) for t in some]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "toxic", "places"])


def _keep_terms(batches, index: np.ndarray):
    """The rows of ``_featurise`` with the places that are in ``index``."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten().to_numpy()
        kept = np.isin(flat, index)
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[kept], pa.int32()))], ["doc_id", "toxic", "places"])


def train(docs: DataFrame, labels: DataFrame, most_rows: dict[int, int] | None = None, **how) -> Machine:
    """Fit on labelled rows outside the held-out third.

    At most ``most_rows`` of each label are read, the first ones in the order of a hash of doc_id: a bounded
    sample that is the same every time. Conflicting or repeated labels of a doc_id count as the highest; null labels are skipped.
    """
    most = most_rows or MOST_ROWS
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for label, n in most.items():
        part = known.filter(F.col("toxic") == label).sort(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    # rows of one doc_id are one row of the sample, so it keeps its bound; of different texts the first in order is read
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = cut(sample.mapInArrow(_featurise, "doc_id long, toxic int, places array<int>"))
    sizes = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n1, n0 = float(sizes[0]), float(sizes[1] - sizes[0])
    # 2**BITS rows at most; only the selected terms of a row come to the driver
    least = {k: how[k] for k in ("least_rows", "least_z") if k in how}
    counted = sample.select("toxic", F.explode("places").alias("place")).groupBy("place").agg(F.sum("toxic").alias("with_1"), F.count("*").alias("rows"))
    counted = counted.filter(F.col("rows") >= least.get("least_rows", 5)).sort("place").toArrow()
    with_1, both = (counted.column(c).to_numpy().astype(np.float64) for c in ("with_1", "rows"))
    places = counted.column("place").to_numpy()
    alone = places[select_terms(with_1, both - with_1, n1, n0, **least)]
    common = places[both * PAIR_SHARE >= n1 + n0].astype(np.int32)
    index = np.union1d(alone, common[_interacting(sample, common)]).astype(np.int32) if n1 and n0 else alone.astype(np.int32)
    held = docs.sparkSession.sparkContext.broadcast(index)
    found = sample.mapInArrow(lambda batches: _keep_terms(batches, held.value), "doc_id long, toxic int, places array<int>").toArrow().combine_chunks()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    flat, offsets = _flat(found.column("places"))
    return fit([flat[offsets[i] : offsets[i + 1]] for i in order], found.column("toxic").to_numpy()[order], index=index, **how)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)


def _interacting(sample: DataFrame, common: np.ndarray) -> np.ndarray:
    """Positions in ``common`` of the terms with an interaction: a block of terms a task, the bounded sample with each."""
    if not len(common):
        return np.zeros(0, np.int64)
    spark = sample.sparkSession
    held = spark.sparkContext.broadcast(common)
    rows = sample.mapInArrow(lambda batches: _keep_terms(batches, held.value), "doc_id long, toxic int, places array<int>").toArrow().combine_chunks()
    flat, ends = _flat(rows.column("places"))
    data = spark.sparkContext.broadcast((np.searchsorted(common, flat).astype(np.int32), ends, rows.column("toxic").to_numpy()))
    n = len(common)

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(paired_terms(*data.value, n, block))], ["term"])
                give_back()

    blocks = -(-n // _TERMS)
    # at most the terms themselves for each block
    found = spark.range(0, blocks, 1, blocks).mapInArrow(run, "term long").distinct().toArrow()
    data.destroy()
    held.destroy()
    return np.sort(found.column("term").to_numpy())


def score_docs(docs: DataFrame, model: Machine) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column score (double, 0 to 1, higher: likelier toxic), and the names that its own columns have there.

    Every whole text is scored, repeated rows alike; a null or empty one gets the bias alone. Nothing but the text
    is read. The columns get new names, so that none of them can clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, text):
        machine = held.value
        for batch in batches:
            scores = [machine.score(terms(t)) for _, _, some in parts(batch.column(batch.schema.get_field_index(text))) for t in some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    own = {f.name: f"_c{i}" for i, f in enumerate(docs.schema.fields)}
    schema = StructType([*[StructField(own[f.name], f.dataType) for f in docs.schema.fields], StructField("score", DoubleType())])
    return docs.toDF(*own.values()).mapInArrow(lambda batches: run(batches, own["text"]), schema), own


def drop_toxic(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; columns unchanged whatever they are called."""
    scored, own = score_docs(docs, model)
    return scored.filter(F.col("score") < threshold).select(*[F.col(c).alias(n) for n, c in own.items()])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. An empty ``docs`` or no labels score by the bias of what there is."""
    model = train(docs, labels, **how)
    scored, own = score_docs(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    scored = scored.withColumnRenamed(own["doc_id"], "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
