"""Spans: finding, choosing, masking and restoring, as DataFrame operators. Offsets are code points."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_spans(docs: DataFrame, key: str, text: str, pattern: str, category: str, rank: int, guard: Column | None = None) -> DataFrame:
    """(key, start, end, rank, category, value, ordinal) of what the first group of a pattern matches.

    Natively: a match starts after all the gaps and matches before it, so that running lengths give offsets. The pattern
    may match boundaries around the group that the group itself can't begin with.
    ``guard`` is a cheap condition that a text with a match must meet; it runs first.
    """
    rows = docs.filter(guard) if guard is not None else docs
    all_of = lambda group: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    both = rows.select(F.col(key), F.split(text, pattern, -1).alias("gaps"), all_of(0).alias("whole"), all_of(1).alias("hits"))
    at = F.aggregate(
        F.transform("hits", lambda h, i: F.struct(F.length(F.get("gaps", i)).alias("g"), F.length(F.get("whole", i)).alias("n"), (F.call_function("instr", F.get("whole", i), h) - 1).alias("lead"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.array_append(a["out"], a["at"] + x["g"] + x["lead"]).alias("out")),
        lambda a: a["out"],
    )
    found = both.filter(F.size("hits") > 0).select(key, "hits", at.alias("starts"))
    each = found.select(key, F.posexplode(F.arrays_zip("hits", "starts")).alias("ordinal", "x"))
    return each.select(key, F.col("x.starts").alias("start"), (F.col("x.starts") + F.length("x.hits")).alias("end"), F.lit(rank).alias("rank"), F.lit(category).alias("category"), F.col("x.hits").alias("value"), "ordinal")


#: Entries of one automaton; a larger dictionary is dealt to several, each of which reads the texts.
ENTRIES = 200_000
_built: dict[str, object] = {}


def _automaton(name: str, keys):
    """The automaton of a broadcast list of keys, once a worker; those of other lists go."""
    from maskwright.functions.matching import Scan

    if name not in _built:
        _built.clear()
        _built[name] = Scan(keys)
    return _built[name]


def _keyed(batches):
    """Adds the match key of the first column."""
    from maskwright.functions.matching import match_key

    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and match_key(x) for x in batch.column(0).to_pylist()], pa.string())], [*batch.schema.names, "mkey"])


def dictionary_spans(docs: DataFrame, key: str, text: str, entries: DataFrame, by_key: bool = False, shard: int = ENTRIES) -> DataFrame:
    """Spans of dictionary entries (value, category, rank) in texts: (key, start, end, rank, category, value, found).

    Every place of each entry, advancing by its length; ``found`` is the source text there. ``by_key`` looks for the match
    keys, whatever the case, spacing or width: of entries with one key, that of the least rank and then value counts;
    otherwise values are looked for as they are, and are to be distinct. One pass finds all entries of an automaton; it
    is broadcast as up to ``shard`` entries or so, and a larger dictionary takes a pass for each part. Empty and null
    entries are nowhere, null texts have none.
    """
    from maskwright.functions.matching import key_offsets, match_key

    spark = docs.sparkSession
    known = entries.select(F.col("value").cast("string").alias("value"), F.col("category").cast("string").alias("category"), F.col("rank").cast("int").alias("rank"))
    if by_key:
        known = known.mapInArrow(_keyed, "value string, category string, rank int, mkey string")
        first = F.min(F.struct("rank", "value", "category")).alias("e")
        known = known.groupBy("mkey").agg(first).select("e.value", "e.category", "e.rank", "mkey")
    else:
        known = known.withColumn("mkey", F.col("value"))
    known = known.filter("mkey <> ''")
    shards = max(1, -(-known.count() // shard))
    kind = docs.schema[key].dataType.simpleString()
    out = None
    for i in range(shards):
        # a part of the dictionary, bounded by ``shard``
        part = spark.sparkContext.broadcast((uuid.uuid4().hex, known.filter(F.pmod(F.xxhash64("mkey"), F.lit(shards)) == i).sort("rank", "value").toArrow()))

        def run(batches, part=part):
            name, table = part.value
            table = table.combine_chunks()
            scan = _automaton(name, table.column("mkey").to_pylist())
            fields = [table.column(c).combine_chunks() for c in ("rank", "category", "value")]
            for batch in batches:
                owner, spans, texts, held = [], [], [], 0
                for row in range(len(batch)):
                    source = batch.column(1)[row].as_py()
                    if source:
                        at = scan.places(match_key(source) if by_key else source)
                        if len(at):
                            if by_key:
                                back = key_offsets(source)
                                at = np.column_stack([at[:, 0], back[at[:, 1]], back[at[:, 2] - 1] + 1])
                            owner.append(np.full(len(at), row))
                            spans.append(at)
                            texts += [source[a:b] for _, a, b in at.tolist()]
                            held += len(at)
                    if held > 50_000 or (held and row == len(batch) - 1):
                        flat = np.concatenate(spans)
                        which = pa.array(flat[:, 0])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32)), *(f.take(which) for f in fields), pa.array(texts, pa.string())], [key, "start", "end", "rank", "category", "value", "found"])
                        owner, spans, texts, held = [], [], [], 0

        each = docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, start int, end int, rank int, category string, value string, found string")
        out = each if out is None else out.union(each)
    return out


def greedy(spans: DataFrame, key: str) -> DataFrame:
    """The longest spans that don't overlap, then the earliest, then by rank: (key, start, end, category, value).

    One key's candidates are read in the order of their claims, and what they cover is marked in a map of the text: time
    goes with the number and length of the candidates, memory with the text.
    """
    kind = spans.schema[key].dataType.simpleString()
    rows = spans.select(F.col(key).alias("k"), (F.col("start") - F.col("end")).alias("neg"), "start", "rank", "end", "category", "value")
    order = ["k", "neg", "start", "rank", "end", "category", "value"]

    def run(batches):
        now, taken = object(), bytearray()
        for batch in batches:
            kept = []
            keys, starts, ends = (batch.column(i).to_pylist() for i in (0, 2, 4))
            for i, (k, start, end) in enumerate(zip(keys, starts, ends)):
                if k != now:
                    now, taken = k, bytearray()
                if len(taken) < end:
                    taken.extend(bytes(end - len(taken) + 1024))
                if taken.find(1, start, end) < 0:
                    taken[start:end] = b"\1" * (end - start)
                    kept.append(i)
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(i) for i in (0, 2, 4, 5, 6)], [key, "start", "end", "category", "value"])

    return rows.repartition("k").sortWithinPartitions(*order).mapInArrow(run, f"`{key}` {kind}, start int, end int, category string, value string")


def not_overlapping(spans: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Spans that overlap no protected span other than themselves."""
    p = protected.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")) & ~((F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")))
    return spans.join(p, hit, "left_anti")


def number(spans: DataFrame, key: str, codes: dict[str, str], offset: DataFrame | None = None) -> DataFrame:
    """One row per surface form of a document: category, number, token; the first to claim a form sets its category.

    Numbers run by category in the order of first appearance; ``offset`` (key, category, last) continues earlier ones.
    """
    from pyspark.sql import Window

    first = spans.groupBy(key, "value").agg(F.min(F.struct("start", "category")).alias("f")).select(key, "value", F.col("f.category").alias("category"), F.col("f.start").alias("first"))
    n = F.row_number().over(Window.partitionBy(key, "category").orderBy("first"))
    out = first.withColumn("number", n)
    if offset is not None:
        out = out.join(offset, [key, "category"], "left").withColumn("number", F.col("number") + F.coalesce("last", F.lit(0))).drop("last")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("category"))
    return out.withColumn("number", F.col("number").cast("int")).withColumn("token", F.format_string("【%s%03d】", code, F.col("number")))


def mask(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, text, masked, n_spans): ``spans`` (key, start, end, token), not overlapping, cut out of the text."""
    per = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("s"))
    joined = docs.join(per, key, "left")
    pieces = F.transform("s", lambda x, i: F.concat(F.substring(F.col(text), F.coalesce(F.get("s", i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get("s", i - 1)["end"], F.lit(0))), x["token"]))
    tail = F.substring(F.col(text), F.element_at("s", -1)["end"] + 1, F.length(text))
    return joined.withColumn("masked", F.when(F.col("s").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail))).withColumn("n_spans", F.coalesce(F.size("s"), F.lit(0)))


def restore(masked: DataFrame, key: str, column: str, tokens: DataFrame) -> DataFrame:
    """Adds ``restored``: tokens (key, token, value) back to originals, unknown ones left; one pass over pieces between tokens."""
    pattern = r"【[^【】]*】"
    per = tokens.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("m"))
    joined = masked.join(per, key, "left")
    hits, gaps = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), F.split(column, pattern, -1)
    parts = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.coalesce(F.col("m"), F.create_map().cast("map<string,string>"))[h], h, F.lit(""))))
    return joined.withColumn("restored", F.array_join(parts, "")).drop("m")
