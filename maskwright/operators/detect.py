"""Rules, name forms and review contexts as DataFrame operators: Arrow batches, one row of text at a time, no grouping of texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright import constants as C

#: Rows of a batch that a task hands on at a time.
ROWS = 20_000
#: Characters that a review shows on either side, and places that it shows of an entity.
WIDTH, PLACES = 70, 3
FILE_NAME = "文件名"


def _typed(name: str, df: DataFrame) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def detect(chunks: DataFrame, key: str, text: str, enabled: tuple[str, ...] = C.DEFAULT, despaced: bool = True, stems: bool = False) -> DataFrame:
    """What the rules find: (key, start, end, rank, category, value), overlaps included, so that ``spans.greedy`` can choose.

    Every row is a text by itself; ``stems`` reads them as file names too. ``rank`` is the place of the category. Null and
    empty texts have nothing, rows that repeat are read each, an empty table gives an empty result.
    """

    def run(batches):
        from maskwright.functions import rules

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [key, "start", "end", "rank", "category", "value"]
        for batch in batches:
            owner, found = [], []
            for row, source in enumerate(batch.column(1).to_pylist()):
                for f in rules.in_stem(source, enabled, despaced) if stems and source else rules.candidates(source, enabled, despaced) if source else ():
                    owner.append(row)
                    found.append((f.start, f.end, C.CATEGORIES.index(f.category), f.category, f.value))
                if found and (len(found) > ROWS or row == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names)
                    owner, found = [], []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names)

    return chunks.select(key, F.col(text).cast("string")).mapInArrow(run, f"{_typed(key, chunks)}, start int, end int, rank int, category string, value string")


def plausible(candidates: DataFrame, value: str, category: str, excluded: DataFrame | None = None) -> DataFrame:
    """``candidates`` of a model with ``cleaned``: the value as it may be registered, null if it can't be of that category.

    ``excluded`` (text, category) lists what people have rejected, compared by match key; it is joined, not collected. Null
    values and unknown categories have null.
    """

    def cleaned(batches):
        from maskwright.functions import rules
        from maskwright.functions.matching import match_key

        for batch in batches:
            at = [batch.schema.names.index(c) for c in (value, category)]
            out = [None if v is None else rules.plausible(v, c) for v, c in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array([x and match_key(x) for x in out], pa.string())], [*batch.schema.names, "cleaned", "_key"])

    def keyed(batches):
        from maskwright.functions.matching import match_key

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x and match_key(x) for x in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["_key", "_category"])

    fields = ", ".join(_typed(c, candidates) for c in candidates.columns)
    out = candidates.mapInArrow(cleaned, f"{fields}, cleaned string, _key string")
    if excluded is None:
        return out.drop("_key")
    barred = excluded.select(F.col("text").cast("string"), F.col("category").cast("string")).mapInArrow(keyed, "_key string, _category string").distinct().withColumn("_barred", F.lit(True))
    joined = out.join(barred.withColumnRenamed("_key", "_their"), (F.col("_key") == F.col("_their")) & (F.col(category) == F.col("_category")), "left")
    return joined.withColumn("cleaned", F.when(F.col("_barred").isNull(), F.col("cleaned"))).select(*candidates.columns, "cleaned")


def name_forms(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, kind, ordinal, form) of organizations: ``short`` forms that the full name suggests, ``stem`` in a series of factories.

    Null and empty names have none.
    """

    def run(batches):
        from maskwright.functions import rules

        for batch in batches:
            owner, rows = [], []
            for at, full in enumerate(batch.column(1).to_pylist()):
                for kind, forms in (("short", rules.short_names), ("stem", rules.factory_stems)):
                    for i, form in enumerate(forms(full) if full else ()):
                        owner.append(at)
                        rows.append((kind, i, form))
            if rows:
                kind, i, form = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(kind, pa.string()), pa.array(i, pa.int32()), pa.array(form, pa.string())], [key, "kind", "ordinal", "form"])

    return names.select(key, F.col(name).cast("string")).mapInArrow(run, f"{_typed(key, names)}, kind string, ordinal int, form string")


def _places(texts: DataFrame, tight: bool) -> DataFrame:
    """(doc_id, token, ix, nth, prefix, match, suffix): up to PLACES places of each entity in each of ``texts`` (doc_id, ix, text, entities)."""

    def run(batches):
        import numpy as np

        from maskwright.functions.matching import Scan, match_key, spans_of_keys

        def line(x):
            return " ".join(x.split()) if tight else x

        fields = ["doc_id", "token", "ix", "nth", "prefix", "match", "suffix"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for row in range(len(batch)):
                source, known = batch.column("text")[row].as_py(), batch.column("entities")[row].as_py()
                if not source or not known:
                    continue
                places = spans_of_keys(Scan(match_key(e["value"]) for e in known), source)
                # one entity competes only with itself: from the left, the longer stretch of those that start together
                order = np.lexsort((places[:, 1] - places[:, 2], places[:, 1], places[:, 0]))
                held, rows = {}, []
                for which, start, end, _ in places[order].tolist():
                    n, free = held.get(which, (0, 0))
                    if n < PLACES and start >= free:
                        held[which] = (n + 1, end)
                        before, after = (source[max(0, start - WIDTH) : start], source[end : end + WIDTH]) if tight else (source[:start], source[end:])
                        rows.append((known[which]["token"], batch.column("ix")[row].as_py(), n, line(before), source[start:end], line(after)))
                if rows:
                    doc = batch.column("doc_id").take(pa.array([row] * len(rows)))
                    yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], fields)

    return texts.select("doc_id", F.col("ix").cast("long").alias("ix"), "text", "entities").mapInArrow(run, f"{_typed('doc_id', texts)}, token string, ix long, nth int, prefix string, match string, suffix string")


def review_contexts(entities: DataFrame, chunks: DataFrame, names: DataFrame, model: DataFrame, labels: DataFrame) -> DataFrame:
    """Per entity of a document what people see of it: (doc_id, token, source, probability, occurrences).

    ``entities``: doc_id, value, category, token (tokens differ in a document); ``chunks``: doc_id, ix, text; ``names``:
    doc_id, stem, file_type; ``model``: doc_id, value, category, probability; ``labels``: value, category. Each entity is looked for by itself, by match
    key; its first PLACES places in the order of the chunks are shown, the file name only if there is none. ``source`` is
    model, label or rule, the first that knows it. Chunks are read apart, and no more than PLACES places of an entity leave
    a chunk, so a long document is not gathered; the entities of one document meet in a row. An entity that is nowhere has an
    empty list.
    """
    own = entities.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("value").cast("string").alias("value"), F.col("token").cast("string").alias("token"))).alias("entities"))
    own = own.withColumn("entities", F.filter("entities", lambda e: e["value"].isNotNull() & e["token"].isNotNull()))
    known = names.select("doc_id", "stem", "file_type")
    first = Window.partitionBy("doc_id", "token").orderBy("ix", "nth")
    inside = _places(chunks.select("doc_id", "ix", F.col("text").cast("string")).join(own, "doc_id"), True).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= PLACES)
    place = F.when(F.col("file_type") == "pdf", F.format_string("第 %d 页", F.col("ix") + 1)).otherwise(F.format_string("文本片段 %d", F.col("ix") + 1))
    shown = inside.join(known.select("doc_id", "file_type"), "doc_id", "left").withColumn("location", place)
    stem = _places(known.select("doc_id", F.lit(0).alias("ix"), F.col("stem").cast("string").alias("text")).join(own, "doc_id"), False).filter("nth = 0")
    stem = stem.join(inside.filter("_n = 1").select("doc_id", "token"), ["doc_id", "token"], "left_anti").withColumns({"_n": F.lit(1), "location": F.lit(FILE_NAME)})
    cols = ["doc_id", "token", "_n", "prefix", "match", "suffix", "location"]
    listed = F.array_sort(F.collect_list(F.struct("_n", "prefix", "match", "suffix", "location")))
    every = shown.select(*cols).unionByName(stem.select(*cols)).groupBy("doc_id", "token").agg(listed.alias("held"))
    scored = model.groupBy("doc_id", "value", "category").agg(F.max("probability").alias("probability"), F.lit(True).alias("_model"))
    named = labels.select("value", "category").distinct().withColumn("_label", F.lit(True))
    out = entities.select("doc_id", "value", "category", "token").join(every, ["doc_id", "token"], "left").join(scored, ["doc_id", "value", "category"], "left").join(named, ["value", "category"], "left")
    source: Column = F.when(F.col("_model"), "model").when(F.col("_label"), "label").otherwise("rule")
    empty = F.array().cast("array<struct<prefix:string,match:string,suffix:string,location:string>>")
    occurrences = F.transform("held", lambda x: F.struct(x["prefix"].alias("prefix"), x["match"].alias("match"), x["suffix"].alias("suffix"), x["location"].alias("location")))
    return out.select("doc_id", "token", source.alias("source"), "probability", F.coalesce(occurrences, empty).alias("occurrences"))
