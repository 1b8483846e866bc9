"""Tasks, labels and packages over their life: projections, state changes, guards, listings, audit events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.constants import CATEGORIES
from maskwright.functions.columns import strip
from maskwright.operators.graph import connected
from maskwright.shared import written

#: States a task returns to when its processing ends early.
RESUMABLE = ("review", "completed", "restored")
SELECTABLE = ("completed", "restored")
# fixed values: states of a training document
TRAINING_STATUSES = ("processing", "ready", "labeled", "failed")
# fixed values: names of categories in hand-written entity lists
CATEGORY_NAMES = {"单位": "organization", "人名": "person", "产品": "product", "品牌": "product", "产区": "location", "地点": "location", "电话": "phone", "证件": "id_card", "邮箱": "email", "地址": "address", "敏感项": "custom"}
# fixed values: what a model package holds and may not hold
WEIGHTS = r"\.(pdparams|pdiparams)$"
CONFIGS = ("model_config.json", "config.json", "taskflow_config.json")
TOKENIZERS = ("vocab.txt", "tokenizer.json", "sentencepiece.bpe.model", "spiece.model")
BLOCKED = r"\.(py|pyc|pyd|so|dll|exe|bat|cmd|ps1|sh)$"
# fixed values: extensions of uploads and the messages of their guard
EXTENSIONS = r"(?i)[^/\\]\.(xls|docx|pdf|ofd|txt)$"
NO_UPLOAD, BAD_TYPE = "请选择需要处理的文件。", "仅支持 .xls、.docx、.pdf、.ofd、.txt 文件。"

_OPTIONS = "uie_mode string, uie_detected_count long, uie_rejected_count long, processing_progress map<string, string>, ocr_page_count long, ocr_mode string, review_required boolean, review_confirmed boolean, review_metrics struct<candidate_count: long>, anonymization_namespace string"


# --- scalars ---------------------------------------------------------------------------------------------------


def json_or(c: Column, schema: str, default: Column) -> Column:
    """The JSON text as ``schema``; ``default`` for null, the empty text and what is no JSON."""
    return F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), F.from_json(c, schema)).otherwise(default)


def total_entities(counts: Column) -> Column:
    """Sum of a map's values; 0 for a null map."""
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0)).cast("long")), F.lit(0).cast("long"))


def custom_entities(c: Column) -> Column:
    """array<struct<text, category>>: the objects of a JSON list, else a line each, as ``category|text`` or text alone."""
    listed = F.call_function("try_variant_get", F.try_parse_json(c), F.lit("$"), F.lit("array<variant>"))
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    lines = F.filter(F.transform(F.split(c, "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"), strip), lambda x: x != "")

    def of_line(x):
        bar = F.instr(x, "|")
        text = F.when(bar > 0, strip(F.substr(x, bar + 1))).otherwise(x)
        category = F.when(bar > 0, F.coalesce(F.element_at(names, strip(F.substring_index(x, "|", 1))), F.lit("custom"))).otherwise(F.lit("custom"))
        return F.struct(text.alias("text"), category.alias("category"))

    objects = F.filter(listed, lambda x: F.call_function("schema_of_variant", x).startswith("OBJECT"))
    found = F.transform(objects, lambda x: F.struct(F.call_function("try_variant_get", x, F.lit("$.text"), F.lit("string")).alias("text"), F.call_function("try_variant_get", x, F.lit("$.category"), F.lit("string")).alias("category")))
    return F.coalesce(found, F.transform(lines, of_line), F.array().cast("array<struct<text: string, category: string>>"))


def category_or_error(c: Column) -> Column:
    """A known category, custom for null and the empty text; anything else is an error."""
    named = strip(F.coalesce(F.nullif(c, F.lit("")), F.lit("custom")))
    return F.when(named.isin(*CATEGORIES), named).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), named)))


def upload_error(name: Column, size: Column, content_error: Column, most_mb: int = 200) -> Column:
    """The first thing wrong with an upload, null if nothing is."""
    return F.when(name.isNull(), NO_UPLOAD).when(~name.rlike(EXTENSIONS), BAD_TYPE).when(size > most_mb << 20, f"文件大小不能超过 {most_mb} MB。").otherwise(content_error)


def loopback(url: Column) -> Column:
    """Whether a URL is plain HTTP on this host, without user, path, query and fragment."""
    form = r"(?i)^http://(127\.0\.0\.1|localhost)(:(\d*))?/?\??#?$"
    port = F.nullif(F.regexp_extract(url, form, 3), F.lit(""))
    # a port of more digits than a long has is out of range too
    return F.coalesce(url.rlike(form) & (port.isNull() | F.coalesce(port.try_cast("long") <= 65535, F.lit(False))), F.lit(False))


def package_label(c: Column, default: str, most: int) -> Column:
    clean = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\x00-\x1f<>:\\/*?"|]', "_"), F.lit(" ._"))
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit(default)), F.lit(most))


def ocr_text(blocks: Column, lines: Column) -> Column:
    """Layout blocks in order, then every recognised line that is no part of the joined blocks."""
    full = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), strip), lambda x: x != "")
    joined = F.array_join(full(blocks), "\n")
    return strip(F.array_join(F.concat(full(blocks), F.filter(full(lines), lambda x: ~F.contains(joined, x))), "\n"))


def supports(offered: Column, wanted: Column) -> Column:
    """Whether a model has a category that is asked for."""
    return F.coalesce(F.arrays_overlap(offered, wanted), F.lit(False))


# --- tasks -----------------------------------------------------------------------------------------------------


def project(tasks: DataFrame) -> DataFrame:
    """``tasks`` with what a client sees of them; ``options`` is JSON text, files are names or null."""
    o = json_or(F.col("options"), _OPTIONS, F.lit(None))
    opt = lambda name, default: F.coalesce(F.col(f"_o.{name}"), F.lit(default))
    t = tasks.withColumn("_o", o)
    download = lambda kind: F.concat(F.lit("/api/tasks/"), "id", F.lit(f"/download/{kind}/"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    shown = F.when(F.col("status") == "restored", F.col("restored_file")).otherwise(F.col("anonymized_file"))
    required = opt("review_required", False)
    return t.withColumns(
        {
            "display_name": F.coalesce(F.regexp_extract(F.nullif(shown, F.lit("")), r"([^/]*)$", 1), "original_name"),
            "anonymized_url": F.when(has("anonymized_file") & (F.col("status") != "review"), download("anonymized")),
            "restored_url": F.when(has("restored_file"), download("restored")),
            "stored_files": F.struct(*[has(c).alias(c) for c in ("input_file", "anonymized_file", "restore_input_file", "restored_file")]),
            "recognition_mode": opt("uie_mode", "rules_only"),
            "model_detected": opt("uie_detected_count", 0),
            "model_rejected": opt("uie_rejected_count", 0),
            "progress": F.col("_o.processing_progress"),
            "ocr_pages": opt("ocr_page_count", 0),
            "ocr_mode": opt("ocr_mode", "fast"),
            "review_required": required,
            "review_confirmed": F.coalesce(F.col("_o.review_confirmed"), ~required),
            "review_candidates": F.coalesce(F.col("_o.review_metrics.candidate_count"), total_entities(F.col("entity_counts"))),
            "namespace": opt("anonymization_namespace", ""),
            "can_cancel": (F.col("status") == "processing") & ~F.col("cancel_requested"),
        }
    ).drop("_o")


def selectable(status: Column) -> Column:
    return status.isin(*SELECTABLE)


def deletable(status: Column, task_id: Column, confirm: Column) -> Column:
    """A task goes only with its own id as confirmation, and never while it is processed."""
    return F.coalesce((confirm == task_id) & (status != "processing"), F.lit(False))


def interrupted(tasks: DataFrame, otherwise: str, detail: str) -> DataFrame:
    """``tasks`` (status, previous_status) after a cancellation or failure: back where they were, else ``otherwise``."""
    back = F.when(F.col("previous_status").isin(*RESUMABLE), F.col("previous_status")).otherwise(F.lit(otherwise))
    return tasks.withColumns({"status": back, "previous_status": F.lit(None).cast("string"), "cancel_requested": F.lit(False), "error_message": F.lit(detail)})


def claim(tasks: DataFrame, seen: DataFrame) -> DataFrame:
    """Compare and set: a task still in the state of ``seen`` (id, seen) starts processing; ``claimed`` tells which did.

    A task has one winner however many claim it: claims by several states are one if the task's is among them. Who of
    them wins is told by their order, see logs.fold_tasks.
    """
    wanted = seen.select("id", F.col("seen").alias("status"), F.lit(True).alias("_fits")).distinct()
    t = tasks.join(wanted, ["id", "status"], "left").withColumn("claimed", F.coalesce("_fits", F.lit(False)))
    t = t.withColumns({"previous_status": F.when(F.col("claimed"), F.col("status")), "status": F.when(F.col("claimed"), F.lit("processing")).otherwise(F.col("status"))})
    return t.select(*tasks.columns, *(["previous_status"] if "previous_status" not in tasks.columns else []), "claimed")


def admission(tasks: DataFrame) -> DataFrame:
    """One row: the latest task in processing (by updated_at, id) and whether a new one may start."""
    active = tasks.filter("status = 'processing'").agg(F.max_by("id", F.struct("updated_at", "id")).alias("active_id"))
    return active.withColumn("admitted", F.col("active_id").isNull())


def ordered_counts(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, n, position): most frequent first, ties as first seen by ``order``; a label's rows are counted before they are ranked."""
    from pyspark.sql import Window

    counts = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.select(label, "n", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).alias("position"))


# --- entities and labels ---------------------------------------------------------------------------------------


def entity_source(entities: DataFrame, model: DataFrame, labels: DataFrame) -> DataFrame:
    """``entities`` (text, category) with source (model, label or rule, the first that knows them) and probability."""
    key = ["text", "category"]
    m = model.groupBy(*key).agg(F.max("probability").alias("probability"), F.lit(True).alias("_m"))
    known = labels.select(*key).distinct().withColumn("_l", F.lit(True))
    source = F.when(F.col("_m"), "model").when(F.col("_l"), "label").otherwise("rule")
    return entities.join(m, key, "left").join(known, key, "left").withColumn("source", source).drop("_m", "_l")


def rejected(known: DataFrame, selected: DataFrame) -> DataFrame:
    """Annotations (text, category) that were known and not selected."""
    return known.join(selected, ["text", "category"], "left_anti")


def with_label(examples: DataFrame, labels: DataFrame) -> DataFrame:
    """Examples keep their row when their label is gone; its id is null then."""
    return examples.join(labels.select(F.col("id").alias("label_id"), F.lit(True).alias("_there")), "label_id", "left").withColumn("label_id", F.when(F.col("_there"), F.col("label_id"))).drop("_there")


def update_labels(labels: DataFrame, changes: DataFrame, order: str = "id") -> DataFrame:
    """``labels`` (id long, text, category, active) after ``changes`` (id, text, category), one after the other by ``order``, then id.

    Where another label has the new text and category (of several the one of the smallest id), it becomes active and the
    changed one inactive, its text staying; else the changed one takes them and is active. Each change meets what those
    before it left. Only changes that share a label or a text and category can meet, directly or over others: these
    groups are found first, and each is worked off in order; labels outside pass by. Changes of unknown ids are ignored.
    """
    value = lambda: F.xxhash64(F.lit("value"), "category", "text")
    node = lambda: F.xxhash64(F.lit("id"), "id")
    ch = written(changes.select(F.col("id").cast("long").alias("id"), "text", "category", F.col(order).cast("long").alias("seq")))
    kind_of_id, columns = labels.schema["id"].dataType, ["id", "text", "category", "active"]
    labels = labels.select(*columns).withColumn("id", F.col("id").cast("long"))
    meets = labels.join(ch.select("text", "category").distinct(), ["text", "category"], "left_semi").select("id")
    touched = labels.join(ch.select("id").union(meets).distinct(), "id", "left_semi")
    links = touched.select(node().alias("a"), value().alias("b")).union(ch.select(node(), value()))
    # hashes that meet by chance only join two groups
    groups = connected(links).withColumnRenamed("node", "a")
    kind = "g long, change int, seq long, id long, text string, category string, active boolean"
    parts = touched.select(node().alias("a"), F.lit(0).alias("change"), F.lit(0).cast("long").alias("seq"), *columns)
    parts = parts.union(ch.select(node(), F.lit(1), "seq", "id", "text", "category", F.lit(None).cast("boolean"))).join(groups, "a")
    dealt = parts.select(F.col("root").alias("g"), *[x.split()[0] for x in kind.split(", ")][1:]).repartition("g").sortWithinPartitions("g", "change", "seq", "id")

    def run(batches):
        now, held, owners = None, {}, {}

        def result():
            rows = [(i, *x) for i, x in held.items()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["id", "text", "category", "active"])

        for batch in batches:
            for g, change, _, i, text, category, active in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    yield result()
                    now, held, owners = g, {}, {}
                if not change:
                    held[i] = [text, category, active]
                    owners.setdefault((text, category), set()).add(i)
                elif i in held:
                    others = owners.setdefault((text, category), set()) - {i}
                    if others:
                        held[min(others)][2], held[i][2] = True, False
                    else:
                        owners[held[i][0], held[i][1]].discard(i)
                        owners[text, category].add(i)
                        held[i] = [text, category, True]
        yield result()

    done = dealt.mapInArrow(run, "id long, text string, category string, active boolean")
    rest = labels.join(touched.select("id"), "id", "left_anti")
    return rest.unionByName(done).withColumn("id", F.col("id").cast(kind_of_id)).select(*columns)


def deactivate(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """``labels`` with those of ``ids`` inactive; ``changed`` tells which were active before."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    t = labels.join(gone, "id", "left").withColumn("changed", F.coalesce(F.col("_gone") & F.col("active"), F.lit(False)))
    return t.withColumn("active", F.when(F.col("_gone"), False).otherwise(F.col("active"))).drop("_gone")


def audit_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, action, before, after) of the labels that differ between two states; inactive ones count as absent."""
    state = lambda df, name: df.filter("active").select("id", F.struct("text", "category").alias(name))
    both = state(before, "before").join(state(after, "after"), "id", "full").filter("not before <=> after")
    return both.select("id", F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated").alias("action"), "before", "after")


def label_listing(labels: DataFrame) -> DataFrame:
    """Active labels by category and age."""
    return labels.filter("active").orderBy("category", "created_at", "id")


def append_absent(items: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``items`` and those of ``new`` whose ``key`` it has in no case; of several in ``new`` that differ in case the first by key."""
    low = F.lower(key).alias("_low")
    add = new.groupBy(low).agg(F.min(key).alias(key)).join(items.select(low).distinct(), "_low", "left_anti")
    return items.select(key).unionByName(add.select(key))


def replace_or_add(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``new`` in the place of rows of the same ``key``, others added."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def preview_sections(names: DataFrame, chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, index, location, text, spans): the file name first, if there is one, then the chunks.

    ``names``: doc_id, stem, file_type; ``chunks``: doc_id, ix, text; ``spans``: doc_id, index, start, end, token,
    category. A section without spans has an empty list; spans come by start.
    """
    has = F.coalesce(F.col("stem") != "", F.lit(False))
    place = F.when(F.col("file_type") == "pdf", F.format_string("第 %d 页", F.col("ix") + 1)).otherwise(F.format_string("文本片段 %d", F.col("ix") + 1))
    first = names.filter(has).select("doc_id", F.lit(0).cast("long").alias("index"), F.lit("文件名").alias("location"), F.col("stem").alias("text"))
    rest = chunks.join(names, "doc_id").select("doc_id", (F.col("ix") + has.cast("int")).cast("long").alias("index"), place.alias("location"), "text")
    held = spans.groupBy("doc_id", "index").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token", "category"))).alias("spans"))
    kind = "array<struct<start: bigint, end: bigint, token: string, category: string>>"
    return first.unionByName(rest).join(held, ["doc_id", "index"], "left").withColumn("spans", F.coalesce(F.col("spans").cast(kind), F.array().cast(kind)))


# --- packages --------------------------------------------------------------------------------------------------


def _casefolded(c: Column) -> Column:
    """Lower case, and ß as ss: paths that differ in case only are one."""
    return F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss"))


def package_guard(entries: DataFrame, most_files: int = 5000, total_bytes: int = 1 << 30, ratio: float = 250.0, packages: DataFrame | None = None) -> DataFrame:
    """Per package of (package, entry, size, csize, flags, mode): n, total and the faults that forbid to open it.

    Faults: empty, too_many, too_large, encrypted, bad_path, repeated (without case, ``.`` and doubled separators), symlink, blocked,
    ratio (entries of over 10 MiB only), no_weights, no_config, no_tokenizer. Folders (entries that end in a
    separator) are no files; weights, configuration and tokenizer are looked for in the package's folder, after a folder that holds all.
    ``packages`` (package) are reported too if they have no entry.
    """
    path = F.regexp_replace("entry", r"\\", "/")
    e = entries.filter(~F.coalesce(path.endswith("/"), F.lit(False))).withColumn("_raw", path)
    steps = F.filter(F.split("_raw", "/"), lambda x: (x != "") & (x != "."))
    e = e.withColumn("_path", F.concat(F.when(F.col("_raw").startswith("/"), "/").otherwise(""), F.array_join(steps, "/")))
    # per path first, so that repeated paths are counted without gathering a package's names
    e = e.groupBy("package", _casefolded(F.col("_path")).alias("_key")).agg(F.count("*").alias("n"), F.min("_path").alias("_path"), F.max("_raw").alias("_raw"), F.sum("size").alias("size"), F.max(F.col("flags").bitwiseAND(1)).alias("shut"), F.max((F.shiftright("mode", 12) == 10).cast("int")).alias("link"), F.max(((F.col("size") > 10 << 20) & (F.col("size") > ratio * F.col("csize")) & (F.col("csize") > 0)).cast("int")).alias("dense"))
    bad = F.col("_key").rlike(r"^/|(^|/)\.\.(/|$)|[:\x00]|^$")
    top = F.when(F.col("_path").contains("/"), F.substring_index("_path", "/", 1))
    name = F.lower(F.regexp_extract("_path", r"([^/]*)$", 1))
    e = e.withColumns({"_top": top, "_name": name, "_depth": F.size(F.split("_path", "/"))})
    here = lambda what, depth: F.max(what & (F.col("_depth") == depth))
    wanted = {"weights": F.col("_name").rlike(WEIGHTS), "config": F.col("_name").isin(*CONFIGS), "tokenizer": F.col("_name").isin(*TOKENIZERS)}
    s = e.groupBy("package").agg(
        F.sum("n").alias("n"), F.sum("size").cast("long").alias("total"), F.max("n").alias("same"), F.max("shut").alias("shut"), F.max("link").alias("link"), F.max("dense").alias("dense"), F.max(bad).alias("bad"),
        F.max(F.col("_name").rlike(BLOCKED)).alias("blocked"), (F.count("_top") == F.count("*")).alias("deep"), (F.min("_top") == F.max("_top")).alias("one"),
        *[here(what, depth).alias(f"{n}{depth}") for n, what in wanted.items() for depth in (1, 2)],
    )
    has = lambda n: F.when(F.col("deep") & F.col("one"), F.col(f"{n}2")).otherwise(F.col(f"{n}1"))
    s = s.withColumn("empty", F.lit(False))
    if packages is not None:
        s = packages.select("package").distinct().join(s, "package", "left").withColumns({"empty": F.col("n").isNull(), "n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    checks = [("empty", F.col("empty")), ("too_many", F.col("n") > most_files), ("too_large", F.col("total") > total_bytes), ("encrypted", F.col("shut") > 0), ("bad_path", F.col("bad")), ("repeated", F.col("same") > 1), ("symlink", F.col("link") > 0), ("blocked", F.col("blocked")), ("ratio", F.col("dense") > 0), ("no_weights", ~has("weights")), ("no_config", ~has("config")), ("no_tokenizer", ~has("tokenizer"))]
    return s.select("package", "n", "total", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks])).alias("faults"))


def strip_common_root(entries: DataFrame) -> DataFrame:
    """``entries`` (package, entry) without the first folder, where all of a package lie in the same one."""
    top = F.substring_index("entry", "/", 1)
    root = entries.groupBy("package").agg(((F.min(top) == F.max(top)) & F.min(F.contains("entry", F.lit("/")))).alias("_one"))
    return entries.join(root, "package").withColumn("entry", F.when(F.col("_one"), F.expr("substr(entry, instr(entry, '/') + 1)")).otherwise(F.col("entry"))).drop("_one")


def missing_members(entries: DataFrame, required: list[str]) -> DataFrame:
    """(package, missing): the required members that an archive lacks."""
    need = F.array(*map(F.lit, required))
    return entries.groupBy("package").agg(F.array_sort(F.array_except(need, F.collect_set(F.when(F.col("entry").isin(*required), F.col("entry"))))).alias("missing"))
