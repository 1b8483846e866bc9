"""Queries of tasks, labels and packages, with their SQL; ``catalogue`` brings them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import lifecycle as L
from maskwright.operators import stats
from maskwright.plans.catalogue import _TASKS_SQL, query, read, tasks

_FILES_SQL = "p AS (SELECT *, event_id::VARCHAR AS id, CASE WHEN k % 3 <> 0 THEN event_id || '_x.txt' END AS anon, CASE WHEN k % 4 = 0 THEN event_id || '.txt' END AS rest FROM tasks)"


@query(f"""WITH {_TASKS_SQL}, {_FILES_SQL} SELECT event_id, coalesce(CASE WHEN status = 'restored' THEN rest ELSE anon END, file_type) AS display_name,
CASE WHEN anon IS NOT NULL AND status <> 'review' THEN '/api/tasks/' || id || '/download/anonymized/' END AS anonymized_url, CASE WHEN rest IS NOT NULL THEN '/api/tasks/' || id || '/download/restored/' END AS restored_url,
CASE WHEN k % 6 <> 0 AND k % 5 = 0 THEN 'model' ELSE 'rules_only' END AS recognition_mode, k % 6 <> 0 AND k % 5 <> 0 AND k % 2 = 0 AS review_required,
k % 6 = 0 OR k % 5 = 0 AS review_confirmed, CASE WHEN k % 6 <> 0 AND k % 5 = 0 THEN k % 11 ELSE selected_count + rejected_count END AS review_candidates,
CASE WHEN k % 6 <> 0 AND k % 5 <> 0 AND k % 2 = 1 THEN k % 4 ELSE 0 END AS ocr_pages, status = 'processing' AND event_id % 7 <> 0 AS can_cancel,
status IN ('completed', 'restored') AS selectable, status <> 'processing' AND k % 2 = 0 AS deletable FROM p""")
def task_projection(spark, sf):
    """What a client sees of a task; a sixth of the options is broken JSON, so defaults hold there."""
    one = lambda form, c: F.format_string(form, F.col("k") % c)
    options = F.when(F.col("k") % 6 == 0, "{broken").when(F.col("k") % 5 == 0, one('{"review_metrics": {"candidate_count": %d}, "uie_mode": "model"}', 11)).when(F.col("k") % 2 == 0, '{"review_required": true}').otherwise(one('{"ocr_page_count": %d, "review_confirmed": false}', 4))
    event = F.col("event_id").cast("string")
    t = tasks(spark, sf).withColumns({"id": event, "original_name": F.col("file_type"), "options": options, "anonymized_file": F.when(F.col("k") % 3 != 0, F.concat(F.lit("out/"), event, F.lit("_x.txt"))), "restored_file": F.when(F.col("k") % 4 == 0, F.concat(F.lit("back/"), event, F.lit(".txt"))), "input_file": event, "restore_input_file": F.lit(""), "cancel_requested": F.col("event_id") % 7 == 0, "entity_counts": F.create_map(F.lit("person"), "selected_count", F.lit("phone"), "rejected_count")})
    confirm = F.when(F.col("k") % 2 == 0, F.col("id")).otherwise("no")
    return L.project(t).select("event_id", "display_name", "anonymized_url", "restored_url", "recognition_mode", "review_required", "review_confirmed", F.col("review_candidates").cast("long").alias("review_candidates"), F.col("ocr_pages").cast("long").alias("ocr_pages"), "can_cancel", L.selectable(F.col("status")).alias("selectable"), L.deletable(F.col("status"), F.col("id"), confirm).alias("deletable"))


_BEFORE = "CASE CAST(k % 4 AS INTEGER) WHEN 0 THEN 'review' WHEN 1 THEN 'restored' WHEN 2 THEN 'processing' END"


@query(f"WITH {_TASKS_SQL}, b AS (SELECT event_id, k, status, {_BEFORE} AS previous FROM tasks) SELECT event_id, CASE WHEN status = 'processing' THEN CASE WHEN previous IN ('review', 'completed', 'restored') THEN previous WHEN k % 2 = 0 THEN 'cancelled' ELSE 'failed' END ELSE status END AS status FROM b")
def state_interrupted(spark, sf):
    """Tasks in processing, cancelled or failed by turns."""
    t = tasks(spark, sf).withColumns({"previous_status": F.expr(_BEFORE), "cancel_requested": F.col("k") % 2 == 0})
    busy = t.filter("status = 'processing'")
    ended = L.interrupted(busy.filter("k % 2 = 0"), "cancelled", "stopped").unionByName(L.interrupted(busy.filter("k % 2 <> 0"), "failed", "error"), allowMissingColumns=True)
    return ended.select("event_id", "status").unionByName(t.filter("status <> 'processing'").select("event_id", "status"))


@query(f"WITH {_TASKS_SQL} SELECT event_id, status = CASE WHEN k % 2 = 0 THEN 'review' ELSE 'completed' END AS claimed, CASE WHEN status = CASE WHEN k % 2 = 0 THEN 'review' ELSE 'completed' END THEN 'processing' ELSE status END AS status FROM tasks")
def state_claim(spark, sf):
    t = tasks(spark, sf).withColumnRenamed("event_id", "id")
    seen = t.select("id", F.when(F.col("k") % 2 == 0, "review").otherwise("completed").alias("seen"))
    return L.claim(t, seen).select(F.col("id").alias("event_id"), "claimed", "status")


@query(f"WITH {_TASKS_SQL} SELECT arg_max(event_id, (created_at, event_id)) AS active_id, count(*) = 0 AS admitted FROM tasks WHERE status = 'processing'")
def task_admission(spark, sf):
    return L.admission(tasks(spark, sf).withColumnsRenamed({"event_id": "id", "created_at": "updated_at"}))


@query(f"WITH {_TASKS_SQL} SELECT file_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS INTEGER) AS position FROM tasks GROUP BY file_type")
def stats_ordered(spark, sf):
    return L.ordered_counts(tasks(spark, sf), "file_type", "event_id")


@query("SELECT s AS status, count(d.doc_id) AS n FROM (SELECT unnest(['processing', 'ready', 'labeled', 'failed']) AS s) LEFT JOIN (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'ready' WHEN n_chars % 3 = 1 THEN 'labeled' ELSE 'other' END AS t FROM documents) d ON t = s GROUP BY s")
def training_status(spark, sf):
    """Every state of a training document, zeros included."""
    r = F.col("n_chars") % 3
    docs = read(spark, sf, "documents").groupBy(F.when(r == 0, "ready").when(r == 1, "labeled").otherwise("other").alias("status")).agg(F.count("*").alias("n"))
    spine = spark.createDataFrame([(s,) for s in L.TRAINING_STATUSES], "status string")
    return spine.join(docs, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_TASKS_SQL} SELECT CAST(sum(selected_count + rejected_count) AS BIGINT) AS entities, CAST(sum(len(range(k % 4))) AS BIGINT) AS occurrences, count(*) AS tasks FROM tasks")
def stats_totals(spark, sf):
    """Entities over all maps, and occurrences over all lists of spans."""
    t = tasks(spark, sf).withColumns({"m": F.create_map(F.lit("person"), "selected_count", F.lit("phone"), "rejected_count"), "spans": F.expr("if(k % 4 = 0, array(), sequence(1L, k % 4))")})
    return t.agg(F.sum(L.total_entities(F.col("m"))).alias("entities"), F.sum(F.size("spans")).alias("occurrences"), F.count("*").alias("tasks"))


@query(f"WITH {_TASKS_SQL} SELECT (SELECT CAST(sum(selected_count + rejected_count) AS BIGINT) FROM tasks) AS entities, (SELECT count(*) FROM labels) AS training_examples, (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) AS active_labels, (SELECT count(*) FROM documents) AS training_documents")
def stats_scalar_counts(spark, sf):
    counts = tasks(spark, sf).select(F.create_map(F.lit("person"), "selected_count", F.lit("phone"), "rejected_count").alias("counts"))
    return stats.scalar_counts(counts, read(spark, sf, "labels"), _labels(spark, sf), read(spark, sf, "documents"))


@query("""SELECT doc_id, i - 1 AS position, text, category FROM (SELECT doc_id, unnest(range(1, 4)) AS i, unnest([trim(source), lang, 'a|b']) AS text, unnest(['person', 'custom', 'custom']) AS category FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 1, lang, 'email' FROM documents WHERE doc_id % 2 = 1)""")
def custom_entities(spark, sf):
    """Lists written by hand (name, none, unknown name) and lists in JSON, of which only objects count."""
    by_line = F.concat(F.lit("人名 | "), F.trim("source"), F.lit("\r\n\n "), F.col("lang"), F.lit(" \n不明|a|b"))
    d = read(spark, sf, "documents").withColumn("v", F.when(F.col("doc_id") % 2 == 0, by_line).otherwise(F.concat(F.lit('[1, "x", {"text": "'), "lang", F.lit('", "category": "email"}]'))))
    return d.select("doc_id", F.posexplode(L.custom_entities(F.col("v"))).alias("position", "e")).select("doc_id", F.col("position").cast("long").alias("position"), "e.text", "e.category")


@query("SELECT o_custkey AS text, o_orderpriority AS category FROM orders WHERE o_orderkey % 2 = 0 AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 1)")
def rejected_annotations(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("text"), F.col("o_orderpriority").alias("category"))
    return L.rejected(o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 2 = 1").drop("o_orderkey"))


@query("WITH m AS (SELECT o_custkey AS c, o_orderpriority AS p, max(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), l AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O'), e AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders) SELECT e.c AS text, e.p AS category, x AS probability, CASE WHEN m.c IS NOT NULL THEN 'model' WHEN l.c IS NOT NULL THEN 'label' ELSE 'rule' END AS source FROM e LEFT JOIN m USING (c, p) LEFT JOIN l USING (c, p)")
def entity_source(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("text"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("probability"), "o_orderstatus")
    return L.entity_source(o.select("text", "category").distinct(), o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'O'"))


@query("SELECT d.doc_id, l.doc_id AS label_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def example_labels(spark, sf):
    """Documents as examples of a label; many have none."""
    return L.with_label(read(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("label_id")), read(spark, sf, "labels").withColumnRenamed("doc_id", "id")).select("doc_id", "label_id")


def _labels(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("text"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 3 != 0).alias("active"))


_LABELS_SQL = "l AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS text, c_mktsegment AS category, c_custkey % 3 <> 0 AS active FROM customer)"


@query(f"""WITH {_LABELS_SQL}, ch AS (SELECT a.id, CASE WHEN a.id % 10 = 0 THEN (a.id + 1)::VARCHAR ELSE 'new' || a.id // 20 END AS t, CASE WHEN a.id % 10 = 0 THEN coalesce(b.category, 'none') ELSE 'BUILDING' END AS c FROM l a LEFT JOIN l b ON b.id = a.id + 1 WHERE a.id % 10 IN (0, 5)),
x AS (SELECT ch.*, o.id AS owner, min(ch.id) OVER (PARTITION BY t, c) AS first FROM ch LEFT JOIN l o ON o.text = t AND o.category = c)
SELECT l.id, CASE WHEN x.id IS NOT NULL AND owner IS NULL AND first = x.id THEN t ELSE l.text END AS text, CASE WHEN x.id IS NOT NULL AND owner IS NULL AND first = x.id THEN c ELSE l.category END AS category,
CASE WHEN l.id IN (SELECT owner FROM x WHERE owner IS NOT NULL) THEN true WHEN x.id IS NULL THEN l.active ELSE owner IS NULL AND first = x.id END AS active FROM l LEFT JOIN x ON x.id = l.id""")
def label_update_collision(spark, sf):
    """Changes to what another label has (every 10th), and pairs of changes to one new text."""
    lab = _labels(spark, sf)
    theirs = lab.select((F.col("id") - 1).alias("id"), F.col("text").alias("t"), F.col("category").alias("c"))
    onto = lab.filter("id % 10 = 0").select("id").join(theirs, "id", "left").select("id", F.coalesce("t", (F.col("id") + 1).cast("string")).alias("text"), F.coalesce("c", F.lit("none")).alias("category"))
    new = lab.filter("id % 10 = 5").select("id", F.expr("'new' || id div 20").alias("text"), F.lit("BUILDING").alias("category"))
    return L.update_labels(lab, onto.unionByName(new))


@query(f"WITH {_LABELS_SQL} SELECT id, text, category, active AND id % 4 <> 0 AS active, active AND id % 4 = 0 AS changed FROM l")
def label_soft_delete(spark, sf):
    lab = _labels(spark, sf)
    return L.deactivate(lab, lab.filter("id % 4 = 0"))


@query(f"WITH {_LABELS_SQL} SELECT id, CASE WHEN NOT active THEN 'created' WHEN id % 5 = 0 THEN 'deleted' ELSE 'updated' END AS action, CASE WHEN active THEN text END AS before_text, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 7 = 0 THEN upper(text || 'x') ELSE text END END AS after_text FROM l WHERE (active OR id % 5 <> 0) AND NOT (active AND id % 5 <> 0 AND id % 7 <> 0)")
def label_audit(spark, sf):
    lab = _labels(spark, sf)
    after = lab.withColumns({"text": F.expr("if(id % 7 = 0, upper(text || 'x'), text)"), "active": F.expr("id % 5 <> 0")})
    return L.audit_events(lab, after).select("id", "action", F.col("before.text").alias("before_text"), F.col("after.text").alias("after_text"))


@query(f"WITH {_LABELS_SQL} SELECT id, category FROM l WHERE active")
def label_listing(spark, sf):
    return L.label_listing(_labels(spark, sf).withColumn("created_at", -F.col("id"))).select("id", "category")


@query("SELECT source AS package, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, count(DISTINCT doc_id % 40) < count(*) AS repeated, max(doc_id % 40 = 3) AS blocked, NOT max(doc_id % 40 = 1) AS no_weights FROM documents GROUP BY source")
def package_guard(spark, sf):
    """Documents as entries of a package for each source."""
    r = F.col("doc_id") % 40
    name = F.when(r == 1, "m\\W.pdparams").when(r == 3, "m/run.SH").otherwise(F.concat(F.lit("m/"), r.cast("string")))
    e = read(spark, sf, "documents").select(F.col("source").alias("package"), name.alias("entry"), F.col("n_chars").alias("size"), F.lit(1).alias("csize"), F.lit(0).alias("flags"), F.lit(0o100644).alias("mode"))
    has = lambda x: F.array_contains("faults", x).alias(x)
    return L.package_guard(e).select("package", "n", "total", has("repeated"), has("blocked"), has("no_weights"))


_ENTRY_SQL = "e AS (SELECT doc_id, source AS package, CASE WHEN lang = 'en' THEN 'top' ELSE source END || '/' || doc_id AS entry FROM documents)"


@query(f"WITH {_ENTRY_SQL}, r AS (SELECT package, count(DISTINCT split_part(entry, '/', 1)) = 1 AS one FROM e GROUP BY package) SELECT package, doc_id, CASE WHEN one THEN doc_id::VARCHAR ELSE entry END AS entry FROM e JOIN r USING (package)")
def package_paths(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("package"), F.concat(F.when(F.col("lang") == "en", "top").otherwise(F.col("source")), F.lit("/"), F.col("doc_id").cast("string")).alias("entry"))
    return L.strip_common_root(d).select("package", "doc_id", "entry")


@query("SELECT source AS package, array_to_string(list_sort(list_filter(['de', 'en', 'xx'], lambda x: NOT list_contains(list(lang), x))), ',') AS missing FROM documents GROUP BY source")
def archive_missing(spark, sf):
    e = read(spark, sf, "documents").select(F.col("source").alias("package"), F.col("lang").alias("entry"))
    return L.missing_members(e, ["de", "en", "xx"]).select("package", F.array_join("missing", ",").alias("missing"))


@query(r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '请选择需要处理的文件。' WHEN page_id % 5 = 1 THEN '仅支持 .xls、.docx、.pdf、.ofd、.txt 文件。' WHEN page_id % 5 = 2 THEN '文件大小不能超过 200 MB。' WHEN page_id % 5 = 3 THEN 'bad' END AS error,
page_id % 3 = 0 AS local, coalesce(nullif(left(trim(regexp_replace(url, '[<>:\\/*?"|]', '_', 'g'), ' ._'), 24), ''), 'model') AS label, CASE WHEN page_id % 2 = 0 THEN 'custom' ELSE 'phone' END AS category FROM pages""")
def scalar_guards(spark, sf):
    r = F.col("page_id") % 5
    p = read(spark, sf, "pages").withColumns({"name": F.when(r == 0, None).when(r == 1, "a.exe").otherwise("a.PDF"), "size": F.when(r == 2, (200 << 20) + 1).otherwise(1), "wrong": F.when(r == 3, "bad"), "link": F.when(F.col("page_id") % 3 == 0, "http://LOCALHOST:8000/").when(F.col("page_id") % 3 == 1, "http://127.0.0.1.example.org/").otherwise("http://127.0.0.1/x"), "cat": F.when(F.col("page_id") % 2 == 0, "").otherwise(" phone ")})
    return p.select("page_id", L.upload_error(F.col("name"), F.col("size"), F.col("wrong")).alias("error"), L.loopback(F.col("link")).alias("local"), L.package_label(F.col("url"), "model", 24).alias("label"), L.category_or_error(F.col("cat")).alias("category"))


@query("SELECT doc_id, lang || chr(10) || source || chr(10) || 'zz' || chr(10) || 'zz' AS text FROM documents")
def ocr_text(spark, sf):
    """Lines that the blocks hold are left out; further ones stay, repeats too."""
    blocks = F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.col("source"))
    return read(spark, sf, "documents").select("doc_id", L.ocr_text(blocks, F.array("source", F.lit("zz"), F.lit(" "), "lang", F.lit("zz"))).alias("text"))


@query("SELECT n_name AS name FROM nation UNION ALL (SELECT DISTINCT r_name FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation))")
def append_absent(spark, sf):
    names, regions = read(spark, sf, "nation").select(F.col("n_name").alias("name")), read(spark, sf, "region").select(F.col("r_name").alias("name"))
    return L.append_absent(names, regions.union(names.select(F.lower("name"))), "name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -n_nationkey - 1, 'new' FROM nation")
def replace_or_add(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_custkey % 3 = 0").select("c_custkey").unionAll(read(spark, sf, "nation").select(-F.col("n_nationkey") - 1)).withColumn("segment", F.lit("new"))
    return L.replace_or_add(c, new, "c_custkey")


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS stem, doc_id % 2 = 0 AS pdf FROM documents), c AS (SELECT doc_id, unnest(v) AS text, unnest(range(len(v))) AS ix FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, 0 AS index, '文件名' AS location, stem AS text FROM n WHERE stem <> '' UNION ALL SELECT doc_id, CAST(ix + CASE WHEN stem <> '' THEN 1 ELSE 0 END AS BIGINT), CASE WHEN pdf THEN '第 ' || (ix + 1) || ' 页' ELSE '文本片段 ' || (ix + 1) END, text FROM c JOIN n USING (doc_id))
SELECT doc_id, index, location, length(text) AS n_chars, CASE WHEN index = 0 AND doc_id % 5 = 0 THEN '1-2;3-4' ELSE '' END AS spans FROM s""")
def preview_sections(spark, sf):
    d = read(spark, sf, "documents")
    names = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("stem"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("txt").alias("file_type"))
    chunks = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ix", "text"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(a + 1).cast("long").alias("end")) for a in (3, 1)]))
    spans = d.filter("doc_id % 5 = 0").select("doc_id", F.lit(0).cast("long").alias("index"), pairs.alias("p")).select("doc_id", "index", "p.start", "p.end", F.lit("【人001】").alias("token"), F.lit("person").alias("category"))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";")
    return L.preview_sections(names, chunks, spans).select("doc_id", "index", "location", F.length("text").cast("long").alias("n_chars"), shown.alias("spans"))
