"""Queries of event logs, keyed labels, cached pages and encrypted payloads, with their SQL; ``catalogue`` brings them in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.operators import lifecycle as L
from maskwright.operators import logs, registry
from maskwright.plans.catalogue import query, read
from maskwright.sources import files

#: A secret for the demonstration queries.
SECRET = "demonstration"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_KINDS_SQL = f"list_extract([{', '.join(repr(k) for k in logs.KINDS)}], CAST((event_id * 5 + {_K}) % {len(logs.KINDS)} + 1 AS INTEGER))"


@query(f"""WITH RECURSIVE ev AS (SELECT user_id, event_id, {_KINDS_SQL} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f(user_id, i, event_id, kind, accepted, status, previous, cancel) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST('' AS VARCHAR), false, 'processing', '', false FROM events UNION ALL
  SELECT user_id, i, event_id, kind, ok, CASE WHEN NOT ok OR kind = 'cancel' THEN status WHEN kind LIKE 'claim %' THEN 'processing' WHEN kind = 'restore' THEN 'restored' WHEN kind = 'review' THEN 'review' WHEN kind = 'complete' THEN 'completed'
      WHEN previous IN ('review', 'completed', 'restored') THEN previous WHEN kind = 'interrupted' THEN 'cancelled' ELSE 'failed' END,
    CASE WHEN NOT ok OR kind IN ('cancel', 'restore') THEN previous WHEN kind LIKE 'claim %' THEN status ELSE '' END,
    CASE WHEN NOT ok OR kind = 'restore' THEN cancel ELSE kind = 'cancel' END
  FROM (SELECT f.user_id, ev.i, ev.event_id, ev.kind, f.status, f.previous, f.cancel, CASE WHEN ev.kind LIKE 'claim %' THEN f.status = substr(ev.kind, 7) WHEN ev.kind = 'restore' THEN f.status IN ('completed', 'restored') ELSE f.status = 'processing' END AS ok
    FROM f JOIN ev ON ev.user_id = f.user_id AND ev.i = f.i + 1) x)
SELECT user_id, event_id, kind, accepted, status, cancel AS cancel_requested FROM f WHERE i > 0""")
def state_log(spark, sf):
    """Events as what happens to a task for each user: claims that lose, cancellations, failures, returns to the state before."""
    e = read(spark, sf, "events")
    kind = F.element_at(F.array(*map(F.lit, logs.KINDS)), ((F.col("event_id") * 5 + F.regexp_extract("props", r"(\d+)", 1).cast("long")) % len(logs.KINDS) + 1).cast("int"))
    return logs.fold_tasks(e, "user_id", "event_id", kind, width=1000)


@query("""WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type = 'view' AS exempt, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts, event_id) AS i FROM events),
f(user_id, i, event_id, allowed, held) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, CAST([] AS BIGINT[]) FROM events UNION ALL
  SELECT user_id, i, event_id, len(recent) < 3, CASE WHEN len(recent) < 3 THEN list_concat(recent, [t]) ELSE recent END
  FROM (SELECT f.user_id, ev.i, ev.event_id, ev.t, list_filter(f.held, lambda x: x > ev.t - 172800000000) AS recent FROM f JOIN ev ON ev.user_id = f.user_id AND ev.i = f.i + 1 AND NOT ev.exempt) x)
SELECT event_id, allowed FROM f WHERE i > 0 UNION ALL SELECT event_id, true FROM ev WHERE exempt""")
def rate_limit_log(spark, sf):
    """Three requests in two days a user, views exempt: the form of the limits, at the pace of the table."""
    e = read(spark, sf, "events")
    return logs.rate_limit(e, "user_id", "ts", (3, 172_800), F.col("event_type") != "view").select("event_id", "allowed")


_PADS = registry.pads(SECRET)
_PRINT = "sha256(unhex('{1}') || unhex(sha256(unhex('{0}') || encode({2} || chr(0) || {3}))))"


@query(f"SELECT c_custkey, {_PRINT.format(*_PADS, 'c_mktsegment', 'c_name')} AS fingerprint FROM customer")
def label_fingerprint(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", registry.fingerprint(F.col("c_name"), F.col("c_mktsegment"), SECRET).alias("fingerprint"))


@query(f"""WITH l AS (SELECT c_mktsegment AS category, {_PRINT.format(*_PADS, 'c_mktsegment', 'c_name')} AS fingerprint, c_custkey % 2 = 0 AS active, c_custkey AS id FROM customer)
SELECT category, fingerprint, active OR id % 5 = 0 AS active, id % 5 = 0 AND (id % 3 = 0 OR NOT active) AS changed FROM l WHERE id % 3 <> 0 OR id % 5 = 0""")
def label_upsert_keyed(spark, sf):
    """Two of three customers are labels, half of them inactive; every fifth is put in, twice."""
    c = read(spark, sf, "customer").withColumns({"text": F.col("c_name"), "category": F.col("c_mktsegment")})
    label = registry.fingerprint(F.col("text"), F.col("category"), SECRET).alias("fingerprint")
    old = c.filter("c_custkey % 3 <> 0").select("category", label, F.lit("old").alias("cipher"), (F.col("c_custkey") % 2 == 0).alias("active"))
    new = c.filter("c_custkey % 5 = 0").select("text", "category")
    # where there was no label before, the table has none to wake
    return registry.upsert_labels(old, new.union(new), SECRET).select("category", "fingerprint", "active", "changed")


@query("""WITH l AS (SELECT c_custkey AS id, c_name AS text, c_mktsegment AS category, c_custkey % 3 <> 0 AS active FROM customer), m AS (SELECT max(id) AS top FROM l)
SELECT l.id, CASE WHEN l.id % 10 = 5 THEN 'free' || l.id WHEN l.id % 10 IN (6, 7) THEN p.text ELSE l.text END AS text,
  CASE WHEN l.id % 10 = 5 THEN 'new' WHEN l.id % 10 IN (6, 7) THEN p.category ELSE l.category END AS category,
  CASE WHEN l.id % 10 IN (5, 6, 7) THEN true WHEN l.id % 10 = 0 AND l.id > 0 AND l.id < top THEN true WHEN l.id % 10 = 1 AND l.id > 1 THEN false ELSE l.active END AS active
FROM l LEFT JOIN l p ON p.id = l.id - 1, m""")
def label_update_sequence(spark, sf):
    """Changes one after the other: neighbours that exchange texts (the first gets its own back), and chains in which each takes what the one before left."""
    lab = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 3 != 0).alias("active"))
    theirs = lambda step: lab.select((F.col("id") + step).alias("id"), "text", "category")
    swap = theirs(-1).filter("id % 10 = 0 and id > 0").union(theirs(1).filter("id % 10 = 1 and id > 1"))
    free = lab.filter("id % 10 = 5").select("id", F.concat(F.lit("free"), F.col("id").cast("string")), F.lit("new"))
    chain = theirs(1).filter("id % 10 in (6, 7)")
    return L.update_labels(lab, swap.union(free).union(chain))


_SECTIONS_SQL = "s AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN NULL WHEN conv_id % 4 = 1 THEN turn * 2 + 1 WHEN conv_id % 4 = 2 AND turn > 1 THEN 2 ELSE turn + 1 END AS page FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations))"


@query(f"""WITH {_SECTIONS_SQL}, p AS (SELECT conv_id, page, arg_max(coalesce(text, ''), turn) AS text FROM s GROUP BY conv_id, page),
w AS (SELECT conv_id, count(page) AS n, min(page) AS low, max(page) AS high, sha256(string_agg(text, chr(12) ORDER BY page) FILTER (page IS NOT NULL)) AS sha FROM p GROUP BY conv_id)
SELECT conv_id, CASE WHEN low = 1 AND high = n THEN n END AS n_pages, CASE WHEN low = 1 AND high = n THEN sha END AS sha FROM w""")
def cached_pages(spark, sf):
    """Turns as pages: some numbers are left out, some come again, some sections are no pages."""
    c = read(spark, sf, "conversations").withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    page = F.expr("case when conv_id % 5 = 0 and at = 0 then null when conv_id % 4 = 1 then at * 2 + 1 when conv_id % 4 = 2 and at > 1 then 2 else at + 1 end")
    location = F.when(page.isNotNull(), F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))).otherwise("文本片段 1")
    sections = c.select("conv_id", "at", location.alias("location"), "text")
    return files.cached_pages(sections, "conv_id", "at").select("conv_id", F.when(F.col("pages").isNotNull(), F.size("pages")).cast("long").alias("n_pages"), F.sha2(F.array_join("pages", "\f"), 256).alias("sha"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 0 ELSE doc_id % 5 END AS annotation_count FROM documents")
def training_summary(spark, sf):
    """How many entities are annotated, read from encrypted payloads; every seventh is damaged, every eleventh absent."""
    entities = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 5), lambda i: F.concat(F.lit("e"), i.cast("string")))
    payload = F.to_json(F.struct(F.slice(entities, 1, (F.col("doc_id") % 5).cast("int")).alias("entities")))
    shut = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("AAAA"), registry.encrypt(payload, SECRET))).otherwise(registry.encrypt(payload, SECRET))
    docs = read(spark, sf, "documents").select("doc_id", shut.alias("annotations"))
    return registry.annotation_counts(docs, SECRET).select("doc_id", F.col("annotation_count").cast("long").alias("annotation_count"))


@query("WITH a AS (SELECT p_partkey AS id, p_size % 4 AS n, p_partkey % 9 = 4 AS on_ FROM part) SELECT id, n AS file_count, on_ AS is_active, id = (SELECT min(id) FROM a WHERE on_) AS serves FROM a")
def registry_listing(spark, sf):
    """Parts as model packages with manifests of some files; which one serves."""
    names = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: F.concat(F.lit("f"), i.cast("string")))
    manifest = F.map_from_arrays(F.slice(names, 1, (F.col("p_size") % 4).cast("int")), F.slice(names, 1, (F.col("p_size") % 4).cast("int")))
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("1").alias("version"), F.when(F.col("p_size") % 4 > 0, manifest).alias("manifest"), (F.col("p_partkey") % 9 == 4).alias("is_active"))
    active = registry.active_model(parts, "base").select("active_artifact_id")
    listed = registry.registry_listing(parts).join(F.broadcast(active), F.col("id").cast("string") == F.col("active_artifact_id"), "left")
    return listed.select("id", F.col("file_count").cast("long").alias("file_count"), "is_active", F.col("active_artifact_id").isNotNull().alias("serves"))
