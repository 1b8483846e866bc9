"""The queries of the package, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright import constants as C
from maskwright.functions import columns as X
from maskwright.operators import registry, spans, stats
from maskwright.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- detection -------------------------------------------------------------------------------------------------

# the same rules for an engine without look-around: the character before and after are matched and cut off
_SQL_EMAIL = r"(?i)(?:^|[^\p{L}\p{N}_.])([\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+)(?:$|[^\p{L}\p{N}_.])"
_EMAIL_ROWS = """SELECT {key}, i - 1 AS ordinal, value FROM (SELECT {key}, unnest(v) AS value, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{re}', 1) AS v FROM {table} WHERE {text} LIKE '%@%'))"""


def emails(df: DataFrame, key: str, text: str) -> DataFrame:
    return spans.pattern_spans(df, key, text, X.EMAIL, "email", 6, F.col(text).contains("@"))


@query(_EMAIL_ROWS.format(key="doc_id", text="text", table="documents", re=_SQL_EMAIL))
def det_email_documents(spark, sf):
    return emails(read(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "value")


@query(_EMAIL_ROWS.format(key="page_id", text="html", table="pages", re=_SQL_EMAIL))
def det_email_pages(spark, sf):
    return emails(read(spark, sf, "pages"), "page_id", "html").select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "value")


_RULES = {"landline": (X.LANDLINE, r"(?:^|[^0-9])(0[0-9]{2,3}[\s—-]?[0-9]{7,8})(?:$|[^0-9])"), "mobile": (X.MOBILE, r"(?:^|[^0-9])(1[3-9](?:[\s-]?[0-9]){9})(?:$|[^0-9])"), "service": (X.SERVICE, r"(?:^|[^0-9])(400[\s-]?[0-9]{3}[\s-]?[0-9]{4})(?:$|[^0-9])"), "id_card": (X.ID_CARD, r"(?:^|[^0-9A-Za-z])([0-9]{17}[0-9Xx]|[0-9]{15})(?:$|[^0-9A-Za-z])"), "credit_code": (X.CREDIT_CODE, r"(?i)(?:^|[^0-9A-Z])([159Y][0-9ABCDEFGHJKLMNPQRTUWXY]{17})(?:$|[^0-9A-Z])")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(coalesce(sum(len(regexp_extract_all(text, '{r}', 1))), 0) AS BIGINT) AS hits FROM documents" for n, (_, r) in _RULES.items()))
def det_rule_counts(spark, sf):
    """One scan for all number rules; a run of seven digits, blanks aside, is what any of them needs."""
    docs = read(spark, sf, "documents")
    guarded = F.col("text").rlike(r"[0-9A-Za-z]{15}|[0-9](?:[\s—-]?[0-9]){6}")
    sums = docs.agg(*[F.coalesce(F.sum(F.when(guarded, F.size(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).otherwise(0)), F.lit(0)).alias(n) for n, (p, _) in _RULES.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("hits")) for n in _RULES])).alias("x")).select("x.rule", "x.hits")


@query()
def det_email_two_view(spark, sf):
    """The e-mail rule over the source and the de-spaced view, through the rule engine."""
    from maskwright.operators.documents import deidentify

    docs = read(spark, sf, "documents").filter(F.col("text").contains("@")).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_ix"), "text")
    return deidentify(docs, enabled=("email",)).select("doc_id", "masked")


# --- dictionary, spans, tokens ---------------------------------------------------------------------------------

#: A label dictionary from the nations: the name in small letters, and its first four letters as a shorter rival.
_ENTRIES_SQL = "SELECT value, min(category) AS category, min(rank) AS rank FROM (SELECT lower(n_name) AS value, 'location' AS category, 3 AS rank FROM nation UNION ALL SELECT lower(n_name[1:4]), 'product', 2 FROM nation UNION ALL SELECT 'tion', 'organization', 0 UNION ALL SELECT 'ation', 'person', 1 UNION ALL SELECT 'ing on', 'product', 2) GROUP BY value"
_FOUND_SQL = f"""e AS ({_ENTRIES_SQL}), d AS (SELECT doc_id, text FROM documents), m AS (SELECT doc_id, value, category, rank, string_split(text, value) AS g FROM d JOIN e ON contains(text, value)),
found AS (SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(value) AS INTEGER) AS start, value, category, rank FROM (SELECT *, unnest(range(1, len(g))) AS i FROM m)),
f AS (SELECT doc_id, start, CAST(start + length(value) AS INTEGER) AS stop, category, rank, value FROM found)"""
_GREEDY_SQL = f"""{_FOUND_SQL}, srt AS (SELECT doc_id, list(DISTINCT {{'neg': start - stop, 'start': start, 'rank': rank, 'stop': stop, 'category': category, 'value': value}}) AS l FROM f GROUP BY doc_id),
srt2 AS (SELECT doc_id, list_sort(l) AS l FROM srt),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: x[1].start < y.stop AND x[1].stop > y.start)) > 0 THEN a ELSE list_concat(a, x) END)) AS s FROM srt2),
sel AS (SELECT doc_id, s.start AS start, s.stop AS stop, s.category AS category, s.value AS value FROM kept)"""
_TOKEN_SQL = f"""{_GREEDY_SQL}, fst AS (SELECT doc_id, value, min(start) AS first, arg_min(category, start) AS category FROM sel GROUP BY doc_id, value),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY first) AS number FROM fst),
tok AS (SELECT doc_id, value, category, CAST(number AS INTEGER) AS number, printf('【%s%03d】', CASE category WHEN 'organization' THEN '单' WHEN 'person' THEN '人' WHEN 'product' THEN '品' ELSE '区' END, number) AS token FROM num)"""


def entries(spark, sf):
    n = read(spark, sf, "nation")
    own = spark.createDataFrame([("tion", "organization", 0), ("ation", "person", 1), ("ing on", "product", 2)], "value string, category string, rank int")
    all_ = n.select(F.lower("n_name").alias("value"), F.lit("location").alias("category"), F.lit(3).alias("rank")).union(n.select(F.lower(F.left("n_name", F.lit(4))), F.lit("product"), F.lit(2))).union(own)
    return all_.groupBy("value").agg(F.min("category").alias("category"), F.min("rank").alias("rank"))


def found(spark, sf):
    return spans.dictionary_spans(read(spark, sf, "documents"), "doc_id", "text", entries(spark, sf)).drop("found")


def chosen(spark, sf):
    return spans.greedy(found(spark, sf), "doc_id")


def tokens(spark, sf):
    return spans.number(chosen(spark, sf), "doc_id", C.CODES)


@query(f"WITH {_FOUND_SQL} SELECT value, category, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM f GROUP BY value, category")
def dict_label_scan(spark, sf):
    return found(spark, sf).groupBy("value", "category").agg(F.count("*").alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"))


#: Labels as people write them: names of nations in capitals with blanks between the letters, and parts of words in wide or mixed letters.
_LABELS_SQL = "SELECT array_to_string(list_transform(string_split(n_name, ''), lambda c: c), ' ') AS value, 'location' AS category FROM nation UNION ALL SELECT * FROM (VALUES ('Ｔｉｏｎ', 'organization'), ('A TION', 'person'), ('the​ y', 'product'), ('LING	th', 'product'))"
_KEY_SQL = rf"""WITH lab AS ({_LABELS_SQL}), e AS (SELECT category, lower(regexp_replace(translate(value, 'Ｔｉｏｎ', 'tion'), '[\s​]', '', 'g')) AS k FROM lab),
p AS (SELECT category, k, '(?i)' || array_to_string(string_split(k, ''), '[\s\x0b\x1c-\x1f ​]*') AS re FROM e)
SELECT doc_id, k AS label, category, i - 1 AS ordinal, f[i] AS found FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, k, category, regexp_extract_all(text, re) AS f FROM documents, p))"""


@query(_KEY_SQL)
def dict_key_scan(spark, sf):
    """Labels found by their match keys, whatever the case, width and spacing on either side, with the source text of each place."""
    own = spark.createDataFrame([("Ｔｉｏｎ", "organization"), ("A TION", "person"), ("the​ y", "product"), ("LING	th", "product")], "value string, category string")
    names = read(spark, sf, "nation").select(F.array_join(F.split("n_name", ""), " ").alias("value"), F.lit("location").alias("category"))
    labels = names.union(own).withColumn("rank", F.lit(0))
    hits = spans.dictionary_spans(read(spark, sf, "documents"), "doc_id", "text", labels, by_key=True)
    label = F.lower(F.regexp_replace(F.translate("value", "Ｔｉｏｎ", "tion"), "[\\s​]", ""))
    nth = F.row_number().over(Window.partitionBy("doc_id", "value").orderBy("start")) - 1
    return hits.select("doc_id", label.alias("label"), "category", nth.cast("long").alias("ordinal"), "found")


@query(f"WITH {_GREEDY_SQL} SELECT doc_id, start, stop, category, value FROM sel")
def spn_greedy_nonoverlap(spark, sf):
    return chosen(spark, sf).withColumnRenamed("end", "stop")


@query(f"WITH {_FOUND_SQL} SELECT doc_id, start, stop, value FROM f a WHERE category <> 'organization' AND NOT EXISTS (SELECT 1 FROM f p WHERE p.category = 'organization' AND p.doc_id = a.doc_id AND a.start < p.stop AND a.stop > p.start)")
def spn_interval_anti(spark, sf):
    f = found(spark, sf)
    return spans.not_overlapping(f.filter("category <> 'organization'"), f.filter("category = 'organization'"), "doc_id").select("doc_id", "start", F.col("end").alias("stop"), "value")


@query(f"WITH {_TOKEN_SQL} SELECT doc_id, value, category, number, token FROM tok")
def enc_tokens_per_doc(spark, sf):
    return tokens(spark, sf).select("doc_id", "value", "category", "number", "token")


@query(f"WITH {_TOKEN_SQL} SELECT category, count(DISTINCT doc_id || token) AS n_tokens FROM tok GROUP BY category")
def enc_category_counts(spark, sf):
    return tokens(spark, sf).groupBy("category").agg(F.count_distinct(F.concat(F.col("doc_id").cast("string"), "token")).alias("n_tokens"))


@query(f"WITH {_FOUND_SQL} SELECT DISTINCT doc_id, value, category FROM f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1 AND f.category = 'person')")
def enc_exclusion_anti(spark, sf):
    """People of documents of good quality are excluded; other categories of the same form are not."""
    out = read(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("person").alias("category"))
    return found(spark, sf).select("doc_id", "value", "category").distinct().join(out, ["doc_id", "category"], "left_anti").select("doc_id", "value", "category")


@query(f"WITH {_TOKEN_SQL}, old AS (SELECT doc_id, category, max(CAST(regexp_extract(token, '([0-9]+)', 1) AS INTEGER)) AS last FROM tok GROUP BY ALL) SELECT t.doc_id, t.value, printf('%03d', t.number + o.last) AS next FROM tok t JOIN old o USING (doc_id, category)")
def enc_counter_continue(spark, sf):
    t = tokens(spark, sf)
    last = t.groupBy("doc_id", "category").agg(F.max(F.regexp_extract("token", r"(\d+)", 1).cast("int")).alias("last"))
    return spans.number(chosen(spark, sf), "doc_id", C.CODES, last).select("doc_id", "value", F.format_string("%03d", "number").alias("next"))


_MASK_SQL = f"""WITH {_TOKEN_SQL}, p AS (SELECT s.doc_id, s.start, s.stop, t.token, coalesce(lag(s.stop) OVER (PARTITION BY s.doc_id ORDER BY s.start), 0) AS prev FROM sel s JOIN tok t USING (doc_id, value)),
j AS (SELECT p.doc_id, string_agg(substr(d.text, prev + 1, start - prev) || token, '' ORDER BY start) AS head, max(stop) AS last, count(*) AS n FROM p JOIN documents d USING (doc_id) GROUP BY p.doc_id),
mm AS (SELECT d.doc_id, CASE WHEN j.n IS NULL THEN d.text ELSE head || substr(d.text, last + 1) END AS masked, CAST(coalesce(j.n, 0) AS INTEGER) AS n_spans, d.text FROM documents d LEFT JOIN j USING (doc_id))"""


def masked(spark, sf):
    toks = tokens(spark, sf).select("doc_id", "value", "token")
    placed = chosen(spark, sf).join(toks, ["doc_id", "value"]).select("doc_id", "start", "end", "token")
    return spans.mask(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", placed), toks


@query(f"{_MASK_SQL} SELECT doc_id, n_spans, masked FROM mm")
def rpl_mask_text(spark, sf):
    return masked(spark, sf)[0].select("doc_id", "n_spans", "masked")


@query("SELECT doc_id, text AS restored FROM documents")
def rst_roundtrip(spark, sf):
    m, toks = masked(spark, sf)
    return spans.restore(m.select("doc_id", "masked"), "doc_id", "masked", toks).select("doc_id", "restored")


@query(f"WITH {_GREEDY_SQL}, k AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id, value ORDER BY start) AS nth, count(*) OVER (PARTITION BY doc_id, value) AS n FROM sel s) SELECT k.doc_id, value, nth, n, trim(regexp_replace(substr(text, greatest(start - 70, 0) + 1, stop + 70 - greatest(start - 70, 0)), '\\s+', ' ', 'g')) AS context FROM k JOIN documents d ON d.doc_id = k.doc_id WHERE nth <= 3")
def kwic_top3(spark, sf):
    w = Window.partitionBy("doc_id", "value")
    top = chosen(spark, sf).withColumns({"nth": F.row_number().over(w.orderBy("start")).cast("long"), "n": F.count("*").over(w)}).filter("nth <= 3")
    return top.join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "value", "nth", "n", X.kwic(F.col("text"), F.col("start"), F.col("end")).alias("context"))


@query(f"WITH {_FOUND_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY doc_id, start) AS nth FROM f) SELECT value, doc_id, start, nth FROM k WHERE nth <= 8")
def ann_contexts_top8(spark, sf):
    return found(spark, sf).withColumn("nth", F.row_number().over(Window.partitionBy("value").orderBy("doc_id", "start")).cast("long")).filter("nth <= 8").select("value", "doc_id", "start", "nth")


@query(f"WITH {_GREEDY_SQL}, g AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM sel) SELECT doc_id, start, stop, 'entity' AS kind FROM g UNION ALL SELECT doc_id, prev, start, 'plain' FROM g WHERE start > prev UNION ALL SELECT d.doc_id, coalesce(m, 0), CAST(length(text) AS INTEGER), 'plain' FROM documents d LEFT JOIN (SELECT doc_id, max(stop) AS m FROM sel GROUP BY doc_id) x ON x.doc_id = d.doc_id WHERE length(text) > coalesce(m, 0)")
def preview_segments(spark, sf):
    g = chosen(spark, sf).withColumn("prev", F.lag("end", 1, 0).over(Window.partitionBy("doc_id").orderBy("start")))
    ends = g.groupBy("doc_id").agg(F.max("end").alias("m"))
    tail = read(spark, sf, "documents").select("doc_id", F.length("text").alias("n")).join(ends, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(0)).alias("start"), F.col("n").alias("stop")).filter("stop > start")
    kind = lambda k: F.lit(k).alias("kind")
    return g.select("doc_id", "start", F.col("end").alias("stop"), kind("entity")).union(g.filter("start > prev").select("doc_id", "prev", "start", kind("plain"))).union(tail.withColumn("kind", F.lit("plain")))


# --- chunks and scalars ----------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CAST(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 2000 AS within FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations) WHERE t <> ''")
def collector_running_total(spark, sf):
    return files.collected(read(spark, sf, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "running", "within")


@query(r"SELECT conv_id, turn, length(regexp_replace(text, '\s', '', 'g')) < 12 AS ocr FROM conversations")
def ocr_route_short(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", files.needs_ocr(F.col("text")).alias("ocr"))


@query(r"SELECT page_id, lower(regexp_replace(url, '\s+', '', 'g')) AS key, trim(regexp_replace(url, '\s+', ' ', 'g'), ' ,;.!/:，；。！、：') AS clean, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[\\/:*?\"<>|]', '_', 'g') AS safe, concat('DA-20240102-', upper(left(sha256(url), 6))) AS code, upper(left(sha256(concat('data-security-platform', chr(0), url)), 8)) AS ns, least(greatest(page_id, 72), 300) AS dpi FROM pages")
def norm_scalars(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", X.ascii_key(u).alias("key"), X.clean_value(u).alias("clean"), X.safe_name(u).alias("safe"), X.task_code(F.lit("2024-01-02").cast("timestamp"), F.sha2(u, 256)).alias("code"), X.namespace(u).alias("ns"), X.clamp(F.col("page_id"), 72, 300).alias("dpi"))


@query(r"SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS label FROM part WHERE length(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) BETWEEN 2 AND 200")
def label_normalize(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.label_text(F.col("p_name")).alias("label")).filter("label is not null")


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def hash_documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY text")
def chunk_dedup(spark, sf):
    """Distinct texts at their first place; the text itself is the key, so equal hashes are not trusted."""
    return read(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.sha2("text", 256).alias("sha"))


# --- task log --------------------------------------------------------------------------------------------------

_TASKS_SQL = """t AS (SELECT event_id, list_extract(['processing', 'review', 'completed', 'restored', 'failed', 'cancelled'], CAST(event_id % 6 + 1 AS INTEGER)) AS status, upper(coalesce(nullif(event_type, ''), 'unknown')) AS file_type, ts AS created_at,
CASE WHEN event_id % 10 = 0 THEN -1 ELSE value END AS duration_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_id % 3 = 0 AS reviewed FROM events),
tasks AS (SELECT *, k % 17 AS candidate_count, k % 7 AS selected_count, k % 5 AS rejected_count, k % 3 AS corrected_count, k % 2 AS added_count FROM t)"""


def tasks(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    t = read(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, C.STATUSES)), (F.col("event_id") % 6 + 1).cast("int")).alias("status"), F.upper(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown"))).alias("file_type"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 10 == 0, -1.0).otherwise(F.col("value")).alias("duration_ms"), k.alias("k"), (F.col("event_id") % 3 == 0).alias("reviewed"))
    return t.withColumns({"candidate_count": F.col("k") % 17, "selected_count": F.col("k") % 7, "rejected_count": F.col("k") % 5, "corrected_count": F.col("k") % 3, "added_count": F.col("k") % 2})


@query(f"WITH {_TASKS_SQL} SELECT CAST(i - 1 AS INTEGER) AS pos, s AS status, count(status) AS n FROM (SELECT unnest(['processing', 'review', 'completed', 'restored', 'failed', 'cancelled']) AS s, unnest(range(1, 7)) AS i) LEFT JOIN tasks ON status = s GROUP BY i, s")
def stats_status_dist(spark, sf):
    return stats.status_distribution(tasks(spark, sf))


@query(f"WITH {_TASKS_SQL} SELECT file_type, count(*) AS n FROM tasks GROUP BY file_type")
def stats_filetype(spark, sf):
    return tasks(spark, sf).groupBy("file_type").agg(F.count("*").alias("n"))


@query(f"WITH {_TASKS_SQL} SELECT 'selected' AS category, CAST(sum(selected_count) AS BIGINT) AS n FROM tasks UNION ALL SELECT 'rejected', CAST(sum(rejected_count) AS BIGINT) FROM tasks")
def stats_entity_map(spark, sf):
    """A map column, exploded and summed."""
    m = tasks(spark, sf).select(F.explode(F.create_map(F.lit("selected"), "selected_count", F.lit("rejected"), "rejected_count")).alias("category", "v"))
    return m.groupBy("category").agg(F.sum("v").alias("n"))


@query(f"WITH {_TASKS_SQL} SELECT CAST(CAST(created_at + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM tasks GROUP BY 1")
def stats_daily_tz(spark, sf):
    return tasks(spark, sf).groupBy(stats.local_day("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {_TASKS_SQL}, d AS (SELECT CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day FROM tasks), s AS (SELECT CAST(max(day) - CAST(i AS INTEGER) AS DATE) AS day FROM d, range(7) r(i) GROUP BY i) SELECT CAST(s.day AS VARCHAR) AS day, count(d.day) AS n FROM s LEFT JOIN d USING (day) GROUP BY s.day")
def stats_7day_spine(spark, sf):
    return stats.daily_spine(tasks(spark, sf))


@query(f"WITH {_TASKS_SQL} SELECT CAST(sum(candidate_count) AS BIGINT) AS candidate_count, CAST(sum(selected_count) AS BIGINT) AS selected_count, CAST(sum(rejected_count) AS BIGINT) AS rejected_count, CAST(sum(corrected_count) AS BIGINT) AS corrected_count, CAST(sum(added_count) AS BIGINT) AS added_count, count_if(reviewed)::BIGINT AS reviewed_tasks FROM tasks")
def stats_review_totals(spark, sf):
    return stats.review_totals(tasks(spark, sf))


@query(f"WITH {_TASKS_SQL} SELECT CAST(sum(CASE WHEN reviewed THEN selected_count WHEN status IN ('completed', 'restored') THEN selected_count + rejected_count ELSE 0 END) AS BIGINT) AS confirmed FROM tasks")
def stats_confirmed_case(spark, sf):
    n = F.when(F.col("reviewed"), F.col("selected_count")).when(F.col("status").isin("completed", "restored"), F.col("selected_count") + F.col("rejected_count")).otherwise(0)
    return tasks(spark, sf).agg(F.sum(n).alias("confirmed"))


@query(f"WITH {_TASKS_SQL} SELECT round(avg(duration_ms) / 1000, 3) AS avg_s, round(max(duration_ms) / 1000, 3) AS max_s, count(*) AS n FROM tasks WHERE duration_ms >= 0")
def stats_durations(spark, sf):
    return stats.durations(tasks(spark, sf))


@query(f"WITH {_TASKS_SQL} SELECT round(100.0 * count_if(status IN ('completed', 'restored')) / count(*), 1)::DOUBLE AS completion_rate, round(100.0 * sum(selected_count) / sum(candidate_count), 1)::DOUBLE AS acceptance_rate FROM tasks")
def stats_rates(spark, sf):
    return stats.rates(tasks(spark, sf)).select(F.col("completion_rate").cast("double").alias("completion_rate"), F.col("acceptance_rate").cast("double").alias("acceptance_rate"))


@query(f"WITH {_TASKS_SQL} SELECT file_type, n, CASE WHEN n > 0 THEN greatest(4.0, n * 100.0 / greatest(1, max(n) OVER ())) ELSE 0 END::DOUBLE AS width FROM (SELECT file_type, count(*) AS n FROM tasks GROUP BY 1)")
def stats_bar_width(spark, sf):
    t = stats_filetype(spark, sf)
    top = t.agg(F.max("n").alias("m"))
    return t.join(F.broadcast(top), F.col("m") >= F.col("n")).select("file_type", "n", F.when(F.col("n") > 0, F.greatest(F.lit(4.0), F.col("n") * 100.0 / F.greatest(F.lit(1), "m"))).otherwise(0.0).cast("double").alias("width"))


@query(f"WITH {_TASKS_SQL} SELECT event_id, CASE WHEN status <> 'processing' THEN status WHEN k % 4 = 0 THEN 'review' WHEN k % 3 = 0 THEN 'completed' WHEN reviewed THEN 'review' ELSE 'cancelled' END AS status FROM tasks")
def state_restart_recovery(spark, sf):
    t = tasks(spark, sf).withColumns({"previous_status": F.when(F.col("k") % 4 == 0, "review"), "has_output": F.col("k") % 3 == 0, "has_mapping": F.col("reviewed")})
    return registry.recover(t).select("event_id", "status")


@query(f"WITH {_TASKS_SQL} SELECT event_id, CAST(created_at AS VARCHAR)[1:19] AS created FROM tasks ORDER BY created_at DESC, event_id DESC LIMIT 100")
def latest_100(spark, sf):
    """A top-k report."""
    return tasks(spark, sf).orderBy(F.desc("created_at"), F.desc("event_id")).limit(100).select("event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def label_upsert_latest(spark, sf):
    """A log of label events as the table it amounts to: the last event of each (user, type)."""
    return registry.latest_state(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


# --- review, training, models ----------------------------------------------------------------------------------


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'rejected' WHEN l.quality <> d.n_chars % 2 THEN 'corrected' ELSE 'kept' END AS verdict FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)")
def review_classify(spark, sf):
    d = read(spark, sf, "documents").filter("lang = 'en'").select("doc_id", (F.col("n_chars") % 2).alias("chosen"))
    return read(spark, sf, "labels").join(d, "doc_id", "left").select("doc_id", F.when(F.col("chosen").isNull(), "rejected").when(F.col("quality") != F.col("chosen"), "corrected").otherwise("kept").alias("verdict"))


@query("WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS m FROM orders GROUP BY o_custkey) SELECT o_custkey, CAST(len(m) AS INTEGER) AS n FROM g WHERE len(list_filter(m, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))) = 0")
def alias_forall(spark, sf):
    """Groups all of whose members are selected."""
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("m"))
    picked = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))
    return g.filter(F.forall("m", lambda x: F.array_contains(picked, x))).select("o_custkey", F.size("m").alias("n"))


@query("(SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1) EXCEPT SELECT doc_id FROM documents WHERE lang = 'fr'")
def exclusion_update(spark, sf):
    """Exclusions: the earlier and the removed ones, less those added back."""
    lab = read(spark, sf, "labels")
    old = lab.filter("quality = 0").select("doc_id").union(lab.filter("toxic = 1").select("doc_id")).distinct()
    return old.join(read(spark, sf, "documents").filter("lang = 'fr'").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT user_id, event_type FROM (SELECT user_id, event_type FROM events WHERE value > 250 UNION ALL SELECT user_id, upper(event_type) FROM events WHERE value < 5)")
def annotation_merge(spark, sf):
    e = read(spark, sf, "events")
    return e.filter("value > 250").select("user_id", "event_type").union(e.filter("value < 5").select("user_id", F.upper("event_type"))).distinct()


_PROMPT_ROWS = [("organization", "单位名称"), ("person", "人名"), ("product", "烟草品牌或产品名称"), ("location", "烟叶产区"), ("address", "详细地址")]


@query(f"WITH {_FOUND_SQL}, p(category, prompt) AS (VALUES {', '.join(map(str, _PROMPT_ROWS))}), h AS (SELECT doc_id, category, string_agg(start || '-' || stop, ';' ORDER BY start, stop) AS hits FROM f GROUP BY doc_id, category) SELECT d.doc_id, p.prompt, coalesce(h.hits, '') AS result_list FROM documents d CROSS JOIN p LEFT JOIN h ON h.doc_id = d.doc_id AND h.category = p.category")
def training_jsonl(spark, sf):
    """A training sample per document and prompt; what has no hit is a negative sample."""
    hits = found(spark, sf).groupBy("doc_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";").alias("hits"))
    prompts = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("prompt")) for c, p in _PROMPT_ROWS])
    each = read(spark, sf, "documents").select("doc_id", F.explode(prompts).alias("p")).select("doc_id", "p.category", "p.prompt")
    return each.join(hits, ["doc_id", "category"], "left").select("doc_id", "prompt", F.coalesce("hits", F.lit("")).alias("result_list"))


@query("WITH c AS (SELECT vec_id % 200 AS doc_id, 'v' || label AS value, list_extract(['person', 'product', 'organization', 'location'], CAST(vec_id % 4 + 1 AS INTEGER)) AS category, ((vec_id * 37) % 100) / 100.0 AS prob, vec_id AS ix FROM embeddings), g AS (SELECT *, CASE category WHEN 'organization' THEN 5 WHEN 'product' THEN 4 WHEN 'location' THEN 3 ELSE 1 END AS prio FROM c WHERE prob >= CASE category WHEN 'person' THEN 0.7 WHEN 'organization' THEN 0.55 ELSE 0.6 END) SELECT doc_id, value, category, prob::DOUBLE AS prob, ix FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY prio DESC, prob DESC, ix) AS n FROM g) WHERE n = 1")
def model_conflict_best(spark, sf):
    from maskwright.functions.mapping import PRIORITY

    c = read(spark, sf, "embeddings").select((F.col("vec_id") % 200).alias("doc_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("value"), F.element_at(F.array(*map(F.lit, ("person", "product", "organization", "location"))), (F.col("vec_id") % 4 + 1).cast("int")).alias("category"), ((F.col("vec_id") * 37 % 100) / 100.0).cast("double").alias("prob"), F.col("vec_id").alias("ix"))
    return registry.best_candidates(c, {"person": 0.7, "organization": 0.55, "product": 0.6, "location": 0.6, "address": 0.6}, PRIORITY)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND (contains(lower(text), 'ation') OR contains(lower(source), 'src1'))")
def preview_search(spark, sf):
    return read(spark, sf, "documents").filter(F.col("lang").isin("en", "de") & (F.lower("text").contains("ation") | F.lower("source").contains("src1"))).select("doc_id", "lang")


@query(r"SELECT source AS archive, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(max(n_chars / greatest(doc_id % 50, 1)), 4)::DOUBLE AS ratio, max(n_chars) <= 83886080 AND sum(n_chars) <= 262144000 AND max(n_chars / greatest(doc_id % 50, 1)) <= 200 AND count(*) <= 5000 AS safe FROM documents GROUP BY source")
def archive_guard(spark, sf):
    e = read(spark, sf, "documents").select(F.col("source").alias("archive"), F.col("lang").alias("entry"), F.col("n_chars").alias("size"), (F.col("doc_id") % 50).alias("csize"))
    return registry.archive_guard(e)


@query("WITH e AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents), a AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN sha256(lang) ELSE sha256(text) END AS found FROM documents WHERE doc_id % 17 <> 0) SELECT path, sha, found FROM e LEFT JOIN a USING (path) WHERE found IS NULL OR found <> sha")
def manifest_diff(spark, sf):
    d = read(spark, sf, "documents")
    actual = d.filter("doc_id % 17 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 13 == 0, F.sha2("lang", 256)).otherwise(F.sha2("text", 256)).alias("sha"))
    return registry.manifest_difference(d.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha")), actual)


@query("WITH s(long, short) AS (VALUES ('1', ' one'), ('2', ' two'), ('12', ' twelve')) SELECT n_name, n_name[1:length(n_name) - length(long)] || short AS alias FROM nation JOIN s ON ends_with(n_name, long)")
def alias_short_names(spark, sf):
    """Each long ending of a fixed table that a name has, replaced by its short one."""
    table = F.array(*[F.struct(F.lit(a).alias("long"), F.lit(b).alias("short")) for a, b in (("1", " one"), ("2", " two"), ("12", " twelve"))])
    each = read(spark, sf, "nation").select("n_name", F.explode(F.filter(table, lambda x: F.endswith("n_name", x["long"]))).alias("x"))
    return each.select("n_name", F.expr("concat(left(n_name, length(n_name) - length(x.long)), x.short)").alias("alias"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_mktsegment, c_name, c_custkey")
def review_order(spark, sf):
    return read(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).orderBy("c_mktsegment", "c_name", "c_custkey").select("c_custkey", "c_name")


@query()
def crypto_roundtrip(spark, sf):
    """Encrypted, decrypted and with a wrong key; random initial vectors put it beyond SQL."""
    r = read(spark, sf, "region").withColumn("ct", registry.encrypt(F.col("r_name"), "secret"))
    return r.select("r_regionkey", (registry.decrypt(F.col("ct"), "secret") == F.col("r_name")).alias("same"), registry.decrypt(F.col("ct"), "other").isNull().alias("shut"))


from maskwright.plans import lifecycle, logs, rules  # noqa: E402, F401  (register their queries)
