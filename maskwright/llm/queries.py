"""Queries over the training-data operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import alignment, block_names, line_templates, merge_dropout, merkle, mixing, ngram_join, quality_rules, secret_scan, suffix_dedup, toxicity, url_filter, warc
from maskwright.llm.common import table

#: Where the public tokenizer lies; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Byte-level BPE, the piece model, and the first one's vocabulary as ranks with its split pattern.
ALIGNED = ("/opt/tokenizers/byte_bpe_50k.json", PIECE_MODEL, "/opt/tokenizers/byte_bpe_50k.tiktoken", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Share of the uniform entropy that the mixing query asks for: near enough to 1 that sources are repeated.
MIX_ENTROPY = 0.998


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.temporal_list_join(url_filter.captures_of(pages), url_filter.demo_log(spark)).withColumn("fetched", F.col("fetched").cast("string"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_dedup(table(spark, sf_dir, "documents"))


def op6_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.schedule(table(spark, sf_dir, "documents"), entropy_fraction=MIX_ENTROPY)
    return rows.select("doc_id", "src", "epoch", "n_tokens", "block_no", "order_key", F.round("weight", 6).alias("weight"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_docs(table(spark, sf_dir, "documents"), PIECE_MODEL, digest=True)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), ALIGNED)


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_ngram_join, op3_quality_rules, op4_toxicity, op5_line_templates, op6_block_names, op7_mixing, op8_suffix_dedup, op9_secret_scan, op10_merge_dropout, op11_merkle_manifest, op12_alignment, op13_warc_index)
    return {f.__name__: f for f in own}


_LOG = ", ".join(f"('{a}', '{b}', '{c}', '{d}', date '{e}')" for a, b, c, d, e in url_filter.DEMO_LOG)
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({0} AS VARCHAR)", "text")) + ")"

ORACLE = {
    "op1_url_filter": rf"""
WITH log(list, kind, entry, action, day) AS (VALUES {_LOG}),
spans AS (SELECT list, kind, entry, action, day AS a, lead(day) OVER (PARTITION BY list, kind, entry ORDER BY day, action DESC) AS b FROM log),
caps AS (SELECT DISTINCT page_id, url, date '2024-01-01' + CAST((page_id * 7) % 366 AS INTEGER) AS fetched,
  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hits AS (SELECT c.*, s.entry, s.list FROM caps c JOIN spans s ON s.action = 'add' AND c.fetched >= s.a AND (s.b IS NULL OR c.fetched < s.b)
  AND ((s.kind = 'domain' AND (c.host = s.entry OR ends_with(c.host, '.' || s.entry)))
    OR (s.kind = 'prefix' AND (c.host || c.path = s.entry OR starts_with(c.host || c.path, s.entry || '/'))))),
agg AS (SELECT page_id, url, fetched, count(*) AS n, string_agg(DISTINCT entry, '|' ORDER BY entry) AS e, string_agg(DISTINCT list, '|' ORDER BY list) AS l FROM hits GROUP BY ALL)
SELECT c.page_id, c.url, c.host, CAST(c.fetched AS VARCHAR) AS fetched, a.n IS NOT NULL AS blocked, coalesce(a.n, 0) AS n_entries, coalesce(a.e, '') AS entries, coalesce(a.l, '') AS lists
FROM caps c LEFT JOIN agg a ON c.page_id IS NOT DISTINCT FROM a.page_id AND c.url IS NOT DISTINCT FROM a.url AND c.fetched = a.fetched
""",
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
""",
    "op3_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
win2 AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win2) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines > 2 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
""",
    "op6_block_names": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
""",
    "op7_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS src, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY src),
sh AS (SELECT list(tokens / total ORDER BY tokens) AS p FROM (SELECT CAST(tokens AS DOUBLE) AS tokens, CAST(sum(tokens) OVER () AS DOUBLE) AS total FROM s WHERE tokens > 0)),
ent(k, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT k + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT k, lo, hi, ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))) - list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(pow(x, (lo + hi) / 2)))) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) >= {MIX_ENTROPY} * ln(len(p)) AS ok
    FROM ent, sh WHERE k < 50)),
rep(k, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT k, lo, hi, pow(list_min(p) / list_max(p), (lo + hi) / 2 - 1) <= 4 AS ok FROM rep, sh WHERE k < 50)),
a AS (SELECT greatest(CASE WHEN list_sum(list_transform(p, lambda x: -x * ln(x))) >= {MIX_ENTROPY} * ln(len(p)) THEN 1 ELSE (SELECT lo FROM ent WHERE k = 50) END,
  CASE WHEN pow(list_min(p) / list_max(p), -1) <= 4 THEN 0 ELSE (SELECT hi FROM rep WHERE k = 50) END) AS a, p FROM sh),
plan AS (SELECT src, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total / list_max(p), a - 1) ELSE 1 END AS epochs,
  CASE WHEN tokens > 0 THEN pow(tokens / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) ELSE 0 END AS weight FROM (SELECT *, CAST(sum(tokens) OVER () AS DOUBLE) AS total FROM s), a),
plan2 AS (SELECT *, CAST(floor(tokens * epochs) AS BIGINT) AS budget, greatest(1, CAST(ceil(sum(floor(tokens * epochs)) OVER () / 100000) AS BIGINT)) AS n_blocks FROM plan),
c AS (SELECT d.*, p.* EXCLUDE (src), unnest(range(CAST(ceil(epochs) AS BIGINT))) AS epoch FROM d JOIN plan2 p USING (src)),
c2 AS (SELECT *, md5('mix:' || doc_id || ':' || epoch) AS key FROM c),
c3 AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c2),
c4 AS (SELECT *, CASE WHEN budget > 0 THEN least(n_blocks - 1, CAST(floor(CAST(pos AS DOUBLE) / budget * n_blocks) AS BIGINT)) ELSE 0 END AS block_no FROM c3 WHERE epoch = 0 OR pos < budget)
SELECT doc_id, src, epoch, n_tokens, CAST(block_no AS BIGINT) AS block_no, md5(key || block_no) AS order_key, round(weight, 6) AS weight FROM c4
""",
    "op11_merkle_manifest": rf"""
WITH RECURSIVE rows0 AS (SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, CASE WHEN xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0
  THEN {_LEAF.format("(n_chars + 1)")} END AS fake FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS n,
  dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM rows0),
low(g, level, ix, h, n) AS (SELECT g, 0, ix, leaf, n FROM leaves UNION ALL
  SELECT g, level + 1, ix // 2, sha256(string_agg(h, '' ORDER BY ix)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY g, level, ix // 2),
sub AS (SELECT g, h AS subroot, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, ix, h, n) AS (SELECT 0, g, subroot, n FROM sub UNION ALL
  SELECT level + 1, ix // 2, sha256(string_agg(h, '' ORDER BY ix)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, ix // 2),
path AS (SELECT l.g, l.ix, a.level AS step, a.ix % 2 = 1 AS before, b.h FROM leaves l JOIN low a ON a.g = l.g AND a.n > 1 AND a.ix = l.ix >> CAST(a.level AS BIGINT)
    LEFT JOIN low b ON b.g = l.g AND b.level = a.level AND b.ix = xor(a.ix, 1)
  UNION ALL SELECT l.g, l.ix, 1000 + a.level, a.ix % 2 = 1, b.h FROM leaves l JOIN high a ON a.n > 1 AND a.ix = l.g >> CAST(a.level AS BIGINT)
    LEFT JOIN high b ON b.level = a.level AND b.ix = xor(a.ix, 1)),
proof AS (SELECT g, ix, list(CASE WHEN h IS NULL THEN '=' WHEN before THEN '<' || h ELSE '>' || h END ORDER BY step) AS p FROM path GROUP BY g, ix),
every AS (SELECT l.*, coalesce(p, []) AS p, subroot, (SELECT h FROM high WHERE n = 1) AS root FROM leaves l LEFT JOIN proof USING (g, ix) JOIN sub USING (g)),
done AS (SELECT *, sha256(array_to_string(list_transform(p, lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(fake, leaf)], p), lambda a, x: sha256(CASE x[1] WHEN '<' THEN x[2:] || a WHEN '>' THEN a || x[2:] ELSE a END)) AS folded_root FROM every)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
""",
    "op13_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM k
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
