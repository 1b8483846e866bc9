"""Queries of the recognition rules, with their SQL; ``catalogue`` brings them in.

Texts are built around columns of a table by expressions that Spark and DuckDB read alike; what the rules are to find in
them stands in the SQL only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions.mapping import PRIORITY
from maskwright.operators import detect as D
from maskwright.operators import registry, spans
from maskwright.plans.catalogue import query, read

# parts of the texts, from a number k
_DIGITS = "lpad(CAST(k AS STRING), 8, '0')"
_NAME = "(substr('赵钱孙李周吴郑王冯陈', CAST(k % 10 AS INT) + 1, 1) || substr('伟敏芳娟磊静涛艳', CAST(k % 8 AS INT) + 1, 1) || substr('国强丽明华', CAST(k % 5 AS INT) + 1, 1))"
_OTHER = "('欧阳' || substr('娜峰琳', CAST(k % 3 AS INT) + 1, 1))"
_PROVINCE = "substr('云南山东贵州四川', 2 * CAST(k % 4 AS INT) + 1, 2)"
_PLACE = "substr('文山普洱曲靖', 2 * CAST(k % 3 AS INT) + 1, 2)"
_N = "CAST(k AS STRING)"
_SPACED = "(substr({0}, 1, 1) || ' ' || substr({0}, 2, 1) || ' ' || substr({0}, 3, 1))".format(_NAME)


def _cat(*parts: str) -> str:
    return " || ".join(parts)


#: (rule, text, what is found: category and value). One text a row of the table, by turns.
TEXTS = [
    ("ORG-01", _cat("'同'", _PROVINCE, "'复烤联合。'"), [("organization", _cat(_PROVINCE, "'复烤'"))]),
    ("ORG-02", _cat("'前往陆良厂调研'", _N), [("organization", "'陆良厂'")]),
    ("ORG-03", _cat(_PROVINCE, "'烟叶复烤有限责任公司。'"), [("organization", _cat(_PROVINCE, "'烟叶复烤有限责任公司'"))]),
    ("ORG-04", _cat(_PLACE, "'市烟草公司五华区公司，编号'", _N), [("organization", _cat(_PLACE, "'市烟草公司五华区公司'"))]),
    ("ORG-05", _cat(_PROVINCE, "'烟草（集团）有限责任公司，编号'", _N), [("organization", _cat(_PROVINCE, "'烟草（集团）有限责任公司'"))]),
    ("ORG-06", _cat("'中标人：华信贸易'", _N, "'有限公司'"), [("organization", _cat("'华信贸易'", _N, "'有限公司'"))]),
    ("ORG-07", _cat("'经办部门：'", "substr('综合计划科技信息安全质量', 4 * CAST(k % 3 AS INT) + 1, 4)", "'处。'"), [("organization", _cat("substr('综合计划科技信息安全质量', 4 * CAST(k % 3 AS INT) + 1, 4)", "'处'"))]),
    ("ORG-08", _cat("substr('华信宏达中原', 2 * CAST(k % 3 AS INT) + 1, 2)", "'财务部。'"), [("organization", _cat("substr('华信宏达中原', 2 * CAST(k % 3 AS INT) + 1, 2)", "'财务部'"))]),
    ("ORG-09", _cat("'走进中国烟草第'", _N, "'期'"), [("organization", "'中国烟草'")]),
    ("ORG-10", _cat("'宏达'", _N, "'号技术中心。'"), [("organization", _cat("'宏达'", _N, "'号技术中心'"))]),
    ("ORG-11", _cat("'陆良、泸西、'", _PLACE, "'厂联合开展改造'", _N), [("organization", "'陆良'"), ("organization", "'泸西'"), ("organization", _PLACE)]),
    ("ORG-12", _cat("'先后走访陆良、泸西、石林等3家复烤厂，第'", _N, "'次'"), [("organization", "'陆良'"), ("organization", "'泸西'"), ("organization", "'石林'")]),
    ("ORG-13", _cat("'本项目由'", _PROVINCE, "'中烟工业有限责任公司承担'", _N), [("organization", _cat(_PROVINCE, "'中烟工业有限责任公司'"))]),
    ("PER-01", _cat("'联系人：'", _NAME, "'，编号'", _N), [("person", _NAME)]),
    ("PER-02", _cat(_NAME, "'同志负责第'", _N, "'项'"), [("person", _NAME)]),
    ("PER-03", _cat("'人员名单：'", _NAME, "'、'", _OTHER, "'（第'", _N, "'组）。'"), [("person", _NAME), ("person", _OTHER)]),
    ("PER-04", _cat(_N, "chr(10)", _NAME, "chr(10)", "'---'"), [("person", _NAME)]),
    ("PER-05", _cat("' '", _NAME, "' '"), [("person", _NAME)]),
    ("PER-06", _cat("'联系人：管理员，编号'", _N), []),
    ("PHN-01", _cat("'编号138 '", "substr({0}, 1, 4)".format(_DIGITS), "' '", "substr({0}, 5, 4)".format(_DIGITS)), [("phone", _cat("'138 '", "substr({0}, 1, 4)".format(_DIGITS), "' '", "substr({0}, 5, 4)".format(_DIGITS)))]),
    ("PHN-02", _cat("'电话0871-'", _DIGITS, "'转'"), [("phone", _cat("'0871-'", _DIGITS))]),
    ("PHN-03", _cat("'热线400-'", "substr({0}, 1, 3)".format(_DIGITS), "'-'", "substr({0}, 5, 4)".format(_DIGITS)), [("phone", _cat("'400-'", "substr({0}, 1, 3)".format(_DIGITS), "'-'", "substr({0}, 5, 4)".format(_DIGITS)))]),
    ("IDC-01", _cat("'编号530102199'", _DIGITS, "'x。'"), [("id_card", _cat("'530102199'", _DIGITS, "'x'"))]),
    ("IDC-02", _cat("'代码91530000MA'", _DIGITS, "'。'"), [("id_card", _cat("'91530000MA'", _DIGITS))]),
    ("IDC-03", _cat("'护照：E'", _DIGITS), [("id_card", _cat("'E'", _DIGITS))]),
    ("EML-01", _cat("'邮箱：u.'", _N, "'@mail.example.com。'"), [("email", _cat("'u.'", _N, "'@mail.example.com'"))]),
    ("ADR-01", _cat("'收货地址：科技路'", _N, "'号附楼，三日内'"), [("address", _cat("'科技路'", _N, "'号附楼'"))]),
    ("ADR-02", _cat("'云南省昆明市五华区红锦路'", _N, "'号，三日内'"), [("address", _cat("'云南省昆明市五华区红锦路'", _N, "'号'"))]),
    ("ADR-03", _cat("'送货至昆明市五华区红锦路'", _N, "'号，三日内'"), [("address", _cat("'昆明市五华区红锦路'", _N, "'号'"))]),
    ("PRD-01", _cat("'品牌：文山雨露'", _N, "'，三日内'"), [("product", _cat("'文山雨露'", _N))]),
    ("PRD-02", _cat("'型号：YX-'", _N, "'/B，三日内'"), [("product", _cat("'YX-'", _N, "'/B'"))]),
    ("LOC-01", _cat("'到'", _PROVINCE, "'烟区考察'", _N), [("location", _PROVINCE)]),
    ("LOC-02", _cat("'来源地：'", _PROVINCE, "'、'", _PLACE, "'，'", _N), [("location", _PROVINCE), ("location", _PLACE)]),
    ("LOC-03", _cat("' '", _PROVINCE), [("location", _PROVINCE)]),
    # without its blank the word before belongs to the address, and the longer candidate wins
    ("VIEW-EML", _cat("'邮箱 u.'", _N, "'@mail.example.com。'"), [("email", _cat("'邮箱 u.'", _N, "'@mail.example.com'"))]),
    ("VIEW", _cat("'联 系 人：'", _SPACED, "'，编号'", _N), [("person", _SPACED)]),
]


def _turns(no: int) -> str:
    return f"k % {len(TEXTS)} = {no}"


def _texts(spark, sf):
    text = F.expr("CASE " + " ".join(f"WHEN {_turns(i)} THEN {t}" for i, (_, t, _) in enumerate(TEXTS)) + " END")
    rule = F.expr("CASE " + " ".join(f"WHEN {_turns(i)} THEN '{r}'" for i, (r, _, _) in enumerate(TEXTS)) + " END")
    return read(spark, sf, "customer").withColumn("k", F.col("c_custkey")).select("k", rule.alias("rule"), text.alias("text"))


_EXPECTED = " UNION ALL ".join(f"SELECT k, '{rule}' AS rule, {text} AS text, '{category}' AS category, {value} AS value FROM c WHERE {_turns(i)}" for i, (rule, text, found) in enumerate(TEXTS) for category, value in found)


@query(f"WITH c AS (SELECT c_custkey AS k FROM customer), e AS ({_EXPECTED}) SELECT k, rule, CAST(strpos(text, value) - 1 AS INTEGER) AS start, CAST(strpos(text, value) - 1 + length(value) AS INTEGER) AS stop, category, value FROM e")
def det_rules(spark, sf):
    """Each rule over texts that hold what it finds, over both views; of overlapping candidates the longest."""
    texts = _texts(spark, sf)
    found = spans.greedy(D.detect(texts, "k", "text"), "k")
    return found.join(texts.select("k", "rule"), "k").select("k", "rule", "start", F.col("end").alias("stop"), "category", "value")


@query(f"SELECT c_custkey, n AS value FROM (SELECT c_custkey, {_NAME} AS n FROM (SELECT c_custkey, c_custkey AS k FROM customer))")
def det_file_stems(spark, sf):
    """Names of people that stand in the names of files only."""
    stem = F.expr(f"CASE WHEN k % 3 = 0 THEN {_NAME} || '_' || {_N} WHEN k % 3 = 1 THEN '表彰' || {_NAME} || '同志先进事迹材料' ELSE {_N} || '-' || {_NAME} || '工作总结' END")
    c = read(spark, sf, "customer").withColumn("k", F.col("c_custkey")).select("c_custkey", stem.alias("stem"))
    return D.detect(c, "c_custkey", "stem", enabled=("person",), stems=True).select("c_custkey", "value").distinct()


#: (value, category, what becomes of it), by turns.
MODEL = [
    (_cat("' '", _NAME, "'， '"), "person", _NAME),
    ("'联系人'", "person", None),
    ("'管理员'", "person", None),
    (_cat(_PROVINCE, "'省'"), "location", _cat(_PROVINCE, "'省'")),
    (_cat(_PROVINCE, "'总部'"), "location", None),
    (_cat("'YX-'", _N), "product", _cat("'YX-'", _N)),
    ("'产品名称'", "product", None),
    (_cat("'宏达  '", _N, "'厂。'"), "organization", _cat("'宏达 '", _N, "'厂'")),
    ("'厂'", "organization", None),
    (_cat("'甲 '", _N, "'公 司'"), "organization", None),
    ("'路1号'", "address", None),
    (_cat("'红锦路'", _N, "'号'"), "address", _cat("'红锦路'", _N, "'号'")),
    (_N, "custom", None),
]
_MODEL_SQL = " UNION ALL ".join(f"SELECT k, {value} AS value, '{category}' AS category, {'NULL' if cleaned is None else cleaned} AS cleaned FROM c WHERE k % {len(MODEL)} = {i}" for i, (value, category, cleaned) in enumerate(MODEL))


@query(f"WITH c AS (SELECT c_custkey AS k FROM customer) {_MODEL_SQL}")
def model_values(spark, sf):
    """What a model found, cleaned or refused; people have rejected an organization of each number, written otherwise."""
    case = lambda at: F.expr("CASE " + " ".join(f"WHEN k % {len(MODEL)} = {i} THEN {m[at] if at == 0 else repr(m[at])}" for i, m in enumerate(MODEL)) + " END")
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    out = c.select(F.expr(f"'甲' || {_N} || '公司'").alias("text"), F.lit("organization").alias("category"))
    return D.plausible(c.select("k", case(0).alias("value"), case(1).alias("category")), "value", "category", out)


#: Full names, their short forms and their stems in a series, in order.
FORMS = [
    (_cat(_PROVINCE, "'宏达'", _N, "'烟叶复烤厂'"), [_cat(_PROVINCE, "'宏达'", _N, "'厂'"), _cat("'宏达'", _N, "'厂'"), _cat(_PROVINCE, "'宏达'", _N, "'烟叶厂'"), _cat("'宏达'", _N, "'烟叶厂'")], [_cat(_PROVINCE, "'宏达'", _N), _cat("'宏达'", _N)]),
    (_cat("'宏达'", _N, "'卷烟厂'"), [_cat("'宏达'", _N, "'厂'")], [_cat("'宏达'", _N)]),
    (_cat(_PROVINCE, "'烟叶复烤'", _N, "'有限责任公司'"), [_cat(_PROVINCE, "'烟叶复烤'", _N, "'公司'"), _cat("'烟叶复烤'", _N, "'公司'"), _cat(_PROVINCE, "'复烤'")], []),
    (_cat("'宏达'", _N, "'烟草专卖局'"), [_cat("'宏达'", _N, "'烟草局'")], []),
    (_cat("'宏达'", _N, "'银行'"), [], []),
]
_FORMS_SQL = " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, CAST({i} AS INTEGER) AS ordinal, {form} AS form FROM c WHERE k % {len(FORMS)} = {no}" for no, (_, short, stem) in enumerate(FORMS) for kind, forms in (("short", short), ("stem", stem)) for i, form in enumerate(forms))


@query(f"WITH c AS (SELECT c_custkey AS k FROM customer) {_FORMS_SQL}")
def alias_forms(spark, sf):
    """Short forms of organizations by their endings and provinces, and their stems in a series of factories."""
    full = F.expr("CASE " + " ".join(f"WHEN k % {len(FORMS)} = {i} THEN {f}" for i, (f, _, _) in enumerate(FORMS)) + " END")
    return D.name_forms(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).withColumn("full", full), "k", "full")


_LIMITS = {"person": 0.7, "organization": 0.55, "product": 0.6, "location": 0.6, "address": 0.6}
_MODEL_ROWS = """c AS (SELECT vec_id % 200 AS doc_id, 'v' || repeat('x', CAST(vec_id % 3 AS INTEGER)) || label AS value, list_extract(['person', 'product', 'organization', 'location'], CAST(vec_id % 4 + 1 AS INTEGER)) AS category, ((vec_id * 37) % 100) / 100.0 AS prob, vec_id AS ix,
CASE WHEN vec_id % 7 <> 0 THEN vec_id % 3 ELSE 0 END AS text_index, CASE WHEN vec_id % 11 <> 0 THEN vec_id * 13 % 5 ELSE -1 END AS start FROM embeddings),
g AS (SELECT *, CASE category WHEN 'organization' THEN 5 WHEN 'product' THEN 4 WHEN 'location' THEN 3 ELSE 1 END AS prio FROM c WHERE prob >= CASE category WHEN 'person' THEN 0.7 WHEN 'organization' THEN 0.55 ELSE 0.6 END),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY prio DESC, prob DESC, ix) AS n, min(ix) OVER (PARTITION BY doc_id, value) AS first FROM g)"""


def _model_rows(spark, sf):
    v = F.col("vec_id")
    value = F.expr("concat('v', repeat('x', cast(vec_id % 3 as int)), label)")
    category = F.element_at(F.array(*map(F.lit, ("person", "product", "organization", "location"))), (v % 4 + 1).cast("int"))
    return read(spark, sf, "embeddings").select((v % 200).alias("doc_id"), value.alias("value"), category.alias("category"), (v * 37 % 100 / 100.0).cast("double").alias("prob"), v.alias("ix"), F.when(v % 7 != 0, v % 3).alias("text_index"), F.when(v % 11 != 0, v * 13 % 5).alias("start"))


@query(f"WITH {_MODEL_ROWS} SELECT doc_id, value, category, ix, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY text_index, start, length(value) DESC, first) AS INTEGER) AS position FROM b WHERE n = 1")
def model_order(spark, sf):
    """The selected model candidates of a document, in the order in which they are registered."""
    return registry.ordered_candidates(_model_rows(spark, sf), _LIMITS, PRIORITY)[0].select("doc_id", "value", "category", "ix", "position")


@query(f"WITH {_MODEL_ROWS} SELECT doc_id, count(*) - (SELECT count(*) FROM b WHERE n = 1 AND b.doc_id = c.doc_id) AS rejected FROM c GROUP BY doc_id")
def model_rejected(spark, sf):
    """How many candidates of a document a review does not see."""
    return registry.ordered_candidates(_model_rows(spark, sf), _LIMITS, PRIORITY)[1]


#: Chunks are turns; a conversation's entities are three of the words of its first turn, a word of the file's name, and one that is nowhere.
_CONTEXT_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ix FROM conversations),
w AS (SELECT conv_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda x: x <> 'stem'))) AS w FROM c WHERE ix = 0),
e AS (SELECT conv_id, 'w' || i AS token, w[i] AS value FROM (SELECT conv_id, w, unnest(range(1, least(len(w), 3) + 1)) AS i FROM w) UNION ALL SELECT conv_id, 'n', 'zq' || conv_id FROM w UNION ALL SELECT conv_id, 'x', 'zqzq' || conv_id FROM w),
v AS (SELECT *, '(?i)' || array_to_string(string_split(value, ''), '\s*') AS re FROM e),
u AS (SELECT v.conv_id, token, ix, text, string_split_regex(text, re) AS g, regexp_extract_all(text, re) AS f FROM v JOIN c USING (conv_id)),
p AS (SELECT conv_id, token, ix, text, i, f[i] AS found, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS pos FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM u)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, token ORDER BY ix, i) AS n FROM p),
o AS (SELECT conv_id, token, string_agg(trim(regexp_replace(substr(text, greatest(pos - 70, 0) + 1, pos - greatest(pos - 70, 0)), '\s+', ' ', 'g')) || '[' || found || ']'
 || trim(regexp_replace(substr(text, pos + length(found) + 1, 70), '\s+', ' ', 'g')) || '@' || CASE WHEN conv_id % 2 = 0 THEN '第 ' || (ix + 1) || ' 页' ELSE '文本片段 ' || (ix + 1) END, '~' ORDER BY n) AS shown FROM r WHERE n <= 3 GROUP BY conv_id, token)
SELECT e.conv_id, e.token, CASE WHEN e.token = 'w1' AND e.conv_id % 3 = 0 THEN 'model' WHEN e.token IN ('w1', 'n') THEN 'label' ELSE 'rule' END AS source,
CASE WHEN e.token = 'w1' AND e.conv_id % 3 = 0 THEN CAST(0.75 AS DOUBLE) END AS probability, coalesce(o.shown, CASE WHEN e.token = 'n' THEN 'File  [ZQ' || e.conv_id || ']  stem@文件名' ELSE '' END) AS shown FROM e LEFT JOIN o USING (conv_id, token)"""


@query(_CONTEXT_SQL)
def review_contexts(spark, sf):
    """What people see of each entity of a conversation: its first three places, the file's name if there is none, and who knows it."""
    from pyspark.sql import Window

    c = read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    chunks = c.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ix"), "text")
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: x != "stem")))
    first = chunks.filter("ix = 0").select("doc_id", F.slice(words, 1, 3).alias("w"))
    number = F.col("doc_id").cast("string")
    own = F.concat(F.transform("w", lambda x, i: F.struct(F.concat(F.lit("w"), (i + 1).cast("string")).alias("token"), x.alias("value"))), F.array(F.struct(F.lit("n").alias("token"), F.concat(F.lit("z q"), number).alias("value")), F.struct(F.lit("x").alias("token"), F.concat(F.lit("zqzq"), number).alias("value"))))
    entities = first.select("doc_id", F.explode(own).alias("e")).select("doc_id", "e.value", F.when(F.col("e.token") == "w1", F.concat(F.lit("c"), number)).when(F.col("e.token") == "n", "named").otherwise("custom").alias("category"), "e.token")
    names = first.select("doc_id", F.concat(F.lit("File  ZQ"), number, F.lit("  stem")).alias("stem"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("txt").alias("file_type"))
    model = entities.filter("token = 'w1' and doc_id % 3 = 0").select("doc_id", "value", "category", F.lit(0.75).alias("probability"))
    labels = entities.filter("token in ('w1', 'n')").select("value", "category")
    out = D.review_contexts(entities, chunks, names, model, labels)
    shown = F.array_join(F.transform("occurrences", lambda x: F.concat(x["prefix"], F.lit("["), x["match"], F.lit("]"), x["suffix"], F.lit("@"), x["location"])), "~")
    return out.select(F.col("doc_id").alias("conv_id"), "token", "source", "probability", shown.alias("shown"))
