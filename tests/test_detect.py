"""Rules, name forms and review contexts over DataFrames: edges that the queries don't meet."""

from maskwright import constants as C
from maskwright.functions import rules
from maskwright.operators import detect as D
from maskwright.operators import registry, spans, stats


def test_detect_reads_every_row(spark):
    text = "单位：中国烟草总公司\n联系人：张三\n电话：13800138000"
    rows = [(1, text, "a"), (1, text, "b"), (2, None, None), (3, "", ""), (4, "无" * 200_000, "x"), (None, "联系人：李四，", "x")]
    df = spark.createDataFrame(rows, "k long, text string, category string")
    got = D.detect(df, "k", "text").collect()
    want = [(1, f.start, f.end, C.CATEGORIES.index(f.category), f.category, f.value) for f in rules.candidates(text)] * 2
    assert sorted(map(tuple, (r for r in got if r["k"] == 1))) == sorted(want)
    assert {(r["k"], r["value"]) for r in got if r["k"] != 1} == {(None, "李四")}
    assert D.detect(df.limit(0), "k", "text").count() == 0


def test_detected_spans_choose_as_the_rules_do(spark):
    text = "云南中烟工业有限责任公司与红云红河烟草（集团）有限责任公司签订采购合同，项目负责人王建国，李娜负责复核，送货至云南省昆明市五华区红锦路123号，联系电话0871-63568888。"
    got = spans.greedy(D.detect(spark.createDataFrame([(7, text)], "k long, text string"), "k", "text"), "k").collect()
    assert sorted((r["start"], r["end"], r["category"], r["value"]) for r in got) == [tuple(f) for f in rules.select(rules.candidates(text), len(text))]


def test_plausible_with_rejected_values(spark):
    rows = [(1, " 张三 ", "person"), (2, "张 三", "person"), (3, None, "person"), (4, "Ａ Ｂ公司", "organization"), (5, "ab公司", "organization"), (6, "ab公司", "address"), (6, "ab公司", None)]
    df = spark.createDataFrame(rows, "k long, value string, category string")
    out = spark.createDataFrame([("AB公司", "organization"), ("ab 公司", "organization"), (None, "person")], "text string, category string")
    got = {(r["k"], r["category"]): r["cleaned"] for r in D.plausible(df, "value", "category", out).collect()}
    assert got == {(1, "person"): "张三", (2, "person"): "张三", (3, "person"): None, (4, "organization"): None, (5, "organization"): None, (6, "address"): "ab公司", (6, None): None}
    assert D.plausible(df, "value", "category").filter("k = 5").first()["cleaned"] == "ab公司"


def test_name_forms_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "厂"), (4, "陆良卷烟厂")], "k long, name string")
    got = [tuple(r) for r in D.name_forms(df, "k", "name").collect()]
    assert sorted(got) == [(4, "short", 0, "陆良厂"), (4, "stem", 0, "陆良")]


def test_review_contexts(spark):
    entities = spark.createDataFrame([("d", "aa", "person", "T1"), ("d", "Ｂ b", "product", "T2"), ("d", "gone", "custom", "T3"), ("d", "in name", "custom", "T4"), ("e", "aa", "person", "T1"), ("f", None, "person", "T1")], "doc_id string, value string, category string, token string")
    chunks = spark.createDataFrame([("d", 1, "x\n\ta aaA y"), ("d", 0, "aaa" + "z" * 80 + " bb"), ("d", 2, "aa aa"), ("d", 3, None), ("e", 0, ""), ("g", 0, "aa")], "doc_id string, ix long, text string")
    names = spark.createDataFrame([("d", "My  In-name inname", "pdf"), ("e", None, "txt")], "doc_id string, stem string, file_type string")
    model = spark.createDataFrame([("d", "aa", "person", 0.5), ("d", "aa", "person", 0.7)], "doc_id string, value string, category string, probability double")
    labels = spark.createDataFrame([("Ｂ b", "product"), ("aa", "person")], "value string, category string")
    got = {(r["doc_id"], r["token"]): (r["source"], r["probability"], [tuple(o) for o in r["occurrences"]]) for r in D.review_contexts(entities, chunks, names, model, labels).collect()}
    z = "z" * 80
    assert got[("d", "T1")] == ("model", 0.7, [("", "aa", "a" + z[:69], "第 1 页"), ("x", "a a", "aA y", "第 2 页"), ("x a a", "aA", "y", "第 2 页")])
    assert got[("d", "T2")] == ("label", None, [(z[:69], "bb", "", "第 1 页")])
    assert got[("d", "T3")] == ("rule", None, [])
    assert got[("d", "T4")] == ("rule", None, [("My  In-name ", "inname", "", "文件名")])
    assert got[("e", "T1")] == ("label", None, []) and got[("f", "T1")] == ("rule", None, [])


def test_order_and_rejection_of_model_candidates(spark):
    rows = [(1, "late", "person", 0.9, 0, 2, 5), (1, "bb", "person", 0.9, 1, None, None), (1, "aaa", "person", 0.9, 2, 0, -1), (1, "cc", "person", 0.6, 3, 0, -1), (1, "cc", "person", 0.9, 4, 0, -1), (1, "bb", "product", 0.6, 5, None, None)]
    rows += [(1, None, "person", 0.9, 6, 0, 0), (1, "", "person", 0.9, 7, 0, 0), (2, "x", "person", None, 0, 0, 0), (2, "x", "other", 0.9, 1, 0, 0), (None, "x", "person", 0.8, 0, 0, 0), (None, "x", "person", 0.8, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, value string, category string, prob double, ix long, text_index long, start long")
    chosen, rejected = registry.ordered_candidates(df, {"person": 0.7, "product": 0.6}, {"product": 4, "person": 1})
    assert sorted((r["doc_id"] or 0, r["position"], r["value"], r["category"]) for r in chosen.collect()) == [(0, 1, "x", "person"), (1, 1, "aaa", "person"), (1, 2, "bb", "product"), (1, 3, "cc", "person"), (1, 4, "late", "person")]
    assert {(r["doc_id"], r["rejected"]) for r in rejected.collect()} == {(1, 4), (2, 2), (None, 1)}


def test_scalar_counts_of_nulls_and_empty_tables(spark):
    maps = spark.createDataFrame([({"a": 2, "b": None},), (None,), ({},), ({"a": 3},)], "counts map<string,int>")
    labels = spark.createDataFrame([(True,), (None,), (False,), (True,)], "active boolean")
    assert stats.scalar_counts(maps, maps, labels, maps.limit(0)).collect() == [(5, 4, 2, 0)]
    assert stats.scalar_counts(maps.limit(0), maps.limit(0), labels.limit(0), maps.limit(0)).collect() == [(0, 0, 0, 0)]


ODD_EMAILS = [
    *("a@b.com c@d.com", "a@b.com,c@d.com;e@f.gg h@i.jj", "a@b.co+c@d.ee", "a@b.co c+x@d.ee", "a@b.c@d.e@f.g", "a@b.co😀c@d.ee", "a@b.c-+d@e.f", "a@b.com.", "a@b.c-d.", "a@b..c d@e.f", "-@-.-"),
    *("cafe\u0301@b.com", "a@b.com\u0301 z@y.xx", "a\u200db@c.de", "a\u203fb@c.dd", "x²@b.com", "Ⓐ@b.com", "ⅷ@b.½", "用户@例子.中国，下一个@例子.中国", "a@b.com\n", "\na@b.com\r\nc@d.com\u2028", "@", "", None),
    "x 𝒳a@b.com  y@z.ww " + "a@b" + ".c" * 50_000,
]


def test_emails_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from maskwright.plans import catalogue as Q

    for name, table, key, text in (("det_email_documents", "documents", "doc_id", "text"), ("det_email_pages", "pages", "page_id", "html")):
        df = spark.createDataFrame(list(enumerate(ODD_EMAILS)), f"{key} long, {text} string")
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = duck.execute(Q.ORACLE[name]).fetchall()
        assert len(want) > 20
        assert sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
        for r in Q.emails(df, key, text).collect():
            assert ODD_EMAILS[r[key]][r["start"] : r["end"]] == r["value"]


NEW_EMAILS = [
    *("aͅ@b.com", "x@b.cͅd", "ͅa@b.cc", "x@b.cͅ", "ࡰa@b.com", "x@ꟓ.com", "x ḩ0@b.cc", "x@b.c\U0001e4f0", "\U00031350@b.cc", "x@b.c\U000323af y@z.ww"),
    *("a@b.c-.-d-e..f", "a@b.c.-", "a@b.-..", "-a@b.c-+d+@e.ff", "+@b.cc", "a@b.c++@d.ee", "x+y+a@b", "a@b.c d.e+f@g.hh", "a@-.--..-"),
    *("a@b." + "a\U0001d4b3" * 20_000, "a@b." + "c-\U0001d4b3.-" * 5_000 + "..", "+-" * 100_000),
]


def test_emails_of_any_letters_and_length_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from maskwright.plans import catalogue as Q

    for name, table, columns in (("det_email_pages", "pages", "page_id long, html string"), ("det_email_documents", "documents", "doc_id long, text string")):
        spark.createDataFrame(list(enumerate(NEW_EMAILS)), columns).write.parquet(f"{tmp_path}/{table}.parquet")
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = duck.execute(Q.ORACLE[name]).fetchall()
        assert len(want) > 15
        assert sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
