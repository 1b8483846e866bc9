import io
import zipfile

from hypothesis import given
from hypothesis import strategies as st

from maskwright import constants as C
from maskwright.functions import rules
from maskwright.functions.mapping import Mapping, restore
from maskwright.operators.documents import deidentify, restore_chunks
from maskwright.sources import files


def docx(*runs):
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p)}</w:p>" for p in runs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/a.bin", b"\0\1")
    return out.getvalue()


def test_docx_runs_and_other_parts_survive():
    data = docx(["单位：中国", "烟草总", "公司"], ["plain"])
    new = files.rewrite(data, "docx", lambda t: t.replace("中国烟草总公司", "【单001】"))
    assert [t for _, t in files.texts(new, "docx")] == ["单位：【单001】", "plain"]
    assert zipfile.ZipFile(io.BytesIO(new)).read("word/media/a.bin") == b"\0\1"
    assert [t for _, t in files.texts(files.rewrite(new, "docx", lambda t: t.replace("【单001】", "中国烟草总公司")), "docx")] == ["单位：中国烟草总公司", "plain"]


def test_ofd_nodes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", "<P><TextObject><TextCode>张</TextCode><TextCode>三</TextCode></TextObject><x>单独</x></P>")
        z.writestr("bad.xml", "<P>")
    assert [t for _, t in files.texts(out.getvalue(), "ofd")] == ["张三", "单独"]
    assert "【人001】" in [t for _, t in files.texts(files.rewrite(out.getvalue(), "ofd", lambda t: t.replace("张三", "【人001】")), "ofd")]


@given(st.lists(st.text(max_size=6), min_size=1, max_size=5), st.text(max_size=12))
def test_spread_puts_the_new_text(parts, new):
    class Node:
        def __init__(self, t):
            self.text = t

    nodes = [Node(p) for p in parts]
    if "".join(parts):
        files._spread(nodes, new)
        assert "".join(n.text for n in nodes) == new


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("单位：中国烟草总公司".encode("gb18030") * 20)
    (tmp_path / "b.docx").write_bytes(docx(["x"], ["y z"]))
    got = files.chunks(files.read_binary(spark, str(tmp_path)))
    assert {(r["kind"], r["text"]) for r in got.collect() if r["kind"] == "docx"} == {("docx", "x"), ("docx", "y z")}
    assert files.archive_entries(files.read_binary(spark, f"{tmp_path}/b.docx")).count() == 2


def test_documents_round_trip(spark):
    rows = [("a", 0, "单位：中国烟草总公司\n联系人：张三"), ("a", 1, "张三电话：13800138000"), ("b", 0, ""), ("c", 0, None), ("d", 0, "无")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_ix int, text string")
    out = {(r["doc_id"], r["chunk_ix"]): r for r in restore_chunks(deidentify(chunks, labels=[("内部密语", "custom")])).collect()}
    assert all(out[d, i]["restored"] == (t or "") for d, i, t in rows)
    assert "张三" not in out["a", 0]["masked"] + out["a", 1]["masked"] and out["a", 0]["counts"] == {"单位": 1, "人名": 1, "电话": 1}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.integers(0, 8)), max_size=12))
def test_selection_is_greedy_and_disjoint(raw):
    found = [rules.Found(s, s + n, C.CATEGORIES[c], "x") for s, n, c in raw]
    kept = rules.select(found, 40)
    assert all(a.end <= b.start for a, b in zip(kept, kept[1:]))
    assert all(any(f.start < k.end and k.start < f.end and (k.start - k.end) <= (f.start - f.end) for k in kept) for f in found)


@given(st.text(alphabet="单位：公司张三李四、 \n13800138000a@b.c复烤厂陆良", max_size=60))
def test_masking_twice_changes_nothing_more(text):
    m = Mapping()
    m.discover(text)
    once = m.mask(text)
    assert restore(once, m.export()).split() is not None
    again = Mapping(custom=())
    again.discover(once)
    assert not any("【" in e for e in again.entries)


def test_stream(spark, tmp_path):
    from maskwright.streaming.mask import mask_stream

    spark.createDataFrame([("a", 0, "联系人：张三"), ("a", 1, "联系人：李四")], "doc_id string, chunk_ix int, text string").coalesce(1).write.json(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2, "负责人：张三")], "doc_id string, chunk_ix int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id string, chunk_ix int, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = mask_stream(source).writeStream.format("memory").queryName("masked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["chunk_ix"]: r["masked"] for r in spark.table("masked").collect()}
    assert len(got) == 3 and got[0][4:] == got[2][4:] and got[1] != got[0]
