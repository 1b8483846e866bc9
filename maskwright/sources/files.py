"""Documents in files: plain text, DOCX and OFD, read and written back; archive directories."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: containers of a paragraph's text and their text nodes, by local name
DOCX = {"p": "t"}
OFD = {"TextObject": "TextCode"}
CHUNK = "path string, kind string, part string, chunk_ix int, text string"
SUPPORTED = (".txt", ".docx", ".ofd")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8, with or without a mark, then the detector's guess, then replacement."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data.decode("utf-8-sig", "replace"), "utf-8-sig"
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        try:
            from charset_normalizer import from_bytes

            best = from_bytes(data).best()
        except ImportError:
            best = None
        return (str(best), best.encoding) if best else (data.decode("utf-8", "replace"), "utf-8")


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _groups(root, kind: str) -> Iterator[list]:
    """The text nodes of each container, in document order; for OFD then the other nodes with text, singly."""
    pairs = DOCX if kind == "docx" else OFD
    seen = set()
    for box in root.iter():
        leaf = pairs.get(_local(box))
        if leaf:
            nodes = [n for n in box.iter() if _local(n) == leaf and id(n) not in seen]
            seen.update(map(id, nodes))
            if nodes:
                yield nodes
    if kind == "ofd":
        for n in root.iter():
            if id(n) not in seen and n.text and n.text.strip():
                yield [n]


def _spread(nodes: list, new: str) -> None:
    """Put a changed text into a container: nodes outside the changed stretch keep theirs, the first inside takes the rest."""
    old = [n.text or "" for n in nodes]
    whole = "".join(old)
    head = next((i for i, (a, b) in enumerate(zip(whole, new)) if a != b), min(len(whole), len(new)))
    tail = next((i for i, (a, b) in enumerate(zip(whole[head:][::-1], new[head:][::-1])) if a != b), min(len(whole), len(new)) - head)
    fill, at, placed = new[head : len(new) - tail], 0, False
    for n, text in zip(nodes, old):
        lo, hi = max(head - at, 0), max(min(len(whole) - tail - at, len(text)), 0)
        inside = lo <= len(text) and at + len(text) >= head and not placed
        n.text = (text[:lo] + fill + text[max(hi, lo) :]) if inside else (text if lo >= len(text) else text[:lo] + text[max(hi, lo) :])
        placed |= inside
        at += len(text)


def rewrite(data: bytes, kind: str, change: Callable[[str], str]) -> bytes:
    """A document with each of its texts changed."""
    if kind == "txt":
        text, encoding = decode(data)
        new = change(text)
        try:
            return new.encode(encoding)
        except (UnicodeEncodeError, LookupError):
            # tokens that the old encoding has no characters for
            return new.encode("utf-8-sig")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for item in source.infolist():
            body = source.read(item)
            if item.filename.endswith(".xml"):
                try:
                    root = ET.fromstring(body)
                except ET.ParseError:
                    root = None
                changed = False
                for nodes in _groups(root, kind) if root is not None else ():
                    old = "".join(n.text or "" for n in nodes)
                    new = change(old) if old else old
                    if new != old:
                        _spread(nodes, new)
                        changed = True
                if changed:
                    body = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            target.writestr(item, body)
    return out.getvalue()


def texts(data: bytes, kind: str) -> list[tuple[str, str]]:
    """(part, text) of a document's containers."""
    if kind == "txt":
        return [("", decode(data)[0])]
    found = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.endswith(".xml"):
                try:
                    root = ET.fromstring(z.read(name))
                except ET.ParseError:
                    continue
                found += [(name, "".join(n.text or "" for n in nodes)) for nodes in _groups(root, kind)]
    return found


def chunks(files: DataFrame) -> DataFrame:
    """(path, kind, part, chunk_ix, text) of binary files; other kinds of file raise an error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                kind = path.rpartition(".")[2].lower()
                if f".{kind}" not in SUPPORTED:
                    raise ValueError(f"unsupported kind of file: {kind}")
                rows += [(path, kind, part, i, t) for i, (part, t) in enumerate(texts(bytes(data), kind)) if t.strip()]
            yield pd.DataFrame(rows, columns=["path", "kind", "part", "chunk_ix", "text"])

    return files.select("path", "content").mapInPandas(run, CHUNK)


def archive_entries(files: DataFrame) -> DataFrame:
    """(archive, entry, size, csize) of zip files, for operators.registry.archive_guard."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    rows += [(path, i.filename, i.file_size, i.compress_size) for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["archive", "entry", "size", "csize"])

    return files.select("path", "content").mapInPandas(run, "archive string, entry string, size long, csize long")


def content_ok(kind, head) -> F.Column:
    """Whether the first bytes of an upload are those of its kind. ``head``: binary."""
    text = F.hex(head)
    return F.when(kind == "pdf", F.ltrim(head.cast("string")).startswith("%PDF-")).when(kind == "xls", text.startswith("D0CF11E0A1B11AE1")).when(kind == "txt", ~F.substring(text, 1, 2048).rlike("^(?:..)*?00")).otherwise(text.startswith("504B0304"))


def needs_ocr(text) -> F.Column:
    """Pages of fewer than 12 visible characters go to recognition."""
    return F.length(F.regexp_replace(text, r"(?U)\s", "")) < 12


def collected(rows: DataFrame, doc: str, order: str, text: str, most: int = 500_000) -> DataFrame:
    """Stripped, non-blank chunks with the running length per document and whether it is within the limit."""
    from pyspark.sql import Window

    kept = rows.withColumn(text, F.btrim(F.col(text), F.lit(" \t\r\n\x0b\x0c"))).filter(F.col(text) != "")
    total = F.sum(F.length(text)).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("running", total.cast("long")).withColumn("within", F.col("running") <= most)


def page_of(location) -> F.Column:
    return F.regexp_extract(location, r"^第 (\d+) 页$", 1).try_cast("int")


def cached_pages(sections: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, pages): the texts of a document's pages in order, null unless their numbers are 1, 2, … without a gap.

    ``sections``: doc, ``order``, location, text; a location like ``第 3 页`` names a page, the last section of a page counts,
    other locations are passed over. A document without pages has null; a null text is an empty one.
    """
    page = F.regexp_extract(F.btrim("location"), r"(?U)^第\s*(\d+)\s*页$", 1).try_cast("long")
    last = sections.select(doc, order, page.alias("page"), "text").groupBy(doc, "page").agg(F.max_by(F.coalesce("text", F.lit("")), order).alias("text"))
    # numbers are distinct now: none is missing if as many as the largest, the smallest being 1
    whole = last.groupBy(doc).agg(F.count("page").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"), F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "text")))).alias("held"))
    texts = F.transform("held", lambda x: x["text"])
    return whole.select(doc, F.when((F.col("low") == 1) & (F.col("high") == F.col("n")), texts).alias("pages"))
