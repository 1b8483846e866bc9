"""Merkle manifest, alignment of tokenizers and WARC archives against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import gzip
import hashlib
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import alignment, merkle, warc
from maskwright.llm.queries import ALIGNED

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("grp", "ix", "h", "kids", "proof", "depth", "part", "key", "side", "digest", "line")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves, fanout):
    """(root, proof of each leaf as (before, after) by level)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for p, i in zip(proofs, at):
            run = level[i // fanout * fanout :][:fanout]
            p.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], proofs


def plain_manifest(rows, fanout):
    leaf = lambda r, more=0: sha(*map(field, (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1])))
    langs, out, subs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())), [], []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, proofs = tree([leaf(r) for r in own], fanout)
        subs.append(sub)
        out += [(r, len(subs) - 1, p) for r, p in zip(own, proofs)]
    root, above = tree(subs, fanout)
    found = []
    for r, s, p in out:
        path = p + above[s]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        at = leaf(r, 1 if hit else 0)
        for before, after in path:
            at = sha(before, at, after)
        found.append((r[0], leaf(r), subs[s], root, sha(*(b + a for b, a in path)), at, at == root))
    return found


ROWS = [(i, f"text {i} é😀 " * (i % 5), ["en", "fr", None, "", "é"][i % 5 if i < 40 else 0], f"s{i % 3}" if i % 4 else None, i if i % 6 else None) for i in range(75)]
ROWS += [(3, "other text of three", "en", "s", 1), (3, None, "en", "s", 1), *[(9, "same", "en", "s", 1)] * 4, (None, "no id", "en", None, 2), (500, "x" * 300_000, "zz", "s", 3)]


def test_merkle_manifest(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES}).repartition(4)
    got = merkle.verified_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_manifest(ROWS, 2))
    assert any(not r[6] for r in plain_manifest(ROWS, 2))


def test_merkle_fanouts_and_sizes(spark):
    for n, fanout in ((1, 2), (10, 3), (25, 5)):
        rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
        got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", fanout)
        got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).select("doc_id", merkle.text_of(F.col("root")), merkle.proof_digest(F.col("proof")), "folded").collect()
        assert sorted(map(tuple, got)) == sorted((r[0], r[3], r[4], r[3]) for r in plain_manifest(rows, fanout))
    assert merkle.verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


TEXTS = [None, "", " ", "a", "Hello world", "  two  blanks \n\n and lines\t", "<|endoftext|> <s> </s>", "a ▁ literal mark", "naïve café — “quotes” 😀😀 日本語 текст", "x" * 3000, "ab " * 4000, "é" * 500, "  wide", "1234567890 12/34", "don't we'll I'm", "\x00\x85\x1c control", "a" * 5000 + " " * 5000 + "b", *[f"copy of a text about the number {i % 3} and more" for i in range(20)]]


def plain_alignment(rows):
    a_model, b_model = Tokenizer.from_file(ALIGNED[0]), sentencepiece.SentencePieceProcessor(model_file=ALIGNED[1])
    a_model.encode_special_tokens = True
    bytes_a = alignment.bytes_of_a(ALIGNED[0])
    piece = lambda i: bytes([int(p[3:5], 16)]) if (p := b_model.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode()
    per, count = [], Counter()
    for doc, text in rows:
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw, wa, wb = f" {text}".encode(), [bytes_a[i] for i in a], [piece(i) for i in b]
        if not text or b"".join(wa) != raw or b"".join(wb) != raw:
            per.append((doc, [], [], []))
            continue
        at_a = [i for i, w in enumerate(wa) for _ in w]
        at_b = [i for i, w in enumerate(wb) for _ in w]
        met = list(dict.fromkeys(zip(at_a, at_b)))
        ends = {sum(map(len, wa[: i + 1])) for i in range(len(a))} & {sum(map(len, wb[: i + 1])) for i in range(len(b))} if len(raw) < 6000 else None
        groups, ga, gb, pa, pb, x, y = [], [], [], 0, 0, 0, 0
        for end in sorted(ends) if ends is not None else []:
            while x < len(a) and pa + len(wa[x]) <= end:
                ga.append(a[x])
                pa, x = pa + len(wa[x]), x + 1
            while y < len(b) and pb + len(wb[y]) <= end:
                gb.append(b[y])
                pb, y = pb + len(wb[y]), y + 1
            groups.append((ga, gb))
            ga, gb = [], []
        links = [(a[i], b[j]) for i, j in met]
        count.update(links)
        per.append((doc, a, b, links, groups if ends is not None else None))
    most = Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    out = []
    for doc, a, b, links, *groups in per:
        text = None if groups and groups[0] is None else ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups[0]) if groups else ""
        out.append((doc, len(a), len(b), len(groups[0]) if groups and groups[0] is not None else None if groups else 0, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), None if text is None else sha(text) if text else ""))
    return out


@pytest.mark.parametrize("files, sizes", [(ALIGNED, {}), (ALIGNED, {"waves": 2, "row": 5, "part_tokens": 50, "step_rows": 3}), (ALIGNED[:2], {"waves": 1})])
def test_alignment(spark, files, sizes):
    rows = [*enumerate(TEXTS), (None, "no id at all"), (4, "Hello world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)
    order = lambda r: tuple(str(x) for x in r)
    got, want = (sorted(map(tuple, x), key=order) for x in (alignment.alignment(docs, files, **sizes).collect(), plain_alignment(rows)))
    for g, w in zip(got, want, strict=True):
        # groups of texts too long for the plain way: their numbers follow from the links
        assert g == w or (w[7] is None and g[:3] == w[:3] and g[4:7] == w[4:7] and g[3] == g[1] + g[2] - g[4]), (g, w)
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), files, **sizes).collect() == []


def test_aligned_groups(spark):
    text = "naïve café — 😀 and so on"
    got = sorted((r.end, r.a, r.b) for r in alignment.aligned_groups(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), ALIGNED).collect())
    bytes_a = alignment.bytes_of_a(ALIGNED[0])
    at = 0
    for end, a, b in got:
        at += len(b"".join(bytes_a[i] for i in a))
        assert at == end and b
    assert at == len(f" {text}".encode())


@pytest.mark.parametrize("path", ["latin", "documents"])
def test_ranks_give_the_ids_of_the_model(spark, path):
    """The faster form of A's vocabulary and B's words apart, on texts of every kind that takes them."""
    encoder = alignment.Encoder(*ALIGNED)
    if path == "latin":
        texts = ["".join(map(chr, [*range(0x20, 0x7F), *range(0xA0, 0x220)])) * 3, "¼ ½ ²3 ª º ß", "it's 'S 's\n\n \t x", *[t for t in TEXTS if t]]
    else:
        texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    for t in texts:
        plain = bool(alignment._PLAIN.fullmatch(t))
        assert encoder.encode_a(f" {t}", plain).tolist() == encoder.a.encode(f" {t}", add_special_tokens=False).ids
        assert encoder.encode_b(f" {t}", plain).tolist() == encoder.b.encode(t)


PAGES = [(i, f"https://www{i % 3}.Example.org:8080/a/{i % 7}?q={i}", f"<p>{i % 9}</p>" * (12 if i % 2 else 3)) for i in range(60)]
PAGES += [(100, None, "y" * 99), (101, "", "y" * 99), (102, "no url at all", None), (103, "http://x.org/a b\r\nc\x00", "é" * 50), (104, "http://x.org/", "é" * 50), (105, "http://x.org/\r\n\r\n", "WARC/1.1\r\n\r\n" * 40), (None, "http://n.org/", "é" * 50), (None, None, "z" * 200), (None, "u", "z" * 200), *[(7, "http://twice.org/", "same " * 50)] * 3, (8, "http://twice.org/", "same " * 50), (200, "http://long.org/" + "p" * 5000, "l" * 400_000)]


def plain_records(rows):
    first = {}
    for page, _, html in rows:
        if html and len(html.encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html)
        again = to is not None and to != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return out


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in (*CLASHES, "uri", "payload", "first")}).repartition(3)


def test_warc_roundtrip(spark):
    got = warc.roundtrip(pages_of(spark, PAGES))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_records(PAGES))
    assert warc.roundtrip(pages_of(spark, PAGES[:0])).collect() == []


def test_warc_files_and_lookup(spark, tmp_path, monkeypatch):
    archives = warc.write_archives(pages_of(spark, PAGES), f"file://{tmp_path}")
    records = 0
    for f in tmp_path.glob("*.warc.gz"):
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
        records += sum(1 for _ in warc.parse_records(f.read_bytes()))
    assert records == len(PAGES)
    rows = archives.directory.orderBy("range", "first").collect()
    assert sum(r.n for r in rows) == len(PAGES) and all(r.first <= r.last for r in rows)
    # sites lie together, in the order of reversed hosts
    assert [r.first for r in rows] == sorted(r.first for r in rows)
    every = warc.read_all(archives).filter("type = 'response'").select("uri", "page_id", F.col("payload_digest").alias("digest")).distinct()
    found = warc.lookup(archives, every.union(spark.createDataFrame([("http://nowhere.org/", 1, "0" * 64), ("a", 1, "0"), ("~~", 1, "0")], every.schema)))
    got = Counter((r.uri, r.page_id, r.payload_digest) for r in found.collect())
    assert got == Counter({tuple(r): 1 for r in every.collect()})
    assert warc.sort_key  # keys of the reader and the writer are one function
    key = spark.createDataFrame([("https://u@WWW.a.org:80/x?y",), ("urn:page:1",)], "u string").select(warc.sort_key(F.col("u"))).collect()
    assert [r[0] for r in key] == ["org,a,www)/x?y", "urn:page:1"]
