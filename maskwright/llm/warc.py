"""WARC archives of pages and a two-level index of their captures.

A record's key is its URL with the labels of the host reversed, so that a site's pages lie together. The rows are
sorted by key in ranges; each range is written as archives of one gzip member a record, in the order of the keys, and as
an index: the sorted lines of up to BLOCK captures make a compressed block, whose place is in a sparse directory, a row
a block. A lookup finds the range by its bounds, then the block by binary search in the range's part of the directory,
reads that block's bytes, finds the line by binary search, and reads the record's bytes.

Of pages with equal payloads one is a response and the others revisit it. Files have names that no other attempt uses,
and only those that the directory names are read: what a lost task left behind is not seen.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut, join_hot, shared_dir

#: Captures of one index block, and bytes of the archive that it covers, at most (one record may be more).
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Bytes after which a task begins a further archive.
ARCHIVE_BYTES = 1 << 30
#: Payloads of fewer bytes are written each time.
LEAST_BYTES = 100

_DIRECTORY = "range int, first string, last string, n int, archive string, start long, bytes long, index string, at long, length long"
_RECORD = "page_id long, uri string, type string, payload_bytes long, payload_digest string, refers_uri string, refers_to long, refers_digest string"


@dataclass(frozen=True)
class Archives:
    """A folder of archives, and the directory of their index blocks as a DataFrame."""

    folder: str
    directory: DataFrame


def target_uri(url: Column, page_id: Column) -> Column:
    """A URL on one line without blanks: a name from the page_id where there is none."""
    own = F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))
    # control characters and blanks would end a header line
    plain = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    return F.coalesce(F.nullif(plain, F.lit("")), own)


def sort_key(uri: Column) -> Column:
    """The URI with its host's labels reversed: ``org,example,www)/path``; others stay."""
    form = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)(?::[0-9]*)?(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(uri, form, 1)), r"\.")), ",")
    return F.when(uri.rlike(form), F.concat(host, F.lit(")"), F.regexp_extract(uri, form, 2))).otherwise(uri)


def _line_column() -> Column:
    """What captures are sorted and looked up by; the separator is below all characters of a key, so sites and URLs stay together."""
    return F.concat_ws("\x1f", "key", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest")


def _record(page_id, uri: str, payload: bytes, digest: str, refers: tuple | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    name = uuid.UUID(hashlib.sha256(f"{page_id} {uri} {digest}".encode("utf-8", "surrogatepass")).hexdigest()[:32])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {refers[0]}", f"X-Refers-To-Page-Id: {refers[1]}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_records(data: bytes):
    """(headers, block) of each gzip member."""
    while data:
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(data)
        data = unpack.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _row(fields: dict, block: bytes) -> tuple:
    payload = block.partition(b"\r\n\r\n")[2]
    page = fields.get("X-Page-Id")
    stated = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response":
        return (page and int(page), fields["WARC-Target-URI"], "response", len(payload), hashlib.sha256(payload).hexdigest(), None, None, None)
    return (page and int(page), fields["WARC-Target-URI"], "revisit", None, None, fields["WARC-Refers-To-Target-URI"], int(fields["X-Refers-To-Page-Id"]), stated)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _write(folder: str):
    """Sorted rows (line, page_id, uri, payload, digest, refers_uri, refers_to) to archives and index blocks; their directory."""

    def run(batches):
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        part, files = TaskContext.get().partitionId(), []
        archive = index = None
        at = block_at = index_at = 0
        lines, out = [], []

        def close_block():
            nonlocal index_at, block_at, lines
            if lines:
                packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
                index[1].write(packed)
                ends = [x.rsplit("\x1f", 2)[0] for x in (lines[0], lines[-1])]
                out.append((part, *ends, len(lines), archive[0], block_at, at - block_at, index[0], index_at, len(packed)))
                index_at += len(packed)
                block_at, lines = at, []

        def opened(kind):
            name = f"{root}/{part:06d}-{uuid.uuid4().hex}.{kind}"
            files.append(where.open_output_stream(name, compression=None))
            return name.rpartition("/")[2], files[-1]

        for batch in batches:
            for line, page_id, uri, payload, digest, refers_uri, refers_to in zip(*batch.columns):
                if archive is None or at > ARCHIVE_BYTES:
                    close_block()
                    archive, at, block_at = opened("warc.gz"), 0, 0
                index = index or opened("index")
                record = _record(page_id.as_py(), uri.as_py(), payload.as_py(), digest.as_py(), (refers_uri.as_py(), refers_to.as_py()) if refers_uri.is_valid else None)
                archive[1].write(record)
                lines.append(f"{line.as_py()}\x1f{at}\x1f{len(record)}")
                at += len(record)
                if len(lines) == BLOCK or at - block_at >= BLOCK_BYTES:
                    close_block()
        close_block()
        for f in files:
            f.close()
        # only now: a file that isn't whole is in no directory
        yield _batch(out, _DIRECTORY)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> Archives:
    """``pages`` (page_id long, url string, html string) as WARC records in ``folder``, a URI that all executors share.

    The payload is html as it is, null being empty. Of rows with equal payloads of ``least_bytes`` or more, those with the
    smallest page_id (null last) are responses, the others revisits. Repeated rows are records of their own. A
    page without a URL gets a name from its page_id. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    plain = plain.select("page_id", target_uri(F.col("url"), F.col("page_id")).alias("uri"), "payload", F.sha2("payload", 256).alias("digest"))
    small = cut(plain.select("page_id", "uri", "digest", F.octet_length("payload").alias("n")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uri"))
    equal = small.filter(F.col("n") >= least_bytes).groupBy("digest").agg(first.alias("first"), F.count("*").alias("rows")).filter("rows > 1 and not first.none")
    equal = cut(equal.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri"), "rows"))
    # groups of copies of over one in 1000 rows are met by broadcast
    hot = F.broadcast(equal.filter(F.col("rows") * 1000 > F.lit(small.count())).drop("rows"))
    few = plain.join(hot, "digest", "left").filter("first_id is not null")
    rest = plain.join(hot, "digest", "left_anti").join(equal.drop("rows").hint("merge"), "digest", "left")
    typed = few.unionByName(rest).withColumn("again", F.expr("first_id is not null and not (page_id <=> first_id)"))
    typed = typed.withColumn("key", sort_key(F.col("uri"))).withColumns({"line": _line_column(), "_tie": F.monotonically_increasing_id()})
    ranged = typed.repartitionByRange("line", "_tie").sortWithinPartitions("line", "_tie")
    refers = [F.expr(f"if(again, {c}, null)").alias(n) for c, n in (("first_uri", "refers_uri"), ("first_id", "refers_to"))]
    directory = cut(ranged.select("line", "page_id", "uri", "payload", "digest", *refers).mapInArrow(_write(folder), _DIRECTORY))
    return Archives(folder, directory)


def _read(where: fs.FileSystem, name: str, at: int, length: int) -> bytes:
    with where.open_input_file(name) as f:
        return f.read_at(length, at)


def read_all(archives: Archives) -> DataFrame:
    """Every record, block by block: page_id, uri, type, and, of responses, payload_bytes and payload_digest of what was
    read; of revisits refers_uri, refers_to and refers_digest."""
    folder = archives.folder

    def run(batches):
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch([_row(*x) for x in parse_records(_read(where, f"{root}/{archive}", at, n))], _RECORD)

    n = archives.directory.count()
    blocks = archives.directory.repartition(max(1, min(n, 10_000)), "archive", "start")
    return blocks.select("archive", "start", "bytes").mapInArrow(run, _RECORD)


def lookup(archives: Archives, wanted: DataFrame) -> DataFrame:
    """A record for each row of ``wanted`` (uri, page_id, digest) that the archives hold, as ``read_all`` gives it, with the digest looked for as ``asked``.

    Ranges are as many as the tasks that wrote: their first keys are all that the driver holds. Each range's part of
    the directory meets the keys that fall in it in one task, sorted, so that a block is read once.
    """
    folder = archives.folder
    bounds = sorted((r[1], r[0]) for r in archives.directory.groupBy("range").agg(F.min("first")).toLocalIterator())
    asked = wanted.select(sort_key(F.col("uri")).alias("key"), "page_id", "digest").withColumn("line", _line_column())
    # the last range that begins at or before the line
    starts, ids = (F.array(*map(F.lit, x)).cast(f"array<{k}>") for x, k in (([b[0] for b in bounds], "string"), ([b[1] for b in bounds], "int")))
    begun = F.size(F.filter(starts, lambda s: s <= F.col("line")))
    asked = asked.withColumn("range", F.when(begun > 0, F.get(ids, begun - 1))).filter("range is not null")
    rows = asked.select("range", F.lit(1).alias("kind"), F.col("line").alias("first"), "digest", *[F.lit(None).cast(k).alias(c) for c, k in (("archive", "string"), ("index", "string"), ("at", "long"), ("length", "long"))])
    parts = archives.directory.select("range", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("digest"), "archive", "index", "at", "length")

    def run(batches):
        where, root = fs.FileSystem.from_uri(folder)
        held, now, block, lines = [], None, None, []
        for batch in batches:
            out = []
            for part, kind, first, digest, archive, index, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    held, now, block = [], part, None
                if kind == 0:
                    held.append((first, archive, index, at, length))
                    continue
                i = bisect.bisect_right(held, first, key=lambda x: x[0]) - 1
                if i >= 0 and block != i:
                    block = i
                    lines = zlib.decompress(_read(where, f"{root}/{held[i][2]}", *held[i][3:])).decode("utf-8", "surrogatepass").split("\n")
                x = bisect.bisect_left(lines, f"{first}\x1f") if i >= 0 else 0
                if i >= 0 and x < len(lines) and lines[x].startswith(f"{first}\x1f"):
                    start, n = map(int, lines[x].rsplit("\x1f", 2)[1:])
                    out += [(*_row(*r), digest) for r in parse_records(_read(where, f"{root}/{held[i][1]}", start, n))]
            yield _batch(out, f"{_RECORD}, asked string")

    both = parts.union(rows).repartition("range").sortWithinPartitions("range", "kind", "first")
    return both.mapInArrow(run, f"{_RECORD}, asked string")


def delete(spark: SparkSession, archives: Archives) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archives.folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def roundtrip(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives.

    A revisit's payload is that of the response that it refers to, looked up in the index and read. The archives go in the end.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    archives = write_archives(pages)
    found = cut(read_all(archives))
    again = found.filter("type = 'revisit'").select("page_id", "refers_uri", "refers_to", "refers_digest")
    wanted = again.select(F.col("refers_uri").alias("uri"), F.col("refers_to").alias("page_id"), F.col("refers_digest").alias("digest")).distinct()
    first = cut(lookup(archives, wanted)).select(F.col("asked").alias("refers_digest"), "payload_bytes", "payload_digest")
    resolved = join_hot(again, first, "refers_digest")
    out = found.filter("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    out = cut(out.unionByName(resolved.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")))
    delete(spark, archives)
    return out
