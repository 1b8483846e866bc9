"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Tables that cut() wrote, each with a weak reference to the JVM's list of its files.
_written: list[tuple] = []
#: Bits of the filters on keys, as a power of two: 1 MB.
FILTER_BITS = 23
#: A key is hot when it holds more than one in HOT_SHARE of all rows; so there are HOT_SHARE hot ones at most.
HOT_SHARE = 1000
SALTS = 32


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and each would keep its highest mark until the end."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="maskwright-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def cut(df: DataFrame, tidy: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from the files.

    Losing an executor then repeats only the steps after the cut. The driver drops what it no longer
    refers to, so that shuffle files of the steps before can go and its heap stays small (some 50 ms each time).
    The files of a cut go likewise, at a later cut, once no DataFrame refers to them any more. Without ``tidy``
    nothing is looked for: for many cuts of a few rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if tidy:
        gc.collect()
        give_back()
        spark.sparkContext._jvm.System.gc()
        release(spark)
    found = spark.read.schema(df.schema).parquet(path)
    # every plan that reads the files holds this one object, whatever was derived from ``found``
    files = found._jdf.queryExecution().analyzed().relation().location()
    _written.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files)))
    return found


def release(spark: SparkSession) -> None:
    """Delete the tables of cut() that no plan of the driver reads any more."""
    jvm, alive = spark.sparkContext._jvm, []
    for path, files in _written:
        if files.refersTo(None):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        else:
            alive.append((path, files))
    _written[:] = alive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def likely(source: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``source`` whose ``key`` (a long) may be in ``wanted``: all that are, and few others.

    A bit of a filter of fixed size for each wanted key: 2**(FILTER_BITS - 6) rows of 16 bytes at most are broadcast,
    whatever the corpus. Beyond some millions of keys it lets more through, never less.
    """
    word, bit = F.expr(f"shiftright(xxhash64({key}) & {(1 << FILTER_BITS) - 1}, 6)"), F.expr(f"cast(xxhash64({key}) & 63 as int)")
    words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    return source.withColumn("_word", word).join(F.broadcast(words), "_word").filter(F.expr(f"shiftright(_bits, cast(xxhash64({key}) & 63 as int)) & 1 = 1")).drop("_word", "_bits")


def bit_filter(wanted: DataFrame, key: str) -> np.ndarray:
    """Whether a number whose last FILTER_BITS are i may be among the ``key`` (a long) of ``wanted``: an array of fixed size, for Python."""
    low = wanted.select(F.expr(f"{key} & {(1 << FILTER_BITS) - 1}").alias("low"))
    words = low.groupBy(F.expr("shiftright(low, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype="<i8")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def in_keys(rows: DataFrame, wanted: DataFrame, keys: list[str], hot: F.Column) -> DataFrame:
    """The rows of ``rows`` whose ``keys`` are in ``wanted`` (distinct keys); those of ``wanted`` that are ``hot``,
    HOT_SHARE at most, are broadcast, so that no task gathers the rows of one of them."""
    few = F.broadcast(wanted.filter(hot).select(*keys))
    rest = rows.join(few, keys, "left_anti").join(wanted.filter(~hot).select(*keys).hint("merge"), keys, "left_semi")
    return rows.join(few, keys, "left_semi").unionByName(rest)


# --- numbers dealt to buckets ------------------------------------------------------------------------------

#: Numbers of one row of a dealt table, and of one bucket on average.
ROW = 256
BUCKET = 1 << 18


def n_buckets(numbers: int) -> int:
    return max(256, -(-numbers // BUCKET))


def deal(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns of 64-bit numbers as rows (bucket, binary, ...), each of ROW numbers of one bucket at most: few rows to shuffle."""
    bucket = bucket.astype(np.uint16 if len(bucket) and bucket.max() < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order].astype(np.int64)
    new = np.ones(len(b), dtype=bool)
    new[1:] = b[1:] != b[:-1]
    start = np.flatnonzero(new)
    at = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    row = np.flatnonzero(at % ROW == 0)
    ends = pa.py_buffer((np.append(row, len(b)) * 8).astype(np.int32))
    values = [pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(np.ascontiguousarray(c[order]))]) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(b[row]), *values], ["bucket", *(f"c{i}" for i in range(len(columns)))])


def dealt_schema(columns: int) -> str:
    return ", ".join(["bucket long", *(f"c{i} binary" for i in range(columns))])


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def buckets(batches, columns: int):
    """(bucket, columns) of each bucket of a partition dealt by ``by_bucket``; one bucket is held at a time."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        b = batch.column(0).to_numpy()
        if not len(b):
            continue
        cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if now is not None and b[lo] != now:
                yield now, [np.concatenate(x) for x in held]
                held = [[] for _ in range(columns)]
            now = b[lo]
            for i, x in enumerate(held):
                column = batch.column(i + 1)
                ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset :]
                # a copy, as the batch goes
                x.append(np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[lo] : ends[hi]].copy().view(np.uint64))
    if now is not None:
        yield now, [np.concatenate(x) for x in held]
    held = None
    give_back()


# --- word scanning -----------------------------------------------------------------------------------------

_GEN = np.random.Generator(np.random.PCG64(20240607))
_CHAR = _GEN.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTS = _GEN.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 19
_power: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n of each at least."""
    if not _power or len(_power[0]) < n:
        size = max(n, _BLOCK)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _power[:] = [np.cumprod(up), np.cumprod(down)]
    return _power[0], _power[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` consecutive values from each start (all inside ``values``)."""
    up, down = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((total[starts + length] - total[starts]) * down[starts])


def scan_words(texts: list[str | None], lower: bool = True, detail: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts in order, and each text's first word.

    Lower-cases A-Z only. Works on blocks that end at white space, so that memory follows the block, not
    the text. With ``detail`` also each word's line in its text, from 0, and whether it holds a digit 0-9.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts) + b"\n"
    if lower:
        data = data.lower()
    codes = np.frombuffer(data, dtype=np.uint8)
    hashes, firsts, digits, at = [], [], [], 0
    while at < len(codes):
        end = min(at + _BLOCK, len(codes))
        while end < len(codes) and not _SPACE[codes[end - 1]]:
            gaps = np.flatnonzero(_SPACE[codes[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else min(end + _BLOCK, len(codes))
        block = codes[at:end]
        inside = np.zeros(len(block) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[block]
        edge = np.diff(inside)
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(block) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CHAR[block] * up[: len(block)])])
        hashes.append(mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64) * MULTS[63]))
        firsts.append(begin + at)
        if detail:
            seen = np.concatenate([np.zeros(1, np.int32), np.cumsum((block >= 0x30) & (block <= 0x39), dtype=np.int32)])
            digits.append(seen[stop] > seen[begin])
        at = end
    words, begin = np.concatenate(hashes), np.concatenate(firsts)
    byte_at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    first = np.searchsorted(begin, byte_at)
    if not detail:
        return words, first
    ends = np.flatnonzero(codes == 0x0A)
    line = np.searchsorted(ends, begin) - np.repeat(np.searchsorted(ends, byte_at[:-1]), np.diff(first))
    return words, first, line, np.concatenate(digits)


def slices(texts: list[str | None], most: int = 1 << 19):
    """Ranges of rows of about ``most`` characters together; a longer text stands alone."""
    yield from _ranges([len(t) if t else 0 for t in texts], most)


def _ranges(sizes: list[int], most: int):
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def parts(texts: pa.Array, most: int = 1 << 19):
    """(first row, end row, texts) of about ``most`` bytes of a column: a batch never becomes Python strings as a whole."""
    for a, b in _ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most):
        yield a, b, texts.slice(a, b - a).to_pylist()
    give_back()


def shingle_sets(texts: list[str | None], k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words count as one shingle, none as none."""
    return sets_of(*scan_words(texts, lower), k)


def sets_of(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    n = len(words) - k + 1
    grams = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        grams += words[j : j + n] * MULTS[j]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = (words[a:b] * MULTS[32 : 32 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def join_hot(rows: DataFrame, side: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``side`` (distinct keys). Keys that more than one in HOT_SHARE of ``rows`` have, HOT_SHARE at most,
    meet their rows by broadcast, so that no task gathers the rows of one; null keys meet nothing."""
    total = F.lit(rows.count())
    hot = F.broadcast(cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key), tidy=False))
    few = F.broadcast(side.join(hot, key, "left_semi"))
    rest = rows.join(hot, key, "left_anti").join(side.join(hot, key, "left_anti").hint("merge"), key, how)
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rest)
