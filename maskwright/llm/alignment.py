"""Alignment of two tokenizers over the same bytes, by a sweep over the ends of their tokens.

Both encode a text; each token ends at a byte offset. The end events of A and B are united, dealt by groups of
documents (a part is so many documents in a row that they have PART_TOKENS events of A, or one longer document), and
sorted by document and offset. A machine reads them in that order: where ends of both meet, a group of tokens of A and B
is closed; between two events next to each other lies one link, of the two tokens that cover the place. The machine
holds the tokens since the last group's end and ROW tokens of either side: its memory follows the longest group, not the text.

How often a pair of ids is linked is counted over the whole corpus: per part by the machine, then per pair over the parts.
The counts go back to the parts that asked, and the machine reads their events once more. Events travel packed, ROW ids to a
row (an id tells its length), and the parts are worked off in WAVES, so that one wave's events only are in the shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import buckets, by_bucket, cut, deal, dealt_schema, give_back, mix, n_buckets, parts

#: Events of one packed row, and of A in one part, before the next begins.
ROW = 4096
PART_TOKENS = 1 << 22
WAVES = 4
#: Rows that the machine takes at a time.
STEP = 256
#: A document's place in a step stands above its offsets.
_SHIFT = np.int64(40)
_EVENTS = "part long, key long, off long, side int, doc_id long, ids binary, counts binary"
_NO_TOKENS, _COUNTS = -1, 2
#: Texts of these characters only are cut into words alike by every version of Unicode; runs end after some thousands.
_PLAIN = re.compile(r"(?!.*\s{4000})(?!.*\S{4000})[\t\n\r\x20-\x7e -Ƞ‐-‧]*", re.S)
_UNIT = re.compile(" +[^ ]*")
_WORDS = 1 << 18


class Encoder:
    """Both tokenizers, with the bytes of each id. ``ranks`` is a faster form of the vocabulary of ``byte_bpe``, with its split pattern."""

    def __init__(self, byte_bpe: str, piece_bpe: str, ranks: str | None = None, pattern: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_a, self.bytes_b = bytes_of_a(byte_bpe), [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        # words are apart if no piece has a space behind another character
        self.words_apart = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.bytes_b)))
        self.known: dict[str, bytes] = {}
        self.same = True

    def encode_a(self, text: str, plain: bool) -> np.ndarray:
        if plain and self.fast:
            return self.fast.encode_to_numpy(text).astype(np.uint16)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            # the library gives an empty text no space in front
            found = self.b.encode(word[1:]) if len(word) > 1 else [self.b.piece_to_id("▁")]
            self.same &= b"".join([self.bytes_b[i] for i in found]) == word.encode()
            ids = np.array(found, dtype=np.uint16).tobytes()
            if len(word) < 40 and self.same:
                if len(self.known) >= _WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def encode_b(self, text: str, plain: bool) -> np.ndarray:
        """``text`` begins with the space that the model would put there."""
        if plain and self.words_apart:
            return np.frombuffer(b"".join(map(self._word, _UNIT.findall(text))), dtype=np.uint16)
        return np.array(self.b.encode(text[1:]), dtype=np.uint16)

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B for a space and the text; None where there is no text or the bytes of either are others."""
        if not text:
            return None
        plain, spaced = bool(_PLAIN.fullmatch(text)), f" {text}"
        self.same = True
        a, b = self.encode_a(spaced, plain), self.encode_b(spaced, plain)
        if plain and self.fast and self.words_apart:
            # ranks lose no byte, and words were compared when they were met first
            return (a, b) if self.same else None
        raw = spaced.encode("utf-8", "surrogatepass")
        same = all(b"".join([table[i] for i in ids.tolist()]) == raw for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))
        return (a, b) if same else None


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable characters stand for themselves, the others come after U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    found = dict(model["model"]["vocab"]) | {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    out = [b""] * (max(found.values()) + 1)
    for piece, i in found.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8")


_loaded: dict[tuple, Encoder] = {}


def _encoder(files: tuple) -> Encoder:
    """Once a worker."""
    if files not in _loaded:
        _loaded[files] = Encoder(*files)
    return _loaded[files]


def _events(files: tuple, row: int, part_tokens: int):
    """Rows (doc_id, text) to packed events; a document without tokens is a row of its own."""

    def run(batches):
        from pyspark import TaskContext

        encoder, task = _encoder(files), TaskContext.get().partitionId()
        length = [np.array([len(x) for x in t], dtype=np.int64) for t in (encoder.bytes_a, encoder.bytes_b)]
        pack = zstandard.ZstdCompressor(level=1).compress
        part, held, n = task << 24, 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in parts(batch.column(1)):
                rows = []
                for doc, text in zip(ids[lo:hi], texts):
                    key, n = (task << 40) + n, n + 1
                    found = encoder.both(text)
                    if found is None:
                        rows.append((part, key, 0, _NO_TOKENS, doc, b""))
                        continue
                    for side, tokens in enumerate(found):
                        at = 0
                        for x in range(0, len(tokens), row):
                            piece = tokens[x : x + row]
                            rows.append((part, key, at, side, doc, pack(piece.tobytes())))
                            at += int(length[side][piece].sum())
                    held += len(found[0])
                    if held >= part_tokens:
                        part, held = part + 1, 0
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), pa.nulls(len(rows), pa.binary())], [x.split()[0] for x in _EVENTS.split(", ")])

    return run


class _Step:
    """The whole groups in some rows of one part, with what was left over before them."""

    def __init__(self, keys, offs, sides, packed, length, left):
        unpack = zstandard.ZstdDecompressor().decompress
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        place = np.cumsum(new) - 1
        self.keys, self.n_docs, self.first_row = keys[new], int(place[-1]) + 1, np.flatnonzero(new)
        ids, ends = [], []
        for side in (0, 1):
            rows = np.flatnonzero(sides == side)
            found = [np.frombuffer(unpack(packed[i]), dtype=np.uint16) for i in rows.tolist()]
            count = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.concatenate([left[side][0], *found])
            more = np.cumsum(length[side][flat[len(left[side][0]) :]])
            start = np.concatenate([[0], more])[np.cumsum(count) - count] if len(rows) else count
            ids.append(flat)
            ends.append(np.concatenate([left[side][1], more + np.repeat(offs[rows] + (place[rows].astype(np.int64) << _SHIFT) - start, count)]))
        at = np.searchsorted(ends[1], ends[0])
        hit = np.zeros(len(ends[0]), dtype=bool)
        if len(ends[1]):
            hit = ends[1][np.minimum(at, len(ends[1]) - 1)] == ends[0]
        #: index of the last token of each group, by side
        self.last = np.flatnonzero(hit), at[hit]
        done = [int(x[-1]) + 1 if len(x) else 0 for x in self.last]
        # every token before an end that both have has been read, as rows of a side follow one another
        base = np.int64(self.n_docs - 1) << _SHIFT
        self.left = [(ids[s][done[s] :], ends[s][done[s] :] - base) for s in (0, 1)]
        self.ids, self.ends = [x[:n] for x, n in zip(ids, done)], [x[:n] for x, n in zip(ends, done)]
        self.hit = hit[: done[0]], np.zeros(done[1], dtype=bool)
        self.hit[1][self.last[1]] = True
        self.meets = at[: done[0]]
        self.docs = [x >> _SHIFT for x in self.ends]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id of B << 16 | id of A, document) of every link: those at ends of A, then those at ends of B alone."""
        (a, b), own = self.ids, ~self.hit[1]
        under = np.searchsorted(self.ends[0], self.ends[1][own])
        code = np.concatenate([b[self.meets].astype(np.uint32) << 16 | a, b[own].astype(np.uint32) << 16 | a[under]])
        return code, len(a), self.docs[1][own]

    def texts(self, table: pa.Array, n_ids: int) -> tuple[pa.Buffer, np.ndarray]:
        """``a1,a2|b1;`` of all groups, and where each document's stretch begins and ends."""
        (a, b), (last_a, last_b) = self.ids, self.last
        group = [np.cumsum(h) - h for h in self.hit]
        before = np.concatenate([[0], last_b + 1])
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + before[group[0]]] = a + np.where(self.hit[0], n_ids, 0)
        code[np.arange(len(b)) + last_a[group[1]] + 1] = b + np.where(self.hit[1], 2 * n_ids, 0)
        taken = table.take(pa.array(code))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)[: len(code) + 1]
        tokens = np.concatenate([[0], np.cumsum(sum(np.bincount(d, minlength=self.n_docs) for d in self.docs))])
        return taken.buffers()[2], ends[tokens]


def _steps(batches, length, most_rows: int = STEP):
    """(part, rows of doc_id, _Step) in order, and (part, None, counts) before them."""
    left, open_ = None, None
    for batch in batches:
        part, key, off, side = (batch.column(i).to_numpy() for i in range(4))
        at = 0
        while at < len(part):
            end = at + 1
            while end < len(part) and end - at < most_rows and part[end] == part[at] and (side[end] == _COUNTS) == (side[at] == _COUNTS):
                end += 1
            rows = slice(at, end)
            if side[at] == _COUNTS:
                yield int(part[at]), None, [[batch.column(i)[j].as_buffer() for j in range(at, end)] for i in (5, 6)]
            else:
                if open_ != (part[at], key[at]):
                    left = [(np.zeros(0, np.uint16), np.zeros(0, np.int64))] * 2
                step = _Step(key[rows], off[rows], side[rows], batch.column(5).slice(at, end - at).to_pylist(), length, left)
                left, open_ = step.left, (part[end - 1], key[end - 1])
                yield int(part[at]), batch.column(4).slice(at, end - at).take(pa.array(step.first_row)), step
            at = end


def _unique(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    at = np.flatnonzero(new)
    return codes[at], np.diff(np.append(at, len(codes))) if counts is None else np.add.reduceat(counts, at) if len(at) else counts


def _lengths(files: tuple) -> list[np.ndarray]:
    encoder = _encoder(files)
    return [np.array([len(x) for x in t], dtype=np.int64) for t in (encoder.bytes_a, encoder.bytes_b)]


def _pairs(files: tuple, step_rows: int):
    """Sorted events to the pairs of ids that a part links, with their number."""

    def run(batches):
        now, held, size = None, [], 0

        def merged():
            return _unique(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

        def out():
            code, count = merged()
            for i in range(0, len(code), 1 << 16):
                c = code[i : i + (1 << 16)].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([len(c)]), pa.array([(c << np.uint64(32) | count[i : i + (1 << 16)].astype(np.uint64)).tobytes()], pa.binary())], ["part", "n", "pairs"])

        for part, _, step in _steps(batches, _lengths(files), step_rows):
            if part != now:
                if held:
                    yield from out()
                now, held, size = part, [], 0
            held.append(_unique(step.links()[0]))
            size += len(held[-1][0])
            if size > 1 << 22:
                held = [merged()]
                size = len(held[0][0])
        if held:
            yield from out()
        give_back()

    return run


def _by_pair(n: int):
    def run(batches):
        for batch in batches:
            for part, pairs in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = np.frombuffer(pairs.as_buffer(), dtype=np.uint64)
                yield deal((mix(pairs >> np.uint64(32)) % np.uint64(n)).astype(np.int64), pairs, np.full(len(pairs), part, dtype=np.uint64))

    return run


def _totals(batches):
    """Pairs with numbers and parts to the total of each pair, dealt by the parts that asked."""
    for _, (pairs, part) in buckets(batches, 2):
        order = np.argsort(pairs)
        pairs, part = pairs[order], part[order]
        code = pairs >> np.uint64(32)
        own, count = _unique(code, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
        yield deal(part.astype(np.int64), code, count[np.searchsorted(own, code)].astype(np.uint64))


def _most(batches):
    """The highest total of each id of B."""
    most = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for code, count in zip(batch.column(0), batch.column(1)):
            np.maximum.at(most, (np.frombuffer(code.as_buffer(), dtype=np.uint64) >> np.uint64(16)).astype(np.int64), np.frombuffer(count.as_buffer(), dtype=np.int64))
    at = np.flatnonzero(most)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(most[at])], ["b", "most"])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(files: tuple, most, step_rows: int):
    """Sorted counts and events of each part to one row a document."""

    def run(batches):
        n_ids = 1 << 16
        table = pa.array([f"{i}{end}".encode() for end in ",|;" for i in range(n_ids)], pa.binary())
        now, codes, totals, held = None, None, None, [[], []]
        doc = None  # of the open document: key, doc_id, six numbers, hash

        def closed():
            return [doc[1], *doc[2], doc[3].hexdigest() if doc[2][0] else ""]

        def batch_of(rows):
            kinds = [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _RESULT.split(", ")])

        for part, ids, step in _steps(batches, _lengths(files), step_rows):
            if part != now:
                now, codes, held = part, None, [[], []]
            if ids is None:
                for h, x in zip(held, step):
                    h += [np.frombuffer(b, dtype=np.int64) for b in x]
                continue
            if codes is None:
                codes, totals = (np.concatenate([np.zeros(0, np.int64), *h]) for h in held)
                order = np.argsort(codes)
                codes, totals, held = codes[order].astype(np.uint32), totals[order], [[], []]
            code, n_a, docs_b = step.links()
            count = totals[np.searchsorted(codes, code)] if len(code) else np.zeros(0, np.int64)
            best = count == most.value[code >> 16]
            owner = np.concatenate([step.docs[0], docs_b])
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(step.n_docs + 1))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[order].astype(np.int64))])[bounds]) for x in (best, count)]
            each = lambda d: np.bincount(d, minlength=step.n_docs)
            numbers = np.stack([each(step.docs[0]), each(step.docs[1]), each(step.docs[0][step.hit[0]]), np.diff(bounds), *sums], axis=1)
            data, ends = step.texts(table, n_ids)
            data, rows = memoryview(data) if len(code) else b"", []
            for i, (key, doc_id) in enumerate(zip(step.keys.tolist(), ids.to_pylist())):
                if doc is None or doc[0] != key:
                    if doc:
                        rows.append(closed())
                    doc = [key, doc_id, [0] * 6, hashlib.sha256()]
                if ends[i + 1] > ends[i]:
                    if doc[2][0]:
                        doc[3].update(b";")
                    doc[3].update(data[ends[i] : ends[i + 1] - 1])
                    doc[2] = [x + y for x, y in zip(doc[2], numbers[i].tolist())]
            yield batch_of(rows)
        yield batch_of([closed()] if doc else [])
        give_back()

    return run


def _sorted(events: DataFrame) -> DataFrame:
    """Each part's events in one task, by document and offset."""
    return events.repartition("part").sortWithinPartitions("part", "key", "off", "side")


def events_of(docs: DataFrame, files: tuple, row: int = ROW, part_tokens: int = PART_TOKENS) -> DataFrame:
    """The packed end events of both tokenizers over ``docs`` (doc_id long, text string), written."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_events(files, row, part_tokens), _EVENTS))


def aligned_groups(docs: DataFrame, files: tuple) -> DataFrame:
    """The groups themselves: doc_id, end (byte offset after a space and the text up to there), a, b (lists of ids)."""

    def run(batches):
        for _, ids, step in _steps(batches, _lengths(files)):
            doc = step.docs[0][step.last[0]]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]).astype(np.int32)), pa.array(x.astype(np.int32))) for x, last in zip(step.ids, step.last)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(step.ends[0][step.last[0]] & ((1 << int(_SHIFT)) - 1)), *lists], ["doc_id", "end", "a", "b"])

    return _sorted(events_of(docs, files)).mapInArrow(run, "doc_id long, end long, a array<int>, b array<int>")


def alignment(docs: DataFrame, files: tuple, waves: int = WAVES, row: int = ROW, part_tokens: int = PART_TOKENS, step_rows: int = STEP) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): the numbers of tokens, groups and links, and how often what is linked is linked.

    ``files``: paths of A's and B's models, then, if there, of A's vocabulary as ranks and its split pattern. A encodes a space and the text,
    B the text. Where the joined bytes of either differ from a space and the text (a literal U+2581, for one), and for null and
    empty texts, all numbers are 0 and groups_sha256 is ''. n_best: links whose pair is, over all documents, as frequent as any
    of its id of B; count_sum: the sum of the pairs' numbers over the links. Repeated rows are rows of their own and count
    again; a null doc_id stays null. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    events = events_of(docs, files, row, part_tokens)
    of_wave = lambda w: F.pmod(F.xxhash64("part"), F.lit(waves)) == w
    wave = [events.filter(of_wave(w)) for w in range(waves)]
    counted = [cut(_sorted(x.filter(F.col("side") != _NO_TOKENS)).mapInArrow(_pairs(files, step_rows), "part long, n long, pairs binary")) for x in wave]
    pairs = counted[0]
    for more in counted[1:]:
        pairs = pairs.union(more)
    n = n_buckets(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    totals = cut(by_bucket(pairs.select("part", "pairs").mapInArrow(_by_pair(n), dealt_schema(2))).mapInArrow(_totals, dealt_schema(2)))
    del pairs, counted
    # an entry for each id of B
    highest = totals.select("c0", "c1").mapInArrow(_most, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).toArrow()
    most = np.zeros(1 << 16, dtype=np.int64)
    most[highest.column("b").to_numpy()] = highest.column("most").to_numpy()
    most = spark.sparkContext.broadcast(most)
    asked = totals.select(F.col("bucket").alias("part"), F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("off"), F.lit(_COUNTS).alias("side"), F.lit(None).cast("long").alias("doc_id"), F.col("c0").alias("ids"), F.col("c1").alias("counts"))
    out = None
    for w in range(waves):
        done = cut(_sorted(asked.filter(of_wave(w)).union(wave[w])).mapInArrow(_score(files, most, step_rows), _RESULT))
        out = done if out is None else out.union(done)
    return out
