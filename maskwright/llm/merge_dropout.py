"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding starts from single characters and takes the best candidate merge from an agenda, again and again.
With dropout, a candidate is skipped by a keyed hash of its place (document key, start, middle and end):
the same key gives the same segmentation anywhere, another key another one, and all of them decode to the
text. At rate 0 the ids are those of the sentencepiece library.

No piece has a space after another character, so nothing merges across the start of a word; the agendas of
all words of a batch are worked off together, one merge of each word a turn. A word of over LONG characters gets a
heap of its own.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import MULTS, mix, parts

SPACE = "▁"
LONG = 256
_NONE = np.int32(2**31 - 1)
_FREE = np.int64(-(2**63))


@dataclass
class Pieces:
    """What encoding needs of a model: pieces, ranks (0 is merged first; the last entry is that of no piece), bytes, and the table of merges."""

    text: list[bytes]
    byte_ids: np.ndarray
    unk: int
    single: np.ndarray
    rank: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    shift: int

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that left and right make, or -1."""
        key = (left.astype(np.int64) << 20) | right  # negative if either is
        at = ((key.view(np.uint64) * MULTS[0]) >> np.uint64(self.shift)).view(np.int64)
        seen = self.keys[at]
        out = np.where(seen == key, self.merged[at], np.int32(-1))
        rest = np.flatnonzero((seen != key) & (seen != _FREE) & (key >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) % len(self.keys)
            seen = self.keys[at]
            hit = seen == key[rest]
            out[rest[hit]] = self.merged[at[hit]]
            more = ~hit & (seen != _FREE)
            rest, at = rest[more], at[more]
        return out


def load(model: bytes) -> Pieces:
    """Read a serialised BPE model with byte fallback, with the sentencepiece library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
    normal = {p: i for i, p in enumerate(names) if not odd[i]}
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("a piece has a space after another character")
    scores = np.array([sp.get_score(i) for i in range(n)])
    _, rank = np.unique(-scores, return_inverse=True)
    rank = np.append(rank, _NONE).astype(np.int32)
    byte_ids = np.full(256, -1, dtype=np.int32)
    text = []
    for i, p in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(p[3:-1], 16)] = i
            text.append(bytes([int(p[3:-1], 16)]))
        else:
            text.append(b"" if odd[i] else p.replace(SPACE, " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    single = np.full(0x110000, -1, dtype=np.int32)
    for p, i in normal.items():
        if len(p) == 1:
            single[ord(p)] = i
    merges = {(normal[p[:j]] << 20) | normal[p[j:]]: i for p, i in normal.items() for j in range(1, len(p)) if p[:j] in normal and p[j:] in normal}
    bits = max(16, (8 * len(merges)).bit_length())
    keys, merged = np.full(1 << bits, _FREE, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
    shift = 64 - bits
    for key, i in merges.items():
        at = ((key * int(MULTS[0])) & (2**64 - 1)) >> shift
        while keys[at] != _FREE:
            at = (at + 1) % len(keys)
        keys[at], merged[at] = key, i
    return Pieces(text, byte_ids, sp.unk_id(), single, rank, keys, merged, shift)


def _limit(rate: float) -> np.uint64:
    return np.uint64(min(int(rate * 2.0**64), 2**64 - 1))


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate merge at that place of the document with that key is skipped."""
    at = key + start.astype(np.uint64) * MULTS[1] + middle.astype(np.uint64) * MULTS[2] + end.astype(np.uint64) * MULTS[3]
    return mix(at) < _limit(rate)


def document_key(seed: int, name: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def agenda(p: Pieces, symbols: list[int], starts: list[int], stop: int, key: int, rate: float) -> tuple[list[int], list[int]]:
    """One word by a heap of candidates: (piece ids, starts). ``starts``: places of the characters, ``stop`` the end."""
    n = len(symbols)
    ids, ends = list(symbols), [*starts[1:], stop]
    before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i < 0 or j < 0 or ids[i] < 0 or ids[j] < 0:
            return
        new = int(p.find(np.array([ids[i]]), np.array([ids[j]]))[0])
        if new < 0:
            return
        if rate and skipped(np.array([key], np.uint64), np.array([starts[i]]), np.array([starts[j]]), np.array([ends[j]]), rate)[0]:
            return
        heapq.heappush(heap, (int(p.rank[new]), i, j, new, ends[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, new, end = heapq.heappop(heap)
        # stale when either half has gone or grown since it was offered
        if not (alive[i] and alive[j]) or after[i] != j or ends[j] != end or int(p.find(np.array([ids[i]]), np.array([ids[j]]))[0]) != new:
            continue
        ids[i], ends[i], alive[j] = new, ends[j], False
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    left = [i for i in range(n) if alive[i]]
    return [ids[i] for i in left], [starts[i] for i in left]


def _merge_all(p: Pieces, sym: np.ndarray, begin: np.ndarray, word: np.ndarray, offset: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """All words together. sym: piece per character or -1; begin: first character of each word; word: word of each
    character; offset, key: of each word, added to places and hashed. Returns pieces and their first characters."""
    at, word = np.arange(len(sym), dtype=np.int32), word.astype(np.int32)
    stop = np.append(begin[1:], len(sym)).astype(np.int32)
    lengths = stop - begin.astype(np.int32)

    def look(i: np.ndarray) -> np.ndarray:
        """Rank of what symbols i and i + 1 of one word make."""
        new = p.find(sym[i], sym[i + 1])
        has = np.flatnonzero(new >= 0)
        if rate and len(has):
            a = i[has]
            w = word[a]
            two = np.minimum(a + 2, len(sym) - 1)
            end = np.where((a + 2 < len(sym)) & (word[two] == w), at[two], stop[w])
            off = offset[w]
            new[has[skipped(key[w], at[a] + off, at[a + 1] + off, end + off, rate)]] = -1
        return p.rank[new]

    rank = np.full(len(sym), _NONE, dtype=np.int32)
    inside = np.flatnonzero(word[1:] == word[:-1])
    rank[inside] = look(inside)
    out_sym, out_at = [], []
    while len(sym):
        best = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
        live = best < _NONE
        if 4 * int(live.sum()) < 3 * len(live):
            here = np.repeat(live, lengths)
            done, left = np.flatnonzero(~here), np.flatnonzero(here)
            out_sym.append(sym[done])
            out_at.append(at[done])
            sym, at, word, rank, best, lengths = sym[left], at[left], word[left], rank[left], best[live], lengths[live]
            live = live[live]
            if not len(sym):
                break
        hit = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank < _NONE))
        w = word[hit]
        hit = hit[np.concatenate([[True], w[1:] != w[:-1]])]
        sym[hit] = p.find(sym[hit], sym[hit + 1])
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        keep = np.flatnonzero(keep)
        now = hit - np.arange(len(hit))
        sym, at, word, rank = sym[keep], at[keep], word[keep], rank[keep]
        lengths = lengths - live
        rank[now] = _NONE
        right = now[now + 1 < len(sym)]
        right = right[word[right] == word[right + 1]]
        left = now[now > 0] - 1
        left = left[word[left] == word[left + 1]]
        both = np.concatenate([right, left])
        if len(both):
            rank[both] = look(both)
    return (np.concatenate(out_sym), np.concatenate(out_at)) if out_sym else (sym, at)


def _encode_part(p: Pieces, codes: np.ndarray, heads: np.ndarray, offset: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """codes: characters of several stretches, spaces as 0x20; heads: where each begins; offset: its place in its text. Ids and the character each comes from."""
    sym = p.single[codes].copy()
    space = codes == 0x20
    sym[space] = p.single[ord(SPACE)]
    sym[codes == ord(SPACE)] = -1  # the letter itself goes by bytes, so that it isn't read back as a space
    start = np.zeros(len(codes), dtype=bool)
    start[1:] = space[1:] & ~space[:-1]
    start[heads] = True
    begin = np.flatnonzero(start)
    word = np.cumsum(start) - 1
    owner = np.searchsorted(heads, begin, side="right") - 1
    shift = offset[owner] - heads[owner]
    lengths = np.diff(np.append(begin, len(codes)))
    long = lengths > LONG
    short = ~np.repeat(long, lengths)
    parts = []
    if short.any():
        places = np.flatnonzero(short)
        local = np.concatenate([[0], np.cumsum(lengths[~long])])[:-1]
        of = np.repeat(np.arange(len(local)), lengths[~long])
        got, at = _merge_all(p, sym[places], local, of, (begin[~long] - local) + shift[~long], keys[owner[~long]], rate)
        parts.append((got, places[at]))
    for w in np.flatnonzero(long):
        a, b = int(begin[w]), int(begin[w] + lengths[w])
        ids, starts = agenda(p, sym[a:b].tolist(), [x + int(shift[w]) for x in range(a, b)], b + int(shift[w]), int(keys[owner[w]]), rate)
        parts.append((np.array(ids, dtype=np.int32), np.array(starts, dtype=np.int64) - int(shift[w])))
    ids, at = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
    order = np.argsort(at, kind="stable")
    ids, at = ids[order], at[order]
    # characters without a piece: their UTF-8 bytes
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        kinds, which = np.unique(codes[at[lost]], return_inverse=True)
        spelt = [p.byte_ids[np.frombuffer(chr(int(c)).encode("utf-8", "surrogatepass"), np.uint8)] for c in kinds]
        times = np.ones(len(ids), dtype=np.int64)
        times[lost] = np.array([len(s) for s in spelt])[which]
        first = np.concatenate([[0], np.cumsum(times)])[:-1]
        wide, at = np.repeat(ids, times), np.repeat(at, times)
        for k in range(max(len(s) for s in spelt)):
            has = lost[np.array([len(s) > k for s in spelt])[which]]
            wide[first[has] + k] = np.array([s[k] if len(s) > k else -1 for s in spelt])[which[np.isin(lost, has)]]
        ids = wide
    return ids, at


def _stretches(text: str, most: int):
    """(place, stretch) of a text with its leading space, cut before words into stretches of about ``most`` characters."""
    whole = " " + text
    at = 0
    while at < len(whole):
        end = at + most
        if end < len(whole):
            cut_at = whole.find(" ", end)
            while cut_at > 0 and whole[cut_at - 1] == " ":
                cut_at = whole.find(" ", cut_at + 1)
            end = cut_at if cut_at > 0 else len(whole)
        yield at, whole[at:end]
        at = end


def encode(p: Pieces, texts: list[str | None], keys: list[int], rate: float = 0.0, most: int = 1 << 19) -> list[np.ndarray]:
    """Piece ids of each text; ``keys``: a 64-bit key for each, of use only at a rate above 0. Null and empty texts have none."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            codes = np.frombuffer("".join(s for _, _, s in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            heads = np.concatenate([[0], np.cumsum([len(s) for _, _, s in held])])
            ids, at = _encode_part(p, codes, heads[:-1], np.array([o for _, o, _ in held], dtype=np.int64), np.array([keys[i] for i, _, _ in held], dtype=np.uint64), rate)
            edges = np.searchsorted(at, heads)
            for (i, _, _), a, b in zip(held, edges[:-1], edges[1:]):
                out[i].append(ids[a:b])
        held, size = [], 0

    for i, t in enumerate(texts):
        for place, stretch in _stretches(t, most) if t else ():
            held.append((i, place, stretch))
            size += len(stretch)
            if size >= most:
                flush()
    flush()
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in out]


def decode(p: Pieces, ids: np.ndarray) -> str:
    """The text of a sequence of ids: pieces joined, bytes put together, the leading space taken off."""
    data = b"".join([p.text[i] for i in ids.tolist()])
    return data[1:].decode("utf-8", "surrogatepass") if data.startswith(b" ") else data.decode("utf-8", "replace")


_loaded: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """load(), once in each process."""
    name = hashlib.sha256(model).digest()
    if name not in _loaded:
        _loaded[name] = load(model)
    return _loaded[name]


def encode_docs(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 1, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, lossless, and the ids (array<int>) or, with ``digest``, their SHA-256.

    The key of a document is made of ``seed`` and its doc_id, so repeated rows are encoded alike, and another
    seed gives another segmentation. ``lossless``: the ids decode to the text. Null and empty texts have no
    ids. The model file (under 1 MB) is read on the driver and sent along; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        p = pieces_of(sent.value)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, own in parts(batch.column(1), 1 << 20):
                found = encode(p, own, [document_key(seed, str(x)) for x in names[lo:hi]], rate)
                same = [decode(p, x) == (t or "") for x, t in zip(found, own)]
                if digest:
                    last = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(own)), pa.array([len(x) for x in found], pa.int64()), pa.array(same), last], ["doc_id", "n_pieces", "lossless", "ids_sha256" if digest else "ids"])

    kind = "ids_sha256 string" if digest else "ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_pieces long, lossless boolean, {kind}")
