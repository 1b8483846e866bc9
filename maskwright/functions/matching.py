"""Views of a text under which rules and dictionary entries match, each with a map back to the source."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np


@dataclass(frozen=True)
class View:
    """A derived text; ``back[i]`` is the source offset of its character i."""

    text: str
    back: tuple[int, ...] | range

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (self.back[start], self.back[end - 1] + 1) if end > start else (0, 0)


class _Folded(dict):
    """What a character is in a key: compatibility-composed, case-folded; white space and format characters are nothing."""

    def __missing__(self, code: int) -> str:
        kept = (x.casefold() for x in unicodedata.normalize("NFKC", chr(code)) if not x.isspace() and unicodedata.category(x) != "Cf")
        self[code] = found = "".join(kept)
        return found


_folded = _Folded()


def match_key(text: str) -> str:
    return text.translate(_folded)


def key_offsets(text: str) -> np.ndarray:
    """The source offset of each character of ``match_key(text)``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, which = np.unique(codes, return_inverse=True)
    sizes = np.array([len(_folded[c]) for c in kinds.tolist()], dtype=np.int64)
    return np.repeat(np.arange(len(codes)), sizes[which] if len(codes) else 0)


def key_view(text: str) -> View:
    """Compatibility-composed and case-folded, without white space and format characters."""
    return View(match_key(text), tuple(key_offsets(text).tolist()))


class Scan:
    """All places of many keys in one pass over a text, by an automaton; empty keys are nowhere."""

    def __init__(self, keys: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for i, key in enumerate(keys):
            if key:
                self.automaton.add_word(key, (*self.automaton.get(key, ()), (i, len(key))))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def places(self, view: str) -> np.ndarray:
        """Rows (key, start, end) in the view, those of one key without overlaps from the left, by their ends."""
        found, free = [], {}
        for last, keys in () if self.empty else self.automaton.iter(view):
            for i, n in keys:
                if free.get(i, 0) <= last + 1 - n:
                    free[i] = last + 1
                    found.append((i, last + 1 - n, last + 1))
        return np.array(found, dtype=np.int64).reshape(-1, 3)


def spans_of_keys(scan: Scan, text: str) -> np.ndarray:
    """Rows (key, start, end, length of the key) of the keys of ``scan`` in the text, as source offsets."""
    found = scan.places(match_key(text))
    if not len(found):
        return np.zeros((0, 4), dtype=np.int64)
    back = key_offsets(text)
    return np.column_stack([found[:, 0], back[found[:, 1]], back[found[:, 2] - 1] + 1, found[:, 2] - found[:, 1]])


def contains_key(text: str, value: str) -> bool:
    key = match_key(value)
    return bool(key) and key in match_key(text)


def _glues(c: str) -> bool:
    return "一" <= c <= "鿿" or c.isalnum()


def views(text: str, despaced: bool = True) -> list[View]:
    """The text itself and, if it differs, the text without blanks (never line ends) between letters or digits."""
    found = [View(text, range(len(text)))]
    if despaced:
        kept, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            blank = text[i:j]
            if j == i:
                kept.append(i)
                j = i + 1
            elif not (0 < i and j < len(text) and _glues(text[i - 1]) and _glues(text[j]) and "\n" not in blank and "\r" not in blank):
                kept.extend(range(i, j))
            i = j
        if len(kept) < len(text):
            found.append(View("".join(text[k] for k in kept), tuple(kept)))
    return found


def without_overlaps(found: np.ndarray, size: int) -> np.ndarray:
    """Of rows (start, end, …) in the order of their claims, those that overlap none before them; ``size``: the text's length."""
    taken, kept = bytearray(size), []
    for i, (start, end) in enumerate(found[:, :2].tolist()):
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            kept.append(i)
    return found[kept]


def find_all(text: str, entries: dict[str, str], scan: Scan | None = None) -> list[tuple[int, int, str]]:
    """(start, end, entry) of the registered entries in a text, without overlaps.

    ``entries`` maps entries to what tells them apart; ``scan``: that of their keys, if there. All places of every
    entry on the key view compete; the longest key wins, then the earliest, then the longest source stretch.
    """
    names = list(entries)
    found = spans_of_keys(scan or Scan(map(match_key, names)), text)
    order = np.lexsort((found[:, 0], found[:, 1] - found[:, 2], found[:, 1], -found[:, 3]))
    kept = without_overlaps(found[order][:, [1, 2, 0]], len(text))
    return sorted((start, end, names[i]) for start, end, i in kept.tolist())
