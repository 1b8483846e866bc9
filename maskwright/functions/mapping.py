"""A document's mapping between what is sensitive in it and its tokens."""

from __future__ import annotations

import re
from collections import Counter

from maskwright import constants as C
from maskwright.functions import rules
from maskwright.functions.matching import Scan, find_all, match_key

_NUMBER = re.compile(r"(\d+)】$")


class Mapping:
    """Built once per document; tokens are numbered by category in the order of registration."""

    def __init__(self, enabled=C.DEFAULT, custom=(), excluded=(), previous: dict | None = None, namespace: str = "", despaced: bool = True):
        self.enabled = tuple(dict.fromkeys(c for c in enabled if c in C.CATEGORIES))
        self.despaced = despaced
        self.excluded = frozenset((match_key(t), c) for t, c in excluded)
        self.namespace = "".join(c for c in namespace.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")[:10]
        self.entries: dict[str, str] = {}  # surface form -> token
        self.owner: dict[str, tuple[str, str]] = {}  # token -> (original, category), in use
        self.old: dict[str, tuple[str, str]] = {}  # tokens that only restore
        self.canonical: dict[str, str] = {}
        self._by_key: dict[str, str] = {}
        self._known: dict[tuple[str, str], str] = {}
        self._last: Counter = Counter()
        self._scan: tuple[int, Scan] | None = None
        for token, original in (previous or {}).get("token_to_original", {}).items():
            category = previous.get("token_categories", {}).get(token, "custom")
            self.old[token] = (original, category)
            self._known.setdefault((match_key(original), category), token)
            if m := _NUMBER.search(token):
                self._last[category] = max(self._last[category], int(m[1]))
        for surface, token in (previous or {}).get("original_to_token", {}).items():
            category = previous.get("token_categories", {}).get(token, "custom")
            self._known[(match_key(surface), category)] = token
        for text, category in custom:
            self.register(text, category)

    def register(self, text: str, category: str) -> str | None:
        """The token of a surface form. The first category to claim a form keeps it."""
        text = rules.clean_value(text)
        key = match_key(text)
        if len(text) < 2 or not key or "【" in text or (key, category) in self.excluded:
            return None
        if key in self._by_key:
            return self._by_key[key]
        token = self._known.get((key, category))
        if token is None:
            self._last[category] += 1
            token = f"【{self.namespace}{'-' if self.namespace else ''}{C.CODES[category]}{self._last[category]:03d}】"
        self.entries[text] = self._by_key[key] = token
        self.owner[token] = (text, category)
        return token

    def discover(self, text: str) -> None:
        for f in rules.select(rules.candidates(text, self.enabled, self.despaced), len(text)):
            self.register(f.value, f.category)

    def discover_stem(self, stem: str) -> None:
        self.discover(stem)
        if "person" in self.enabled:
            for pattern in rules.STEM_PATTERNS:
                for m in pattern.finditer(stem):
                    if rules.is_name(m[1]):
                        self.register(m[1], "person")

    def merge(self, canonical: str, aliases: list[str], category: str = "organization") -> str | None:
        """Reviewed aliases take the canonical name's token, and restore to it. Numbers in use don't change."""
        canonical = rules.clean_value(canonical)
        token = self.entries.get(canonical) or self.register(canonical, category)
        for alias in map(rules.clean_value, aliases):
            if token and alias and alias != canonical and (own := self.entries.get(alias) or self.register(alias, category)):
                if own != token and own in self.owner:
                    self.old[own] = self.owner.pop(own)
                self.entries[alias] = self._by_key[match_key(alias)] = token
                self.canonical[alias] = canonical
        if token:
            self.owner[token] = (canonical, category)
        return token

    def suggest(self, text: str) -> list[dict]:
        """Aliases of known organizations that the text uses; people decide on them."""
        if "organization" not in self.enabled or not text:
            return []
        known = [t for t, token in self.entries.items() if self.owner.get(token, ("", ""))[1] == "organization"]
        by_key = {match_key(t): t for t in known}
        series = {match_key(base): (by_key.get(match_key(base), base), ending) for _, _, base, ending in rules.factory_series(text, self.despaced)}
        groups, seen = [], set()
        for full in sorted(known, key=len, reverse=True):
            found = [(a, f"“{a}”符合“{full}”的行业简称规则", 0.92) for a in rules.short_names(full) if any(e == a for _, _, e in find_all(text, {full: "full", a: "alias"}))]
            for stem in rules.factory_stems(full):
                if hit := series.get(match_key(stem)):
                    found.append((hit[0], f"“{hit[0]}”位于顿号并列的后置“{hit[1]}”省略表达中", 0.94))
            for alias, reason, confidence in found:
                if (full, alias) not in seen:
                    seen.add((full, alias))
                    if self.register(alias, "organization"):
                        groups.append({"id": f"organization-{len(groups) + 1}", "category": "organization", "canonical": full, "members": [full, alias], "reason": reason, "confidence": confidence, "accepted": False})
        return groups

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        # entries are only ever added
        if self._scan is None or self._scan[0] != len(self.entries):
            self._scan = (len(self.entries), Scan(map(match_key, self.entries)))
        return find_all(text, self.entries, self._scan[1])

    def mask(self, text: str, filename: bool = False) -> str:
        out, at = [], 0
        for start, end, entry in self.spans(text or ""):
            token = self.entries[entry]
            if filename:
                token_in_name = f"ANON_{token.strip('【】')}"
                self.owner.setdefault(token_in_name, self.owner.get(token, (entry, "custom")))
                token = token_in_name
            out += [text[at:start], token]
            at = end
        return "".join(out) + (text or "")[at:]

    def counts(self) -> dict[str, int]:
        kinds = Counter(self.owner[t][1] for t in set(self.entries.values()))
        return {C.LABELS[c]: n for c, n in kinds.items()}

    def export(self) -> dict:
        both = self.old | self.owner
        return {
            "version": 4,
            "namespace": self.namespace,
            "token_to_original": {t: o for t, (o, _) in both.items()},
            "token_categories": {t: c for t, (_, c) in both.items()},
            "original_to_token": dict(self.entries),
            "alias_to_canonical": dict(self.canonical),
            "active_tokens": sorted(set(self.entries.values())),
        }


def restore(text: str, mapping: dict) -> str:
    """Tokens back to originals, longest first; unknown tokens stay."""
    known = mapping.get("token_to_original") or {}
    if not text or not known:
        return text
    return re.sub("|".join(re.escape(t) for t in sorted(known, key=len, reverse=True)), lambda m: known[m[0]], text)


def relevant(labels: list[tuple[str, str]], text: str, scan: Scan | None = None) -> list[tuple[str, str]]:
    """The labels that a document contains; ``scan``: that of the labels' keys, if there."""
    scan = scan or Scan(match_key(t) for t, _ in labels)
    return [labels[i] for i in sorted(set(scan.places(match_key(text))[:, 0].tolist()))]


#: Categories whose claim to a surface form comes first among model candidates; fixed values.
PRIORITY = {"organization": 5, "product": 4, "location": 3, "address": 2, "person": 1}


def thresholded(found: list[dict], limits: dict[str, float], check=rules.plausible) -> tuple[list[tuple[str, str]], int]:
    """Of model candidates, the best per surface form (category priority, then probability), and how many were turned down."""
    best, order = {}, []
    for x in found:
        value = check(x["text"], x["category"])
        if value is None or x["probability"] < limits.get(x["category"], 1.0):
            continue
        rank = (PRIORITY.get(x["category"], 0), x["probability"])
        if value not in best:
            order.append(value)
        if value not in best or rank > best[value][0]:
            best[value] = (rank, x["category"])
    return [(v, best[v][1]) for v in order], len(found) - len(order)
