"""The engine on single texts: detection, resolution of overlaps, restoring. Plain Python, linear in the text; ``columns`` runs it on Arrow batches.

A span is a tuple (entity_type, start, end, value, confidence, source), a detection (entity_type, start, end, value, is_valid); offsets are
UTF-8 bytes. Defined results: a null text has nothing in it and stays null; empty matches are dropped; equal texts give equal results.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby
from typing import Any

import numpy as np
import regex

from .patterns import DETECTORS, FUZZY_TOKEN, MOCK_ORG, MOCK_PERSON, PRIORITY, REDACTED, TOKEN, VARIANTS

Span = tuple[str, int, int, str, float, str]
Detection = tuple[str, int, int, str, bool]
#: The plug-in point for named-entity recognition: a text to spans; ranges that don't fit the text are dropped.
Recognizer = Callable[[str], Iterable[Span]]


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> Any:
    return regex.compile(pattern)


class Places:
    """From characters to bytes and back."""

    def __init__(self, text: str):
        self.at = None
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self.at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        self.size = len(text) if self.at is None else int(self.at[-1])

    def byte(self, char: int) -> int:
        return char if self.at is None else int(self.at[char])

    def char(self, byte: int) -> int | None:
        """The character that starts at a byte (or the text's end); None inside a character or outside the text."""
        if not 0 <= byte <= self.size:
            return None
        if self.at is None:
            return byte
        k = int(np.searchsorted(self.at, byte))
        return k if self.at[k] == byte else None


def found(text: str, places: Places, pattern: str) -> list[tuple[int, int, str]]:
    """Non-empty matches: start, end, value."""
    at = places.byte
    return [(at(m.start()), at(m.end()), m[0]) for m in compiled(pattern).finditer(text) if m.end() > m.start()]


#: What a text must have for a detector to be tried at all; each is implied by the detector's pattern.
NEEDS = {"INDIAN_PHONE": regex.compile(r"\d{10}"), "EMAIL": regex.compile("@"), "URL": regex.compile("://"), "IPV6": regex.compile(":")}
WORD = regex.compile(r"\S+")


def _emails(text: str, places: Places, pattern: str) -> list[tuple[int, int, str]]:
    """Matches run within words that have an @; others are not tried, which long texts without blanks would make slow."""
    own, out, at, end = compiled(pattern), [], text.find("@"), 0
    while at >= 0:
        word = WORD.search(text, max(end, max(text.rfind(c, 0, at) for c in " \n\t") + 1), len(text))
        while word and word.end() <= at:
            word = WORD.search(text, word.end())
        if not word:
            break
        out += [(places.byte(m.start()), places.byte(m.end()), m[0]) for m in own.finditer(text, word.start(), word.end())]
        end = word.end()
        at = text.find("@", end)
    return out


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(value: str) -> bool:
    """Whether the ASCII digits pass the Luhn check; no digits: false."""
    total, own = 0, _digits(value)
    for k, c in enumerate(reversed(own)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return bool(own) and total % 10 == 0


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """Multiplication in the dihedral group of order 10, row by row, and the eight powers of the check's permutation."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else (a + b - 5) % 5 + 5
        return (a - 5 - b) % 5 + 5 if b < 5 else (a - b) % 5

    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([powers[-1][turn[k]] for k in range(10)])
    return [times(a, b) for a in range(10) for b in range(10)], [x for row in powers for x in row]


PRODUCT, POWER = verhoeff_tables()


def verhoeff(value: str) -> bool:
    """Whether the ASCII digits pass the Verhoeff check; no digits: true."""
    check = 0
    for k, c in enumerate(reversed(_digits(value))):
        check = PRODUCT[check * 10 + POWER[k % 8 * 10 + int(c)]]
    return check == 0


CHECKS: dict[str, Callable[[str], bool]] = {"luhn": luhn, "verhoeff": verhoeff, "always": lambda value: True}


def detections(text: str, names: Sequence[str] = tuple(DETECTORS), places: Places | None = None) -> list[Detection]:
    """All pattern detections with their validity, by detector, then place."""
    places = places or Places(text)
    out: list[Detection] = []
    for name in names:
        pattern, check = DETECTORS[name]
        if name in NEEDS and not NEEDS[name].search(text):
            continue
        own = _emails(text, places, pattern) if name == "EMAIL" else found(text, places, pattern)
        out += [(name, a, b, v, CHECKS[check](v)) for a, b, v in own]
    return out


def regex_spans(text: str, places: Places | None = None) -> list[Span]:
    """Valid detections as spans of source Regex."""
    return [(name, a, b, v, 1.0, "Regex") for name, a, b, v, ok in detections(text, places=places) if ok]


def pattern_spans(text: str, pattern: str, kind: str, source: str, confidence: float = 1.0, places: Places | None = None) -> list[Span]:
    return [(kind, a, b, v, confidence, source) for a, b, v in found(text, places or Places(text), pattern)]


def mock_org(text: str, places: Places | None = None) -> list[Span]:
    return pattern_spans(text, MOCK_ORG, "ORG", "NER", 0.85, places) if "Bank" in text else []


def mock_person(text: str, places: Places | None = None) -> list[Span]:
    return [s for s in pattern_spans(text, MOCK_PERSON, "PERSON", "NER", 0.70, places) if s[3] != "Bank"]


def mock_ner(text: str) -> list[Span]:
    """The mock recognizer: organizations, then every capitalized word but ``Bank``."""
    places = Places(text)
    return mock_org(text, places) + mock_person(text, places)


def valid_span(places: Places, start: int, end: int) -> tuple[int, int] | None:
    """Characters of a byte range, if it is not empty, lies in the text and cuts no character."""
    if not start < end:
        return None
    a, b = places.char(start), places.char(end)
    return None if a is None or b is None else (a, b)


def entity_spans(text: str, entities: str | None, places: Places | None = None) -> list[Span]:
    """Externally found entities (a JSON array of label, start, end, confidence) as spans of source NER; one malformed element voids the list."""
    try:
        rows = json.loads(entities or "")
    except ValueError:
        return []
    if not isinstance(rows, list):
        return []
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    places, out = places or Places(text), []
    for e in rows:
        share = e.get("confidence") if isinstance(e, dict) else None
        share = 1.0 if share is None else share
        if not isinstance(e, dict) or not isinstance(e.get("label"), str) or not whole(e.get("start")) or not whole(e.get("end")) or isinstance(share, bool) or not isinstance(share, (int, float)):
            return []
        if at := valid_span(places, e["start"], e["end"]):
            out.append((e["label"], e["start"], e["end"], text[at[0] : at[1]], float(share), "NER"))
    return out


def recognized(text: str, recognizer: Recognizer, places: Places) -> list[Span]:
    """A recognizer's spans that fit the text."""
    return [s for s in recognizer(text) if valid_span(places, s[1], s[2])]


def merge(own: Iterable[Span]) -> list[Span]:
    """Of each chain of overlapping spans the best one: longest, then source, then start, then end, then type."""
    keyed = sorted(((s[1], -s[2], -PRIORITY.get(s[5], 0), s[0]), s) for s in own if s[1] < s[2])
    out: list[tuple[Any, Span]] = []
    edge = -1
    for _, s in keyed:
        rank = (s[1] - s[2], -PRIORITY.get(s[5], 0), s[1], -s[2], s[0])
        if s[1] < edge:
            if rank < out[-1][0]:
                out[-1] = (rank, s)
            edge = max(edge, s[2])
        else:
            out.append((rank, s))
            edge = s[2]
    return [s for _, s in out]


def not_contained(own: Sequence[Any], start: int = 1, end: int = 2) -> list[Any]:
    """Spans (with their offsets at these places) that no other strictly contains, in their order; equal spans stay."""
    order = sorted(range(len(own)), key=lambda k: (own[k][start], -own[k][end]))
    good, edge = [], -1
    for _, same in groupby(order, key=lambda k: (own[k][start], own[k][end])):
        same = list(same)
        if own[same[0]][end] > edge:
            good += same
        edge = max(edge, own[same[0]][end])
    return [own[k] for k in sorted(good)]


def greedy(own: Sequence[Any], size: int, start: int = 1, end: int = 2) -> list[Any]:
    """Without contained spans: from right to left, of equal starts the later one first, each that ends before the last one taken starts."""
    out, edge = [], size
    for s in reversed(sorted(not_contained(own, start, end), key=lambda s: s[start])):
        if s[end] <= edge:
            out.append(s)
            edge = s[start]
    return out[::-1]


def stitch(text: str, replacements: Iterable[tuple[int, int, str]]) -> str:
    """``text`` with disjoint byte ranges, in order, replaced; ranges that don't fit are skipped."""
    data, at, out = text.encode(), 0, []
    for start, end, sub in replacements:
        if at <= start <= end <= len(data):
            out += [data[at:start], sub.encode()]
            at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def variant_matches(text: str, name: str) -> list[str]:
    """Strings that the variant detectors return; Aadhaar numbers are cleaned and checked."""
    own = [m[0] for m in compiled(VARIANTS[name]).finditer(text)]
    return [d for d in map(_digits, own) if len(d) == 12 and verhoeff(d)] if name == "AADHAAR" else own


def redact(text: str, mark: str = "X") -> str:
    """Four patterns one after the other, each match overwritten by as many marks as it has bytes."""
    for pattern in REDACTED:
        if "@" not in pattern or "@" in text:
            text = compiled(pattern).sub(lambda m: mark * len(m[0].encode()), text)
    return text


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Maximal runs without white space."""
    return found(text, Places(text), TOKEN)


def chunks(text: str, size: int, overlap: int, own: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[int, int, int, str]]:
    """first token, token after the last, first byte, text of each chunk; the last chunk is the first one that reaches the end."""
    own = tokens(text) if own is None else own
    data, step, at = text.encode(), max(size - overlap, 1), 0
    while size > 0 and own:
        end = min(at + size, len(own))
        yield at, end, own[at][0], data[own[at][0] : own[end - 1][1]].decode()
        if end == len(own):
            return
        at += step


def threshold(sub: str) -> int:
    return max(len(sub.encode()) // 8, 2)


def compatible(kind: str, token: str, sub: str) -> bool:
    """Whether a token may stand for a substitute of this type."""
    if kind == "AADHAAR":
        return len(_digits(token)) == len(token) and len(_digits(sub)) == len(sub) and 10 <= len(token.encode()) <= 14
    if kind == "PAN":
        return len(sub.encode()) == 10 and len(token.encode()) <= 12 and sum(c.isascii() and c.isalpha() for c in token) >= 4
    if kind == "PHONE":
        return len(_digits(token)) >= 8
    return kind not in ("NAME", "PERSON") or any(c.isascii() and c.isalpha() for c in token)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or a number above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        before, row[0] = row[low - 1], i
        if low > 1:
            row[low - 1] = most + 1
        best = row[0] if low == 1 else most + 1
        for j in range(low, high + 1):
            up = row[j] if j < i + most else most + 1
            value = before if x == b[j - 1] else 1 + min(before, up, row[j - 1])
            before, row[j] = row[j], value
            best = min(best, value)
        if best > most:
            return most + 1
    return row[-1]


def _pieces(n: int, k: int) -> list[tuple[int, int]]:
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


class Pairs:
    """The pairs (substitute, original, type) of one session, and what they restore.

    Exact: one pair after the other, longest substitute (bytes) first, then by text. Only pairs whose rarest gram the text has, at the
    start or after a replacement, are tried. Fuzzy: a substitute is cut into more than d pieces; a token within d edits has any d + 1 of them but d
    in place, give or take d, so an index of each one's d + 1 rarest pieces finds all candidates.
    """

    GRAM, FEW = 4, 512

    def __init__(self, pairs: Iterable[tuple[str, str, str]]):
        self.pairs = sorted({(-len(s.encode()), s, o, k) for s, o, k in pairs if s})
        grams = Counter(g for _, s, _, _ in self.pairs for g in {s[i : i + self.GRAM] for i in range(max(1, len(s) - self.GRAM + 1))})
        self.by: dict[str, list[int]] = defaultdict(list)
        for rank, (_, sub, _, _) in enumerate(self.pairs):
            self.by[min((sub[i : i + self.GRAM] for i in range(max(1, len(sub) - self.GRAM + 1))), key=lambda g: (grams[g], g))].append(rank)

    @cached_property
    def pieces(self) -> tuple[dict[tuple[int, int, int, str], list[int]], dict[int, set[tuple[int, int]]]]:
        """Pairs by their rarest pieces, and by length the bounds and numbers of pieces there are."""
        cuts = Counter(x for _, sub, _, _ in self.pairs for k in self._cuts(sub) for x in self._keys(sub, k))
        by: dict[tuple[int, int, int, str], list[int]] = defaultdict(list)
        sizes: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for rank, (_, sub, _, _) in enumerate(self.pairs):
            most = threshold(sub)
            rarest = [sorted(self._keys(sub, k), key=lambda x: (cuts[x], x))[: most + 1] for k in self._cuts(sub)]
            chosen = min(rarest, key=lambda own: sum(cuts[x] for x in own))
            sizes[len(sub)].add((most, chosen[0][1]))
            for x in chosen:
                by[x].append(rank)
        return by, sizes

    @staticmethod
    def _cuts(sub: str) -> set[int]:
        return {threshold(sub) + 1, max(threshold(sub) + 1, len(sub) // 3)}

    @staticmethod
    def _keys(sub: str, k: int) -> list[tuple[int, int, int, str]]:
        return [(len(sub), k, i, sub[a:b]) for i, (a, b) in enumerate(_pieces(len(sub), k))]

    def _ranks(self, texts: Iterable[str], known: set[str]) -> set[int]:
        grams = {t[i : i + n] for t in texts for n in range(1, self.GRAM + 1) for i in range(len(t) - n + 1)} - known
        known |= grams
        return {r for g in grams & self.by.keys() for r in self.by[g]}

    def exact(self, text: str) -> str:
        if len(self.pairs) <= self.FEW:  # the same, without an index
            for _, sub, original, _ in self.pairs:
                text = text.replace(sub, original)
            return text
        known: set[str] = set()
        todo = list(self._ranks([text], known))
        heapify(todo)
        done = -1
        while todo:
            rank = heappop(todo)
            _, sub, original, _ = self.pairs[rank]
            if rank > done and sub in text:
                parts, around, at = text.split(sub), [], 0
                text = original.join(parts)
                for part in parts[:-1]:
                    at += len(part)
                    around.append(text[max(0, at - self.GRAM + 1) : at + len(original) + self.GRAM - 1])
                    at += len(original)
                for more in self._ranks(around, known):
                    heappush(todo, more)
            done = max(done, rank)
        return text

    def nearest(self, token: str) -> tuple[str, str] | None:
        """Substitute and original of the pair nearest to a token; longer substitutes first, then by text."""
        best: tuple[int, int, str, str] | None = None
        seen: set[int] = set()
        by, sizes = self.pieces
        for n, limits in sizes.items():
            for most, k in limits:
                if abs(n - len(token)) > most:
                    continue
                for i, (a, b) in enumerate(_pieces(n, k)):
                    for at in range(max(0, a - most), min(len(token) - (b - a), a + most) + 1):
                        for rank in by.get((n, k, i, token[at : at + b - a]), ()):
                            if rank not in seen:
                                seen.add(rank)
                                size, sub, original, kind = self.pairs[rank]
                                if abs(len(token.encode()) + size) <= most and compatible(kind, token, sub) and 0 < (d := distance(token, sub, most)) <= most:
                                    best = min(best or (d, size, sub, original), (d, size, sub, original))
        return best and best[2:]

    def fuzzy(self, exact: str) -> list[tuple[int, int, str, str]]:
        """start, end (characters), substitute, original of each token that is near a substitute."""
        if not self.pairs:
            return []
        own = ((m, self.nearest(m[0])) for m in compiled(FUZZY_TOKEN).finditer(exact))
        return [(m.start(), m.end(), *hit) for m, hit in own if hit]


def revealed(exact: str, hits: Sequence[tuple[int, int, str, str]]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with fuzzy hits restored, and their UTF-16 offsets in it with substitute and original."""
    wide = lambda s: len(s.encode("utf-16-le")) // 2
    out, spans, at, place = [], [], 0, 0
    for a, b, sub, original in hits:
        place += wide(exact[at:a])
        out += [exact[at:a], original]
        spans.append((place, place + wide(original), sub, original))
        place, at = place + wide(original), b
    return "".join([*out, exact[at:]]), spans
