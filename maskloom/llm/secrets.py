"""Secret scans: base patterns, and formats inferred as probabilistic automata from labelled credentials.

Labelled credentials are the values that the base patterns find (label: the pattern's kind) and, if given, a table of further ones; at
most SAMPLE distinct ones a kind, those with the least hashes of the whole table. They are dealt by alphabet, and each alphabet's values
are one format. Part of them (by hash) is held back. Of the others a prefix tree is grown from the root; a state is the multiset of
suffixes that pass through it. Two states are compatible if, on at least EVIDENCE suffixes each, neither the remaining lengths (largest gap of
the distribution functions) nor the characters in the next AHEAD places differ by more than a Hoeffding margin, and the shortest and longest lengths agree. States are merged breadth first:
each new state with the first compatible one. Children with less evidence cannot tell: those of one state are
taken as one. So length, fixed parts and places stay where the data show them. The merged automaton gives a string a probability; what a state has
not seen of a class of characters that it has seen gets the share that its variety suggests (Witten-Bell).

Every token of the text that could be a credential is scored by all automata, per character, and so is every range of its parts between separators;
it is a secret of kind ``format`` if some automaton gives it at least what that automaton gives nearly all of the values held back.
Of the ranges of a token disjoint ones with most characters in all are kept. Base spans stay as they are; format spans don't overlap them.

All ranges of a token are scored in one pass: ranges that have come to the same state go on together, and of those only the ones
that no other exceeds in both likelihood and characters.

Defined results: null and empty texts have no spans; without labelled credentials there are no format spans; repeated rows have
equal spans; offsets are code points; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare

SAMPLE, ALPHA, LOWEST, EVIDENCE, AHEAD, LABELLED, STATES, RARE = 300, 0.05, 0.02, 20, 4, 10, 512, 0.01
KINDS = ("assign", "access", "hex", "format")
#: Fixed values of the contract.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may be a credential: a token of 16 or more of these characters with a letter and a digit.
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: Parts of a token: what lies between separators, without marks at its ends.
PART = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+_-]*[A-Za-z0-9])?")
LEAST = 16
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, number of the kind, end, value of the base patterns' matches."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


#: Classes of characters: what a state has seen of one makes the rest of it likely. Alphabets of formats, narrowest first.
CLASSES = ("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ")
CLASS = {c: k for k, own in enumerate(CLASSES) for c in own}
ALPHABETS = tuple((name, re.compile(f"[{own}]+")) for name, own in (("digits", "0-9"), ("hex", "0-9a-f"), ("HEX", "0-9A-F"), ("lower", "0-9a-z"), ("upper", "0-9A-Z"), ("mixed", "0-9A-Za-z"), ("marked", "0-9A-Za-z+/_=.-")))


def alphabet(value: str) -> str:
    """The narrowest alphabet that has all of the value's characters."""
    return next((name for name, own in ALPHABETS if own.fullmatch(value)), "other")


@dataclass
class Automaton:
    """step[state][character] = (next state, log probability); stop[state] = log probability of ending there."""

    step: list[dict[str, tuple[int, float]]]
    stop: list[float]
    least: float = -math.inf

    def score(self, value: str) -> float:
        """Log probability per character; minus infinity outside the language."""
        state, total = 0, 0.0
        for c in value:
            to = self.step[state].get(c)
            if to is None:
                return -math.inf
            state = to[0]
            total += to[1]
        return (total + self.stop[state]) / (len(value) + 1)


Suffixes = list[tuple[int, int]]


class _Merger:
    """Breadth-first merging; a state is the list of (value, place) of the suffixes that pass through it."""

    def __init__(self, values: list[str], alpha: float):
        self.values, self.margin = values, math.sqrt(0.5 * math.log(2 / alpha))
        self.states: list[Suffixes] = []
        self.seen: list[tuple[list[int], list[Counter[str]]]] = []

    def facts(self, own: Suffixes) -> tuple[list[int], list[Counter[str]]]:
        """Remaining lengths in order, and the characters of each of the next places (empty: the end)."""
        left = sorted(len(self.values[v]) - at for v, at in own)
        return left, [Counter(self.values[v][at + k : at + k + 1] for v, at in own) for k in range(AHEAD)]

    @staticmethod
    def beyond(a: list[int], b: list[int]) -> float:
        """How likely lengths of one law leave each other's ends that empty; places that are one apart differ there first."""
        low = (1 - bisect_left(a, b[0]) / len(a)) ** len(b) * (1 - bisect_left(b, a[0]) / len(b)) ** len(a)
        return low * (bisect_right(a, b[-1]) / len(a)) ** len(b) * (bisect_right(b, a[-1]) / len(b)) ** len(a)

    def compatible(self, a: tuple[list[int], list[Counter[str]]], b: tuple[list[int], list[Counter[str]]]) -> bool:
        m, n = len(a[0]), len(b[0])
        if min(m, n) < EVIDENCE:
            return False
        margin = self.margin * (1 / math.sqrt(m) + 1 / math.sqrt(n))
        if self.beyond(a[0], b[0]) < RARE:
            return False
        if any(abs(bisect_right(a[0], x) / m - bisect_right(b[0], x) / n) > margin for x in {*a[0], *b[0]}):
            return False
        return all(abs(p[c] / m - q[c] / n) <= margin for p, q in zip(a[1], b[1], strict=True) for c in p.keys() | q.keys())

    def children(self, own: Suffixes) -> list[tuple[set[str], Suffixes]]:
        """Suffixes one character on: for each character, or together for those without enough of them."""
        by: dict[str, Suffixes] = {}
        for v, at in own:
            if at < len(self.values[v]):
                by.setdefault(self.values[v][at], []).append((v, at + 1))
        out = [({c}, x) for c, x in sorted(by.items()) if len(x) >= EVIDENCE]
        few = [(c, x) for c, x in sorted(by.items()) if len(x) < EVIDENCE]
        if few:
            out.append(({c for c, _ in few}, [s for _, x in few for s in x]))
        return out

    def run(self) -> list[dict[str, int]]:
        """The next state by character of each state."""
        first = [(v, 0) for v in range(len(self.values))]
        self.states, self.seen, step = [first], [self.facts(first)], [{}]
        at = 0
        while at < len(self.states):
            for chars, own in self.children(self.states[at]):
                facts = self.facts(own)
                to = next((k for k, other in enumerate(self.seen) if self.compatible(other, facts)), None)
                if to is None and len(own) < EVIDENCE and at and len(self.states[at]) < EVIDENCE:
                    to = at  # too few to tell one place from the next: one state for the rest
                if to is None and len(self.states) >= STATES:
                    to = at  # likewise beyond so many places: values of any length are learned from whole
                if to is None:
                    to = len(self.states)
                    self.states.append(own)
                    self.seen.append(facts)
                    step.append({})
                step[at].update(dict.fromkeys(chars, to))
            at += 1
        return step


def infer(values: list[str], alpha: float = ALPHA, lowest: float = LOWEST) -> Automaton:
    """A probabilistic automaton by merging compatible states of the prefix tree; every fifth value (by hash) only sets the threshold."""
    own = sorted(set(values))
    held = [v for v in own if zlib.crc32(v.encode()) % 5 == 0] if len(own) >= 5 * 5 else []
    train = sorted(set(own) - set(held)) or own
    step = _Merger(train, alpha).run()
    # Probabilities from all training values' ways through the merged automaton.
    count: list[Counter[str]] = [Counter() for _ in step]
    for v in train:
        at = 0
        for c in v:
            if c not in step[at]:  # a state that was merged into another has not taught it this character
                step[at][c] = max(step[at].values(), default=at)
            count[at][c] += 1
            at = step[at][c]
        count[at][""] += 1
    steps, stop = [], []
    for to, n in zip(step, count, strict=True):
        total, kinds = sum(n.values()), len(n)
        known = {CLASS[c] for c in n if c in CLASS}
        fresh = sorted(c for k in known for c in CLASSES[k] if c not in n)
        whole = total + (kinds if fresh else 0)
        moves = {c: (to[c], math.log(x / whole)) for c, x in n.items() if c}
        for c in fresh:
            near = max((x for x in n if x and CLASS.get(x) == CLASS[c]), key=lambda x: (n[x], x))
            moves[c] = (to[near], math.log(kinds / whole / len(fresh)))
        steps.append(moves)
        stop.append(math.log(n[""] / whole) if n[""] else -math.inf)
    out = Automaton(steps, stop)
    scores = sorted(out.score(v) for v in held or own)
    out.least = scores[int(len(scores) * lowest)] - 0.05
    return out


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, labelled: DataFrame | None = None) -> dict[str, Automaton]:
    """An automaton for each alphabet with at least LABELLED credentials; ``labelled`` (kind, value) adds to those that the base patterns find."""
    prepare(docs.sparkSession)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(KINDS[k], v) for text in batch.column(0).to_pylist() if text for _, k, _, v in base_spans(text)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    own = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(values, "kind string, value string")
    if labelled is not None:
        own = own.unionByName(labelled.where("kind is not null and value <> ''").select(F.col("kind").cast("string").alias("kind"), F.col("value").cast("string").alias("value")))
    own = own.withColumn("h", F.xxhash64("value"))
    # Least hashes first within salted parts, then among the parts' best: no kind gathers in one task.
    part = own.distinct().withColumn("part", F.pmod("h", F.lit(64)))
    near = part.withColumn("k", F.row_number().over(Window.partitionBy("kind", "part").orderBy("h", "value"))).where(F.col("k") <= sample)
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))).where(F.col("k") <= sample)
    by: dict[str, set[str]] = {}
    for r in best.select("value").collect():  # at most ``sample`` rows a kind
        by.setdefault(alphabet(r["value"]), set()).add(r["value"])
    return {k: infer(sorted(v)) for k, v in sorted(by.items()) if len(v) >= LABELLED}


class _Ranges:
    """Ranges of parts that have come to the same state, by their first part."""

    def __init__(self) -> None:
        self.past = 0.0  # what all have gathered since they are together
        self.early: deque[tuple[int, int, float]] = deque()  # too short or without a letter or a digit so far, by start
        self.front: list[tuple[int, float, int]] = []  # (-gain, excess, first part): less gain, more excess

    def add(self, loss: int, excess: float, first: int) -> None:
        at = bisect_right(self.front, loss, key=lambda x: x[0])
        if at and self.front[at - 1][1] >= excess:
            return
        end = at
        while end < len(self.front) and self.front[end][1] <= excess:
            end += 1
        self.front[at:end] = [(loss, excess, first)]

    def join(self, other: _Ranges) -> None:
        shift = other.past - self.past
        if len(other.front) + len(other.early) > len(self.front) + len(self.early):
            self.past, other.past, shift = other.past, self.past, -shift
            self.front, other.front = other.front, self.front
            self.early, other.early = other.early, self.early
        moved = [(first, loss, excess + shift) for first, loss, excess in other.early]
        if not moved or not self.early or self.early[-1] < moved[0]:
            self.early.extend(moved)
        elif moved[-1] < self.early[0]:
            self.early.extendleft(reversed(moved))
        else:
            self.early = deque(sorted([*self.early, *moved]))
        for loss, excess, first in other.front:
            self.add(loss, excess + shift, first)


def best_ranges(run: str, parts: list[tuple[int, int]], automata: list[Automaton]) -> list[tuple[int, int]]:
    """Disjoint ranges of neighbouring parts that some automaton takes, with most characters in all; start and end in the run."""
    n = len(parts)
    ready = [len(run) + 1] * (n + 1)  # where a range from each part on has a letter, a digit and LEAST characters
    digit = letter = len(run) + 1
    for i in range(n - 1, -1, -1):
        a, b = parts[i]
        found, other = DIGIT.search(run, a, b), LETTER.search(run, a, b)
        digit, letter = found.end() if found else digit, other.end() if other else letter
        ready[i] = max(digit, letter, a + LEAST)
    cover, chosen = [0] * (n + 1), [-1] * (n + 1)
    live: list[dict[int, _Ranges]] = [{} for _ in automata]
    last = 0
    for j, (a, b) in enumerate(parts):
        cover[j + 1] = cover[j]
        for number, x in enumerate(automata):
            groups = live[number]
            for at in range(last, b):
                if at == a:
                    fresh = _Ranges()
                    fresh.early.append((j, a - cover[j], 0.0))
                    if 0 in groups:
                        groups[0].join(fresh)
                    else:
                        groups[0] = fresh
                if not groups:
                    continue
                moved: dict[int, _Ranges] = {}
                for state, group in groups.items():
                    to = x.step[state].get(run[at])
                    if to is not None:
                        group.past += to[1] - x.least
                        if to[0] in moved:
                            moved[to[0]].join(group)
                        else:
                            moved[to[0]] = group
                groups = moved
            live[number] = groups
            for state, group in groups.items():
                while group.early and ready[group.early[0][0]] <= b:
                    first, loss, excess = group.early.popleft()
                    group.add(loss, excess, first)
                at = bisect_left(group.front, x.least - x.stop[state] - group.past, key=lambda r: r[1])
                if at < len(group.front) and b - group.front[at][0] > cover[j + 1]:
                    cover[j + 1], chosen[j + 1] = b - group.front[at][0], group.front[at][2]
        last = b
    out, j = [], n
    while j:
        if chosen[j] < 0:
            j -= 1
        else:
            out.append((parts[chosen[j]][0], parts[j - 1][1]))
            j = chosen[j]
    return out[::-1]


def all_spans(text: str, automata: dict[str, Automaton]) -> list[tuple[int, int, int]]:
    """start, number of the kind, end of all spans, in order."""
    base = base_spans(text)
    spans = [(a, k, b) for a, k, b, _ in base]
    if automata:
        models, at = list(automata.values()), 0
        taken: list[list[int]] = []  # base spans, joined where they overlap
        for a, _, b in spans:
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        for m in TOKEN.finditer(text):
            if not (DIGIT.search(m[0]) and LETTER.search(m[0])):
                continue
            start, free = m.start(), [[]]
            for p in PART.finditer(m[0]):
                while at < len(taken) and taken[at][1] <= start + p.start():
                    at += 1
                if at < len(taken) and taken[at][0] < start + p.end():
                    free.append([])
                elif free[-1] and at and taken[at - 1][0] >= start + free[-1][-1][1]:
                    free.append([p.span()])  # a base span of separators only lies between
                else:
                    free[-1].append(p.span())
            for parts in free:
                if parts and parts[-1][1] - parts[0][0] >= LEAST:
                    offset, end = parts[0][0], parts[-1][1]
                    own = [(a - offset, b - offset) for a, b in parts]
                    spans += [(start + offset + a, 3, start + offset + b) for a, b in best_ranges(m[0][offset:end], own, models)]
    return sorted(spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by a mark that names the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, automata: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans (kind:start:end, comma-joined). Narrow: no shuffle."""
    prepare(docs.sparkSession)
    kind = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_format bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[Any]] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                found = all_spans(text, automata) if text else []
                for k in range(4):
                    out[k].append(sum(x[1] == k for x in found))
                names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                out[4].append(hashlib.sha256(",".join(n for n, x in zip(names, found, strict=True) if x[1] < 3).encode()).hexdigest())
                out[5].append(",".join(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def redact(docs: DataFrame, automata: dict[str, Automaton], text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced; other columns stay."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, all_spans(t, automata)) if t else t for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def _oracle_sql() -> str:
    """The base rows in DuckDB: matches and the gaps between them give the offsets."""
    own = {"assign": ASSIGN.pattern, "access": ACCESS.pattern, "hex": HEX.pattern}
    keep = {"assign": "length(regexp_extract(v, '{0}', 2)) >= 6", "access": "length(v) >= 20", "hex": "true"}
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    parts = []
    for k, (kind, pattern) in enumerate(own.items()):
        p = pattern.replace("'", "''")
        found = f"SELECT r, m[i] AS v, CAST({total('g[1:i]')} + {total('m[1:i - 1]')} AS BIGINT) AS a FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d))"
        parts.append(f"SELECT r, {k} AS k, '{kind}' AS kind, a, a + length(v) AS b FROM ({found}) WHERE {keep[kind].format(p)}")
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)})
        SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        sha256(coalesce(string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, k) FILTER (k IS NOT NULL), '')) AS base_sha256 FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, doc_id"""


ORACLE_SQL = _oracle_sql()
