"""Quality rules: document statistics and learned decision lists as ordered Spark conditional expressions. Native.

The learner is sequential covering: grow a conjunction of threshold tests on half of the labelled rows by information
gain, prune it on the other half, keep it if its precision there is high enough, remove what it covers, repeat. It works on
quantile cuts of the statistics, with rows as bits of integers. The result is an ordered list of conjunctions, emitted
as one CASE expression: rows that meet a rule are dropped, others are kept.

Labelled rows for learning: at most ``sample`` documents of the labels, those with the smallest hashes; all statistics and
all verdicts cover whole texts of all documents.

Defined results: null and empty texts have no words and fail the base rules (fewer than 20 words); statistics that are
null count as 0; documents without labels are only judged, not learned from; without labels of both kinds there is no
rule and the base decides; repeated rows and labels are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_rows, text_or_empty

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Statistics that rules may test; ratios, so that lengths don't stand in for quality.
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "distinct_ratio", "upper_ratio", "digit_ratio", "end_ratio")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of the base rules and FEATURES, in one narrow pass."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", BLANK, -1), ""))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), "hashes", lines.alias("lines"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", "[0-9]+", ""))).alias("n_digits"),
        (F.length("text") - F.length(F.translate("text", ".!?", ""))).alias("n_ends"),
    )
    d = d.withColumn("windows", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int")), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    d = d.withColumn("n_distinct", F.size(F.array_distinct("hashes"))).drop("lines", "hashes")
    # Windows found twice: sort (hash, start), keep those equal to a neighbour, then add up what their starts cover.
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.when(F.size("windows") > F.size(F.array_distinct("windows")), pairs)
    d = d.withColumn("sorted", repeated).drop("windows")
    same = lambda a, b: F.coalesce(F.get("sorted", a)["h"] == F.get("sorted", b)["h"], F.lit(False))
    marked = F.transform("sorted", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
    d = d.withColumn("starts", F.array_sort(F.array_compact(marked))).drop("sorted")
    gaps = F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")
    # The row number keeps the optimizer from moving a caller's filter below, where these arrays would be made anew for each of their elements.
    d = d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, total)).drop("starts")
    per = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return d.withColumns({
        "symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_words"), "repeat_ratio": per("n_repeat_words", "n_words"),
        "mean_word": per("word_chars", "n_words"), "distinct_ratio": per("n_distinct", "n_words"), "upper_ratio": per("n_upper", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"), "end_ratio": per("n_ends", "n_words"),
    }).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Test:
    """One threshold test: feature >= cut, or feature < cut."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.above else F.col(self.feature) < self.cut

    def holds(self, row: dict[str, Any]) -> bool:
        return (row[self.feature] >= self.cut) == self.above


def _gain(bad0: int, all0: int, bad1: int, all1: int) -> float:
    if bad1 == 0 or bad0 == 0:
        return -1.0
    return bad1 * (math.log2(bad1 / all1) - math.log2(bad0 / all0))


def learn(rows: list[dict[str, Any]], features: tuple[str, ...] = FEATURES, cuts: int = 64, most_rules: int = 12, precision: float = 0.9, least: int = 3) -> list[list[Test]]:
    """Ordered conjunctions that pick rows with ``bad`` = 1; row k is used for growing if k is even, for pruning if odd."""
    rows = sorted(rows, key=lambda r: tuple(r[f] for f in (*features, "bad")))
    tests: list[tuple[Test, int]] = []
    for f in features:
        values = sorted({r[f] for r in rows})
        chosen = values if len(values) <= cuts else sorted({values[k * (len(values) - 1) // cuts] for k in range(cuts + 1)})
        for cut in chosen[1:]:
            mask = sum(1 << k for k, r in enumerate(rows) if r[f] >= cut)
            tests += [(Test(f, True, cut), mask), (Test(f, False, cut), ~mask & ((1 << len(rows)) - 1))]
    bad = sum(1 << k for k, r in enumerate(rows) if r["bad"])
    grow = sum(1 << k for k in range(0, len(rows), 2))
    left = (1 << len(rows)) - 1
    masks = dict(tests)
    rules: list[list[Test]] = []
    while len(rules) < most_rules and (bad & left & grow):
        rule: list[Test] = []
        covered = left & grow
        while (covered & ~bad) and len(rule) < 4:
            b0, a0 = (covered & bad).bit_count(), covered.bit_count()
            best = max(tests, key=lambda t: _gain(b0, a0, (covered & bad & t[1]).bit_count(), (covered & t[1]).bit_count()), default=None)
            if best is None or _gain(b0, a0, (covered & bad & best[1]).bit_count(), (covered & best[1]).bit_count()) <= 0:
                break
            rule.append(best[0])
            covered &= best[1]

        def on(tests_: list[Test], rows_: int) -> tuple[int, int]:
            for t in tests_:
                rows_ &= masks[t]
            return (rows_ & bad).bit_count(), rows_.bit_count()

        def worth(tests_: list[Test]) -> float:
            b, a = on(tests_, left & ~grow)
            return (b - (a - b)) / a if a else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        b, a = on(rule, left)
        held_b, held_a = on(rule, left & ~grow)
        if not rule or b < least or b < precision * a or (held_a and held_b < precision * held_a):
            break
        rules.append(rule)
        for t in rule:
            covered &= masks[t]
        gone = left
        for t in rule:
            gone &= masks[t]
        left &= ~gone
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The decision list as one ordered conditional: false for rows that a rule drops, else true."""
    out: Any = F
    for rule in rules:
        both = rule[0].column()
        for t in rule[1:]:
            both = both & t.column()
        out = out.when(both, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[list[Test]]:
    """Rules from the documents whose label is 0 against those whose label is 1."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.join(F.broadcast(own.select(F.col("doc_id").alias(id_col))), id_col, "left_semi")
    rows = small_rows(statistics(few, id_col, text_col).join(F.broadcast(own), "doc_id").dropDuplicates(["doc_id"]).select("label", "base_failed", *FEATURES), sample)
    return learn([{f: r[f] for f in FEATURES} | {"bad": int(r["label"] == 0)} for r in rows if not r["base_failed"]])


def judge(docs: DataFrame, rules: list[list[Test]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All statistics, base_failed and kept."""
    return statistics(docs, id_col, text_col).withColumn("kept", ~F.col("base_failed") & verdict(rules))


#: The rows of the base statistics in DuckDB: every window of every text as a row.
ORACLE_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
    s AS (SELECT r, i, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM w) WHERE c > 1),
    t AS (SELECT r, sum(n) AS n FROM s GROUP BY r),
    f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN t ON d.r = t.r)
    SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f"""
