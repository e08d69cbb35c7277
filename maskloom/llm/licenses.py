"""License scans: base phrases, and an exact set-similarity join of text blocks with notice templates. Native.

A block is a line; its set is its distinct words. A template matches a block when the block contains at least
THRESHOLD of the template's distinct words. Words of all templates are ordered by their document frequency in the whole
table, rarest first. A match needs one of the template's first |T| - need + 1 words (prefix filter), a block with
``need`` words of the vocabulary (length filter), and, at the first common word, enough words after it in both orders
(positional filter); what survives is counted exactly. Templates are a parameter, so the index is a literal in the
plan; blocks never leave their row, so nothing is shuffled but the vocabulary's counts.

Notices wrapped over lines are found with ``windows``: then every window of the text's words, SLACK times as long as the template, is a
block too, whatever lines it crosses. A matching window holds a word of the template's prefix, so only windows around those are counted.

Defined results: null and empty texts have no words, no labels, null positions and score 0; repeated rows and ties give
equal results; very long lines are sets like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed values of the contract: phrase and label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices in common use, by label; a parameter of the operator.
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "gpl-3": ["licensed under the gnu general public license version 3", "free software redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under the creative commons attribution 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved no part may be reproduced without permission"],
}
THRESHOLD = 0.9
#: Words of a window for each word of the template; the rest may be other words, such as comment marks.
SLACK = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaced(lowered: Column) -> Column:
    """Words with one space between and around them; two spaces if there is no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATORS, " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def vocabulary_order(docs: DataFrame, words: list[str], text_col: str) -> list[str]:
    """Template words by document frequency over the whole table, rarest first; ties by the word."""
    spaced = docs.select(_spaced(F.translate(text_or_empty(text_col), UPPER, LOWER)).alias("s"))
    counts = spaced.select(F.explode(F.array_intersect(_strings(words), F.split("s", " "))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}  # at most one row for each word of the templates
    return sorted(words, key=lambda w: (found.get(w, 0), w))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, score of each template found).

    Blocks are lines and, with ``windows``, also windows of words across lines.
    """
    vocabulary = vocabulary_order(docs, sorted({w for ts in templates.values() for t in ts for w in t.split()}), text_col)
    rank = {w: k for k, w in enumerate(vocabulary)}
    index = []
    for label, texts in templates.items():
        for t in texts:
            words = sorted(set(t.split()), key=rank.__getitem__)
            index.append((label, words, math.ceil(threshold * len(words) - 1e-9), SLACK * len(t.split())))
    prefix = sorted({w for _, words, need, _ in index for w in words[: len(words) - need + 1]})

    doc = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.translate(text_or_empty(text_col), UPPER, LOWER).alias("low"))
    doc = doc.withColumn("s", _spaced(F.col("low")))
    doc = doc.withColumn("n_words", F.when(F.col("s") == "  ", F.lit(0)).otherwise(_spaces(F.col("s")) - 1).cast("bigint"))
    parts = {f"p{k}": F.when(F.col("s").contains(f" {p} "), F.split("s", f" {p}(?= )", -1)) for k, p in enumerate(phrases)}
    doc = doc.withColumns(parts)
    lines = F.filter(F.split("low", "\n", -1), lambda x: x.rlike("(?:" + "|".join(map(re.escape, prefix)) + ")")) if prefix else F.array().cast("array<string>")
    doc = doc.withColumn("blocks", F.array_distinct(F.transform(lines, lambda x: F.array_intersect(_strings(vocabulary), F.split(_spaced(x), " ")))))
    if windows and prefix:
        most = max(width for *_, width in index)
        near = F.transform("ws", lambda w, i: F.when(w.isin(prefix), F.slice("ws", F.greatest(i - (most - 2), F.lit(1)), 2 * most - 1)))
        few = min(need for _, _, need, _ in index)
        doc = doc.withColumn("ws", F.split("s", " "))
        doc = doc.withColumn("around", F.filter(near, lambda c: c.isNotNull() & (F.size(F.array_intersect(_strings(vocabulary), c)) >= few)))
        doc = doc.drop("ws")
    doc = doc.drop("low", "s")

    def widest(words: list[str], need: int, width: int) -> Column:
        """The share of the best window, null if none has ``need`` words."""
        own = lambda c: F.size(F.array_intersect(_strings(words), c))
        starts = lambda c: F.sequence(F.lit(1), F.greatest(F.size(c) - width + 1, F.lit(1)))
        counted = F.transform(F.filter("around", lambda c: own(c) >= need), lambda c: F.array_max(F.transform(starts(c), lambda k: own(F.slice(c, k, width)))))
        return F.array_max(F.filter(counted, lambda n: n >= need)) / F.lit(float(len(words)))

    def best(words: list[str], need: int) -> Column:
        size = len(words)

        def passes(block: Column) -> Column:
            meets = F.lit(False)
            for i, w in enumerate(words[: size - need + 1]):
                j = F.array_position(block, w)
                meets = meets | ((j > 0) & (F.least(F.lit(size - i), F.size(block) - j + 1) >= need))
            return (F.size(block) >= need) & meets

        counted = F.transform(F.filter("blocks", passes), lambda b: F.size(F.array_intersect(_strings(words), b)))
        return F.array_max(F.filter(counted, lambda n: n >= need)) / F.lit(float(size))

    def found(words: list[str], need: int, width: int) -> Column:
        return F.greatest(best(words, need), widest(words, need, width)) if windows and prefix else best(words, need)

    some = (F.size("blocks") > 0) | (F.size("around") > 0) if windows and prefix else F.size("blocks") > 0
    pairs = F.array(*(F.when(some, F.struct(F.lit(label).alias("label"), found(words, need, width).alias("score"))) for label, words, need, width in index))
    doc = doc.withColumn("matches", F.filter(pairs, lambda x: x["score"].isNotNull()))

    hits = [(F.col(f"p{k}"), len(p.split()), label) for k, (p, label) in enumerate(phrases.items())]
    firsts = [_spaces(F.element_at(p, 1)) for p, _, _ in hits]
    lasts = [F.col("n_words") - (_spaces(F.element_at(p, -1)) - 1) - n for p, n, _ in hits]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(p.isNotNull(), F.lit(label)) for p, _, label in hits)))))
    total = sum((F.when(p.isNotNull(), F.size(p) - 1).otherwise(0) for p, _, _ in hits), F.lit(0))
    doc = doc.withColumns({"n_base": total.cast("bigint"), "first_word": F.least(*firsts, F.lit(None).cast("bigint")), "last_word": F.greatest(*lasts, F.lit(None).cast("bigint")), "base": base})
    return doc.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("matches", lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0))).alias("score"), "matches",
    )



def oracle_sql(templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The rows of ``scan`` without ``matches``, in DuckDB, by counting every template in every line."""
    words = lambda c: f"list_filter(string_split_regex({c}, '{SEPARATORS}'), lambda x: x <> '')"
    text = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = ", ".join(f"list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + {len(p.split())}] = {text(p.split())}) AS p{k}" for k, p in enumerate(phrases))
    shares = []
    for label, ts in templates.items():
        for t in ts:
            own = sorted(set(t.split()))
            shares.append(f"{{'label': '{label}', 'score': list_max(list_transform(ls, lambda s: len(list_intersect(s, {text(own)})))) / {float(len(own))}, 'need': {math.ceil(threshold * len(own) - 1e-9)} / {float(len(own))}}}")
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(phrases.values())) + "], lambda x: x IS NOT NULL)"
    every = ", ".join(f"p{k}" for k in range(len(phrases)))
    return f"""SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
        array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, list_transform(found, lambda m: m.label)))), ',') AS labels,
        CASE WHEN len(base) > 0 THEN 1.0E0 ELSE coalesce(list_max(list_transform(found, lambda m: m.score)), 0.0E0) END AS score
        FROM (SELECT doc_id, ws, list_concat({every}) AS places, {base} AS base, list_filter([{', '.join(shares)}], lambda m: m.score >= m.need) AS found
        FROM (SELECT doc_id, ws, {places}, list_transform(string_split(low, chr(10)), lambda l: list_distinct({words('l')})) AS ls
        FROM (SELECT doc_id, low, {words('low')} AS ws FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents))))"""


def windows_sql(templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The rows of ``scan`` with ``windows``: to those of lines come the distinct template words from each place of one on, as far as a window goes."""
    rows = []
    for label, texts in templates.items():
        for t in texts:
            own = sorted(set(t.split()))
            rows += [f"('{label}', {len(rows)}, {len(own)}, {math.ceil(threshold * len(own) - 1e-9)}, {SLACK * len(t.split())}, [{', '.join(repr(w) for w in own)}])"]
    return f"""WITH lines AS ({oracle_sql(templates, phrases, threshold)}),
    notices(label, t, size, need, width, own) AS (VALUES {', '.join(rows)}),
    parts AS (SELECT label, t, size, need, width, unnest(own) AS w FROM notices),
    texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM documents),
    places AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM texts),
    counted AS (SELECT doc_id, label, size, need, count(DISTINCT w) OVER (PARTITION BY doc_id, t ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n FROM places JOIN parts USING (w)),
    found AS (SELECT doc_id, list(DISTINCT label) AS more, max(n / CAST(size AS DOUBLE)) AS best FROM counted WHERE n >= need GROUP BY doc_id)
    SELECT doc_id, n_words, n_base, first_word, last_word, base_labels,
        array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(labels, ','), lambda x: x <> ''), coalesce(more, [])))), ',') AS labels,
        CASE WHEN base_labels <> '' THEN 1.0E0 ELSE greatest(score, coalesce(best, 0.0E0)) END AS score
    FROM lines LEFT JOIN found USING (doc_id)"""
