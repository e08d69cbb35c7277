"""Detectors: documents to spans. One narrow Arrow pass each; all matches are kept, overlaps are resolved elsewhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import engine
from ..functions.columns import DETECTION, SPAN, per_text
from ..functions.engine import Recognizer, Span
from ..functions.patterns import DETECTORS, KEYWORDS, VARIANTS, dictionary, keyword_rule, usable_rule


def detections(text: Column, entities: Iterable[str] | None = None) -> Column:
    """All pattern detections of a text with their validity, ordered by detector, then place."""
    names = tuple(entities or DETECTORS)
    return per_text(lambda t: engine.detections(t, names), DETECTION)(text)


def scan_text(docs: DataFrame, entities: Iterable[str] | None = None) -> DataFrame:
    """doc_id, entity_type, start, end, value, is_valid."""
    found = docs.select("doc_id", F.explode(detections(F.col("text"), entities)).alias("d"))
    return found.select("doc_id", "d.*")


def scan_valid_text(docs: DataFrame, entities: Iterable[str] | None = None) -> DataFrame:
    return scan_text(docs, entities).where("is_valid")


def regex_spans(text: Column) -> Column:
    """Valid, non-empty detections as spans of source Regex."""
    return per_text(engine.regex_spans, SPAN)(text)


def mock_org(text: Column) -> Column:
    return per_text(engine.mock_org, SPAN)(text)


def mock_person(text: Column) -> Column:
    return per_text(engine.mock_person, SPAN)(text)


def recognized(text: Column, recognizer: Recognizer = engine.mock_ner) -> Column:
    """What a recognizer finds in each text; the default is the mock recognizer. It is sent to the workers as it is."""
    return per_text(lambda t: engine.recognized(t, recognizer, engine.Places(t)), SPAN)(text)


def usable(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules (pattern, type) in the supported dialect; others are skipped."""
    return [(p, k) for p, k in rules if usable_rule(p)]


def keyword_rules(keywords: Iterable[str]) -> list[tuple[str, str]]:
    return [(p, "KEYWORD") for p in map(keyword_rule, keywords) if p]


def by_rules(text: str, rules: list[tuple[str, str]], places: engine.Places | None = None) -> list[Span]:
    places = places or engine.Places(text)
    return [s for p, k in rules for s in engine.pattern_spans(text, p, k, "UserRule", places=places)]


def rule_spans(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Matches of user rules (pattern, type); rules outside the dialect are skipped, empty matches dropped."""
    own = usable(rules)
    return per_text(lambda t: by_rules(t, own), SPAN)(text)


def by_dictionary(text: str, pattern: str | None) -> list[Span]:
    return engine.pattern_spans(text, pattern, "KEYWORD", "Keyword") if pattern else []


def dictionary_spans(text: Column, words: Iterable[str] = KEYWORDS) -> Column:
    """Dictionary terms, leftmost and longest first, anywhere in a word."""
    pattern = dictionary(list(words))
    return per_text(lambda t: by_dictionary(t, pattern), SPAN)(text)


def entity_spans(text: Column, entities: Column) -> Column:
    """Externally found entities (a JSON array of label, start, end, confidence) as spans of source NER.

    One malformed element voids the list. Offsets outside the text, empty ranges and ranges that cut a character are dropped.
    """
    return per_text(engine.entity_spans, SPAN)(text, entities)


def exploded(docs: DataFrame, own: Column) -> DataFrame:
    """doc_id and the columns of each span."""
    return docs.select("doc_id", F.explode(own).alias("s")).select("doc_id", "s.*")


def variant_rows(docs: DataFrame) -> DataFrame:
    """doc_id, detector, value of what the variant detectors return."""
    own = per_text(lambda t: [(n, v) for n in VARIANTS for v in engine.variant_matches(t, n)], "struct<detector: string, value: string>")
    return exploded(docs, own(F.col("text")))


def detected_types(text: Column) -> Column:
    """Names of the variant detectors that find something, in fixed order."""
    own = per_text(lambda t: [(n,) for n in VARIANTS if engine.variant_matches(t, n)], "struct<name: string>")
    return own(text)["name"]


def variant_report(cases: DataFrame) -> DataFrame:
    """Cases (text, expect; INVALID: nothing is to be found) with what the variant detectors find and whether that is right."""
    found = cases.withColumn("found", F.array_join(detected_types(F.col("text")), ","))
    return found.withColumn("passed", F.when(F.col("expect") == "INVALID", F.col("found") == "").otherwise(F.array_contains(F.split("found", ","), F.col("expect"))))
