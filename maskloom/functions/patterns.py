"""The detectors' patterns, in detection order."""

from __future__ import annotations

import re

import regex

#: Entity types and the patterns that define them. Validity: how a match is checked.
DETECTORS: dict[str, tuple[str, str]] = {
    "AADHAAR": (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "verhoeff"),
    "PAN": (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "always"),
    "IFSC": (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "always"),
    "GSTIN": (r"\b\d{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", "always"),
    "EPIC": (r"\b[A-Z]{3}[0-9]{7}\b", "always"),
    "INDIAN_PHONE": (r"(?:\+91[-\s]?|0)?[6-9]\d{9}\b", "always"),
    "SSN": (r"\b\d{3}-\d{2}-\d{4}\b", "always"),
    "EIN": (r"\b\d{2}-\d{7}\b", "always"),
    "UK_NI": (r"\b[A-Z]{2}\d{6}[A-D]\b", "always"),
    "IBAN": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "always"),
    "CREDIT_CARD": (r"\b((?:\d{4}[- ]?){3}\d{4}|\d{13,19})\b", "luhn"),
    "EMAIL": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "always"),
    "IPV4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "always"),
    "IPV6": (r"\b([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "always"),
    "URL": (r"https?://[^\s/$.?#][^\n][^\s]*", "always"),
}
#: The mock recognizer, the variant detectors, and plain redaction.
MOCK_ORG, MOCK_PERSON = r"\b([A-Z]{2,10})\s+Bank\b", r"\b([A-Z][a-z]{1,19})\b"
VARIANTS: dict[str, str] = {
    "AADHAAR": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "IFSC": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "GSTIN": r"\b\d{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
    "PHONE": r"\b(?:\+91[- ]?)?[6-9]\d{9}\b",
}
REDACTED = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b\d{12}\b", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"\b[6-9]\d{9}\b")
#: The default keyword dictionary, and how sources rank in conflicts.
KEYWORDS = ("password", "api_key", "secret", "confidential", "internal only", "ssn", "aadhaar", "bank account")
PRIORITY = {"UserRule": 3, "Regex": 2, "Keyword": 1, "NER": 0}
TOKEN, FUZZY_TOKEN = r"\S+", r"[A-Za-z0-9@._+\-]{3,}"


def keyword_rule(word: str) -> str | None:
    """A whole-word, case-insensitive pattern; None for a blank keyword."""
    word = word.strip()
    return rf"(?i)\b{re.escape(word)}\b" if word else None


def dictionary(words: tuple[str, ...] | list[str]) -> str | None:
    """One alternation, longest first, without word boundaries; case is ignored within ASCII."""
    own = sorted({w for w in words if w}, key=lambda w: (-len(w.encode()), w))
    return "(?i)(?:" + "|".join(re.escape(w) for w in own) + ")" if own else None


def usable_rule(pattern: str) -> bool:
    """Whether a user's pattern is in the supported dialect: it compiles, without look-around or back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        return False
    try:
        regex.compile(pattern)
    except regex.error:
        return False
    return True
