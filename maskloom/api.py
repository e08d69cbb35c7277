"""Functions on single strings, for interactive use: the engine that the DataFrame operators run, without Spark.

A ``Session`` keeps the latest vault; masking again replaces it, ``wipe`` forgets it. Nothing is written.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from .functions import engine
from .functions.columns import replaced
from .functions.engine import Detection, Recognizer, Span
from .functions.patterns import KEYWORDS, dictionary
from .functions.substitutes import normalized, substitute
from .operators import chunk, detect, mask


class Session:
    """Masks texts and restores replies with the vault of the last masked text."""

    def __init__(self, recognizers: Iterable[Recognizer] = ()):
        self.recognizers, self.pairs = tuple(recognizers), None

    def _masked(self, text: str, resolve: Callable[..., list[Span]], *more: str) -> str:
        subs = replaced(resolve(text, *more), uuid.uuid4().hex, mask.as_name)
        self.pairs = engine.Pairs({sub: (sub, original, kind) for _, _, kind, original, sub in reversed(subs)}.values())
        return engine.stitch(text, ((a, b, sub) for a, b, _, _, sub in subs))

    def mask_text(self, text: str) -> str:
        return self._masked(text, mask.resolver(recognizers=self.recognizers))

    def mask_with_rules_json(self, text: str, rules: str) -> str:
        return self._masked(text, mask.resolver(mask.rules_from_json(rules), recognizers=self.recognizers))

    def mask_with_keywords_json(self, text: str, keywords: str) -> str:
        return self._masked(text, mask.resolver(keywords=mask.keywords_from_json(keywords), recognizers=self.recognizers))

    def mask_with_ner_json(self, text: str, entities: str, keywords: str = "[]", mock: bool = True) -> str:
        return self._masked(text, mask.resolver(mock=mock, keywords=mask.keywords_from_json(keywords), recognizers=self.recognizers), entities)

    def mask_text_profiled(self, text: str) -> str:
        """JSON: text, mask_ms, input_len, output_len (bytes)."""
        began = time.time()
        out = self.mask_text(text)
        return json.dumps({"text": out, "mask_ms": int(1000 * (time.time() - began)), "input_len": len(text.encode()), "output_len": len(out.encode())}, ensure_ascii=False)

    def mask_summary(self, text: str) -> str:
        kinds = [s[0] for s in mask.resolver(recognizers=self.recognizers)(text)]
        names = sum(k in ("PERSON", "NAME") for k in kinds)
        return f"Hidden: {names} name{'' if names == 1 else 's'}, {kinds.count('PAN')} PAN, {kinds.count('AADHAAR')} Aadhaar"

    def unmask_reply(self, text: str) -> str:
        return text if self.pairs is None else self.pairs.exact(text)

    def unmask_reply_json(self, text: str) -> str:
        exact = self.unmask_reply(text)
        out, spans = engine.revealed(exact, self.pairs.fuzzy(exact) if self.pairs else [])
        named = [dict(zip(("utf16_start", "utf16_end", "masked", "revealed"), s, strict=True)) for s in spans]
        return json.dumps({"text": out, "fuzzy_spans": named}, ensure_ascii=False)

    def wipe(self) -> None:
        self.pairs = None


def scan_text(text: str) -> list[Detection]:
    return engine.detections(text)


def scan_valid_text(text: str) -> list[Detection]:
    return [d for d in scan_text(text) if d[4]]


def detect_keywords(text: str, words: Iterable[str] = KEYWORDS) -> list[Span]:
    return detect.by_dictionary(text, dictionary(list(words)))


def chunk_text(text: str, size: int = chunk.CHUNK, overlap: int = chunk.OVERLAP) -> list[tuple[int, int, int, str]]:
    """First token, token after the last, first byte, text of each chunk."""
    return list(engine.chunks(text, size, overlap))


def tier4_detect(text: str, words: Iterable[str] = KEYWORDS) -> list[tuple[object, ...]]:
    """entity_type, start, end, value, source of the spans of a long text; a text over the limit of tokens is an error."""
    rows = chunk.long_spans(text, dictionary(list(words)))
    if rows and rows[0][-1]:
        raise ValueError(rows[0][-1])
    return [r[:-1] for r in rows]


def redact_pii(text: str, mark: str = "X") -> str:
    return engine.redact(text, mark)


def generate_substitute(kind: str, original: str, salt: str = "") -> str:
    return substitute(normalized(kind), original, salt)
