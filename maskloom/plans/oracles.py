"""The queries' rows as DuckDB SQL."""

from __future__ import annotations

from ..functions.engine import verhoeff_tables
from ..functions.patterns import DETECTORS, KEYWORDS, MOCK_ORG, MOCK_PERSON, REDACTED, VARIANTS, dictionary, keyword_rule
from ..operators import dataset
from .duck_substitutes import FAMILIES, day_offset, digest, family, normalized, substitute
from .views import PROMPTS


DOCUMENTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
#: Letters beyond ASCII, two bytes each, as two word characters: DuckDB's word boundaries are ASCII only.
LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}]"
WIDE = f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{LETTERS}', '__', 'g') AS text FROM documents"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def matches(src: str, pattern: str) -> str:
    """doc_id, start, end, value of all matches with byte offsets."""
    p = q(pattern)
    return f"""SELECT doc_id, CAST(a AS INT) AS "start", CAST(a + strlen(v) AS INT) AS "end", v AS value FROM (
        SELECT doc_id, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS a
        FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM ({src}))))"""


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"({d} <> '' AND list_sum(list_transform(string_split(reverse({d}), ''), lambda x, i: CASE WHEN i % 2 = 0 THEN CAST(x AS INT) * 2 - CASE WHEN CAST(x AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(x AS INT) END)) % 10 = 0)"


def verhoeff(v: str) -> str:
    product, power = verhoeff_tables()
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"({d} = '' OR list_reduce(list_prepend(0, list_transform(string_split(reverse({d}), ''), lambda x, i: {power}[((i - 1) % 8) * 10 + CAST(x AS INT) + 1])), lambda a, x: {product}[a * 10 + x + 1]) = 0)"


def valid(v: str, check: str) -> str:
    return luhn(v) if check == "luhn" else verhoeff(v) if check == "verhoeff" else "true"


def detected(src: str, entities: tuple[str, ...] = tuple(DETECTORS)) -> str:
    return " UNION ALL ".join(f"""SELECT doc_id, '{e}' AS entity_type, "start", "end", value, {valid('value', DETECTORS[e][1])} AS is_valid FROM ({matches(src, DETECTORS[e][0])})""" for e in entities)


def spans(src: str, pattern: str, kind: str, source: str, confidence: float) -> str:
    return f"""SELECT doc_id, '{kind}' AS entity_type, "start", "end", value, CAST({confidence} AS FLOAT) AS confidence, '{source}' AS source FROM ({matches(src, pattern)})"""


def regex_spans(src: str) -> str:
    return f"""SELECT doc_id, entity_type, "start", "end", value, CAST(1 AS FLOAT) AS confidence, 'Regex' AS source FROM ({detected(src)}) WHERE is_valid AND "start" < "end" """


def mock(src: str) -> str:
    return f"{spans(src, MOCK_ORG, 'ORG', 'NER', 0.85)} UNION ALL SELECT * FROM ({spans(src, MOCK_PERSON, 'PERSON', 'NER', 0.7)}) WHERE value <> 'Bank'"


PRIORITY = "CASE source WHEN 'UserRule' THEN 3 WHEN 'Regex' THEN 2 WHEN 'Keyword' THEN 1 ELSE 0 END"


def merged(src: str) -> str:
    order = f"""PARTITION BY doc_id ORDER BY "start", "end" DESC, {PRIORITY} DESC, entity_type"""
    return f"""SELECT doc_id, entity_type, "start", "end", value, source FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY "end" - "start" DESC, {PRIORITY} DESC, "start", "end" DESC, entity_type) AS k FROM (
        SELECT *, sum(fresh) OVER ({order} ROWS UNBOUNDED PRECEDING) AS chain FROM (
        SELECT *, CASE WHEN "start" < max("end") OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM (SELECT doc_id, entity_type, "start", "end", source, min(value) AS value FROM ({src}) WHERE "start" < "end" GROUP BY ALL)))) WHERE k = 1"""


def substituted(chosen: str, src: str = PROMPTS, kind: str = "CASE entity_type WHEN 'PERSON' THEN 'NAME' ELSE entity_type END") -> str:
    """doc_id, session_id, start, end, entity_type, original, sub of chosen spans."""
    kind = normalized(f"({kind})")
    return f"""SELECT doc_id, session_id, "start", "end", k AS entity_type, o AS original, {substitute('k', 'o', 'h', day_offset('session_id'))} AS sub FROM (
        SELECT *, {digest('session_id', 'k', 'o')} AS h FROM (SELECT m.doc_id, session_id, "start", "end", {kind} AS k, value AS o FROM ({chosen}) m JOIN ({src}) p ON m.doc_id = p.doc_id))"""


def stitched(subs: str, src: str = PROMPTS) -> str:
    """doc_id, session_id, text, masked, n_spans; offsets are characters, which in the prompts are bytes."""
    return f"""SELECT doc_id, any_value(session_id) AS session_id, any_value(text) AS text, string_agg(substr(text, b + 1, "start" - b) || sub, '' ORDER BY "start") || substr(any_value(text), max("end") + 1) AS masked, CAST(count(*) AS INT) AS n_spans FROM (
        SELECT s.*, text, coalesce(lag("end") OVER (PARTITION BY s.doc_id ORDER BY "start"), 0) AS b FROM ({subs}) s JOIN ({src}) p ON s.doc_id = p.doc_id) GROUP BY doc_id"""


def pipeline(*extra: str, with_mock: bool = True) -> str:
    return substituted(merged(" UNION ALL ".join([regex_spans(PROMPTS), *([mock(PROMPTS)] if with_mock else []), *extra])))


RULES = [("Ref [A-Z]{5}", "TAG"), (r"host \d+", "HOST"), ("(", "BAD"), ("x*", "NONE")]
RULES_USED = [spans(PROMPTS, p, k, "UserRule", 1.0) for p, k in [*RULES[:2], ("x+", "NONE")]]
WORDS = ["nothing", " pune ", ""]
WORDS_USED = [spans(PROMPTS, keyword_rule(w), "KEYWORD", "UserRule", 1.0) for w in WORDS[:2]]
TERMS = ("card", "card 4", "mail", "HOST", "")
#: Two entities of each prompt; the second lies outside the text.
ENTITIES = """concat('[{"label":"TAG","start":', CAST(doc_id % 5 AS STRING), ',"end":', CAST(doc_id % 5 + 8 AS STRING), ',"confidence":0.5},{"label":"OUT","start":5,"end":99999}]')"""
EXTERNAL = f"SELECT doc_id, 'TAG' AS entity_type, CAST(doc_id % 5 AS INT) AS \"start\", CAST(doc_id % 5 + 8 AS INT) AS \"end\", substr(text, CAST(doc_id % 5 + 1 AS BIGINT), 8) AS value, CAST(0.5 AS FLOAT) AS confidence, 'NER' AS source FROM ({PROMPTS})"
SAMPLES = {f: f"SELECT DISTINCT value AS original FROM ({matches(PROMPTS, p)})" for f, p in {
    "PAN": DETECTORS["PAN"][0], "AADHAAR": DETECTORS["AADHAAR"][0], "PHONE": DETECTORS["INDIAN_PHONE"][0], "EMAIL": DETECTORS["EMAIL"][0], "CREDIT_CARD": DETECTORS["CREDIT_CARD"][0],
    "IP": DETECTORS["IPV4"][0], "URL": DETECTORS["URL"][0], "GENERIC": DETECTORS["IBAN"][0],
}.items()}
#: Amounts and dates of orders as text, in the forms that the generators know.
SAMPLES["NAME"] = "SELECT DISTINCT c_name AS original FROM customer"
SAMPLES["MONEY"] = "SELECT DISTINCT concat('Rs ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '.50 only' ELSE ' due' END) AS original FROM orders UNION SELECT 'no amount' AS original"
_D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
SAMPLES["DATE"] = f"SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN concat('on ', {_D}) WHEN 1 THEN concat(substr({_D}, 9, 2), '/', substr({_D}, 6, 2), '/', substr({_D}, 1, 4)) WHEN 2 THEN concat('31-02-', substr({_D}, 1, 4), ' x') ELSE 'someday' END AS original FROM orders"
REPLIES = "SELECT doc_id AS reply_id, session_id, concat(substr(masked, 1, 11), '0', substr(masked, 13)) AS text FROM ({0})"
TAG_ROWS = "SELECT doc_id, CAST(n_chars % 11 AS INT) AS a, CAST(n_chars % 7 AS INT) AS b, CAST(doc_id % 9 AS INT) AS c FROM documents"


def vault(subs: str) -> str:
    n = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY \"start\" DESC) AS i FROM ({subs})"
    return f"SELECT session_id, entity_type AS norm_type, original, sub AS substitute, min((doc_id, i)) AS seq FROM ({n}) GROUP BY ALL"


def reverse(forward: str) -> str:
    return f"SELECT session_id, substitute, original, norm_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id, substitute ORDER BY seq DESC, original DESC, norm_type DESC) AS k FROM ({forward})) WHERE k = 1"


def redacted(src: str) -> str:
    t = "text"
    for p in REDACTED:
        t = f"list_reduce(list_prepend('', list_transform(range(1, len(string_split_regex({t}, '{p}')) + 1), lambda i: string_split_regex({t}, '{p}')[i] || repeat('X', coalesce(strlen(regexp_extract_all({t}, '{p}')[i]), 0)))), lambda a, x: a || x)"
        src = f"SELECT doc_id, {t} AS text FROM ({src})"
        t = "text"
    return f"SELECT doc_id, text AS redacted FROM ({src})"


TOKENS = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]+"


def chunked(size: int, overlap: int, src: str = DOCUMENTS) -> str:
    step = max(1, size - overlap)
    return f"""SELECT doc_id, CAST(a AS INT) AS start_token, CAST(least(a + {size}, n) AS INT) AS end_token, CAST(t[a + 1].s AS INT) AS "start", substr(text, CAST(t[a + 1].cs + 1 AS BIGINT), CAST(t[least(a + {size}, n)].ce - t[a + 1].cs AS BIGINT)) AS text FROM (
        SELECT doc_id, text, t, len(t) AS n, unnest(range(0, CASE WHEN len(t) <= {size} THEN 1 ELSE CAST(ceil((len(t) - {size}) / {step}.0) AS BIGINT) * {step} + 1 END, {step})) AS a FROM (
        SELECT m.doc_id, any_value(text) AS text, list({{'s': m."start", 'cs': c."start", 'ce': c."end"}} ORDER BY m."start") AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i FROM ({matches(src, TOKENS)})) m JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i FROM ({matches(src, TOKENS).replace('strlen(', 'length(')})) c ON m.doc_id = c.doc_id AND m.i = c.i JOIN ({src}) d ON m.doc_id = d.doc_id GROUP BY m.doc_id))"""


def examples(n: int, templates: list[list[tuple[str, str]]]) -> str:
    def duck(x: str) -> str:
        return x.replace("sha2(", "sha256(").replace(", 256)", ")").replace("element_at(array(", "list_extract(list_value(")

    tokens, tags = [], []
    for t in templates:
        own = [(f"string_split({duck(w)}, ' ')", tag) for w, tag in t]
        tokens.append("list_concat(" + ", ".join(s for s, _ in own) + ")")
        tags.append("list_concat(" + ", ".join(f"list_transform({s}, lambda x, i: {chr(39)}O{chr(39)})" if tag == "O" else f"list_transform({s}, lambda x, i: CASE WHEN i = 1 THEN 'B-{tag}' ELSE 'I-{tag}' END)" for s, tag in own) + ")")
    case = lambda xs: f"CASE {duck(dataset._hash('id', 0))} % {len(xs)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
    return f"SELECT id, array_to_string({case(tokens)}, ' ') AS tokens, array_to_string({case(tags)}, ' ') AS ner_tags FROM (SELECT unnest(range({n})) AS id)"


def _compatible() -> str:
    count = lambda c, p: f"length({c}) - length(regexp_replace({c}, '{p}', '', 'g'))"
    return f"""CASE norm_type WHEN 'AADHAAR' THEN NOT regexp_matches(token, '[^0-9]') AND NOT regexp_matches(substitute, '[^0-9]') AND strlen(token) BETWEEN 10 AND 14
        WHEN 'PAN' THEN strlen(substitute) = 10 AND strlen(token) <= 12 AND {count('token', '[A-Za-z]')} >= 4 WHEN 'PHONE' THEN {count('token', '[0-9]')} >= 8 WHEN 'NAME' THEN regexp_matches(token, '[A-Za-z]') ELSE true END"""


def _scan(e: str) -> str:
    src = "SELECT page_id AS doc_id, url AS text FROM pages" if e == "URL" else PROMPTS
    return detected(src, (e,))


def greedy() -> str:
    """Valid, not nested spans of the prompts, taken from right to left."""
    order = "CASE entity_type " + " ".join(f"WHEN '{e}' THEN {k}" for k, e in enumerate(DETECTORS)) + " END"
    return f"""WITH RECURSIVE v AS (SELECT * FROM ({detected(PROMPTS)}) WHERE is_valid),
        s AS MATERIALIZED (SELECT a.*, t.size, row_number() OVER (PARTITION BY a.doc_id ORDER BY "start" DESC, {order} DESC) AS k FROM v a JOIN (SELECT doc_id, strlen(text) AS size FROM ({PROMPTS})) t ON a.doc_id = t.doc_id
            WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.doc_id = b.doc_id AND b."start" <= a."start" AND a."end" <= b."end" AND (b."start" < a."start" OR a."end" < b."end"))),
        g AS (SELECT doc_id, k, "end" <= size AS ok, CASE WHEN "end" <= size THEN "start" ELSE size END AS edge FROM s WHERE k = 1
            UNION ALL SELECT s.doc_id, s.k, s."end" <= g.edge, CASE WHEN s."end" <= g.edge THEN s."start" ELSE g.edge END FROM g JOIN s ON s.doc_id = g.doc_id AND s.k = g.k + 1)
        SELECT s.doc_id, entity_type, "start", "end", value FROM s JOIN g ON s.doc_id = g.doc_id AND s.k = g.k WHERE ok"""


def tier4(most: int = 50_000) -> str:
    n = f"len(regexp_extract_all(text, '{TOKENS}'))"
    c = f"SELECT doc_id AS d, \"start\" AS base, doc_id * 100000 + start_token AS doc_id, text FROM ({chunked(512, 64, f'SELECT * FROM ({DOCUMENTS}) WHERE {n} <= {most}')})"
    own = f"{regex_spans(c)} UNION ALL {spans(c, dictionary(KEYWORDS), 'KEYWORD', 'Keyword', 1.0)}"
    rows = f"""SELECT d AS doc_id, entity_type, CAST("start" + base AS INT) AS "start", CAST("end" + base AS INT) AS "end", value, source FROM ({own}) s JOIN ({c}) c ON s.doc_id = c.doc_id"""
    over = f"SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 'Input exceeds maximum token limit' FROM ({DOCUMENTS}) WHERE {n} > {most}"
    return f"SELECT *, CAST(NULL AS STRING) AS error FROM ({merged(rows)}) UNION ALL {over}"


def bio(a: str, b: str, c: str) -> str:
    """doc_id, kind, s, e of the entities of three tags."""
    names = "[" + ", ".join(f"'{x}'" for x in dataset.MONEY_LABELS) + "]"
    return f"""SELECT doc_id, k, min(i) AS s, max(i) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
        SELECT doc_id, i, t[1] AS p, substr(t, 3) AS k, CASE WHEN t[1] = 'O' THEN 0 WHEN t[1] = 'B' OR coalesce(lag(substr(t, 3)) OVER (PARTITION BY doc_id ORDER BY i), '') <> substr(t, 3) THEN 1 ELSE 0 END AS fresh
        FROM (SELECT doc_id, unnest([0, 1, 2]) AS i, {names}[unnest([{a}, {b}, {c}]) + 1] AS t FROM ({TAG_ROWS})))) WHERE p <> 'O' GROUP BY doc_id, g, k"""


#: For masked documents: character offsets, and one character for each letter beyond ASCII.
CHAR_DOCUMENTS = "SELECT doc_id, doc_id % 100 AS session_id, coalesce(text, '') AS text FROM documents"
CHAR_SPANS = f"{regex_spans(DOCUMENTS)} UNION ALL {mock(WIDE.replace(repr('__'), repr('_')))}".replace("strlen(", "length(")

NO_MOCK = pipeline(with_mock=False)
VAULT = reverse(vault(NO_MOCK))
EXACT = f"""SELECT r.reply_id, r.session_id, coalesce(list_reduce(list_prepend({{'s': '', 'o': r.text}}, pairs), lambda a, p: {{'s': '', 'o': replace(a.o, p.s, p.o)}}).o, r.text) AS exact FROM ({REPLIES.format(stitched(NO_MOCK))}) r LEFT JOIN (
    SELECT session_id, list({{'s': substitute, 'o': original}} ORDER BY strlen(substitute) DESC, substitute) AS pairs FROM ({VAULT}) WHERE substitute <> '' GROUP BY session_id) v ON r.session_id = v.session_id"""

ORACLE_SQL: dict[str, str] = {f"scan_{e.lower()}": _scan(e) for e in DETECTORS}
ORACLE_SQL |= {
    "scan_text_documents": detected(DOCUMENTS, ("INDIAN_PHONE", "CREDIT_CARD", "EMAIL", "IPV4")),
    "scan_valid_text": f"SELECT * FROM ({detected(PROMPTS)}) WHERE is_valid",
    "variant_detectors": " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS detector, v AS value, count(*) AS n FROM (SELECT doc_id, " + (f"regexp_replace(value, '[^0-9]', '', 'g') AS v FROM ({matches(PROMPTS, p)})) WHERE length(v) = 12 AND {verhoeff('v')}" if n == "AADHAAR" else f"value AS v FROM ({matches(PROMPTS, p)}))") + " GROUP BY ALL"
        for n, p in VARIANTS.items()
    ),
    "detected_types": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN " + (f"len(list_filter(list_transform(regexp_extract_all(text, '{p}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) = 12 AND {verhoeff('d')})) > 0" if n == "AADHAAR" else f"regexp_matches(text, '{p}')") + f" THEN '{n}' END" for n, p in VARIANTS.items()) + f"], lambda x: x IS NOT NULL), ',') AS types FROM ({PROMPTS})",
    "mock_ner_person": f"SELECT * FROM ({spans(WIDE, MOCK_PERSON, 'PERSON', 'NER', 0.7)}) WHERE value <> 'Bank'",
    "mock_ner_org": spans(PROMPTS, MOCK_ORG, "ORG", "NER", 0.85),
    "user_rules": " UNION ALL ".join(RULES_USED),
    "keyword_rules": " UNION ALL ".join(WORDS_USED),
    "keyword_dictionary": spans(PROMPTS, dictionary(KEYWORDS), "KEYWORD", "Keyword", 1.0),
    "keyword_dictionary_custom": spans(PROMPTS, dictionary(TERMS), "KEYWORD", "Keyword", 1.0),
    "external_ner": EXTERNAL,
    "merge_spans": merged(f"{regex_spans(PROMPTS)} UNION ALL {mock(PROMPTS)}"),
    "merge_spans_array": merged(f"{regex_spans(PROMPTS)} UNION ALL {mock(PROMPTS)}"),
    "drop_contained": f"""WITH s AS (SELECT * FROM ({detected(PROMPTS)}) WHERE is_valid) SELECT doc_id, entity_type, "start", "end", value FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND b."start" <= a."start" AND a."end" <= b."end" AND (b."start" < a."start" OR a."end" < b."end"))""",
    "mask_summary": f"""SELECT doc_id, n AS names, p AS pan, a AS aadhaar, concat('Hidden: ', CAST(n AS STRING), ' name', CASE WHEN n = 1 THEN '' ELSE 's' END, ', ', CAST(p AS STRING), ' PAN, ', CAST(a AS STRING), ' Aadhaar') AS summary FROM (
        SELECT d.doc_id, CAST(count(*) FILTER (entity_type IN ('PERSON', 'NAME')) AS INT) AS n, CAST(count(*) FILTER (entity_type = 'PAN') AS INT) AS p, CAST(count(*) FILTER (entity_type = 'AADHAAR') AS INT) AS a
        FROM ({PROMPTS}) d LEFT JOIN ({merged(f"{regex_spans(PROMPTS)} UNION ALL {mock(PROMPTS)}")}) m ON d.doc_id = m.doc_id GROUP BY d.doc_id)""",
    "mask_pipeline": f"SELECT doc_id, session_id, masked FROM ({stitched(pipeline())})",
    "mask_without_mock": f"SELECT doc_id, session_id, masked FROM ({stitched(NO_MOCK)})",
    "mask_with_rules": f"SELECT doc_id, session_id, masked FROM ({stitched(pipeline(*RULES_USED))})",
    "mask_with_keywords": f"SELECT doc_id, session_id, masked FROM ({stitched(pipeline(*WORDS_USED))})",
    "mask_with_entities": f"SELECT doc_id, session_id, masked FROM ({stitched(pipeline(EXTERNAL))})",
    "vault_forward": f"SELECT session_id, norm_type, original, substitute FROM ({vault(pipeline())})",
    "vault_reverse": reverse(vault(pipeline())),
    "unmask_exact": EXACT,
    "unmask_fuzzy_tokens": f"""SELECT reply_id, substitute AS masked, original AS revealed, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY reply_id, i ORDER BY d, strlen(substitute) DESC, substitute) AS k FROM (
        SELECT *, levenshtein(token, substitute) AS d, greatest(strlen(substitute) // 8, 2) AS most FROM (SELECT reply_id, session_id, unnest(regexp_extract_all(exact, '[A-Za-z0-9@._+-]{{3,}}')) AS token, generate_subscripts(regexp_extract_all(exact, '[A-Za-z0-9@._+-]{{3,}}'), 1) AS i FROM ({EXACT})) t JOIN ({VAULT}) v USING (session_id) WHERE {_compatible()})
        WHERE abs(strlen(token) - strlen(substitute)) <= most AND d > 0 AND d <= most) WHERE k = 1 GROUP BY ALL""",
    "redact_pii": redacted(DOCUMENTS),
    "redact_prompts": redacted(f"SELECT doc_id, text FROM ({PROMPTS})"),
    "profiled": f"SELECT doc_id, CAST(strlen(text) AS INT) AS input_len, CAST(strlen(masked) AS INT) AS output_len FROM ({stitched(pipeline())})",
    "token_spans": matches(DOCUMENTS, TOKENS),
    "chunk_text": chunked(512, 64),
    "chunk_small": chunked(100, 25),
    "clean_dataset": "SELECT doc_id, 'w' || CAST(a AS STRING) || ' ' || CAST(b AS STRING) AS tokens, CAST(c AS STRING) || ' ' || CAST(a AS STRING) AS ner_tags FROM (" + TAG_ROWS + ") WHERE c NOT IN (0, 1)",
    "normalize_tags": f"SELECT doc_id, concat_ws(' ', CASE WHEN a IN (7, 8) THEN 0 ELSE a END, CASE WHEN b IN (7, 8) THEN 0 ELSE b END, CASE WHEN c IN (7, 8) THEN 0 ELSE c END) AS tags FROM ({TAG_ROWS})",
    "label_encode": f"SELECT doc_id, concat_ws(' ', a, b) AS ids FROM ({TAG_ROWS})",
    "concat_datasets": f"SELECT doc_id, a FROM ({TAG_ROWS}) UNION ALL SELECT doc_id, b AS a FROM ({TAG_ROWS})",
    "align_first": f"SELECT doc_id, concat_ws(' ', -100, a, -100, b, c, -100, -100, -100) AS labels FROM ({TAG_ROWS})",
    "align_all": f"SELECT doc_id, concat_ws(' ', -100, a, a, b, c, c, -100, -100) AS labels FROM ({TAG_ROWS})",
    "pad_truncate": f"SELECT doc_id, concat_ws(' ', a, b, c, 0, 0) AS padded, concat_ws(' ', a, b) AS cut FROM ({TAG_ROWS})",
    "argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS argmax FROM embeddings",
    "prediction_similarity": f"SELECT doc_id, (CASE WHEN a = b THEN 1 ELSE 0 END + CASE WHEN b = c THEN 1 ELSE 0 END + 1) * 100.0E0 / 3 AS similarity FROM ({TAG_ROWS})",
    "synthetic_ner": examples(500, dataset.NER_SENTENCES),
    "synthetic_money_date": examples(500, dataset.MONEY_SENTENCES),
}
ORACLE_SQL |= {
    f"generate_{f.lower()}": f"SELECT original, {family('' if f == 'GENERIC' else f, 'original', 'h', day_offset('7'))} AS substitute FROM (SELECT original, {digest('7', repr(f), 'original')} AS h FROM ({src}))"
    for f, src in SAMPLES.items()
}
ORACLE_SQL |= {
    "variant_report": f"SELECT doc_id, expect, types AS found, CASE expect WHEN 'INVALID' THEN types = '' ELSE list_contains(string_split(types, ','), expect) END AS passed FROM (SELECT doc_id, types, CASE doc_id % 3 WHEN 0 THEN 'PAN' WHEN 1 THEN 'PHONE' ELSE 'INVALID' END AS expect FROM ({ORACLE_SQL['detected_types']}))",
    "ignore_mask": f"SELECT doc_id, concat_ws(' ', b, c) AS pred, concat_ws(' ', c, a) AS lab FROM ({TAG_ROWS})",
    "first_rows": f"SELECT * FROM ({TAG_ROWS}) ORDER BY doc_id LIMIT 500",
    "wiped_vault": f"SELECT * FROM ({ORACLE_SQL['vault_forward']}) WHERE session_id <> 3",
}
TOKEN_RUN = "[A-Za-z0-9@._+-]{3,}"
BEST = f"""SELECT reply_id, i, substitute, original FROM (SELECT *, row_number() OVER (PARTITION BY reply_id, i ORDER BY d, strlen(substitute) DESC, substitute) AS k FROM (
    SELECT *, levenshtein(token, substitute) AS d, greatest(strlen(substitute) // 8, 2) AS most FROM (SELECT reply_id, session_id, unnest(regexp_extract_all(exact, '{TOKEN_RUN}')) AS token, generate_subscripts(regexp_extract_all(exact, '{TOKEN_RUN}'), 1) AS i FROM exact) t JOIN pairs v USING (session_id) WHERE {_compatible()})
    WHERE abs(strlen(token) - strlen(substitute)) <= most AND d > 0 AND d <= most) WHERE k = 1"""
ORACLE_SQL |= {
    "scan_text_all": detected(DOCUMENTS),
    "greedy_spans": greedy(),
    "mask_text_greedy": f"SELECT doc_id, masked FROM ({stitched(substituted(greedy(), kind='entity_type'))})",
    "mask_summary_documents": ORACLE_SQL["mask_summary"].replace(PROMPTS, DOCUMENTS).replace(mock(DOCUMENTS), mock(WIDE)),
    "mask_documents": f"SELECT d.doc_id, coalesce(masked, d.text) AS masked, coalesce(n_spans, 0) AS n_spans FROM ({CHAR_DOCUMENTS}) d LEFT JOIN ({stitched(substituted(merged(CHAR_SPANS), CHAR_DOCUMENTS), CHAR_DOCUMENTS)}) m ON d.doc_id = m.doc_id",
    "tier4_detect": tier4(),
    "tier4_limited": tier4(600),
    "seqeval_f1": f"""WITH p AS ({bio('a', 'b', 'c')}), t AS ({bio('a', 'b', '(c % 5)')}), n AS (SELECT (SELECT count(*) FROM p JOIN t USING (doc_id, k, s, e)) AS hit, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt)
        SELECT hit / np AS precision, hit / nt AS recall, 2.0E0 * hit / (np + nt) AS f1 FROM n""",
}
#: Restored texts and their spans; in the prompts characters are UTF-16 units.
RESTORED = f"""WITH exact AS MATERIALIZED ({EXACT}), pairs AS MATERIALIZED ({VAULT}), best AS ({BEST}),
    parts AS (SELECT reply_id, g, m, unnest(range(1, len(g) + 1)) AS i FROM (SELECT reply_id, string_split_regex(exact, '{TOKEN_RUN}') AS g, regexp_extract_all(exact, '{TOKEN_RUN}') AS m FROM exact)),
    placed AS (SELECT reply_id, p.i, g[p.i] AS gap, coalesce(original, m[p.i], '') AS word, substitute, original, sum(length(gap) + length(word)) OVER (PARTITION BY reply_id ORDER BY p.i) AS stop FROM parts p LEFT JOIN best b USING (reply_id, i))"""
ORACLE_SQL |= {
    "unmask_fuzzy": f"""{RESTORED} SELECT reply_id, string_agg(gap || word, '' ORDER BY i) AS text, coalesce(string_agg(concat_ws('|', stop - length(word), stop, substitute, original), ',' ORDER BY i) FILTER (original IS NOT NULL), '') AS spans FROM placed GROUP BY reply_id""",
    "unmask_json": f"""{RESTORED} SELECT reply_id, CAST(to_json({{'text': string_agg(gap || word, '' ORDER BY i), 'fuzzy_spans': coalesce(list({{'utf16_start': CAST(stop - length(word) AS INT), 'utf16_end': CAST(stop AS INT), 'masked': substitute, 'revealed': original}} ORDER BY i) FILTER (original IS NOT NULL), [])}}) AS VARCHAR) AS json FROM placed GROUP BY reply_id""",
}
assert set(FAMILIES) <= set(SAMPLES)
