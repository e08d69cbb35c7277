"""The text-privacy engine on golden facts and properties."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions import engine
from maskloom.functions.columns import matches, merge_array, stitch, substituted
from maskloom.functions.patterns import DETECTORS, PRIORITY, dictionary, keyword_rule, usable_rule
from maskloom.functions.substitutes import date_shift, substitute
from maskloom.operators import chunk, dataset, detect, mask, metrics, spans, unmask
from maskloom.sources import files


def texts(spark, *rows):
    return spark.createDataFrame([(k, 1, t) for k, t in enumerate(rows)], "doc_id bigint, session_id bigint, text string")


GOOD_AADHAAR = ["123412341234", "678967896789", "890189018901", "121212121212", "331579974693"]
BAD_AADHAAR = ["111111111111", "234123412341"]


def test_checksums():
    assert all(map(engine.verhoeff, [*GOOD_AADHAAR, ""])) and not any(map(engine.verhoeff, BAD_AADHAAR))
    assert all(map(engine.luhn, ["4111111111111111", "5500-0000 0000-0004"])) and not any(map(engine.luhn, ["6011000000000000", "4222222222222222", ""]))


EXAMPLES = {
    "AADHAAR": "1234 1234 1234", "PAN": "ABCDE1234F", "IFSC": "SBIN0001234", "GSTIN": "27ABCDE1234F1Z5", "EPIC": "ABC1234567", "INDIAN_PHONE": "+91 9876543210", "SSN": "123-45-6789", "EIN": "12-3456789", "UK_NI": "AB123456C",
    "IBAN": "GB82WEST12345698765432", "CREDIT_CARD": "4111 1111 1111 1111", "EMAIL": "a.b@corp.co.in", "IPV4": "10.0.0.1", "IPV6": "2001:db8:0:0:0:0:0:1", "URL": "https://example.com/x?y=1",
}


def test_each_detector_finds_its_example(spark):
    rows = detect.scan_text(texts(spark, *(f"é say {v} now" for v in EXAMPLES.values()))).collect()
    for k, (name, value) in enumerate(EXAMPLES.items()):
        own = [r for r in rows if r.doc_id == k and r.entity_type == name]
        assert [(r.value, r.start, r.end) for r in own] == [(value, 7, 7 + len(value))], name
    assert detect.scan_text(texts(spark, "The quick brown fox jumps over the lazy dog", "")).count() == 0


def test_offsets_are_bytes(spark):
    text = "naïve Ünïcode 9876543210 — ok 8765432109é a.b@c.de\u2003x@y.zz,é@q.org end"
    for name, (pattern, _) in DETECTORS.items():
        got = texts(spark, text).select(F.explode(matches(F.col("text"), pattern)).alias("m")).select("m.*").collect()
        import regex

        want = [(len(text[: m.start()].encode()), len(text[: m.end()].encode()), m[0]) for m in regex.finditer(pattern, text)]
        assert [tuple(r) for r in got] == want, name
        assert [d[1:4] for d in engine.detections(text, [name])] == want, name
    places = engine.Places(text)
    assert engine.valid_span(places, 2, 4) == (2, 3) and engine.valid_span(places, 2, 3) is None and engine.valid_span(places, 0, 999) is None and engine.valid_span(places, 4, 4) is None


def test_detectors_are_the_plain_patterns(spark):
    """Whatever a detector skips, on whole documents and on odd strings it finds what its pattern finds."""
    import regex

    r = random.Random(9)
    docs = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    docs += ["".join(r.choice(["a", "@", ".", "b.co", " ", "9876543210", "\u2003", "é", ":", "https://", "1234 ", "-", "ABCDE", "+91 "]) for _ in range(40)) for _ in range(400)]
    own = {name: regex.compile(p) for name, (p, _) in DETECTORS.items()}
    for text in docs:
        want = [(name, m[0]) for name, p in own.items() for m in p.finditer(text)]
        assert [(d[0], d[3]) for d in engine.detections(text)] == want


def test_time_grows_with_the_text():
    import time

    part = "Contact Priya at priya@gmail.com or 9876543210, PAN ABCDE1234F, é card 4111111111111111. "
    mask_one = mask.resolver()
    took = {}
    for n in (200, 12_000):
        text = part * n
        began = time.time()
        found = mask_one(text)
        assert len(found) == 6 * n and len(engine.stitch(text, ((s[1], s[2], "x") for s in found))) == n * len(engine.stitch(part, ((s[1], s[2], "x") for s in mask_one(part))))
        engine.greedy([s[:4] for s in found], len(text.encode()))
        took[n] = time.time() - began
    assert took[12_000] < 60 * 4 * max(took[200], 0.02)
    began = time.time()
    engine.detections("a." * 100_000 + " x@y")
    assert time.time() - began < 10


CASES = [("My Aadhaar is 331579974693", "AADHAAR"), ("PAN is ABCDE1234F", "PAN"), ("IFSC code SBIN0001234", "IFSC"), ("GSTIN 27ABCDE1234F1Z5", "GSTIN"), ("Phone number 9876543210", "PHONE"), ("Invalid Aadhaar 111111111111", ""), ("PAN WRONG123", ""), ("Phone 12345", ""), ("GST fake 12ABCDE1234F1Z", ""), ("IFSC TEST00012", "")]


def test_variant_report(spark):
    rows = texts(spark, *(c for c, _ in CASES)).select("doc_id", F.array_join(detect.detected_types(F.col("text")), ",").alias("t")).orderBy("doc_id").collect()
    assert sum(r.t == want for r, (_, want) in zip(rows, CASES, strict=True)) == 10


def test_phone_variants_differ(spark):
    rows = texts(spark, "+919876543210", "+91 9876543210", "919876543210")
    own = [([d[3] for d in engine.detections(x.text, ["INDIAN_PHONE"])], engine.variant_matches(x.text, "PHONE")) for x in rows.orderBy("doc_id").collect()]
    assert own == [(["+919876543210"], []), (["+91 9876543210"], ["9876543210"]), (["9876543210"], [])]


def test_rules_keywords_entities(spark):
    assert not usable_rule("(") and not usable_rule(r"a(?=b)") and not usable_rule(r"(a)\1") and usable_rule(r"\bAcme\b")
    assert keyword_rule("  ") is None and dictionary(["", ""]) is None
    doc = texts(spark, "Acme SECRET ssnx internal only é token")
    rules = detect.exploded(doc, detect.rule_spans(F.col("text"), [("Acme", "ORG"), ("(", "X"), ("z*", "Z"), *detect.keyword_rules(["secret", " ", "tok"])]))
    assert [(r.entity_type, r.value, r.source) for r in rules.collect()] == [("ORG", "Acme", "UserRule"), ("KEYWORD", "SECRET", "UserRule")]
    words = detect.exploded(doc, detect.dictionary_spans(F.col("text")))
    assert [(r.value, r.start) for r in words.collect()] == [("SECRET", 5), ("ssn", 12), ("internal only", 17)]
    for entities, want in (
        ('[{"label":"A","start":0,"end":4},{"label":"B","start":31,"end":32},{"label":"C","start":4,"end":4},{"label":"D","start":0,"end":999}]', [("A", "Acme", 1.0)]),
        ('[{"label":"A","start":0,"end":4},{"label":"B"}]', []),
        ("no json", []),
    ):
        got = detect.exploded(doc, detect.entity_spans(F.col("text"), F.lit(entities))).collect()
        assert [(r.entity_type, r.value, r.confidence) for r in got] == want
    assert mask.rules_from_json('[{"pattern":"a","replacement_type":"T","more":1}]') == [("a", "T")] and mask.rules_from_json('[{"pattern":1}]') == [] == mask.rules_from_json("x")
    assert mask.keywords_from_json('["a"]') == ["a"] and mask.keywords_from_json('["a", 1]') == []


SPANS = "doc_id bigint, entity_type string, start int, end int, value string, confidence float, source string"


def sweep(own):
    own = sorted({(s[2], -s[3], -PRIORITY[s[6]], s[1]) for s in own if s[2] < s[3]})
    out, edge = [], -1
    for a, b, p, t in own:
        rank = (a + b, p, a, b, t)
        if out and a < edge:
            out[-1] = min(out[-1], rank)
            edge = max(edge, -b)
        else:
            out.append(rank)
            edge = -b
    return sorted((r[2], -r[3], r[4]) for r in out)


def test_merge_as_table_and_array(spark):
    r = random.Random(2)
    rows = []
    for d in range(120):
        for _ in range(r.randrange(0, 9)):
            a = r.randrange(0, 30)
            rows.append((d, r.choice("ABC"), a, a + r.randrange(0, 9), "v", 1.0, r.choice(list(PRIORITY))))
    df = spark.createDataFrame(rows, SPANS)
    table = spans.merge_spans(df).collect()
    arrays = df.groupBy("doc_id").agg(F.collect_list(F.struct("entity_type", "start", "end", "value", "confidence", "source")).alias("own")).select("doc_id", F.explode(merge_array(F.col("own"))).alias("s")).select("doc_id", "s.*").collect()
    for d in range(120):
        want = sweep([x for x in rows if x[0] == d])
        for got in (table, arrays):
            assert sorted((x.start, x.end, x.entity_type) for x in got if x.doc_id == d) == want


def test_priorities(spark):
    doc = texts(spark, "ABCDE1234F")
    kind = lambda **o: mask.mask_pipeline(doc, **o).first().spans[0].entity_type
    assert kind(entities=F.lit('[{"label":"ORG","start":0,"end":10}]')) == "PAN"
    assert kind(rules=[("ABCDE1234F", "NAME")]) == "NAME"
    assert kind(rules=[("BCDE", "X")]) == "PAN"


def greedy(own, size):
    inside = lambda d, o: o[0] <= d[0] and d[1] <= o[1] and (o[0] < d[0] or d[1] < o[1])
    kept = sorted((d for d in own if not any(inside(d, o) for o in own)), key=lambda d: (d[0], d[2]))
    out, edge = [], size
    for d in reversed(kept):
        if d[1] <= edge:
            out.append(d)
            edge = d[0]
    return out[::-1]


def test_greedy(spark):
    r = random.Random(3)
    cases = []
    for d in range(100):
        own = []
        for k in range(r.randrange(0, 7)):
            a = r.randrange(0, 20)
            own.append((a, a + r.randrange(1, 8), k))
        cases.append((d, own))
    df = spark.createDataFrame(cases, "doc_id bigint, own array<struct<start: int, end: int, ord: int>>")
    for row in df.select("doc_id", spans.greedy_array(F.col("own"), F.lit(30), "array<struct<start: int, end: int, ord: int>>").alias("g")).collect():
        assert [tuple(g) for g in row.g] == greedy(cases[row.doc_id][1], 30)


def test_pipeline_properties(spark):
    text = "Contact Priya at priya@gmail.com or 9876543210, PAN ABCDE1234F, card 4111111111111111; again ABCDE1234F. é HDFC Bank"
    out = mask.mask_pipeline(spark.createDataFrame([(1, 1, text), (2, 1, "PAN ABCDE1234F"), (3, 2, "PAN ABCDE1234F"), (4, 2, ""), (5, 2, None), (6, None, "Call 9876543210 Pune")], "doc_id bigint, session_id bigint, text string")).orderBy("doc_id").collect()
    subs = {(r.session_id, s.entity_type, s.original): s.sub for r in out[:3] for s in r.spans}
    for s in out[0].spans:
        if s.entity_type in ("PAN", "EMAIL", "PHONE", "CREDIT_CARD"):
            assert s.original not in out[0].masked and s.sub in out[0].masked
    assert all(a.end <= b.start for a, b in zip(out[0].spans, out[0].spans[1:], strict=False))
    assert out[0].masked.count(subs[1, "PAN", "ABCDE1234F"]) == 2 and subs[1, "PAN", "ABCDE1234F"] in out[1].masked
    assert subs[1, "PAN", "ABCDE1234F"] != subs[2, "PAN", "ABCDE1234F"]
    assert out[3].masked == "" and out[4].masked is None and out[4].spans == []
    assert len(out[5].spans) == 3 and re.fullmatch(r"[A-Z][a-z]+ [6-9]\d{9} [A-Z][a-z]+", out[5].masked)


def test_recognizers_plug_in(spark):
    def colours(text):
        return [("COLOUR", m.start(), m.end(), m[0], 0.9, "NER") for m in re.finditer("red|blue", text)] + [("BAD", 0, 999, "", 0.9, "NER"), ("BAD", 2, 1, "", 0.9, "NER")]

    docs = texts(spark, "a red car, ABCDE1234F", "")
    assert [[s.entity_type for s in r.spans] for r in mask.mask_pipeline(docs, mock=False, recognizers=[colours]).orderBy("doc_id").collect()] == [["COLOUR", "PAN"], []]
    assert [r.value for r in detect.exploded(docs, detect.recognized(F.col("text"), colours)).collect()] == ["red"]


def test_one_detection_in_the_vault(spark):
    masked = mask.mask_pipeline(texts(spark, "PAN ABCDE1234F"))
    plan = mask.reverse_vault(mask.vault(masked))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    old = mask.vault(masked).drop("seq")
    new = mask.vault(mask.mask_pipeline(texts(spark, "mail a@b.co"))).drop("seq")
    assert [r.norm_type for r in mask.replace_sessions(old, new).collect()] == ["EMAIL"]


def test_round_trip(spark):
    docs = texts(spark, *(f"mail u{k}@corp.co.in phone 98765432{k:02d} pan ABCDE12{k:02d}F" for k in range(30)))
    masked = mask.mask_pipeline(docs, mock=False)
    reverse = mask.reverse_vault(mask.vault(masked))
    back = unmask.unmask_exact(masked.select(F.col("doc_id").alias("reply_id"), "session_id", F.col("masked").alias("text")), reverse)
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {r.reply_id: r.exact for r in back.collect()} == want
    assert unmask.unmask_exact(spark.createDataFrame([(1, 99, "as it is")], "reply_id int, session_id bigint, text string"), reverse).first().exact == "as it is"


def test_unmask_golden(spark):
    rows = [(1, "ZZZ", "first", "X", 1), (1, "ZZZA", "second", "X", 2), (2, "Arjun", "Rahul", "NAME", 1), (2, "ZXCVB5678Q", "ABCDE1234F", "PAN", 2), (3, "Arjun", "Rahul", "NAME", 1), (4, "8765432109", "9876543210", "PHONE", 1)]
    reverse = spark.createDataFrame(rows, "session_id int, substitute string, original string, norm_type string, seq int").drop("seq")
    replies = spark.createDataFrame([(1, 1, "x ZZZA y ZZZ z"), (2, 2, "Arjun should verify ZXCVB5678Q"), (3, 2, "\U0001f600 ZXCVB5670Q now"), (4, 3, "9999999999"), (5, 4, "8765432119"), (6, 9, "same")], "reply_id int, session_id int, text string")
    got = {r.reply_id: r for r in unmask.unmask_fuzzy(replies, reverse).collect()}
    assert [got[k].text for k in range(1, 7)] == ["x second y first z", "Rahul should verify ABCDE1234F", "\U0001f600 ABCDE1234F now", "9999999999", "9876543210", "same"]
    assert [tuple(s) for s in got[3].fuzzy_spans] == [(3, 13, "ZXCVB5678Q", "ABCDE1234F")]
    one = json.loads(next(r.json for r in unmask.unmask_json(replies, reverse).collect() if r.reply_id == 6))
    assert one == {"text": "same", "fuzzy_spans": []}


def test_late_registration_wins(spark):
    rows = [(1, 1, [(0, 3, "NAME", "Amy", "Dev"), (5, 8, "NAME", "Bob", "Dev")])]
    masked = spark.createDataFrame(rows, f"doc_id bigint, session_id bigint, spans {mask.SUB}")
    assert mask.reverse_vault(mask.vault(masked)).first().original == "Amy"
    assert mask.reverse_vault(mask.vault(masked, right_first=False)).first().original == "Bob"


def test_stitch(spark):
    row = spark.createDataFrame([("a é b", [(2, 4, "X"), (3, 4, "no"), (4, 5, "_")])], "t string, r array<struct<start: int, end: int, sub: string>>").select(stitch(F.col("t"), F.col("r")).alias("s")).first()
    assert row.s == "a X_b"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_restoring_is_the_plain_one():
    """Exact: every pair in turn. Fuzzy: every token against every pair."""
    r = random.Random(1)
    draw = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randrange(a, b)))
    for _ in range(1500):
        made = [(draw("abcZ1é", 0, 9), draw("abcZ1", 0, 6), r.choice(["X", "NAME", "PHONE"])) for _ in range(r.randrange(0, 9))]
        pairs = list({p[0]: p for p in made}.values())
        text = want = draw("abcZ1é ", 0, 40)
        own = engine.Pairs(pairs)
        for s, o, _ in sorted(pairs, key=lambda p: (-len(p[0].encode()), p[0])):
            want = want.replace(s, o) if s else want
        assert own.exact(text) == want
        own.FEW = 0  # by the index
        assert own.exact(text) == want
        for token in re.findall(r"[A-Za-z0-9@._+-]{3,}", want):
            near = [(levenshtein(token, s), -len(s.encode()), s, o) for s, o, k in pairs if s and abs(len(s.encode()) - len(token)) <= engine.threshold(s) and engine.compatible(k, token, s)]
            near = [x for x in near if 0 < x[0] <= engine.threshold(x[2])]
            assert own.nearest(token) == (min(near)[2:] if near else None)
        a, b, most = draw("abc", 0, 12), draw("abc", 0, 12), r.randrange(0, 5)
        d = levenshtein(a, b)
        assert engine.distance(a, b, most) == d if d <= most else engine.distance(a, b, most) > most


def test_hot_sessions_are_dealt(spark):
    """One session with 20,000 pairs and 6,000 replies: in slices, equal to what slices of one row give."""
    pairs = spark.range(20_000).selectExpr("CAST(7 AS INT) AS session_id", "concat('user', lpad(CAST(id * 7919 % 1000003 AS STRING), 7, '0'), '@masked.dev') AS substitute", "concat('o', id) AS original", "'NAME' AS norm_type")
    replies = spark.range(6_000).selectExpr("id AS reply_id", "CAST(7 AS INT) AS session_id", "concat('see user', lpad(CAST(id * 7919 % 1000003 AS STRING), 7, '0'), '@masked.dev', CASE WHEN id < 500 THEN concat(' user', lpad(CAST(id * 7919 % 1000003 AS STRING), 7, '0'), '@masked.dex') ELSE '' END, ' end') AS text")
    rows = unmask.unmask_exact(replies, pairs)
    assert rows.where("exact rlike concat('^see o', reply_id, '( user.*)? end$')").count() == 6_000
    fuzzy = unmask.unmask_fuzzy(replies.where("reply_id < 500"), pairs, slice_rows=200)
    assert fuzzy.where("text = concat('see o', reply_id, ' o', reply_id, ' end') and size(fuzzy_spans) = 1").count() == 500
    assert "_slice" in rows._jdf.queryExecution().analyzed().toString()
    few = replies.where("reply_id < 40").unionByName(spark.createDataFrame([(-1, None, "S0"), (-2, 7, None), (-3, 8, "as it is")], "reply_id bigint, session_id int, text string"))
    small = pairs.limit(50).unionByName(spark.createDataFrame([(None, "S0", "null's own", "NAME"), (7, "", "no", "X")], "session_id int, substitute string, original string, norm_type string"))
    one = {r.reply_id: r for r in unmask.unmask_fuzzy(few, small, slice_rows=3).collect()}
    assert {k: tuple(r) for k, r in one.items()} == {r.reply_id: tuple(r) for r in unmask.unmask_fuzzy(few, small).collect()} and len(one) == 43
    assert (one[-1].text, one[-2].text, one[-3].text) == ("null's own", None, "as it is")


@pytest.mark.parametrize(
    ("kind", "original", "shape"),
    [
        ("PAN", "ABCDE1234F", r"[A-Z]{5}\d{4}[A-Z]"), ("AADHAAR", "1", r"\d{12}"), ("PHONE", "1", r"[6-9]\d{9}"), ("EMAIL", "a@gmail.com", r"user\d{5}@masked\.dev"), ("EMAIL", "a@b.co.in", r"user\d{5}@b\.co\.masked\.dev"),
        ("CREDIT_CARD", "4111 1111 1111 1111", r"\d{16}"), ("CREDIT_CARD", "1", r"\d{13}"), ("NAME", "x", r"[A-Z][a-z]+"), ("MONEY", "Rs 100 only", r"Rs (7[5-9]|8\d|90|11\d|12[0-5])\.\d\d only"), ("MONEY", "none", r"\d{3,4}\.\d\d"),
        ("IP", "10.0.0.1", r"\d{1,3}(\.\d{1,3}){3}"), ("IP", "::1", r"[1-9a-f][0-9a-f]{3}(:[1-9a-f][0-9a-f]{3}){7}"), ("URL", "x", r"https://[a-z.]+/r/[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"), ("", "Ab-9é", r"[A-Z][a-z]-\dé"), ("", "", r"[a-z]{4}"),
    ],
)
def test_shapes(kind, original, shape):
    made = [substitute(kind, original, salt) for salt in range(40)]
    assert all(re.fullmatch(shape, x) for x in made) and made == [substitute(kind, original, str(salt)) for salt in range(40)]


def test_names_seldom_collide():
    assert len({substitute("NAME", f"person {k}", 1) for k in range(200)}) > 180
    assert substitute("NAME", "x", None) == substitute("NAME", "x", "")


def test_dates():
    cases = [("2024-02-28", 2, "2024-03-01"), ("on 31/12/2023.", 1, "on 01/01/2024."), ("15-09-2024", -15, "31-08-2024"), ("2023-02-31", 0, "2023-03-03"), ("2024-13-01", 5, "2020-01-06"), ("x", -1, "2019-12-31"), ("1/2 15-09-2024", 0, "1/2 15/09/2024"), ("0000-01-01", 1, "0000-01-02")]
    assert [date_shift(o, days) for o, days, _ in cases] == [want for *_, want in cases]


def test_columns_and_strings_agree(spark):
    row = spark.createDataFrame([("7", "PHONE", "1"), (None, "INDIAN_PHONE", "1"), ("7", "PHONE", None)], "s string, k string, o string").select(substituted(F.col("k"), F.col("o"), F.col("s")).alias("x")).collect()
    assert [r.x for r in row] == [substitute("PHONE", "1", 7), substitute("PHONE", "1", None), None]


def test_redaction(spark):
    rows = mask.redact_pii(texts(spark, "PAN ABCDE1234F tel 9876543210 mail a@b.co id 123456789012", "é", "")).orderBy("doc_id").collect()
    assert [r.redacted for r in rows] == ["PAN XXXXXXXXXX tel XXXXXXXXXX mail XXXXXX id XXXXXXXXXXXX", "é", ""]


def test_chunks(spark):
    for n, want in ((1000, [(0, 512), (448, 960), (896, 1000)]), (1200, [(0, 512), (448, 960), (896, 1200)]), (3, [(0, 3)])):
        rows = chunk.chunks(texts(spark, " ".join(f"w{k}" for k in range(n)))).orderBy("start_token").collect()
        assert [(r.start_token, r.end_token) for r in rows] == want
    assert chunk.chunks(texts(spark, " ".join(["w"] * 5000))).count() == 12
    assert chunk.chunks(texts(spark, "", "  ")).count() == 0 and chunk.chunks(texts(spark, "a b"), 0, 0).count() == 0
    assert [r.text for r in chunk.chunks(texts(spark, " é  b\tc "), 2, 5).orderBy("start_token").collect()] == ["é  b", "b\tc"]


def test_long_documents(spark):
    words = [f"t{k}" for k in range(600)]
    words[500] = "test@example.com"
    words[10] = "secret"
    rows = chunk.tier4_detect(texts(spark, " ".join(words), " ".join(["w"] * 50_001))).collect()
    assert sorted((r.doc_id, r.entity_type or r.error) for r in rows) == [(0, "EMAIL"), (0, "KEYWORD"), (1, chunk.TOO_LONG)]
    found = next(r for r in rows if r.entity_type == "EMAIL")
    assert " ".join(words).encode()[found.start : found.end] == b"test@example.com"


def test_summary(spark):
    rows = mask.mask_summary(texts(spark, "Priya ABCDE1234F 123412341234", "x")).orderBy("doc_id").collect()
    assert [r.summary for r in rows] == ["Hidden: 1 name, 1 PAN, 1 Aadhaar", "Hidden: 0 names, 0 PAN, 0 Aadhaar"]


def test_dataset(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b"], ["0", "7"]), (["a"], ["0", "1"]), ([], []), (["a"], ["x"]), (None, ["1"])], "tokens array<string>, ner_tags array<string>")
    assert [tuple(map(tuple, r)) for r in dataset.clean(rows).collect()] == [(("a", "b"), (0, 7))]
    with pytest.raises(ValueError):
        dataset.require_rows(rows.where("false"))
    with pytest.raises(Exception, match="unknown tag"):
        rows.select(dataset.label_ids(F.array(F.lit("B-NO")))).collect()
    one = rows.limit(1).select(dataset.label_ids(F.array(F.lit("B-MONEY"), F.lit("O"))).alias("i"), dataset.without_misc(F.array(*map(F.lit, (7, 8, 3)))).alias("m")).first()
    assert (one.i, one.m) == ([7, 0], [0, 0, 3])
    for made in (dataset.synthetic_ner(spark, 60), dataset.synthetic_money_date(spark, 60)):
        own = made.collect()
        assert all(len(r.tokens) == len(r.ner_tags) and r.ner_tags[:2] == ["B-PER", "I-PER"] for r in own) and len({tuple(t[:1] for t in r.ner_tags) for r in own}) > 2
    files.write_examples(dataset.synthetic_ner(spark, 5).select("tokens", "ner_tags"), str(tmp_path / "x"))
    assert files.read_examples(spark, str(tmp_path / "x"), array=False).count() == 5
    (tmp_path / "a.json").write_text(json.dumps([{"tokens": ["é"], "ner_tags": ["O"]}]))
    assert files.read_examples(spark, str(tmp_path / "a.json")).first().tokens == ["é"]
    (tmp_path / "l.txt").write_text("aa, en, zh-min-nan\n3 languages: 174\n")
    assert [r.code for r in files.read_languages(spark, str(tmp_path / "l.txt")).collect()] == ["aa", "en", "zh-min-nan"]
    assert files.preview(rows, 1)[0] == ["tokens", "ner_tags"]


def test_metrics(spark):
    rows = spark.createDataFrame([(["B-PER", "I-PER", "O", "B-LOC"], ["B-PER", "I-PER", "O", "B-ORG"]), (["I-PER", "I-LOC", "O", "O"], ["B-PER", "B-LOC", "O", "O"])], "pred array<string>, true array<string>")
    s = metrics.scores(rows).first()
    assert (s.precision, s.recall, s.f1) == (0.75, 0.75, 0.75)
    one = rows.limit(1).select(metrics.argmax(F.array(*map(F.lit, (1.0, 3.0, 3.0)))).alias("a"), metrics.similarity(F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (1, 2, 0, 4)))).alias("s"), metrics.entities(F.col("pred")).alias("e")).first()
    assert one.a == 1 and one.s == 75.0 and [tuple(x) for x in one.e] == [("PER", 0, 1), ("LOC", 3, 3)]


def test_stream(spark, tmp_path):
    from maskloom.streaming.masking import mask_stream, to_memory

    docs = texts(spark, "PAN ABCDE1234F", "mail a@b.co")
    docs.write.parquet(str(tmp_path / "in"))
    stream = mask_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    to_memory(stream, "masked_stream", str(tmp_path / "c")).awaitTermination(60)
    got = {r.doc_id: r.masked for r in spark.table("masked_stream").collect()}
    assert got == {r.doc_id: r.masked for r in mask.mask_pipeline(docs).collect()}


def test_single_strings():
    from maskloom import api

    session = api.Session()
    assert session.unmask_reply("x") == "x" and json.loads(session.unmask_reply_json("x")) == {"text": "x", "fuzzy_spans": []}
    text = "PAN ABCDE1234F and a.b@corp.co"
    masked = session.mask_with_ner_json(text, '[{"label":"TAG","start":15,"end":18}]', '["pan"]', mock=False)
    assert "ABCDE1234F" not in masked and "and" not in masked.split()[2:3] and session.unmask_reply(masked) == text
    assert json.loads(session.unmask_reply_json(masked))["text"] == text
    session.wipe()
    assert session.unmask_reply(masked) == masked
    assert "Acme" not in session.mask_with_rules_json("Acme 1", '[{"pattern":"Acme","replacement_type":"ORG"}]') and session.mask_with_keywords_json("alpha", '["alpha"]') != "alpha"
    assert json.loads(session.mask_text_profiled(text))["input_len"] == len(text) and session.mask_summary(text).startswith("Hidden: ")
    assert [d[0] for d in api.scan_valid_text(text)] == ["PAN", "EMAIL"] and len(api.scan_text("111111111111")) == 1
    assert [s[3] for s in api.detect_keywords("a Secret")] == ["Secret"] and [c[3] for c in api.chunk_text("a b c", 2, 1)] == ["a b", "b c"]
    with pytest.raises(ValueError, match="limit"):
        api.tier4_detect("w " * 50_001)
    assert api.redact_pii("ABCDE1234F", "#") == "#" * 10
    assert re.fullmatch(r"[6-9]\d{9}", api.generate_substitute("INDIAN_PHONE", "9876543210")) and re.fullmatch("[A-Z]{2}", api.generate_substitute("ORG", "AB"))
