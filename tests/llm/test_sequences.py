"""Sharding, packing, BPE and media."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from maskloom.llm import bpe, media, packing, sharding

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 3)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, 3, back=True) == np.arange(n)).all()
    shard, slot = sharding.place(n - 1, n, 24, 3)
    assert sharding.row_at(shard, slot, n, 24, 3) == n - 1


def test_shards(odd, odd_rows, none):
    rows = sharding.shard(odd, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in odd_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sharding.place(r.row_number, len(rows), 5, 20) and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(r.row_number for r in rows) == list(range(len(rows)))
    again = sharding.shard(odd.repartition(7), 5).collect()
    key = lambda rs: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(rows) == key(again)
    assert sharding.shard(none, 5).count() == 0


def test_nnls():
    r = np.random.default_rng(0)
    a, want = r.random((20, 8)), np.array([0, 2.0, 0, 1, 3, 0, 0, 5])
    assert np.allclose(packing.nnls(a, a @ want, 50), want, atol=1e-6)
    assert all(sum(c) == 16 and len(c) <= 3 for c in packing.combinations(16, 3))
    assert len(packing.combinations(16, 3)) == len(set(packing.combinations(16, 3))) == sum(1 for a in range(1, 17) for b in range(a, 17) for c in range(b, 17) if a + b + c == 16) + 8 + 1


@pytest.mark.parametrize("shape", ["even", "short", "one", "sparse"])
def test_nnls_ends_at_the_least_residual(shape):
    """With the production matrix and number of rounds: no column that is out would lower the residual, those that are in leave no slope."""
    r = np.random.default_rng(6)
    a = packing._matrix(packing.UNITS, packing.DEPTH)
    draw = {"even": r.integers(0, 300, packing.UNITS), "short": 2000 * np.exp(-np.arange(packing.UNITS) / 9), "one": np.eye(packing.UNITS)[40] * 5000, "sparse": r.integers(0, 300, packing.UNITS) * (r.random(packing.UNITS) < 0.1)}
    b = draw[shape].astype(float).round()
    x = packing.nnls(a, b, 2 * packing.UNITS)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() <= 1e-6 * max(1.0, b.max()) and np.abs(slope[x > 0]).max(initial=0) <= 1e-6 * max(1.0, b.max())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=300))
def test_plan(lengths):
    own = np.array(lengths, np.int64)
    seqs = packing.plan(own, 256, units=32)
    assert sorted(i for s in seqs for i in s) == list(range(len(own)))
    assert all(own[s].sum() <= 256 for s in seqs)


def test_packing(odd, odd_rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(odd, WORDS, 64, 2, group_tokens=20_000).collect()
    ids = {x[1]: [*library.encode(x[1] or "", add_special_tokens=False).ids, 2] for x in odd_rows}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    for x in odd_rows:
        own = ids[x[1]]
        mine = [r for r in pieces[x[0], len(own)] if r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())]
        covered = Counter(k for r in mine for k in range(r.start, r.start + r.length))
        assert set(covered) == set(range(len(own)))
    assert sum(r.length for r in rows) == sum(len(ids[x[1]]) for x in odd_rows)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length, r.padded_length))
    for own in used.values():
        at = 0
        for offset, length, padded in sorted(own):
            assert offset == at and (padded == 64 or padded & (padded - 1) == 0)
            at += length
            assert at <= padded
    assert packing.pack(none, WORDS, 64).count() == 0


TEXTS = ["", "a", "  a  b\n\n c ", "<|endoftext|>x<|endoftext|>", "日本語 テスト 　x\x1c\x85 ", "'s't'S it's", "x" * 500, "\U0001f600 \U0001f468‍\U0001f469", "\r\n\t  12½²x", "don't  we'll 'Re"]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_and_words_like_the_library(text):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTES), bpe.codec(BYTES)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    words = Tokenizer.from_file(WORDS)
    assert packing.tokenizer(WORDS).encode([text], 2)[0].tolist() == [*words.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    library, own = Tokenizer.from_file(BYTES), bpe.codec(BYTES)
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_merge_is_the_plain_one():
    own = bpe.codec(BYTES)

    def plain(word):
        ids = [own.byte_id[b] for b in word]
        while True:
            found = [(m, i) for i in range(len(ids) - 1) if (m := own.merges.get(ids[i] << own.shift | ids[i + 1])) is not None]
            if not found:
                return ids
            m, i = min(found)
            ids[i : i + 2] = [m & ((1 << own.shift) - 1)]

    for word in [b"ab", b"hello", b"aaaaaaaaaaaaaaaa", b"internationalization", bytes(range(256)), b"the" * 40]:
        assert own.merge(word) == plain(word)


def test_bpe_rows(odd, odd_rows, none):
    rows = bpe.encode_documents(odd, BYTES).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((x[0], x[1] or "") for x in odd_rows)
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(odd, BYTES), BYTES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((x[0], x[1] or "") for x in odd_rows)
    assert bpe.encode_documents(none, BYTES).count() == 0


PAGE = """<html><title>no</title><body><h1>Head</h1><p>One <b>two</b></p><img src="sha256:aa" alt="first"><script>x()</script>
<figure><img src="sha256:bb"><figcaption>A &amp; caption</figcaption></figure>tail<video src="http://v"></video></body>"""


def test_items():
    items = media.parse_items(PAGE)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [("text", "Head", None), ("text", "One two", None), ("image", "sha256:aa", "first"), ("image", "sha256:bb", "A & caption"), ("text", "tail", None), ("media", "http://v", None)]
    assert [i["position"] for i in items] == list(range(6)) and media.parse_items(None) == []


def test_media_rows(odd, odd_rows, none, spark):
    rows = media.document_media(odd).collect()
    want = Counter()
    for x in odd_rows:
        p = media.padded((x[1] or "").encode())
        want[x[0], len((x[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    lines = {x[0]: [bool(line.split()) for line in (x[1] or "").split("\n")] for x in odd_rows if x[0] is not None}
    assert all(r.caption == f"{r.n_bytes} bytes" for r in rows) and all((r.position, r.n_items) == (int(lines[r.doc_id][0]), 1 + sum(lines[r.doc_id])) for r in rows if r.doc_id is not None)
    assert media.document_media(none).count() == 0
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    store = spark.createDataFrame([("aa", 5)], "digest string, width int")
    found = media.resolve(media.sequences(pages), store).orderBy("position").collect()
    assert [(r.page_id, r.position, r.caption, r.digest, r.width) for r in found] == [(1, 2, "first", "aa", 5), (1, 3, "A & caption", "bb", None)]


def test_damaged_image():
    image = bytearray(media.to_image(media.padded(b"abc")))
    assert media.samples_of(bytes(image)).tobytes() == media.padded(b"abc")
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.samples_of(bytes(image))


def test_other_references_stay_unresolved(spark):
    media_rows = spark.createDataFrame([("aa", 5), ("http://v", 6)], "digest string, payload_bytes bigint")
    pages = spark.createDataFrame([(1, PAGE), (2, '<img src="aa" alt="local">'), (3, None)], "page_id bigint, html string")
    rows = media.resolve(media.sequences(pages), media_rows, every=True).collect()
    want = [(1, 2, "first", "aa", 5), (1, 3, "A & caption", "bb", None), (1, 5, None, None, None), (2, 0, "local", None, None)]
    assert sorted(((r.page_id, r.position, r.caption, r.digest, r.payload_bytes) for r in rows), key=lambda x: x[:2]) == want


def test_real_pages_and_documents_keep_their_words(spark):
    """Against a plain tag stripper: all words of a page in their order; a document's items are its lines with the figure after the first one."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    rows = media.sequences(pages).collect()
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        plain = re.sub(r"(?is)<!--.*?-->|<(script|style|title|noscript|template)\b.*?</\1\s*>|<!doctype[^>]*>", " ", raw[r.page_id] or "")
        plain = html.unescape(re.sub(r"</?(?:b|i|a|em|strong|span|u)\b[^>]*>", "", plain))
        assert " ".join(x.text for x in r["items"] if x.kind == "text").split() == re.sub(r"<[^>]*>", " ", plain).split()
        assert [x.position for x in r["items"]] == list(range(len(r["items"])))
    text = "a < b & c\n\n  <img src=x> \n&amp; é"
    page = spark.createDataFrame([(1, text)], "doc_id int, text string").select("doc_id", media.document_page(F.col("text"), F.lit("sha256:aa"), F.lit("cap")).alias("html"))
    items = media.sequences(page).first()["items"]
    assert [(x.kind, x.text, x.ref, x.caption) for x in items] == [("text", "a < b & c", None, None), ("image", None, "sha256:aa", "cap"), ("text", "<img src=x>", None, None), ("text", "&amp; é", None, None)]
