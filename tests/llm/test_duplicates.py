"""Suffix removal and the near-duplicate join, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskloom.llm import rtree, suffix


def test_bounded_expansion_is_the_sorted_truth():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, kinds, length = int(r.integers(1, 200)), int(r.integers(2, 6)), int(r.integers(2, 60))
        x = r.integers(0, kinds, n)
        if r.random() < 0.5:
            x = np.concatenate([x, x[: n // 2], x[n // 3 :]])
        x = (np.cumsum(np.bincount(x) > 0) - 1)[x].astype(np.int64)
        order, marked = suffix.equal_windows(x, length)
        d = np.concatenate([x] * (length // len(x) + 2))
        s = [tuple(d[i : i + length]) for i in order]
        assert s == sorted(s)
        assert marked.tolist() == [True, *(s[i] != s[i - 1] for i in range(1, len(s))), True]


def removed(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def check_removal(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, **options).collect())
    assert got == removed(rows)


def test_removal_odd(spark, odd, odd_rows, none):
    check_removal(spark, [x[:2] for x in odd_rows if not x[1] or len(x[1]) < 100_000], block_bytes=700)
    assert suffix.remove_repeats(none).count() == 0
    kept = suffix.remove_repeats(odd, texts=True)
    assert kept.schema == odd.schema
    rows = Counter((r.doc_id, r.n, r.payload, r.block_id, r.score) for r in kept.collect())
    assert rows == Counter((x[0], x[8], x[9], x[6], x[7]) for x in odd_rows)
    assert {r.text for r in kept.where("doc_id in (2, 4)").collect()} == {"", None}


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_random(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab \né") for _ in range(r.randrange(30, 160))) for _ in range(12)]
    rows = [(k // 2 if k % 7 == 0 else k, "".join(r.choice(pool)[r.randrange(0, 20) :] for _ in range(r.randrange(0, 5)))) for k in range(60)]
    check_removal(spark, rows, block_bytes=2000)


def components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    by = defaultdict(list)
    for k in range(len(rows)):
        by[find(k)].append(rows[k][0])
    least = {k: min((i for i in own if i is not None), default=None) for k, own in by.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def linked(spark, rows, n, percent, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out, _, _ = rtree.link(docs, n, percent, **options)
    return Counter((r.doc_id, r.n, r.component_id) for r in out.collect())


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = r.choice(["zeta", "eta", "theta"]) + str(r.randrange(50))
    return " ".join(words)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_join_random(spark, n, percent):
    r = random.Random(percent)
    rows = []
    for _ in range(25):
        base = [r.choice("abcdefghijkl") + str(r.randrange(9)) for _ in range(r.randrange(5, 120))]
        rows += [(len(rows) + k, edited(r, base, r.randrange(0, 1 + len(base) // 15))) for k in range(r.randrange(1, 8))]
    assert linked(spark, rows, n, percent, block_bytes=3000) == components(rows, n, percent)


def test_join_odd(spark, odd_rows, none, odd):
    rows = [x[:2] for x in odd_rows]
    assert linked(spark, rows, 3, 90) == components(rows, 3, 90)
    assert rtree.link(none, 3, 90)[0].count() == 0
    kept = rtree.keep_one(odd, 5, 80)
    assert kept.schema == odd.schema
    want = components(rows, 5, 80)
    assert kept.count() == sum(k for x, k in want.items() if not x[1]) + len({x[2] for x in want if x[1]})
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 8}


def test_tiles_lose_no_link(spark):
    """A cluster beyond one unit is dealt into tiles; chains across tiles still connect."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, edited(r, base, r.randrange(0, 3))) for k in range(60)]
    chain = list(base)
    for k in range(25):
        chain[2 * k] = f"c{k}"
        rows.append((100 + k, " ".join(chain)))
    assert linked(spark, rows, 2, 80, unit=400) == components(rows, 2, 80)


def test_large_files_lose_no_link(spark):
    """Files beyond the bound's size become clusters whole; the result is the same, in units and in tiles."""
    r = random.Random(10)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, edited(r, base, r.randrange(0, 4))) for k in range(50)] + [(100 + k, edited(r, [f"v{k % 3}{j}" for j in range(20)], 1)) for k in range(30)]
    want = components(rows, 2, 80)
    assert linked(spark, rows, 2, 80, file=2) == want and linked(spark, rows, 2, 80, file=2, unit=400) == want


def test_points_of_all_sizes():
    """Sets of sizes on several steps: what the bound and the count connect is what counting all pairs connects; unrelated long sets are no candidates."""
    r = np.random.default_rng(4)
    law = rtree.Law(80)
    sets = []
    for n in (100, 1900, 2500, 5000, 9000, 30_000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        for k in range(6):
            own = base.copy()
            cut = r.integers(0, n, n * k // 15)
            own[cut] = r.integers(0, 2**63, len(cut), dtype=np.uint64)
            sets.append(np.unique(own[: n - n * k // 40]))
    sets = [np.unique(rtree.mix64(s)) for s in sets]
    sizes, points = np.array(list(map(len, sets))), list(map(rtree.counts, sets))
    root = {k: k for k in range(len(sets))}
    for i in range(len(sets)):
        for j in range(i):
            o = np.intersect1d(sets[i], sets[j]).size
            if 100 * o >= 80 * (sizes[i] + sizes[j] - o):
                a, b = root[i], root[j]
                root = {k: (b if v == a else v) for k, v in root.items()}

    def groups(a, b):
        out = {k: k for k in range(len(sets))}
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = out[x], out[y]
            out = {k: (q if v == p else v) for k, v in out.items()}
        return {frozenset(k for k in out if out[k] == v) for v in out.values()}

    want = {frozenset(k for k in root if root[k] == v) for v in root.values()}
    verified = rtree.by_size(points, sizes, law, lambda own, p, n: rtree.verified_links([sets[k] for k in own.tolist()], p, n, law))
    assert groups(*verified) == want and 6 <= len(want) < 36
    bound = groups(*rtree.by_size(points, sizes, law, lambda own, p, n: rtree.bounded_links(p, n, law)))
    assert all(any(w <= b for b in bound) for w in want)
    apart = [np.unique(rtree.mix64(r.integers(0, 2**63, n, dtype=np.uint64))) for n in (10_000, 10_000, 30_000, 30_000, 100_000, 100_000)]
    assert not len(rtree.by_size(list(map(rtree.counts, apart)), np.array(list(map(len, apart))), law, lambda own, p, n: rtree.bounded_links(p, n, law))[0])


def test_rtree_finds_all_that_the_bound_allows():
    r = np.random.default_rng(3)
    points = r.integers(0, 9, (400, rtree.GROUPS))
    points[200:] = points[:200] + (r.random((200, rtree.GROUPS)) < 0.1)
    sizes, law = points.sum(axis=1), rtree.Law(90)
    tree = rtree.RTree(points, sizes)
    for i in range(0, 400, 7):
        want = [j for j in range(400) if law.smallest(sizes[i]) <= sizes[j] <= sizes[i] * 100 // 90 and np.minimum(points[i], points[j]).sum() >= law.need(int(sizes[i]), int(sizes[j]))]
        assert sorted(tree.search(i, law).tolist()) == want


def test_components(spark):
    from maskloom.llm.common import Scratch

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (203, 201), (300, 300)]
    out = rtree.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark), "t").collect()
    got = {r.entry: r.root for r in out}
    assert len(out) == len(got) == 45 and {got[k] for k in [*range(41), 100]} == {0} and {got[k] for k in (200, 201, 203)} == {200}
