"""Exact removal of repeated passages: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of MATCH bytes over it also starts in a document with a smaller id. Equal strings must meet
without a global suffix array, so every window of MATCH bytes is filed under its minimizer, the gram of GRAM bytes with the
least hash in it: equal windows have equal minimizers at equal places. A minimizer and the windows that it owns are a
context. Four steps, each over blocks of whole documents (see ``common.pack_blocks``):

1. Each block reports its distinct minimizers with their smallest and largest document; a bucket of minimizers tells
   the blocks which of them lie in two documents.
2. Each block sends the contexts of those, each distinct one once with its smallest and largest document.
3. A bucket joins its distinct contexts into one text, sorts its suffixes to a depth of at least MATCH, and takes the BWT. Starting
   from the empty string's interval, backward extension by every symbol yields the intervals of all strings by increasing
   length; where an interval of length l + 1 ends at a boundary not yet marked, the common prefix there is l, and only such
   intervals are extended further. The expansion stops at MATCH: boundaries still unmarked have longer common prefixes. So
   windows between two marks are equal; the smallest document among them answers for all.
4. Each block receives, for its contexts, the windows whose smallest document precedes its own, and removes.

Contexts are aggregated in their block before they are shuffled, so a passage in a third of all documents sends one row a block,
not one a document. Grams and contexts are compared by 64-bit hashes, windows byte by byte.

Defined results: null and empty texts have nothing to remove; rows with the same id don't remove from each other; rows with a null
id keep their text and remove nothing; texts shorter than MATCH are kept; other columns travel with their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, Scratch, from_ipc, mix64, nothing_kept, pack_blocks, packed, prepare, range_hashes, shuffle_partitions, texts_of, unpacked

MATCH, GRAM, BLOCK_BYTES, STEP, TEXT = 50, 24, 4_000_000, 1 << 15, 100_000
HALF = (MATCH - GRAM) // 2
WORDS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def _gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(a * WORDS[0] + b * WORDS[1] + c * WORDS[2])


def _minimizers(data: np.ndarray) -> np.ndarray:
    """For each window of MATCH bytes, the place of its minimizer; ties go to the leftmost."""
    n, span = len(data) - MATCH + 1, MATCH - GRAM + 1
    out = np.empty(n, np.int32)
    low = np.uint64(0xFFFF)
    for at in range(0, n, STEP):
        to = min(n, at + STEP)
        part = data[at : to + MATCH - 1].astype(np.uint64)
        two = part[:-1] | part[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        m = to - at + span - 1
        h = _gram_hash(eight[:m], eight[8 : 8 + m], eight[16 : 16 + m])
        h = (h & ~low) | np.arange(m, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: to - at], h[span - width : span - width + to - at])
        out[at:to] = (h & low).astype(np.int32) + np.int32(at)
    return out


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each minimizer, the first and last start of the windows that it owns, and its place; no window crosses documents."""
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none.astype(np.uint64), none, none, none
    where = _minimizers(data)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.maximum(starts[:-1], starts[1:] - MATCH + 1), 1)
    np.add.at(change, starts[1:], -1)
    valid = np.cumsum(change, out=change)[: len(where)] == 0
    del change
    edge = np.flatnonzero((where[1:] != where[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(where)]]) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    place = where[first].astype(np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[place]).view("<u8").astype(np.uint64)
    # Minimizers have small hashes; mixed once more, they spread over buckets.
    key = mix64(_gram_hash(grams[:, 0], grams[:, 1], grams[:, 2]) + np.uint64(MULTIPLIER)) if len(grams) else none.astype(np.uint64)
    return key, first, last, place


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``first``, one after the other."""
    ends = np.cumsum(size, dtype=first.dtype)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0, dtype=first.dtype)


def grams_of(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """As many symbols from each place of a cyclic text as fit into 62 bits, as a number, and how many."""
    bits = max(1, int(symbols.max()).bit_length())
    key, have = symbols.astype(np.int64), 1
    while 2 * have * bits <= 62:
        key = key << have * bits | np.roll(key, -have)
        have *= 2
    return key, have


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rotations of a text in the order of their first ``depth`` symbols at least, by prefix doubling where ties are left.

    Also: for each mark between neighbours (mark j stands before rotation j) how many symbols they share, as far as their first grams tell, and the grams' length.
    """
    n = len(symbols)
    key, have = grams_of(symbols)
    order = np.argsort(key)
    done = key[order]
    new = np.concatenate([[True], done[1:] != done[:-1]])
    bits = max(1, int(symbols.max()).bit_length())
    shared = np.full(n + 1, -1, np.int8)
    differ = (done[1:] ^ done[:-1]).astype(np.float64)
    shared[1:-1] = np.where(new[1:], have - 1 - (np.frexp(differ)[1] - 1) // bits, have)
    gram, slots = have, np.flatnonzero(~new | ~np.concatenate([new[1:], [True]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while have < depth and len(slots):
        own = order[slots]
        pair = rank[own] << 32 | rank[(own + have) % n]
        by = np.argsort(pair)
        own, pair = own[by], pair[by]
        order[slots] = own
        start = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[own] = slots[np.maximum.accumulate(np.where(start, np.arange(len(slots)), 0))]
        slots = slots[~start | ~np.concatenate([start[1:], [True]])]
        have *= 2
    return order, shared, gram


def equal_windows(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a cyclic text, and marks on its boundaries whose common prefix is below ``length``.

    Bounded breadth-first backward extension on the BWT. The first levels are read off the grams by which the suffixes were
    sorted: marks between different grams, and as first intervals those of grams whose last symbol alone sets them
    apart from the next. Mark j stands before suffix j; marks 0 and n are always set.
    """
    n = len(symbols)
    order, shared, gram = suffix_order(symbols, length)
    marked = shared < min(gram, length)
    if gram >= length:
        return order, marked
    bwt = symbols[order - 1].astype(np.uint16)
    by = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by] = np.arange(n, dtype=np.int32)
    nxt, prv = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = bwt[by[1:]] == bwt[by[:-1]]
    nxt[by[:-1][same]] = by[1:][same]
    prv[by[1:][same]] = by[:-1][same]
    ends = np.flatnonzero(marked).astype(np.int32)
    first = shared[ends[1:]] == gram - 1
    low, high = ends[:-1][first], ends[1:][first]
    for _ in range(gram, length):
        if not len(low):
            break
        size = high - low
        at = _ranges(low, size)
        lows, highs = np.repeat(low, size), np.repeat(high, size)
        # Of each symbol in an interval, its first and last place lead to the ends of the extended interval.
        begin = np.sort(step[at[prv[at] < lows]])
        end = np.sort(step[at[nxt[at] >= highs]]) + 1
        fresh = ~marked[end]
        low, high = begin[fresh], end[fresh]
        marked[high] = True
    return order, marked


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bounds(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which of them are not null."""
    import pyarrow.compute as pc

    column = column.cast(pa.int64())
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def _block(payload: Any, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table, bytes, starts; key, first and last window, and place of the anchors of documents with an id; the anchors' documents (row numbers)."""
    nothing_kept()
    table = from_ipc(payload)
    data, starts = texts_of(table.column(text_col))
    key, first, last, place = anchors(data, starts)
    doc = np.searchsorted(starts, first, "right") - 1
    has = _ids(table.column(id_col))[1][doc] if len(doc) else np.zeros(0, bool)
    return table, data, starts, key[has], first[has], last[has], place[has], doc[has]


def _grouped(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, first of each key in it, and each key's smallest and largest value."""
    order = np.argsort(key, kind="stable")
    at = _bounds(key[order])
    if not len(at):
        return order, at, low[:0], high[:0]
    return order, at, np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


def _reports(buckets: int, id_col: str, text_col: str) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, _, _, key, _, _, _, doc = _block(payload.as_buffer(), id_col, text_col)
                ids = _ids(table.column(id_col))[0][doc]
                order, at, low, high = _grouped(key, ids, ids)
                key = key[order][at]
                rows: list[list[Any]] = [[], [], [], [], []]
                bucket = _bucket(key, buckets)
                edge = [*_bounds(bucket).tolist(), len(key)]
                for a, b in zip(edge, edge[1:], strict=False):
                    for out, x in zip(rows, (int(bucket[a]), block, b - a, packed(np.diff(key[a:b], prepend=np.uint64(0))), packed(np.concatenate([low[a:b], high[a:b] - low[a:b]]))), strict=True):
                        out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.binary())], ["bucket", "block_id", "n", "keys", "docs"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: which minimizers lie in two documents, as a row for each block."""
    n = table.column("n").to_pylist()
    keys, low, high = [], [], []
    for k, a, b in zip(n, table.column("keys").to_pylist(), table.column("docs").to_pylist(), strict=True):
        keys.append(np.cumsum(unpacked(a, k, np.uint64), dtype=np.uint64))
        d = unpacked(b, 2 * k, np.int64)
        low.append(d[:k])
        high.append(d[:k] + d[k:])
    key = np.concatenate(keys)
    order, at, least, most = _grouped(key, np.concatenate(low), np.concatenate(high))
    both = np.repeat(least < most, np.diff(np.append(at, len(key))))
    wanted = np.zeros(len(key), bool)
    wanted[order[both]] = True
    ends = np.cumsum(n)
    blocks, rows = table.column("block_id").to_pylist(), []
    for block, k, end in zip(blocks, n, ends.tolist(), strict=True):
        own = key[end - k : end][wanted[end - k : end]]
        if len(own):
            rows.append((block, len(own), packed(np.diff(own, prepend=np.uint64(0)))))
    return pa.table({"block_id": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary())})


def _contexts(buckets: int, id_col: str, text_col: str) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, parts in zip(batch.column("block_id").to_pylist(), batch.column("payload"), batch.column("parts").to_pylist(), strict=True):
                wanted = np.sort(np.concatenate([np.cumsum(unpacked(p["keys"], p["n"], np.uint64), dtype=np.uint64) for p in parts]))
                table, data, _, key, first, last, place, doc = _block(payload.as_buffer(), id_col, text_col)
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                key, first, end, place, ids = key[hit], first[hit], last[hit] + MATCH, place[hit], _ids(table.column(id_col))[0][doc[hit]]
                named = range_hashes(data, first, end)
                order, at, low, high = _grouped(named, ids, ids)
                one = order[at]
                named, key, first, size, place = named[one], key[one], first[one], (end - first)[one], (place - first)[one]
                bucket = _bucket(key, buckets)
                order = np.argsort(bucket, kind="stable")
                edge = [*_bounds(bucket[order]).tolist(), len(order)]
                rows: list[tuple[Any, ...]] = []
                for a, b in zip(edge, edge[1:], strict=False):
                    own = order[a:b]
                    text = data[_ranges(first[own], size[own])].tobytes()
                    rows.append((int(bucket[own[0]]), block, b - a, len(text), packed(named[own]), packed(np.concatenate([size[own], place[own], low[own], high[own] - low[own]])), pa.compress(text, codec="zstd", asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 4 + [pa.binary()] * 3)], ["bucket", "block_id", "n", "size", "named", "numbers", "text"])

    return run


def _runs(data: np.ndarray, begin: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of contexts that start in a smaller document too: the context's number, first window, windows, that document."""
    # One text: each context, then a symbol that no text has.
    symbols = np.zeros(int(length.sum()) + len(begin), np.int64)
    place = np.cumsum(length + 1) - length - 1
    symbols[_ranges(place, length)] = data[_ranges(begin, length)].astype(np.int64) + 1
    there = np.bincount(symbols) > 0
    suffixes, marked = equal_windows((np.cumsum(there) - 1)[symbols], MATCH)
    windows = length - MATCH + 1
    starts = _ranges(place, windows)
    smallest = np.full(len(symbols), np.iinfo(np.int64).max)
    smallest[starts] = np.repeat(least, windows)
    group = np.cumsum(marked[:-1]) - 1
    smallest[suffixes] = np.minimum.reduceat(smallest[suffixes], np.flatnonzero(marked[:-1]))[group]
    found, context = smallest[starts], np.repeat(np.arange(len(begin)), windows)
    hit = np.flatnonzero(found < most[context])
    if not len(hit):
        return (np.zeros(0, np.int64),) * 4
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (context[hit[1:]] != context[hit[:-1]]) | (found[hit[1:]] != found[hit[:-1]])]))
    own = context[hit[edges]]
    return number[own], hit[edges] - (np.cumsum(windows) - windows)[own], np.diff(np.append(edges, len(hit))), found[hit[edges]]


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket: windows of each block's contexts that also start in a smaller document, as runs."""
    n = table.column("n").to_pylist()
    named, numbers, texts = [], [], []
    for k, size, a, b, c in zip(n, *(table.column(x).to_pylist() for x in ("size", "named", "numbers", "text")), strict=True):
        named.append(unpacked(a, k, np.uint64))
        numbers.append(unpacked(b, 4 * k, np.int64).reshape(4, k))
        texts.append(np.frombuffer(pa.decompress(c, decompressed_size=size, codec="zstd", asbytes=True), np.uint8))
    name, (size, place, low, above) = np.concatenate(named), np.concatenate(numbers, axis=1)
    high = low + above
    order, at, least, most = _grouped(name, low, high)
    begin = np.cumsum(size) - size
    data = np.concatenate(texts)
    one = order[at]
    # A window holds its minimizer with HALF bytes before or after it: contexts that share neither with another document have no match.
    live = np.zeros((2, len(one)), bool)
    for side, (a, b) in enumerate(((place[one] - HALF, place[one] + GRAM), (place[one], place[one] + GRAM + HALF))):
        fits = np.flatnonzero((a >= 0) & (b <= size[one]))
        by, edge, lo, hi = _grouped(range_hashes(data, begin[one[fits]] + a[fits], begin[one[fits]] + b[fits]), least[fits], most[fits])
        live[side, fits[by[np.repeat(lo < hi, np.diff(np.append(edge, len(by))))]]] = True
    alive = np.flatnonzero(live.any(axis=0))
    where = np.full(len(one), -1)
    where[alive] = np.arange(len(alive))
    context_of = np.empty(len(name), np.int64)
    context_of[order] = np.repeat(where, np.diff(np.append(at, len(name))))
    one, least, most = one[alive], least[alive], most[alive]
    none = pa.table({"block_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "named": pa.array([], pa.binary()), "runs": pa.array([], pa.binary())})
    if not len(one):
        return none
    # Where only one side is shared, so are only windows that hold HALF bytes of it.
    skip = np.where(live[0, alive], 0, np.maximum(0, place[one] - HALF))
    length = np.where(live[1, alive], size[one], np.minimum(size[one], place[one] - HALF + MATCH)) - skip
    begin = begin[one] + skip
    # Texts of about TEXT bytes, by minimizer: equal windows are in one text, and a text's arrays in the processor's cache.
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[begin - skip + place[one]]).view("<u8").astype(np.uint64)
    texts_ = _gram_hash(grams[:, 0], grams[:, 1], grams[:, 2]) % np.uint64(max(1, int(length.sum()) // TEXT))
    by = np.argsort(texts_, kind="stable")
    found = [_runs(data, begin[own], length[own], least[own], most[own], own) for own in np.split(by, _bounds(texts_[by])[1:])]
    run_context, run_start, run_size, run_doc = (np.concatenate([f[k] for f in found]) for k in range(4))
    if not len(run_context):
        return none
    by = np.argsort(run_context, kind="stable")
    run_context, run_start, run_size, run_doc = run_context[by], run_start[by], run_size[by], run_doc[by]
    run_start = run_start + skip[run_context]
    run_first = np.searchsorted(run_context, np.arange(len(one)), "left")
    run_count = np.searchsorted(run_context, np.arange(len(one)), "right") - run_first
    rows, ends = [], np.cumsum(n)
    for block, k, end in zip(table.column("block_id").to_pylist(), n, ends.tolist(), strict=True):
        own = end - k + np.flatnonzero(context_of[end - k : end] >= 0)
        c = context_of[own]
        runs = _ranges(run_first[c], run_count[c])
        of = np.repeat(own, run_count[c])
        keep = run_doc[runs] < high[of]
        runs, of = runs[keep], of[keep]
        if len(runs):
            rows.append((block, len(runs), packed(name[of]), packed(np.concatenate([run_start[runs], run_size[runs], run_doc[runs]]))))
    return pa.table({"block_id": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "named": pa.array([r[2] for r in rows], pa.binary()), "runs": pa.array([r[3] for r in rows], pa.binary())})


def removal(data: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, named: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(data) + 1, np.int32)
    if len(named) and len(first):
        order = np.argsort(named, kind="stable")
        named, runs = named[order], runs[:, order]
        own = range_hashes(data, first, last + MATCH)
        a = np.searchsorted(named, own, "left")
        count = np.searchsorted(named, own, "right") - a
        row = _ranges(a, count)
        of = np.repeat(np.arange(len(own)), count)
        keep = runs[2, row] < ids[of]
        row, of = row[keep], of[keep]
        begin = first[of] + runs[0, row]
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + runs[1, row] - 1 + MATCH, -1)
    return np.cumsum(gone, out=gone)[:-1] > 0


def _removed(id_col: str, text_col: str, names: list[str], schema: pa.Schema) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, parts in zip(batch.column("payload"), batch.column("parts").to_pylist(), strict=True):
                table, data, starts, _, first, last, _, doc = _block(payload.as_buffer(), id_col, text_col)
                parts = parts or []
                named = np.concatenate([unpacked(p["named"], p["n"], np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
                runs = np.concatenate([unpacked(p["runs"], 3 * p["n"], np.int64).reshape(3, -1) for p in parts], axis=1) if parts else np.zeros((3, 0), np.int64)
                gone = removal(data, first, last, _ids(table.column(id_col))[0][doc], named, runs)
                total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[starts[:-1][starts[:-1] < len(gone)]] = gone[starts[:-1][starts[:-1] < len(gone)]]
                spans = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])
                removed, pieces = total[starts[1:]] - total[starts[:-1]], spans[starts[1:]] - spans[starts[:-1]]
                kept = [data[a:b].tobytes() if not r else data[a:b][~gone[a:b]].tobytes() for a, b, r in zip(starts[:-1].tolist(), starts[1:].tolist(), removed.tolist(), strict=True)]
                made = {
                    "n_bytes": pa.array(np.diff(starts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(pieces, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept] if "kept_sha256" in names else [None] * len(kept), pa.string()),
                    "kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept] if "kept_text" in names else [None] * len(kept), pa.string()),
                }
                if "kept_text" in names:  # a null text stays null
                    import pyarrow.compute as pc

                    made["kept_text"] = pc.if_else(pc.is_valid(table.column(text_col).combine_chunks()), made["kept_text"], pa.scalar(None, pa.string()))
                if "kept_text" in names:  # the rows as they were but for the text
                    made = {text_col: made["kept_text"]}
                columns = [made[x] if x in made else table.column(x).combine_chunks() for x in schema.names]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; or with ``texts`` all columns of ``docs``, the text without its repeats.

    The bytes that stay need not be whole characters at a cut; the text column leaves out such fragments, the checksum doesn't.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    prepare(spark)
    wanted = docs if texts else docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    scratch = Scratch(spark)
    blocks = scratch.write(pack_blocks(wanted.withColumn(text_col, F.col(text_col).cast("string")), text_col, block_bytes), "blocks", maxRecordsPerFile=16, compression="uncompressed")
    buckets = 4 * max(shuffle_partitions(spark), blocks.count() // 8)
    reports = blocks.mapInArrow(_reports(buckets, id_col, text_col), "bucket bigint, block_id bigint, n bigint, keys binary, docs binary")
    shared = scratch.write(reports.groupBy("bucket").applyInArrow(_shared, "block_id bigint, n bigint, keys binary"), "shared")
    parts = shared.groupBy("block_id").agg(F.collect_list(F.struct("n", "keys")).alias("parts"))
    contexts = blocks.join(parts, "block_id").mapInArrow(_contexts(buckets, id_col, text_col), "bucket bigint, block_id bigint, n bigint, size bigint, named binary, numbers binary, text binary")
    answers = scratch.write(contexts.groupBy("bucket").applyInArrow(_answers, "block_id bigint, n bigint, named binary, runs binary"), "answers")
    scratch.drop("shared")
    runs = answers.groupBy("block_id").agg(F.collect_list(F.struct("n", "named", "runs")).alias("parts"))
    kind = docs.schema if texts else f"{id_col} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    kind = spark.createDataFrame([], kind).schema if isinstance(kind, str) else kind
    names = ["kept_text"] if texts else kind.names
    return blocks.join(runs, "block_id", "left").mapInArrow(_removed(id_col, text_col, names, to_arrow_schema(kind)), kind)


#: The rows of ``remove_repeats`` in DuckDB: every 50-byte string with the smallest doc_id that has it, in hex, cut out of pieces of 200 bytes.
ORACLE_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    pieces AS (SELECT doc_id, k, substr(h, 400 * k + 1, 498) AS p FROM d, range(0, length(h) // 400 + 1) AS r(k)),
    strings AS (SELECT doc_id, 200 * k + i AS pos, substr(p, 2 * i + 1, 100) AS s FROM pieces, range(0, least(200, length(p) // 2 - 49)) AS r(i)),
    firsts AS (SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s),
    hits AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS earlier FROM strings JOIN firsts USING (s) WHERE first_id < doc_id),
    cut AS (SELECT doc_id, sum(least(50, pos - coalesce(earlier, -50))) AS removed, count(*) FILTER (earlier IS NULL OR pos - earlier > 50) AS spans,
        list({'a': coalesce(earlier + 50, 0), 'b': pos} ORDER BY pos) FILTER (earlier IS NULL OR pos - earlier > 50) AS gaps, max(pos) + 50 AS rest FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE array_to_string(list_transform(gaps, lambda g: substr(h, 2 * g.a + 1, 2 * (g.b - g.a))), '') || substr(h, 2 * rest + 1) END)) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)"""
