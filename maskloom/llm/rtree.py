"""Near-duplicate join on word shingles: exact Jaccard threshold, by count-vector R-trees.

Two texts with shingle sets A and B, |A| <= |B|, have Jaccard similarity of at least the threshold only if their sets differ
in at most d = |A| * (1 - t) / t shingles. The join runs in these steps:

1. Copies: texts with equal sets are one entry, so copies are never paired.
2. Filing: an entry's shingles are dealt by hash into d + 1 + slack parts. Of a pair, at least slack + 1 parts are equal, so both
   meet in a file for an equal part. Parts are counted for the smaller set of a pair, so an entry files itself once for
   each step of a ladder of d that a partner may stand on. Empty parts are no files, unless an entry has more than ``slack`` of them.
3. R-tree: in each file, entries are points, the counts of their shingles in GROUPS hash groups, twice as many for each doubling beyond
   GROUPS * PER shingles; sizes that may be partners are searched together. A packed R-tree is searched for
   each point; the sum of coordinate minima bounds the overlap from above, for boxes by their upper corners. Points whose bound
   reaches the overlap that the threshold needs become candidate clusters (a union of trees, not of all pairs).
4. Verification: each cluster's shingle sets meet once; a second R-tree gives the pairs, and shingles are counted for pairs that
   are not connected already. Clusters beyond UNIT shingles are dealt into tiles: each is solved with a few pivots of the whole
   cluster, and only entries outside the cluster's largest component then visit the other tiles. No link is lost, as a
   pair within one component needs no verification.

The result is what connectivity needs: each entry's component. Blocks (``common.pack_blocks``) report an entry once, so a text in
a third of all rows costs one row a block.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; texts with fewer words than a shingle
have one, the whole sequence; rows with equal ids are rows of their own; null ids are no component's smallest id unless all are null.
Shingles are compared by 64-bit hashes, whole sets by 128 bits; files list sets by the first 64 of these, and a list that two sets
share brings both as candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, from_ipc, mix64, nothing_kept, pack_blocks, packed, prepare, range_hashes, shuffle_partitions, texts_of, unpacked

BLOCK_BYTES, GROUPS, PER, STEPS, FANOUT, PIVOTS, UNIT, FILE = 4_000_000, 256, 8, 10, 16, 16, 4_000_000, 20_000
#: A count of FULL or more is kept as FULL and bounds nothing: it stands for any number.
FULL, ANY = 255, 1 << 24
WORD_BASE, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and where each text's begin (one more for the end)."""
    n = len(starts) - 1
    blank = SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    stop = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = range_hashes(LOWER[data], begin, stop)
    first = np.searchsorted(begin, starts, "left")
    count = np.diff(first)
    out, sizes = [], np.zeros(n, np.int64)
    joined = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        joined = mix64(joined * WORD_BASE + word[k : k + len(joined)] + np.uint64(k + 1))
    for i, (a, c) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
        if c >= words:
            own = np.unique(joined[a : a + c - words + 1])
        elif c:
            h = np.array([c], np.uint64)
            for k in range(c):
                h = mix64(h * WORD_BASE + word[a + k : a + k + 1] + np.uint64(101 + k))
            own = h
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that name each set, as two numbers; 0 for the empty one."""
    size = np.diff(at).astype(np.uint64)
    out = np.zeros((len(size), 2), np.uint64)
    for k, salt in enumerate((WORD_BASE, SECOND)):
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mix64(sets + salt), out=total[1:], dtype=np.uint64)
        out[:, k] = np.where(size > 0, mix64(total[at[1:]] - total[at[:-1]] + mix64(size + salt)) | np.uint64(1), np.uint64(0))
    return out


class Law:
    """The arithmetic of one threshold, given in hundredths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ladder = [1]
        while self.ladder[-1] < 1 << 40:
            self.ladder.append(max(self.ladder[-1] + 1, int(self.ladder[-1] * 1.3)))
        self.steps = np.array(self.ladder)

    def most(self, small: np.ndarray) -> np.ndarray:
        """Most shingles in which a partner of this size or more differs."""
        return small * (100 - self.percent) // self.percent

    def smallest(self, size: np.ndarray) -> np.ndarray:
        """The smallest size of a partner."""
        return -(-size * self.percent // 100)

    def need(self, a: Any, b: Any) -> Any:
        """The overlap that two sizes need: 100 * o >= percent * (a + b - o)."""
        return -(-(self.percent * (a + b)) // (100 + self.percent))

    def slack(self, d: int) -> int:
        return 2 + d // 6


def files(sets: np.ndarray, at: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the files of each entry, and the entry's number."""
    size = np.diff(at)
    entry = np.repeat(np.arange(len(size)), size)
    low, high = law.most(law.smallest(size)), law.most(size)
    first, last = np.searchsorted(law.steps, np.maximum(low, 1), "left"), np.searchsorted(law.steps, np.maximum(high, 1), "left")
    keys, owners = [], []
    mixed = mix64(sets ^ np.uint64(0x5851F42D4C957F2D))
    for step in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
        on = (first <= step) & (step <= last) & (high > 0)
        if not on.any():
            continue
        d = law.ladder[step]
        slack = law.slack(d)
        parts = d + 1 + slack
        number = np.cumsum(on) - 1
        rows = np.flatnonzero(on[entry])
        cell = number[entry[rows]] * parts + ((mixed[rows] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(on.sum()) * parts, np.uint64)
        np.add.at(total, cell, mix64(sets[rows] + np.uint64(77)))
        filled = np.zeros(len(total), bool)
        filled[cell] = True
        empty = ~filled.reshape(-1, parts)
        filled |= np.repeat(empty.sum(axis=1) > slack, parts)  # more empty parts than the slack: file those too
        which = np.flatnonzero(filled)
        part = (which % parts).astype(np.uint64)
        keys.append(mix64(total[which] + mix64(part + np.uint64(parts << 24))))
        owners.append(np.flatnonzero(on)[which // parts])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def step_of(size: np.ndarray) -> np.ndarray:
    """How often the groups are doubled for a set of this size, so that a group has PER shingles at most on average."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / (GROUPS * PER))), 0, STEPS).astype(np.int64)


def counts(own: np.ndarray) -> bytes:
    """The point of a set: how many of its shingles fall into each hash group, FULL at most."""
    step = int(step_of(np.array([len(own)]))[0])
    group = (own >> np.uint64(56 - step)).astype(np.int64)
    return np.minimum(np.bincount(group, minlength=GROUPS << step), FULL).astype(np.uint8).tobytes()


def from_bytes(points: list[bytes], step: int) -> np.ndarray:
    """Points of this step or finer ones, as vectors of this step: neighbouring groups are summed."""
    if all(len(x) == GROUPS << step for x in points):
        out = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1).astype(np.int32)
        out[out == FULL] = ANY
        return out
    out = np.empty((len(points), GROUPS << step), np.int32)
    for k, x in enumerate(points):
        fine = np.frombuffer(x, np.uint8).astype(np.int64)
        fine[fine == FULL] = ANY
        out[k] = np.minimum(fine.reshape(GROUPS << step, -1).sum(axis=1), ANY)
    return out


def by_size(points: list[bytes], sizes: np.ndarray, law: Law, links: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of what ``links`` (numbers, points, sizes) connects, each step of sizes with those that its partners may have."""
    step, a_out, b_out = step_of(sizes), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    reach = math.ceil(math.log2(100 / law.percent) - 1e-9)
    for s in np.unique(step).tolist():
        own = np.flatnonzero((step >= s) & (step <= s + reach))
        if len(own) > 1:
            root = links(own, from_bytes([points[k] for k in own.tolist()], s), sizes[own])
            away = np.flatnonzero(root != np.arange(len(own)))
            a_out.append(own[root[away]])
            b_out.append(own[away])
    return np.concatenate(a_out), np.concatenate(b_out)


class RTree:
    """A packed R-tree over count vectors; boxes keep the largest and smallest size and each group's largest count."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        lead = points[:, np.argsort(-points.var(axis=0))[:2]] if len(points) else points[:, :2]
        self.order = np.lexsort((lead[:, 1], lead[:, 0], sizes))  # neighbours in size and in the two most telling groups share a node
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while True:
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))
            if len(top) <= FANOUT:
                break

    def search(self, i: int, law: Law) -> np.ndarray:
        """Points whose bound on the overlap with point i reaches what the threshold needs; i among them."""
        point, size = self.points[i], int(self.sizes[i])
        least, most = int(law.smallest(np.int64(size))), size * 100 // law.percent
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            at = at[(high[at] >= least) & (low[at] <= most)]
            at = at[np.minimum(top[at], point).sum(axis=1) >= law.need(size, np.maximum(low[at], least))]
            below = len(self.levels[level - 1][0]) if level else len(self.order)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < below]
        found = self.order[at]
        found = found[(self.sizes[found] >= least) & (self.sizes[found] <= most)]
        return found[np.minimum(self.points[found], point).sum(axis=1) >= law.need(size, self.sizes[found])]


def bounded_links(points: np.ndarray, sizes: np.ndarray, law: Law) -> np.ndarray:
    """Labels of the components that the bound connects: each one's first point."""
    tree, label = RTree(points, sizes), np.arange(len(sizes))
    for i in range(len(sizes)):
        found = tree.search(i, law)
        around = np.unique(label[found])
        if len(around) > 1:
            label[np.isin(label, around)] = around[0]
            if not label.any():  # all are connected
                break
    return label


def verified_links(sets: list[np.ndarray], points: np.ndarray, sizes: np.ndarray, law: Law) -> np.ndarray:
    """Labels of the components of pairs that meet the threshold. Pairs within one component are not counted again."""
    tree, label = RTree(points, sizes), np.arange(len(sets))
    for i in range(len(sets)):
        found = tree.search(i, law)
        found = found[label[found] != label[i]]
        while len(found):
            j, found = int(found[0]), found[1:]
            overlap = int(np.intersect1d(sets[i], sets[j], assume_unique=True).size)
            if overlap >= law.need(int(sizes[i]), int(sizes[j])):
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
                found = found[label[found] != a]
        if not label.any():
            break
    return label


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bounds(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _sets(payload: Any, text_col: str, words: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    nothing_kept()
    table = from_ipc(payload)
    sets, at = shingle_sets(*texts_of(table.column(text_col)), words)
    return table, sets, at, fingerprints(sets, at)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _named(mark: np.ndarray) -> pa.Array:
    """128-bit names as binary values."""
    return pa.Array.from_buffers(pa.binary(16), len(mark), [None, pa.py_buffer(np.ascontiguousarray(mark))]).cast(pa.binary())


def _marks(column: Any) -> np.ndarray:
    """Names as two numbers each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary(16))
    return np.frombuffer(column.buffers()[1], np.uint64, 2 * len(column), 16 * column.offset).reshape(-1, 2) if len(column) else np.zeros((0, 2), np.uint64)


def _first(mark: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Numbers of the first of each distinct name (below equal values of ``before``), in order."""
    order = np.lexsort((mark[:, 1], mark[:, 0], *before[::-1]))
    keys = [x[order] for x in (*before, mark[:, 0], mark[:, 1])]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys]) if len(order) > 1 else new[1:]
    return order[new]


def _rows(words: int, id_col: str, text_col: str) -> Any:
    """Of each row: its place, id, number of shingles and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, _, at, mark = _sets(payload.as_buffer(), text_col, words)
                n = len(mark)
                columns = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), table.column(id_col).combine_chunks().cast(pa.int64()), pa.array(np.diff(at)), pc.if_else(pa.array(mark[:, 0] != 0), _named(mark), pa.scalar(None, pa.binary())), pa.array(_signed(mark[:, 0]))]
                yield pa.RecordBatch.from_arrays(columns, ["block_id", "row", "doc_id", "n", "entry", "short"])

    return run


def _reports(buckets: int, words: int, percent: int, text_col: str) -> Any:
    """Of each bucket: the files of a block's entries. Keys keep their upper 48 bits; files that thereby coincide only bring candidates."""
    law = Law(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(1):
                _, sets, at, mark = _sets(payload.as_buffer(), text_col, words)
                first = _first(mark)
                first = first[mark[first, 0] != 0]
                if not len(first):
                    continue
                size = np.diff(at)[first]
                ends = np.cumsum(size)
                key, owner = files(sets[np.repeat(at[first] - ends + size, size) + np.arange(ends[-1])], np.concatenate([[0], ends]), law)
                if not len(key):
                    continue
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                bucket = _bucket(key, buckets)
                key >>= np.uint64(16)
                edge = [*_bounds(bucket).tolist(), len(key)]
                rows = [(int(bucket[a]), b - a, packed(np.diff(key[a:b], prepend=np.uint64(0))), packed(mark[first, 0][owner[a:b]])) for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "n", "keys", "owners"])

    return run


def _filed(table: pa.Table) -> pa.Table:
    """Of one bucket: files with two entries or more, each member list once."""
    n = table.column("n").to_pylist()
    key = np.concatenate([np.cumsum(unpacked(x, k, np.uint64), dtype=np.uint64) for x, k in zip(table.column("keys").to_pylist(), n, strict=True)])
    owner = np.concatenate([unpacked(x, k, np.uint64) for x, k in zip(table.column("owners").to_pylist(), n, strict=True)])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
    key, owner = key[new], owner[new]
    at = _bounds(key)
    size = np.diff(np.append(at, len(key)))
    total = np.zeros(len(key) + 1, np.uint64)
    np.cumsum(mix64(owner), out=total[1:], dtype=np.uint64)
    name = mix64(total[at + size] - total[at] + size.astype(np.uint64))
    several = np.flatnonzero(size > 1)
    one = several[_first(np.stack([name[several], owner[at[several]]], axis=1), size[several])]  # equal lists have equal names, sizes and first members
    at, size, name = at[one], size[one], name[one]
    ends = np.cumsum(size)
    rows = np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    return pa.table({"file": pa.array(np.repeat(_signed(name), size)), "short": pa.array(_signed(owner[rows])), "members": pa.array(np.repeat(size, size))})


def _points(words: int, text_col: str) -> Any:
    """For asked rows of each block: the entry and its point, or its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, rows in zip(batch.column("payload"), batch.column("rows").to_pylist(), strict=True):
                _, sets, at, mark = _sets(payload.as_buffer(), text_col, words)
                rows = np.array(sorted(set(rows)), np.int64)
                size = np.diff(at)[rows]
                own = [sets[at[r] : at[r + 1]] for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays([_named(mark[rows]), pa.array(_signed(mark[rows, 0])), pa.array(size), pa.array(list(map(counts, own)), pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["entry", "short", "n", "point", "shingles"])

    return run


def _candidates(percent: int) -> Any:
    def run(table: pa.Table) -> pa.Table:
        """Of one bin of files: star edges of what the bound connects in each file."""
        file, size, mark, point = table.column("file").to_numpy(), table.column("n").to_numpy(), _marks(table.column("entry")), table.column("point").to_pylist()
        law = Law(percent)
        order = np.lexsort((mark[:, 1], mark[:, 0], file))
        edge = [*_bounds(file[order]).tolist(), len(order)]
        a_out, b_out = [], []
        for a, b in zip(edge, edge[1:], strict=False):
            own = order[a:b]
            x, y = by_size([point[k] for k in own.tolist()], size[own], law, lambda _, points, sizes: bounded_links(points, sizes, law))
            a_out.append(own[x])
            b_out.append(own[y])
        return pa.table({"a": _named(mark[np.concatenate(a_out)]), "b": _named(mark[np.concatenate(b_out)])})

    return run


def _verify(percent: int) -> Any:
    def run(table: pa.Table) -> pa.Table:
        """Of one bin: star edges of the verified components of each cluster's tile."""
        law = Law(percent)
        tile, size, pivot = (table.column(x).to_numpy() for x in ("tile", "n", "pivot"))
        unit, mark, point = _marks(table.column("unit")), _marks(table.column("entry")), table.column("point").to_pylist()
        blobs = table.column("shingles").combine_chunks()
        order = np.lexsort((mark[:, 1], mark[:, 0], ~pivot.astype(bool), tile, unit[:, 1], unit[:, 0]))
        new = np.concatenate([[True], (unit[order[1:]] != unit[order[:-1]]).any(axis=1) | (tile[order[1:]] != tile[order[:-1]])])
        edge = [*np.flatnonzero(new).tolist(), len(order)]
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edge, edge[1:], strict=False):
            own = order[a:b]
            own = own[np.sort(_first(mark[own]))]  # pivots come first
            if len(own) < 2:
                continue
            sets = [np.frombuffer(blobs[int(k)].as_buffer(), np.uint64) for k in own]
            x, y = by_size([point[k] for k in own.tolist()], size[own], law, lambda some, points, sizes, sets=sets: verified_links([sets[k] for k in some.tolist()], points, sizes, law))
            a_out.append(own[x])
            b_out.append(own[y])
        return pa.table({"a": _named(mark[np.concatenate(a_out)]), "b": _named(mark[np.concatenate(b_out)])})

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """entry, root (the smallest entry of its component) of all entries on edges (a, b).

    Alternating large and small stars, each round one written table, until nothing changes; the rounds grow with the logarithm of the
    longest chain. A hub's rows are aggregated before they are shuffled and joined with skew handling.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    for turn in range(1, 100):
        # Large star: neighbours that are larger than an entry point to the smallest around it.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: an entry and its smaller neighbours point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = scratch.write(small, f"{name}-{turn}")
        same = now.count() == after.count() and now.join(after, ["a", "b"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{turn - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("entry"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("entry"), F.col("b").alias("root")).distinct())


def _fetch(blocks: DataFrame, wanted: DataFrame, words: int, text_col: str) -> DataFrame:
    """entry, n, point, shingles of wanted (block_id, row)."""
    rows = wanted.groupBy("block_id").agg(F.collect_list("row").alias("rows"))
    return blocks.hint("merge").join(rows, "block_id").mapInArrow(_points(words, text_col), "entry binary, short bigint, n bigint, point binary, shingles binary")


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, unit: int = UNIT, file: int = FILE) -> tuple[DataFrame, DataFrame, Scratch]:
    """Rows (block_id, row, doc_id, n, entry, root, component_id), the blocks that they point into, and the tables behind both."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    blocks = scratch.write(pack_blocks(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, block_bytes), "blocks", maxRecordsPerFile=16, compression="uncompressed")
    buckets = 4 * max(shuffle_partitions(spark), blocks.count() // 8)
    rows = scratch.write(blocks.mapInArrow(_rows(words, id_col, text_col), "block_id bigint, row int, doc_id bigint, n bigint, entry binary, short bigint"), "rows")
    reports = blocks.mapInArrow(_reports(buckets, words, percent, text_col), "bucket bigint, n bigint, keys binary, owners binary")
    filed = scratch.write(reports.groupBy("bucket").applyInArrow(_filed, "file bigint, short bigint, members bigint").distinct(), "filed")
    # One row of each entry that lies in a file with another.
    place = rows.where("entry is not null").groupBy("entry").agg(F.min(F.struct("block_id", "row")).alias("p"), F.min("short").alias("short")).select("short", "p.block_id", "p.row")
    place = place.join(filed.select("short").distinct(), "short", "left_semi")
    sets = scratch.write(_fetch(blocks, place, words, text_col), "sets", compression="uncompressed")
    points = sets.select("entry", "short", "n", "point")
    small = filed.where(F.col("members") <= file).join(points, "short").withColumn("bin", F.pmod(F.xxhash64("file"), F.lit(buckets)))
    bound = small.groupBy("bin").applyInArrow(_candidates(percent), "a binary, b binary")
    # A file beyond ``file`` entries is a candidate cluster as a whole; its verification is dealt into tiles.
    large = filed.where(F.col("members") > file).join(points.select("short", "entry"), "short")
    hubs = large.groupBy("file").agg(F.min("entry").alias("a"))
    clusters = components(bound.unionByName(large.join(hubs, "file").select("a", F.col("entry").alias("b"))), scratch, "clusters")
    sized = scratch.write(clusters.join(points.select("entry", "n"), "entry"), "sized")
    totals = sized.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    members = sized.join(totals, "root").withColumn("tiles", F.ceil(F.col("total") / unit).cast("bigint")).withColumn("tile", F.pmod(F.xxhash64("entry"), F.col("tiles")))
    members = scratch.write(members.select(F.col("root").alias("unit"), "entry", "tile", "tiles"), "members")
    kind = "a binary, b binary"

    def solve(parts: DataFrame) -> DataFrame:
        binned = parts.join(sets.drop("short"), "entry").withColumn("bin", F.pmod(F.xxhash64("unit", "tile"), F.lit(buckets)))
        return binned.groupBy("bin").applyInArrow(_verify(percent), kind)

    alone = members.where("tiles = 1").select("unit", "tile", "entry", F.lit(False).alias("pivot"))
    edges = scratch.write(solve(alone), "edges")
    tiled = members.where("tiles > 1")
    if not tiled.isEmpty():
        first = tiled.select("unit", "tile", "entry", F.lit(False).alias("pivot")).unionByName(_pivots(tiled))
        round_one = scratch.write(solve(first), "edges-tiles")
        grouped = components(round_one, scratch, "tiles")
        labelled = scratch.write(tiled.join(grouped, "entry", "left").withColumn("root", F.coalesce("root", "entry")), "labelled")
        main = labelled.groupBy("unit", "root").count().groupBy("unit").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        rest = labelled.join(main, "unit").where("root <> main").select("unit", "entry", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"))
        second = tiled.select("unit", "tile", "entry", F.lit(False).alias("pivot")).unionByName(rest.select("unit", "tile", "entry", F.lit(True).alias("pivot")))
        second = second.join(rest.select("unit").distinct(), "unit", "left_semi")
        edges = edges.unionByName(round_one).unionByName(scratch.write(solve(second), "edges-rest"))
    roots = components(edges, scratch, "verified")
    labels = rows.where("entry is not null").groupBy("entry").agg(F.min("doc_id").alias("doc_id")).join(roots, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    labels = scratch.write(labels.select("entry", "doc_id", "root"), "labels")
    least = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(least, "root").select("entry", "root", "component_id")
    out = rows.drop("short").join(named, "entry", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    scratch.drop("filed", "sets", "sized", "members")
    return out, blocks, scratch


def _pivots(tiled: DataFrame) -> DataFrame:
    """PIVOTS entries of the first tile of each dealt cluster, by hash, for each of its tiles."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("unit").orderBy(F.xxhash64(F.col("entry"), F.lit(1)), "entry")
    top = tiled.where("tile = 0").withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS)
    return top.select("unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"), "entry", F.lit(True).alias("pivot"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id; rows without shingles all stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows, blocks, _ = link(docs, words, percent, id_col, text_col)
    kept = rows.where("entry is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "block_id", "row")).alias("k")).select("k.block_id", "k.row")
    kept = kept.unionByName(rows.where("entry is null").select("block_id", "row"))
    schema = to_arrow_schema(docs.schema)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, own in zip(batch.column("payload"), batch.column("rows").to_pylist(), strict=True):
                table = from_ipc(payload.as_buffer()).take(pa.array(sorted(own))).combine_chunks()
                for part in table.to_batches():
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema, strict=True)], schema=schema)

    return blocks.join(kept.groupBy("block_id").agg(F.collect_list("row").alias("rows")), "block_id").mapInArrow(take, docs.schema)


def oracle_sql(words: int = 3, percent: int = 90) -> str:
    """The rows of op7 in DuckDB: all pairs that share a shingle are counted, then components by reachability."""
    shingle = f"list_transform(range(1, greatest(len(ws) - {words} + 2, 2)), lambda i: array_to_string(ws[i:i + {words - 1}], chr(1)))"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        n AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct({shingle}) END AS s FROM w),
        t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM n),
        links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT n.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id FROM n LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON n.doc_id = m.a"""
