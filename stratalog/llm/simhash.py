"""SimHash near-duplicates by anchor points: the codewords of a covering code are the anchors at which fingerprints meet."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, labels_of, lean, roomy, slices, spread, word_codes

#: A fingerprint is BLOCKS blocks of 15 bits, in two longs.
BLOCKS, WIDTH = 8, 15
THRESHOLD = 15
#: Of an anchor, beyond which it is split.
COMPARISONS = 4_000_000_000


def _hash16(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))


_LANES = np.uint64(0x0101010101010101)


def _votes(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For groups of size rows of h, how many have each of the 64 bits. Eight bits at a time are summed in the bytes of one number, at most 255 rows in a go."""
    parts = -(-size // 255)
    start = np.cumsum(size) - size
    at = np.repeat(start, parts) + 255 * spread(np.zeros(len(parts), np.int64), parts)
    counts = np.empty((len(at), 64), np.int32)
    for k in range(8):
        counts[:, k::8] = np.add.reduceat(h >> np.uint64(k) & _LANES, at).view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0)


def fingerprints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each text and whether it has words: bit i of 120 is set where more than half of the distinct words' hashes have it."""
    out, has = np.zeros((len(col), 2), np.int64), np.zeros(len(col), bool)
    powers = np.int64(1) << np.arange(60, dtype=np.int64)
    for start, part in slices(col):
        code, n, names = word_codes(part)
        pair = np.unique(np.repeat(np.arange(len(part)), n) * np.int64(len(names)) + code)
        if not len(pair):
            continue
        size = np.bincount(pair // len(names), minlength=len(part))
        some = np.flatnonzero(size)
        h = np.frombuffer(b"".join(map(_hash16, names)), "<u8").reshape(-1, 2)[pair % len(names)]
        for c in (0, 1):
            votes = _votes(np.ascontiguousarray(h[:, c]), size[some])[:, :60] * 2 > size[some, None]
            out[start + some, c] = votes.astype(np.int64) @ powers
        has[start + some] = True
    return out, has


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For every word of 15 bits its codeword in the perfect Hamming code [15, 11], and the codewords within its covering radius (1) plus 1, that one first."""
    v = np.arange(1 << WIDTH, dtype=np.int32)
    syndrome = np.zeros_like(v)
    for p in range(WIDTH):
        syndrome ^= np.where(v >> p & 1, p + 1, 0).astype(np.int32)
    home = np.where(syndrome > 0, v ^ (1 << np.maximum(syndrome - 1, 0)), v).astype(np.int32)
    # words within distance 1 of v have their codewords within distance 2 of v; there are 8 such codewords, or 1 where v is one itself
    near = np.stack([home] + [home[v ^ (1 << p)] for p in range(WIDTH)], axis=1)
    return home, np.sort(near, axis=1)


_tables: list = []


def _anchors() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables.extend(_hamming())
    return _tables[0], _tables[1]


def replicas(lo: np.ndarray, hi: np.ndarray, wide: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block, (row, anchor, home): a fingerprint's own anchor, and all anchors within the covering radius plus one.

    wide: half as many blocks of two words each, whose anchors are pairs of codewords; one difference is in one of the two
    words, so the other keeps its own codeword.
    """
    home, near = _anchors()
    words = [((lo if k < 4 else hi) >> (WIDTH * (k % 4)) & ((1 << WIDTH) - 1)).astype(np.int64) for k in range(BLOCKS)]

    def around(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = near[part]
        new = np.ones(n.shape, bool)
        new[:, 1:] = n[:, 1:] != n[:, :-1]
        row, col = np.nonzero(new)
        anchor = n[row, col]
        return row, anchor.astype(np.int64), anchor == home[part[row]]

    if not wide:
        for k, part in enumerate(words):
            row, anchor, own = around(part)
            yield row, anchor + (k << WIDTH), own
        return
    for k in range(0, BLOCKS, 2):
        first, second = words[k], words[k + 1]
        base = (k // 2) << 2 * WIDTH
        row, anchor, own = around(first)
        yield row, base + (anchor << WIDTH) + home[second[row]], own
        row, anchor, own = around(second)
        row, anchor = row[~own], anchor[~own]
        yield row, base + (home[first[row]].astype(np.int64) << WIDTH) + anchor, np.zeros(len(row), bool)


def _load(wide: bool):
    """How many rows each anchor gets, and how many of them are at home there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, homes = np.zeros(BLOCKS << WIDTH, np.int64), np.zeros(BLOCKS << WIDTH, np.int64)

        def out(anchor: np.ndarray, all_: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(all_), pa.array(own)], names=["anchor", "rows", "homes"])

        for b in batches:
            for _, anchor, home in replicas(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi")), wide):
                if wide:
                    names, at, n = np.unique(anchor, return_inverse=True, return_counts=True)
                    yield out(names, n, np.bincount(at, weights=home, minlength=len(names)).astype(np.int64))
                else:
                    rows += np.bincount(anchor, minlength=len(rows))
                    homes += np.bincount(anchor[home], minlength=len(rows))
        hit = np.flatnonzero(rows)
        yield out(hit, rows[hit], homes[hit])

    return run


def _spread(splits, wide: bool):
    """Rows at their anchors. An anchor that is split is a grid: those at home are told apart in one direction and stand in all cells of the other, all rows as visitors the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, parts = splits.value
        for b in batches:
            lo, hi, i = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "id"))
            salt = (np.bitwise_xor(lo, hi) * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(40)

            def out(row: np.ndarray, anchor: np.ndarray, home: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
                for s in range(0, len(row), 200_000):
                    x = slice(s, s + 200_000)
                    r = row[x]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[x]), pa.array(cell[x].astype(np.int32)), pa.array(home[x]), pa.array(lo[r]), pa.array(hi[r]), pa.array(i[r])], names=["anchor", "cell", "home", "lo", "hi", "id"])

            for row, anchor, home in replicas(lo, hi, wide):
                at = np.minimum(np.searchsorted(hot, anchor), max(0, len(hot) - 1))
                one = hot[at] != anchor if len(hot) else np.ones(len(anchor), bool)
                yield from out(row[one], anchor[one], home[one], np.zeros(int(one.sum()), np.int64))
                for k in np.flatnonzero(~one):
                    n = int(parts[at[k]])
                    r, mine = np.full(n, row[k]), int(salt[row[k]] % np.uint64(n))
                    cells, a = np.arange(n), np.full(n, anchor[k])
                    yield from out(r, a, np.zeros(n, bool), cells * n + mine)
                    if home[k]:
                        yield from out(r, a, np.ones(n, bool), mine * n + cells)

    return run


def close_pairs(lo: np.ndarray, hi: np.ndarray, home: np.ndarray, threshold: int, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x, y of one anchor with x at home there and at most threshold different bits, of about at_once comparisons at a time."""
    own = np.flatnonzero(home)
    step = max(1, at_once // max(1, len(lo)))
    for s in range(0, len(own), step):
        x = own[s : s + step]
        i, j = np.nonzero(np.bitwise_count(lo[x][:, None] ^ lo[None]) <= threshold)
        d = np.bitwise_count(lo[x[i]] ^ lo[j]) + np.bitwise_count(hi[x[i]] ^ hi[j])
        ok = (d <= threshold) & (x[i] != j)
        yield x[i[ok]], j[ok]


def tree_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each node with the smallest of its component; pairs are united as they come and not kept."""
    lab = np.arange(n)
    for x, y in pairs:
        a, b = lab[x], lab[y]
        differ = a != b
        if differ.any():
            two = np.unique(np.minimum(a, b)[differ] * np.int64(n) + np.maximum(a, b)[differ])
            lab = labels_of(two // n, two % n, n)[lab]
    y = np.flatnonzero(lab != np.arange(n))
    return lab[y], y


def _compare(threshold: int, forest: bool):
    """Rows come grouped by anchor and cell within the task. forest: of each group's pairs only a tree for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[list[np.ndarray]] = []

        def settle(lo, hi, i, home) -> Iterator[pa.RecordBatch]:
            pairs = close_pairs(lo, hi, home, threshold)
            for x, y in [tree_of(pairs, len(lo))] if forest else pairs:
                if len(x):
                    d = np.bitwise_count(lo[x] ^ lo[y]) + np.bitwise_count(hi[x] ^ hi[y])
                    new = i[x] != i[y]  # a row meets itself where an anchor is split
                    yield pa.RecordBatch.from_arrays([pa.array(i[x][new]), pa.array(i[y][new]), pa.array(d[new].astype(np.int32))], names=["a", "b", "distance"])

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            if not keep:
                return
            anchor, cell, home, lo, hi, i = (np.concatenate(c) for c in zip(*keep))
            keep.clear()
            cuts = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(anchor)]])
            done = len(cuts) - 1 if last else len(cuts) - 2
            for s, e in zip(cuts[:done], cuts[1 : done + 1]):
                if e - s > 1 and home[s:e].any():
                    yield from settle(lo[s:e], hi[s:e], i[s:e], home[s:e])
            if not last:
                s = cuts[done]
                keep.append([anchor[s:], cell[s:], home[s:], lo[s:], hi[s:], i[s:]])

        for b in batches:
            keep.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "home", "lo", "hi", "id")])
            if anchor_ends(keep):
                yield from whole(False)
        yield from whole(True)

    return run


def anchor_ends(keep: list[list[np.ndarray]]) -> bool:
    """Whether the last batch goes beyond the group that the first one begins with, so that something can be settled."""
    return keep[0][0][0] != keep[-1][0][-1] or keep[0][1][0] != keep[-1][1][-1]


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD, forest: bool = False, comparisons: int = COMPARISONS) -> DataFrame:
    """(a, b, distance) for rows (id, lo, hi) with different ids, with at most threshold different bits, each pair from one to several times, in either order.

    With at most 15 differences over 8 blocks, some block has at most one. There, the two rows' codewords are at most
    the covering radius plus one away: x is home at its codeword, y is replicated to all codewords within that distance,
    so the two meet and nothing is missed. Rows of an anchor are counted first (two numbers an anchor): one with more
    than comparisons of them is split into a grid of cells, so a hot anchor is no single task. A cell's pairs are
    found and united in pieces, so memory is its rows of 33 bytes. forest: only enough pairs to keep the components.

    A threshold below 8 goes by 4 blocks of 30 bits, of which one has at most one difference: as many replicas, but 2^24 anchors
    instead of 2^14, so about 1 in 70,000 of all pairs is compared instead of 1 in 34. It is what billions of documents need.
    """
    if threshold >= 2 * BLOCKS:
        raise ValueError(f"anchors guarantee thresholds below {2 * BLOCKS}")
    wide = threshold < BLOCKS
    load = prints.select("lo", "hi").mapInArrow(lean(_load(wide)), "anchor long, rows long, homes long").groupBy("anchor").agg((F.sum("rows").cast("double") * F.sum("homes")).alias("w"))
    hot = sorted((r["anchor"], math.ceil(math.sqrt(r["w"] / comparisons))) for r in load.where(F.col("w") > comparisons).collect())
    splits = prints.sparkSession.sparkContext.broadcast((np.array([a for a, _ in hot], np.int64), np.array([n for _, n in hot], np.int64)))
    spread = prints.select("id", "lo", "hi").mapInArrow(lean(_spread(splits, wide)), "anchor long, cell int, home boolean, lo long, hi long, id long")
    return spread.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(lean(_compare(threshold, forest)), "a long, b long, distance int")


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lo, hi) of rows with an id and at least one word."""
    src = roomy(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, has = fingerprints(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), pa.array(f[has, 0]), pa.array(f[has, 1])], names=["doc_id", "lo", "hi"])

    return src.mapInArrow(lean(run), "doc_id long, lo long, hi long")


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of documents that have a near-duplicate; group_id is the smallest id of the group.

    A group is a component of pairs at Hamming distance of at most threshold; equal fingerprints are at distance 0.
    Equal fingerprints are first reduced to one, so a hot group of copies costs one row. Rows with a NULL id, NULL text
    or no words are in no group; rows that repeat an id are one document; texts of any length are read whole; other columns
    don't matter; an empty table gives an empty result.
    """
    prints = cut(fingerprint_table(docs, id_col, text_col), "prints")
    same = cut(prints.groupBy("lo", "hi").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "same")
    copies = prints.join(same.where("n > 1"), ["lo", "hi"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    near = near_pairs(same.select("id", "lo", "hi"), threshold, forest=True).select("a", "b")
    return components(copies.union(near)).select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 4_000_000) -> DataFrame:
    """Rows that lead their group or are in none, all columns as they are; rows without an id stay."""
    gone = cut(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
