"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, and union-find that keeps one line of each component."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, components, cut, lean, roomy, sieve_of, sieved, slices

SHINGLE = 6
THRESHOLD = 0.8
#: Lines with Jaccard 0.8 share one of 7 bands of 4 with probability 0.975, with 0.9 almost surely.
BANDS, ROWS = 7, 4
BROADCAST_ROWS = 1_000_000
#: Share of the driver's heap that the rows of one broadcast may take there, and bytes of a row, which is collected, put into a relation and serialised; several broadcasts are there at once.
BROADCAST_SHARE, BROADCAST_ROW = 1 / 16, 250
#: Nodes of a bucket beyond which it is cut into blocks.
BUCKET = 4096
#: Lines of a bucket that are compared at once.
BLOCK = 48
#: Bits of a line's signature, by which pairs that can't be near are left out before texts move.
SIGNED = 256

_r = np.random.default_rng(23)
_MUL = (_r.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _r.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BAND = _r.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def line_hashes(lines: list[str]) -> np.ndarray:
    """lines x 2 longs. Two of n different lines share both with a chance of about n^2 / 2^129: none at any size."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), "<i8").reshape(-1, 2)


def place_hash(doc: np.ndarray, no: np.ndarray) -> np.ndarray:
    """A long for a line's place."""
    x = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + no.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def shingles(line: str) -> set[str]:
    """All runs of SHINGLE characters; a shorter line is one shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def numbers(line: str) -> np.ndarray:
    """The line's shingles as different numbers in order. Those of characters below 1,024 are packed exactly into 60 bits; others, and lines shorter than a shingle, are 63-bit hashes."""
    if len(line) < SHINGLE:
        return np.array([-(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) >> 1) - 1], np.int64)
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = len(code) - SHINGLE + 1
    out = np.zeros(n, np.int64)
    for k in range(SHINGLE):
        out = out << 10 | code[k : k + n]
    if code.max() >= 1024:
        wide = np.zeros(n, bool)
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            wide |= code[k : k + n] >= 1024
            h = (h ^ code[k : k + n].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[wide] = -(h[wide] >> np.uint64(1)).astype(np.int64) - 1
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two lines' numbers."""
    c = np.concatenate((a, b))
    c.sort()
    both = np.count_nonzero(c[1:] == c[:-1])
    return both / (len(c) - both)


def _block(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the pairs with Jaccard of threshold at least: products of incidence rows count what two lines share."""
    size = np.array([len(x) for x in a + b])
    every = np.concatenate(a + b)
    order = np.argsort(every, kind="stable")
    new = np.append(True, np.diff(every[order]) != 0)
    at = np.cumsum(new) - 1
    shared = np.bincount(at) > 1  # what one line has alone doesn't count
    column = np.cumsum(shared) - 1
    keep = shared[at]
    rows = np.zeros((len(size), int(shared.sum())), np.float32)
    rows[np.repeat(np.arange(len(size)), size)[order[keep]], column[at[keep]]] = 1
    both = (rows[: len(a)] @ rows[len(a) :].T).astype(np.float64)
    return np.nonzero(both >= threshold * (size[: len(a), None] + size[len(a) :] - both))


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE characters, line after line, and how many each line has. Lines aren't empty and hold no line end."""
    code = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass") + b"\0" * 4 * SHINGLE, "<u4")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.maximum(1, size - SHINGLE + 1)
    start = np.cumsum(size + 1) - size - 1
    h = np.zeros(len(code) - SHINGLE + 1, np.uint32)
    for k in range(SHINGLE):
        h = h * np.uint32(0x01000193) + code[k : k + len(h)]
    # a short line's window also holds what follows: its hash is taken from the line alone
    short = np.flatnonzero(size < SHINGLE)
    h[start[short]] = [xxhash.xxh32_intdigest(lines[s].encode("utf-8", "surrogatepass")) for s in short]
    first = np.cumsum(n) - n
    h = h[np.arange(first[-1] + n[-1]) + np.repeat(start - first, n)]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16)), n


def bands(lines: list[str]) -> np.ndarray:
    """lines x BANDS keys. Lines aren't empty and hold no line end."""
    out = np.empty((len(lines), BANDS), np.int64)
    for i, j in chunks(lines, 150_000):
        h, n = _hashed(lines[i:j])
        first = np.cumsum(n) - n
        key = np.zeros(j - i, np.uint64)
        for p in range(BANDS * ROWS):
            b, r = divmod(p, ROWS)
            if r == 0:
                key = np.full(j - i, b + 1, np.uint64)
            key = (key ^ np.minimum.reduceat(h * _MUL[p] + _ADD[p], first)) * _BAND[b, r]
            key ^= key >> np.uint64(29)
            if r == ROWS - 1:
                out[i:j, b] = key.view(np.int64)
    return out


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: an upper and a lower bound of the number of its shingles (runs, and different hashes), and SIGNED bits as longs, each the parity of the hashes that fall on it."""
    most, least, bits = np.empty(len(lines), np.int32), np.empty(len(lines), np.int32), np.empty((len(lines), SIGNED // 64), np.int64)
    for i, j in chunks(lines, 150_000):
        h, n = _hashed(lines[i:j])
        key = np.repeat(np.arange(j - i, dtype=np.uint64) << np.uint64(32), n) | h
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        first = np.searchsorted(key, np.arange(j - i, dtype=np.uint64) << np.uint64(32))
        most[i:j], least[i:j] = n, np.diff(np.append(first, len(key)))
        place = key & np.uint64(SIGNED - 1)
        bit = np.uint64(1) << (place & np.uint64(63))
        for k in range(SIGNED // 64):
            bits[i:j, k] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), first).view(np.int64)
    return most, least, bits


def possible(cell: np.ndarray, most: np.ndarray, least: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """Which lines may have Jaccard of threshold at least with another of their cell, by signatures(); cell: a number for each line, ascending.

    Sets of a and b shingles with Jaccard t differ in at most (a + b) (1 - t) / (1 + t) of them, and neither is smaller than t
    times the other. Signatures differ in no more bits than the sets in shingles, so no such pair is left out.
    """
    out, bits = np.zeros(len(cell), bool), bits.view(np.uint64)  # bitwise_count() takes absolute values

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(-1, dtype=np.int32)
        return (differ <= (1 - threshold) / (1 + threshold) * (most[a] + most[b].astype(np.int64)) + 1e-6) & (most[a] >= threshold * least[b] - 1e-6) & (most[b] >= threshold * least[a] - 1e-6)

    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(cell)))
    a, k = np.flatnonzero(np.repeat(size <= BLOCK, size)), 0
    while len(a):
        k += 1
        a = a[a + k < len(cell)]
        a = a[cell[a] == cell[a + k]]
        ok = a[near(a, a + k)]
        out[ok] = out[ok + k] = True
    for i, n in zip(first[size > BLOCK].tolist(), size[size > BLOCK].tolist()):
        own = np.arange(i, i + n)
        for j in range(0, n, BLOCK):
            part = own[j : j + BLOCK]
            out[part] = (near(part[:, None], own[None]) & (part[:, None] != own[None])).any(1)
    return out


def _lines(text: str) -> list[tuple[int, str]]:
    """Numbered lines, without white space around them; blank ones are left out."""
    return [(k, s) for k, x in enumerate(text.split("\n")) if (s := x.strip())]


_BAND_NAMES = [f"b{i}" for i in range(BANDS)]


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines; band keys only where a line is new to the task."""
    seen: set[bytes] = set()
    for b in batches:
        for i, part in slices(b.column(1), 4_000_000):
            doc, no, lines = [], [], []
            for d, t in zip(b.column(0).slice(i, len(part)).to_pylist(), part.to_pylist()):
                for k, s in _lines(t):
                    doc.append(d)
                    no.append(k)
                    lines.append(s)
            h = line_hashes(lines)
            new = []
            for k, x in enumerate(h.view("V16").ravel().tolist() if len(h) else []):
                if x not in seen:
                    seen.add(x)
                    new.append(k)
            if len(seen) > 400_000:  # forgetting costs rows only
                seen.clear()
            mask = np.ones(len(h), bool)
            mask[new] = False
            keys = np.zeros((len(h), BANDS), np.int64)
            if new:
                keys[new] = bands([lines[k] for k in new])
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(doc, pa.int64()), pa.array(no, pa.int32()), *(pa.array(np.ascontiguousarray(keys[:, c]), mask=mask) for c in range(BANDS))], names=["h1", "h2", "doc_id", "line_no", *_BAND_NAMES])


def verify(lines: dict[int, str], threshold: float, keys: np.ndarray | None = None) -> dict[int, int]:
    """keys: bands() of the lines in order of their hashes. The smallest hash of each line's component of pairs that share a band and have Jaccard of threshold at least. Pairs already in one component aren't compared again."""
    ids = sorted(lines)
    up = {i: i for i in ids}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)

    sets = {i: numbers(lines[i]) for i in ids}
    buckets = defaultdict(list)
    for i, own in zip(ids, (bands([lines[i] for i in ids]) if keys is None else keys).tolist()):
        for k in own:
            buckets[k].append(i)
    done = set()
    for members in buckets.values():
        if len(members) < 2 or (own := tuple(members)) in done:
            continue
        done.add(own)
        if len(members) < 16:
            for n, i in enumerate(members):
                for j in members[:n]:
                    if root(i) != root(j) and jaccard(sets[i], sets[j]) >= threshold:
                        join(i, j)
            continue
        parts = [members[k : k + BLOCK] for k in range(0, len(members), BLOCK)]
        for n, p in enumerate(parts):
            for q in parts[: n + 1]:
                if len({root(i) for i in p + q}) > 1:
                    for x, y in zip(*_block([sets[i] for i in p], [sets[i] for i in q], threshold)):
                        join(p[x], q[y])
    return {i: root(i) for i in ids}


def _verify(threshold: float):
    """Edges of the lines of each cell: rows come sorted by cell and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, pairs = None, {}, []

        def settle() -> None:
            if len(own) > 1:  # all of them share a band
                pairs.extend((i, r) for i, r in verify(own, threshold, np.zeros((len(own), 1), np.int64)).items() if i != r)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for b in batches:
            for *g, h, t in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "i", "j", "node", "line"))):
                if g != at:
                    settle()
                    at, own = g, {}
                own[h] = t
            yield out()
            pairs.clear()
        settle()
        yield out()

    return run


def _texts(places, known):
    """(h1, h2, line) of the lines at places with known hashes, and of a few others, by two sieves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in slices(b.column(1), 4_000_000):
                doc, no, lines = [], [], []
                for d, t in zip(b.column(0).slice(i, len(part)).to_pylist(), part.to_pylist()):
                    for k, s in _lines(t):
                        doc.append(d)
                        no.append(k)
                        lines.append(s)
                take = np.flatnonzero(sieved(places.value, place_hash(np.array(doc, np.int64), np.array(no, np.int64))))
                own = [lines[k] for k in take]
                h = line_hashes(own)
                take = np.flatnonzero(sieved(known.value, h[:, 0].copy()))
                h = h[take]
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([own[k] for k in take], pa.string())], names=["h1", "h2", "line"])

    return run


_BIT_NAMES = [f"s{i}" for i in range(SIGNED // 64)]


def _signed(texts):
    """(h1, h2) and signatures() of the lines of _texts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches):
            most, least, bits = signatures(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(most), pa.array(least), *(pa.array(bits[:, k].copy()) for k in range(bits.shape[1]))], names=["h1", "h2", "most", "least", *_BIT_NAMES])

    return run


def _pruned(threshold: float):
    """Rows (c1, c2, i, j, node, signature), sorted by cell and node, of lines for which another of the cell is possible(); each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[np.ndarray] = []

        def out(cols: list[np.ndarray], cells: np.ndarray) -> pa.RecordBatch:
            once = np.append(True, cells | (cols[4][1:] != cols[4][:-1]))[: len(cols[4])]  # rows that repeat an id bring a line twice
            cell = np.append(0, np.cumsum(cells))[: len(once)][once]
            cols = [c[once] for c in cols]
            keep = possible(cell, cols[5], cols[6], np.stack(cols[7:], axis=1), threshold)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols[:5]], names=["c1", "c2", "i", "j", "node"])

        def bounds(cols: list[np.ndarray]) -> np.ndarray:
            return np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            wait = [np.concatenate(x) for x in zip(wait, cols)] if wait else cols
            new = bounds(wait)
            end = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # the last cell may go on
            if end:
                yield out([c[:end] for c in wait], new[: end - 1])
                wait = [c[end:].copy() for c in wait]
        if wait:
            yield out(wait, bounds(wait))

    return run


class Sent:
    """Broadcasts of sieves, which the driver holds until they are given up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __call__(self, sieve: np.ndarray):
        self.held.append(self.spark.sparkContext.broadcast(sieve))
        return self.held[-1]

    def free(self) -> None:
        """To be called when what was made with them is written; no later read asks for them."""
        while self.held:
            self.held.pop().destroy()


def sifted(rows: DataFrame, keys: DataFrame, on: list[str], send: Sent | None = None) -> DataFrame:
    """rows without most of those whose columns on aren't in keys, so that a join shuffles little else. The sieve has 32 MB at most; what it lets through by chance is left to the join."""
    names = rows.columns
    wanted = (send or Sent(rows.sparkSession))(sieve_of(keys.select(F.xxhash64(*on).alias("x")), "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(names).filter(pa.array(sieved(wanted.value, b.column("__x").to_numpy())))

    return rows.withColumn("__x", F.xxhash64(*on)).mapInArrow(lean(run), rows.schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(place_hash(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["place"])


def cells_of(keyed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(c1, c2, i, j, node) for rows (key, node): the lines to be compared, two at least in each cell.

    A bucket is a cell, named by its set of nodes, so that a set that several bands bring together is compared once. A bucket of more than
    bucket nodes is cut into blocks, and each pair of blocks is a cell: nothing is left out, and no task gets it all.
    """
    w = Window.partitionBy("key")
    sized = keyed.select("key", "node", F.count("*").over(w).alias("n"), F.bit_xor(F.xxhash64("node")).over(w).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).over(w).alias("y")).where("n > 1")
    small = sized.where(F.col("n") <= bucket).select(F.col("x").alias("c1"), F.col("y").alias("c2"), F.lit(0).alias("i"), F.lit(0).alias("j"), "node").distinct()
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    big = sized.where(F.col("n") > bucket).select("key", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return small.union(big.select(F.col("key").alias("c1"), F.lit(0).cast("long").alias("c2"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node"))


def _light(spark: SparkSession, rows: int) -> bool:
    """Whether the driver's heap can hold so many rows for a broadcast."""
    return rows * BROADCAST_ROW <= spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory() * BROADCAST_SHARE


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) for each line that goes, with the line that stays for it.

    Lines are compared without white space around them; blank ones always stay. Equal lines are one node, by 128 bits;
    nodes that share a band and whose shingle sets have Jaccard of threshold at least are joined; of each component the
    line with the smallest (doc_id, line_no) stays. Hashes and band keys are shuffled once a line and task, then once a
    node. Nodes that share a band have signatures moved first, of 256 bits, and texts only if these don't rule out every partner; both are
    those of their first line, found through two sieves of 32 MB at most.
    Comparison is by bucket, and large buckets by pairs of blocks; union-find joins what was found. Tables of up to broadcast_rows rows
    that are small beside the driver's heap are broadcast, others joined by shuffle, with rows that pass a sieve of their keys. A NULL id or text gives no lines; rows that repeat an id are one document, the first of equal
    (doc_id, line_no) lines stays as one; other columns don't matter; very long lines are compared whole; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    src = roomy(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL"))

    sent = Sent(spark)

    def written(df: DataFrame, tag: str) -> DataFrame:
        out = cut(df, tag)
        sent.free()
        return out

    def light(df: DataFrame) -> bool:
        rows = df.count()
        return rows <= broadcast_rows and _light(spark, rows)

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if light(df) else df

    def met(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(few), on, how) if light(few) else sifted(rows, few, on, sent).join(few, on, how)

    def texts_of(own: DataFrame):
        return _texts(sent(sieve_of(own.select("doc_id", "line_no").mapInArrow(lean(_places), "place long"), "place")), sent(sieve_of(own, "h1")))

    lines = cut(src.mapInArrow(lean(_list_lines), "h1 long, h2 long, doc_id long, line_no int, " + ", ".join(f"{c} long" for c in _BAND_NAMES)), "lines")
    one = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"), *(F.max(c).alias(c) for c in _BAND_NAMES))
    nodes = cut(one.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), *_BAND_NAMES), "nodes")
    cells = cut(cells_of(nodes.select(F.explode(F.array(*_BAND_NAMES)).alias("key"), "node"), bucket), "cells")
    own = written(met(nodes.select("node", "h1", "h2", "doc_id", "line_no"), cut(cells.select("node").distinct(), "met"), ["node"], "left_semi"), "candidates")
    order = ["c1", "c2", "i", "j"]
    bits = ["most", "least", *_BIT_NAMES]
    signed = src.mapInArrow(lean(_signed(texts_of(own))), "h1 long, h2 long, most int, least int, " + ", ".join(f"{c} long" for c in _BIT_NAMES))
    signed = signed.join(sized(own.select("node", "h1", "h2")), ["h1", "h2"]).join(cells, "node").select(*order, "node", *bits)
    cells = written(signed.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(lean(_pruned(threshold)), cells.select(*order, "node").schema), "pruned")
    own = written(met(own, cut(cells.select("node").distinct(), "met"), ["node"], "left_semi"), "candidates")
    texts = src.mapInArrow(lean(texts_of(own)), "h1 long, h2 long, line string").join(sized(own.select("node", "h1", "h2")), ["h1", "h2"]).select("node", "line")
    found = texts.join(cells, "node").repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(lean(_verify(threshold)), "a long, b long")
    comp = written(components(found).select(F.col("id").alias("node"), F.col("root")), "joined")
    near = own.join(sized(comp), "node").select("root", "h1", "h2", F.struct("doc_id", "line_no").alias("first"))
    least = near.groupBy("root").agg(F.min("first").alias("kept"))
    near = near.join(least, "root").select("h1", "h2", "kept")
    alone = nodes.where("n > 1").join(sized(comp.select("node")), "node", "left_anti").select("h1", "h2", F.struct("doc_id", "line_no").alias("kept"))
    kept = cut(near.union(alone).select("h1", "h2", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")), "kept")
    out = met(lines.select("h1", "h2", "doc_id", "line_no"), kept, ["h1", "h2"])
    return out.where("doc_id <> kept_doc_id OR line_no <> kept_line_no").select("doc_id", "line_no", "kept_doc_id", "kept_line_no")


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with those lines cut out of their texts; nothing else changes."""
    nos = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__nos"))
    cutting = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(F.col("__nos"), i)), "\n")
    out = docs.join(nos, docs[id_col].cast("long") == nos["__id"], "left")
    return out.select(*(F.when(F.col("__nos").isNull(), docs[c]).otherwise(cutting).alias(c) if c == text_col else docs[c] for c in docs.columns))
