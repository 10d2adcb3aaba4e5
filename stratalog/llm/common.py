"""Components, word streams and lean workers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, shared_dir

WORD = re.compile(r"\w+")
_WORD_OR_SPACE = re.compile(r"\w+| ")


def labels_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 with edges a-b, the smallest node of each one's component."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def _union_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
    if a:
        ids, inv = np.unique(np.concatenate(a + b), return_inverse=True)
        lab = labels_of(inv[: len(inv) // 2], inv[len(inv) // 2 :], len(ids))
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[lab[i : i + 100_000]])], names=["id", "root"])


def components(edges: DataFrame, one_task: int = 1_500_000) -> DataFrame:
    """(id, root) for every node of edges (a, b): root is the smallest id of its component.

    Up to one_task edges are joined in one task (some 0.2 GB); beyond that the stars of larger and smaller
    neighbours alternate until nothing moves, each round written to the shared folder.
    Loops are ignored; an empty table gives an empty result.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    if e.count() <= one_task:
        return e.coalesce(1).mapInArrow(lean(_union_task), "id long, root long")
    before = None
    while True:
        both = e.select("a", "b").union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        e = cut(small, "stars")
        now = tuple(e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("id"), F.col("a").alias("root")).union(e.select(F.col("a").alias("id"), F.col("a").alias("root"))).distinct()


#: Bytes for each core below which a table's files may be too few to keep all cores busy.
ROOMY_BYTES = 2 << 20


def roomy(df: DataFrame) -> DataFrame:
    """A small table spread over all cores, as its few files or row groups would leave most of them idle; larger ones as they are. Only the layout differs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROOMY_BYTES else df


#: Bits of a sieve at most: 32 MB, whatever goes into it.
SIEVE_BITS = 28


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch of words of a sieve: their places and their bits as bytes."""
    for x in batches:
        w, b = x.column(0).to_numpy().astype(np.int32), x.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["w", "b"])


def sieve_of(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a column of longs (its low bits, about 16 bits a value, up to 2^SIEVE_BITS in all), or-ed together by Spark.

    The driver gets 12 bytes a word, a partition at a time, into the one array of 32 MB at most that it keeps; as rows, words took the driver's Python some 470 each.
    """
    bits = min(SIEVE_BITS, max(10, int(df.count() * 16).bit_length()))
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    got = df.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for w, b in got.mapInArrow(lean(_packed), "w binary, b binary").toLocalIterator():
        out[np.frombuffer(w, np.int32)] = np.frombuffer(b, np.int64)
    return out.view(np.uint64)


def sieved(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the column: all that are, and some others."""
    v = values.view(np.uint64)
    return sieve[(v >> np.uint64(6)) & np.uint64(len(sieve) - 1)] >> (v & np.uint64(63)) & np.uint64(1) > 0


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # not this libc: memory is given back when it will
        return None


def lean(run: Callable) -> Callable:
    """run for mapInArrow, with freed memory given back after each batch: workers live on from task to task, beside an executor's heap."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            if _libc() is not None:
                _libc().malloc_trim(0)

    return trimmed


class Memo(dict):
    """Results by string, forgotten all at once when there are too many; forgetting costs time only."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def chunks(texts: list, most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def slices(col: pa.Array, most: int = 3_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Pieces of a string column of about most bytes each, one row at least, with the place of their first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(col):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, col.slice(start, end - start)
        start = end


def words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores; what every word-based operator here counts as a word."""
    return WORD.findall(text.lower())


def strings(col: pa.Array) -> list[str]:
    return col.to_numpy(zero_copy_only=False).tolist()


def pieces(col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What lies between spaces: a code for each piece of all texts in a row, each text's number of them (one at least), and the strings by code."""
    parts = pc.split_pattern(pc.fill_null(col, ""), " ")
    d = parts.flatten().dictionary_encode()
    return d.indices.to_numpy(), pc.list_value_length(parts).to_numpy().astype(np.int64), strings(d.dictionary)


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions at[i], at[i] + 1, ... (size[i] of them), one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


def word_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """words() of all texts: a code for each word in a row, each text's number of words, and the strings by code.

    No word holds a space, so each distinct piece between spaces is looked at once.
    """
    code, n, parts = pieces(col)
    d = pa.array(_WORD_OR_SPACE.findall(" ".join(parts).lower()), pa.string()).dictionary_encode()
    names, idx = strings(d.dictionary), d.indices.to_numpy()
    space = idx == names.index(" ") if " " in names else np.zeros(len(idx), bool)
    size = np.bincount(np.cumsum(space)[~space], minlength=len(parts)) if len(parts) else np.zeros(0, np.int64)
    idx = idx[~space]
    start = np.cumsum(size) - size
    each = size[code]
    count = np.add.reduceat(each, np.cumsum(n) - n) if len(n) else np.zeros(0, np.int64)
    return idx[spread(start[code], each)], count, names


__all__ = ["Memo", "chunks", "components", "cut", "labels_of", "lean", "pieces", "roomy", "shared_dir", "sieve_of", "sieved", "slices", "spread", "strings", "word_codes", "words"]
