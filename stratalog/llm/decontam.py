"""Benchmark decontamination by greedy string tiling: shared-token seeds join texts to test items, Karp-Rabin finds the longest non-overlapping tiles, and the share of the item they cover decides."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, lean, roomy, sieve_of, sieved, slices, spread, word_codes, words

#: A tile has at least this many words; a seed has exactly as many. An item with fewer words is a seed of its own.
MIN_MATCH = 5
#: Words of a test item that tiles must cover.
MIN_COVERAGE = 0.5
BROADCAST_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def hashes(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), np.uint64, len(names))


class Rolling:
    """Karp-Rabin hashes of all k neighbours for any k, from running sums: the base is odd, so it has an inverse modulo 2^64."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.up = np.cumprod(np.append(np.uint64(1), np.full(max(0, self.n - 1), _BASE)), dtype=np.uint64)
        down = np.cumprod(np.append(np.uint64(1), np.full(max(0, self.n - 1), _INVERSE)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(h * down[: self.n], dtype=np.uint64))

    def at(self, k: int) -> np.ndarray:
        if k > self.n:
            return np.zeros(0, np.uint64)
        return (self.sums[k:] - self.sums[:-k]) * self.up[k - 1 :]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    return Rolling(h).at(k)


def _unmarked(marks: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(~marks))


def tiles(text: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in item, place in text), longest first, earliest in the item and then in the text among equals, no word in two tiles.

    A round finds the greatest length at which unmarked words match, by bisection, then goes once over the item's places:
    each takes the first free place in the text with its hash. Places used up stay used up, so a pointer for each hash
    moves on; matches are never listed in pairs, however repetitive both sides are.
    """
    out: list[tuple[int, int, int]] = []
    free, open_ = np.ones(len(text), bool), np.ones(len(item), bool)
    rolling_text, rolling_item = Rolling(text), Rolling(item)
    high = min(len(text), len(item))
    while high >= least:
        used_text, used_item = _unmarked(free), _unmarked(open_)

        def matches(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Places in the item and in the text of k unmarked words, those in the text only with a hash of the item, and their hashes."""
            x = np.flatnonzero(used_item[k:] == used_item[:-k])
            y = np.flatnonzero(used_text[k:] == used_text[:-k])
            hx, hy = rolling_item.at(k)[x], rolling_text.at(k)[y]
            known = np.unique(hx)
            if not len(known):
                return x, y[:0], hx, hy[:0]
            ok = known[np.minimum(np.searchsorted(known, hy), len(known) - 1)] == hy
            return x, y[ok], hx, hy[ok]

        low = least
        found = matches(low)
        if not len(found[1]):
            break
        while low < high:
            mid = (low + high + 1) // 2
            if len((more := matches(mid))[1]):
                found, low = more, mid
            else:
                high = mid - 1
        k, (x, y, hx, hy) = low, found
        o = np.argsort(hy, kind="stable")
        y, hy = y[o].tolist(), hy[o]
        begin = np.searchsorted(hy, hx, "left").tolist()
        end = np.searchsorted(hy, hx, "right").tolist()
        at: dict[int, int] = {}
        for i, b, e in zip(x.tolist(), begin, end):
            # tiles are at least k long, so one that overlaps k words holds the first or the last of them
            if not (open_[i] and open_[i + k - 1]):
                continue
            j = at.get(b, b)
            while j < e and not (free[y[j]] and free[y[j] + k - 1]):
                j += 1
            at[b] = j
            while j < e and not (free[y[j]] and free[y[j] + k - 1] and (item[i : i + k] == text[y[j] : y[j] + k]).all()):
                j += 1  # another text with the same hash
            if j < e:
                open_[i : i + k] = free[y[j] : y[j] + k] = False
                out.append((k, i, y[j]))
        high = k - 1
    return out


@dataclass
class Seeds:
    """Seeds of the items that share a seed length."""

    size: int
    items: np.ndarray  # numbers of the items
    values: np.ndarray  # different seeds, sorted
    places: dict[int, np.ndarray]  # item -> seed at each place
    owners: np.ndarray  # items of each seed, one after the other
    times: np.ndarray  # and how often they have it
    starts: np.ndarray  # where a seed's owners begin

    @staticmethod
    def of(size: int, numbers: list[int], words_: list[np.ndarray]) -> Seeds:
        w = [windows(words_[i], size) for i in numbers]
        values, at = np.unique(np.concatenate(w), return_inverse=True)
        cuts = np.cumsum([0, *map(len, w)])
        places = {i: at[a:b] for i, a, b in zip(numbers, cuts, cuts[1:])}
        pair, times = np.unique(at * np.int64(len(words_)) + np.repeat(numbers, np.diff(cuts)), return_counts=True)
        return Seeds(size, np.array(numbers), values, places, pair % len(words_), times, np.searchsorted(pair // len(words_), np.arange(len(values) + 1)))


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    tables: list[Seeds]

    def __post_init__(self):
        self.lengths = np.array([len(x) for x in self.words], np.int64)

    @staticmethod
    def of(rows: list[tuple], least: int) -> Items:
        """An item shorter than a seed is its own seed, and is matched as a whole."""
        ids, hs = [i for i, _ in rows], [hashes(words(t)) for _, t in rows]
        by = defaultdict(list)
        for i, h in enumerate(hs):
            if len(h):
                by[min(least, len(h))].append(i)
        return Items(ids, hs, [Seeds.of(size, own, hs) for size, own in sorted(by.items())])

    def scan(self, col: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, list]]:
        """(row, item, coverage, tiles) of all that reach the coverage."""
        for start, part in slices(col):
            code, n, names = word_codes(part)
            h = hashes(names)[code] if len(names) else np.zeros(0, np.uint64)
            ends = np.cumsum(n)
            for t in self.tables:
                for r, i, c, found in self._meet(t, h, n, ends, coverage):
                    yield start + r, i, c, found

    def _meet(self, t: Seeds, h: np.ndarray, n: np.ndarray, ends: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, list]]:
        w = windows(h, t.size)
        if not len(w):
            return
        seed = np.minimum(np.searchsorted(t.values, w), len(t.values) - 1)
        hit = np.flatnonzero(t.values[seed] == w)
        row = np.searchsorted(ends, hit, "right")
        inside = hit + t.size <= ends[row]
        hit, row = hit[inside], row[inside]
        if not len(hit):
            return
        seed = seed[hit]
        # a text's different seeds, so that repetition on either side doesn't multiply
        own = np.unique(row * np.int64(len(t.values)) + seed)
        r, s = np.divmod(own, len(t.values))
        count = np.diff(t.starts)[s]
        total = np.cumsum(count)
        chosen = np.zeros(len(t.values), bool)
        a = 0
        while a < len(r):
            base = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, base + 4_000_000, "right")))
            if b < len(r) and r[b] == r[b - 1]:  # whole texts, one at least
                b = int(np.searchsorted(r, r[b], "left"))
                b = b if b > a else int(np.searchsorted(r, r[a], "right"))
            e = spread(t.starts[s[a:b]], count[a:b])
            pair = np.repeat(r[a:b], count[a:b]) * np.int64(len(self.words)) + t.owners[e]
            o = np.argsort(pair, kind="stable")
            pair, e = pair[o], e[o]
            k = np.repeat(s[a:b], count[a:b])[o]
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            most = np.add.reduceat(t.times[e], first) * t.size
            last = np.append(first[1:], len(pair))
            for p in np.flatnonzero(most >= coverage * self.lengths[pair[first] % len(self.words)]):
                x, i = divmod(int(pair[first[p]]), len(self.words))
                shared = k[first[p] : last[p]]
                chosen[shared] = True
                if got := self._tile(t, x, i, chosen, h, n, ends, hit, row, seed, coverage):
                    yield x, i, *got
                chosen[shared] = False
            a = b

    def _tile(self, t: Seeds, r: int, i: int, chosen: np.ndarray, h, n, ends, hit, row, seed, coverage: float):
        item = self.words[i]
        need = coverage * len(item)
        if _covered(np.flatnonzero(chosen[t.places[i]]), t.size, len(item)).sum() < need:  # no tiling can cover more than the seeds do
            return None
        lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, "right")
        base = ends[r] - n[r]
        at = np.flatnonzero(_covered(hit[lo:hi][chosen[seed[lo:hi]]] - base, t.size, int(n[r])))
        # only words in seeds can be in tiles; a gap between them is kept as one word of no item
        gap = np.flatnonzero(np.diff(at) > 1) + 1
        text, back = np.insert(h[base + at], gap, np.uint64(0)), np.insert(at, gap, -1)
        found = [(m, x, int(back[y])) for m, x, y in tiles(text, item, t.size)]
        c = sum(m for m, _, _ in found) / len(item)
        return (c, found) if c >= coverage else None


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in runs of this size that begin at these places."""
    d = np.zeros(n + 1, np.int64)
    d[at] += 1
    np.subtract.at(d, at + size, 1)
    return np.cumsum(d[:n]) > 0


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL")


SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int"


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) for each text and test item of which tiles of at least least words cover at least coverage.

    Tiles may stand in any order, so reordered passages count. An item of fewer than least words is matched as a whole; one
    without words isn't matched. Items up to broadcast_bytes of text go to every task and nothing is shuffled; beyond,
    seeds that pass a sieve of the items' seeds (32 MB at most) are joined by shuffle, and only texts and items that share
    one are tiled. A NULL id or text on either side gives no row; items that repeat are reported once for each id; rows
    of documents that repeat are reported each; texts of any length are read whole, repetitive ones in time that grows with
    their length and not with the number of matches; other columns don't matter; empty tables give an empty result.
    """
    src = roomy(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL"))
    tests = _items(benchmark, item_id, item_text).distinct()
    if tests.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0))).first()[0] <= broadcast_bytes:
        rows = sorted((r[0], r[1]) for r in tests.collect())
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items.of(shared.value, least)
            for b in batches:
                ids, out = b.column(0).to_pylist(), []
                for r, i, c, found in items.scan(b.column(1), coverage):
                    out.append((ids[r], items.ids[i], c, len(found)))
                yield _batch(out)

        return src.mapInArrow(lean(run), SCHEMA)

    rowed = cut(src.withColumn("row", F.monotonically_increasing_id()), "rows")

    def seeds(id_name: str, text_name: str, sizes: list[int] | None, sieve=None):
        """(id, seed) of texts; of items (sizes None) with their own seed length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(id_name)
                for start, part in slices(b.column(text_name)):
                    code, n, names = word_codes(part)
                    h, ends = hashes(names)[code] if len(names) else np.zeros(0, np.uint64), np.cumsum(n)
                    for k in sizes or range(1, least + 1):
                        w = windows(h, k)
                        if not len(w):
                            continue
                        w = (w ^ np.uint64(k)).view(np.int64)
                        at = np.arange(len(w)) if sieve is None else np.flatnonzero(sieved(sieve.value, w))
                        row = np.searchsorted(ends, at, "right")
                        ok = at + k <= ends[row]
                        if sizes is None:
                            ok &= np.minimum(n[row], least) == k
                        pair = np.unique(np.stack([row[ok], w[at[ok]]]), axis=1)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + pair[0])), pa.array(pair[1])], names=["id", "seed"])

        return run

    right = cut(tests.select("item_id", "item_text").mapInArrow(lean(seeds("item_id", "item_text", None)), "id long, seed long").withColumnRenamed("id", "item_id"), "seeds")
    shared = docs.sparkSession.sparkContext.broadcast(sieve_of(right, "seed"))
    left = rowed.select("row", "text").mapInArrow(lean(seeds("row", "text", list(range(1, least + 1)), shared)), "id long, seed long")
    pairs = left.join(right, "seed").select(F.col("id").alias("row"), "item_id").distinct()
    both = rowed.join(pairs, "row").join(tests, "item_id").select("row", "doc_id", "text", "item_id", "item_text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Memo(lambda it: Items.of([it], least), 1000)
        for b in batches:
            out = []
            for j, (d, i, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), b.column("item_text").to_pylist())):
                for _, _, c, found in made[i, t].scan(b.column("text").slice(j, 1), coverage):
                    out.append((d, i, c, len(found)))
            yield _batch(out)

    return both.mapInArrow(lean(tile), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, i, c, k = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.float64()), pa.array(k, pa.int32())], names=["doc_id", "item_id", "coverage", "n_tiles"])


def drop_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 4_000_000) -> DataFrame:
    """Rows whose id has no leak, all columns as they are; rows without an id stay."""
    gone = cut(found.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
