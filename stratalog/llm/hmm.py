"""Hidden Markov language model: Baum-Welch with counts added up across partitions, and exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

import gc
import logging
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, roomy, shared_dir, slices, spread, word_codes

log = logging.getLogger(__name__)

STATES = 6
#: Rounds end when one gains less log-likelihood per word, at any size.
TOLERANCE = 1e-3
#: Characters of distinct texts, and of one text, from which the states begin; rounds then cover all documents.
START_CHARS, START_TEXT = 1_000_000, 20_000
#: A word that occurs as often in the corpus is a symbol of its own; all others are symbol 0.
MIN_COUNT = 2
SMOOTH = 0.1
#: Symbols in a piece of the emission table, about.
PIECE = 30_000


def word_totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in slices(b.column(0), 24_000_000):
                code, _, names = word_codes(part)
                n = np.bincount(code, minlength=len(names))
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(hit)), pa.array(n[hit].astype(np.int64))], names=["word", "n"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pieces_of(h: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of the table (a power of two of them) that a hash is in: ranges, in the hashes' order."""
    bits = pieces.bit_length() - 1
    return (h >> (64 - bits)) + (pieces >> 1) if bits else np.zeros(len(h), np.int64)


def hashes(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), np.uint64, len(names)).view(np.int64)


@dataclass
class Model:
    vocabulary: dict[str, int]  # word -> symbol; 0 is every other word
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states
    rare: int = 1  # words that share symbol 0

    def symbols(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code, n, names = word_codes(part)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in names), np.int32, len(names))[code], n

    def local(self, part: pa.Array) -> tuple[np.ndarray, Model, np.ndarray, np.ndarray]:
        return np.zeros(len(self.emit) - 1, np.int64), self, *self.symbols(part)


@dataclass
class Table:
    """A model of any number of symbols. Words' hashes and expected counts are files in the shared folder, a pair for each piece of the hashes' range, and are mapped: a task reads what its own words need."""

    folder: str
    pieces: int  # a power of two
    start: np.ndarray
    move: np.ndarray
    other: np.ndarray  # counts of symbol 0
    sums: np.ndarray  # of all counts, with their smoothing
    smooth: float  # added to each count
    rare: int
    round: int = 0
    texts: DataFrame | None = field(default=None, repr=False)
    least: float = MIN_COUNT
    maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("maps", "vocabulary", "emit", "texts")} | {"maps": {}, "texts": None}

    def piece(self, p: int) -> tuple[np.ndarray, np.ndarray] | None:
        if p not in self.maps:
            there = os.path.exists(f"{self.folder}/{p}.npy")
            self.maps[p] = (np.load(f"{self.folder}/{p}.npy", mmap_mode="r"), np.load(f"{self.folder}/{p}-{self.round}.npy", mmap_mode="r")) if there else None
        return self.maps[p]

    def emissions(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes (sorted) are symbols, and what the states emit of each that is."""
        known, rows, p = np.zeros(len(h), bool), [np.zeros((0, len(self.start)))], pieces_of(h, self.pieces)
        cuts = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(h) else []
        for a, b in zip(cuts, [*cuts[1:], len(h)]):
            if (maps := self.piece(int(p[a]))) is None:
                continue
            i = np.minimum(np.searchsorted(maps[0], h[a:b]), len(maps[0]) - 1)
            known[a:b] = ok = maps[0][i] == h[a:b]
            rows.append(maps[1][i[ok]])
        return known, (np.concatenate(rows) + self.smooth) / self.sums

    def of(self, h: np.ndarray) -> Model:
        """The model of these symbols, in their order after 0."""
        order = np.argsort(h, kind="stable")
        return self.known(h[order], order, np.zeros(0, np.int64))[1]

    def known(self, h: np.ndarray, place: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, Model, np.ndarray]:
        """Of words with these hashes (sorted; place has the code of each), those that are symbols, in the order of their codes, their model, and the codes as places among these from 1, or 0."""
        ok, rows = self.emissions(h)
        own = np.zeros(len(h), bool)
        own[place] = ok
        symbol = np.cumsum(own)
        emit, names = np.empty((len(rows) + 1, len(self.start))), np.empty(len(rows), np.int64)
        to = symbol[place[ok]]
        emit[0], emit[to], names[to - 1] = (self.other + self.smooth) / self.sums, rows, h[ok]
        symbol[~own] = 0
        return names, Model({}, self.start, self.move, emit, self.rare), symbol[code]

    def local(self, part: pa.Array) -> tuple[np.ndarray, Model, np.ndarray, np.ndarray]:
        code, n, names = word_codes(part)
        h = hashes(names)
        order = np.argsort(h, kind="stable")
        return *self.known(h[order], order, code), n

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        """All words, on the driver: for small tables."""
        rows = word_totals(self.texts, self.texts.columns[0]).where(F.col("n") >= self.least).collect()
        return {w: i + 1 for i, (_, w) in enumerate(sorted((-r["n"], r["word"]) for r in rows))}

    @cached_property
    def emit(self) -> np.ndarray:
        return self.of(hashes(list(self.vocabulary))).emit


def factors(h: np.ndarray, states: int) -> np.ndarray:
    """Factors between 0.2 and 1.8 that disturb a word's share, from its hash and the state alone."""
    x = h.view(np.uint64)[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return 0.2 + 1.6 * ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


#: Symbols whose forward values are held at once; sequences beyond are gone through again from checkpoints.
HELD = 1_300_000
#: Symbols that advance together, about; of long sequences so many more.
TOGETHER, LONGER = 500_000, 1.7
#: Steps after which forward values are scaled; those of a sequence are at its end, too.
SCALED = 8
#: Sequences of more words are gathered from several pieces of a task, so that many advance together.
LONG = 2048
#: Up to so many lanes, calls cost more than values: steps with the same lanes are counted together, so many symbols at once.
NARROW, BULK = 256, 20_000


#: Rows of encoded() are of some MB: row groups end as soon as they have so many bytes, as writers and readers hold one whole.
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.enable.dictionary": False}


class Scratch:
    """Tables of values used again, as fresh memory costs a page fault for each 4 KB; a task drops them at its end."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def table(self, name: str, rows: int, columns: int) -> np.ndarray:
        if self.held.get(name, np.zeros(0)).size < rows * columns:
            self.held.pop(name, None)
            self.held[name] = np.empty(rows * columns)
        return self.held[name][: rows * columns].reshape(rows, columns)

    def clear(self) -> None:
        self.held.clear()


SCRATCH = Scratch()


class Lanes:
    """Sequences (n symbols each, one after the other in obs) side by side: a row for each symbol, ordered by time, the longest sequences first, so that a step's values lie together."""

    def __init__(self, model: Model, obs: np.ndarray, n: np.ndarray, held: int = HELD):
        self.order = np.argsort(-n, kind="stable")
        size = n[self.order].astype(np.int64)
        self.at = (np.cumsum(n, dtype=np.int64) - n)[self.order]
        self.steps = int(size[0]) if len(size) else 0
        self.live = np.searchsorted(-size, -np.arange(self.steps), "left")  # sequences longer than t
        self.off = np.append(0, np.cumsum(self.live))
        self.obs, self.count = obs, len(n)
        self.start, self.move, self.emit = model.start, np.ascontiguousarray(model.move), model.emit
        self.on = np.append(self.live[1:], 0)[: self.steps]  # sequences that go on after t; the others are scaled
        self.scaled = np.arange(self.steps) % SCALED == SCALED - 1
        # stretches of time of about held symbols
        self.cuts, t = [0], 0
        while t < self.steps:
            t = max(t + 1, int(np.searchsorted(self.off, self.off[t] + held, "right")) - 1)
            self.cuts.append(t)
            self.scaled[t - 1] = True

    def symbols(self, t0: int, t1: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a stretch, and the lane of each."""
        live = self.live[t0:t1]
        lane = np.arange(self.off[t1] - self.off[t0]) - np.repeat(self.off[t0:t1] - self.off[t0], live)
        return self.obs[self.at[lane] + np.repeat(np.arange(t0, t1), live)], lane

    def plan(self, t0: int, t1: int) -> list[tuple[int, int, int]]:
        """For each step of a stretch: its first row, its lanes, and the first lane to be scaled."""
        return list(zip((self.off[t0:t1] - self.off[t0]).tolist(), self.live[t0:t1].tolist(), np.where(self.scaled[t0:t1], 0, self.on[t0:t1]).tolist()))

    def values(self, o: np.ndarray) -> np.ndarray:
        """What the states emit of symbols, until values are asked for again."""
        return np.take(self.emit, o, axis=0, out=SCRATCH.table("e", len(o), len(self.start)), mode="clip")

    def forward(self, t0: int, t1: int, before: np.ndarray | None, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values of a stretch, until these are asked for again, and the scales, from the values just before it."""
        a, c, all_states = SCRATCH.table("a", *e.shape), np.ones(len(e)), np.ones(len(self.start))
        for s, k, cold in self.plan(t0, t1):
            x = a[s : s + k]
            if before is None:
                np.multiply(e[:k], self.start, out=x)
            else:
                np.dot(before[:k], self.move, out=x)
                np.multiply(x, e[s : s + k], out=x)
            if cold < k:
                y, z = c[s + cold : s + k], x[cold:]
                np.dot(z, all_states, out=y)
                np.divide(z, y[:, None], out=z)
            before = x
        return a, c

    def likelihoods(self) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """Log-likelihood of each lane, and the forward values before each stretch."""
        ll, before, starts = np.zeros(self.count), None, []
        for t0, t1 in zip(self.cuts, self.cuts[1:]):
            starts.append(before)
            o, lane = self.symbols(t0, t1)
            a, c = self.forward(t0, t1, before, self.values(o))
            before = a[len(a) - int(self.live[t1 - 1]) :].copy()
            ll += np.bincount(lane, weights=np.log(c), minlength=self.count)
        return ll, starts


def forward(model: Model, obs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-likelihood of each sequence (n symbols each, one after the other in obs), all advanced together, by the scaled forward recursion."""
    lanes = Lanes(model, obs, n)
    out = np.zeros(len(n))
    out[lanes.order] = lanes.likelihoods()[0]
    return out


def expected_counts(model: Model, obs: np.ndarray, n: np.ndarray, held: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions given the sequences, and their log-likelihood. Memory is that of held symbols, whatever the sequences' length."""
    lanes = Lanes(model, obs, n, held)
    states = len(model.start)
    turn = np.ascontiguousarray(lanes.move.T)
    start, moves, emit, narrow = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.size), np.empty((NARROW, states))
    one = len(lanes.cuts) == 2  # a single stretch: its forward values are made once
    total, starts = (0.0, [None]) if one else (lambda x: (float(x[0].sum()), x[1]))(lanes.likelihoods())
    after: np.ndarray | None = None  # what the following step hands back
    for t0, t1, before in zip(lanes.cuts[-2::-1], lanes.cuts[:0:-1], starts[::-1]):
        o, _ = lanes.symbols(t0, t1)
        e = lanes.values(o)
        a, c = lanes.forward(t0, t1, before, e)
        if one:
            total = float(np.log(c).sum())
        plan = lanes.plan(t0, t1)
        # backward values stay in a step's own lanes; a becomes a * b, and e what a step hands back
        end = len(plan)
        while end:
            s, k, cold = plan[end - 1]
            x = e[s : s + k]
            if after is not None:
                here, back = a[s : s + len(after)], after @ turn
                moves += here.T @ after
                here *= back
                x[: len(after)] *= back
            if cold < k:
                x[cold:] /= c[s + cold : s + k, None]
            after, last = x, end
            end -= 1
            if k > NARROW:
                continue
            back, least = narrow[:k], s - BULK
            while end and plan[end - 1][1] == k and plan[end - 1][0] >= least:
                end -= 1
                s, _, cold = plan[end]
                x = e[s : s + k]
                np.dot(after, turn, out=back)
                np.multiply(x, back, out=x)
                if cold < k:
                    x[cold:] /= c[s + cold : s + k, None]
                after = x
            if end < last - 1:
                here, then = a[s : plan[last - 1][0]], e[s + k : plan[last - 1][0] + k]
                moves += here.T @ then
                here *= then @ turn
        if t0 == 0:
            start = a[: plan[0][1]].sum(0)
        after = after.copy()
        at = e.view(np.int64)  # e is of no more use
        np.add((o * states)[:, None], np.arange(states), out=at)
        emit += np.bincount(at.ravel(), weights=a.ravel(), minlength=len(emit))
    return start, moves * model.move, emit.reshape(-1, states), total


def _parts(obs: np.ndarray, n: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Symbol sequences of whole texts in even parts of most symbols at most, about, one text at least."""
    ends = np.cumsum(n, dtype=np.int64)
    parts = math.ceil(ends[-1] / most) if len(n) else 0
    cuts = [0, *(int(np.searchsorted(ends, k * ends[-1] / parts, "left")) + 1 for k in range(1, parts)), len(n)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            yield i, obs[ends[i] - n[i] : ends[j - 1]], n[i:j]


def _runs(model: Model | Table, col: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for start, part in slices(col, 9_000_000):
        _, _, obs, n = model.local(part)
        for i, o, k in _parts(obs, n, most):
            yield start + i, o, k


@dataclass
class Group:
    """Sequences with the symbols that they use: emissions by symbol (0 is any other word), hashes of the others, and what names each sequence."""

    h: np.ndarray
    model: Model
    obs: np.ndarray
    n: np.ndarray
    names: pa.Array | None

    def take(self, which: np.ndarray) -> Group:
        """The sequences at these places."""
        at = np.cumsum(self.n, dtype=np.int64) - self.n
        return Group(self.h, self.model, self.obs[spread(at[which], self.n[which])], self.n[which], None if self.names is None else self.names.take(pa.array(which)))

    def lean(self) -> Group:
        """The same sequences, with their symbols only."""
        used, m = np.zeros(len(self.model.emit), bool), self.model
        used[self.obs] = used[0] = True
        return Group(self.h[used[1:]], Model({}, m.start, m.move, m.emit[used], m.rare), (np.cumsum(used) - 1)[self.obs], self.n, self.names)


def _joined(groups: list[Group]) -> Group:
    """Symbols stay apart, except 0."""
    if len(groups) == 1:
        return groups[0]
    m = groups[0].model
    base = np.cumsum([0, *(len(g.h) for g in groups)])
    obs = np.concatenate([np.where(g.obs > 0, g.obs + b, 0) for g, b in zip(groups, base)])
    emit = np.concatenate([m.emit[:1], *(g.model.emit[1:] for g in groups)])
    return Group(np.concatenate([g.h for g in groups]), Model({}, m.start, m.move, emit, m.rare), obs, np.concatenate([g.n for g in groups]), None if groups[0].names is None else pa.concat_arrays([g.names for g in groups]))


def _side_by_side(groups: Iterator[Group], most: int = TOGETHER) -> Iterator[Group]:
    """The same sequences, about most symbols at a time, those of a length together, long ones with long ones of other groups."""
    wait, size = [], 0
    for g in groups:
        order = np.argsort(-g.n.astype(np.int64), kind="stable")
        long = int((g.n > LONG).sum())
        if long:
            wait.append(g.take(order[:long]).lean())
            size += int(wait[-1].n.sum())
        g = g.take(order[long:])
        for i, obs, n in _parts(g.obs, g.n, most):
            yield Group(g.h, g.model, obs, n, None if g.names is None else g.names.slice(i, len(n)))
        del g
        if size > most * LONGER:
            yield _joined(wait)
            wait, size = [], 0
    if wait:
        yield _joined(wait)


def _added(h: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up by hash."""
    keys, inv = np.unique(np.concatenate(h), return_inverse=True)
    c = np.concatenate(c)
    return keys, np.stack([np.bincount(inv, weights=c[:, i], minlength=len(keys)) for i in range(c.shape[1])], axis=1)


def _save(path: str, a: np.ndarray) -> None:
    """Whole or not at all: a task may run twice."""
    with open(own := f"{path}-{uuid.uuid4().hex}", "wb") as f:
        np.save(f, a)
    os.replace(own, path)


#: Sums over all symbols leave a task for one of so many groups, so that none takes them all.
FEW = 32


def _blobs(piece: np.ndarray, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Hashes and counts as bytes, a row for each piece."""
    if (piece[1:] < piece[:-1]).any():
        o = np.argsort(piece, kind="stable")
        piece, h, c = piece[o], h[o], c[o]
    cuts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(piece))
    return pa.RecordBatch.from_arrays([pa.array(piece[cuts].astype(np.int64)), pa.array([h[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], names=["piece", "h", "c"])


def _gather(folder: str, at: int, states: int):
    """Adds up what tasks sent for the pieces of a partition, row by row, and saves each piece: memory is that of these pieces, however many tasks send. Round 0 brings each hash once. Rows (k, sums) are as in fit()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, new, own = np.zeros((states + 4, states)), {}, {}
        for b in batches:
            for p, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h, c = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer()).reshape(-1, states)
                if p < 0:
                    few[h] += c
                elif not at:
                    new.setdefault(p, []).append((h.copy(), c.copy()))
                else:
                    if p not in own:
                        keys = np.load(f"{folder}/{p}.npy", mmap_mode="r")
                        own[p] = keys, np.zeros((len(keys), states))
                    keys, sums = own[p]
                    sums[np.searchsorted(keys, h)] += c  # a row has each hash once
        for p, got in new.items():
            h = np.concatenate([x for x, _ in got])
            order = np.argsort(h)
            _save(f"{folder}/{p}.npy", h[order])
            own[p] = None, np.concatenate([x for _, x in got])[order]
        for p, (_, sums) in own.items():
            _save(f"{folder}/{p}-{at}.npy", sums)
            few[states + 3] += sums.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(states + 4)), *(pa.array(np.ascontiguousarray(few[:, i])) for i in range(states))], names=["k", *(f"c{i}" for i in range(states))])

    return run


def begun(texts: list[str], states: int, smooth: float, seeds: tuple[int, ...] = (11, 12, 13), tolerance: float = 1e-4, tried: int = 15, least: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States from some texts, trained until they settle, from the best of some random beginnings: starts, moves, hashes of words seen twice (sorted), each one's shares of the states, and those of all other words."""
    code, n, names = word_codes(pa.array(texts, pa.string()))
    times = np.bincount(code, minlength=len(names))
    own = times >= 2
    obs = np.where(own, np.cumsum(own), 0)[code]
    share = np.concatenate([[times[~own].sum()], times[own]]) + smooth

    def step(m: Model) -> tuple[float, np.ndarray, Model]:
        s, a, e, ll = expected_counts(m, obs, n)
        s, a, e = s + smooth, a + smooth, e + smooth / states
        return ll, e, Model({}, s / s.sum(), a / a.sum(1, keepdims=True), e / e.sum(0))

    def tries(seed: int) -> tuple[float, np.ndarray, Model]:
        r = np.random.default_rng(seed)
        # far from flat, else rounds gain next to nothing until the states part
        emit = share[:, None] * (r.gamma(0.5, 1, (len(share), states)) + 1e-3)
        move = r.uniform(0.5, 1.5, (states, states))
        got = -math.inf, emit, Model({}, np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        for _ in range(tried if len(obs) else 0):
            got = step(got[2])
        return got

    before, emit, m = max(map(tries, seeds), key=lambda x: x[0])
    k = tried
    while len(obs):
        ll, emit, m = step(m)
        k += 1
        if k >= least and (ll - before) / len(obs) < tolerance:
            break
        before = ll
    SCRATCH.clear()
    h = hashes([x for x, o in zip(names, own) if o])
    shares = emit / emit.sum(1, keepdims=True)
    order = np.argsort(h)
    return m.start, m.move, h[order], shares[1:][order], shares[0]


def _some(texts: DataFrame) -> list[str]:
    """Distinct texts with the smallest hashes, START_CHARS together and one at least, each cut at START_TEXT."""
    keyed = texts.where("length(text) > 0").select(F.xxhash64("text").alias("h"), F.substring("text", 1, START_TEXT).alias("text"))
    sizes = keyed.select("h", F.length("text").alias("n")).distinct().orderBy("h", "n").limit(20_000).collect()
    if not sizes:
        return []
    ends = np.cumsum([x.n for x in sizes])
    last = sizes[min(len(sizes) - 1, int(np.searchsorted(ends, START_CHARS)))].h
    return [x.text for x in sorted(keyed.where(F.col("h") <= last).dropDuplicates(["h"]).collect())]


def _folder(docs: DataFrame) -> str:
    spark = docs.sparkSession
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError("the emission table is mapped: spark.checkpoint.dir must be a mounted folder (file://)")
    path = f"{root.removeprefix('file:').replace('//', '/', 1) if root.startswith('file:') else root}/{spark.sparkContext.applicationId}/hmm-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _bytes(x: np.ndarray) -> pa.Array:
    """A row of an array's bytes."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def encoded(docs: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """All texts, tokenised once and written: a row for each piece of a task, with the hashes (sorted) of its words, their numbers (c) and codes (place), the texts' words as codes, each text's number of words, and which are NULL; names are the ids, if wanted. The first four are bytes, as the JVM handles the elements of arrays one by one."""
    src = roomy(docs.select(docs[text_col].alias("text"), *([docs[id_col].alias("name")] if id_col else [])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in slices(b.column(0), 9_000_000):
                code, n, names = word_codes(part)
                c = np.bincount(code, minlength=len(names)).astype(np.int64)
                h, c, obs = hashes(names)[c > 0], c[c > 0], (np.cumsum(c > 0) - 1)[code].astype(np.int32)
                order = np.argsort(h, kind="stable")
                lists = [_bytes(x) for x in (h[order], c[order], order.astype(np.int32), obs)] + [pa.array([x]) for x in (n.astype(np.int32), ~part.is_valid().to_numpy(zero_copy_only=False))]
                if id_col:
                    own = b.column(1).slice(start, len(part))
                    lists.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
                yield pa.RecordBatch.from_arrays(lists, names=["h", "c", "place", "obs", "n", "null", *(["names"] if id_col else [])])

    kind = f", names array<{src.schema['name'].dataType.simpleString()}>" if id_col else ""
    return cut(src.mapInArrow(lean(run), f"h binary, c binary, place binary, obs binary, n array<int>, null array<boolean>{kind}"), "coded", **ROW_GROUPS)


def _hash_totals(coded: DataFrame) -> DataFrame:
    """(h, n) over all documents; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs = [], []

        def out() -> pa.RecordBatch:
            h, c = _added(hs, cs)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.rint(c[:, 0]).astype(np.int64))], names=["h", "n"])

        for b in batches:
            for i in range(len(b)):
                hs.append(np.frombuffer(b.column(0)[i].as_buffer(), np.int64))
                cs.append(np.frombuffer(b.column(1)[i].as_buffer(), np.int64)[:, None])
            if sum(map(len, hs)) > 1_000_000:
                yield out()
                hs, cs = [], []
        if hs:
            yield out()

    return coded.select("h", "c").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _coded_groups(batches: Iterator[pa.RecordBatch], m: Table, named: bool = False) -> Iterator[Group]:
    """Columns h, place, obs, n and, if named, names and null."""
    for b in batches:
        for i in range(len(b)):
            h, place, obs = (np.frombuffer(b.column(k)[i].as_buffer(), kind) for k, kind in enumerate((np.int64, np.int32, np.int32)))
            names = pa.StructArray.from_arrays([b.column(4)[i].values, b.column(5)[i].values], names=["name", "null"]) if named else None
            yield Group(*m.known(h, place, obs), b.column(3)[i].values.to_numpy(), names)


def train(docs: DataFrame, states: int = STATES, rounds: int | None = None, min_share: float = 0.0, smooth: float = SMOOTH, text_col: str = "text", min_count: int = MIN_COUNT, tolerance: float = TOLERANCE) -> Table:
    """Vocabulary and every round's counts come from all documents; see fit(). NULL and empty texts add nothing; of repeated rows each counts; texts of any length are read whole, in memory that doesn't grow with them; other columns don't matter; an empty table gives a model without words."""
    return fit(encoded(docs, text_col), docs.select(docs[text_col].alias("text")), states, rounds, min_share, smooth, min_count, tolerance)


def fit(coded: DataFrame, texts: DataFrame, states: int = STATES, rounds: int | None = None, min_share: float = 0.0, smooth: float = SMOOTH, min_count: int = MIN_COUNT, tolerance: float = TOLERANCE) -> Table:
    """A model of encoded(texts).

    A word is a symbol of its own if it occurs min_count times (and has min_share of all words). Texts are encoded once;
    in a round each task adds up its own counts, which meet in a shuffle by piece of the table. Only sums over all
    symbols reach the driver. States begin from some texts, and rounds over all documents follow until one gains less than
    tolerance in log-likelihood per word; with rounds, from nearly flat states, just as many. Two words with the same 64-bit hash would be one symbol.
    """
    spark = coded.sparkSession
    folder = _folder(coded)
    totals = cut(_hash_totals(coded), "words")
    total, distinct = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(min_count, 2, min_share * total)
    own = totals.where(F.col("n") >= least)
    symbols, covered = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    r = np.random.default_rng(11)
    move = r.uniform(0.5, 1.5, (states, states))
    start, move, rare_shares = np.full(states, 1 / states), move / move.sum(1, keepdims=True), r.uniform(0.2, 1.8, states)
    known, shares = np.zeros(0, np.int64), np.zeros((0, states))
    if rounds is None:
        start, move, known, shares, rare_shares = begun(_some(texts), states, smooth)
    warm = spark.sparkContext.broadcast((known, shares, rare_shares))
    pieces = 1 << max(0, math.ceil(math.log2(max(1, symbols / PIECE))))
    model = Table(folder, pieces, start, move, float(total - covered) * rare_shares, np.ones(states), smooth / states, distinct - symbols + 1, 0, texts, least)
    keyed = "piece long, h binary, c binary"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            if rounds is None:
                known, shares, rest = warm.value
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                by = np.where((known[i] == h)[:, None], shares[i], rest) if len(known) else np.tile(rest, (len(h), 1))
            else:
                by = factors(h, states)
            yield _blobs(pieces_of(h, pieces), h, b.column(1).to_numpy()[:, None] * by)

    def gathered(rows: DataFrame, at: int) -> np.ndarray:
        """By row: starts, moves, symbol 0, log-likelihood, all own symbols."""
        out = np.zeros((states + 4, states))
        for x in rows.repartition("piece").mapInArrow(lean(_gather(folder, at, states)), "k long, " + ", ".join(f"c{i} double" for i in range(states))).collect():
            out[x.k] += x[1:]
        return out

    model.sums = gathered(own.select("h", "n").mapInArrow(lean(begin), keyed), 0)[states + 3] + model.other + model.smooth * (symbols + 1)
    if rounds == 0 or not total:
        return model
    at, before, more = 0, -math.inf, True
    while more:
        at += 1
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            few, hs, cs = np.zeros((states + 3, states)), [], []
            for g in _side_by_side(_coded_groups(batches, shared.value)):
                x, y, z, ll = expected_counts(g.model, g.obs, g.n)
                few[0] += x
                few[1 : states + 1] += y
                few[states + 1] += z[0]
                few[states + 2, 0] += ll
                if hs and hs[-1] is g.h:
                    cs[-1] += z[1:]
                    continue
                hs.append(g.h)
                cs.append(z[1:])
                if sum(map(len, hs)) > 600_000:
                    hs, cs = ([x] for x in _added(hs, cs))
                    if len(hs[0]) > 300_000:
                        yield _blobs(pieces_of(hs[0], pieces), hs[0], cs[0])
                        hs, cs = [], []
            SCRATCH.clear()
            k = np.arange(states + 3)
            yield _blobs(np.full(len(k), -1 - TaskContext.get().partitionId() % FEW), k, few)
            if hs:
                h, c = _added(hs, cs)
                yield _blobs(pieces_of(h, pieces), h, c)

        got = gathered(coded.select("h", "place", "obs", "n").mapInArrow(lean(run), keyed), at)
        s, a = got[0] + smooth, got[1 : states + 1] + smooth
        model = Table(folder, pieces, s / s.sum(), a / a.sum(1, keepdims=True), got[states + 1], got[states + 1] + got[states + 3] + (symbols + 1) * smooth / states, smooth / states, model.rare, at, texts, least)
        shared.unpersist()
        for p in range(pieces):  # the round before is of no more use
            if os.path.exists(old := f"{folder}/{p}-{at - 1}.npy"):
                os.remove(old)
        gc.collect()  # this round's frames first, as they hold its shuffle; then Spark drops the files
        spark.sparkContext._jvm.System.gc()
        more = at < rounds if rounds is not None else (got[states + 2, 0] - before) / total >= tolerance
        log.info("round %d: %.5f a word", at, got[states + 2, 0] / total)
        before = got[states + 2, 0]
    return model


def score(docs: DataFrame, model: Model | Table, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word), a row for each input row: the natural logarithm of the probability of the whole symbol sequence, and its share per word.

    A NULL text has NULL in all three; a text without words has 0, 0 and NULL. Ids may be NULL or repeat; other columns
    don't matter; texts of any length are scored whole; an empty table gives an empty result. A word without a symbol of
    its own has symbol 0's probability divided by the number of words that share it. Tasks map the emission table and
    read the rows of their own words. No shuffle.
    """
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
        for b in batches:
            for start, part in slices(b.column(1), 9_000_000):
                names = pa.StructArray.from_arrays([b.column(0).slice(start, len(part)), part.is_null()], names=["name", "null"])
                yield Group(*shared.value.local(part), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scores(groups(batches))

    return src.mapInArrow(lean(run), _score_schema(src.schema["doc_id"].dataType.simpleString()))


def _score_schema(kind: str) -> str:
    return f"doc_id {kind}, n_words long, log_likelihood double, per_word double"


def _scores(groups: Iterator[Group]) -> Iterator[pa.RecordBatch]:
    for g in _side_by_side(groups):
        rare = np.bincount(np.repeat(np.arange(len(g.n)), g.n)[g.obs == 0], minlength=len(g.n))
        ll, size = forward(g.model, g.obs, g.n) - rare * math.log(g.model.rare), g.n.astype(np.int64)
        null = g.names.field(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([g.names.field(0), pa.array(size, mask=null), pa.array(ll, mask=null), pa.array(ll / np.maximum(size, 1), mask=size == 0)], names=["doc_id", "n_words", "log_likelihood", "per_word"])
    SCRATCH.clear()


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """score(docs, train(docs)) from one encoding of the texts."""
    coded = encoded(docs, text_col, id_col)
    model = fit(coded, docs.select(docs[text_col].alias("text")), **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scores(_coded_groups(batches, shared.value, named=True))

    return coded.select("h", "place", "obs", "n", "names", "null").mapInArrow(lean(run), _score_schema(docs.schema[id_col].dataType.simpleString()))
