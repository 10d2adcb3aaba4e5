"""Exact dedup, SimHash, line dedup, and the components that they share."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import exactdedup, linededup, simhash
from stratalog.llm.common import components, labels_of, sieve_of, sieved, words

DATA = "/root/testdata/sf0.001"


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_both_ways(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1090)] + [(5, 5), (2000, -7)]
    df = spark.createDataFrame([*pairs, (None, 3), *pairs[:9]], "a long, b long")
    want = {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items()}
    for most in (10**6, 0):
        got = components(df, most).collect()
        assert len(got) == len(want) and {x.id: x.root for x in got} == want
    assert components(df.limit(0)).count() == 0
    a, b = np.array([0, 1, 5]), np.array([1, 2, 4])
    assert labels_of(a, b, 7).tolist() == [0, 0, 0, 3, 4, 4, 6]


def owners(rows):
    least = {}
    for i, t in rows:
        if t is not None and i is not None:
            least[t] = min(least.get(t, i), i)
    return sorted(((i, i if t is None else least.get(t)) for i, t in rows), key=repr)


ROWS = [(5, "a"), (3, "a"), (9, "b"), (9, "b"), (4, ""), (2, ""), (7, None), (None, None), (None, "a"), (None, "only"), (-1, "ab"), (11, "abc"), (12, "abd"), (13, "abc"), (14, "é" * 100000), (6, "é" * 100000), (5, "twice")]


@pytest.mark.parametrize("how", [{}, {"hash_bits": 0}, {"hot": 2}, {"hash_bits": 0, "hot": 3, "budget": 10}, {"broadcast_bytes": 0}, {"hash_bits": 1, "budget": 2000}, {"hot_bytes": 6}])
def test_owners(spark, how):
    r = random.Random(2)
    rows = ROWS + [(100 + k, "".join(r.choice("ab") for _ in range(r.randrange(6)))) for k in range(300)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, owner_id int, len int, hash string").repartition(5)
    got = sorted((tuple(x) for x in exactdedup.exact_owners(df, **how).collect()), key=repr)
    assert got == owners(rows)
    assert exactdedup.exact_owners(df.limit(0), **how).count() == 0


class Store:
    def __init__(self):
        self.kept, self.saves = {}, 0

    def save(self, first, edge, size):
        self.kept[first], self.saves = (edge, size), self.saves + 1

    def load(self, first):
        return self.kept.pop(first)


def test_trie_with_and_without_spill():
    r = random.Random(3)
    keys = [bytes(r.choice(b"abz") for _ in range(r.randrange(8))) for _ in range(2000)]
    for budget, store in ((1 << 30, None), (30, Store())):
        trie, least = exactdedup.Trie(budget, store), {}
        for n, k in enumerate(keys):
            v = r.randrange(1000)
            least[k] = min(least.get(k, v), v)
            assert trie.put(k, v) == least[k]
        assert store is None or store.saves


def test_trie_keeps_to_its_budget_below_any_prefix():
    r = random.Random(10)
    keys = [b"common prefix/" + bytes(r.choice(b"abc") for _ in range(r.randrange(1, 60))) for _ in range(3000)] + [b"common prefix/" + b"a" * 50 * n for n in range(60)]
    for order in (keys, keys[::-1], r.sample(keys, len(keys))):
        trie, store, most, least = exactdedup.Trie(20_000, Store()), None, 0, {}
        for n, k in enumerate(order + order[::7]):
            least[k] = min(least.get(k, n), n)
            assert trie.put(k, n) == least[k]
            most = max(most, trie.weight)
        assert most <= 20_000 + 120 * (exactdedup.NODE + 50) and trie.spill.saves
    assert trie.put(b"new", None) is None and trie.put(b"new", 4) == 4 and trie.put(b"new", None) == 4


def test_deep_tries_spill_and_come_back(tmp_path):
    spill = exactdedup.Spill(f"file://{tmp_path}")
    trie = exactdedup.Trie(1 << 30, spill)
    for n in range(5000):
        trie.put(b"x" * n, n)
    rows = trie._packed(trie.root)
    spill.save(1, rows, trie.weight)
    back = exactdedup.Trie(1 << 30, spill)
    back.root = back._unpacked(spill.load(1)[0])
    assert all(back.put(b"x" * n, 10**6) == n for n in range(5000)) and not list(spill.store.get_file_info(__import__("pyarrow.fs", fromlist=["fs"]).FileSelector(spill.root)))
    spill.close()


def brute_print(text):
    own = set(words(text))
    bits = [0] * 120
    for w in own:
        h = xxhash.xxh3_128_digest(w.encode())
        lo, hi = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")
        for k in range(60):
            bits[k] += lo >> k & 1
            bits[60 + k] += hi >> k & 1
    bits = [2 * b > len(own) for b in bits]
    return sum(b << k for k, b in enumerate(bits[:60])), sum(b << k for k, b in enumerate(bits[60:]))


def test_fingerprints():
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdé") for _ in range(3)) for _ in range(n)) for n in (0, 1, 2, 5, 254, 255, 256, 700, 3000)] + [None, "... !", "A a,a\nA\tb"]
    f, has = simhash.fingerprints(pa.array(texts))
    for t, p, ok in zip(texts, f.tolist(), has):
        assert bool(ok) == bool(t and words(t))
        if ok:
            assert tuple(p) == brute_print(t)


def test_near_pairs_miss_nothing(spark):
    r = random.Random(5)
    prints = []
    for c in range(30):
        base = r.getrandbits(120)
        for _ in range(12):
            x = base
            for b in r.sample(range(120), r.randrange(14)):
                x ^= 1 << b
            prints.append(x)
    rows = [(k, x & (1 << 60) - 1, x >> 60) for k, x in enumerate(prints)]
    want = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 15}
    df = spark.createDataFrame(rows, "id long, lo long, hi long").repartition(4)
    got = simhash.near_pairs(df).collect()
    assert {(max(x.a, x.b), min(x.a, x.b)) for x in got} == want and len(want) > 500
    assert all(x.distance == (prints[x.a] ^ prints[x.b]).bit_count() for x in got)
    tree = {(x.a, x.b) for x in simhash.near_pairs(df, forest=True).collect()}
    assert roots(tree) == roots(want)
    with pytest.raises(ValueError):
        simhash.near_pairs(df, threshold=16)


def test_wide_blocks_miss_nothing(spark):
    r = random.Random(12)
    prints = []
    for _ in range(25):
        base = r.getrandbits(120)
        prints += [base ^ sum(1 << b for b in r.sample(range(120), r.randrange(9))) for _ in range(12)]
    prints = list(set(prints))
    want = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 7}
    df = spark.createDataFrame([(k, x & (1 << 60) - 1, x >> 60) for k, x in enumerate(prints)], "id long, lo long, hi long").repartition(3)
    for how in ({}, {"comparisons": 40}):
        got = simhash.near_pairs(df, threshold=7, **how).collect()
        assert {(max(x.a, x.b), min(x.a, x.b)) for x in got} == want and len(want) > 300
    lo, hi = np.array([x & (1 << 60) - 1 for x in prints]), np.array([x >> 60 for x in prints])
    every = [(int(i), int(a), bool(h)) for row, anchor, home in simhash.replicas(lo, hi, True) for i, a, h in zip(row, anchor, home)]
    assert len(every) == len({x[:2] for x in every}) and sum(x[2] for x in every) == 4 * len(prints)


def test_a_hot_anchor_is_split_and_misses_nothing(spark):
    r = random.Random(8)
    base = r.getrandbits(120)
    prints = list({base ^ sum(1 << b for b in r.sample(range(120), r.randrange(16))) for _ in range(150)} | {r.getrandbits(120) for _ in range(150)})
    want = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 15}
    df = spark.createDataFrame([(k, x & (1 << 60) - 1, x >> 60) for k, x in enumerate(prints)], "id long, lo long, hi long").repartition(3)
    got = simhash.near_pairs(df, comparisons=50).collect()
    assert {(max(x.a, x.b), min(x.a, x.b)) for x in got} == want and all(x.a != x.b for x in got)
    assert roots({(x.a, x.b) for x in simhash.near_pairs(df, forest=True, comparisons=50).collect()}) == roots(want)


def test_a_dense_anchor_keeps_no_pairs():
    r = np.random.default_rng(9)
    n = 16_000
    lo = np.bitwise_xor(r.integers(0, 1 << 60), np.int64(1) << r.integers(0, 60, n)) ^ (np.int64(1) << r.integers(0, 60, n))
    hi = np.full(n, 5) ^ (np.int64(1) << r.integers(0, 60, n))
    tracemalloc.start()
    x, y = simhash.tree_of(simhash.close_pairs(lo, hi, np.ones(n, bool), 15), n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and len(y) == n - 1 and not x.any()


def test_groups_and_drop(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    near = base[:70] + ["changed"] + base[71:]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (8, " ".join(base)), (8, " ".join(base)), (1, " ".join(word() for _ in range(150))), (2, None), (4, ""), (6, "?!"), (None, " ".join(base)), (7, "one"), (9, "ONE!")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, group_id int, lo string").repartition(3)
    got = simhash.near_groups(df)
    assert sorted(map(tuple, got.collect())) == [(3, 3), (5, 3), (7, 7), (8, 3), (9, 7)]
    for most in (10**6, 0):
        kept = simhash.drop_near(df, got, broadcast_rows=most)
        assert kept.columns == df.columns and Counter(x.doc_id for x in kept.collect()) == Counter([3, 1, 2, 4, 6, None, 7])
    assert simhash.near_groups(df.limit(0)).count() == 0


def test_groups_on_documents(spark):
    """Components of all pairs at distance 15 at most, by brute force."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(x.doc_id, brute_print(x.text)) for x in docs.select("doc_id", "text").collect() if words(x.text)]
    pairs = [(a, b) for n, (a, p) in enumerate(rows) for b, q in rows[:n] if (p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count() <= 15]
    assert pairs and {x.doc_id: x.group_id for x in simhash.near_groups(docs).collect()} == roots(pairs)


def brute_lines(rows, threshold=0.8):
    at = defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            for n, s in linededup._lines(t):
                at[s].append((i, n))
    own = sorted(at)
    sets = {s: linededup.shingles(s) for s in own}
    pairs = [(a, b) for n, a in enumerate(own) for b in own[:n] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    comp = roots(pairs + [(s, s) for s in own])
    groups = defaultdict(set)
    for s in own:
        groups[comp[s]].update(at[s])
    return {(i, n, *min(g)) for g in groups.values() for i, n in g if (i, n) != min(g)}


def test_lines_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(30)) for _ in range(25)]

    def near(s):
        w = s.split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = word()
        return " ".join(w)

    rows = [(k, "\n".join(r.choice([near(r.choice(base)), word(), "", "ab", "  ab ", "é" * 3]) for _ in range(r.randrange(8)))) for k in range(80)]
    rows += [(200, None), (None, base[0]), (201, ""), (202, base[1]), (202, base[1]), (203, "z" * 200000 + "\n" + "z" * 200000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, line_no int, lh string").repartition(4)
    want = brute_lines(rows)
    for most in (10**6, 0):
        got = {tuple(x) for x in linededup.repeated_lines(df, broadcast_rows=most).collect()}
        lines = {x[:2] for x in want}
        assert len({x[:2] for x in got} & lines) >= 0.97 * len(lines) and {x[:2] for x in got} <= lines
        assert len(got & want) >= 0.9 * len(want)
    out = linededup.drop_lines(df, linededup.repeated_lines(df))
    assert out.columns == df.columns
    left = [s for x in out.collect() if x.text and x.doc_id is not None and x.doc_id != 202 for _, s in linededup._lines(x.text)]
    assert len(left) == len(set(left))
    assert linededup.repeated_lines(df.limit(0)).count() == 0


def test_large_buckets_in_blocks_and_chains_of_lines(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    chain = [[word() for _ in range(40)]]
    for k in range(120):  # each line is like the next, not like those farther on
        chain.append(list(chain[-1]))
        chain[-1][k % 40] = word()
    rows = [(k, " ".join(w)) for k, w in enumerate(chain)] + [(1000 + k, f"{' '.join(chain[0])} {k:04d}") for k in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    a = {tuple(x) for x in linededup.repeated_lines(df).collect()}
    b = {tuple(x) for x in linededup.repeated_lines(df, bucket=7, broadcast_rows=0).collect()}
    assert a == b and len(a) >= 0.97 * (len(rows) - 1) and {x for x in a if x[0] >= 1000} == {(1000 + k, 0, 0, 0) for k in range(300)}


def test_equal_lines_in_all_rows(spark):
    df = spark.createDataFrame([(k, f"the same line in all of them\nown {k} {'xyz' * (k % 7)} {k * 7919}") for k in range(2000)], "doc_id long, text string").repartition(7)
    got = {tuple(x) for x in linededup.repeated_lines(df).collect()}
    assert {x for x in got if x[1] == 0} == {(k, 0, 0, 0) for k in range(1, 2000)}


def test_lines_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_lines([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])
    got = {tuple(x) for x in linededup.repeated_lines(docs).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_line_dedup_broadcasts_only_what_the_drivers_heap_can_hold(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the same line of words in {i % 7} places\nand another of document {i}") for i in range(40)], "doc_id long, text string")
    broadcast = lambda out: "strategy=broadcast" in out._jdf.queryExecution().logical().toString()
    a = linededup.repeated_lines(df)
    assert broadcast(a)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    monkeypatch.setattr(linededup, "BROADCAST_ROW", heap, raising=False)  # as if rows were many
    b = linededup.repeated_lines(df)
    assert not broadcast(b) and sorted(a.collect()) == sorted(b.collect()) and a.count() > 0


def test_signatures_rule_out_no_near_line():
    r = random.Random(5)
    words = ["".join(r.choices("abcdeé日", k=r.randint(1, 9))) for _ in range(60)]
    lines = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(40)]
    for x in lines[:30]:  # copies with a few characters changed
        for n in (1, 2, 4):
            y = list(x)
            for _ in range(n):
                y[r.randrange(len(y))] = r.choice("xyz")
            lines.append("".join(y))
    lines = sorted({*lines, "a" * 300, "a" * 301, "ab", "b"})
    cell = np.sort(np.array([r.randrange(4) for _ in lines]))
    near = [any(cell[i] == cell[j] and i != j and linededup.jaccard(linededup.numbers(x), linededup.numbers(y)) >= 0.8 for j, y in enumerate(lines)) for i, x in enumerate(lines)]
    for block in (linededup.BLOCK, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(linededup, "BLOCK", block)
            got = linededup.possible(cell, *linededup.signatures(lines), 0.8)
        assert not (np.array(near) & ~got).any() and any(near)
    assert not linededup.possible(np.zeros(40, int), *linededup.signatures(["%d " % k * 3 + "".join(r.choices("abcdefgh", k=90)) for k in range(40)]), 0.8).any()


def test_line_dedup_joins_by_shuffle_bring_few_of_the_other_lines(spark):
    df = spark.createDataFrame([(i, f"a line that every document has\nline {i * 7919} of one only") for i in range(300)], "doc_id long, text string")
    out = linededup.repeated_lines(df, broadcast_rows=0)
    assert out.count() == 299
    names = []

    def walk(p):
        names.append(p.nodeName())
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(out._jdf.queryExecution().optimizedPlan())
    assert "MapInArrow" in names  # the sieve of the lines that stay, before their join
    few = df.where("doc_id < 10").select("doc_id")
    left = linededup.sifted(df, few, ["doc_id"])
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} >= set(range(10)) and left.count() < 100


def test_a_sieve_takes_little_of_the_driver(spark):
    """As rows, the words of the largest one took 1,973 MB of the driver's Python."""
    values = spark.range(1_000_000).select(F.xxhash64("id").alias("x"))
    own = np.array([r.x for r in values.limit(1000).collect()])
    tracemalloc.start()
    try:
        sieve = sieve_of(values, "x")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sieved(sieve, own).all() and peak < 16e6
    few = sieve_of(spark.createDataFrame([(5,), (64,), (-1,)], "x long"), "x")
    assert np.flatnonzero(sieved(few, np.arange(1024))).tolist() == [5, 64, 1023]


def test_line_dedup_gives_up_sieves_that_nothing_reads_again(spark, monkeypatch):
    held = []
    free = linededup.Sent.free
    monkeypatch.setattr(linededup.Sent, "free", lambda self: (held.append(len(self.held)), free(self)))
    rows = [(i, f"a line that is long enough to have shingles, no. {i // 2}{'!' * (i % 2)}") for i in range(40)]
    got = linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=0)
    assert max(held) == 2 and len(got.collect()) >= 20
