"""URL filter, decontamination and mixing."""

import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import decontam, mixing, urlfilter

DATA = "/root/testdata/sf0.01"
duckdb = pytest.importorskip("duckdb")


def brute_url(url, voc, min_soft):
    u = urlfilter.ascii_lower(url or "")
    for x in ("%2d", "%2e", "%5f", "%20", "%2b", "%7e", "_", ".", "+", "~", " "):
        u = u.replace(x, "-")
    n = {t: len(re.findall(rf"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", u)) for t in voc}
    strict = sum(k for t, k in n.items() if voc[t][1])
    soft = sum(k for t, k in n.items() if not voc[t][1])
    kinds = sum(k > 0 for t, k in n.items() if not voc[t][1])
    return strict, soft, kinds, sum(k * voc[t][0] for t, k in n.items()), strict > 0 or kinds >= min_soft


def test_urls_against_regular_expressions(spark):
    r = random.Random(1)
    words = [*urlfilter.VOCABULARY, "winner", "sads", "x", "é", "İ", "Casino", "FREE"]
    urls = ["".join(r.choice(words) + r.choice(["-", "/", ".", "", "--", "%20"]) for _ in range(r.randrange(7))) for _ in range(400)] + [None, "", "-" * 70000 + "xxx"]
    rows = [(k if k % 9 else None, u, "html", 1, k) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string, strict_hits int, rejected long").repartition(3)
    got = urlfilter.url_filter(df).collect()
    assert len(got) == len(rows) + 5
    for g in got:
        assert (g.strict_hits, g.soft_hits, g.soft_terms, round(g.weight, 9), g.rejected) == tuple(round(x, 9) if isinstance(x, float) else x for x in brute_url(g.url, urlfilter.VOCABULARY, 2))
    assert urlfilter.url_filter(df.limit(0)).count() == 0


def test_separators_and_a_vocabulary_from_a_file(spark, tmp_path):
    (tmp_path / "v").write_text("# own terms\nadult-x 5 strict\n\nwin 0.5 soft\nbig 1 soft\n")
    voc = urlfilter.load_vocabulary(str(tmp_path / "v"))
    assert voc == {"adult-x": (5.0, True), "win": (0.5, False), "big": (1.0, False)}
    urls = ["h/adult_x", "h/adult.x", "h/Adult%2Dx", "h/adultx", "h/win+big", "h/winbig", "h/win/win"]
    got = urlfilter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), voc).collect()
    assert [x.rejected for x in sorted(got)] == [True, True, True, False, True, False, False]
    (tmp_path / "v").write_text("Bad! 1 soft\n")
    with pytest.raises(ValueError):
        urlfilter.load_vocabulary(str(tmp_path / "v"))


def test_urls_against_sql(spark):
    con = duckdb.connect()
    path = f"{DATA}/pages.parquet"
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = urlfilter.url_filter(spark.read.parquet(path))
    rows = con.execute("SELECT {} FROM ({})".format(", ".join(df.columns), urlfilter.oracle())).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(rows) and any(x[-1] for x in rows) and not all(x[-1] for x in rows)


def brute_tiles(text, item, least):
    """Word by word, without hashes."""
    out, mt, mi = [], [False] * len(text), [False] * len(item)
    while True:
        best, found = least, []
        for x in range(len(item)):
            for y in range(len(text)):
                k = 0
                while x + k < len(item) and y + k < len(text) and item[x + k] == text[y + k] and not mi[x + k] and not mt[y + k]:
                    k += 1
                if k > best:
                    best, found = k, [(x, y)]
                elif k == best:
                    found.append((x, y))
        done = False
        for x, y in sorted(found):
            if not any(mi[x : x + best]) and not any(mt[y : y + best]):
                mi[x : x + best] = mt[y : y + best] = [True] * best
                out.append((best, x, y))
                done = True
        if not done:
            return out


def test_tiles_against_brute_force():
    r = random.Random(2)
    for _ in range(150):
        voc = r.choice([2, 4, 9])
        text, item = ([r.randrange(voc) for _ in range(r.randrange(1, 40))] for _ in range(2))
        if r.random() < 0.5 and len(item) > 10:
            text = text[:5] + item[6:] + text[5:9] + item[:6]
        got = decontam.tiles(np.array(text, np.uint64), np.array(item, np.uint64), 3)
        assert got == brute_tiles(text, item, 3)


def brute_leaks(docs, items, least=5, coverage=0.5):
    out = []
    for d, t in docs:
        for i, b in items:
            if d is not None and t is not None and i is not None and b is not None and decontam.words(b):
                w = decontam.words(b)
                c = sum(k for k, _, _ in brute_tiles(decontam.words(t), w, min(least, len(w)))) / len(w)
                if c >= coverage and c > 0:
                    out.append((d, i, round(c, 9)))
    return sorted(out)


def test_leaks_against_brute_force_on_both_paths(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    items = [(k, " ".join(word() for _ in range(r.choice([3, 8, 20])))) for k in range(6)] + [(7, None), (None, "a b c d e f"), (8, ""), (9, "q w e r t y")]
    docs = []
    for k in range(40):
        w = [word() for _ in range(r.randrange(40))]
        b = (items[r.randrange(6)][1]).split()
        h = r.randrange(1, len(b))
        docs.append((k, " ".join(w[:9] + r.choice([[], b, b[h:] + ["zz"] + b[:h], b[: len(b) // 3]]) + w[9:])))
    docs += [(100, None), (None, "q w e r t y"), (101, ""), (102, "Q, w; e\nr - t y!"), (102, "Q, w; e\nr - t y!"), (103, "x " * 30000 + "q w e r t y " + "x " * 30000)]
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, item_id int, coverage string").repartition(3)
    bench = spark.createDataFrame([(i, b, 5) for i, b in items], "item_id long, text string, doc_id int")
    want = brute_leaks([x for x in docs if x[0] != 103], items) + [(103, 9, 1.0)]
    for how in ({}, {"broadcast_bytes": 0}):
        got = sorted((g.doc_id, g.item_id, round(g.coverage, 9)) for g in decontam.leaks(df, bench, **how).collect())
        assert got == sorted(want)
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0
    kept = decontam.drop_leaks(df, decontam.leaks(df, bench))
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_short_items_and_repetition(spark):
    items = [(1, "what is two plus"), (2, "who wrote hamlet"), (3, "yes"), (4, "a b a b a b a b a b a b"), (5, "z " * 200), (6, "")]
    docs = [(1, "so, what is two plus? then who wrote Hamlet"), (2, "who wrote the hamlet is two plus what"), (3, "a b " * 400), (4, "b a " * 4), (5, "z " * 130), (6, "z " * 90), (7, "yes or no"), (8, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert {(1, 1), (1, 2), (3, 4), (5, 5), (7, 3)} <= {x[:2] for x in want} and (6, 5, 0.45) not in want
    for how in ({}, {"broadcast_bytes": 0}):
        assert sorted((g.doc_id, g.item_id, round(g.coverage, 9)) for g in decontam.leaks(df, bench, **how).collect()) == want


def test_repetitive_texts_take_time_by_length():
    w = decontam.hashes(["a", "b", "c"])
    began = time.monotonic()
    for text, item in ((w[np.zeros(1_000_000, int)], w[np.zeros(1000, int)]), (w[np.arange(1_000_000) % 2], w[np.arange(1000) % 2]), (w[np.arange(300_000) % 3], w[np.arange(1000) // 250 % 3])):
        got = decontam.tiles(text, item)
        assert got == [] or sum(k for k, _, _ in got) <= 1000
    items = decontam.Items.of([(k, "a " * (500 + k)) for k in range(3)], 5)
    assert [(r, i, c) for r, i, c, _ in items.scan(pa.array(["a " * 1_000_000, "b " * 50]), 0.5)] == [(0, k, 1.0) for k in range(3)]
    assert time.monotonic() - began < 60


def test_leaks_find_every_copied_item(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = bench.select("item_id", "text").collect()
    want = {(d.doc_id, i.item_id) for d in docs.select("doc_id", "text").collect() for i in items if i.text in d.text}
    got = {(g.doc_id, g.item_id) for g in decontam.leaks(docs, bench).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)


def test_weights():
    tokens = [1000, 100, 10, 0]
    a, w = mixing.weights(tokens, 1110, target=0.9, max_repeats=1e9)
    assert abs(mixing.entropy(w) - 0.9 * math.log(3)) < 1e-6 and w[3] == 0 and abs(sum(w) - 1) < 1e-12
    a, w = mixing.weights(tokens, 1110, target=1.0, max_repeats=4)
    assert max(x * 1110 / n for x, n in zip(w, tokens) if n) == pytest.approx(4, abs=1e-6)
    assert mixing.weights([5, 5], 10)[1] == [0.5, 0.5] and mixing.weights([7], 7)[1] == [1.0] and mixing.weights([0, 0], 0)[1] == [0.0, 0.0]
    b = [mixing.weights(tokens, 1110, t, 1e9)[0] for t in (0.5, 0.7, 0.9)]
    assert b == sorted(b, reverse=True)


@pytest.mark.parametrize("block_tokens", [8, 50, 1 << 20])
def test_plan_against_running_sums(spark, block_tokens):
    r = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(r.randrange(9))), r.choice(["a", "a", "a", "b", None])) for k in range(120)] + [(200, None, "c"), (201, "", "c"), (202, "x y", "a"), (202, "x y", "a")]
    df = spark.createDataFrame([(*x, 1, "e", 2) for x in rows], "doc_id long, text string, source string, epoch int, block string, tokens int").repartition(4)
    n = {x: (len(re.split(r"[ \n\t\r]", x[1])) if x[1] else 0) for x in rows}
    by = {}
    for x in rows:
        by.setdefault(x[2], []).append(x)
    names = sorted(by, key=lambda s: (s is not None, s or ""))
    tokens = [sum(n[x] for x in by[s]) for s in names]
    budget = int(1.7 * sum(tokens))
    _, w = mixing.weights(tokens, budget)
    got = [tuple(g) for g in mixing.plan(df, budget=budget, block_tokens=block_tokens).collect()]
    for s, own, weight in zip(names, tokens, w):
        mine = sorted((e, b, p, d) for d, q, e, b, p in got if q == s)
        full = int(weight * budget // own) if own else 0
        rest = weight * budget - full * own
        for e in range(full):
            assert sorted(x[3] for x in mine if x[0] == e) == sorted(x[0] for x in by[s])
        keys = spark.createDataFrame([(x[0],) for x in by[s]], "d long").select("d", mixing._key(mixing.SEED, F.lit(full), F.col("d")).alias("p"), mixing._key(mixing.SEED + 2, F.lit(full), F.pmod(mixing._key(mixing.SEED + 1, F.lit(full), F.col("d")), F.lit(max(1, round(own / block_tokens))).cast("long"))).alias("b")).collect()
        order = sorted(zip(keys, by[s]), key=lambda k: (k[0].b, k[0].p, k[0].d))
        want, at = [], 0
        whole = {}
        for k, x in order:
            whole[k.b] = whole.get(k.b, 0) + n[x]
        before, total = {}, 0
        for b in sorted(whole):
            before[b], total = total, total + whole[b]
        for k, x in order:
            if rest > 0 and before[k.b] < rest and (before[k.b] + whole[k.b] <= rest or at < rest):
                want.append(x[0])
            at += n[x]
        assert sorted(x[3] for x in mine if x[0] == full) == sorted(want)
        spent = sum(n[x] for x in by[s]) * full + sum(n[x] for k, x in order if x[0] in want) if len(set(x[0] for x in by[s])) == len(by[s]) else None
        if spent is not None and own:
            assert weight * budget <= spent + 1e-6 and spent < weight * budget + 9


def test_mix_of_nothing_and_columns(spark):
    s = "doc_id long, text string, source string, extra array<int>"
    assert mixing.plan(spark.createDataFrame([], s)).count() == 0 and mixing.mixed(spark.createDataFrame([], s)).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "x", [1]), (2, "a", "y", None), (None, "z", "y", [])], s)
    out = mixing.mixed(df, max_repeats=3.0)
    assert out.columns == df.columns
    ids = [x.doc_id for x in out.collect()]
    assert ids.count(2) > 1 and ids.count(None) == 1


def test_mixed_follows_the_plan(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: r["count"] for r in mixing.plan(df).groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()} == want and max(want.values()) > 1


def test_mixed_is_the_plan_for_repeated_ids_and_in_its_order(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3, *range(10, 60)]), " ".join("w" for _ in range(r.randrange(9))), s, k) for k, s in enumerate(["big"] * 300 + ["small"] * 25 + [None] * 12)]
    rows += [(1, "x y z", "big", 1000 + k) for k in range(150)] + [(1, "x y z", "small", 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int").repartition(5)
    for block in (8, 1 << 20):
        want = Counter((x.doc_id, x.source, x.epoch, x.block, x.place) for x in mixing.plan(df, block_tokens=block).collect())
        got = mixing.mixed(df, block_tokens=block, with_plan=True).toDF("doc_id", "text", "source", "own", "epoch", "block", "place").collect()
        assert Counter((x.doc_id, x.source, x.epoch, x.block, x.place) for x in got) == want
        assert [(x.epoch, x.block, x.place) for x in got] == sorted((x.epoch, x.block, x.place) for x in got)
        small = [x.own for x in got if x.source == "small"]
        assert max(Counter(small).values()) > 1 and all(a != b for a, b in zip(small, small[1:]))  # no copy next to its like
        assert set(Counter(Counter((x.own, x.epoch) for x in got).values())) == {1}  # a row once an epoch at most
        tokens = sum(len(t.split(" ")) if t else 0 for _, t, _, _ in rows)
        assert abs(sum(len(x.text.split(" ")) if x.text else 0 for x in got) - tokens) < 30


def test_running_sums_of_a_hot_key(spark):
    rows = [(k % 2, 7, k) for k in range(3000)] + [(0, k % 5, k) for k in range(200)]
    df = spark.createDataFrame(rows, "src int, place int, n long").repartition(6)
    got = sorted(mixing.running(df, ["src"], ["place"], "n", "sums").collect(), key=lambda x: (x.src, x.place, x.sofar))
    for s in (0, 1):
        total = 0
        for x in sorted((x for x in got if x.src == s), key=lambda x: (x.place, x.sofar, x.n)):
            assert x.sofar == total
            total += x.n
    assert Counter((x.src, x.place, x.n) for x in got) == Counter(rows)


def test_url_vocabulary_covers_its_categories(spark):
    bad = ["porn.example/a", "a.example/viagra/x", "x.example/online-casino", "x.example/poker-jackpot", "escort-girls.example", "free-warez.example", "x.example/payday-loans", "x.example/buy-xanax"]
    good = ["news.example/politics", "shop.example/shoes", "essex.example/council", "x.example/free", "clinic.example/breast-cancer", "community.example/gay-rights"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    assert [x.rejected for x in sorted(urlfilter.url_filter(df).collect())] == [True] * len(bad) + [False] * len(good)
