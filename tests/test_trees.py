import random
import tracemalloc
from array import array
from collections import Counter

import numpy as np
import pytest

from stratalog.operators import graph, moves, treediff
from stratalog.plans.views import nested

T, F_, X, L, M = 0o040000, 0o100644, 0o100755, 0o120000, 0o160000


def model(old, new):
    out = []
    for p in sorted(set(old) | set(new)):
        a, b = old.get(p), new.get(p)
        if a == b:
            continue
        if a and b and (a[0] ^ b[0]) & 0o170000:
            out += [(p, a[1], None, a[0]), (p, None, b[1], b[0])]
        else:
            out.append((p, a and a[1], b and b[1], (b or a)[0]))
    return out


def listing(r):
    names = ["pkg", "pkg.go", "pkg0", "pkg-old", "a"]
    out = {}
    for _ in range(r.randrange(12)):
        path = "/".join(r.choice(names) for _ in range(r.randrange(1, 4)))
        if not any(p == path or p.startswith(path + "/") or path.startswith(p + "/") for p in out):
            out[path] = (r.choice([F_, X, L, M]), r.choice("uvwxyz"))
    return out


def test_flat_and_nested_against_a_model(spark):
    r = random.Random(5)
    snaps = [listing(r) for _ in range(24)]
    rows = [(k, p, m, o) for k, s in enumerate(snaps) for p, (m, o) in s.items()]
    df = spark.createDataFrame(rows, "ver long, path string, mode int, oid string")
    want = [(k, *e) for k in range(1, 24) for e in model(snaps[k - 1], snaps[k])]
    old = df.where("ver < 23").selectExpr("ver + 1 AS commit", "path", "mode", "oid")
    new = df.where("ver > 0").selectExpr("ver AS commit", "path", "mode", "oid")
    flat = [tuple(x) for x in treediff.snapshot_diff(old, new, "commit").collect()]
    assert sorted(flat, key=repr) == sorted(want, key=repr)
    roots, trees = nested(df)
    pairs = spark.createDataFrame([(k,) for k in range(1, 24)], "commit long")
    pairs = pairs.join(roots.selectExpr("ver + 1 AS commit", "tree_oid AS old_tree"), "commit", "left").join(roots.selectExpr("ver AS commit", "tree_oid AS new_tree"), "commit", "left").selectExpr("string(commit) AS commit", "old_tree", "new_tree")
    deep = [(int(x[0]), *x[1:]) for x in treediff.tree_diff(pairs, trees).collect()]
    assert sorted(deep, key=repr) == sorted(want, key=repr)


def test_mode_only_change_and_empty(spark):
    s = "commit long, path string, mode int, oid string"
    got = treediff.snapshot_diff(spark.createDataFrame([(1, "p", F_, "x")], s), spark.createDataFrame([(1, "p", X, "x")], s), "commit").collect()
    assert [tuple(g) for g in got] == [(1, "p", "x", "x", X)]
    none = spark.createDataFrame([], "commit string, old_tree string, new_tree string")
    assert treediff.tree_diff(none, spark.createDataFrame([], "tree_oid string, name string, mode int, oid string")).count() == 0


def test_moves_against_sequential_credits(spark):
    r = random.Random(6)
    rows = []
    for c in range(40):
        for p in range(r.randrange(14)):
            kind, a, b = r.choice([F_, X, L, M]), r.choice("uvw"), r.choice("uvw")
            shape = r.randrange(3)
            rows.append((str(c), f"p{p:02}", None if shape == 0 else a, None if shape == 1 else b, kind))
    want = []
    for c in {x[0] for x in rows}:
        own = sorted([x for x in rows if x[0] == c], key=lambda x: x[1])
        blob = [x for x in own if x[4] & 0o170000 in (0o100000, 0o120000)]
        credit = Counter((x[2], x[4] & 0o170000) for x in blob if x[3] is None)
        for x in blob:
            if x[3] is not None and x[2] != x[3]:
                k = (x[3], x[4] & 0o170000)
                if credit[k]:
                    credit[k] -= 1
                else:
                    want.append((c, x[1], x[2], x[3], k[1]))
    got = [tuple(x) for x in moves.suppress_moves(spark.createDataFrame(rows, "commit string, path string, old_oid string, new_oid string, mode int")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_walk_order():
    parents = {"d": ["b", "c"], "c": ["a"], "b": ["a"], "a": [], "z": ["gone"]}
    assert list(graph.walk(parents, ["d", "z"])) == ["z", "d", "c", "a", "b"]
    assert list(graph.walk(parents, ["gone"])) == []


def test_parents_first():
    got = graph.parents_first([("c", ["a", "b"], 3), ("b", ["a"], 1), ("a", ["outside"], 5), ("e", ["f"], 2), ("f", ["e"], 1)])
    assert got == ["a", "b", "c", "f", "e"]


def test_reachable_by_frontiers(spark):
    rows = [(k, [k - 1] if k % 5 else [k - 1, k - 3] if k > 3 else []) for k in range(1, 30)]
    c = spark.createDataFrame(rows, "oid long, parents array<long>")
    tips = spark.createDataFrame([(17,), (99,)], "oid long")
    a, b = graph.reachable(c, tips).collect(), graph.reachable(c, tips, most=1).collect()
    assert sorted(a) == sorted(b) and len(a) == len(list(graph.walk(dict(rows), [17])))


def test_first_parent_tree_of_shallow_commit(spark):
    c = spark.createDataFrame([("a", "ta", ["gone"]), ("b", "tb", ["a", "x"]), ("r", "tr", [])], "oid string, tree_oid string, parents array<string>")
    assert {r.oid: r.old_tree for r in graph.first_parent_trees(c).collect()} == {"a": None, "b": "ta", "r": None}
    assert {r.oid for r in graph.without_merges(c).collect()} == {"a", "r"}


def test_parents_first_takes_few_bytes_a_commit():
    """Dictionaries of parents, children and times took several hundred."""
    n = 200_000
    kids = array("i", [k for i in range(n - 2) for k in (i + 1, i + 2)])
    starts = np.minimum(np.arange(n + 1) * 2, len(kids)).astype(np.int32)
    tracemalloc.start()
    try:
        rank = graph.ranks_of_places(starts, kids, n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rank.tolist() == list(range(n)) and peak < 50 * n


def test_topological_over_several_partitions(spark):
    """Times that tie, parents that are younger, outside or named twice, a cycle and no parents at all."""
    r = random.Random(5)
    rows = [(k, [r.randrange(k + 1, 260) for _ in range(r.randrange(3))] if k % 3 else None, r.randrange(40)) for k in range(250)]
    rows += [(300, [301], 1), (301, [300, 300], 0), (302, [7, 7], 0)]
    c = spark.createDataFrame(rows, "oid long, parents array<long>, committer_ts long").repartition(6)
    got = {x.oid: x.topo_rank for x in graph.topological(c).collect()}
    assert len(got) == len(rows)
    assert [o for o, _ in sorted(got.items(), key=lambda x: x[1])] == graph.parents_first((o, p or [], t) for o, p, t in rows)
    place, known = got, set(got)
    assert all(place[p] < place[o] for o, ps, _ in rows if o < 300 for p in ps or [] if p in known)
    assert {place[300], place[301]} == {len(rows) - 2, len(rows) - 1} and place[301] < place[300]
    assert graph.topological(c.where("oid < 0")).count() == 0
    with pytest.raises(ValueError):
        graph.topological(c, 10)
