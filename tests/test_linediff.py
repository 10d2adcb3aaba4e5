import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import lines
from stratalog.operators import linediff

CASES = [
    ("", "", []),
    ("hello\nworld", "hello\nworld", []),
    ("", "l1\nl2\nl3", [(1, ["l1", "l2", "l3"])]),
    ("l1\nl2", "", []),
    ("l1\nl2", "l1\nl2\nl3", [(3, ["l3"])]),
    ("l2\nl3", "l1\nl2\nl3", [(1, ["l1"])]),
    ("l1\nl3", "l1\nl2\nl3", [(2, ["l2"])]),
    ("l1\nl4", "l1\nl2\nl3\nl4\nl5", [(2, ["l2", "l3"]), (5, ["l5"])]),
    ("l1\nold\nl3", "l1\nnew\nl3", [(2, ["new"])]),
    ("o1\no2", "n1\nn2\nn3", [(1, ["n1", "n2", "n3"])]),
    ("l1\n", "l1\n+a\n++b", [(2, ["+a", "++b"])]),
    ("l1\nl2", "l1\n\n\nl2", [(2, ["", ""])]),
    ("l1\n", "l1\n   \n\t\t\n ", [(2, ["   ", "\t\t", " "])]),
    ("hello\n", "hello\n世界\n🚀\némoji", [(2, ["世界", "🚀", "émoji"])]),
    ("l1\r\nl2", "l1\r\nl2\r\nl3", [(2, ["l2\r", "l3"])]),
    ("x\nx\nx\n", "x\nx\nx\nx\n", [(4, ["x"])]),
    ("a\nb\n", "b\na\n", [(2, ["a"])]),
    ("a\nb\nc\n", "c\nb\na\n", [(2, ["b", "a"])]),
    ("\n\n\n", "\n\n", []),
]


def slow(old, new):
    at, out = 0, []
    for k, line in enumerate(new):
        if line in old[at:]:
            at = old.index(line, at) + 1
        else:
            out.append(k)
    return out


@pytest.mark.parametrize("old,new,want", CASES)
def test_cases(old, new, want):
    # an absent old side differs from an empty one only where new is binary or large
    got = linediff.added_hunks(old.encode(), new.encode())
    assert [(s, [x.decode() for x in ls]) for s, ls, b in got if not b] == want


def test_greedy_against_the_rule():
    r = random.Random(3)
    for _ in range(1500):
        voc = [str(i) for i in range(r.choice([3, 8, 200]))]
        old = [r.choice(voc) for _ in range(r.randrange(60))]
        new = old[:] if r.random() < 0.5 else [r.choice(voc) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(5)):
            new.insert(r.randrange(len(new) + 1), r.choice(voc))
        assert linediff.greedy(old, new) == slow(old, new)


def test_native_form_agrees(spark):
    r = random.Random(4)
    rows = []
    for k in range(60):
        voc = [str(i) for i in range(r.choice([2, 5]))]
        rows.append((k, [r.choice(voc) for _ in range(r.randrange(12))], [r.choice(voc) for _ in range(r.randrange(12))]))
    got = spark.createDataFrame(rows, "k int, o array<string>, n array<string>").select("k", lines.added_flags(F.col("o"), F.col("n"))).collect()
    for k, flags in got:
        assert [i for i, f in enumerate(flags) if f] == slow(rows[k][1], rows[k][2])


def test_common_start_changes_nothing():
    r = random.Random(12)
    for _ in range(3000):
        voc = r.choice(["ab", "abc\n", "a\n"])
        make = lambda n: "".join(r.choice(voc) for _ in range(r.randrange(n))).encode()
        head = make(40) * r.choice([1, 1, 1, 4000])
        old, new = head + make(9), head + make(9)
        assert linediff.greedy_bytes(old, new) == linediff.greedy(linediff.byte_lines(old) if old else [], linediff.byte_lines(new) if new else [])
    assert linediff.added_hunks(b"a\n" * 9, b"a\n" * 9 + b"b\n") == [(10, [b"b"], False)]


def test_the_largest_tier_goes_by_hashes():
    old, new = b"a\nb\nc\n", b"c\nx\na\ny\n"
    assert linediff.added_hunks(old, new, small=0, large=1) == linediff.added_hunks(old, new, small=0) == [(2, [b"x"], False), (4, [b"y"], False)]


def test_tiers_and_limits():
    old, new = b"a\nb\n" * 3, b"b\na\nc\n"
    assert [s for s, _, _ in linediff.added_hunks(old, new, small=0)] == [3]
    assert linediff.added_hunks(b"x", b"y" * 20, most=10) == [(1, [b"[File too large to diff: new=20 bytes]"], False)]
    assert linediff.added_hunks(b"x" * 20, b"y", most=10) == [(1, [b"[File too large to diff: old=20 new=1 bytes]"], False)]
    assert linediff.added_hunks(b"x" * 20, b"\0y", most=10) == [(1, [b"\0y"], True)]
    assert linediff.added_hunks(None, b"") == [] == linediff.added_hunks(b"a", None) == linediff.added_hunks(b"a", b"a")
    assert not linediff.is_binary(b"x" * 8192 + b"\0") and linediff.is_binary(b"x" * 8191 + b"\0")


def test_hunks_frame(spark):
    objects = spark.createDataFrame([("o", "blob", bytearray(b"a\nb\n")), ("n", "blob", bytearray(b"a\nc\nb\nd")), ("b", "blob", bytearray(b"\0x")), ("l", "blob", bytearray(b"\xff\n"))], "oid string, type string, data binary")
    pairs = spark.createDataFrame([("c1", "p", "o", "n"), ("c2", "q", "o", "n"), ("c2", "r", None, "b"), ("c3", "s", None, "l"), ("c3", "t", "o", "o"), ("c3", "u", "o", None)], "commit string, path string, old_oid string, new_oid string")
    got = sorted(tuple(r) for r in linediff.hunks(pairs, objects).collect())
    want = [(c, p, 2, 2, False, ["c"], b"c") for c, p in (("c1", "p"), ("c2", "q"))] + [(c, p, 4, 4, False, ["d"], b"d") for c, p in (("c1", "p"), ("c2", "q"))]
    want += [("c2", "r", 1, 1, True, None, b"\0x"), ("c3", "s", 1, 1, False, None, b"\xff")]
    assert [(*g[:6], bytes(g[6])) for g in got] == sorted(want)


def test_missing_content_fails(spark):
    pairs = spark.createDataFrame([("c", "p", None, "nowhere")], "commit string, path string, old_oid string, new_oid string")
    with pytest.raises(Exception, match="missing blob nowhere"):
        linediff.hunks(pairs, spark.createDataFrame([], "oid string, type string, data binary")).collect()


def test_split_lines(spark):
    t = ["", "\n", "a", "a\n", "a\nb", "\n\n", "a\r\n", None]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(t)], "k int, t string").select("k", lines.split_lines(F.col("t"))).orderBy("k").collect()
    assert [g[1] for g in got] == [[], [""], ["a"], ["a"], ["a", "b"], ["", ""], ["a\r"], None]
