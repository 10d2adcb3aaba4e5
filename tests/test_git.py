"""Repositories made with git, read without it, and compared with what git says."""

import hashlib
import os
import random
import shutil
import struct
import subprocess
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from stratalog.functions import headers
from stratalog.plans import fixture
from stratalog.plans.scanner import HistoryScanner
from stratalog.sources import gitfiles, gitgraph, gitsource
from stratalog.sources.gitsource import load

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="git makes the fixtures")


class Repo:
    def __init__(self, path):
        self.path, self.clock = str(path), 1_600_000_000
        os.makedirs(self.path, exist_ok=True)
        self.git("init", "-q", "-b", "main", ".")

    def git(self, *args, data=None):
        self.clock += 60
        env = os.environ | {"GIT_AUTHOR_NAME": "A U Thor", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d.e", "GIT_AUTHOR_DATE": f"{self.clock} +0100", "GIT_COMMITTER_DATE": f"{self.clock + 7} +0000", "GIT_CONFIG_GLOBAL": "/dev/null", "HOME": self.path}
        return subprocess.run(["git", *args], cwd=self.path, env=env, input=data, capture_output=True, check=True).stdout

    def write(self, files):
        for name, data in files.items():
            at = os.path.join(self.path, name)
            if data is None:
                os.remove(at)
                continue
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as f:
                f.write(data if isinstance(data, bytes) else data.encode())

    def commit(self, files, message="m"):
        self.write(files)
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", message)
        return self.git("rev-parse", "HEAD").decode().strip()


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """Appends, rewrites, a binary, moves, a directory that becomes a file, merges, tags; two packs and loose objects."""
    r = Repo(tmp_path_factory.mktemp("big"))
    text = "".join(f"line {k}\n" for k in range(200))
    for k in range(25):
        text += f"more {k}\n"
        r.commit({"a.txt": text, "sub/dir/b.txt": f"{k}\n" + text[::-1], "c.bin": bytes([0, k]) * 300})
    r.git("repack", "-adfq", "--depth=30", "--window=50")
    r.commit({"pkg/x.go": "x\n", "pkg.go": "y\n", "pkg0": "z\n"})
    r.commit({"pkg/x.go": None, "moved.go": "x\n"})
    r.git("checkout", "-q", "-b", "side", "HEAD~3")
    r.commit({"side.txt": "s\nt\n", "pkg0": "other\n"})
    r.git("checkout", "-q", "main")
    r.git("merge", "-q", "--no-ff", "-X", "ours", "side", "-m", "merge")
    r.git("repack", "-dq")
    shutil.rmtree(os.path.join(r.path, "pkg"), ignore_errors=True)
    r.commit({"pkg": "now a file\n"})
    os.symlink("a.txt", os.path.join(r.path, "link"))
    r.commit({})
    r.git("tag", "-a", "v1", "-m", "tag")
    r.git("tag", "light", "HEAD~2")
    r.git("pack-refs", "--all")
    return r


def test_objects_like_git(spark, big):
    every = big.git("cat-file", "--batch-all-objects", "--batch-check").decode().split("\n")[:-1]
    want = {x.split()[0]: (x.split()[1], int(x.split()[2])) for x in every}
    rows = load(spark, big.path, "objects", objectsPerTask=17, verifyCrc=True).collect()
    assert {r.oid: (r.type, r.size) for r in rows} == want and len(rows) == len(want)
    repo = gitfiles.Repository(big.path)
    assert len(repo.packs) == 2 and repo.loose_ids()
    for r in rows[::13]:
        assert bytes(r.data) == big.git("cat-file", r.type, r.oid)
    assert all(repo.verify_trailer(p) for p in range(2))
    index = load(spark, big.path, "object_index")
    assert index.count() == sum(repo.index(p).count for p in range(2))


def test_point_reads(spark, big):
    oid = big.git("rev-parse", "HEAD").decode().strip()
    got = load(spark, big.path, "objects").where(f"oid = '{oid}'").collect()
    assert [r.oid for r in got] == [oid]
    assert load(spark, big.path, "objects").where("oid IN ('" + oid + "', '" + "0" * 40 + "')").count() == 1


def test_commits_and_refs(spark, big):
    s = HistoryScanner(spark, big.path)
    want = set(big.git("rev-list", "--all").decode().split())
    got = s.commits().collect()
    assert {r.oid for r in got} == want and sorted(r.visit_rank for r in got) == list(range(len(want)))
    tips = {x.split()[0] for x in big.git("rev-parse", "main", "side", "light", "v1^{commit}").decode().split("\n")[:-1]}
    assert tips == {r[0] for r in s.tips().collect()}
    place = {r.oid: r.topo_rank for r in s.ordered_commits().collect()}
    assert all(place[p] < place[r.oid] for r in got for p in r.parents)


def test_tree_diff_like_git(spark, big):
    s = HistoryScanner(spark, big.path)
    want = []
    for c in big.git("rev-list", "--all").decode().split():
        first = big.git("rev-list", "--parents", "-n1", c).decode().split()[1:2]
        out = big.git("diff-tree", "-r", "--no-renames", "--no-commit-id", *(["--root", c] if not first else [first[0], c])).decode()
        for line in out.split("\n")[:-1]:
            meta, path = line.split("\t")
            om, nm, old, new, status = meta[1:].split()
            z = "0" * 40
            sides = [(old, None, om), (None, new, nm)] if status == "T" else [(old if old != z else None, new if new != z else None, nm if new != z else om)]
            want += [(c, path, a, b, int(m, 8)) for a, b, m in sides]
    assert sorted(map(repr, (tuple(r) for r in s.changes().collect()))) == sorted(map(repr, want))


def test_blobs_once_and_the_same_each_time(spark, big):
    s = HistoryScanner(spark, big.path)
    rows = {r.blob: (r.commit, r.path) for r in s.blobs().collect()}
    every = {x.split()[0] for x in big.git("rev-list", "--all", "--objects").decode().split("\n") if x}
    kinds = dict(x.split()[:2] for x in big.git("cat-file", "--batch-check", data="\n".join(sorted(every)).encode()).decode().split("\n")[:-1])
    changed = {r.new_oid for r in s.changes().collect() if r.new_oid}
    assert set(rows) == {o for o, k in kinds.items() if k == "blob"} & changed
    assert rows == {r.blob: (r.commit, r.path) for r in HistoryScanner(spark, big.path).blobs().repartition(7).collect()}
    data = s.blob_data().collect()
    assert len(data) == len(rows)
    assert s.totals().first().bytes == sum(len(r.data) for r in data)
    report = s.report(before=1000.0)
    assert report["blobs"] == len(rows) and report["bytes_per_second"] > 0 and report["speed_up"] > 1
    some = spark.createDataFrame([(b,) for b in list(rows)[:5]], "blob string")
    assert s.blobs(some).count() == len(rows) - 5


def test_scan_and_errors(spark, big):
    s = HistoryScanner(spark, big.path)
    got = s.scan(lambda data, meta: [meta["path"]] if b"now a file" in data else []).collect()
    assert [(r.path, r.finding) for r in got] == [("pkg", "pkg")]
    hunks = HistoryScanner(spark, big.path, mode="hunks")
    assert hunks.scan(lambda data, meta: ["x"] if meta["blob"] is None else []).count() == hunks.hunks().count()
    with pytest.raises(ValueError):
        s.scan(None)
    with pytest.raises(ValueError, match=r"unknown\(7\)"):
        HistoryScanner(spark, big.path, mode=7).payloads()

    def broken(data, meta):
        raise RuntimeError("scanner broke")

    with pytest.raises(Exception, match="scanner broke"):
        s.scan(broken).count()


def test_merges_can_be_skipped(spark, big):
    merges = set(big.git("rev-list", "--all", "--merges").decode().split())
    with_, without = (HistoryScanner(spark, big.path, skip_merges=x).hunks().select("commit").distinct().collect() for x in (False, True))
    assert merges and merges & {r[0] for r in with_} and not merges & {r[0] for r in without}


def test_metadata(spark, big):
    oid = big.git("rev-parse", "HEAD").decode().strip()
    at, ct = map(int, big.git("show", "-s", "--format=%at %ct", oid).split())
    s = HistoryScanner(spark, big.path)
    name, email, when = s.metadata(oid)
    assert (name, email, int(when.timestamp())) == ("A U Thor", "a@b.c", at)
    assert int(s.metadata(oid, prefer_committer=True)[2].timestamp()) == ct
    with pytest.raises(KeyError):
        s.metadata("0" * 40)


def test_rename_and_copy(spark, tmp_path):
    r = Repo(tmp_path / "r")
    r.commit({"old.txt": "one\ntwo\n", "source.txt": "s\n"})
    second = r.commit({"old.txt": None, "new.txt": "one\ntwo\n"})
    third = r.commit({"source.txt": None, "copy-a.txt": "s\n", "copy-b.txt": "s\n"})
    rows = HistoryScanner(spark, r.path).hunks().collect()
    assert not [x for x in rows if x.commit == second]
    assert [x.path for x in rows if x.commit == third] == ["copy-b.txt"]


def test_empty_and_shallow(spark, tmp_path):
    r = Repo(tmp_path / "e")
    s = HistoryScanner(spark, r.path)
    assert s.commits().count() == 0 and s.blobs().count() == 0 and s.hunks().count() == 0
    full = Repo(tmp_path / "f")
    for k in range(4):
        full.commit({"f.txt": f"{k}\n"})
    shallow = str(tmp_path / "s")
    subprocess.run(["git", "clone", "-q", "--depth", "2", f"file://{full.path}", shallow], check=True, capture_output=True)
    s = HistoryScanner(spark, shallow)
    assert s.commits().count() == 2
    assert {x.old_oid is None for x in s.changes().collect()} == {True, False}
    with pytest.raises(FileNotFoundError):
        gitfiles.Repository(str(tmp_path))


def test_delta_limits_and_damage(big, tmp_path):
    base = b"abcdefgh" * 10
    make = lambda *ops: bytes([len(base)]) + bytes([20]) + b"".join(ops)
    assert gitfiles.apply_delta(base, make(b"\x91\x08\x0c", b"\x08" + b"z" * 8)) == base[8:20] + b"z" * 8
    for bad in (make(b"\0"), make(b"\x91\x08"), make(b"\x91\x50\x0c"), make(b"\x08zz"), b"\x01\x05\x01a", make(b"\x01z")):
        with pytest.raises(gitfiles.CorruptError):
            gitfiles.apply_delta(base, bad)
    with pytest.raises(gitfiles.CorruptError):
        gitfiles.apply_delta(base, make(b"\x91\x08\x14"), most=5)
    z = zlib.compress(b"hello")
    assert gitfiles.inflate(memoryview(z), 5) == b"hello"
    assert gitfiles.inflate(memoryview(z[:-4] + b"\0\0\0\0"), 5) == b"hello"  # the sum isn't looked at
    for raw, n in ((z, 4), (z, 6), (b"\x00" + z[1:], 5), (z[:5], 5)):
        with pytest.raises(gitfiles.CorruptError):
            gitfiles.inflate(memoryview(raw), n)
    copy = str(tmp_path / "copy")
    shutil.copytree(big.path, copy)
    pack = gitfiles.Repository(copy).packs[0]
    os.chmod(pack[:-5] + ".idx", 0o644)
    with open(pack[:-5] + ".idx", "r+b") as f:
        f.seek(1200)
        f.write(b"\xff\xff")
    with pytest.raises(gitfiles.CorruptError):
        gitfiles.Repository(copy).index(0)
    with pytest.raises(gitfiles.CorruptError, match="deep"):
        repo = gitfiles.Repository(big.path, max_depth=0)
        for i in range(repo.index(0).count):
            repo.packed(0, int(repo.index(0).offsets[i]))


def test_summaries_that_git_writes(spark, big, tmp_path):
    copy = Repo(tmp_path / "copy")
    shutil.rmtree(copy.path)
    shutil.copytree(big.path, copy.path)
    first = copy.git("rev-parse", "HEAD").decode().strip()
    copy.git("checkout", "-q", "-f", "main")
    for k in range(3):
        copy.git("checkout", "-q", "-f", "-b", f"o{k}", "main~4")
        copy.commit({f"o{k}": f"{k}\n"})
    copy.git("checkout", "-q", "-f", "main")
    assert load(spark, copy.path, "commit_graph").count() == 0 and load(spark, copy.path, "multi_pack_index").count() == 0

    def same():
        got = {r.oid: (r.tree_oid, r.parents, r.committer_ts) for r in load(spark, copy.path, "commit_graph").collect()}
        want = {r.oid: (r.tree_oid, r.parents, r.committer_ts) for r in load(spark, copy.path, "commits").collect()}
        assert first in got and got == want

    copy.git("commit-graph", "write", "--reachable")
    same()
    os.remove(os.path.join(copy.path, ".git/objects/info/commit-graph"))
    copy.git("commit-graph", "write", "--reachable", "--split=no-merge")
    tree = copy.git("rev-parse", "HEAD^{tree}").decode().strip()
    octopus = copy.git("commit-tree", tree, "-p", "main", "-p", "o0", "-p", "o1", "-p", "o2", "-m", "octopus").decode().strip()
    copy.git("update-ref", "refs/heads/main", octopus)
    copy.git("commit-graph", "write", "--reachable", "--split=no-merge")
    assert len(gitgraph.graph_files(os.path.join(copy.path, ".git/objects"))) == 2
    same()
    copy.git("multi-pack-index", "write")
    repo = gitfiles.Repository(copy.path)
    for r in load(spark, copy.path, "multi_pack_index").collect():
        p = [os.path.basename(x)[:-5] for x in repo.packs].index(r.pack[:-4])
        assert int(repo.index(p).offsets[repo.index(p).find(r.oid)]) == r.offset
    at = os.path.join(copy.path, ".git/objects/pack/multi-pack-index")
    os.chmod(at, 0o644)
    with open(at, "r+b") as f:
        f.seek(40)
        f.write(b"zz")
    with pytest.raises(gitfiles.CorruptError):
        gitgraph.multi_pack_index(repo.objects)


@pytest.mark.parametrize("table,allowed", [("commits", {"commit", "head", "delta"}), ("tree_entries", {"tree", "delta"}), ("tags", {"tag"}), ("object_index", set())])
def test_only_what_a_table_needs_is_inflated(big, table, allowed):
    reader = gitsource.GitReader({"path": big.path, "table": table, "objectsPerTask": "11"})
    gitfiles._open.clear()
    rows = [x for p in reader.partitions() for x in reader.read(p)]
    inflated = reader.repo().inflated
    assert rows and set(inflated) <= allowed and (table not in ("commits", "tree_entries") or inflated)


def test_long_commits_are_read_by_their_heads(tmp_path):
    r = Repo(tmp_path / "r")
    oid = r.commit({"a": "1"}, "long message " * 5000)
    r.git("repack", "-adq", "--depth=0")
    repo = gitfiles.Repository(r.path)
    p, i = repo.find(oid)
    head = repo.commit_head(p, int(repo.index(p).offsets[i]))
    assert len(head) == 4097 and headers.parse_commit(headers.commit_header(head))[1] == [] and set(repo.inflated) == {"head"}


def test_a_type_filter_reaches_the_reader(spark, big):
    assert [r.type for r in load(spark, big.path, "objects").where("type = 'tag'").collect()] == ["tag"]
    reader = gitsource.GitReader({"path": big.path, "table": "objects"})
    assert list(reader.pushFilters([EqualTo(("type",), "tag")])) == []
    gitfiles._open.clear()
    assert [x[1] for p in reader.partitions() for x in reader.read(p)] == ["tag"] and set(reader.repo().inflated) <= {"tag"}


def test_one_pack_is_scanned_by_many_tasks_and_seen_contents_by_none(spark, big, tmp_path):
    one = str(tmp_path / "one")
    shutil.copytree(big.path, one)
    subprocess.run(["git", "repack", "-adfq"], cwd=one, check=True, capture_output=True)
    s = HistoryScanner(spark, one)
    assert len(gitfiles.Repository(one).packs) == 1
    found = s.blob_data()
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    want = {r.blob: bytes(r.data) for r in found.collect()}
    assert all(hashlib.sha1(b"blob %d\0" % len(d) + d).hexdigest() == b for b, d in want.items())
    # damage a content: a scan that has seen it doesn't notice
    repo = gitfiles.Repository(one)
    blob = next(b for b in want if repo.header(0, int(repo.index(0).offsets[repo.find(b)[1]]))[0] == 3)
    at = repo.header(0, int(repo.index(0).offsets[repo.find(blob)[1]]))[3]
    os.chmod(repo.packs[0], 0o644)
    with open(repo.packs[0], "r+b") as f:
        f.seek(at)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="zlib header"):
        s.blob_data().collect()
    rest = {r.blob for r in s.blob_data(spark.createDataFrame([(blob,)], "blob string")).collect()} if not any(repo.record(0, int(repo.index(0).offsets[i]))[1] == repo.index(0).offsets[repo.find(blob)[1]] for i in range(repo.index(0).count) if i != repo.find(blob)[1]) else set(want) - {blob}
    assert rest == set(want) - {blob}


def test_names_are_bytes(spark, tmp_path):
    r = Repo(tmp_path / "r")
    names = [os.fsdecode(b"a\xfe"), os.fsdecode(b"a\xff"), "a\u00e9", "d/" + os.fsdecode(b"\xff\xfe")]
    r.commit({n: "1\n" for n in names})
    second = r.commit({n: f"2 {k}\n" for k, n in enumerate(names)})
    s = HistoryScanner(spark, r.path)
    got = sorted(x.path for x in s.changes().collect() if x.commit == second)
    assert got == sorted(['"\\x61\\xFE"', '"\\x61\\xFF"', "a\u00e9", '"\\x64\\x2F\\xFF\\xFE"'])
    hunks = sorted((x.path, x.lines[0]) for x in s.hunks().collect() if x.commit == second)
    assert [h[1] for h in hunks] == ["2 0", "2 1", "2 3", "2 2"]
    assert {x.path for x in s.blobs().collect() if x.commit == second} == set(got)
    assert s.scan(lambda data, meta: [meta["path"]]).count() == s.blobs().count()


def test_missing_trees_and_blobs_are_errors(spark, tmp_path):
    r = Repo(tmp_path / "r")
    r.commit({"d/f": "1\n"})
    r.commit({"d/f": "2\n"})
    blob = r.git("rev-parse", "HEAD:d/f").decode().strip()
    os.remove(os.path.join(r.path, ".git/objects", blob[:2], blob[2:]))
    with pytest.raises(Exception, match=f"missing blob {blob}"):
        HistoryScanner(spark, r.path).blob_data().collect()
    with pytest.raises(Exception, match=f"missing blob {blob}"):
        HistoryScanner(spark, r.path).hunks().collect()
    tree = r.git("rev-parse", "HEAD~1:d").decode().strip()
    os.remove(os.path.join(r.path, ".git/objects", tree[:2], tree[2:]))
    with pytest.raises(ValueError, match=f"missing tree {tree}"):
        HistoryScanner(spark, r.path).changes()


def test_empty_trees(spark, tmp_path):
    r = Repo(tmp_path / "r")
    r.commit({"f": "1\n"})
    r.commit({"f": None})
    r.commit({"g": "2\n"})
    assert len(HistoryScanner(spark, r.path).changes().collect()) == 3


def test_author_faults_are_told_apart(spark, tmp_path):
    r = Repo(tmp_path / "r")
    r.commit({"f": "1"})
    tree = r.git("rev-parse", "HEAD^{tree}").decode().strip()
    s = HistoryScanner(spark, r.path)
    for line, kind in (("author A <a", "malformed"), ("author A a>", "no-email"), ("author A <a@b>", "no-timestamp"), ("author A <a@b> soon +0000", "bad-timestamp")):
        oid = r.git("hash-object", "-t", "commit", "-w", "--stdin", "--literally", data=f"tree {tree}\n{line}\ncommitter C <c@d> 5 +0000\n\nm\n".encode()).decode().strip()
        with pytest.raises(headers.HeaderError) as e:
            s.metadata(oid)
        assert e.value.kind == kind


def test_merged_and_reverse_indexes(big, tmp_path):
    repo = gitfiles.Repository(big.path)
    at = repo.save_merged(str(tmp_path / "merged"))
    mapped = gitfiles.Repository(big.path, merged=at)
    for p in range(2):
        index = repo.index(p)
        assert (repo.order(p) == index.offsets.argsort(kind="stable")).all()
        for i in range(index.count):
            first = next((q, j) for q in range(2) if (j := repo.index(q).find(index.oid(i))) is not None)
            assert repo.find(index.oid(i)) == mapped.find(index.oid(i)) == first
    assert repo.find("0" * 40) is None and mapped.find("f" * 40) is None
    copy = str(tmp_path / "copy")
    shutil.copytree(big.path, copy)
    for damaged in gitfiles.Repository(copy).packs:
        subprocess.run(["git", "index-pack", "--rev-index", damaged], cwd=copy, capture_output=True)
        if os.path.exists(rev := damaged[:-5] + ".rev"):
            os.chmod(rev, 0o644)
            with open(rev, "r+b") as f:
                f.seek(14)
                f.write(b"\x7f\x7f")
    again = gitfiles.Repository(copy)
    assert all((again.order(p) == repo.order(p)).all() for p in range(2))


def test_trailers_and_large_deltas(spark, big, tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(big.path, copy)
    pack = gitfiles.Repository(copy).packs[0]
    os.chmod(pack, 0o644)
    with open(pack, "r+b") as f:
        f.seek(-20, 2)
        f.write(bytes(20))
    assert load(spark, copy, "objects").count()
    with pytest.raises(Exception, match="checksum"):
        load(spark, copy, "objects", verifyTrailers=True).count()
    small = gitfiles.Repository(big.path, max_delta=1)
    faults = set()
    for i in range(small.index(0).count):
        try:
            small.header(0, int(small.index(0).offsets[i]))
        except gitfiles.CorruptError as e:
            faults.add(str(e))
    assert faults == {"delta too large"}


def test_deltas_of_the_fixture():
    r = random.Random(3)
    for _ in range(300):
        base = bytes(r.choice(b"ab") for _ in range(r.randrange(300)))
        data = base[: r.randrange(len(base) + 1)] + bytes(r.choice(b"abc") for _ in range(r.randrange(300))) + base[r.randrange(len(base) + 1) :]
        assert gitfiles.apply_delta(base, fixture.delta(base, data)) == data


def test_the_fixture_is_a_repository_for_git(spark):
    rows = [(0, "a/x", 0o100644, "one\n" * 300), (0, "b", 0o120000, "a/x"), (1, "a/x", 0o100644, "one\n" * 299 + "two\n"), (1, "a.b", 0o100755, "")]
    path = fixture.repository(spark.createDataFrame(rows, "ver long, path string, mode int, text string"))
    run = lambda *a: subprocess.run(["git", "--git-dir", path, *a], capture_output=True, check=True).stdout.decode()
    run("fsck", "--full", "--strict")
    assert run("show", "main:a/x") == rows[2][3] and run("rev-list", "--count", "main").strip() == "2" and "a.b" in run("ls-tree", "-r", "--name-only", "main")


def test_the_fixture_is_written_by_tasks(spark, monkeypatch):
    """Several packs, folders at several depths, an object in two packs; the driver gets a row a version and no content."""
    from pyspark.sql.classic.dataframe import DataFrame

    got = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: pytest.fail("contents go through the driver"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(fixture, "_packs", lambda rows, cores: 3)
    rows = [(v, p, 0o100644, f"{p if k % 3 else 'same'} {v if k % 2 else ''}\n" * 50) for v in range(3) for k, p in enumerate(["top", "a.b", "a/x", "a/é", "a/b/c/d", "a0", *(f"deep/{i % 5}/{i}" for i in range(60))])]
    path = fixture.repository(spark.createDataFrame(rows, "ver long, path string, mode int, text string").repartition(5))
    assert len(max(got, key=len)) == 3
    run = lambda *a: subprocess.run(["git", "--git-dir", path, *a], capture_output=True, check=True).stdout.decode()
    run("fsck", "--full", "--strict")
    for v in range(3):
        want = {p: t for x, p, _, t in rows if x == v}
        assert set(run("ls-tree", "-rz", "--name-only", f"main~{2 - v}").split("\0")[:-1]) == set(want)
        assert all(run("show", f"main~{2 - v}:{p}") == want[p] for p in ("top", "a/é", "a/b/c/d", "deep/3/8"))
    repo = gitfiles.Repository(path)
    ids = [repo.index(p).oid(i) for p in range(len(repo.packs)) for i in range(repo.index(p).count)]
    assert len(repo.packs) > 4 and len(set(ids)) < len(ids)
    found = load(spark, path, "objects").select("oid", "type").collect()
    assert sorted(r.oid for r in found) == sorted(set(ids))


def test_tasks_keep_to_their_memory(tmp_path, monkeypatch):
    """Batches of objects go by their bytes; maps and orders are kept of so many entries only."""
    monkeypatch.setattr(gitfiles, "ENTRIES", 20)
    many = 40
    for k in range(many):
        p = fixture.Pack(str(tmp_path / "objects/pack"))
        for i in range(3):
            p.add("blob", bytes([k, i]) * 1_000_000)
        p.close()
    reader = gitsource.GitReader({"path": str(tmp_path), "table": "objects", "verifyTrailers": "true", "verifyCrc": "true"})
    rows = 0
    for part in reader.partitions():
        for b in reader.read(part):
            rows += len(b)
            assert b.nbytes < 12e6
    assert rows == 3 * many
    repo = gitsource.open_with(reader.options)
    assert 0 < len(repo._map) <= 6 and len(repo._index) <= 7 and len(repo._order) <= 7
    one = fixture.Pack(str(tmp_path / "large/objects/pack"))
    for i in range(30):
        one.add("blob", bytes([i]) * 2_000_000)
    one.close()
    reader = gitsource.GitReader({"path": str(tmp_path / "large"), "table": "objects"})
    sizes = [len(b) for part in reader.partitions() for b in reader.read(part)]
    assert sum(sizes) == 30 and max(sizes) < 8
    assert not repo._map and not repo._cache


def test_tree_parser():
    h = bytes(range(20))
    ok = b"100644 a\0" + h + b"40000 d\0" + h
    assert list(gitfiles.tree_entries(ok)) == [(b"a", 0o100644, h.hex()), (b"d", 0o40000, h.hex())]
    for bad in (b"\0" + ok, ok[:-1], b"10x644 a\0" + h, b"100644a" + h, b"100644 a" + h[1:]):
        with pytest.raises(gitfiles.CorruptError):
            list(gitfiles.tree_entries(bad))
    assert struct.calcsize(">I") == 4
