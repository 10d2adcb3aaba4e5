"""Spark data source "gitrepo": option path, and option table with one of refs, object_index, objects, commits, tree_entries, tags, commit_graph, multi_pack_index.

Types are read from headers, so commits, tree_entries and tags, and objects with a filter on type, inflate nothing else.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.headers import HeaderError, commit_header, parse_author, parse_commit, tag_target
from ..runtime import shared_dir
from .gitfiles import CorruptError, Repository, opened, tree_entries
from .gitgraph import commit_graph, multi_pack_index

SCHEMAS = {
    "refs": "ref_name string, oid string, source string",
    "object_index": "oid string, pack_id int, offset long, crc long, position int",
    "objects": "oid string, type string, size long, data binary, pack_id int, offset long",
    "commits": "oid string, tree_oid string, parents array<string>, committer_ts long, author_name string, author_email string, author_ts long, author_error string",
    "tree_entries": "tree_oid string, name binary, mode int, oid string",
    "tags": "oid string, target string",
    "commit_graph": "oid string, tree_oid string, parents array<string>, committer_ts long, generation long",
    "multi_pack_index": "oid string, pack string, offset long",
}


#: Bytes of contents that leave a task at once, about.
BATCH = 8 << 20


@dataclass
class Range(InputPartition):
    """Entries first..last of a pack in order of their offsets; pack -1 is loose files, -2 given ids."""

    pack: int
    first: int
    last: int
    ids: tuple = ()


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.table = options.get("table", "objects")
        self.per_task = int(option(options, "objectsPerTask", 20000))
        self.wanted: list[str] | None = None
        self.kinds: set | None = {"commits": {"commit"}, "tree_entries": {"tree"}, "tags": {"tag"}}.get(self.table)

    def repo(self) -> Repository:
        return open_with(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on oid becomes point reads; on type, of objects, a look at headers before anything is inflated."""
        for f in filters:
            equal = f.__class__ in (EqualTo, In)
            if equal and self.table in ("objects", "commits", "tags") and f.attribute == ("oid",):
                ids = [f.value] if isinstance(f, EqualTo) else list(f.value)
                ids = [i for i in ids if i is not None]
                self.wanted = ids if self.wanted is None else [i for i in self.wanted if i in set(ids)]
            elif equal and self.table == "objects" and f.attribute == ("type",):
                kinds = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = kinds if self.kinds is None else self.kinds & kinds
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.table in ("refs", "commit_graph", "multi_pack_index"):
            return [Range(-3, 0, 0)]
        if self.wanted is not None:
            return [Range(-2, 0, 0, tuple(dict.fromkeys(self.wanted)))]
        repo, out = Repository(self.options["path"]), []  # checks the indexes' sums
        for p in range(len(repo.packs)):
            n = repo.index(p).count
            out += [Range(p, k, min(n, k + self.per_task)) for k in range(0, n, self.per_task)]
        if self.table != "object_index":
            ids = repo.loose_ids()
            out += [Range(-1, 0, 0, tuple(ids[k : k + self.per_task])) for k in range(0, len(ids), self.per_task)]
        return out or [Range(-1, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        repo = self.repo()
        if self.table == "refs":
            yield from repo.refs()
            return
        if self.table == "commit_graph":
            yield from commit_graph(repo.objects)
            return
        if self.table == "multi_pack_index":
            if m := multi_pack_index(repo.objects):
                yield from ((o, m.packs[p], int(at)) for o, p, at in zip(m.ids, m.pack.tolist(), m.offset.tolist()))
            return
        if self.table == "object_index":
            yield from self._index(repo, partition)
            return
        if self.table == "objects":
            yield from self._batches(self._objects(repo, partition))
            return
        for oid, kind, data, pack, offset in self._objects(repo, partition):
            if self.table == "commits":
                head = commit_header(data)
                tree, parents, when = parse_commit(head)
                name = email = ts = error = None
                try:
                    name, email, ts = parse_author(head)
                except HeaderError as e:
                    error = e.kind
                yield oid, tree, parents, when, name, email, ts, error
            elif self.table == "tree_entries":
                if not data:  # so that an empty tree is known to be there
                    yield oid, None, None, None
                for name, mode, child in tree_entries(data):
                    yield oid, name, mode, child
            elif self.table == "tags" and (target := tag_target(data)):
                yield oid, target

    @staticmethod
    def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of objects in batches of some BATCH bytes; Spark's own would be of 10,000 rows, whatever they hold."""
        kinds, names = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64()], ["oid", "type", "size", "data", "pack_id", "offset"]
        wait, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*wait), kinds)], names=names)

        for oid, kind, data, pack, offset in rows:
            wait.append((oid, kind, len(data), data, pack, offset))
            size += len(data) + 200
            if size > BATCH:
                yield out()
                wait, size = [], 0
        if wait:
            yield out()

    @staticmethod
    def _index(repo: Repository, part: Range) -> Iterator[pa.RecordBatch]:
        if part.pack < 0:
            return
        index, i = repo.index(part.pack), repo.order(part.pack)[part.first : part.last]
        ids = np.frombuffer(index.raw_ids, np.uint8).reshape(-1, 20)[i].tobytes().hex()
        cols = [pa.array([ids[k : k + 40] for k in range(0, len(ids), 40)], pa.string()), pa.array(np.full(len(i), part.pack, np.int32)), pa.array(index.offsets[i]), pa.array(index.crcs[i].astype(np.int64)), pa.array(i.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["oid", "pack_id", "offset", "crc", "position"])

    def _objects(self, repo: Repository, part: Range) -> Iterator[tuple]:
        """Objects of the wanted types; of a commit only its head, if that is what is wanted."""

        def packed(oid: str, pack: int, i: int) -> tuple | None:
            offset = int(repo.index(pack).offsets[i])
            kind = repo.kind_at(pack, offset) if self.kinds is not None else None
            if self.kinds is not None and kind not in self.kinds:
                return None
            if repo.verify_crc:
                repo.check_crc(pack, i)
            if self.table == "commits":
                return oid, kind, repo.commit_head(pack, offset), pack, offset
            return oid, *repo.packed(pack, offset), pack, offset

        if part.pack >= 0:
            index = repo.index(part.pack)
            for i in repo.order(part.pack)[part.first : part.last].tolist():
                oid = index.oid(i)
                # an earlier pack may have it
                if (len(repo.packs) < 2 or repo.find(oid)[0] == part.pack) and (row := packed(oid, part.pack, i)):
                    yield row
            return
        for oid in part.ids:
            at = repo.find(oid)
            if at is None:
                try:
                    kind, data = repo.loose(oid)
                except KeyError:
                    if part.pack == -1:
                        raise
                    continue
                if self.kinds is None or kind in self.kinds:
                    yield oid, kind, data, None, None
            elif part.pack == -2 and (row := packed(oid, *at)):  # packs come first, so a loose copy is passed over
                yield row


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitrepo"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "objects")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def option(o: dict, key: str, default=None):
    """Spark hands options on in lower case."""
    return o.get(key, o.get(key.lower(), default))


def open_with(o: dict) -> Repository:
    true = lambda k: str(option(o, k, "false")).lower() == "true"
    return opened(o["path"], int(option(o, "maxDeltaDepth", 100)), int(option(o, "maxDeltaObjectSize", 512 << 20)), true("verifyCrc"), int(option(o, "offsetCacheBudget", 64 << 20)), False, true("verifyTrailers"), o.get("merged"))


def merged_index(spark: SparkSession, path: str) -> str | None:
    """The merged index of a repository with several packs, written once to the shared folder for tasks to map; None with one pack, or where that folder is no mounted one (tasks then make their own)."""
    repo = Repository(path)
    root = shared_dir(spark)
    if len(repo.packs) < 2 or "://" in root and not root.startswith("file://"):
        return None
    key = hashlib.sha1(repr([(p, os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in repo.packs]).encode()).hexdigest()
    at = f"{root.removeprefix('file://')}/merged-{key}"
    os.makedirs(os.path.dirname(at), exist_ok=True)
    return at if os.path.exists(f"{at}-entry.npy") else repo.save_merged(at)


def load(spark: SparkSession, path: str, table: str, **options):
    """One table of a repository that every executor sees at path. Names in trees are strings that hold the tree's bytes, valid UTF-8 or not: they compare as bytes; see functions.modes.shown."""
    register(spark)
    if table not in ("refs", "commit_graph", "multi_pack_index") and (merged := merged_index(spark, path)):
        options = {"merged": merged, **options}
    df = spark.read.format("gitrepo").options(path=path, table=table, **{k: str(v) for k, v in options.items()}).load()
    return df.withColumn("name", df["name"].cast("string")) if table == "tree_entries" else df


__all__ = ["CorruptError", "GitSource", "load", "register"]
