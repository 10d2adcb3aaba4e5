"""A repository made from rows, for queries that read one: packs with their indexes, deltas included, and a loose ref. Tasks write the packs; no git executable is used."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, shared_dir

#: Rows whose objects go to one pack, about, and bytes beyond which a task begins another.
PER_PACK, PACK_BYTES = 20_000, 1 << 30

CODE = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}


def _size(code: int, n: int) -> bytes:
    out, n = [code << 4 | n & 15], n >> 4
    while n:
        out[-1] |= 128
        out.append(n & 127)
        n >>= 7
    return bytes(out)


def _number(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out[-1] |= 128
        out.append(n & 127)
    return bytes(out)


def _back(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(128 | n & 127)
    return bytes(out[::-1])


def _copy(start: int, n: int) -> bytes:
    op, rest = 128, b""
    for k in range(4):
        if b := start >> 8 * k & 255:
            op |= 1 << k
            rest += bytes([b])
    for k in range(3):
        if b := n >> 8 * k & 255:
            op |= 16 << k
            rest += bytes([b])
    return bytes([op]) + rest


def delta(base: bytes, data: bytes) -> bytes:
    """data by what it begins and ends with in common with base."""
    n = min(len(base), len(data))
    a, b = np.frombuffer(base, np.uint8), np.frombuffer(data, np.uint8)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = min(int(differ[0]) if len(differ) else n, n - head)
    middle = data[head : len(data) - tail]
    copies = lambda start, size: b"".join(_copy(start + k, min(60000, size - k)) for k in range(0, size, 60000))
    literal = b"".join(bytes([len(middle[k : k + 127])]) + middle[k : k + 127] for k in range(0, len(middle), 127))
    return _number(len(base)) + _number(len(data)) + copies(0, head) + literal + copies(len(base) - tail, tail)


class Pack:
    """Written to its folder as objects come; only ids, places and checksums stay in memory."""

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.at, self.crc, self.size = folder, {}, {}, 12
        self.temp = f"{folder}/tmp_pack_{uuid.uuid4().hex}"
        self.body = open(self.temp, "w+b")
        self.body.write(b"PACK\0\0\0\2\0\0\0\0")

    def add(self, kind: str, data: bytes, base: tuple[str, bytes] | None = None) -> str:
        """The object's id; base: (id, content) of one of the pack to make a delta from."""
        oid = hashlib.sha1(b"%s %d\0" % (kind.encode(), len(data)) + data).hexdigest()
        if oid not in self.at:
            if base and base[0] in self.at:
                d = delta(base[1], data)
                rec = _size(6, len(d)) + _back(self.size - self.at[base[0]]) + zlib.compress(d, 1)
            else:
                rec = _size(CODE[kind], len(data)) + zlib.compress(data, 1)
            self.at[oid], self.crc[oid] = self.size, zlib.crc32(rec)
            self.size += self.body.write(rec)
        return oid

    def close(self) -> None:
        """Counts the objects, adds the trailer and writes the index."""
        self.body.seek(8)
        self.body.write(struct.pack(">I", len(self.at)))
        self.body.seek(0)
        total = hashlib.file_digest(self.body, "sha1").digest()
        self.body.seek(0, os.SEEK_END)
        self.body.write(total)
        self.body.close()
        ids = sorted(self.at)
        first = np.array([int(i[:2], 16) for i in ids], np.int64)
        fan = np.cumsum(np.bincount(first, minlength=256)).astype(">u4").tobytes()
        index = b"\xfftOc\0\0\0\2" + fan + bytes.fromhex("".join(ids)) + b"".join(struct.pack(">I", self.crc[i]) for i in ids) + b"".join(struct.pack(">I", self.at[i]) for i in ids) + total
        name = f"{self.folder}/pack-{total.hex()}"
        with open(f"{self.temp}_idx", "wb") as f:
            f.write(index + hashlib.sha1(index).digest())
        os.rename(f"{self.temp}_idx", f"{name}.idx")  # a task that is run again writes the same files
        os.rename(self.temp, f"{name}.pack")


def _into_packs(folder: str, names: list[str], fill: Callable) -> Callable:
    """For mapInArrow: fill() makes a function of (pack, batch) that returns columns; at the end it gets None, for what it still holds. Packs are closed as they get large, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, add = None, fill()
        for b in batches:
            if pack and pack.size > PACK_BYTES:
                pack.close()
                pack = None
            pack = pack or Pack(folder)
            yield pa.RecordBatch.from_arrays(add(pack, b), names=names)
        if pack:
            yield pa.RecordBatch.from_arrays(add(pack, None), names=names)
            pack.close()

    return run


def _blobs() -> Callable:
    """Rows (ver, path, mode, text), sorted by path and version, to (ver, path, mode, oid): each content is a delta of the one before on its path, if that is in the pack."""
    base: tuple = None, None

    def add(pack: Pack, b: pa.RecordBatch | None) -> list[pa.Array]:
        nonlocal base
        if b is None:
            return [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int32(), pa.string())]
        oids = []
        for p, data in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            oids.append(pack.add("blob", data, base[1] if base[0] == p else None))
            base = p, (oids[-1], data)
        return [*b.columns[:3], pa.array(oids, pa.string())]

    return add


def _trees() -> Callable:
    """Rows (ver, dir, name, mode, oid), sorted by version, folder and name as Git does, to (ver, dir, oid) of the folders' trees."""
    at, parts = None, []

    def add(pack: Pack, b: pa.RecordBatch | None) -> list[pa.Array]:
        nonlocal at
        out = []

        def settle() -> None:
            if parts:
                out.append((*at, pack.add("tree", b"".join(parts))))
                parts.clear()

        for ver, d, name, mode, oid in zip(*(c.to_pylist() for c in b.columns)) if b is not None else ():
            if (ver, d) != at:
                settle()
                at = ver, d
            parts.append(b"%o %s\0" % (mode, name.encode()) + bytes.fromhex(oid))
        if b is None:
            settle()
        return [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return add


def _packs(rows: int, cores: int) -> int:
    return max(1, -(-rows // PER_PACK), min(cores, rows // 1000))


def repository(entries: DataFrame) -> str:
    """A repository with one commit for each version of entries (ver, path, mode, text), each the child of the one before; its committer time is the version.

    Tasks write the packs: contents by path, a path's versions in order, so that each is a delta of the one before, and then trees,
    the deepest folders first. An object that several tasks have is in several packs. The driver gets the id of each version's
    tree only, as commits name their parents and so are made one after the other.
    """
    spark = entries.sparkSession
    root, cores = shared_dir(spark), spark.sparkContext.defaultParallelism
    if "://" in root and not root.startswith("file://"):
        raise ValueError("the repository is read as files: spark.checkpoint.dir must be a mounted folder (file://)")
    path = f"{root.removeprefix('file://')}/repository-{uuid.uuid4().hex}"
    folder = f"{path}/objects/pack"
    os.makedirs(folder)
    rows = entries.select(F.col("ver").cast("long").alias("ver"), "path", F.col("mode").cast("int").alias("mode"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartition(_packs(entries.count(), cores), "path").sortWithinPartitions("path", "ver")
    files = cut(rows.mapInArrow(_into_packs(folder, ["ver", "path", "mode", "oid"], _blobs), "ver long, path string, mode int, oid string"), "files")
    name, depth = F.substring_index("path", "/", -1), F.size(F.split("path", "/")) - 1
    above = lambda of: F.expr(f"substring({of}, 1, greatest(length({of}) - length(name) - 1, 0))")
    trees = None
    for k in range(files.agg(F.max(depth)).first()[0] or 0, -1, -1):
        here = files.where(depth == k).withColumn("name", name).select("ver", above("path").alias("dir"), "name", "mode", "oid")
        if trees is not None:
            here = here.union(trees.withColumn("name", F.substring_index("dir", "/", -1)).select("ver", above("dir").alias("dir"), "name", F.lit(0o40000).alias("mode"), "oid"))
        order = F.when(F.col("mode") == 0o40000, F.concat("name", F.lit("/"))).otherwise(F.col("name"))
        here = here.repartition(_packs(here.count() // 4, cores), "ver", "dir").sortWithinPartitions("ver", "dir", order)
        trees = cut(here.mapInArrow(_into_packs(folder, ["ver", "dir", "oid"], _trees), "ver long, dir string, oid string"), "trees")
    pack, parent = Pack(folder), None
    for ver, _, tree in trees.orderBy("ver").collect():
        head = f"tree {tree}\n" + (f"parent {parent}\n" if parent else "")
        parent = pack.add("commit", f"{head}author A U Thor <a@example.org> {ver} +0000\ncommitter C <c@example.org> {ver} +0000\n\nversion {ver}\n".encode())
    pack.close()
    os.makedirs(f"{path}/refs/heads")
    if parent:
        with open(f"{path}/refs/heads/main", "w") as f:
            f.write(parent + "\n")
    with open(f"{path}/HEAD", "w") as f:
        f.write("ref: refs/heads/main\n")
    return path
