"""Git's own summaries of a repository: commit-graph files, single or chained, and multi-pack indexes. Optional; packs and commits alone are enough."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np

from .gitfiles import CorruptError

NONE, MORE, LAST = 0x70000000, 0x80000000, 0x80000000


def _chunks(raw: bytes, at: int, n: int) -> dict[bytes, bytes]:
    table = [(raw[at + 12 * k : at + 12 * k + 4], int.from_bytes(raw[at + 12 * k + 4 : at + 12 * k + 12], "big")) for k in range(n + 1)]
    if len(raw) < at + 12 * (n + 1) + 20 or any(not at < b <= len(raw) for _, b in table):
        raise CorruptError("chunk table")
    out = {}
    for (name, start), (_, end) in zip(table, table[1:]):
        if end < start:
            raise CorruptError("chunks out of order")
        out[name] = raw[start:end]
    return out


def _ids(parts: dict[bytes, bytes]) -> list[str]:
    if len(parts.get(b"OIDF", b"")) != 1024 or b"OIDL" not in parts:
        raise CorruptError("no ids")
    fan = np.frombuffer(parts[b"OIDF"], ">u4").astype(np.int64)
    n = int(fan[-1])
    if (np.diff(fan) < 0).any() or len(parts[b"OIDL"]) != 20 * n:
        raise CorruptError("fanout")
    return [parts[b"OIDL"][20 * k : 20 * k + 20].hex() for k in range(n)]


def _checked(path: str, magic: bytes) -> bytes:
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != magic or len(raw) < 32:
        raise CorruptError(f"{path}: not a {magic.decode()} file")
    if hashlib.sha1(raw[:-20]).digest() != raw[-20:]:
        raise CorruptError(f"{path}: checksum")
    return raw


def graph_files(objects: str) -> list[str]:
    """The single file, or the layers of the chain with the base first; none where git wrote neither."""
    info = os.path.join(objects, "info")
    if os.path.exists(os.path.join(info, "commit-graph")):
        return [os.path.join(info, "commit-graph")]
    chain = os.path.join(info, "commit-graphs", "commit-graph-chain")
    if not os.path.exists(chain):
        return []
    with open(chain) as f:
        return [os.path.join(info, "commit-graphs", f"graph-{x.strip()}.graph") for x in f if x.strip()]


def commit_graph(objects: str) -> list[tuple[str, str, list[str], int, int]]:
    """(oid, tree, parents, committer time, generation). Positions of parents count through all layers, base first."""
    layers, ids = [], []
    for path in graph_files(objects):
        raw = _checked(path, b"CGPH")
        if raw[4] not in (1, 2) or raw[5] != 1:
            raise CorruptError(f"{path}: version")
        parts = _chunks(raw, 8, raw[6])
        own = _ids(parts)
        if len(parts.get(b"CDAT", b"")) != 36 * len(own):
            raise CorruptError(f"{path}: commit data")
        layers.append((own, parts[b"CDAT"], np.frombuffer(parts.get(b"EDGE", b""), ">u4").astype(np.int64)))
        ids += own
    out = []

    def parent(k: int) -> str:
        if k >= len(ids):
            raise CorruptError("parent outside the graph")
        return ids[k]

    for own, data, edge in layers:
        words = np.frombuffer(data, ">u4").reshape(-1, 9).astype(np.int64)
        for k, oid in enumerate(own):
            p, q = int(words[k, 5]), int(words[k, 6])
            parents = [] if p == NONE else [parent(p)]
            if q & MORE:
                at = q & ~MORE
                while True:
                    if at >= len(edge):
                        raise CorruptError("edge list ends early")
                    parents.append(parent(int(edge[at]) & ~LAST))
                    if edge[at] & LAST:
                        break
                    at += 1
            elif q != NONE:
                parents.append(parent(q))
            high, low = int(words[k, 7]), int(words[k, 8])
            out.append((oid, data[36 * k : 36 * k + 20].hex(), parents, (high & 3) << 32 | low, high >> 2))
    return out


@dataclass
class MultiPackIndex:
    packs: list[str]
    ids: list[str]
    pack: np.ndarray
    offset: np.ndarray


def multi_pack_index(objects: str) -> MultiPackIndex | None:
    path = os.path.join(objects, "pack", "multi-pack-index")
    if not os.path.exists(path):
        return None
    raw = _checked(path, b"MIDX")
    if raw[4] not in (1, 2) or raw[5] != 1:
        raise CorruptError(f"{path}: version")
    n = int.from_bytes(raw[8:12], "big")
    parts = _chunks(raw, 12, raw[6])
    names = [x.decode() for x in parts.get(b"PNAM", b"").split(b"\0") if x][:n]
    ids = _ids(parts)
    if len(names) != n or len(parts.get(b"OOFF", b"")) != 8 * len(ids):
        raise CorruptError(f"{path}: packs or offsets")
    at = np.frombuffer(parts[b"OOFF"], ">u4").reshape(-1, 2).astype(np.int64)
    wide = np.frombuffer(parts.get(b"LOFF", b""), ">u8").astype(np.int64)
    offset = at[:, 1].copy()
    big = offset >> 31 > 0
    if b"LOFF" in parts and big.any():
        place = offset[big] & 0x7FFFFFFF
        if (place >= len(wide)).any():
            raise CorruptError(f"{path}: large offsets")
        offset[big] = wide[place]
    if len(at) and (at[:, 0] >= n).any():
        raise CorruptError(f"{path}: pack number")
    return MultiPackIndex(names, ids, at[:, 0], offset)
