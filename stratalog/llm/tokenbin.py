"""Token ids as independent zstandard frames with a trailing seek table and a checksum for each frame."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokencount import PATTERN, VOCABULARY, encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SHARD_BYTES = 8 << 20


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """Skippable frame of (compressed size, size, low half of XXH64 of the content) and a footer with their number."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Reader:
    """Reads single frames of a shard. fetch(start, size) returns bytes, so a file or an object store needs to send only those."""

    def __init__(self, fetch: Callable[[int, int], bytes], total: int):
        n, flags, magic = struct.unpack("<IBI", fetch(total - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        size = 8 + 12 * n + 9
        head = fetch(total - size, size)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE, size - 8):
            raise ValueError("damaged seek table")
        self.fetch = fetch
        t = np.frombuffer(head[8:-9], "<u4").reshape(n, 3)
        self.packed, self.size, self.sums = t[:, 0], t[:, 1], t[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.packed, dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.packed)

    def frame(self, i: int) -> bytes:
        raw = self.fetch(int(self.starts[i]), int(self.packed[i]))
        data = zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, int(self.size[i])))
        if len(data) != self.size[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return data


def reader(blob: bytes) -> Reader:
    return Reader(lambda at, n: blob[at : at + n], len(blob))


def token_shards(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, level: int = 1, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards (doc_ids, n_tokens, token_bytes, data): data is the shard's file, frame i of it the ids of doc_ids[i].

    A frame holds one document's ids as little-endian unsigned integers of token_bytes (2, or 4 for vocabularies beyond
    65,536). A shard ends at shard_bytes or with its task's rows. A NULL text or id has no place in a token file and is
    left out; an empty text is an empty frame; repeated rows each get a frame; a text of any length is one frame; other columns don't matter; an empty
    table gives no shards. No shuffle; the rows go through Spark's commit protocol, so a lost or repeated task leaves
    neither half shards nor doubles. save_shards() writes them as files.
    """
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")  # in its order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zstd = encoder(vocabulary, pattern), zstandard.ZstdCompressor(level=level, write_content_size=True)
        ids, counts, frames, parts, size = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = b"".join(parts) + seek_table(frames)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([enc.dtype.itemsize], pa.int32()), pa.array([data], pa.binary())], names=["doc_ids", "n_tokens", "token_bytes", "data"])

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                packed = zstd.compress(raw)
                ids.append(i)
                counts.append(len(raw) // enc.dtype.itemsize)
                frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                parts.append(packed)
                size += len(packed)
                if size >= shard_bytes:
                    yield shard()
                    ids, counts, frames, parts, size = [], [], [], [], 0
        if ids:
            yield shard()

    return src.mapInArrow(lean(run), "doc_ids array<long>, n_tokens array<long>, token_bytes int, data binary")


def save_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard to <folder>/<hash of its content>.bin.zst and returns (file, doc_ids, n_tokens). Names follow the content: writing again is harmless. Shards that repeat are one file; no shards, no files; NULLs don't occur in shards; data of any size up to a cell's is written whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            names = []
            for data in b.column("data").to_pylist():
                names.append(name := f"{xxhash.xxh3_128_hexdigest(data)}.bin.zst")
                own = f"{root}/{name}.{uuid.uuid4().hex}.part"  # two attempts of one task don't meet
                with store.open_output_stream(own) as f:
                    f.write(data)
                store.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column("doc_ids"), b.column("n_tokens")], names=["file", "doc_ids", "n_tokens"])

    return shards.select("doc_ids", "n_tokens", F.col("data")).mapInArrow(lean(run), "file string, doc_ids array<long>, n_tokens array<long>")
