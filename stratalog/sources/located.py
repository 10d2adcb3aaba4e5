"""Contents read where they lie: rows are sent to tasks by pack and offset, and only there contents are inflated."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linediff import HUNK, MOST, hunk_batch, is_binary
from ..runtime import cut
from .gitfiles import Repository
from .gitsource import open_with

#: Bytes of contents that leave a task at once, about.
BATCH = 8 << 20


#: Contents that one task reads, about; metadata alone would be put together to far fewer tasks.
PER_TASK = 5000


def _ranges(rows: DataFrame, pack: str, offset: str) -> DataFrame:
    """Rows in ranges of packs, each read forward by one task; one pack is as many ranges as its contents ask for. Loose objects come first, by their ids."""
    rows = cut(rows, "located")
    n = rows.count()
    tasks = max(-(-n // PER_TASK), min(n, rows.sparkSession.sparkContext.defaultParallelism), 1)
    by = [F.col(pack).asc_nulls_first(), F.col(offset)]
    return rows.repartitionByRange(tasks, *by, *(c for c in ("blob", "new_oid") if c in rows.columns)).sortWithinPartitions(*by)


def _content(repo: Repository, oid: str, pack: int | None, offset: int | None) -> tuple[str, bytes | None]:
    """Type and, of blobs, the content; a loose object that isn't there is an error."""
    if pack is None:
        try:
            return repo.loose(oid)
        except KeyError:
            raise ValueError(f"missing blob {oid}") from None
    kind = repo.kind_at(pack, offset)
    if kind != "blob":
        return kind, None
    if repo.verify_crc:
        repo.check_crc(*repo.find(oid))
    return repo.packed(pack, offset)


def contents(located: DataFrame, options: dict) -> DataFrame:
    """located (blob, commit, path, pack_id, offset) with data; rows whose object is no blob are left out."""
    cols = ["blob", "commit", "path", "pack_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo = open_with(options)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[*cols, "data"])

        for b in batches:
            rows, size = [], 0
            for row in zip(*(b.column(c).to_pylist() for c in cols)):
                kind, data = _content(repo, row[0], row[3], row[4])
                if kind != "blob":
                    continue
                rows.append((*row, data))
                size += len(data)
                if size > BATCH:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return _ranges(located.select(*cols), "pack_id", "offset").mapInArrow(run, "blob string, commit string, path string, pack_id int, offset long, data binary")


def compared(todo: DataFrame, options: dict, most: int = MOST) -> DataFrame:
    """Blocks of added lines of todo (old_oid, new_oid, old_pack, old_offset, new_pack, new_offset); no content is shuffled, and the old side is inflated only where the new one is text."""
    cols = ["old_oid", "new_oid", "old_pack", "old_offset", "new_pack", "new_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo = open_with(options)

        def blob(oid: str, pack: int | None, offset: int | None) -> bytes:
            kind, data = _content(repo, oid, pack, offset)
            if kind != "blob":
                raise ValueError(f"missing blob {oid}: it is a {kind}")
            return data

        def sides(b: pa.RecordBatch) -> Iterator[tuple]:
            for o, n, op, oo, np_, no in zip(*(b.column(c).to_pylist() for c in cols)):
                new = blob(n, np_, no)
                alone = o is None or len(new) <= most and is_binary(new)
                yield o, n, None if alone else blob(o, op, oo), new

        for b in batches:
            for k in range(0, len(b), 256):
                yield hunk_batch(sides(b.slice(k, 256)), most)

    return _ranges(todo.select(*cols), "new_pack", "new_offset").mapInArrow(run, f"old_oid string, new_oid string, {HUNK}")
