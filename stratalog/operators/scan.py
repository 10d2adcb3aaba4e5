"""User functions over payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def apply_scanner(payloads: DataFrame, fn: Callable[[bytes, dict], list[str] | None]) -> DataFrame:
    """(blob, commit, path, finding) of what fn(payload, {blob, commit, path}) returns, in Arrow batches on the executors. An error in fn fails the query."""
    if fn is None:
        raise ValueError("scan needs a function")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob, commit, path, data in zip(*(b.column(c).to_pylist() for c in ("blob", "commit", "path", "payload"))):
                rows += [(blob, commit, path, x) for x in fn(data, {"blob": blob, "commit": commit, "path": path}) or []]
            c = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.string()) for v in c], names=["blob", "commit", "path", "finding"])

    return payloads.select("blob", "commit", "path", "payload").mapInArrow(run, "blob string, commit string, path string, finding string")
