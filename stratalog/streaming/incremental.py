"""Incremental runs: contents that come in a stream are handed over once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import first_wins
from ..operators.seen import SeenTable


def first_seen(stream: DataFrame, key: str = "blob") -> DataFrame:
    """A stream's rows whose key is new, by keyed state without end, as contents never expire."""
    return stream.dropDuplicates([key])


def scan_new(stream: DataFrame, seen_path: str, checkpoint: str, process: Callable[[DataFrame, int], None], key: str = "blob", rank: tuple[str, ...] = ("rank",), available_now: bool = True) -> StreamingQuery:
    """Hands each batch's new contents to process(df, batch_id), then adds their keys to the table at seen_path.

    A key is added only after process returns, under a folder of its batch: a batch that is repeated after a failure
    replaces that folder, doesn't see its own keys, and hands the same rows over again. process should replace by batch_id in turn.
    """

    def batch(df: DataFrame, n: int) -> None:
        seen = SeenTable(df.sparkSession, seen_path, key)
        new = seen.unseen(first_wins(df, key, *rank), besides=n).persist()
        try:
            process(new, n)
            seen.add(new, n)
        finally:
            new.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
