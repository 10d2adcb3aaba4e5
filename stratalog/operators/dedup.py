"""First wins, anti-joins with what was processed, and order on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, *rank: str) -> DataFrame:
    """For each key the row of least rank. Partial minima are taken before the shuffle, so hot keys don't meet in one task. Rows with a NULL key are dropped."""
    rest = [c for c in df.columns if c != key]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("__v"))
    return first.select(*(F.col(key) if c == key else F.col(f"__v.{c}").alias(c) for c in df.columns))


def unseen(candidates: DataFrame, seen: DataFrame | None, key: str = "blob") -> DataFrame:
    """Candidates whose key isn't in seen; without a seen table, all of them."""
    return candidates if seen is None else candidates.join(seen.select(key).distinct(), key, "left_anti")


def first_pack(index: DataFrame) -> DataFrame:
    """Of each id in several packs, the entry of the first pack, and there of the smallest offset."""
    return first_wins(index, "oid", "pack_id", "offset")


def reverse_index(index: DataFrame) -> DataFrame:
    """The place of each entry in its pack by offset, from 0, with where the next one begins (NULL for the last)."""
    w = Window.partitionBy("pack_id").orderBy("offset")
    return index.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("next_offset", F.lead("offset").over(w))


def locate(candidates: DataFrame, index: DataFrame, key: str = "blob") -> DataFrame:
    """Candidates with pack_id and offset; both are NULL for loose objects."""
    return candidates.join(index.select(F.col("oid").alias(key), "pack_id", "offset"), key, "left")


def disk_order(located: DataFrame, *then: str) -> DataFrame:
    """Rows of a pack in one partition, in order of their offsets, so each pack is read forward."""
    return located.repartition("pack_id").sortWithinPartitions("pack_id", "offset", *then)


def totals(df: DataFrame, data: Column, *by: str) -> DataFrame:
    """How many contents, and their bytes."""
    return df.groupBy(*by).agg(F.count("*").alias("blobs"), F.sum(F.octet_length(data)).cast("long").alias("bytes"))
