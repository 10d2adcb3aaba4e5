"""Exact moves: a deleted content pays for one appearance of the same content in the same commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.modes import is_blob_like, kind
from .treediff import content_changes


def suppress_moves(changes: DataFrame) -> DataFrame:
    """Content changes (commit, path, old_oid, new_oid, kind) that no deletion of the commit pays for.

    A deletion of a file or link gives one credit for its id and type. Additions and modifications alike use credits up
    in path order. Overwriting in place gives none. Commits without deletions pass through without a sort of their
    candidates meeting any credit.
    """
    deleted = changes.where(F.col("new_oid").isNull() & is_blob_like(F.col("mode")))
    credit = deleted.groupBy("commit", F.col("old_oid").alias("new_oid"), kind(F.col("mode")).alias("kind")).agg(F.count("*").alias("credits"))
    found = content_changes(changes).select("commit", "path", "old_oid", "new_oid", kind(F.col("mode")).alias("kind"))
    paid = found.join(credit, ["commit", "new_oid", "kind"], "left")
    turn = F.row_number().over(Window.partitionBy("commit", "new_oid", "kind").orderBy("path"))
    return paid.withColumn("__turn", turn).where(F.col("__turn") > F.coalesce("credits", F.lit(0))).select("commit", "path", "old_oid", "new_oid", "kind")
