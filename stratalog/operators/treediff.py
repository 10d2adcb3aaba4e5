"""What changed between two versions of a tree, and which changes bring content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modes import is_blob_like, is_tree, join_path, kind
from ..runtime import cut


def _events(both: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep, old_oid, old_mode, new_oid, new_mode) to changes: a change of type is a deletion and an addition; else the new side's mode counts."""
    same = F.col("old_oid").eqNullSafe(F.col("new_oid")) & F.col("old_mode").eqNullSafe(F.col("new_mode"))
    typed = F.col("old_oid").isNotNull() & F.col("new_oid").isNotNull() & (kind(F.col("old_mode")) != kind(F.col("new_mode")))
    none = F.lit(None).cast("string")
    one = F.struct(F.col("old_oid"), F.col("new_oid"), F.coalesce("new_mode", "old_mode").alias("mode"))
    two = F.array(F.struct(F.col("old_oid"), none.alias("new_oid"), F.col("old_mode").alias("mode")), F.struct(none.alias("old_oid"), F.col("new_oid"), F.col("new_mode").alias("mode")))
    out = both.where(~same).select(*keep, F.explode(F.when(typed, two).otherwise(F.array(one))).alias("e"))
    return out.select(*keep, "e.old_oid", "e.new_oid", "e.mode")


def snapshot_diff(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Changes (by..., path, old_oid, new_oid, mode) between flat listings (by..., path, mode, oid): a full outer join on the path. NULL is the absent side."""
    keys = [*by, "path"]
    a = old.select(*keys, F.col("oid").alias("old_oid"), F.col("mode").alias("old_mode"))
    b = new.select(*keys, F.col("oid").alias("new_oid"), F.col("mode").alias("new_mode"))
    return _events(a.join(b, keys, "full_outer"), *keys)


def order(changes: DataFrame) -> list[Column]:
    """Bytes of the whole path, and at one path deletions first: the order in which a recursive walk meets them."""
    return [F.col("path"), F.col("new_oid").isNotNull()]


#: The id of a tree without entries; it needn't be stored anywhere.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def tree_diff(roots: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """Changes (commit, path, old_oid, new_oid, mode) for roots (commit, old_tree, new_tree), level by level.

    A level compares each distinct pair of trees once, whichever commits share it, and equal subtrees end there. So the
    work follows what changed, not commits times files; rounds are as many as directories are deep, each written once.
    tree_entries: (tree_oid, name, mode, oid); a row without a name says that the tree is there and empty. A NULL tree is empty.
    A tree that is compared but has no rows fails. Submodules are reported, not entered.
    """
    spark = roots.sparkSession
    every = cut(tree_entries.select("tree_oid", "name", "mode", "oid").distinct(), "entries")
    known, entries = every.select("tree_oid").distinct(), every.where("name IS NOT NULL")
    rows = cut(roots.where(~F.col("old_tree").eqNullSafe(F.col("new_tree"))).select("commit", F.lit("").alias("prefix"), "old_tree", "new_tree"), "level")
    found: list[DataFrame] = []
    while not rows.isEmpty():
        pairs = rows.select("old_tree", "new_tree").distinct()
        used = pairs.select(F.explode(F.array("old_tree", "new_tree")).alias("tree_oid")).where(F.col("tree_oid").isNotNull() & (F.col("tree_oid") != EMPTY_TREE))
        if lost := used.join(known, "tree_oid", "left_anti").first():
            raise ValueError(f"missing tree {lost[0]}")

        def side(s: str) -> DataFrame:
            e = entries.select(F.col("tree_oid").alias(f"{s}_tree"), "name", is_tree(F.col("mode")).alias("dir"), F.col("oid").alias(f"{s}_oid"), F.col("mode").alias(f"{s}_mode"))
            return pairs.join(e, f"{s}_tree")

        a, b = side("old").alias("a"), side("new").alias("b")
        on = F.col("a.old_tree").eqNullSafe(F.col("b.old_tree")) & F.col("a.new_tree").eqNullSafe(F.col("b.new_tree")) & (F.col("a.name") == F.col("b.name")) & (F.col("a.dir") == F.col("b.dir"))
        met = a.join(b, on, "full_outer").select(
            F.when(F.col("a.name").isNotNull(), F.col("a.old_tree")).otherwise(F.col("b.old_tree")).alias("old_tree"),
            F.when(F.col("a.name").isNotNull(), F.col("a.new_tree")).otherwise(F.col("b.new_tree")).alias("new_tree"),
            F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.dir", "b.dir").alias("dir"), "old_oid", "old_mode", "new_oid", "new_mode",
        ).where(~(F.col("old_oid").eqNullSafe(F.col("new_oid")) & F.col("old_mode").eqNullSafe(F.col("new_mode"))))
        r = rows.select("commit", "prefix", F.col("old_tree").alias("o"), F.col("new_tree").alias("n"))
        at = r.join(met, F.col("o").eqNullSafe(F.col("old_tree")) & F.col("n").eqNullSafe(F.col("new_tree"))).withColumn("path", join_path(F.col("prefix"), F.col("name")))
        at = cut(at.select("commit", "path", "dir", "old_oid", "old_mode", "new_oid", "new_mode"), "level")
        found.append(_events(at.where("NOT dir"), "commit", "path"))
        rows = at.where("dir").where(~F.col("old_oid").eqNullSafe(F.col("new_oid"))).select("commit", F.col("path").alias("prefix"), F.col("old_oid").alias("old_tree"), F.col("new_oid").alias("new_tree"))
    if not found:
        return spark.createDataFrame([], "commit string, path string, old_oid string, new_oid string, mode int")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def content_changes(changes: DataFrame) -> DataFrame:
    """Files and links whose new side holds content that the old side doesn't."""
    return changes.where(is_blob_like(F.col("mode")) & F.col("new_oid").isNotNull() & ~F.col("old_oid").eqNullSafe(F.col("new_oid")))
