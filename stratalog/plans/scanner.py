"""One object for a repository's history: unique contents, added lines, commit metadata."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import HeaderError, when
from ..functions.modes import shown
from ..operators import dedup, graph, linediff, moves, treediff
from ..operators.scan import apply_scanner
from ..runtime import attach, cut
from ..sources.gitsource import load, merged_index
from ..sources.located import compared, contents

MODES = ("blob", "hunks")
PATH_LIMIT = 1 << 20


def mode_name(mode) -> str:
    return mode if mode in MODES else f"unknown({mode})"


class HistoryScanner:
    """History of the repository at git_dir, which every executor must see at that path.

    Options: skip_merges (hunks only), max_delta_depth, max_delta_object_size (0: no limit), verify_crc, verify_trailers, mode.
    offset_cache_budget bounds the decoded bases that a task keeps. pair_cache_budget and delta_arena_budget are accepted and do nothing:
    distinct pairs are compared once by a shuffle, and buffers belong to Spark.
    """

    def __init__(self, spark: SparkSession, git_dir: str, mode: str = "blob", skip_merges: bool = False, max_delta_depth: int = 100, max_delta_object_size: int = 512 << 20, verify_crc: bool = False, verify_trailers: bool = False, offset_cache_budget: int = 64 << 20, pair_cache_budget: int | None = None, delta_arena_budget: int | None = None):
        self.spark, self.dir, self.mode, self.skip_merges = attach(spark), git_dir, mode, skip_merges
        self.options = {"maxDeltaDepth": max_delta_depth, "maxDeltaObjectSize": max_delta_object_size, "verifyCrc": verify_crc, "verifyTrailers": verify_trailers, "offsetCacheBudget": offset_cache_budget}
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name, **self.options)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut(make(), name)
        return self._kept[name]

    def tips(self) -> DataFrame:
        """Distinct targets of all refs in order of their ids, annotated tags followed to commits."""
        tags = {r[0]: r[1] for r in self.table("tags").collect()}
        found = set()
        for r in self.table("refs").select("oid").distinct().collect():
            at, seen = r[0], set()
            while at in tags and at not in seen:
                seen.add(at)
                at = tags[at]
            found.add(at)
        return self.spark.createDataFrame([(o,) for o in sorted(found)], "oid string")

    def commits(self) -> DataFrame:
        """Reachable commits with visit_rank and old_tree, the tree of the first parent."""

        def make() -> DataFrame:
            every = cut(self.table("commits"), "all_commits")
            ranks = graph.visit_ranks(every, self.tips())
            return graph.first_parent_trees(every).join(ranks, "oid")

        return self._once("commits", make)

    def ordered_commits(self) -> DataFrame:
        """Reachable commits with topo_rank, parents first."""
        own = self.commits()
        return own.join(graph.topological(own), "oid")

    def tree_entries(self) -> DataFrame:
        return self._once("tree_entries", lambda: self.table("tree_entries"))

    def _changes(self) -> DataFrame:
        """Changes with paths as bytes: names that aren't UTF-8 stay apart and in their order. Paths beyond PATH_LIMIT fail."""
        long = F.octet_length("path") > PATH_LIMIT
        path = F.when(long, F.raise_error(F.concat(F.lit("path too long in "), F.col("commit")))).otherwise(F.col("path"))
        return self._once("changes", lambda: treediff.tree_diff(self.commits().select(F.col("oid").alias("commit"), "old_tree", F.col("tree_oid").alias("new_tree")), self.tree_entries()).withColumn("path", path))

    def changes(self) -> DataFrame:
        """All first-parent changes of reachable commits. A path that isn't UTF-8 is shown quoted in hexadecimal."""
        return self._changes().withColumn("path", shown(F.col("path")))

    def index(self) -> DataFrame:
        """Where each packed object lies, in the first pack that has it."""
        return self._once("index", lambda: dedup.first_pack(self.table("object_index").select("oid", "pack_id", "offset")))

    def blobs(self, seen: DataFrame | None = None) -> DataFrame:
        """(blob, commit, path): each content once, with the first commit in visit order and the first path there that brings it; without those in seen (blob)."""
        found = treediff.content_changes(self._changes()).join(self.commits().select(F.col("oid").alias("commit"), "visit_rank"), "commit")
        first = dedup.first_wins(found.select(F.col("new_oid").alias("blob"), "visit_rank", "path", "commit"), "blob", "visit_rank", "path")
        return dedup.unseen(first, seen).select("blob", "commit", shown(F.col("path")).alias("path"))

    def blob_data(self, seen: DataFrame | None = None) -> DataFrame:
        """blobs() with pack_id, offset and data, in ranges of packs read forward. Contents are located first: those in seen are never inflated, and none is shuffled. Objects that aren't blobs are left out; a content that is nowhere fails."""
        return contents(dedup.locate(self.blobs(seen), self.index()), self._reading())

    def _reading(self) -> dict:
        return {"path": self.dir, **({"merged": m} if (m := merged_index(self.spark, self.dir)) else {}), **self.options}

    def _pairs(self) -> DataFrame:
        found = self._changes()
        if self.skip_merges:
            found = found.join(graph.without_merges(self.commits()).select(F.col("oid").alias("commit")), "commit", "left_semi")
        return moves.suppress_moves(found)

    def pairs(self) -> DataFrame:
        """(commit, path, old_oid, new_oid) to compare, without exact moves."""
        return self._pairs().withColumn("path", shown(F.col("path")))

    def hunks(self) -> DataFrame:
        """Blocks of added lines by commit and path, those of one path in order. Distinct pairs are located and compared where they are read."""
        pairs = self._once("pairs", self._pairs)
        at = lambda s: self.index().select(F.col("oid").alias(f"{s}_oid"), F.col("pack_id").alias(f"{s}_pack"), F.col("offset").alias(f"{s}_offset"))
        todo = linediff.to_compare(pairs).join(at("new"), "new_oid", "left").join(at("old"), "old_oid", "left")
        found = linediff.of_pairs(pairs, compared(todo, self._reading()))
        return found.repartition("commit", "path").sortWithinPartitions("commit", "path", "start_line").withColumn("path", shown(F.col("path")))

    def payloads(self, seen: DataFrame | None = None) -> DataFrame:
        """What a scan hands over: (blob, commit, path, payload); blob is NULL for hunks."""
        if self.mode == "blob":
            return self.blob_data(seen).select("blob", "commit", "path", F.col("data").alias("payload"))
        if self.mode == "hunks":
            return self.hunks().select(F.lit(None).cast("string").alias("blob"), "commit", "path", "payload")
        raise ValueError(f"scan mode {mode_name(self.mode)}")

    def scan(self, fn: Callable[[bytes, dict], list[str]], seen: DataFrame | None = None) -> DataFrame:
        """(blob, commit, path, finding) of what fn(payload, {blob, commit, path}) returns, on the executors. An error in fn fails the query.

        The blobs of a finished run are to be added to seen by the caller, after its write is committed; see streaming.incremental.
        """
        return apply_scanner(self.payloads(seen), fn)

    def iter_hunks(self) -> Iterator:
        """Hunks one by one on the driver, a partition at a time."""
        return self.hunks().toLocalIterator()

    def metadata(self, oid: str, prefer_committer: bool = False) -> tuple[str, str, datetime]:
        """Author name, email and time of one commit, read by its id alone. KeyError if it isn't there, HeaderError with the kind of fault if its author line is no good."""
        r = self.table("commits").where(F.col("oid") == oid).select("author_name", "author_email", "author_ts", "committer_ts", "author_error").first()
        if r is None:
            raise KeyError(oid)
        if r[4] is not None:
            raise HeaderError(r[4])
        return r[0], r[1], when(r[3] if prefer_committer else r[2])

    def totals(self, seen: DataFrame | None = None) -> DataFrame:
        return dedup.totals(self.blob_data(seen), F.col("data"))

    def report(self, seen: DataFrame | None = None, before: float | None = None) -> dict[str, float]:
        """A scan's totals, the seconds that it took and what it did in one; with the seconds of another run (before), how many times as fast it was."""
        began = time.monotonic()
        r = self.totals(seen).first()
        took = time.monotonic() - began
        blobs, size = r["blobs"], r["bytes"] or 0
        return {"blobs": blobs, "bytes": size, "seconds": took, "blobs_per_second": blobs / took, "bytes_per_second": size / took} | ({} if before is None else {"speed_up": before / took})

    def close(self) -> None:
        self._kept.clear()
