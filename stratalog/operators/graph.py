"""The commit graph. A walk needs only ids and parents, and histories are long and thin: it runs on the driver up to a checked size, over arrays (some 250 bytes a commit while they are made; for the order with parents first, which goes by places only, some 30)."""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, shared_dir

DRIVER_COMMITS = 20_000_000
#: Ranks that go back to Spark at once.
CHUNK = 2_000_000


def walk(parents: dict, tips: Iterable) -> Iterator:
    """Reachable commits in visit order: of the tips the largest first, a commit before its parents, the last parent first. Unknown ids are passed over."""
    stack, seen = sorted(set(tips)), set()
    while stack:
        at = stack.pop()
        if at in seen:
            continue
        seen.add(at)
        if at in parents:
            yield at
            stack.extend(p for p in parents[at] if p not in seen)


def numbered(own: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of commits (oid, parents) in order, where each one's parents begin, and the parents as places among the ids (-1: not there). Arrays only: ids, and 8 bytes a commit and parent."""
    t = own.select("oid", F.array_compact(F.coalesce("parents", F.array().cast(own.schema["parents"].dataType))).alias("parents")).toArrow()
    ids = t["oid"].combine_chunks().to_numpy(zero_copy_only=False)
    ids = ids.astype("S") if ids.dtype == object else ids
    lists = t["parents"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    o = np.argsort(ids, kind="stable")
    lists = lists.take(pa.array(o, pa.int64()))
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ids = ids[o]
    flat = flat.astype(ids.dtype)
    at = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
    return ids, np.append(0, np.cumsum(size)).astype(np.int64), np.where(ids[at] == flat, at, -1) if len(ids) else at


def walk_places(starts: np.ndarray, parents: np.ndarray, tips: np.ndarray) -> np.ndarray:
    """walk() by places, for ids in order."""
    seen, out = bytearray(len(starts) - 1), np.empty(len(starts) - 1, np.int64)
    stack, n = sorted(set(tips.tolist())), 0
    while stack:
        at = stack.pop()
        if seen[at]:
            continue
        seen[at] = 1
        out[n] = at
        n += 1
        stack.extend(p for p in parents[starts[at] : starts[at + 1]].tolist() if p >= 0 and not seen[p])
    return out[:n]


def ranks_of_places(starts: np.ndarray, kids: array, n: int) -> np.ndarray:
    """The rank of each of n places with parents before children, ready ones in order; those that a cycle holds back come last. kids: the children of each place, from starts on. 12 bytes a place, 4 an edge, besides the heap of those that are ready."""
    wait, each = np.zeros(n, np.int32), np.frombuffer(kids, np.int32) if kids else np.zeros(0, np.int32)
    for k in range(0, len(each), CHUNK):
        np.add.at(wait, each[k : k + CHUNK], 1)
    rank = np.full(n, -1, np.int32)
    heap, w, r, s, t = np.flatnonzero(wait == 0).tolist(), memoryview(wait), memoryview(rank), memoryview(starts), 0
    while heap:
        i = heapq.heappop(heap)
        r[i] = t
        t += 1
        for k in kids[s[i] : s[i + 1]]:
            w[k] -= 1
            if not w[k]:
                heapq.heappush(heap, k)
    rest = np.flatnonzero(rank < 0)
    rank[rest] = np.arange(t, n, dtype=np.int32)
    return rank


def parents_first(commits: Iterable[tuple]) -> list:
    """Ids of (id, parents, time) with parents before children, ready ones by (time, id); parents not given don't count, and what a cycle holds back comes last in that order."""
    rows = sorted(commits, key=lambda x: (x[2], x[0]))
    place = {i: k for k, (i, _, _) in enumerate(rows)}
    pairs = sorted((place[p], k) for k, (_, ps, _) in enumerate(rows) for p in ps if p in place)
    starts = np.searchsorted([p for p, _ in pairs], np.arange(len(rows) + 1)).astype(np.int32)
    return [rows[k][0] for k in np.argsort(ranks_of_places(starts, array("i", [k for _, k in pairs]), len(rows))).tolist()]


def visit_ranks(commits: DataFrame, tips: DataFrame, most: int = DRIVER_COMMITS) -> DataFrame:
    """(oid, visit_rank) of commits (oid, parents) reachable from tips (oid), from 0 in visit order."""
    own = commits.select("oid", "parents")
    if own.count() > most:
        raise ValueError(f"more than {most} commits: the visit order is sequential; use reachable() and another rank")
    ids, starts, parents = numbered(own)
    want = np.array([r[0] for r in tips.select("oid").collect()])
    want = (want.astype("S") if ids.dtype.kind == "S" else want.astype(ids.dtype)) if len(ids) else ids[:0]
    at = np.minimum(np.searchsorted(ids, want), max(0, len(ids) - 1))
    order = walk_places(starts, parents, at[ids[at] == want] if len(ids) else at[:0])
    return _ranked(commits, ids[order], "visit_rank")


def _ranked(commits: DataFrame, ids: np.ndarray, name: str) -> DataFrame:
    """Ids with their places, by way of Arrow and a table in the shared folder: the plan doesn't carry the rows."""
    col = pa.array(ids.astype("U") if ids.dtype.kind == "S" else ids)
    t = pa.table([col, pa.array(np.arange(len(ids)))], names=["oid", name])
    kind = dict(commits.dtypes)["oid"]
    return cut(commits.sparkSession.createDataFrame(t, f"oid {kind}, {name} long"), name)


def reachable(commits: DataFrame, tips: DataFrame, most: int = DRIVER_COMMITS) -> DataFrame:
    """(oid) of commits reachable from tips. Beyond most commits, frontiers are joined until none is new, each written to the shared folder."""
    if commits.count() <= most:
        return visit_ranks(commits, tips, most).select("oid")
    edges = commits.select("oid", F.explode_outer("parents").alias("parent"))
    known = commits.select("oid")
    front = cut(tips.select("oid").join(known, "oid", "left_semi").distinct(), "front")
    seen = front
    while not front.isEmpty():
        step = front.join(edges, "oid").select(F.col("parent").alias("oid")).where("oid IS NOT NULL").distinct()
        front = cut(step.join(known, "oid", "left_semi").join(seen, "oid", "left_anti"), "front")
        seen = cut(seen.union(front), "seen")
    return seen


def _placed(df: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """df with each row's place in the order of by, from a range-partitioned sort that is written once, and the number of rows."""
    at = cut(df.sort(*by).withColumn("__row", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__row", 33).cast("int")
    size = sorted(tuple(r) for r in at.groupBy(part.alias("part")).count().collect())
    ends = np.cumsum([n for _, n in size]).tolist()
    first = df.sparkSession.createDataFrame([(p, end - n) for (p, n), end in zip(size, ends)], "part int, first long")
    place = (F.col("first") + F.col("__row").bitwiseAND((1 << 33) - 1)).cast("int")
    return at.withColumn("part", part).join(F.broadcast(first), "part").withColumn("place", place).drop("part", "first", "__row"), ends[-1] if ends else 0


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (up, kid) in order as bytes of their ints, a row for each batch, and its least pair as a key that sorts."""
    for b in batches:
        up, kid = (c.to_numpy() for c in b.columns)
        if len(up):
            least = np.array([up[0], kid[0]], ">i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (least, up.tobytes(), kid.tobytes())], names=["least", "up", "kid"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rank = np.frombuffer(raw, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rank), dtype=np.int32)), pa.array(rank.astype(np.int64))], names=["place", "topo_rank"])


def _stored(spark: SparkSession, rank: np.ndarray) -> DataFrame:
    """(place, topo_rank) in the shared folder. Ranks leave the driver as bytes, CHUNK at once: as rows, they would fill its heap."""
    path, schema = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/topo_rank-{uuid.uuid4().hex}", "place int, topo_rank long"
    step = CHUNK // 8
    for k in range(0, max(len(rank), 1), CHUNK):
        rows = [(i, rank[i : i + step].tobytes()) for i in range(k, min(len(rank), k + CHUNK), step)]
        spark.createDataFrame(rows, "first int, ranks binary").mapInArrow(_unpacked, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def topological(commits: DataFrame, most: int = DRIVER_COMMITS) -> DataFrame:
    """(oid, topo_rank) with parents first. Commits are numbered by (time, id) and edges sorted by Spark; the driver gets places only, a partition of edges at a time (8 bytes an edge), and gives back ranks."""
    placed, n = _placed(commits.select("oid", "parents", "committer_ts"), "committer_ts", "oid")
    if n > most:
        raise ValueError(f"more than {most} commits: this order is sequential")
    known = placed.groupBy("oid").agg(F.min("place").alias("up")).withColumnRenamed("oid", "parent")
    links = placed.select(F.col("place").alias("kid"), F.explode("parents").alias("parent")).join(known, "parent").select("up", "kid").sort("up", "kid")
    count, kids = np.zeros(n + 1, np.int32), array("i")
    packed = cut(links.mapInArrow(_bytes, "least binary, up binary, kid binary"), "links")  # written, as what follows asks for one partition at a time
    for up, kid in packed.sort("least").select("up", "kid").toLocalIterator():
        np.add.at(count, np.frombuffer(up, np.int32) + 1, 1)
        kids.frombytes(kid)
    rank = ranks_of_places(np.cumsum(count, out=count), kids, n)
    return placed.join(_stored(commits.sparkSession, rank), "place").select("oid", "topo_rank")


def edges(commits: DataFrame) -> DataFrame:
    """(oid, parent_pos, parent_oid, known): known is false for parents outside."""
    e = commits.select("oid", F.posexplode("parents").alias("parent_pos", "parent_oid"))
    k = commits.select(F.col("oid").alias("parent_oid"), F.lit(True).alias("known"))
    return e.join(k, "parent_oid", "left").select("oid", "parent_pos", "parent_oid", F.coalesce("known", F.lit(False)).alias("known"))


def first_parent_trees(commits: DataFrame) -> DataFrame:
    """commits with old_tree, the tree of the first parent; NULL, which is the empty tree, without one or where it isn't there."""
    p = commits.select(F.col("oid").alias("__p"), F.col("tree_oid").alias("old_tree"))
    return commits.withColumn("__first", F.try_element_at("parents", F.lit(1))).join(p, F.col("__first") == F.col("__p"), "left").drop("__p", "__first")


def without_merges(commits: DataFrame) -> DataFrame:
    return commits.where(F.size("parents") <= 1)
