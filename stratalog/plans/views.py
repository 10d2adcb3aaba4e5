"""A synthetic repository over the tables at hand, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.content import blob_oid
from ..runtime import cut, table

OID = "sha1('blob ' || strlen(text) || chr(0) || text)"
ENTRIES_SQL = f"""v_entries AS (SELECT (doc_id // 20) % 4 AS ver,
  source || '/' || lang || '/' || row_number() OVER (PARTITION BY (doc_id // 20) % 4, source, lang ORDER BY doc_id) AS path,
  CASE WHEN doc_id % 17 = 0 THEN 40960 WHEN doc_id % 13 = 0 THEN 33261 ELSE 33188 END AS mode, {OID} AS oid, text, doc_id FROM documents)"""
COMMITS_SQL = """v_commits AS (SELECT event_id AS oid, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p1,
  CASE WHEN event_type = 'signup' THEN lag(event_id) OVER (ORDER BY ts, event_id) END AS p2, ts FROM events)"""
DIFF_SQL = (
    ENTRIES_SQL
    + """, vers AS (SELECT DISTINCT ver FROM v_entries),
  o AS (SELECT e.ver + 1 AS ver, path, mode, oid FROM v_entries e WHERE e.ver + 1 IN (SELECT ver FROM vers)),
  j AS (SELECT coalesce(o.ver, n.ver) AS commit, coalesce(o.path, n.path) AS path, o.oid AS old_oid, o.mode AS om, n.oid AS new_oid, n.mode AS nm
        FROM o FULL OUTER JOIN v_entries n ON o.ver = n.ver AND o.path = n.path),
  c AS (SELECT * FROM j WHERE NOT (old_oid IS NOT DISTINCT FROM new_oid AND om IS NOT DISTINCT FROM nm)),
  t AS (SELECT *, old_oid IS NOT NULL AND new_oid IS NOT NULL AND (om & 61440) <> (nm & 61440) AS typed FROM c),
  diff AS (SELECT commit, path, old_oid, new_oid, coalesce(nm, om) AS mode FROM t WHERE NOT typed
           UNION ALL SELECT commit, path, old_oid, NULL, om FROM t WHERE typed
           UNION ALL SELECT commit, path, NULL, new_oid, nm FROM t WHERE typed)"""
)
MOVES_SQL = (
    DIFF_SQL
    + """, cand AS (SELECT commit, path, old_oid, new_oid, mode & 61440 AS kind FROM diff
      WHERE (mode & 61440) IN (32768, 40960) AND new_oid IS NOT NULL AND old_oid IS DISTINCT FROM new_oid),
  cred AS (SELECT commit, old_oid AS oid, mode & 61440 AS kind, count(*) AS n FROM diff WHERE new_oid IS NULL AND (mode & 61440) IN (32768, 40960) GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY commit, new_oid, kind ORDER BY path) AS rn FROM cand),
  pairs AS (SELECT rk.commit, path, old_oid, new_oid, rk.kind FROM rk LEFT JOIN cred ON rk.commit = cred.commit AND rk.new_oid = cred.oid AND rk.kind = cred.kind WHERE rn > coalesce(n, 0))"""
)


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(ver, path, mode, oid, text, doc_id): four versions of a flat listing."""
    ver = F.expr("(doc_id div 20) % 4")
    n = F.row_number().over(Window.partitionBy(ver, "source", "lang").orderBy("doc_id"))
    mode = F.when(F.col("doc_id") % 17 == 0, 40960).when(F.col("doc_id") % 13 == 0, 33261).otherwise(33188)
    return table(spark, d, "documents").select(ver.alias("ver"), F.concat_ws("/", "source", "lang", n.cast("string")).alias("path"), mode.alias("mode"), blob_oid(F.col("text")).alias("oid"), "text", "doc_id")


def versions(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each version (commit) as the new listing, and the one before it as the old."""
    last = e.agg(F.max("ver")).first()[0]
    new = e.select(F.col("ver").alias("commit"), "path", "mode", "oid")
    old = e.where(F.col("ver") < (last if last is not None else 0)).select((F.col("ver") + 1).alias("commit"), "path", "mode", "oid")
    return old, new


def commits(spark: SparkSession, d: str) -> DataFrame:
    """(oid, parents, committer_ts): one's own last event, and for signups the last event of all as the second parent.

    The second lag orders the whole table; as a window that is one task, so it is a join on a rank made by a range-partitioned sort.
    """
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    p1 = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    own = e.select("event_id", p1.alias("p1"), "event_type", "ts")
    p = cut(e.select("event_id", "ts").repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()), "ranked")  # written, as two branches must see the same parts
    inner = Window.partitionBy("part").orderBy("ts", "event_id")
    p = p.withColumn("prev", F.lag("event_id").over(inner))
    ends = p.groupBy("part").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("end"))
    before = ends.withColumn("before", F.lag("end").over(Window.orderBy("part"))).select("part", "before")
    p2 = p.join(F.broadcast(before), "part").select("event_id", F.coalesce("prev", "before").alias("p2"))
    out = own.join(p2, "event_id").withColumn("p2", F.when(F.col("event_type") == "signup", F.col("p2")))
    return out.select(F.col("event_id").alias("oid"), F.array_compact(F.array("p1", "p2")).alias("parents"), "p1", "p2", F.unix_timestamp("ts").alias("committer_ts"), "ts")


def nested(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listing as trees: roots (ver, tree_oid) and tree_entries (tree_oid, name, mode, oid). Ids of trees are hashes of their rows."""
    rows = e.select("ver", F.split("path", "/").alias("p"), "mode", "oid")
    at = rows.select("ver", F.slice("p", 1, F.size("p") - 1).alias("dir"), F.element_at("p", -1).alias("name"), "mode", "oid")
    every, depth = [], at.select(F.max(F.size("dir"))).first()[0] or 0
    for k in range(depth, -1, -1):
        here = at.where(F.size("dir") == k)
        line = F.concat_ws(" ", F.col("mode").cast("string"), "name", "oid")
        ids = here.groupBy("ver", "dir").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("tree_oid"))
        every.append(here.join(ids, ["ver", "dir"]).select("tree_oid", "name", "mode", "oid"))
        if k:
            up = ids.select("ver", F.slice("dir", 1, F.size("dir") - 1).alias("dir"), F.element_at("dir", -1).alias("name"), F.lit(0o40000).alias("mode"), F.col("tree_oid").alias("oid"))
            at = at.where(F.size("dir") < k).union(up)
        else:
            roots = ids.select("ver", "tree_oid")
    out = every[0]
    for x in every[1:]:
        out = out.union(x)
    return roots, out.distinct()
