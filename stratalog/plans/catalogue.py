"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import headers, lines, modes
from ..functions.content import blob_oid, from_hex, guess_type, is_absent, is_binary, shard_key, to_hex
from ..operators import dedup, graph, linediff, moves, treediff
from ..operators.scan import apply_scanner
from ..runtime import shared_dir, table
from ..streaming.incremental import scan_new
from .fixture import repository
from .scanner import HistoryScanner
from .views import COMMITS_SQL, DIFF_SQL, ENTRIES_SQL, MOVES_SQL, OID, commits, entries, nested, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("blob_oid", f"SELECT doc_id, {OID} AS oid FROM documents")
def q_blob_oid(spark, d):
    return _docs(spark, d).select("doc_id", blob_oid(F.col("text")).alias("oid"))


@query("oid_hex", f"""SELECT doc_id, upper({OID}) AS raw, {OID} AS back, ('0x' || substr({OID}, 1, 16))::UBIGINT::VARCHAR AS shard, n_chars % 5 < 2 AS absent FROM documents""")
def q_oid_hex(spark, d):
    oid = blob_oid(F.col("text"))
    side = F.when(F.col("n_chars") % 5 > 1, oid).when(F.col("n_chars") % 5 == 1, "0" * 40)  # both ways in which a side is missing
    return _docs(spark, d).select("doc_id", F.hex(from_hex(oid)).alias("raw"), to_hex(from_hex(oid)).alias("back"), shard_key(oid).cast("string").alias("shard"), is_absent(side).alias("absent"))


@query("unique_blobs", f"SELECT oid, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY doc_id) AS rn FROM (SELECT doc_id, source, {OID} AS oid FROM documents)) WHERE rn = 1")
def q_unique_blobs(spark, d):
    return dedup.first_wins(_docs(spark, d).select(blob_oid(F.col("text")).alias("oid"), "doc_id", "source"), "oid", "doc_id")


@query(
    "scan_totals",
    f"""WITH b AS (SELECT doc_id, source, strlen(text) AS bytes, {OID} AS oid FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY doc_id) AS rn FROM b)
    SELECT source, count(*) AS blobs, sum(bytes)::BIGINT AS bytes FROM f WHERE rn = 1 GROUP BY source""",
)
def q_scan_totals(spark, d):
    b = _docs(spark, d).select(blob_oid(F.col("text")).alias("oid"), "doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    return dedup.first_wins(b, "oid", "doc_id").groupBy("source").agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"))


@query("scan_rates", f"SELECT source, sum(strlen(text))::DOUBLE / count(*) AS bytes_each, count(DISTINCT text)::DOUBLE / count(*) AS new_share FROM documents GROUP BY source")
def q_scan_rates(spark, d):
    b = _docs(spark, d).select("source", blob_oid(F.col("text")).alias("oid"), F.octet_length("text").alias("n"))
    one = b.groupBy("source", "oid").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return one.groupBy("source").agg((F.sum("n").cast("double") / F.sum("k")).alias("bytes_each"), (F.count("*").cast("double") / F.sum("k")).alias("new_share"))


@query("unseen_blobs", f"WITH b AS (SELECT doc_id, {OID} AS blob FROM documents) SELECT blob, min(doc_id) AS doc_id FROM b WHERE NOT EXISTS (SELECT 1 FROM b s JOIN labels l ON s.doc_id = l.doc_id WHERE s.blob = b.blob) GROUP BY blob")
def q_unseen_blobs(spark, d):
    b = _docs(spark, d).select(blob_oid(F.col("text")).alias("blob"), "doc_id")
    seen = b.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("blob")
    return dedup.unseen(dedup.first_wins(b, "blob", "doc_id"), seen)


_EDGES = ["", "\n", "a", "a\n", "a\nb", "\n\n", "a\r\nb\r\n", "a\n\nb\n\n"]
_EDGE_SQL = ", ".join("({}, {})".format(-1 - k, " || ".join(["''", *("chr(10)" if c == "\n" else "chr(13)" if c == "\r" else f"'{c}'" for c in t)])) for k, t in enumerate(_EDGES))


@query(
    "tokenize_lines",
    f"""WITH e(doc_id, text) AS (VALUES {_EDGE_SQL}), a AS (SELECT doc_id::BIGINT AS doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM e),
    s AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN right(text, 1) = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM a)
    SELECT doc_id, len(l)::INTEGER AS n_lines, l[1] AS first_line, l[-1] AS last_line FROM s""",
)
def q_tokenize_lines(spark, d):
    edge = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(_EDGES)], "doc_id long, text string")
    a = _docs(spark, d).select("doc_id", "text").union(edge).withColumn("l", lines.split_lines(F.col("text")))
    return a.select("doc_id", F.size("l").alias("n_lines"), F.try_element_at("l", F.lit(1)).alias("first_line"), F.try_element_at("l", F.lit(-1)).alias("last_line"))


@query("mode_filter", f"WITH {ENTRIES_SQL} SELECT ver, path, mode & 61440 AS kind, (mode & 61440) IN (32768, 40960) AS blob_like, (mode & 61440) = 16384 AS tree FROM v_entries")
def q_mode_filter(spark, d):
    m = F.col("mode")
    return entries(spark, d).select("ver", "path", modes.kind(m).alias("kind"), modes.is_blob_like(m).alias("blob_like"), modes.is_tree(m).alias("tree"))


@query("type_names", "SELECT c AS code, CASE c WHEN 0 THEN 'bad' WHEN 1 THEN 'commit' WHEN 2 THEN 'tree' WHEN 3 THEN 'blob' WHEN 4 THEN 'tag' WHEN 6 THEN 'ofs-delta' WHEN 7 THEN 'ref-delta' ELSE 'unknown' END AS name FROM range(9) t(c)")
def q_type_names(spark, d):
    return spark.range(9).select(F.col("id").alias("code"), modes.type_name(F.col("id")).alias("name"))


@query("join_path", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source || '/' || lang END AS path FROM documents")
def q_join_path(spark, d):
    return _docs(spark, d).select("doc_id", modes.slashes(modes.join_path(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")), F.col("lang"))).alias("path"))


def _diff(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = entries(spark, d)
    return e, treediff.snapshot_diff(*versions(e), "commit")


@query("tree_diff", f"WITH {DIFF_SQL} SELECT commit, path, old_oid, new_oid, mode FROM diff")
def q_tree_diff(spark, d):
    return _diff(spark, d)[1]


@query("tree_diff_nested", f"WITH {DIFF_SQL} SELECT commit::VARCHAR AS commit, path, old_oid, new_oid, mode FROM diff")
def q_tree_diff_nested(spark, d):
    roots, trees = nested(entries(spark, d))
    old = roots.select((F.col("ver") + 1).alias("ver"), F.col("tree_oid").alias("old_tree"))
    pairs = roots.select("ver", F.col("tree_oid").alias("new_tree")).join(old, "ver", "left").select(F.col("ver").cast("string").alias("commit"), "old_tree", "new_tree")
    return treediff.tree_diff(pairs, trees)


_NAMES = ["pkg/a.go", "pkg.go", "pkg-old", "pkg0", "pkg/b/c", "Pkg", "é", "a b"]


@query(
    "tree_order",
    f"WITH {DIFF_SQL}, l(path) AS (VALUES {', '.join(f"('{n}')" for n in _NAMES)}), a AS (SELECT commit, path, new_oid IS NOT NULL AS added FROM diff UNION ALL SELECT -1, path, true FROM l) SELECT commit, path, added, row_number() OVER (PARTITION BY commit ORDER BY path, added) AS place FROM a",
)
def q_tree_order(spark, d):
    lit = spark.createDataFrame([(-1, n, "x") for n in _NAMES], "commit long, path string, new_oid string")
    a = _diff(spark, d)[1].select("commit", "path", "new_oid").union(lit)
    return a.select("commit", "path", F.col("new_oid").isNotNull().alias("added"), F.row_number().over(Window.partitionBy("commit").orderBy(*treediff.order(a))).cast("long").alias("place"))


@query("content_changes", f"WITH {DIFF_SQL} SELECT commit, path, new_oid FROM diff WHERE (mode & 61440) IN (32768, 40960) AND new_oid IS NOT NULL AND old_oid IS DISTINCT FROM new_oid")
def q_content_changes(spark, d):
    return treediff.content_changes(_diff(spark, d)[1]).select("commit", "path", "new_oid")


@query("move_suppression", f"WITH {MOVES_SQL} SELECT commit, path, old_oid, new_oid, kind FROM pairs")
def q_move_suppression(spark, d):
    return moves.suppress_moves(_diff(spark, d)[1])


@query("pair_dedup", f"WITH {MOVES_SQL} SELECT old_oid, new_oid, count(*) AS uses FROM pairs GROUP BY ALL")
def q_pair_dedup(spark, d):
    return moves.suppress_moves(_diff(spark, d)[1]).groupBy("old_oid", "new_oid").agg(F.count("*").alias("uses"))


_LINES = "CASE WHEN {0} = '' THEN [] WHEN right({0}, 1) = chr(10) THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END"
_PAIR_SQL = (
    MOVES_SQL
    + f""", txt AS (SELECT oid, any_value(text) AS text FROM v_entries GROUP BY oid),
  mp AS (SELECT DISTINCT old_oid, new_oid FROM pairs WHERE old_oid IS NOT NULL),
  pl AS (SELECT old_oid, new_oid, {_LINES.format("a.text")} AS ol, {_LINES.format("b.text")} AS nl FROM mp JOIN txt a ON a.oid = old_oid JOIN txt b ON b.oid = new_oid)"""
)
_ISLANDS_SQL = """, isl AS (SELECT *, k - row_number() OVER (PARTITION BY old_oid, new_oid ORDER BY k) AS g FROM added)
  SELECT old_oid, new_oid, min(k)::INTEGER AS start_line, max(k)::INTEGER AS end_line, string_agg(line, chr(10) ORDER BY k) AS payload FROM isl GROUP BY old_oid, new_oid, g"""
_SET_SQL = f"""WITH {_PAIR_SQL}, ex AS (SELECT old_oid, new_oid, ol, unnest(range(1, len(nl) + 1)) AS k, unnest(nl) AS line FROM pl),
  added AS (SELECT old_oid, new_oid, k, line FROM ex WHERE NOT list_contains(ol, line)){_ISLANDS_SQL}"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, diff = _diff(spark, d)
    return moves.suppress_moves(diff), e.groupBy("oid").agg(F.any_value("text").alias("text"))


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs, txt = _pairs(spark, d)
    two = pairs.where("old_oid IS NOT NULL").select("old_oid", "new_oid").distinct()
    two = two.join(txt.select(F.col("oid").alias("old_oid"), lines.split_lines(F.col("text")).alias("old_lines")), "old_oid")
    return two.join(txt.select(F.col("oid").alias("new_oid"), lines.split_lines(F.col("text")).alias("new_lines")), "new_oid")


def _flat(blocks: DataFrame) -> DataFrame:
    return blocks.select("old_oid", "new_oid", "start_line", "end_line", lines.payload(F.col("lines")).alias("payload"))


@query("line_set_hunks", _SET_SQL)
def q_line_set(spark, d):
    return _flat(linediff.line_set(_line_pairs(spark, d), "old_oid", "new_oid"))


@query("hashed_hunks", _SET_SQL)
def q_hashed(spark, d):
    return _flat(linediff.line_set(_line_pairs(spark, d), "old_oid", "new_oid", hashed=True))


_GREEDY_SQL = f"""WITH RECURSIVE {_PAIR_SQL}, st AS (
    SELECT old_oid, new_oid, ol, nl, 0::BIGINT AS k, 0::BIGINT AS i, false AS hit FROM pl
    UNION ALL
    SELECT old_oid, new_oid, ol, nl, k + 1, i + coalesce(list_position(ol[i + 1:], nl[k + 1]), 0), coalesce(list_position(ol[i + 1:], nl[k + 1]), 0) > 0 FROM st WHERE k < len(nl)),
  added AS (SELECT old_oid, new_oid, k, nl[k] AS line FROM st WHERE k > 0 AND NOT hit){_ISLANDS_SQL}"""


@query("greedy_hunks", _GREEDY_SQL)
def q_greedy(spark, d):
    pairs, txt = _pairs(spark, d)
    objects = txt.select("oid", F.lit("blob").alias("type"), F.encode("text", "utf-8").alias("data"))
    two = pairs.where("old_oid IS NOT NULL").select("old_oid", "new_oid").distinct().select(F.col("old_oid").alias("commit"), F.col("new_oid").alias("path"), "old_oid", "new_oid")
    return linediff.hunks(two, objects).select(F.col("commit").alias("old_oid"), F.col("path").alias("new_oid"), "start_line", "end_line", F.decode("payload", "utf-8").alias("payload"))


@query("greedy_hunks_native", _GREEDY_SQL)
def q_greedy_native(spark, d):
    p = _line_pairs(spark, d).withColumn("f", lines.added_flags(F.col("old_lines"), F.col("new_lines")))
    added = p.select("old_oid", "new_oid", F.posexplode(F.arrays_zip(F.col("f").alias("f"), F.col("new_lines").alias("line"))).alias("pos", "x")).where("x.f").select("old_oid", "new_oid", (F.col("pos") + 1).alias("line_no"), "x.line")
    return _flat(linediff.group_lines(added, "old_oid", "new_oid"))


@query(
    "added_files",
    f"""WITH {MOVES_SQL}, txt AS (SELECT oid, any_value(text) AS text FROM v_entries GROUP BY oid)
    SELECT commit::VARCHAR || ': ' || path || ':1-' || len(l) || ' (' || len(l) || ' lines)' AS label, 1 AS start_line, len(l)::INTEGER AS end_line FROM
    (SELECT commit, path, {_LINES.format("text")} AS l FROM pairs JOIN txt ON oid = new_oid WHERE old_oid IS NULL) WHERE len(l) > 0""",
)
def q_added_files(spark, d):
    pairs, txt = _pairs(spark, d)
    objects = txt.select("oid", F.lit("blob").alias("type"), F.encode("text", "utf-8").alias("data"))
    h = linediff.hunks(pairs.where("old_oid IS NULL").withColumn("commit", F.col("commit").cast("string")), objects)
    n = F.size("lines")
    return h.select(lines.label(F.col("commit"), F.col("path"), F.col("start_line"), lines.end_line(F.col("start_line"), n), n).alias("label"), "start_line", lines.end_line(F.col("start_line"), n).alias("end_line"))


_BARE = ["tree 1", "tree", "blob x", "parent 1", "author A", "tag v", "ta", "", "Author A"]


@query("type_guess", "SELECT d, CASE WHEN starts_with(d, 'tree ') THEN 'tree' WHEN starts_with(d, 'parent ') OR starts_with(d, 'author ') THEN 'commit' WHEN starts_with(d, 'tag ') THEN 'tag' ELSE 'blob' END AS kind FROM (VALUES " + ", ".join(f"('{x}')" for x in _BARE) + ") t(d)")
def q_type_guess(spark, d):
    return spark.createDataFrame([(x,) for x in _BARE], "d string").select("d", guess_type(F.col("d")).alias("kind"))


_CASES = [("deletion", "x\n", None), ("same", "x\n", "x\n"), ("large", None, "x" * 60), ("binary", "a", "b\0c"), ("added", None, "a\nb\n"), ("empty", None, ""), ("old large", "y" * 60, "z"), ("old binary", "\0", "n"), ("changed", "a\nb\nc", "a\nx\nc"), ("large binary old", "\0" + "y" * 60, "z")]
_ANSWERS = [("large", 1, False, "[File too large to diff: new=60 bytes]"), ("binary", 1, True, "b?c"), ("added", 1, False, "a|b"), ("old large", 1, False, "[File too large to diff: old=60 new=1 bytes]"), ("old binary", 1, True, "n"), ("changed", 2, False, "x"), ("large binary old", 1, False, "[File too large to diff: old=61 new=1 bytes]")]


@query("hunk_decision", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, {str(c).lower()}, '{t}')" for a, b, c, t in _ANSWERS) + ") t(name, start_line, is_binary, payload)")
def q_hunk_decision(spark, d):
    rows = spark.createDataFrame(_CASES, "name string, old string, new string")
    oid = lambda c: F.when(F.col(c).isNotNull(), blob_oid(F.col(c)))
    pairs = rows.select(F.lit("c").alias("commit"), F.col("name").alias("path"), oid("old").alias("old_oid"), oid("new").alias("new_oid"))
    texts = rows.select(F.explode(F.array("old", "new")).alias("t")).where("t IS NOT NULL").distinct()
    found = linediff.hunks(pairs, texts.select(blob_oid(F.col("t")).alias("oid"), F.lit("blob").alias("type"), F.encode("t", "utf-8").alias("data")), most=50)
    text = F.replace(F.replace(F.decode("payload", "utf-8"), F.lit("\0"), F.lit("?")), F.lit("\n"), F.lit("|"))
    return found.select(F.col("path").alias("name"), "start_line", "is_binary", text.alias("payload"))


#: Every text with a NUL byte at one of these places, where it is long enough; the last two lie beyond what is looked at.
_NULS = (0, 100, 8191, 8192, 9000)


@query("binary_test", f"SELECT doc_id, p AS place, strlen(text) >= p AND p < 8192 AS bin FROM documents, (VALUES {', '.join(f'({p})' for p in _NULS)}) t(p)")
def q_binary_test(spark, d):
    data = F.encode("text", "utf-8")
    docs = _docs(spark, d).select("doc_id", data.alias("data"), F.explode(F.array(*map(F.lit, _NULS))).alias("place"))
    nul = F.when(F.length("data") >= F.col("place"), F.concat(F.substring("data", F.lit(1), F.col("place")), F.lit(b"\0"), F.substring("data", F.col("place") + 1, F.length("data")))).otherwise(F.col("data"))
    return docs.select("doc_id", "place", is_binary(nul).alias("bin"))


@query("first_parent", f"WITH {COMMITS_SQL} SELECT c.oid, p.oid AS first_parent, CASE WHEN p.oid IS NOT NULL THEN 't' || p.oid END AS old_tree FROM v_commits c LEFT JOIN v_commits p ON p.oid = coalesce(c.p1, c.p2)")
def q_first_parent(spark, d):
    c = commits(spark, d).withColumn("tree_oid", F.concat(F.lit("t"), F.col("oid").cast("string")))
    return graph.first_parent_trees(c).select("oid", F.try_element_at("parents", F.lit(1)).alias("first_parent"), "old_tree")


@query("commit_edges", f"WITH {COMMITS_SQL} SELECT oid, (row_number() OVER (PARTITION BY oid ORDER BY k) - 1)::INTEGER AS parent_pos, p AS parent_oid, true AS known FROM (SELECT oid, 1 AS k, p1 AS p FROM v_commits UNION ALL SELECT oid, 2, p2 FROM v_commits) WHERE p IS NOT NULL")
def q_commit_edges(spark, d):
    return graph.edges(commits(spark, d))


@query("no_merges", f"WITH {COMMITS_SQL} SELECT oid FROM v_commits WHERE p1 IS NULL OR p2 IS NULL")
def q_no_merges(spark, d):
    return graph.without_merges(commits(spark, d)).select("oid")


def _tip(c: DataFrame) -> DataFrame:
    return c.agg(F.max("oid").alias("oid"))


@query("reachable", f"WITH RECURSIVE {COMMITS_SQL}, r AS (SELECT max(oid) AS oid FROM v_commits UNION SELECT p FROM r JOIN (SELECT oid, p1 AS p FROM v_commits UNION ALL SELECT oid, p2 FROM v_commits) e ON e.oid = r.oid WHERE p IS NOT NULL) SELECT oid FROM r")
def q_reachable(spark, d):
    c = commits(spark, d)
    return graph.reachable(c, _tip(c))


@query("dfs_rank")
def q_dfs_rank(spark, d):
    c = commits(spark, d)
    return graph.visit_ranks(c, _tip(c))


@query("topo_order")
def q_topo_order(spark, d):
    return graph.topological(commits(spark, d))


_INDEX_SQL = f"{ENTRIES_SQL}, idx AS (SELECT oid, ver::INTEGER AS pack_id, doc_id * 100 + 12 AS \"offset\" FROM v_entries)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("oid", F.col("ver").cast("int").alias("pack_id"), (F.col("doc_id") * 100 + 12).alias("offset"))


@query("index_first_pack", f'WITH {_INDEX_SQL} SELECT oid, pack_id, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY pack_id, "offset") AS rn FROM idx) WHERE rn = 1')
def q_index_first_pack(spark, d):
    return dedup.first_pack(_index(spark, d))


@query("reverse_index", f'WITH {_INDEX_SQL} SELECT oid, pack_id, "offset", row_number() OVER w - 1 AS position, lead("offset") OVER w AS next_offset FROM idx WINDOW w AS (PARTITION BY pack_id ORDER BY "offset")')
def q_reverse_index(spark, d):
    return dedup.reverse_index(_index(spark, d))


@query("locate_blobs", f"""WITH {_INDEX_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY pack_id, "offset") AS rn FROM idx) WHERE rn = 1),
    b AS (SELECT DISTINCT oid AS blob FROM idx UNION ALL SELECT DISTINCT sha1('loose ' || doc_id) FROM documents) SELECT b.blob, f.pack_id, f."offset" FROM b LEFT JOIN f ON f.oid = b.blob""")
def q_locate(spark, d):
    i = _index(spark, d)
    loose = _docs(spark, d).select(F.sha1(F.concat(F.lit("loose "), F.col("doc_id").cast("string"))).alias("blob")).distinct()
    return dedup.disk_order(dedup.locate(i.select(F.col("oid").alias("blob")).distinct().union(loose), dedup.first_pack(i)), "blob")


_PEOPLE = [
    ("plain", "tree abc\nauthor John Doe <john@example.com> 1234567890 +0000\ncommitter Jane <jane@example.com> 5 +0000", "John Doe", "john@example.com", 1234567890, None),
    ("spaces", "author   John   Doe   <john@example.com>   1234567890   +0000", "John   Doe", "john@example.com", 1234567890, None),
    ("fallback", "tree abc\ncommitter Bob Smith <bob@example.com> 9876543210 +0000", "Bob Smith", "bob@example.com", 9876543210, None),
    ("nested", "author Test <user> Name <test@example.com> 1 +0000", "Test <user> Name", "test@example.com", 1, None),
    ("nameless", "author  <none@example.com> 12 +0000", "", "none@example.com", 12, None),
    ("before epoch", "author A <a@b> -99 -0800", "A", "a@b", -99, None),
    ("twice", "author A <a@b> 1 +0000\nauthor B <b@b> 2 +0000", "B", "b@b", 2, None),
    ("no close", "author John <john 12 +0000", None, None, None, "malformed"),
    ("no open", "author John john> 12 +0000", None, None, None, "no-email"),
    ("no time", "author John <john@b>", None, None, None, "no-timestamp"),
    ("bad time", "author John <john@b> soon +0000", None, None, None, "bad-timestamp"),
    ("nobody", "tree abc\n\nmessage", None, None, None, "no-person"),
]


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query("author_parse", "SELECT name, author_name, email, epoch::BIGINT AS epoch, error FROM (VALUES " + ", ".join(f"({_sql(n)}, {_sql(a)}, {_sql(e)}, {_sql(t)}, {_sql(x)})" for n, _, a, e, t, x in _PEOPLE) + ") t(name, author_name, email, epoch, error)")
def q_author_parse(spark, d):
    a = spark.createDataFrame([(n, h) for n, h, *_ in _PEOPLE], "name string, header string").withColumn("a", headers.author(F.col("header")))
    return a.select("name", F.col("a.name").alias("author_name"), "a.email", "a.epoch", "a.error")


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


@query("crc_of_blob", f"""WITH t AS (SELECT {_crc_table()}::BIGINT[] AS tab), h AS (SELECT doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM documents),
    b AS (SELECT doc_id, [4294967295::BIGINT] || list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS l FROM h)
    SELECT doc_id, xor(list_reduce(l, lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM b, t""")
def q_crc(spark, d):
    return _docs(spark, d).select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"))


_SECRET = re.compile(rb'token = "[0-9a-f]+"')


@query("scan_findings", f"""SELECT oid AS blob, source AS path, unnest(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS finding FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY doc_id) AS rn FROM (SELECT doc_id, source, text, {OID} AS oid FROM documents)) WHERE rn = 1""")
def q_scan_findings(spark, d):
    first = dedup.first_wins(_docs(spark, d).select(blob_oid(F.col("text")).alias("blob"), "doc_id", F.col("source").alias("path"), "text"), "blob", "doc_id")
    payload = first.select("blob", F.lit(None).cast("string").alias("commit"), "path", F.encode("text", "utf-8").alias("payload"))
    return apply_scanner(payload, lambda data, meta: [m.decode() for m in _SECRET.findall(data)]).select("blob", "path", "finding")


@query("stream_incremental", f"SELECT {OID} AS blob FROM documents GROUP BY 1")
def q_stream(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_docs(spark, d).schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/document[s].parquet")
    rows = stream.select(blob_oid(F.col("text")).alias("blob"), F.col("doc_id").alias("rank"))
    scan_new(rows, f"{at}/seen", f"{at}/checkpoint", lambda df, n: None).awaitTermination()
    return spark.read.parquet(f"{at}/seen").select("blob")


_repositories: dict[tuple[str, str], str] = {}


def _scanner(spark: SparkSession, d: str, **how) -> HistoryScanner:
    """Over a repository with the four versions of the listing, made from the whole table, once for the session's queries."""
    key = spark.sparkContext.applicationId, d
    if key not in _repositories:
        _repositories[key] = repository(entries(spark, d).select("ver", "path", "mode", "text"))
    return HistoryScanner(spark, _repositories[key], **how)


def _versions(s: HistoryScanner) -> DataFrame:
    return s.commits().select(F.col("oid").alias("commit"), F.col("committer_ts").alias("ver"))


@query("git_objects", f"SELECT DISTINCT {OID} AS oid, 'blob' AS type, strlen(text) AS size FROM documents")
def q_git_objects(spark, d):
    return _scanner(spark, d, verify_crc=True, verify_trailers=True).table("objects").where("type = 'blob'").select("oid", "type", "size")


@query("git_commits", f"WITH {ENTRIES_SQL}, v AS (SELECT DISTINCT ver FROM v_entries) SELECT ver::BIGINT AS committer_ts, CASE WHEN ver > 0 THEN 1 ELSE 0 END AS n_parents, 'A U Thor' AS author_name, ver::BIGINT AS author_ts, (SELECT max(ver) FROM v) - ver AS visit_rank FROM v")
def q_git_commits(spark, d):
    return _scanner(spark, d).commits().select("committer_ts", F.size("parents").alias("n_parents"), "author_name", "author_ts", "visit_rank")


@query("git_changes", f"WITH {DIFF_SQL} SELECT commit::BIGINT AS ver, path, old_oid, new_oid, mode FROM diff")
def q_git_changes(spark, d):
    s = _scanner(spark, d)
    return s.changes().join(F.broadcast(_versions(s)), "commit").select("ver", "path", "old_oid", "new_oid", "mode")


@query("git_blobs", f"""WITH {DIFF_SQL}, brought AS (SELECT commit AS ver, path, new_oid AS blob FROM diff WHERE (mode & 61440) IN (32768, 40960) AND new_oid IS NOT NULL AND old_oid IS DISTINCT FROM new_oid),
    f AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY ver DESC, path) AS rn FROM brought), n AS (SELECT DISTINCT oid, strlen(text) AS bytes, sha1(text) AS content FROM v_entries)
    SELECT blob, ver::BIGINT AS ver, path, bytes, content FROM f JOIN n ON n.oid = blob WHERE rn = 1""")
def q_git_blobs(spark, d):
    s = _scanner(spark, d)
    found = s.blob_data().join(F.broadcast(_versions(s)), "commit")
    return found.select("blob", "ver", "path", F.octet_length("data").cast("long").alias("bytes"), F.sha1("data").alias("content"))


@query("git_hunks", _GREEDY_SQL.rpartition("SELECT old_oid, new_oid, min(k)")[0] + f"""SELECT p.commit::BIGINT AS ver, p.path, h.start_line, h.end_line, h.payload FROM pairs p JOIN (
      SELECT old_oid, new_oid, min(k)::INTEGER AS start_line, max(k)::INTEGER AS end_line, string_agg(line, chr(10) ORDER BY k) AS payload FROM isl GROUP BY old_oid, new_oid, g) h ON h.old_oid = p.old_oid AND h.new_oid = p.new_oid
    UNION ALL SELECT commit::BIGINT, path, 1, len(l)::INTEGER, array_to_string(l, chr(10)) FROM (SELECT commit, path, {_LINES.format("text")} AS l FROM pairs JOIN txt ON oid = new_oid WHERE old_oid IS NULL) WHERE len(l) > 0""")
def q_git_hunks(spark, d):
    s = _scanner(spark, d, mode="hunks")
    return s.hunks().join(F.broadcast(_versions(s)), "commit").select("ver", "path", "start_line", "end_line", F.decode("payload", "utf-8").alias("payload"))
