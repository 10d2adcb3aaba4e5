import pytest
from pyspark.sql import functions as F

from stratalog.functions.content import blob_oid
from stratalog.operators import dedup
from stratalog.operators.seen import SeenTable
from stratalog.streaming.incremental import first_seen, scan_new


def test_each_content_once_over_several_runs(spark, tmp_path):
    src, seen, mark = str(tmp_path / "in"), str(tmp_path / "seen"), str(tmp_path / "mark")
    got = []

    def run():
        stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(src)
        rows = stream.select(blob_oid(F.col("text")).alias("blob"), F.col("id").alias("rank"))
        scan_new(rows, seen, mark, lambda df, n: got.extend(tuple(r) for r in df.collect())).awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string").coalesce(1).write.json(src)
    run()
    assert sorted(r[1] for r in got) == [1, 2]
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, text string").coalesce(1).write.mode("append").json(src)
    run()
    assert sorted(r[1] for r in got) == [1, 2, 5]
    assert spark.read.parquet(seen).count() == 3


def test_failed_batch_is_handed_over_again(spark, tmp_path):
    src, seen, mark = str(tmp_path / "in"), str(tmp_path / "seen"), str(tmp_path / "mark")
    spark.createDataFrame([(1, "a")], "id long, text string").coalesce(1).write.json(src)
    stream = lambda: spark.readStream.schema("id long, text string").json(src).select(F.col("text").alias("blob"), F.col("id").alias("rank"))

    def broken(df, n):
        raise RuntimeError("no")

    with pytest.raises(Exception):
        scan_new(stream(), seen, mark, broken).awaitTermination()
    got = []
    scan_new(stream(), seen, mark, lambda df, n: got.extend(r.blob for r in df.collect())).awaitTermination()
    assert got == ["a"]


def test_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("x",), ("x",), ("y",)], "blob string").write.json(src)
    q = first_seen(spark.readStream.schema("blob string").json(src)).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_dedup_pieces(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z"), ("b", 1, "w")], "k string, r int, v string")
    assert sorted(tuple(r) for r in dedup.first_wins(df, "k", "r").collect()) == [("a", 1, "y"), ("b", 1, "w")]
    assert dedup.unseen(df, None, "k").count() == 4
    index = spark.createDataFrame([("o", 1, 50), ("o", 0, 90), ("p", 1, 12)], "oid string, pack_id int, offset long")
    assert {(r.oid, r.pack_id) for r in dedup.first_pack(index).collect()} == {("o", 0), ("p", 1)}
    at = dedup.locate(spark.createDataFrame([("o",), ("q",)], "blob string"), dedup.first_pack(index))
    assert {(r.blob, r.offset) for r in at.collect()} == {("o", 90), ("q", None)}
    assert [(r.offset, r.position, r.next_offset) for r in dedup.reverse_index(index).where("pack_id = 1").orderBy("offset").collect()] == [(12, 0, 50), (50, 1, None)]


def test_seen_table(spark, tmp_path):
    seen = SeenTable(spark, str(tmp_path / "seen"))
    rows = spark.createDataFrame([("a",), ("b",)], "blob string")
    assert seen.read() is None and seen.unseen(rows).count() == 2
    for _ in range(2):
        seen.add(rows.where("blob = 'a'"), 1)
    assert [r.blob for r in seen.read().collect()] == ["a"] and [r.blob for r in seen.unseen(rows).collect()] == ["b"]
    assert seen.unseen(rows, besides=1).count() == 2
