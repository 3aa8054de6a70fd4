"""Incremental runs, streams, sources, sinks and joins that face hot keys."""

import json
import os
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from quirewright import cluster
from quirewright.sources import readers, sinks
from quirewright.streaming import incremental as I
from quirewright.streaming import page_states

MANIFEST = "document_id string, source string, source_type string, canonical_source string, captured_at timestamp, content_sha256 string, config_sha256 string, status string, ingested_at timestamp"
STATE = "source_key string, status string, document_id string, content_sha256 string, config_sha256 string, attempts int, captured_at timestamp"


def manifest(spark, rows):
    return spark.createDataFrame([(f"{s}{c}", s, "url", s, D(2024, 1, c), h, g, "x", D(2024, 2, i)) for s, c, h, g, i in rows], MANIFEST)


def state(spark, rows):
    return spark.createDataFrame([(s, st, None, h, g, a, D(2024, 1, c)) for s, st, c, h, g, a in rows], STATE)


def test_pending(spark):
    m = manifest(spark, [("a", 1, "SHA256:H", "g", 1), ("b", 1, "h", "g", 1), ("b", 2, "h2", "g", 2), ("c", 1, "h", None, 1), ("d", 1, "h", "g", 1), ("d", 1, "h", "g", 1), ("e", 1, "h", "g", 1), ("f", 1, "h", "g", 1)])
    s = state(spark, [("a", "accepted", 1, "h", "sha256:G", 1), ("b", "review", 1, "h", "g", 1), ("d", "failed", 1, None, None, 3), ("e", "accepted", 1, "h", "g", 1), ("e", "rejected", 1, "old", "g", 2)])
    got = {r.canonical_source for r in I.pending(m, s).collect()}
    assert got == {"b", "d", "e", "f"}
    assert I.pending(m.limit(0), s.limit(0)).count() == 0


def test_pending_all_null_and_extra_columns(spark):
    m = spark.createDataFrame([tuple([None] * 9)] * 2, MANIFEST).withColumn("content", F.lit("x")).withColumn("finished", F.lit(True))
    assert I.pending(m, state(spark, [])).count() == 0


def test_log_survives_a_broken_run(spark, tmp_path):
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(i, f"{i:03d}") for i in range(5)], "v int, seq string")

    def boom():
        raise RuntimeError("the run breaks off")

    copy = lambda new, upto: new.drop("seq")
    with pytest.raises(RuntimeError):
        I.run_incremental(log, rows, F.col("seq"), copy, boom)
    assert log.commits() == [] and log.committed() is None
    first = I.run_incremental(log, rows, F.col("seq"), copy)
    assert (first.number, first.low, first.high, first.rows) == (1, None, "004", 5)
    assert I.run_incremental(log, rows, F.col("seq"), copy) is None
    more = rows.unionByName(spark.createDataFrame([(9, "007"), (8, "005")], "v int, seq string"))
    second = I.run_incremental(log, more, F.col("seq"), copy)
    assert (second.low, second.high, second.rows) == ("004", "007", 2)
    assert sorted(r.v for r in log.committed().collect()) == [0, 1, 2, 3, 4, 8, 9]
    with pytest.raises(Exception):  # a number can be taken once only
        log.commit(I.Commit(2, None, None, "elsewhere", 0))


def test_late_rows_are_taken_once(spark, tmp_path):
    """Rows without a sequence value, at the watermark and below it that come after a run are new, once; rows delivered again are not."""
    log = I.CommitLog(spark, f"file://{tmp_path}/late")
    make = lambda *rows: spark.createDataFrame(list(rows), "v int, seq string")
    copy = lambda new, upto: new
    a = make((1, "2024-01-01"), (2, "2024-01-03"), (3, None))
    assert I.run_incremental(log, a, F.col("seq"), copy).rows == 3
    assert I.run_incremental(log, a.unionByName(make((1, "2024-01-01"), (3, None))), F.col("seq"), copy) is None
    b = a.unionByName(make((4, None), (5, "2024-01-03"), (6, "2024-01-02"), (7, "2024-01-04"), (8, "2024-02-01")))
    assert I.run_incremental(log, b, F.col("seq"), copy, until="2024-01-05").rows == 4
    assert I.run_incremental(log, b, F.col("seq"), copy).rows == 1
    assert I.run_incremental(log, b, F.col("seq"), copy) is None
    assert sorted(r.v for r in log.committed().collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    none = I.CommitLog(spark, f"file://{tmp_path}/none")
    assert I.run_incremental(none, a.where("seq is null"), F.col("seq"), copy).rows == 1
    assert I.run_incremental(none, a, F.col("seq"), copy).rows == 2


def test_captures_run(spark, tmp_path):
    log = I.CommitLog(spark, f"file://{tmp_path}/c")
    m = manifest(spark, [("a", 1, "h", "g", 1), ("b", 1, "h", "g", 2)])
    done = state(spark, [("b", "accepted", 1, "h", "g", 1)])
    waiting = lambda: {(r.canonical_source, r.document_id) for r in I.captures_waiting(log).collect()}
    assert I.captures_waiting(log) is None
    I.captures_to_process(log, m, done)
    assert waiting() == {("a", "a1")}
    later = m.unionByName(manifest(spark, [("b", 3, "h3", "g", 5)]))
    failed = done.unionByName(state(spark, [("a", "failed", 1, None, None, 1)]))
    I.captures_to_process(log, later, failed)  # the changed source, and the one that failed
    assert waiting() == {("a", "a1"), ("b", "b3")}
    finished = done.unionByName(state(spark, [("a", "running", 1, None, None, 1), ("a", "accepted", 2, "h", "g", 2)]))
    assert I.captures_to_process(log, later, finished) is not None  # no new row, but a source left unfinished
    assert waiting() == {("b", "b3")}
    assert I.captures_to_process(log, later, done) is None


def test_page_states_stream(spark, tmp_path):
    src, ck = f"{tmp_path}/in", f"{tmp_path}/ck"
    schema = "document_id string, page_number int, state string, ts timestamp"
    rows = [("d", 1, "extracting", D(2024, 1, 1)), ("d", 1, "rendered", D(2024, 1, 2)), ("d", 2, "failed", D(2024, 1, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    got: dict = {}

    def run():
        stream = page_states.page_states(spark.readStream.schema(schema).parquet(src))
        keep = lambda df, _: got.update({r.page_number: (r.state, r.updates) for r in df.collect()})
        stream.writeStream.outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    run()
    assert got == {1: ("rendered", 2), 2: ("failed", 1)}
    got.clear()
    spark.createDataFrame([("d", 1, "verified", D(2024, 1, 3)), ("d", 2, "rendered", D(2024, 1, 3))], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert got == {1: ("verified", 3), 2: ("failed", 2)}


def test_new_files_once(spark, tmp_path):
    src, ck, out = (f"{tmp_path}/{k}" for k in ("in", "ck", "out"))
    for n in (1, 2):
        spark.range(n).write.mode("append").parquet(src)
        page_states.new_files(spark, src, "id long", ck, out)
        page_states.new_files(spark, src, "id long", ck, out)
    assert spark.read.parquet(out).count() == 3


def test_watermarked_views(spark, tmp_path):
    schema = "canonical_source string, captured_at timestamp, ingested_at timestamp, source_type string"
    spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 1, 1), "url")] * 2 + [("a", D(2024, 1, 2), D(2024, 1, 2), "url")], schema).write.parquet(f"{tmp_path}/in")
    s = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for name, df, mode, want in (("u", page_states.distinct_captures(s()), "append", 2), ("w", page_states.captures_by_day(s()), "update", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == want


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\nhttps://a\n /x/b.pdf \n")
    assert [r.source for r in readers.batch_input(spark, str(tmp_path / "l.txt")).collect()] == ["https://a", "/x/b.pdf"]
    (tmp_path / "m.jsonl").write_text('# c\n{"source": "https://a", "id": "i", "tags": ["t"], "other": 3}\n')
    r = readers.jsonl_manifest(spark, str(tmp_path / "m.jsonl")).first()
    assert (r.source, r.id, r.tags, r.profile, json.loads(r.extra)) == ("https://a", "i", ["t"], None, {"other": "3"})
    (tmp_path / "bad.jsonl").write_text('{"id": "i"}\n')
    with pytest.raises(Exception, match="without a source"):
        readers.jsonl_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    d = tmp_path / "d"
    (d / "sub").mkdir(parents=True)
    for n in ("a.pdf", "b.html", "c.png", "sub/e.htm"):
        (d / n).write_bytes(b"<p>x</p>" if n.endswith("m") or n.endswith("l") else b"\x89PNG\r\n\x1a\n")
    name = lambda df: sorted(os.path.basename(r.source) for r in df.collect())
    assert name(readers.directory(spark, str(d))) == ["a.pdf", "b.html"]
    assert name(readers.directory(spark, str(d), recursive=True, exclude="a*")) == ["b.html", "e.htm"]
    assert name(readers.directory(spark, str(d), include="*.pdf")) == ["a.pdf"]
    assert readers.html_pages(spark, str(d), recursive=True).count() == 2
    assert readers.images(spark, str(d / "c.png")).first().format == "png"
    ident = readers.with_identity(spark.createDataFrame([("HTTPS://A/",), ("x.bin",)], "source string")).orderBy("source").collect()
    assert ident[0].canonical_source == "https://a" and ident[1].error


def test_bytes_that_are_not_utf8_are_replaced(spark, tmp_path):
    (tmp_path / "bad.html").write_bytes(b"<p>caf\xe9 \xff ok</p>")
    r = readers.html_pages(spark, str(tmp_path)).first()
    assert r.html == "<p>caf\ufffd \ufffd ok</p>"


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), p, ["k"])
    sinks.write_table(spark.createDataFrame([("b", 3)], "k string, v int"), p, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(p).collect()) == [("a", 1), ("b", 3)]
    sinks.write_ledger(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == '{"a":"x","b":1}'
    sinks.write_markdown(spark.createDataFrame([("d1", "# T\nx")], "document_id string, markdown string"), str(tmp_path / "md"))
    assert [r.value for r in spark.read.text(str(tmp_path / "md" / "document_id=d1")).collect()] == ["# T", "x"]


def test_lookup_join_with_a_hot_key(spark, monkeypatch):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    small = cluster.lookup_join(left, right, ["k"]).agg(F.count("*"), F.sum("v")).first()
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cluster, "fits_broadcast", lambda t: False)
    assert cluster.lookup_join(left, right, ["k"]).agg(F.count("*"), F.sum("v")).first() == small
    assert cluster.lookup_join(left, right.select("k"), ["k"], "left_anti").count() == 3000 - small[0]
    assert cluster.lookup_join(left, right, ["k"], "left").count() == 3000


def test_a_table_that_compresses_well_is_not_broadcast(spark):
    ids = spark.range(900_000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    big = cluster.materialize(ids.select("k", F.floor(F.col("v") / 1000).alias("v")))
    assert cluster.scan_bytes(big) < 8 << 20 and not cluster.fits_broadcast(big)
    left = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = cluster.lookup_join(left, big, ["k"], how, materialized=True)
        joined.count()
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    wide = cluster.materialize(spark.range(2000).select("id", F.repeat(F.lit("x"), 50_000).alias("t"), F.array(F.lit("y"), F.lit(None)).alias("a"), F.struct("id").alias("s")))
    assert cluster.scan_bytes(wide) < 8 << 20 and not cluster.fits_broadcast(wide)
    assert cluster.fits_broadcast(cluster.materialize(spark.range(0).toDF("id")))


def test_ranks_without_whole_groups(spark):
    df = cluster.materialize(spark.range(1000).select("id", (F.col("id") % 3).alias("k")))
    r = cluster.dense_rank_in_groups(df, "k", ["id"], "rank", rows_each=37)
    per = r.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(x.n == x.d == x.m + 1 for x in per)


def test_hash_sample(spark):
    df = spark.range(5000)
    a = sorted(r.id for r in cluster.hash_sample(df, ["id"], 300).collect())
    assert len(a) == 300 and a == sorted(r.id for r in cluster.hash_sample(df.repartition(7), ["id"], 300).collect())
    assert cluster.hash_sample(df, ["id"], 9000).count() == 5000


def test_release(spark):
    df = cluster.materialize(spark.range(3))
    assert df.count() == 3 and cluster.scan_bytes(df) > 0
    cluster.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(*df.inputFiles()).count()


def test_shared_dir_is_demanded_on_a_cluster(spark, monkeypatch):
    class Fake:
        conf = {"spark.checkpoint.dir": None}

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.shared_dir(Fake)
    Fake.conf = {"spark.checkpoint.dir": "hdfs://a/b/"}
    assert cluster.shared_dir(Fake) == "hdfs://a/b"


def test_entry_imports_without_the_text_operators():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"page_flags", "p7_found"} <= names and set(e.oracle_sql()) <= names
