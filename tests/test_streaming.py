import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditlake.streaming import events as E


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


ROWS = [(f"{i}", f"audit{i % 3}", "scanner", "status" if i % 4 else "finding", i // 3 + 1, at(i * 20), f"m{i}", "{}") for i in range(60)]


@pytest.fixture
def source(spark, tmp_path):
    def write(rows, n):
        spark.createDataFrame(rows, E.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return str(tmp_path / "in")

    write(ROWS[:30], 0)
    return write(ROWS[30:], 1)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_resume_and_counts(spark, source):
    live = E.read_events(spark, source, files_per_trigger=1)
    got = drained(E.resume(live, "audit1", 5, ["status"]), "resumed").collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in ROWS if r[1] == "audit1" and r[4] > 5 and r[3] == "status")
    counts = drained(E.windowed_counts(live), "counted", "complete").groupBy("event_type").agg(F.sum("n")).collect()
    assert dict(map(tuple, counts)) == {"status": 45, "finding": 15}


def test_sequence_state_survives_batches(spark, source):
    got = drained(E.sequenced(E.read_events(spark, source, files_per_trigger=1)), "numbered").collect()
    for audit in ("audit0", "audit1", "audit2"):
        assert sorted(r["sequence"] for r in got if r["audit_id"] == audit) == list(range(1, 21))


def test_duplicates_once(spark, source, tmp_path):
    spark.createDataFrame(ROWS[:30], E.EVENT_SCHEMA).write.mode("append").parquet(source)
    assert drained(E.unique(E.read_events(spark, source), "1 hour"), "once").count() == 60


def test_upsert_sink(spark, tmp_path):
    path, table = str(tmp_path / "u"), str(tmp_path / "t")
    first = [("1", "a", "x", "status", 1, at(0), "old", "{}"), ("2", "a", "x", "status", 2, at(1), "x", "{}")]
    second = [("3", "a", "x", "status", 1, at(5), "new", "{}")]
    sink = E.upsert_sink(table)
    for rows in (first, second):
        spark.createDataFrame(rows, E.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        q = E.read_events(spark, path).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = E.version(spark, table, 1)
    assert sorted((r["sequence"], r["message"]) for r in got.collect()) == [(1, "new"), (2, "x")]
    sink(spark.createDataFrame(second, E.EVENT_SCHEMA), 1)  # a repeated batch
    assert E.version(spark, table, 1).count() == 2


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    table = tmp_path / "t"
    sink = E.upsert_sink(str(table))
    rows = [(f"{i}", f"audit{i}", "x", "status", 1, at(0), "old", "{}") for i in range(200)]
    assert E.version(spark, str(table), -1) is None and E.version(spark, str(table), 0) is None
    sink(spark.createDataFrame(rows, E.EVENT_SCHEMA), 0)
    sink(spark.createDataFrame([("n", "audit7", "x", "status", 1, at(1), "new", "{}"), ("m", None, "x", "status", 1, at(1), "null", "{}")], E.EVENT_SCHEMA), 1)
    assert 1 <= len(list(table.glob("part=*/v=1"))) <= 2 < len(list(table.glob("part=*/v=0")))
    got = E.version(spark, str(table), 1)
    assert got.count() == 201 and [r["message"] for r in got.where("audit_id = 'audit7'").collect()] == ["new"]
    assert E.version(spark, str(table), 0).count() == 200


def test_publish_and_handoff(spark, source, tmp_path):
    q = E.publish(E.read_events(spark, source), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    history = spark.read.parquet(str(tmp_path / "out"))
    assert history.count() == 60
    page, live = E.history_then_live(history.where("sequence <= 8"), E.read_events(spark, source), "audit2")
    rest = drained(live, "handed")
    assert page.count() == 8 and rest.count() == 12 and rest.agg(F.min("sequence")).first()[0] == 9


def test_batch_rules(spark):
    df = spark.createDataFrame([*ROWS, ("e", "audit0", "x", "error", 5, at(0), "", "{}")], E.EVENT_SCHEMA)
    assert E.until_end(df).where("audit_id = 'audit0'").agg(F.max("sequence")).first()[0] == 5
    assert E.bounded_buffer(df, 4).groupBy("audit_id").count().where("count <> 4").count() == 0
    assert "event: error\ndata: {" in E.sse_frames(df.where("id = 'e'")).first()["frame"]
    agents = spark.createDataFrame([("a", "scan"), ("b", "scan"), ("c", "plan")], "agent_id string, agent_type string")
    m = spark.createDataFrame([("1", "a", None, "info", "low", "hi", at(0)), ("2", "c", "b", "info", "low", "yo", at(9000))], E.MESSAGE_SCHEMA)
    assert sorted((r["id"], r["recipient"]) for r in E.broadcast_messages(m, agents).collect()) == [("1", "b"), ("1", "c"), ("2", "a"), ("2", "b")]
    assert E.broadcast_messages(m, agents, ["plan"]).count() == 1 and E.point_to_point(m, "b").count() == 1
    assert E.expired(m, "timestamp", F.lit(at(9000)), 3600).count() == 1


def test_sequence_of_audits_that_span_arrow_batches(spark, tmp_path):
    """Three audits in one partition, each over several Arrow batches and in falling order of time."""
    rows = spark.range(25_000, numPartitions=1).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("audit_id"), F.lit("status").alias("event_type"),
        F.timestamp_seconds(1_700_000_000 - F.floor(F.col("id") / 2)).alias("timestamp"),
    )
    rows.write.parquet(path := str(tmp_path / "long"))
    live = E.read_events(spark, path, "id string, audit_id string, event_type string, timestamp timestamp")
    got = {(r["audit_id"], r["sequence"]): r["id"] for r in drained(E.sequenced(live), "long_audits").collect()}
    want = {(f"a{a}", n): str(i) for a in range(3) for n, i in enumerate(sorted(range(a, 25_000, 3), key=lambda i: (-(i // 2), str(i))), 1)}
    assert got == want
