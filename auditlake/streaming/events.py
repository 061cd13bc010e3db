"""Audit events and messages as Structured Streaming: sources, sequencing, resume, upsert, retention, delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "id string, audit_id string, agent_type string, event_type string, sequence bigint, timestamp timestamp, message string, data string"
MESSAGE_SCHEMA = "id string, sender string, recipient string, type string, priority string, content string, timestamp timestamp"
# Event types that end a stream, buffered events of an audit, and the largest page of history.
END_TYPES = ("complete", "error", "cancelled")
CAPACITY, PAGE = 5000, 1000
#: Parts of the merged event table.
PARTS = 64
#: Files a trigger takes.
FILES_PER_TRIGGER = 100


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = FILES_PER_TRIGGER, format: str = "parquet") -> DataFrame:
    """Events as files arrive; backpressure is the number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events from a Kafka topic of JSON values (the connector comes with the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def publish(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to the event table, exactly once by the sink's commit log."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sequenced(events: DataFrame) -> DataFrame:
    """Give events their number inside their audit, in arrival order; the last number given is the state of a key.

    A batch's events of an audit come in several frames where an Arrow batch ends among them, so they are put
    together before they are sorted: a task holds one audit's events of one batch.
    """
    schema = "id string, audit_id string, event_type string, sequence bigint, timestamp timestamp"

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "id"])
        pdf["sequence"] = range(last + 1, last + 1 + len(pdf))
        state.update((last + len(pdf),))
        yield pdf[["id", "audit_id", "event_type", "sequence", "timestamp"]]

    rows = events.select("id", "audit_id", "event_type", "timestamp")
    return rows.groupBy("audit_id").applyInPandasWithState(number, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def resume(events: DataFrame, audit_id: str, after: int, types: list[str] | None = None) -> DataFrame:
    """A subscriber's stream: events of one audit after a sequence number; every subscriber gets all of them."""
    keep = (F.col("audit_id") == audit_id) & (F.col("sequence") > after)
    if types:
        keep &= F.col("event_type").isin(*types)
    return events.where(keep)


def unique(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (audit, sequence) once while late copies can still come."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["audit_id", "sequence"])


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling or sliding windows of event time."""
    window = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return events.withWatermark("timestamp", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def history_then_live(history: DataFrame, live: DataFrame, audit_id: str) -> tuple[DataFrame, DataFrame]:
    """(history page, live stream after it): the stream starts after the page's own last event, so no gap opens."""
    page = history.where(F.col("audit_id") == audit_id).orderBy("sequence").limit(PAGE)
    last = page.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    return page, resume(live, audit_id, last)


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: merge a batch into the event table.  Audits are dealt into PARTS parts; a batch writes
    the parts that it touches under a version of its number, so a repeated batch gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        part = F.pmod(F.xxhash64("audit_id"), F.lit(PARTS)).cast("int")
        touched = {r[0] for r in batch.select(part).distinct().collect()}
        rows = batch.withColumn("arrival", F.lit(number))
        old = version(batch.sparkSession, path, number - 1, touched)
        if old is not None:
            rows = old.unionByName(rows)
        rank = F.row_number().over(Window.partitionBy("audit_id", "sequence").orderBy(F.col("arrival").desc(), F.col("timestamp").desc(), F.col("id").desc()))
        last = rows.withColumn("_rn", rank).where("_rn = 1").drop("_rn").withColumn("part", part).withColumn("v", F.lit(number))
        last.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(path)
        batch.unpersist()

    return merge


def version(spark: SparkSession, path: str, number: int, parts: set[int] | None = None) -> DataFrame | None:
    """A version of the merged table, or some parts of it: each part's newest state up to that batch; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for found in files.globStatus(hadoop(f"{path}/part=*/v=*")) or ():
        part, v = (int(x.split("=")[1]) for x in found.getPath().toString().split("/")[-2:])
        if v <= number and (parts is None or part in parts):
            newest[part] = max(v, newest.get(part, v))
    if not newest:
        return None
    return spark.read.option("basePath", path).parquet(*(f"{path}/part={p}/v={v}" for p, v in sorted(newest.items()))).drop("part", "v")


def sse_frames(events: DataFrame) -> DataFrame:
    """Server-sent-event text of each event."""
    body = F.to_json(F.struct("id", "audit_id", "sequence", "event_type", "message"))
    return events.select("audit_id", "sequence", F.concat(F.lit("event: "), F.col("event_type"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))


def until_end(events: DataFrame) -> DataFrame:
    """Events of each audit up to its first ending event (batch)."""
    ended = events.where(F.col("event_type").isin(*END_TYPES)).groupBy("audit_id").agg(F.min("sequence").alias("end"))
    return events.join(ended, "audit_id", "left").where("end is null or sequence <= end").drop("end")


def bounded_buffer(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The oldest events of each audit up to the buffer's capacity: the newest are dropped when it is full (batch)."""
    w = Window.partitionBy("audit_id").orderBy("sequence")
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= capacity).drop("_rn")


def broadcast_messages(messages: DataFrame, agents: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Every message to all agents but its sender, optionally to some agent types."""
    to = agents.select(F.col("agent_id").alias("recipient"), F.col("agent_type").alias("_type"))
    if types:
        to = to.where(F.col("_type").isin(*types))
    rows = messages.drop("recipient").crossJoin(to)
    return rows.where(F.col("recipient") != F.col("sender")).drop("_type")


def point_to_point(messages: DataFrame, agent: str) -> DataFrame:
    return messages.where(F.col("recipient") == agent)


def expired(rows: DataFrame, column: str, now, seconds: int) -> DataFrame:
    """Rows older than a number of seconds: events after 7 days, messages and stopped agents after an hour."""
    return rows.where(F.col(column) < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds))))


def micro_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "100 milliseconds"):
    """Hand batches to a function at most once an interval."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
