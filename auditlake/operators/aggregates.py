"""Counts and summaries; every one is a single grouped pass with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalar as S


def symbol_statistics(symbols: DataFrame) -> DataFrame:
    """Count by kind, with the total in the row of kind `total`."""
    return symbols.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def rule_statistics(rules: DataFrame) -> DataFrame:
    """(dimension, value, n): total and by severity, language and category; rules without category are left out there."""
    one = rules.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("total", F.lit("all")), ("severity", F.col("severity")), ("language", F.col("language")), ("category", F.col("category")))))).alias("x"))
    return one.where("x.value is not null").groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(findings: DataFrame, column: str = "severity") -> DataFrame:
    """Five zero-filled buckets; unknown severities are dropped."""
    counted = findings.groupBy(F.lower(F.col(column)).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    buckets = findings.sparkSession.createDataFrame([(s,) for s in S.SEVERITIES], "severity string")
    return F.broadcast(buckets).join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def open_severity_counts(findings: DataFrame, column: str = "severity") -> DataFrame:
    """All severities as they come, lower-cased; a missing one counts as info."""
    return findings.groupBy(F.lower(F.coalesce(F.col(column), F.lit("info"))).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def audit_summary(findings: DataFrame, column: str = "severity") -> DataFrame:
    """Count by severity and, in the row of `total`, of all."""
    rows = findings.select(F.coalesce(F.col(column), F.lit("unknown")).alias("severity"))
    return rows.rollup("severity").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("severity", F.lit("total")).alias("severity"), "n")


def filtered_counts(findings: DataFrame, keep) -> DataFrame:
    """Counts by severity of all findings and of those kept, in one pass."""
    rows = [F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("total_kept")]
    for s in S.SEVERITIES:
        hit = F.col("severity") == s
        rows += [F.count_if(hit).alias(s), F.count_if(hit & keep).alias(f"{s}_kept")]
    return findings.agg(*rows)


def event_count(events: DataFrame) -> DataFrame:
    """Events and the latest sequence number (0 where there is none) of each audit."""
    return events.groupBy("audit_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("sequence"), F.lit(0)).alias("latest"))


def latest_sequence(events: DataFrame, audit_id) -> DataFrame:
    return events.where(F.col("audit_id") == audit_id).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("latest"))


def event_type_counts(events: DataFrame, audit_id=None) -> DataFrame:
    rows = events if audit_id is None else events.where(F.col("audit_id") == audit_id)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def agent_statistics(agents: DataFrame, statuses: tuple[str, ...] = ("running", "waiting", "completed", "failed", "stopped")) -> DataFrame:
    """For each agent type: all agents, and those of each fixed status."""
    return agents.groupBy("agent_type").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in statuses))


def distinct_values(table: DataFrame, *columns: str) -> DataFrame:
    """One sorted array of distinct values for each column."""
    return table.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def symbols_by_file(symbols: DataFrame) -> DataFrame:
    """Symbols of each file in the order of their lines."""
    item = F.struct("start_line", "name", "kind")
    return symbols.groupBy("file_path").agg(F.array_sort(F.collect_list(item)).alias("symbols"))


def ids_by_name(symbols: DataFrame) -> DataFrame:
    sid = S.symbol_id(F.col("file_path"), F.col("name"), F.col("start_line"))
    return symbols.groupBy("name").agg(F.array_sort(F.collect_list(sid)).alias("ids"))


def report_by_node(symbols: DataFrame) -> DataFrame:
    """One row for each node id, the last one given, and how many ids there are."""
    sid = S.symbol_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("node_id")
    rows = symbols.select(sid, F.struct("end_line", "kind", "code").alias("s")).groupBy("node_id").agg(F.max("s").alias("s"))
    return rows.select("node_id", "s.kind", "s.end_line").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("node_count"))))


def audit_counters(findings: DataFrame) -> DataFrame:
    """Verified and false-positive counts, false-positive rate in per cent (null for no findings), confident ones."""
    wrong = F.col("verified") == F.lit(False)
    return findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verified")).alias("verified"), F.count_if(wrong).alias("false_positives"),
        F.try_divide(100.0 * F.count_if(wrong), F.count(F.lit(1))).alias("false_positive_rate"), F.count_if(F.col("confidence") > 0.7).alias("high_confidence"),
    )


def queue_statistics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("recipient").agg(F.count(F.lit(1)).alias("queued"), F.count_if(~F.col("delivered")).alias("undelivered"), F.sum(F.octet_length("content")).alias("bytes"))


def graph_counts(graphs: DataFrame) -> DataFrame:
    """Sizes of the node and edge lists of stored graph documents (JSON)."""
    parsed = F.from_json("data", "nodes array<string>, edges array<string>")
    return graphs.select("id", F.coalesce(F.size(parsed["nodes"]), F.lit(0)).alias("nodes"), F.coalesce(F.size(parsed["edges"]), F.lit(0)).alias("edges"))
