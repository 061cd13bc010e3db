"""Sinks and table rewrites: appends, upserts, deletes and retention over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tables that hold rows of a project, in the order of their deletion.
PROJECT_TABLES = ("findings", "scans", "call_relations", "code_graphs", "symbols", "ast_indices", "projects")


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def index_rows(symbols: DataFrame, project_id: int, index_id: int, version: str, files: int) -> tuple[DataFrame, DataFrame]:
    """(one row of the index, one row a symbol of it) to store; the index row keeps the count, the symbols their own table."""
    keys = F.lit(project_id).cast("long").alias("project_id"), F.lit(index_id).cast("long").alias("ast_index_id")
    rows = symbols.select(
        *keys, F.concat_ws(":", "name", "file_path", F.col("start_line").cast("string")).alias("symbol_id"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_type"),
        "file_path", F.col("start_line").alias("line_number"), F.col("end_line"), F.array_join(F.coalesce("parent_classes", F.array().cast("array<string>")), ",").alias("parent_name"), F.to_json("metadata").alias("metadata"),
    )
    index = symbols.agg(F.count(F.lit(1)).alias("total_symbols")).select(*keys, F.lit(version).alias("index_version"), "total_symbols", F.lit(files).cast("long").alias("total_files"))
    return index, rows


def put(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows and replace the partitions that they fall into: a second run, after a failure too, stores nothing twice."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def save_index(symbols: DataFrame, project_id: int, index_id: int, version: str, files: int, indices: str, table: str) -> None:
    """Store an index: its symbols first, then the row that makes it known, so a reader of known indices sees whole ones."""
    index, rows = index_rows(symbols, project_id, index_id, version, files)
    put(rows, table, "project_id", "ast_index_id")
    put(index, indices, "project_id", "ast_index_id")


def overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "finding_id") -> DataFrame:
    """Incoming rows whose key is not there yet, once each."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def store_scan(findings: DataFrame, files: DataFrame, existing: DataFrame, project_id: int, at: Column) -> tuple[DataFrame, DataFrame]:
    """(findings to append, one completed scan row) of a scan."""
    fresh = new_rows(findings, existing).withColumn("project_id", F.lit(project_id)).withColumn("created_at", at)
    counts = findings.agg(F.count(F.lit(1)).alias("findings_found")).crossJoin(files.agg(F.count_distinct("path").alias("files_scanned")))
    scan = counts.select(F.lit(project_id).alias("project_id"), F.lit("completed").alias("status"), "files_scanned", "findings_found", at.alias("started_at"), at.alias("completed_at"))
    return fresh, scan


def graph_relations(graphs: DataFrame) -> DataFrame:
    """Call relations of stored graph documents; edges without both ends are skipped."""
    parsed = F.from_json("data", "edges array<struct<`from`:string,`to`:string,file:string,line:bigint>>")
    rows = graphs.select(F.col("id").alias("graph_id"), F.explode(parsed["edges"]).alias("e"))
    return rows.select("graph_id", F.col("e.from").alias("caller"), F.col("e.to").alias("callee"), F.col("e.file").alias("file"), F.col("e.line").alias("line")).where("caller <> '' and callee <> ''")


def delete_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """Every project table without a project's rows."""
    out = {}
    for name in PROJECT_TABLES:
        if name in tables:
            key = "id" if name == "projects" else "project_id"
            out[name] = tables[name].where(~F.coalesce(F.col(key) == project_id, F.lit(False)))
    return out


def upsert_events(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The last arrival of each id, and of those the last one of each (audit_id, sequence)."""
    by_id = Window.partitionBy("id").orderBy(F.col(arrival).desc())
    rows = events.withColumn("_rn", F.row_number().over(by_id)).where("_rn = 1")
    by_place = Window.partitionBy("audit_id", "sequence").orderBy(F.col(arrival).desc())
    return rows.withColumn("_rn", F.row_number().over(by_place)).where("_rn = 1").drop("_rn")


def delete_audit(events: DataFrame, audit_id) -> DataFrame:
    return events.where(~F.coalesce(F.col("audit_id") == audit_id, F.lit(False)))


def retain(rows: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days."""
    return rows.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def upsert_latest(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Sessions, executions, findings and verdicts: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(arrival).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def set_status(sessions: DataFrame, audit_id, status: str) -> DataFrame:
    return sessions.withColumn("status", F.when(F.col("audit_id") == audit_id, F.lit(status)).otherwise(F.col("status")))


def vector_rows(chunks: DataFrame, project_id: str) -> DataFrame:
    """Chunk rows to append to the embeddings table; ids carry the project."""
    return chunks.withColumn("id", F.concat(F.lit(f"{project_id}_"), F.col("id").cast("string")))


def knowledge_rows(entries: DataFrame) -> DataFrame:
    """Vulnerability knowledge to append; patterns are joined by commas."""
    return entries.withColumn("patterns", F.concat_ws(",", "patterns"))


def one_default(configs: DataFrame, config_id) -> DataFrame:
    """Configs of which exactly the named one is the default."""
    return configs.withColumn("is_default", F.col("id") == config_id)


def latest_index(spark: SparkSession, indices: DataFrame, symbols: DataFrame, project_id: int) -> DataFrame:
    """Symbols of a project's newest index."""
    newest = indices.where(F.col("project_id") == project_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1).select(F.col("id").alias("index_id"))
    return symbols.join(F.broadcast(newest), "index_id", "left_semi")


def changed_files(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Files that a snapshot does not hold with the same time of change."""
    return files.join(snapshot.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")
