"""Sorts, limits and pages; limits follow sorts, so Spark runs them as top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalar as S


def by_severity(findings: DataFrame, severity: str = "severity", created: str = "created_at", tie: str = "finding_id") -> DataFrame:
    return findings.orderBy(S.severity_rank(F.col(severity)), F.col(created).desc(), tie)


def prioritised(findings: DataFrame, n: int = 50) -> DataFrame:
    """By severity (unknown ones rank fifth, as info does) and rule, the first n."""
    return findings.orderBy(S.severity_rank(F.col("severity"), other=5), "rule_id", "finding_id").limit(n)


def history(table: DataFrame, project_id, n: int = 20) -> DataFrame:
    return table.where(F.col("project_id") == project_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def keyset_page(events: DataFrame, audit_id, after: int, limit: int = 100, most: int = 1000) -> DataFrame:
    """Events after a sequence number, ascending, at most `most`."""
    return events.where((F.col("audit_id") == audit_id) & (F.col("sequence") > after)).orderBy("sequence").limit(min(limit, most))


def latest_events(events: DataFrame, audit_id, n: int) -> DataFrame:
    return events.where(F.col("audit_id") == audit_id).orderBy(F.col("sequence").desc()).limit(n)


def first_symbols(symbols: DataFrame, n: int = 500) -> DataFrame:
    """A repeatable bounded node set: by file, line and name, and where these tie by every other column that has an order."""
    first = ["file_path", "start_line", "name"]
    rest = [f.name for f in symbols.schema if f.name not in first and "map<" not in f.dataType.simpleString()]
    return symbols.orderBy(*first, *rest).limit(n)


def file_tree(entries: DataFrame) -> DataFrame:
    """Folders first, then names without regard to case."""
    return entries.orderBy(F.when(F.col("type") == "folder", 0).otherwise(1), F.lower("name"), "name")


def components_by_size(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "component")


def defaults_first(configs: DataFrame) -> DataFrame:
    return configs.orderBy(F.col("is_default").desc(), F.col("created_at").desc(), "id")


def latest_default(configs: DataFrame) -> DataFrame:
    return configs.where("is_default").orderBy(F.col("created_at").desc(), "id").limit(1)


def page(rows: DataFrame, *order, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)
