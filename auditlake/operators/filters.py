"""Filters and projections over symbols, files, findings, scans, rules, events and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalar as S


def contains_ci(column: Column, query: str) -> Column:
    return F.contains(F.lower(column), F.lit(query.lower()))


def search_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose names hold the query in either case."""
    return symbols.where(contains_ci(F.col("name"), query))


def call_sites(symbols: DataFrame, name: str) -> DataFrame:
    """Calls of a name; an empty query finds nothing."""
    wanted = name.strip()
    return symbols.where((F.col("kind") == "MethodCall") & (F.col("name") == wanted) & F.lit(bool(wanted)))


def file_structure(symbols: DataFrame, file_path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == file_path).select("name", "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"))


def all_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"))


def symbol_record(symbols: DataFrame) -> DataFrame:
    """A symbol as one flat record: language, id, qualified class name, joined parents, all metadata."""
    qualified = F.when(F.coalesce(F.col("package"), F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name"))
    return symbols.select(
        S.symbol_id(F.col("file_path"), F.col("name"), F.col("start_line")).alias("id"), "name", "kind", "file_path", "start_line", "end_line",
        S.symbol_language(F.col("file_path")).alias("language"), qualified.alias("full_class_name"),
        F.concat_ws(", ", "parent_classes").alias("super_classes"), "package", "code",
        F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("kind"), F.col("kind"))).alias("metadata"),
    )


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("id") == rule_id).limit(1)


def findings_of_project(findings: DataFrame, project_id: int) -> DataFrame:
    return findings.where(F.col("project_id") == project_id).orderBy(F.col("created_at").desc(), "finding_id")


def scans_of_project(scans: DataFrame, project_id: int) -> DataFrame:
    done = F.when(F.col("completed_at").isNotNull(), F.col("completed_at")).otherwise(F.col("started_at"))
    return scans.where(F.col("project_id") == project_id).withColumn("at", done).orderBy(F.col("at").desc(), "id")


def projects(table: DataFrame, uuid: str | None = None) -> DataFrame:
    found = table if uuid is None else table.where(F.col("uuid") == uuid)
    return found.orderBy(F.col("created_at").desc(), "id")


def filter_findings(findings: DataFrame, text: str = "", severity: str | None = None) -> DataFrame:
    """Text in description, type or path in either case, and one severity or all."""
    keep = F.lit(True)
    if text:
        keep = contains_ci(F.col("description"), text) | contains_ci(F.col("vuln_type"), text) | contains_ci(F.col("file_path"), text)
    if severity and severity != "all":
        keep &= F.col("severity") == severity
    return findings.where(keep)


def filter_rules(rules: DataFrame, text: str = "", severity: str | None = None, category: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if text:
        keep = contains_ci(F.col("name"), text) | contains_ci(F.col("description"), text) | contains_ci(F.col("id"), text)
    if severity and severity != "all":
        keep &= F.col("severity") == severity
    if category and category != "all":
        keep &= F.col("category") == category
    return rules.where(keep)


def categories(rules: DataFrame) -> DataFrame:
    return rules.where("category is not null").select("category").distinct()


def filter_templates(templates: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    keep = contains_ci(F.col("name"), text) | contains_ci(F.col("description"), text) if text else F.lit(True)
    return templates.where(keep & (F.lit(True) if category in (None, "all") else F.col("category") == category))


def agents_by(agents: DataFrame, agent_type: str | None = None, status: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if agent_type:
        keep &= F.col("agent_type") == agent_type
    if status:
        keep &= F.col("status") == status
    return agents.where(keep)


def query_events(events: DataFrame, audit_id=None, after_sequence: int | None = None, types: list[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    if audit_id is not None:
        keep &= F.col("audit_id") == audit_id
    if after_sequence is not None:
        keep &= F.col("sequence") > after_sequence
    if types:
        keep &= F.col("event_type").isin(*types)
    return events.where(keep)


def verification_gate(findings: DataFrame, least: float = 0.6, default: float = 0.5) -> DataFrame:
    """Findings worth verifying: neither low nor info, and confident enough."""
    severity = F.lower(F.coalesce("severity", F.lit("")))
    return findings.where(~severity.isin("low", "info") & (F.coalesce("confidence", F.lit(default)) >= least))


def key_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first findings of high or critical severity."""
    return findings.where(F.lower("severity").isin("critical", "high")).orderBy(S.severity_rank(F.col("severity")), "finding_id").limit(n)


def highlighted(nodes: DataFrame, query: str) -> DataFrame:
    """Graph nodes with a mark where the label, in its shown or original form, holds the query."""
    hit = contains_ci(F.col("label"), query) | contains_ci(F.coalesce("original_label", F.lit("")), query)
    return nodes.withColumn("highlighted", F.coalesce(hit, F.lit(False)) if query else F.lit(False))


def path_matches(path: Column, pattern: str) -> Column:
    """A part of the path, or a glob in which `*` stands for anything."""
    if "*" not in pattern:
        return F.contains(path, F.lit(pattern))
    quoted = "".join(".*" if c == "*" else c if c.isalnum() or c in "/_" else f"\\{c}" for c in pattern)
    return path.rlike(f"^{quoted}$")


def message_history(messages: DataFrame, agent: str) -> DataFrame:
    return messages.where((F.col("sender") == agent) | (F.col("recipient") == agent)).orderBy("timestamp")
