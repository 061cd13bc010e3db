"""The audit model's tables derived from the driver's tables, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings dealt to documents, and severities of order priorities.
ENDINGS = ("py", "js", "ts", "java", "rs", "md", "cpp", "png")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return d.select(F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), ext.alias("ext"), F.col("text").alias("content"), "doc_id")


FILES = "SELECT source || '/' || doc_id || '.' || (['py','js','ts','java','rs','md','cpp','png'])[CAST(doc_id % 8 + 1 AS INT)] AS path, (['py','js','ts','java','rs','md','cpp','png'])[CAST(doc_id % 8 + 1 AS INT)] AS ext, text AS content, doc_id FROM documents"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    severity = F.when(p == "1", "critical").when(p == "2", "High").when(p == "3", "medium").when(p == "4", "low").when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 1, "weird").otherwise("info")
    return o.select(
        F.col("o_orderkey").alias("finding_id"), severity.alias("severity"), (F.col("o_orderkey") % 100 / 100.0).cast("double").alias("confidence"),
        (F.col("o_custkey") % 10).alias("project_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 3 == 0).alias("verified"),
        F.concat(F.lit("type-"), "o_orderstatus").alias("vuln_type"), F.concat(F.lit("src/file"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("Order "), "o_orderpriority").alias("description"), (F.col("o_orderkey") % 17).cast("string").alias("rule_id"),
    )


FINDINGS = """SELECT o_orderkey AS finding_id, CASE WHEN substr(o_orderpriority,1,1)='1' THEN 'critical' WHEN substr(o_orderpriority,1,1)='2' THEN 'High' WHEN substr(o_orderpriority,1,1)='3' THEN 'medium'
 WHEN substr(o_orderpriority,1,1)='4' THEN 'low' WHEN o_orderkey%7=0 THEN NULL WHEN o_orderkey%7=1 THEN 'weird' ELSE 'info' END AS severity, CAST(o_orderkey%100/100.0 AS DOUBLE) AS confidence,
 o_custkey%10 AS project_id, o_orderdate AS created_at, o_orderkey%3=0 AS verified, 'type-'||o_orderstatus AS vuln_type, 'src/file'||(o_custkey%50)||'.py' AS file_path,
 'Order '||o_orderpriority AS description, CAST(o_orderkey%17 AS VARCHAR) AS rule_id FROM orders"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events without a sequence number."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("audit_id"), "event_type", "ts", "props", "value")


EVENTS = "SELECT event_id AS id, user_id AS audit_id, event_type, ts, props, value FROM events"
SEQUENCED = f"SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY ts, id) AS sequence FROM ({EVENTS})"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols made from parts: classes, interfaces, methods, functions and calls in 24 files."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Class", "Method", "MethodCall", "Function", "Interface"))), (k % 5 + 1).cast("int"))
    name = F.concat(F.lit("N"), (k % 211).cast("string"))
    start = (k * 7 % 400 + 1).cast("long")
    meta = F.when(k % 5 == 2, F.create_map(F.lit("callerMethod"), F.concat(F.lit("N"), (k * 3 % 211).cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    parents = F.when(k % 5 == 0, F.array(F.concat(F.lit("N"), (k * 5 % 211).cast("string")))).otherwise(F.array().cast("array<string>"))
    file = F.concat(F.lit("src/m"), (k % 24).cast("string"), F.lit(".java"))
    return p.select(name.alias("name"), kind.alias("kind"), file.alias("file_path"), start.alias("start_line"), (start + k % 60).alias("end_line"), F.concat(F.lit("void run() { "), F.lit("N"), (k * 11 % 211).cast("string"), F.lit("(x); }")).alias("code"),
                    parents.alias("parent_classes"), F.lit("pkg").alias("package"), meta.alias("metadata"), F.concat_ws(":", file, name, start.cast("string")).alias("id"), k.alias("pk"))


SYMBOLS = """SELECT 'N'||(p_partkey%211) AS name, (['Class','Method','MethodCall','Function','Interface'])[CAST(p_partkey%5+1 AS INT)] AS kind, 'src/m'||(p_partkey%24)||'.java' AS file_path,
 CAST(p_partkey*7%400+1 AS BIGINT) AS start_line, CAST(p_partkey*7%400+1+p_partkey%60 AS BIGINT) AS end_line, 'void run() { N'||(p_partkey*11%211)||'(x); }' AS code,
 CASE WHEN p_partkey%5=0 THEN ['N'||(p_partkey*5%211)] ELSE CAST([] AS VARCHAR[]) END AS parent_classes, CASE WHEN p_partkey%5=2 THEN 'N'||(p_partkey*3%211) END AS caller,
 'src/m'||(p_partkey%24)||'.java:N'||(p_partkey%211)||':'||(p_partkey*7%400+1) AS id, p_partkey AS pk FROM part"""


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of agents made from customers: agent k is below agent k // 8."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    parent = F.when(k >= 8, F.floor(k / 8).cast("long"))
    status = F.element_at(F.array(*map(F.lit, ("running", "completed", "failed", "stopped"))), (k % 4 + 1).cast("int"))
    return c.select(k.alias("agent_id"), F.lower("c_mktsegment").alias("agent_type"), parent.alias("parent_id"), status.alias("status"))


AGENTS = "SELECT c_custkey AS agent_id, lower(c_mktsegment) AS agent_type, CASE WHEN c_custkey>=8 THEN c_custkey//8 END AS parent_id, (['running','completed','failed','stopped'])[CAST(c_custkey%4+1 AS INT)] AS status FROM customer"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites made from line items: supplier 'calls' a function of the part."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("f"), (F.col("l_suppkey") % 500).cast("string")).alias("caller"), F.concat(F.lit("f"), (F.col("l_partkey") * 13 % 500).cast("string")).alias("callee"), F.concat(F.lit("src/"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").cast("long").alias("line"))


CALLS = "SELECT 'f'||(l_suppkey%500) AS caller, 'f'||(l_partkey*13%500) AS callee, 'src/'||l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line FROM lineitem"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, href) of page links."""
    p = table(spark, sf_dir, "pages")
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)))
    return p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("a"), href.alias("h")).select("a", F.concat(F.lit("h"), "h").alias("b"))


LINKS = """SELECT DISTINCT 'p'||page_id AS a, 'h'||unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS b FROM pages"""
