"""Further registered queries: the remaining operators, each on tables derived from the driver's."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from auditlake.functions import scalar as S
from auditlake.functions import sql as SQL
from auditlake.operators import aggregates as G
from auditlake.operators import conversation as C
from auditlake.operators import diff as D
from auditlake.operators import dml as K
from auditlake.operators import filters as P
from auditlake.operators import graph as N
from auditlake.operators import ordering as T
from auditlake.operators import recon as R
from auditlake.operators import sets as U
from auditlake.operators import symbols as Y
from auditlake.operators import vectors as V
from auditlake.operators import windows as W
from auditlake.plans import inputs as I  # noqa: E741
from auditlake.plans.registry import ORACLES, query
from auditlake.plans.tables import new_path, task_count
from auditlake.sources import files as SF
from auditlake.sources.rules import rule_table
from auditlake.streaming import events as E

# --- sources and sinks ---------------------------------------------------------------------------

_INDICES = "SELECT o_orderkey AS id, o_custkey % 10 AS project_id, o_orderdate AS created_at FROM orders"


def _indices(spark, sf):
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("project_id"), F.col("o_orderdate").alias("created_at"))


@query("latest_index_symbols", f"SELECT l_orderkey AS index_id, l_linenumber AS n FROM lineitem WHERE l_orderkey = (SELECT id FROM ({_INDICES}) WHERE project_id = 2 ORDER BY created_at DESC, id DESC LIMIT 1)")
def latest_index_symbols(spark, sf):
    symbols = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("index_id"), F.col("l_linenumber").alias("n"))
    return K.latest_index(spark, _indices(spark, sf), symbols, 2)


@query("snapshot_keys", "SELECT DISTINCT source, substr(sha1(source), 1, 16) AS key FROM documents")
def snapshot_keys(spark, sf):
    return I.table(spark, sf, "documents").select("source", S.snapshot_key(F.col("source")).alias("key")).distinct()


@query("changed_files", f"SELECT path FROM ({I.FILES}) WHERE doc_id % 3 <> 0")
def changed_files(spark, sf):
    files = I.files(spark, sf).withColumn("mtime", F.col("doc_id"))
    return K.changed_files(files, files.where("doc_id % 3 = 0")).select("path")


@query("knowledge_module_lookup", f"SELECT lower(replace(replace(regexp_replace(string_split(path, '/')[-1], '[.]md$', ''), ' ', '_'), '-', '_')) AS module, path FROM ({I.FILES}) WHERE path LIKE '%.md'")
def knowledge_module_lookup(spark, sf):
    return SF.knowledge_modules(I.files(spark, sf)).select("module", "path")


@query("manifest_lines", f"WITH l AS (SELECT path AS file, trim(unnest(string_split(content, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM ({I.FILES})) SELECT file, CAST(count(*) AS BIGINT) AS n FROM l WHERE line <> '' AND line NOT LIKE '#%' GROUP BY file")
def manifest_lines(spark, sf):
    """Every document as a requirements file."""
    files = I.files(spark, sf).select(F.concat("path", F.lit("/requirements.txt")).alias("path"), "content")
    return R.dependencies(files).groupBy(F.regexp_replace("file", "/requirements.txt$", "").alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("store_scan_row", f"SELECT 3 AS project_id, 'completed' AS status, (SELECT count(DISTINCT path) FROM ({I.FILES})) AS files_scanned, count(*) AS findings_found FROM ({I.FINDINGS})")
def store_scan_row(spark, sf):
    findings = I.findings(spark, sf)
    _, scan = K.store_scan(findings, I.files(spark, sf), findings.limit(0), 3, F.lit("2024-01-01").cast("timestamp"))
    return scan.select("project_id", "status", "files_scanned", "findings_found")


@query("graph_call_relations", "SELECT event_id AS graph_id, 'a' AS caller, 'b' || (event_id % 5) AS callee, event_id AS line FROM events WHERE event_id % 7 <> 0")
def graph_call_relations(spark, sf):
    k = F.col("event_id")
    edge = F.struct(F.when(k % 7 != 0, "a").otherwise("").alias("from"), F.concat(F.lit("b"), (k % 5).cast("string")).alias("to"), F.lit("f").alias("file"), k.alias("line"))
    graphs = I.table(spark, sf, "events").select(k.alias("id"), F.to_json(F.struct(F.array(edge).alias("edges"))).alias("data"))
    return K.graph_relations(graphs).select("graph_id", "caller", "callee", "line")


#: Tables that hold rows of a project: the driver's table, and its columns for the row and the project.
_OWNED = {
    "findings": ("orders", ("o_orderkey", "o_custkey % 10")),
    "scans": ("events", ("event_id", "user_id % 10")),
    "call_relations": ("lineitem", ("l_orderkey", "l_suppkey % 10")),
    "code_graphs": ("events", ("event_id", "event_id % 10")),
    "symbols": ("part", ("p_partkey", "p_partkey % 10")),
    "ast_indices": ("orders", ("o_orderkey", "o_custkey % 10")),
    "projects": ("customer", ("c_custkey", "c_nationkey")),
}


@query("delete_project", " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({key} AS BIGINT) AS id, CAST({project} AS BIGINT) AS project_id FROM {source} WHERE {key if name == 'projects' else project} <> 4" for name, (source, (key, project)) in _OWNED.items()))
def delete_project(spark, sf):
    tables = {name: I.table(spark, sf, source).selectExpr(f"CAST({key} AS BIGINT) AS id", f"CAST({project} AS BIGINT) AS project_id") for name, (source, (key, project)) in _OWNED.items()}
    left = [rows.select(F.lit(name).alias("name"), "id", "project_id") for name, rows in K.delete_project(tables, 4).items()]
    out = left[0]
    for more in left[1:]:
        out = out.unionByName(more)
    return out


@query("index_saved", f"SELECT 3 AS project_id, 7 AS ast_index_id, 'v2' AS index_version, (SELECT count(*) FROM part) AS total_symbols, name || ':' || file_path || ':' || start_line AS symbol_id, kind AS symbol_type, array_to_string(parent_classes, ',') AS parent_name FROM ({I.SYMBOLS})")
def index_saved(spark, sf):
    """An index that is stored twice is read back once."""
    indices, table = new_path(spark, "indices"), new_path(spark, "symbols")
    for version in ("v1", "v2"):
        K.save_index(I.symbols(spark, sf), 3, 7, version, 24, indices, table)
    key = ["project_id", "ast_index_id"]
    known = spark.read.parquet(indices).select(*key, "index_version", "total_symbols")
    return spark.read.parquet(table).join(known, key).select(*key, "index_version", "total_symbols", "symbol_id", "symbol_type", "parent_name")


#: A source file of each language; {k7} stands for the part's number modulo 7.
_WRITTEN = {
    "java": "package p.q;\npublic class C{k} extends B{k7} {{\n  void m{k13}() {{\n    other.go{k5}(1); // no(2)\n  }}\n}}\n",
    "rs": "struct S{k} {{ n: u32 }}\nfn f{k13}(x: u32) -> u32 {{\n  g{k5}(x) /* no(2) */\n}}\n",
    "ts": "class T{k} {{\n  m{k13}(x) {{\n    return this.go{k5}(x);\n  }}\n}}\nfunction h{k7}() {{ }}\n",
}
_WRITTEN_SQL = " UNION ALL ".join(
    f"SELECT p_partkey || '.{ext}' AS file_path, '{kind}' AS kind, '{name}' || (p_partkey % {of}) AS name, CAST({line} AS BIGINT) AS start_line, {parent} AS parents FROM part WHERE p_partkey % 3 = {turn}"
    for turn, ext, kind, name, of, line, parent in (
        (0, "java", "Class", "C", 10**12, 2, "'B' || (p_partkey % 7)"), (0, "java", "Method", "m", 13, 3, "''"), (0, "java", "MethodCall", "go", 5, 4, "''"),
        (1, "rs", "Struct", "S", 10**12, 1, "''"), (1, "rs", "Function", "f", 13, 2, "''"), (1, "rs", "MethodCall", "g", 5, 3, "''"),
        (2, "ts", "Class", "T", 10**12, 1, "''"), (2, "ts", "Method", "m", 13, 2, "''"), (2, "ts", "MethodCall", "go", 5, 3, "''"), (2, "ts", "Function", "h", 7, 6, "''"),
    )
)


@query("written_symbols", _WRITTEN_SQL)
def written_symbols(spark, sf):
    """Symbols of a Java, Rust or TypeScript file written for each part."""
    k = F.col("p_partkey")

    def filled(text: str):
        pieces = re.split(r"\{(k\d*)\}", text)
        numbers = [(k % int(x[1:]) if x[1:] else k).cast("string") for x in pieces[1::2]]
        plain = [F.lit(x.replace("{{", "{").replace("}}", "}")) for x in pieces[::2]]
        return F.concat(plain[0], *(c for pair in zip(numbers, plain[1:], strict=True) for c in pair))

    kinds = list(_WRITTEN)
    path = F.concat_ws(".", k.cast("string"), F.element_at(F.array(*map(F.lit, kinds)), (k % 3 + 1).cast("int")))
    content = F.when(k % 3 == 0, filled(_WRITTEN[kinds[0]])).when(k % 3 == 1, filled(_WRITTEN[kinds[1]])).otherwise(filled(_WRITTEN[kinds[2]]))
    found = Y.extract_symbols(I.table(spark, sf, "part").select(path.alias("path"), content.alias("content")))
    return found.select("file_path", "kind", "name", "start_line", F.array_join("parent_classes", ",").alias("parents"))


@query("session_upsert", "SELECT user_id AS audit_id, max(event_id) AS event_id FROM events GROUP BY 1")
def session_upsert(spark, sf):
    return K.upsert_latest(I.table(spark, sf, "events").withColumnRenamed("user_id", "audit_id"), ["audit_id"], "event_id").select("audit_id", "event_id")


@query("session_status", f"SELECT agent_id AS audit_id, CASE WHEN agent_id = 5 THEN 'cancelled' ELSE status END AS status FROM ({I.AGENTS})")
def session_status(spark, sf):
    return K.set_status(I.agents(spark, sf).withColumnRenamed("agent_id", "audit_id"), 5, "cancelled").select("audit_id", "status")


@query("vector_rows", "SELECT 'p1_' || vec_id AS id, label FROM embeddings")
def vector_rows(spark, sf):
    return K.vector_rows(I.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), "p1").select("id", "label")


@query("knowledge_rows", f"SELECT id, array_to_string(parent_classes, ',') AS patterns FROM ({I.SYMBOLS})")
def knowledge_rows(spark, sf):
    return K.knowledge_rows(I.symbols(spark, sf).withColumnRenamed("parent_classes", "patterns")).select("id", "patterns")


@query("one_default", "SELECT c_custkey AS id, c_custkey = 7 AS is_default FROM customer")
def one_default(spark, sf):
    return K.one_default(I.table(spark, sf, "customer").withColumnRenamed("c_custkey", "id"), 7).select("id", "is_default")


# --- filters -------------------------------------------------------------------------------------


@query("project_list", "SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000003'")
def project_list(spark, sf):
    t = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("uuid"), F.col("c_custkey").alias("created_at"))
    return P.projects(t, "Customer#000000003").select("id")


@query("project_scans", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS at FROM orders WHERE o_custkey % 10 = 6")
def project_scans(spark, sf):
    o = I.table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("project_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("completed_at"))
    return P.scans_of_project(t, 6).select("id", "at")


@query("rule_by_id", "SELECT 'xxe-detection' AS id, 'critical' AS severity")
def rule_by_id(spark, sf):
    return P.rule_by_id(rule_table(spark), "xxe-detection").select("id", "severity")


@query("rule_categories", "SELECT unnest(['injection', 'authentication', 'information-disclosure', 'session-management', 'cryptography', 'file-operation', 'security-misconfiguration']) AS category")
def rule_categories(spark, sf):
    return P.categories(rule_table(spark))


@query("template_filter", "SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')) AND p_brand = (SELECT min(p_brand) FROM part)")
def template_filter(spark, sf):
    p = I.table(spark, sf, "part")
    first = p.agg(F.min("p_brand")).first()[0]
    return P.filter_templates(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category")), "RED", first).select("id")


@query("agents_filtered", f"SELECT agent_id FROM ({I.AGENTS}) WHERE agent_type = 'building' AND status = 'failed'")
def agents_filtered(spark, sf):
    return P.agents_by(I.agents(spark, sf), "building", "failed").select("agent_id")


@query("nodes_highlighted", f"SELECT id, contains(lower(name), 'n7') OR contains(lower(kind), 'n7') AS highlighted FROM ({I.SYMBOLS})")
def nodes_highlighted(spark, sf):
    return P.highlighted(I.symbols(spark, sf).select("id", F.col("name").alias("label"), F.col("kind").alias("original_label")), "N7").select("id", "highlighted")


@query("message_history", "SELECT event_id FROM events WHERE user_id = 3 OR event_id % 150 = 3")
def message_history(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("sender"), (F.col("event_id") % 150).cast("string").alias("recipient"), F.col("ts").alias("timestamp"))
    return P.message_history(e, "3").select("event_id")


# --- aggregates, windows, orders, sets -----------------------------------------------------------


@query("queue_stats", "SELECT CAST(conv_id % 5 AS VARCHAR) AS recipient, count(*) AS queued, count(*) FILTER (turn % 2 = 1) AS undelivered, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def queue_stats(spark, sf):
    c = I.table(spark, sf, "conversations").select((F.col("conv_id") % 5).cast("string").alias("recipient"), (F.col("turn") % 2 == 0).alias("delivered"), F.col("text").alias("content"))
    return G.queue_statistics(c)


@query("graph_counts", "SELECT event_id AS id, CAST(event_id % 4 AS INT) AS nodes, CAST(event_id % 3 AS INT) AS edges FROM events")
def graph_counts(spark, sf):
    def some(n: int):
        return F.slice(F.array(*(F.lit(str(i)) for i in range(n))), F.lit(1), (F.col("event_id") % n).cast("int"))

    data = F.to_json(F.struct(some(4).alias("nodes"), some(3).alias("edges")))
    return G.graph_counts(I.table(spark, sf, "events").select(F.col("event_id").alias("id"), data.alias("data")))


@query("latest_sequence_of_audit", f"SELECT max(sequence) AS latest FROM ({I.SEQUENCED}) WHERE audit_id = 11")
def latest_sequence_of_audit(spark, sf):
    return G.latest_sequence(W.sequenced(I.events(spark, sf), "audit_id", F.col("ts"), F.col("id")), 11)


@query("diff_line_numbers", f"SELECT id, CAST(CASE WHEN k <> 'Insert' THEN sum(CASE WHEN k <> 'Insert' THEN 1 ELSE 0 END) OVER w END AS BIGINT) AS left_line, CAST(CASE WHEN k <> 'Delete' THEN sum(CASE WHEN k <> 'Delete' THEN 1 ELSE 0 END) OVER w END AS BIGINT) AS right_line FROM (SELECT *, CASE event_type WHEN 'click' THEN 'Insert' WHEN 'view' THEN 'Delete' ELSE 'Equal' END AS k FROM ({I.EVENTS})) WINDOW w AS (PARTITION BY audit_id ORDER BY id ROWS UNBOUNDED PRECEDING)")
def diff_line_numbers(spark, sf):
    kind = F.when(F.col("event_type") == "click", "Insert").when(F.col("event_type") == "view", "Delete").otherwise("Equal")
    return W.diff_numbers(I.events(spark, sf).withColumn("diff_type", kind), "audit_id", "id").select("id", "left_line", "right_line")


@query("offset_lines", "SELECT doc_id, CAST(1 + len(substr(text, 1, o)) - len(replace(substr(text, 1, o), chr(10), '')) AS INT) AS line FROM (SELECT doc_id, text, length(text) - doc_id % 50 AS o FROM documents) WHERE o >= 0")
def offset_lines(spark, sf):
    """Of an offset near each text's end, so whole texts are read."""
    at = (F.length("text") - F.col("doc_id") % 50).cast("int")
    return I.table(spark, sf, "documents").withColumn("at", at).where("at >= 0").select("doc_id", W.offset_lines(F.col("text"), F.col("at")).cast("int").alias("line"))


@query("latest_events", f"SELECT id FROM ({I.SEQUENCED}) WHERE audit_id = 4 ORDER BY sequence DESC LIMIT 7")
def latest_events(spark, sf):
    return T.latest_events(W.sequenced(I.events(spark, sf), "audit_id", F.col("ts"), F.col("id")), 4, 7).select("id")


@query("first_symbols", f"SELECT pk FROM ({I.SYMBOLS}) ORDER BY file_path, start_line, name LIMIT 500")
def first_symbols(spark, sf):
    return T.first_symbols(I.symbols(spark, sf)).select("pk")


@query("component_sizes", f"WITH RECURSIVE e AS ({I.LINKS}), n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, label) AS (SELECT a, a FROM n UNION SELECT n.b, r.label FROM r JOIN n ON n.a = r.node), c AS (SELECT node, min(label) AS component FROM r GROUP BY node) SELECT component, count(*) AS size FROM c GROUP BY 1")
def component_sizes(spark, sf):
    return T.components_by_size(N.connected_components(I.links(spark, sf)))


@query("latest_default", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 9 = 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def latest_default(spark, sf):
    c = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 9 == 0).alias("is_default"), F.col("c_acctbal").alias("created_at"))
    return T.latest_default(c).select("id")


@query("union_keys", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_keys(spark, sf):
    return U.union_keys(I.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), I.table(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), "k")


@query("except_keys", "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)")
def except_keys(spark, sf):
    return U.except_keys(I.table(spark, sf, "part").select(F.col("p_partkey").alias("k")), I.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "k")


@query("unseen_nodes", "SELECT DISTINCT user_id AS node FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def unseen_nodes(spark, sf):
    visited = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return U.unseen(I.table(spark, sf, "events").withColumnRenamed("user_id", "node"), visited, "node")


@query("line_set_jaccard", "WITH s AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS l FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.l) = 0 OR len(b.l) = 0 THEN 0 ELSE len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) END, 6) AS j FROM s a JOIN s b ON b.doc_id = a.doc_id + 1")
def line_set_jaccard(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", U.trimmed_lines(F.col("text")).alias("l"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("l").alias("m"))
    return d.join(n, "doc_id").select("doc_id", F.round(U.jaccard(F.col("l"), F.col("m")), 6).alias("j"))


# --- joins, graphs and diffs ---------------------------------------------------------------------


@query("class_map", f"SELECT name, max(file_path) AS file_path FROM ({I.SYMBOLS}) WHERE kind = 'Class' GROUP BY name")
def class_map(spark, sf):
    return N.class_map(I.symbols(spark, sf))


@query("call_edges", f"SELECT caller, name AS callee, file_path AS file, start_line AS line FROM ({I.SYMBOLS}) WHERE kind = 'MethodCall' AND caller IS NOT NULL")
def call_edges(spark, sf):
    return N.call_edges(I.symbols(spark, sf))


@query("containment_compat", f"WITH s AS ({I.SYMBOLS}) SELECT c.id AS source, m.id AS target FROM s c JOIN s m USING (file_path) WHERE c.kind IN ('Class', 'Interface') AND m.kind IN ('Method', 'Function') AND m.end_line > c.end_line AND m.end_line < c.end_line + 100 AND (contains(lower(m.code), lower(c.name)) OR contains('pkg', c.name))")
def containment_compat(spark, sf):
    return N.containment_edges(I.symbols(spark, sf), compat=True).select("source", "target")


@query("relevant_modules", f"SELECT DISTINCT vuln_type FROM ({I.FINDINGS}) WHERE vuln_type <> 'type-P'")
def relevant_modules(spark, sf):
    names = I.findings(spark, sf).select("vuln_type").distinct()
    modules = spark.createDataFrame([("type_f",), ("type_o",)], "module string")
    return R.relevant_modules(names, modules).select("vuln_type")


@query("edge_handles", "SELECT l_orderkey AS source, l_partkey AS target, CASE WHEN abs(l_partkey - l_orderkey) > abs(l_partkey % 7 - l_orderkey % 7) THEN CASE WHEN l_partkey > l_orderkey THEN 'right' ELSE 'left' END ELSE CASE WHEN l_partkey % 7 > l_orderkey % 7 THEN 'bottom' ELSE 'top' END END AS source_handle FROM lineitem")
def edge_handles(spark, sf):
    """Every line item is an edge."""
    l = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))  # noqa: E741
    ids = l.select(F.col("source").alias("id")).union(l.select("target")).distinct()
    return N.placed_edges(l, ids.select("id", F.col("id").alias("x"), (F.col("id") % 7).alias("y"))).select("source", "target", "source_handle")


@query("agent_tree", f"WITH RECURSIVE t AS ({I.AGENTS}), r(agent_id, top, depth) AS (SELECT agent_id, agent_id, 0 FROM t UNION ALL SELECT r.agent_id, t.parent_id, r.depth + 1 FROM r JOIN t ON t.agent_id = r.top WHERE t.parent_id IS NOT NULL) SELECT agent_id, arg_max(top, depth) AS root, CAST(max(depth) AS INT) AS depth FROM r GROUP BY agent_id")
def agent_tree(spark, sf):
    return N.agent_tree(I.agents(spark, sf)).select("agent_id", "root", "depth")


@query("vector_context", "SELECT string_agg(substr(text, 1, 200), chr(10) || chr(10) ORDER BY doc_id) AS context FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 3)")
def vector_context(spark, sf):
    return V.context_text(I.table(spark, sf, "documents").select((-F.col("doc_id")).cast("double").alias("score"), "text").orderBy(F.col("score").desc()).limit(3))


@query("handoff_text", f"SELECT agent_id, '## 📋 来自 ' || agent_type || ' Agent 的任务交接' || chr(10) || chr(10) || '### 工作摘要' || chr(10) || status || chr(10) || chr(10) || '### 已完成工作' || chr(10) || '- ' || status AS text FROM ({I.AGENTS})")
def handoff_text(spark, sf):
    none = F.array().cast("array<string>")
    a = I.agents(spark, sf).select(
        F.col("agent_type").alias("from_agent"), F.col("agent_id").cast("string").alias("to_agent"), F.col("status").alias("summary"), F.array("status").alias("work_completed"),
        F.array().cast("array<struct<title:string,type:string,severity:string>>").alias("key_findings"), none.alias("insights"), none.alias("attention_points"), none.alias("priority_areas"),
    )
    return C.handoff_text(a).select(F.col("to_agent").cast("long").alias("agent_id"), "text")


@query("symbol_languages", f"SELECT path, CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' ELSE 'unknown' END AS symbol_language, CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'cpp' THEN 'cpp' ELSE 'python' END AS finding_language FROM ({I.FILES})")
def symbol_languages(spark, sf):
    p = F.col("path")
    return I.files(spark, sf).select("path", S.symbol_language(p).alias("symbol_language"), S.finding_language(p).alias("finding_language"))


@query("binary_files", f"SELECT path, ext = 'png' AS binary FROM ({I.FILES})")
def binary_files(spark, sf):
    return I.files(spark, sf).select("path", S.is_binary(F.col("path"), F.col("content").cast("binary")).alias("binary"))


@query("truncated_code", "SELECT doc_id, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS code FROM documents")
def truncated_code(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", S.truncated(F.col("text"), 200).alias("code"))


# --- event rules that have a batch form ----------------------------------------------------------


def _audit(spark, sf):
    rows = W.sequenced(I.events(spark, sf), "audit_id", F.col("ts"), F.col("id"))
    return rows.withColumn("event_type", F.when(F.col("event_type") == "signup", "complete").otherwise(F.col("event_type")))


_AUDIT = f"SELECT * REPLACE (CASE WHEN event_type = 'signup' THEN 'complete' ELSE event_type END AS event_type) FROM ({I.SEQUENCED})"


@query("events_until_end", f"WITH e AS ({_AUDIT}), x AS (SELECT audit_id, min(sequence) AS stop FROM e WHERE event_type IN ('complete', 'error', 'cancelled') GROUP BY 1) SELECT id FROM e LEFT JOIN x USING (audit_id) WHERE stop IS NULL OR sequence <= stop")
def events_until_end(spark, sf):
    return E.until_end(_audit(spark, sf)).select("id")


@query("event_buffer", f"SELECT id FROM ({I.SEQUENCED}) WHERE sequence <= 20")
def event_buffer(spark, sf):
    return E.bounded_buffer(W.sequenced(I.events(spark, sf), "audit_id", F.col("ts"), F.col("id")), 20).select("id")


@query("event_frames", f"SELECT id, 'event: ' || event_type || chr(10) || 'data: {{\"id\":' || id || ',\"audit_id\":' || audit_id || ',\"sequence\":' || sequence || ',\"event_type\":\"' || event_type || '\",\"message\":\"m\"}}' || chr(10) || chr(10) AS frame FROM ({_AUDIT})")
def event_frames(spark, sf):
    rows = _audit(spark, sf).withColumn("message", F.lit("m"))
    return E.sse_frames(rows).join(rows.select("audit_id", "sequence", "id"), ["audit_id", "sequence"]).select("id", "frame")


@query("broadcast_messages", f"WITH a AS ({I.AGENTS}) SELECT s.agent_id AS id, r.agent_id AS recipient FROM a s, a r WHERE s.agent_id <= 5 AND r.agent_id <> s.agent_id AND r.agent_type = 'building'")
def broadcast_messages(spark, sf):
    a = I.agents(spark, sf)
    m = a.where("agent_id <= 5").select(F.col("agent_id").alias("id"), F.col("agent_id").alias("sender"), F.lit(None).cast("long").alias("recipient"))
    return E.broadcast_messages(m, a, ["building"]).select("id", "recipient")


@query("events_expired", f"SELECT id FROM ({I.EVENTS}) WHERE ts < (SELECT max(ts) FROM ({I.EVENTS})) - INTERVAL 604800 SECOND")
def events_expired(spark, sf):
    e = I.events(spark, sf)
    return E.expired(e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))), "ts", F.col("now"), 604800).select("id")


@query("events_deduplicated", "SELECT user_id AS audit_id, event_type FROM events GROUP BY ALL")
def events_deduplicated(spark, sf):
    return I.events(spark, sf).select("audit_id", "event_type").dropDuplicates()


# --- streams: the batch results from a file stream, written through a committed sink ----------------


def _stream(spark, sf):
    """The events table as a stream of files: a file source watches a folder, so the rows are put into one first.

    Files arrive in no order, so there are no more of them than one trigger takes: the stream is one batch.
    """
    path = new_path(spark, "stream-in")
    e = I.table(spark, sf, "events")
    e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("audit_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("sequence")).coalesce(E.FILES_PER_TRIGGER).write.parquet(path)
    return E.read_events(spark, path, "id string, audit_id string, event_type string, timestamp timestamp, sequence bigint")


def _drained(df, name):
    """The rows that a stream appends until its source is drained."""
    spark = df.sparkSession
    path = new_path(spark, name)
    q = E.publish(df, path, new_path(spark, f"{name}-offsets"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_sequence", "SELECT CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS sequence FROM events")
def stream_sequence(spark, sf):
    """Numbers inside each audit, held as state of the stream."""
    return _drained(E.sequenced(_stream(spark, sf)), "stream-sequence").select("id", "sequence")


@query("stream_resume", "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE user_id = 5 AND event_id > 100 AND event_type IN ('view', 'click')")
def stream_resume(spark, sf):
    return _drained(E.resume(_stream(spark, sf), "5", 100, ["view", "click"]), "stream-resume").select("id")


@query("stream_unique", "SELECT user_id || ':' || event_type AS k, count(*) AS n FROM events GROUP BY 1")
def stream_unique(spark, sf):
    """Every event once, though the stream holds each twice."""
    s = _stream(spark, sf)
    rows = _drained(E.unique(s.unionByName(s), "30 days"), "stream-unique")
    return rows.groupBy(F.concat_ws(":", "audit_id", "event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_upsert", "SELECT CAST(user_id AS VARCHAR) AS audit_id, event_id % 20 AS sequence, CAST(max(event_id) AS VARCHAR) AS id FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf):
    """Batches merged into a table on (audit_id, sequence); the latest event of a place stays."""
    path = new_path(spark, "stream-upsert")
    s = _stream(spark, sf).withColumn("timestamp", F.timestamp_seconds(F.col("sequence"))).withColumn("sequence", F.col("sequence") % 20)
    q = s.writeStream.foreachBatch(E.upsert_sink(path)).option("checkpointLocation", new_path(spark, "stream-upsert-offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return E.version(spark, path, q.lastProgress["batchId"]).select("audit_id", "sequence", "id")


# --- functions of SQL text -------------------------------------------------------------------------


@query("sql_table_function", ORACLES["extracted_symbol_stats"])
def sql_table_function(spark, sf):
    """The symbol extractor as a lateral table function."""
    SQL.register(spark)
    source = F.concat(F.lit("class C"), F.col("doc_id").cast("string"), F.lit(":\n    def run(self):\n        self.queue.put(1)\n"))
    files = I.files(spark, sf).select(F.concat("path", F.lit(".py")).alias("path"), source.alias("content")).repartition(task_count(spark))
    return spark.sql("SELECT coalesce(s.kind, 'total') AS kind, count(*) AS n FROM {files} f, LATERAL extract_symbols(f.path, f.content) s GROUP BY ROLLUP (s.kind)", files=files)


@query("sql_scalar_functions", f"SELECT finding_id, CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 6 END AS rank, 'py' AS ext FROM ({I.FINDINGS})")
def sql_scalar_functions(spark, sf):
    SQL.register(spark)
    return spark.sql("SELECT finding_id, severity_rank(severity) AS rank, file_extension(file_path) AS ext FROM {f}", f=I.findings(spark, sf))
