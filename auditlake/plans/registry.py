"""Registered queries of the engine's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import scalar as S
from auditlake.operators import aggregates as G
from auditlake.operators import conversation as C
from auditlake.operators import diff as D
from auditlake.operators import dml as K
from auditlake.operators import dsl as Q
from auditlake.operators import filters as P
from auditlake.operators import graph as N
from auditlake.operators import ordering as T
from auditlake.operators import recon as R
from auditlake.operators import scan as X
from auditlake.operators import sets as U
from auditlake.operators import symbols as Y
from auditlake.operators import vectors as V
from auditlake.operators import windows as W
from auditlake.plans import inputs as I  # noqa: E741
from auditlake.sources.builtin_rules import RULES
from auditlake.sources import files as SF
from auditlake.sources.rules import active_rules, rule_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Patterns that occur in the test documents, by finding type.
DOCUMENT_PATTERNS = {"email": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "credential": r"(api_key|token|secret|password) *[=:]", "licence": r"(?i)licen[sc]e"}
_LINES = f"SELECT path, CAST(i AS BIGINT) AS line, string_split(content, chr(10))[CAST(i AS INT)] AS text FROM (SELECT path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM ({I.FILES}))"
_HITS = " UNION ALL ".join(f"SELECT path AS file_path, line AS line_start, '{k}' AS vuln_type FROM lines WHERE regexp_matches(text, '{p}')" for k, p in DOCUMENT_PATTERNS.items())
_LAST = f"NOT (text = '' AND line = (SELECT max(line) FROM ({_LINES}) m WHERE m.path = l.path))"
_RANK = "CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 6 END"


# --- scans ---------------------------------------------------------------------------------------


@query("scan_lines_by_type", f"WITH lines AS ({_LINES}) SELECT *, line_start AS line_end, 'RegexScanner' AS detector, 'high' AS severity, 'Found potential ' || vuln_type || ' at line ' || line_start AS description FROM ({_HITS})")
def scan_lines_by_type(spark, sf):
    return X.scan_lines(I.files(spark, sf), DOCUMENT_PATTERNS)


_SEEDED = f"SELECT path, text, line FROM lines UNION ALL SELECT path, 'db_password = \"pw-' || doc_id || '\"', 0 FROM ({I.FILES}) WHERE doc_id % 10 = 3 UNION ALL SELECT path, 'x // TODO: API_KEY=\"k\"', 0 FROM ({I.FILES}) WHERE doc_id % 10 = 4"


@query("scan_builtin_lines", f"WITH lines AS ({_LINES}) SELECT path AS file_path, CAST(CASE WHEN line = 0 THEN 1 ELSE line + CASE WHEN path IN (SELECT path FROM ({I.FILES}) WHERE doc_id % 10 IN (3, 4)) THEN 1 ELSE 0 END END AS BIGINT) AS line_start, vuln_type FROM ({_SEEDED}), (VALUES ('password', '(?i)password\\s*=\\s*[''\"][^''\"]+[''\"]'), ('api_key', '(?i)api_key\\s*=\\s*[''\"][^''\"]+[''\"]'), ('todo', 'TODO:')) v(vuln_type, p) WHERE regexp_matches(text, p)")
def scan_builtin_lines(spark, sf):
    """The built-in patterns; a fifth of the files get a first line that holds one or two of them."""
    k = F.col("doc_id")
    first = F.when(k % 10 == 3, F.concat(F.lit('db_password = "pw-'), k.cast("string"), F.lit('"\n'))).when(k % 10 == 4, F.lit('x // TODO: API_KEY="k"\n')).otherwise("")
    files = I.files(spark, sf).withColumn("content", F.concat(first, "content"))
    return X.scan_lines(files).select("file_path", "line_start", "vuln_type")


@query("findings_by_severity", f"WITH lines AS ({_LINES}), f AS ({_HITS}) SELECT s AS severity, CASE WHEN s = 'high' THEN (SELECT count(*) FROM f) ELSE 0 END AS n FROM (SELECT unnest(['critical','high','medium','low','info']) AS s)")
def findings_by_severity(spark, sf):
    return G.severity_counts(X.scan_lines(I.files(spark, sf), DOCUMENT_PATTERNS))


CONTENT_RULES = [
    {"id": "credential-block", "name": "c", "description": "a credential", "severity": "High", "language": "all", "cwe": "CWE-798", "pattern": r"(token|secret|password|api_key) *[=:]\s*[^ \n]+"},
    {"id": "digits", "name": "d", "description": "a long number", "severity": "low", "language": "python", "cwe": None, "pattern": r"[0-9]{12,}"},
]


def _content_sql(pattern: str, rule: dict, *exts: str) -> str:
    where = f"WHERE ext IN ({', '.join(repr(e) for e in exts)})" if exts else ""
    return f"""SELECT path AS file_path, '{"RegexRule: " + rule["id"]}' AS detector, '{rule["cwe"] or "Unknown"}' AS vuln_type, '{rule["severity"].lower()}' AS severity,
 CAST(sum(len(regexp_extract_all(content, '{pattern}'))) AS BIGINT) AS n FROM ({I.FILES}) {where} GROUP BY ALL HAVING n > 0"""


@query("scan_rules_content", _content_sql(r"(?:token|secret|password|api_key) *[=:]\s*[^ \n]+", CONTENT_RULES[0]) + " UNION ALL " + _content_sql("[0-9]{12,}", CONTENT_RULES[1], "py"))
def scan_rules_content(spark, sf):
    """Whole-content matches, counted by file and rule."""
    return X.scan_content(I.files(spark, sf), CONTENT_RULES).groupBy("file_path", "detector", "vuln_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("scan_multiline_spans", f"WITH lines AS ({_LINES}) SELECT path AS file_path, line AS line_start, line AS line_end FROM lines WHERE regexp_matches(text, 'licen[sc]e')")
def scan_multiline_spans(spark, sf):
    """Line ranges of whole-content matches; the pattern holds one match a line at most."""
    rule = {"id": "licence", "name": "l", "description": "", "severity": "info", "language": "all", "cwe": None, "pattern": r"licen[sc]e[^\n]*"}
    return X.scan_content(I.files(spark, sf), [rule]).select("file_path", "line_start", "line_end")


_PATTERN_RULES = [r for r in active_rules(RULES) if not r.get("query")]


@query("scan_shipped_rules", " UNION ALL ".join(_content_sql(r["pattern"].replace("'", "''"), r, *(X.extensions_of(r["language"]) or ())) for r in _PATTERN_RULES))
def scan_shipped_rules(spark, sf):
    """All active shipped pattern rules over every file, counted by file and rule."""
    return X.scan_content(I.files(spark, sf), _PATTERN_RULES).groupBy("file_path", "detector", "vuln_type", "severity").agg(F.count(F.lit(1)).alias("n"))


# Structural rules: calls in code, not in comments or strings.
CALL_RULES = [
    {"id": "call-eval", "name": "e", "description": "", "severity": "high", "language": "all", "cwe": None, "query": '(call_expression function: (identifier) @f (#eq? @f "eval"))'},
    {"id": "log-call", "name": "l", "description": "", "severity": "low", "language": "javascript", "cwe": None, "query": '(call_expression function: (member_expression object: (identifier) @o property: (property_identifier) @p) (#eq? @o "console") (#eq? @p "log"))'},
]


_FEEDS = "CAST(2 + length(coalesce(content, '')) - length(replace(coalesce(content, ''), chr(10), '')) AS BIGINT)"


@query("scan_structural_rules", f"""SELECT path AS file_path, {_FEEDS} AS line_start, 'ASTRule: call-eval' AS detector FROM ({I.FILES})
 UNION ALL SELECT path, {_FEEDS}, 'ASTRule: log-call' FROM ({I.FILES}) WHERE ext IN ('js','jsx','ts','tsx','mjs','cjs')""")
def scan_structural_rules(spark, sf):
    """Each file's text inside a comment, and calls around it: only the calls in code are found."""
    said = F.regexp_replace(F.coalesce("content", F.lit("")), "[*/]", " ")
    code = F.concat(F.lit("/* eval(1) "), said, F.lit(" */ s = 'eval(2)' // console.log(3)\neval (4); console.log(5); my.eval(6); reveal(7)"))
    return X.scan_content(I.files(spark, sf).withColumn("content", code), CALL_RULES).select("file_path", "line_start", "detector")


@query("scan_custom_by_extension", f"WITH lines AS ({_LINES}) SELECT path AS file, line, 'low' AS severity, 'number' AS message FROM lines WHERE path LIKE '%.js' AND regexp_matches(text, '[0-9]{{6,}}')")
def scan_custom_by_extension(spark, sf):
    return X.scan_custom(I.files(spark, sf), {"js": [{"pattern": "[0-9]{6,}", "message": "number", "severity": "low"}]}).select("file", "line", "severity", "message")


@query("findings_dedupe", f"WITH lines AS ({_LINES}), f AS ({_HITS}) SELECT file_path, line_start, vuln_type FROM f WHERE line_start > 1")
def findings_dedupe(spark, sf):
    """A repeated scan appends only what the first one (lines 1) did not store."""
    found = X.with_finding_id(X.scan_lines(I.files(spark, sf), DOCUMENT_PATTERNS))
    return K.new_rows(found.unionByName(found), found.where("line_start = 1")).select("file_path", "line_start", "vuln_type")


@query("rule_stats", "SELECT dimension, value, CAST(n AS BIGINT) AS n FROM (VALUES ('total','all',18),('severity','critical',4),('severity','high',6),('severity','medium',6),('severity','low',2),('language','all',16),('language','java',1),('language','typescript',1),('category','injection',5),('category','information-disclosure',3),('category','security-misconfiguration',3),('category','cryptography',2),('category','authentication',1),('category','session-management',1),('category','file-operation',1)) v(dimension, value, n)")
def rule_stats(spark, sf):
    return G.rule_statistics(rule_table(spark))


@query("rules_active", "SELECT 14 AS active, 18 AS total")
def rules_active(spark, sf):
    from auditlake.sources.builtin_rules import RULES

    return spark.createDataFrame([(len(active_rules(RULES)), len(RULES))], "active int, total int")


@query("rule_applicability", f"SELECT ext, 16 * count(*) + CASE WHEN ext = 'java' THEN count(*) ELSE 0 END + CASE WHEN ext IN ('js','ts') THEN count(*) ELSE 0 END AS pairs FROM ({I.FILES}) GROUP BY ext")
def rule_applicability(spark, sf):
    pairs = X.applicable(I.files(spark, sf), rule_table(spark))
    return pairs.groupBy(S.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("pairs"))


@query("supported_files", f"SELECT path FROM ({I.FILES}) WHERE ext IN ('py','js','ts','java','rs','cpp')")
def supported_files(spark, sf):
    return SF.scan_project(I.files(spark, sf)).select("path")


@query("walk_include_exclude", f"SELECT path FROM ({I.FILES}) WHERE contains(path, 'src1') AND NOT contains(path, '.md')")
def walk_include_exclude(spark, sf):
    return SF.walk(I.files(spark, sf), ["src1"], (".md",)).select("path")


@query("file_name_search", f"SELECT path FROM ({I.FILES}) WHERE contains(lower(string_split(path, '/')[-1]), '6.py')")
def file_name_search(spark, sf):
    return SF.search_names(I.files(spark, sf), "6.PY")


@query("read_one_file", f"SELECT path, content FROM ({I.FILES}) WHERE path = (SELECT min(path) FROM ({I.FILES}))")
def read_one_file(spark, sf):
    files = I.files(spark, sf)
    first = files.agg(F.min("path").alias("path"))
    return files.select("path", "content").join(F.broadcast(first), "path", "left_semi")


@query("file_tree", f"SELECT DISTINCT CASE WHEN d = 1 THEN string_split(path,'/')[1] ELSE path END AS path, CASE WHEN d = 2 THEN string_split(path,'/')[1] END AS parent, CASE WHEN d = 1 THEN string_split(path,'/')[1] ELSE string_split(path,'/')[2] END AS name, CASE WHEN d = 1 THEN 'folder' ELSE 'file' END AS type, CAST(d AS INT) AS depth FROM ({I.FILES}), (VALUES (1),(2)) v(d)")
def file_tree(spark, sf):
    return T.file_tree(N.path_tree(I.files(spark, sf)))


# --- filters, sorts, pages -----------------------------------------------------------------------


@query("symbol_search", f"SELECT name, kind, file_path AS file, start_line AS line FROM ({I.SYMBOLS}) WHERE contains(lower(name), 'n12')")
def symbol_search(spark, sf):
    return P.all_symbols(P.search_symbols(I.symbols(spark, sf), "N12"))


@query("call_sites", f"SELECT pk FROM ({I.SYMBOLS}) WHERE kind = 'MethodCall' AND name = 'N12'")
def call_sites(spark, sf):
    return P.call_sites(I.symbols(spark, sf), " N12 ").select("pk")


@query("file_structure", f"SELECT name, kind, file_path AS file, start_line AS line FROM ({I.SYMBOLS}) WHERE file_path = 'src/m3.java'")
def file_structure(spark, sf):
    return P.file_structure(I.symbols(spark, sf), "src/m3.java")


@query("symbol_records", f"SELECT id, name, kind, 'java' AS language, 'pkg.' || name AS full_class_name, array_to_string(parent_classes, ', ') AS super_classes FROM ({I.SYMBOLS})")
def symbol_records(spark, sf):
    return P.symbol_record(I.symbols(spark, sf)).select("id", "name", "kind", "language", "full_class_name", "super_classes")


@query("finding_search", f"SELECT finding_id FROM ({I.FINDINGS}) WHERE (contains(lower(description), 'urgent') OR contains(lower(vuln_type), 'urgent') OR contains(lower(file_path), 'urgent')) AND severity = 'critical'")
def finding_search(spark, sf):
    return P.filter_findings(I.findings(spark, sf), "URGENT", "critical").select("finding_id")


@query("project_findings", f"SELECT finding_id, created_at FROM ({I.FINDINGS}) WHERE project_id = 3")
def project_findings(spark, sf):
    return P.findings_of_project(I.findings(spark, sf), 3).select("finding_id", "created_at")


@query("verification_gate", f"SELECT finding_id FROM ({I.FINDINGS}) WHERE coalesce(lower(severity), '') NOT IN ('low', 'info') AND confidence >= 0.6")
def verification_gate(spark, sf):
    return P.verification_gate(I.findings(spark, sf)).select("finding_id")


@query("key_findings", f"SELECT finding_id, severity FROM ({I.FINDINGS}) WHERE lower(severity) IN ('critical', 'high') ORDER BY {_RANK}, finding_id LIMIT 10")
def key_findings(spark, sf):
    return P.key_findings(I.findings(spark, sf)).select("finding_id", "severity")


@query("rules_filtered", "SELECT * FROM (VALUES ('insecure-random'),('insecure-cookie'),('log-injection'),('sensitive-log-data'),('csrf-detection'),('unsafe-http-methods')) v(id)")
def rules_filtered(spark, sf):
    return P.filter_rules(rule_table(spark), "", "medium").select("id")


@query("severity_sorted", f"SELECT finding_id, severity, CAST({_RANK} AS INT) AS rank FROM ({I.FINDINGS}) ORDER BY {_RANK}, created_at DESC, finding_id")
def severity_sorted(spark, sf):
    """The whole order, as the surveyed query has no limit."""
    return T.by_severity(I.findings(spark, sf)).select("finding_id", "severity", S.severity_rank(F.col("severity")).alias("rank"))


@query("findings_prioritised", f"SELECT finding_id FROM ({I.FINDINGS}) ORDER BY CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 5 END, rule_id, finding_id LIMIT 50")
def findings_prioritised(spark, sf):
    return T.prioritised(I.findings(spark, sf)).select("finding_id")


@query("history_newest", f"SELECT id FROM (SELECT finding_id AS id, * FROM ({I.FINDINGS})) WHERE project_id = 4 ORDER BY created_at DESC, id DESC LIMIT 20")
def history_newest(spark, sf):
    return T.history(I.findings(spark, sf).withColumn("id", F.col("finding_id")), 4).select("id")


@query("keyset_page", f"SELECT id, sequence FROM ({I.SEQUENCED}) WHERE audit_id = 5 AND sequence > 10 ORDER BY sequence LIMIT 25")
def keyset_page(spark, sf):
    return T.keyset_page(_sequenced(spark, sf), 5, 10, 25).select("id", "sequence")


@query("rows_page", f"SELECT finding_id FROM ({I.FINDINGS}) ORDER BY created_at, finding_id LIMIT 40 OFFSET 80")
def rows_page(spark, sf):
    return T.page(I.findings(spark, sf), "created_at", "finding_id", offset=80, limit=40).select("finding_id")


@query("latest_per_key", f"SELECT project_id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, finding_id DESC) AS rn FROM ({I.FINDINGS})) WHERE rn = 1")
def latest_per_key(spark, sf):
    return W.latest_per_key(I.findings(spark, sf), ["project_id"], F.col("created_at").desc(), F.col("finding_id").desc()).select("project_id", "finding_id")


@query("last_n_per_key", f"SELECT audit_id, id FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY ts DESC, id DESC) AS rn FROM ({I.EVENTS})) WHERE rn <= 5")
def last_n_per_key(spark, sf):
    return W.last_n_per_key(I.events(spark, sf), ["audit_id"], 5, F.col("ts").desc(), F.col("id").desc()).select("audit_id", "id")


@query("git_path_filter", f"SELECT path FROM ({I.FILES}) WHERE regexp_matches(path, '^src1.*[.]py$')")
def git_path_filter(spark, sf):
    files = I.files(spark, sf)
    return files.where(P.path_matches(F.col("path"), "src1*.py")).select("path")


# --- events --------------------------------------------------------------------------------------


def _sequenced(spark, sf):
    return W.sequenced(I.events(spark, sf), "audit_id", F.col("ts"), F.col("id"))


@query("event_sequence", f"SELECT id, audit_id, sequence FROM ({I.SEQUENCED})")
def event_sequence(spark, sf):
    return _sequenced(spark, sf).select("id", "audit_id", "sequence")


@query("event_type_counts", f"SELECT event_type, count(*) AS n FROM ({I.EVENTS}) GROUP BY 1")
def event_type_counts(spark, sf):
    return G.event_type_counts(I.events(spark, sf))


@query("event_latest_sequence", f"SELECT audit_id, count(*) AS n, max(sequence) AS latest FROM ({I.SEQUENCED}) GROUP BY 1")
def event_latest_sequence(spark, sf):
    return G.event_count(_sequenced(spark, sf))


@query("event_resume", f"SELECT id FROM ({I.SEQUENCED}) WHERE audit_id = 7 AND sequence > 12 AND event_type IN ('click', 'view')")
def event_resume(spark, sf):
    return P.query_events(_sequenced(spark, sf), 7, 12, ["click", "view"]).select("id")


@query("event_upsert", f"SELECT audit_id, max(id) AS id FROM ({I.SEQUENCED}) GROUP BY audit_id, sequence % 10")
def event_upsert(spark, sf):
    """Every tenth number collides; the last arrival of a place stays."""
    rows = _sequenced(spark, sf).withColumn("sequence", F.col("sequence") % 10).withColumn("arrival", F.col("id"))
    return K.upsert_events(rows).select("audit_id", "id")


@query("event_retention", f"SELECT id FROM ({I.EVENTS}) WHERE ts >= (SELECT max(ts) FROM ({I.EVENTS})) - INTERVAL 7 DAY")
def event_retention(spark, sf):
    events = I.events(spark, sf)
    now = events.agg(F.max("ts").alias("now"))
    return K.retain(events.crossJoin(F.broadcast(now)), "ts", F.col("now"), 7).select("id")


@query("event_props_json", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def event_props_json(spark, sf):
    return I.events(spark, sf).select("id", F.get_json_object("props", "$.k").alias("k"))


@query("event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    e = I.events(spark, sf)
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("delete_audit", f"SELECT id FROM ({I.EVENTS}) WHERE audit_id <> 9")
def delete_audit(spark, sf):
    return K.delete_audit(I.events(spark, sf), 9).select("id")


# --- aggregates ----------------------------------------------------------------------------------


@query("symbol_stats", f"SELECT kind, count(*) AS n FROM ({I.SYMBOLS}) GROUP BY kind UNION ALL SELECT 'total', count(*) FROM part")
def symbol_stats(spark, sf):
    return G.symbol_statistics(I.symbols(spark, sf))


@query("severity_zero_filled", f"SELECT s AS severity, (SELECT count(*) FROM ({I.FINDINGS}) WHERE lower(severity) = s) AS n FROM (SELECT unnest(['critical','high','medium','low','info']) AS s)")
def severity_zero_filled(spark, sf):
    return G.severity_counts(I.findings(spark, sf))


@query("severity_open", f"SELECT lower(coalesce(severity, 'info')) AS severity, count(*) AS n FROM ({I.FINDINGS}) GROUP BY 1")
def severity_open(spark, sf):
    return G.open_severity_counts(I.findings(spark, sf))


@query("audit_summary", f"SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM ({I.FINDINGS}) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def audit_summary(spark, sf):
    return G.audit_summary(I.findings(spark, sf))


@query("filtered_counts", f"SELECT count(*) AS total, count(*) FILTER (k) AS total_kept, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}, count(*) FILTER (severity = '{s}' AND k) AS {s}_kept" for s in S.SEVERITIES)} FROM (SELECT *, confidence > 0.5 AS k FROM ({I.FINDINGS}))")
def filtered_counts(spark, sf):
    return G.filtered_counts(I.findings(spark, sf), F.col("confidence") > 0.5)


@query("audit_counters", f"SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS false_positives, round(100.0 * count(*) FILTER (NOT verified) / count(*), 6) AS false_positive_rate, count(*) FILTER (confidence > 0.7) AS high_confidence FROM ({I.FINDINGS})")
def audit_counters(spark, sf):
    return G.audit_counters(I.findings(spark, sf)).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query("agent_stats", f"SELECT agent_type, count(*) AS total, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'waiting') AS waiting, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'stopped') AS stopped FROM ({I.AGENTS}) GROUP BY 1")
def agent_stats(spark, sf):
    return G.agent_statistics(I.agents(spark, sf))


@query("distinct_types", f"SELECT array_to_string(list_sort(list(DISTINCT vuln_type)), ',') AS types FROM ({I.FINDINGS})")
def distinct_types(spark, sf):
    return G.distinct_values(I.findings(spark, sf), "vuln_type").select(F.concat_ws(",", "vuln_type").alias("types"))


@query("symbols_by_file", f"SELECT file_path, count(*) AS n, string_agg(name || ':' || start_line, ',' ORDER BY start_line, name, kind) AS names FROM ({I.SYMBOLS}) GROUP BY 1")
def symbols_by_file(spark, sf):
    g = G.symbols_by_file(I.symbols(spark, sf))
    return g.select("file_path", F.size("symbols").cast("long").alias("n"), F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit(":"), s["start_line"].cast("string"))), ",").alias("names"))


@query("ids_by_name", f"SELECT name, string_agg(id, ',' ORDER BY id) AS ids FROM ({I.SYMBOLS}) GROUP BY 1")
def ids_by_name(spark, sf):
    return G.ids_by_name(I.symbols(spark, sf)).select("name", F.array_join("ids", ",").alias("ids"))


@query("report_nodes", f"SELECT count(DISTINCT id) AS nodes FROM ({I.SYMBOLS})")
def report_nodes(spark, sf):
    return G.report_by_node(I.symbols(spark, sf)).agg(F.max("node_count").alias("nodes"))


# --- sets and diffs ------------------------------------------------------------------------------


@query("union_findings", f"SELECT finding_id, vuln_type FROM ({I.FINDINGS}) UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'")
def union_findings(spark, sf):
    return U.union_findings(I.findings(spark, sf).select("finding_id", "vuln_type"), I.events(spark, sf).where("event_type = 'error'").select(F.col("id").alias("finding_id")))


_SIDES = f"a AS (SELECT 'd/' || (doc_id // 2) AS path, content FROM ({I.FILES}) WHERE doc_id % 2 = 0), b AS (SELECT 'd/' || (doc_id // 2 + doc_id // 200) AS path, content FROM ({I.FILES}) WHERE doc_id % 2 = 1)"


def _sides(spark, sf):
    f, k = I.files(spark, sf), F.col("doc_id")
    half = F.floor(k / 2).cast("long")
    a = f.where(k % 2 == 0).select(F.concat(F.lit("d/"), half.cast("string")).alias("path"), "content")
    b = f.where(k % 2 == 1).select(F.concat(F.lit("d/"), (half + F.floor(k / 200).cast("long")).cast("string")).alias("path"), "content")
    return a, b


@query("dir_compare_full_outer", f"WITH {_SIDES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'Deleted' WHEN a.path IS NULL THEN 'Added' WHEN a.content = b.content THEN 'Unchanged' ELSE 'Modified' END AS status, strlen(a.content) AS left_size, strlen(b.content) AS right_size FROM a FULL OUTER JOIN b ON a.path = b.path")
def dir_compare_full_outer(spark, sf):
    return D.compare_keys(*_sides(spark, sf))


_SETS = "list_distinct(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> ''))"


@query("rename_jaccard", f"""WITH s AS (SELECT doc_id, strlen(content) AS n, {_SETS} AS l FROM ({I.FILES})),
 p AS (SELECT a.doc_id AS path, b.doc_id AS old_path, len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) AS similarity FROM s a JOIN s b ON a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 AND abs(a.n - b.n) <= 0.2 * greatest(a.n, b.n) AND len(a.l) > 0 AND len(b.l) > 0)
 SELECT path, old_path, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, old_path) AS rn FROM p WHERE similarity >= 0.8) WHERE rn = 1""")
def rename_jaccard(spark, sf):
    f = I.files(spark, sf).select(F.col("doc_id").alias("path"), "content")
    return D.renames(f.where("path % 2 = 1"), f.where("path % 2 = 0")).withColumn("similarity", F.round("similarity", 6))


@query("diff_summary", f"WITH {_SIDES}, j AS (SELECT a.content AS x, b.content AS y FROM a FULL OUTER JOIN b ON a.path = b.path) SELECT count(*) AS files, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS deleted, count(*) FILTER (x = y) AS unchanged FROM j")
def diff_summary(spark, sf):
    """Statuses only, as SQL has no line diff; directory_diff_summary has all counts."""
    a, b = _sides(spark, sf)
    return D.diff_summary(D.compare_directories(a, b, detect_renames=False)).select("files", "added", "deleted", "unchanged")


@query("directory_diff_summary")
def directory_diff_summary(spark, sf):
    """All counts, with renames and lines; SQL has no line diff, so it is tested against brute force."""
    return D.diff_summary(D.compare_directories(*_sides(spark, sf)))


@query("whole_file_lines", f"SELECT path, CAST(count(*) AS BIGINT) AS n FROM ({_LINES}) l WHERE {_LAST} GROUP BY path")
def whole_file_lines(spark, sf):
    """Of files of every extension."""
    return D.whole_file_lines(I.files(spark, sf), "Insert").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("git_change_sides")
def git_change_sides(spark, sf):
    """Line diffs of every changed path of two differing sides; SQL has no line diff, so lines are tested against brute force."""
    a, b = _sides(spark, sf)
    status = F.substring("status", 1, 1).alias("status")
    changes = D.compare_keys(a, b).where("status <> 'Unchanged'").select(status, "path", F.lit(None).cast("string").alias("old_path"))

    def lines(kind: str):
        return F.size(F.filter("lines", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind.lower()}")

    return D.compare_changes(changes, a, b).select("path", "status", lines("Equal"), lines("Insert"), lines("Delete"))


# --- graphs --------------------------------------------------------------------------------------

_BFS = f"""WITH RECURSIVE e AS ({I.CALLS}), r(node, lvl) AS (SELECT 'f1', 0 UNION SELECT e.callee, r.lvl + 1 FROM r JOIN e ON e.caller = r.node WHERE r.lvl < 2),
 f AS (SELECT node, min(lvl) AS lvl FROM r GROUP BY node)"""


@query("call_graph_edges", _BFS + " SELECT e.caller, e.callee, e.file, e.line, CAST(f.lvl AS INT) AS level FROM e JOIN f ON e.caller = f.node WHERE f.lvl < 2")
def call_graph_edges(spark, sf):
    return N.call_graph(I.calls(spark, sf), "f1", 2)[1]


@query("call_graph_nodes", _BFS + " SELECT node FROM f")
def call_graph_nodes(spark, sf):
    return N.call_graph(I.calls(spark, sf), "f1", 2)[0]


@query("class_hierarchy", f"""WITH RECURSIVE s AS (SELECT DISTINCT name, parent_classes[1] AS parent FROM ({I.SYMBOLS}) WHERE kind = 'Class'), u(name, depth) AS (SELECT 'N5', 0 UNION SELECT s.parent, u.depth + 1 FROM u JOIN s ON s.name = u.name WHERE s.parent IN (SELECT name FROM s) AND u.depth < 300),
 m AS (SELECT name, min(depth) AS depth FROM u GROUP BY name) SELECT 'parent' AS relation, name, CAST(depth AS INT) AS depth FROM m WHERE depth > 0 UNION ALL SELECT DISTINCT 'child', name, 1 FROM s WHERE parent = 'N5'""")
def class_hierarchy(spark, sf):
    return N.class_hierarchy(I.symbols(spark, sf), "N5").select("relation", "name", "depth").distinct()


_INHERITS = "SELECT c.id AS source, p.id AS target, 'extends' AS label, 'inheritance' AS type FROM s c JOIN s p ON p.name = c.parent_classes[1] WHERE c.kind IN ('Class', 'Interface', 'Struct')"
_CONTAINS = "SELECT c.id AS source, m.id AS target, 'contains' AS label, 'containment' AS type FROM s c JOIN s m USING (file_path) WHERE c.kind IN ('Class', 'Interface') AND m.kind IN ('Method', 'Function') AND m.start_line BETWEEN c.start_line AND c.end_line"
_SITES = "SELECT o.id AS source, c.id AS target, 'calls' AS label, 'call' AS type FROM s c JOIN s o ON o.name = c.caller WHERE c.kind = 'MethodCall'"
_TEXTUAL = "SELECT o.id AS source, t.id AS target, 'calls' AS label, 'call' AS type FROM s o JOIN s t ON contains(o.code, t.name || '(') AND o.name <> t.name WHERE o.kind IN ('Method', 'Function')"


@query("inheritance_edges", f"WITH s AS ({I.SYMBOLS}) {_INHERITS}")
def inheritance_edges(spark, sf):
    return N.inheritance_edges(I.symbols(spark, sf))


@query("containment_range_join", f"WITH s AS ({I.SYMBOLS}) {_CONTAINS}")
def containment_range_join(spark, sf):
    return N.containment_edges(I.symbols(spark, sf))


@query("call_site_edges", f"WITH s AS ({I.SYMBOLS}) {_SITES}")
def call_site_edges(spark, sf):
    return N.site_edges(I.symbols(spark, sf))


@query("textual_call_edges", f"WITH s AS ({I.SYMBOLS}) {_TEXTUAL}")
def textual_call_edges(spark, sf):
    return N.textual_call_edges(I.symbols(spark, sf))


#: The node limit belongs to the graph: it is drawn.
_GRAPH = f"WITH s AS (SELECT * FROM ({I.SYMBOLS}) ORDER BY file_path, start_line, name LIMIT 500)"


@query("knowledge_graph_nodes", f"{_GRAPH} SELECT id, name AS label, kind AS type FROM s")
def knowledge_graph_nodes(spark, sf):
    return N.knowledge_graph(I.symbols(spark, sf))[0]


@query("knowledge_graph_edges", f"{_GRAPH}, e AS ({_INHERITS} UNION ALL {_CONTAINS} UNION ALL {_SITES} UNION ALL {_TEXTUAL}) SELECT *, 'edge_' || (row_number() OVER (ORDER BY type, source, target) - 1) AS edge_id FROM e")
def knowledge_graph_edges(spark, sf):
    return N.knowledge_graph(I.symbols(spark, sf))[1]


@query("connected_components", f"""WITH RECURSIVE e AS ({I.LINKS}), n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, label) AS (SELECT a, a FROM n UNION SELECT n.b, r.label FROM r JOIN n ON n.a = r.node)
 SELECT node, min(label) AS component FROM r GROUP BY node""")
def connected_components(spark, sf):
    return N.connected_components(I.links(spark, sf))


@query("agent_closure", f"WITH RECURSIVE t AS ({I.AGENTS}), r(node, ancestor, depth) AS (SELECT agent_id, parent_id, 1 FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT r.node, t.parent_id, r.depth + 1 FROM r JOIN t ON t.agent_id = r.ancestor WHERE t.parent_id IS NOT NULL) SELECT node, ancestor, CAST(depth AS INT) AS depth FROM r")
def agent_closure(spark, sf):
    return N.closure(I.agents(spark, sf), "agent_id", "parent_id")


@query("agent_stop_set", f"WITH RECURSIVE t AS ({I.AGENTS}), r(agent_id) AS (SELECT CAST(3 AS BIGINT) UNION ALL SELECT t.agent_id FROM r JOIN t ON t.parent_id = r.agent_id) SELECT agent_id FROM r")
def agent_stop_set(spark, sf):
    return N.stop_set(I.agents(spark, sf), 3)


@query("tree_status", f"WITH RECURSIVE t AS ({I.AGENTS}), r(agent_id, top) AS (SELECT agent_id, agent_id FROM t UNION ALL SELECT r.agent_id, t.parent_id FROM r JOIN t ON t.agent_id = r.top WHERE t.parent_id IS NOT NULL) SELECT top, status, count(*) AS n FROM r JOIN t USING (agent_id) GROUP BY ALL")
def tree_status(spark, sf):
    return N.tree_status(I.agents(spark, sf))


# --- vectors and chunks --------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_L2 = "1 - list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _top(score: str) -> str:
    return f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {score} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, e.vec_id) AS rank FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON e.vec_id <> q.vec_id) WHERE rank <= 5"


@query("cosine_topk", _top(_COS))
def cosine_topk(spark, sf):
    e = I.table(spark, sf, "embeddings")
    return V.top_k_batch(e, e.where("vec_id % 20 = 0")).withColumn("score", F.round("score", 6))


@query("l2_topk", _top(_L2))
def l2_topk(spark, sf):
    e = I.table(spark, sf, "embeddings")
    return V.top_k_batch(e, e.where("vec_id % 20 = 0"), metric="l2").withColumn("score", F.round("score", 6))


@query("filtered_topk", "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE e.label = 1 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 5")
def filtered_topk(spark, sf):
    e = I.table(spark, sf, "embeddings")
    first = e.orderBy("vec_id").first()["embedding"]
    return V.top_k(e, first, 5, keep=F.col("label") == 1).select("vec_id", F.round("score", 6).alias("score"))


@query("line_chunks", f"SELECT path, CAST(s + 1 AS BIGINT) AS start_line, CAST(least(s + 20, len(l)) AS BIGINT) AS end_line, array_to_string(l[s + 1 : s + 20], chr(10)) AS text FROM (SELECT path, l, unnest(range(0, len(l), 15)) AS s FROM (SELECT path, string_split(content, chr(10)) AS l FROM ({I.FILES})))")
def line_chunks(spark, sf):
    return W.line_chunks(I.files(spark, sf), "path", "content", 20, 5)


# --- conversations, reconnaissance, language ------------------------------------------------------


@query("conversation_compress", """WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
 SELECT conv_id, 2 AS part, turn, role FROM c WHERE n <= 4 OR i > n - 2 UNION ALL SELECT conv_id, 0, turn, role FROM c WHERE n > 4 AND i <= n - 2 AND role = 'system' UNION ALL SELECT DISTINCT conv_id, 1, CAST(NULL AS BIGINT), 'system' FROM c WHERE n > 4""")
def conversation_compress(spark, sf):
    return C.compress(I.table(spark, sf, "conversations"), 4).select("conv_id", "part", "turn", "role")


def _surface_sql(kind: str, words: tuple[str, ...]) -> str:
    severity = f"'{R.SURFACE_SEVERITIES[kind]}'" if kind in R.SURFACE_SEVERITIES else "CAST(NULL AS VARCHAR)"
    return f"SELECT url AS file, '{kind}' AS type, {severity} AS severity FROM pages WHERE " + " OR ".join(f"contains(lower(url), '{w}')" for w in words)


@query("attack_surface", " UNION ALL ".join(_surface_sql(k, w) for k, w in R.SURFACES.items()))
def attack_surface(spark, sf):
    return R.attack_surface(I.table(spark, sf, "pages"), "url")


@query("tech_stack", "SELECT 'C++,Java,JavaScript,Python,Rust,TypeScript' AS languages, '' AS frameworks")
def tech_stack(spark, sf):
    return R.tech_stack(I.files(spark, sf)).select(F.concat_ws(",", "languages").alias("languages"), F.concat_ws(",", "frameworks").alias("frameworks"))


@query("confidence_score", "SELECT event_id AS id, CAST(CASE WHEN event_type = 'error' THEN 0.2 ELSE 0.5 END AS DOUBLE) AS confidence FROM events")
def confidence_score(spark, sf):
    return I.events(spark, sf).select("id", F.round(C.confidence(F.col("event_type")), 6).alias("confidence"))


@query("vulnerability_alias", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'command_injection' WHEN 2 THEN 'open_redirect_x' ELSE lower(replace(replace(o_orderpriority, ' ', '_'), '-', '_')) END AS name FROM orders")
def vulnerability_alias(spark, sf):
    """Of every order: aliases in several spellings, and names that are no alias."""
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "SQLi").when(k == 1, " RCE ").when(k == 2, "Open Redirect-x").otherwise(F.col("o_orderpriority"))
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.normal_vulnerability(raw).alias("name"))


@query("callee_normalise", f"SELECT DISTINCT name AS callee FROM ({I.SYMBOLS})")
def callee_normalise(spark, sf):
    s = I.symbols(spark, sf)
    full = F.concat(F.lit("a::b->c?."), "name")
    return s.select(S.callee_name(full).alias("callee")).distinct()


@query("dependency_parse", """SELECT p_partkey || '/package.json' AS file, 'm' || (p_partkey % 97) AS name, '^' || p_size AS version, 'production' AS type, 'npm' AS ecosystem FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey || '/package.json', 'dev-' || p_size, '2', 'development', 'npm' FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey || '/requirements.txt', 'm' || (p_partkey % 97), '>=' || p_size, 'production', 'pypi' FROM part WHERE p_partkey % 3 = 1
 UNION ALL SELECT p_partkey || '/requirements.txt', 'flask', 'unknown', 'production', 'pypi' FROM part WHERE p_partkey % 3 = 1
 UNION ALL SELECT p_partkey || '/pom.xml', 'maven-project', 'unknown', 'production', 'maven' FROM part WHERE p_partkey % 3 = 2""")
def dependency_parse(spark, sf):
    """One manifest for every part, of three kinds."""
    k, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.concat(F.lit("m"), (F.col("p_partkey") % 97).cast("string"))
    npm = F.to_json(F.struct(F.create_map(name, F.concat(F.lit("^"), size)).alias("dependencies"), F.create_map(F.concat(F.lit("dev-"), size), F.lit("2")).alias("devDependencies")))
    pip = F.concat(F.lit("# c\n"), name, F.lit(">="), size, F.lit("\n\nflask\n"))
    file = F.when(k % 3 == 0, "package.json").when(k % 3 == 1, "requirements.txt").otherwise("pom.xml")
    content = F.when(k % 3 == 0, npm).when(k % 3 == 1, pip).otherwise("<x/>")
    return R.dependencies(I.table(spark, sf, "part").select(F.concat_ws("/", k.cast("string"), file).alias("path"), content.alias("content")))


@query("extracted_symbol_stats", "SELECT kind, CASE kind WHEN 'total' THEN 3 ELSE 1 END * (SELECT count(*) FROM documents) AS n FROM (VALUES ('Class'), ('Method'), ('MethodCall'), ('total')) v(kind)")
def extracted_symbol_stats(spark, sf):
    """Symbols of one written source file for each document."""
    source = F.concat(F.lit("class C"), F.col("doc_id").cast("string"), F.lit(":\n    def run(self):\n        self.queue.put(1)\n"))
    files = I.files(spark, sf).select(F.concat("path", F.lit(".py")).alias("path"), source.alias("content"))
    return G.symbol_statistics(Y.extract_symbols(files))


# --- index-query language ------------------------------------------------------------------------


@query("dsl_conditions", "SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey BETWEEN 3 AND 17) OR NOT (c_name <> 'Customer#000000007')")
def dsl_conditions(spark, sf):
    c = I.table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    cond = Q.some(Q.every(Q.one_of("c_mktsegment", "BUILDING", "MACHINERY"), Q.between("nation", "3", "17")), Q.negated(Q.not_equal("c_name", "Customer#000000007")))
    return c.where(cond).select("c_custkey")


@query("dsl_page", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%' ORDER BY c_nationkey DESC, c_custkey LIMIT 10 OFFSET 10")
def dsl_page(spark, sf):
    c = I.table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("string")).withColumn("key", F.col("c_custkey").cast("string"))
    return Q.retrieve(c.withColumn("labels", F.create_map(F.lit("a"), F.col("c_mktsegment"))), Q.starts_with("c_mktsegment", "B"), "-nation", "key", labels=["a", "!b"], page=2, size=10)[0].select("c_custkey")


# --- relational sanity over the star schema --------------------------------------------------------


@query("star_join_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name")
def star_join_revenue(spark, sf):
    l, o, c, n = (I.table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))  # noqa: E741
    rows = l.join(o.where("o_orderstatus = 'F'"), l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line scan of documents to zero-filled severity counts."""
    return findings_by_severity(spark, sf_dir)
