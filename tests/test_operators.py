import random
import struct
import time
from collections import Counter

import pyarrow as pa
import pytest
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
from auditlake.operators import symbols as Y
from auditlake.operators import vectors as V
from auditlake.operators import windows as W
from auditlake.sources.builtin_rules import RULES
from auditlake.sources.rules import active_rules, dialect_error


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def files(spark, *rows):
    return spark.createDataFrame([(p, p.rpartition(".")[2], c) for p, c in rows], "path string, ext string, content string")


PASSWORD = [r for r in RULES if r["id"] == "no-hardcoded-passwords"]


def test_multiline_content_against_line_scan(spark):
    df = files(spark, ("a.py", 'a = 1\npassword = "x"\nfoo\nPASSWORD="q\nz" end'))
    assert [(r["line_start"], r["line_end"]) for r in X.scan_content(df, PASSWORD).collect()] == [(2, 2), (4, 5)]
    assert [r["line_start"] for r in X.scan_lines(df).collect()] == [2]


def test_lines_of_odd_ends(spark):
    df = spark.createDataFrame([("a\r\nb\r\n",), ("",), ("\n",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.lines_of(F.col("t"))).collect()] == [["a", "b"], [], [""], ["x"], None]


def test_rules_that_the_dialect_refuses():
    dropped = {r["id"] for r in RULES} - {r["id"] for r in active_rules(RULES)}
    assert dropped == {"csrf-detection", "insecure-cookie", "xxe-detection", "command-injection"}
    assert dialect_error(r"(a)\1") and dialect_error("(?<=a)b") and not dialect_error(r"\(\?=") and dialect_error("(")


def test_content_scan_as_python(spark):
    import re

    rng = random.Random(1)
    parts = ["eval(", "print", "\n", " x ", "console.log(", "DES", "encrypt ", "'", '"', "Runtime.getRuntime().exec", "random()", "\r\n", "token = ", "abcdefghijkl"]
    rows = [(f"d/{i}.{rng.choice(['py', 'ts', 'java', 'md'])}", "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(120)]
    got = Counter((r["file_path"], r["detector"], r["line_start"], r["line_end"]) for r in X.scan_content(files(spark, *rows), RULES).collect())
    want = Counter()
    for path, text in rows:
        for rule in active_rules(RULES):
            exts = X.extensions_of(rule["language"])
            if exts is not None and path.rpartition(".")[2] not in exts:
                continue
            if rule.get("query"):  # calls outside comments and strings, located by their first name
                for m in re.finditer(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|(?<![\w.$])(console)\s*\.\s*log\s*\(""", text):
                    line = 1 + text[: m.start()].count("\n")
                    want[path, f"ASTRule: {rule['id']}", line, line] += m[1] is not None
                continue
            for m in re.finditer(rule["pattern"], text):
                want[path, f"RegexRule: {rule['id']}", 1 + text[: m.start()].count("\n"), 1 + text[: m.end()].count("\n")] += 1
    assert got == +want


def test_structural_queries_are_parsed_or_refused():
    assert X.call_pattern('(call_expression function: (identifier) @f (#eq? @f "eval"))') == r"(?<![\w.$])eval\s*\("
    with pytest.raises(ValueError):
        X.call_pattern('(assignment left: (identifier) @a)')


def test_applicability_and_ids(spark):
    df = files(spark, ("a.tsx", ""), ("b.java", ""), ("c.md", ""))
    from auditlake.sources.rules import rule_table

    got = Counter(r["path"] for r in X.applicable(df, rule_table(spark)).collect())
    assert got == {"a.tsx": 17, "b.java": 17, "c.md": 16}
    found = X.scan(spark, files(spark, ("a.py", "TODO: x")), PASSWORD)
    assert found.select("finding_id").distinct().count() == found.count() == 1
    assert K.new_rows(found, found).count() == 0


EDGES = [("a", "b", 1), ("a", "b", 2), ("b", "c", 3), ("c", "a", 4), ("c", "d", 5)]


def test_call_graph_depths(spark):
    df = spark.createDataFrame(EDGES, "caller string, callee string, line long")
    nodes, edges = N.call_graph(df, "a", 1)
    assert sorted(r[0] for r in nodes.collect()) == ["a", "b"] and edges.count() == 2
    nodes, edges = N.call_graph(df, " a ", 3)
    assert sorted(r[0] for r in nodes.collect()) == ["a", "b", "c", "d"] and edges.count() == 5
    for entry, depth, n in (("", 3, 0), ("unknown", 2, 1), ("a", 0, 0)):
        nodes, edges = N.call_graph(df, entry, depth)
        assert (nodes.count(), edges.count()) == (n, 0)


def test_hierarchy(spark):
    rows = [("C", ["B"]), ("B", ["A", "External"]), ("D", ["B"]), ("A", []), ("X", ["Y"]), ("Y", ["X"])]
    df = spark.createDataFrame([(n, "Class", f"{n}.java", p) for n, p in rows], "name string, kind string, file_path string, parent_classes array<string>")
    assert sorted((r[0], r[1]) for r in N.class_hierarchy(df, "B").collect()) == [("child", "C"), ("child", "D"), ("parent", "A")]
    assert sorted((r[0], r[1]) for r in N.class_hierarchy(df, "X").collect()) == [("child", "Y"), ("parent", "Y")]
    assert N.class_hierarchy(df, "Nope").count() == 0


def test_knowledge_graph(spark):
    source = "package p.q;\npublic class A extends B {\n  private int n = 1;\n  void run() {\n    helper(n);\n  }\n  int helper(int x) { return x; }\n}\nclass B { }\n"
    symbols = Y.extract_symbols(spark.createDataFrame([("A.java", source)], "path string, content string"))
    nodes, edges = N.knowledge_graph(symbols)
    found = {(r["type"], r["source"].split(":")[1], r["target"].split(":")[1]) for r in edges.collect()}
    assert {("inheritance", "A", "B"), ("containment", "A", "run"), ("containment", "A", "helper"), ("call", "run", "helper")} <= found
    assert sorted(r["edge_id"] for r in edges.collect()) == sorted(f"edge_{i}" for i in range(edges.count()))
    assert nodes.count() == symbols.count()
    assert N.knowledge_graph(symbols, limit=1)[1].count() == 0


def test_tree_and_layout(spark):
    agents = spark.createDataFrame([(1, None, "x"), (2, 1, "y"), (3, 2, "x"), (9, None, "x")], "agent_id long, parent_id long, status string")
    got = {r["agent_id"]: (r["root"], r["path"], r["depth"]) for r in N.agent_tree(agents).collect()}
    assert got == {1: (1, [1], 0), 2: (1, [1, 2], 1), 3: (1, [1, 2, 3], 2), 9: (9, [9], 0)}
    assert sorted(r[0] for r in N.stop_set(agents, 2).collect()) == [2, 3]
    edges = N.placed_edges(spark.createDataFrame([("a", "b")], "source string, target string"), spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, -5.0)], "id string, x double, y double")).first()
    assert (edges["source_handle"], edges["target_handle"]) == ("top", "bottom")
    assert N.connected_components(spark.createDataFrame([("z", "z"), ("b", "a"), ("c", "b")], "a string, b string")).where("component = 'a'").count() == 3


def test_long_chain_of_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (200, 200), (100, 101)]
    got = dict(map(tuple, N.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert N.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_shortest_edit():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randrange(9))]
        b = [rng.choice("abc") for _ in range(rng.randrange(9))]
        steps = D.shortest_edit(a, b)
        assert [a[i] for k, i, _ in steps if k != "Insert"] == a and [b[j] for k, _, j in steps if k != "Delete"] == b
        assert all(a[i] == b[j] for k, i, j in steps if k == "Equal")
        assert [i for _, i, _ in steps if i is not None] == list(range(len(a))) and [j for _, _, j in steps if j is not None] == list(range(len(b)))
        assert sum(k != "Equal" for k, _, _ in steps) == edit_distance(a, b)


def test_shortest_edit_in_linear_space():
    import tracemalloc

    rng = random.Random(3)
    a = [rng.choice("abcdefgh") for _ in range(1500)]
    b = [rng.choice("ijklmnop") if i % 2 else x for i, x in enumerate(a)]
    tracemalloc.start()
    steps = D.shortest_edit(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k != "Equal" for k, _, _ in steps) == edit_distance(a, b)
    assert peak < 4 << 20


def test_renames_with_common_lines(spark):
    """Every file holds the same header lines, so only the rare lines can tell files apart."""
    rng = random.Random(4)
    head = [f"import {i}" for i in range(6)]
    texts = {i: head + [f"{i} own {j}" for j in range(rng.randrange(1, 30))] for i in range(60)}
    for i in range(60, 110):
        texts[i] = texts[rng.randrange(60)][: rng.randrange(5, 34)] + [f"new {i}"] * rng.randrange(3)
    rows = [(i, "\n".join(t)) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "path long, content string")
    got = {r["path"]: (r["old_path"], round(r["similarity"], 9)) for r in D.renames(df.where("path >= 60"), df.where("path < 60")).collect()}
    want = {}
    for i in range(60, 110):
        for j in range(60):
            x, y, n, m = set(texts[i]), set(texts[j]), len(rows[i][1]), len(rows[j][1])
            rate = len(x & y) / len(x | y)
            if rate >= 0.8 and abs(n - m) <= 0.2 * max(n, m) and rate > want.get(i, (0, 0))[1]:
                want[i] = (j, rate)
    assert want and got == {i: (j, round(s, 9)) for i, (j, s) in want.items()}


@pytest.mark.parametrize("compat", [False, True])
def test_containment_cells(spark, compat):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        start = rng.randrange(1, 700)
        end = start + rng.choice([-2, 0, 1, 5, 63, 64, 65, 400])
        rows.append((f"s{i}", f"n{i % 4}", rng.choice(["Class", "Interface", "Struct", "Method", "Function"]), f"f{i % 3}", start, end if i % 17 else None, f"x n{i % 5} y", "pkg"))
    df = spark.createDataFrame(rows, "id string, name string, kind string, file_path string, start_line long, end_line long, code string, package string")
    want = set()
    for c in rows:
        for m in rows:
            if c[2] in ("Class", "Interface", "Struct") and m[2] in ("Method", "Function") and c[3] == m[3] and c[5] is not None:
                inside = c[4] <= m[4] <= c[5] if not compat else m[5] is not None and c[5] < m[5] < c[5] + 100 and c[1] in m[6]
                if inside:
                    want.add((c[0], m[0]))
    got = [(r["source"], r["target"]) for r in N.containment_edges(df, compat).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_top_k_of_blocks(spark, monkeypatch, metric):
    """Against brute force: equal vectors (ties go to the smallest id), nulls, other lengths, several blocks."""
    monkeypatch.setattr(V, "BLOCK_BYTES", 8 * 3 * 7)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)] + [(90, None), (91, [1.0]), (92, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def score(x, y):
        if metric == "l2":
            return 1 - sum((a - b) ** 2 for a, b in zip(x, y))
        return sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)

    want = []
    for i, x in rows[:90:20]:
        best = sorted((-round(score(x, y), 9), j) for j, y in rows[:90] if j != i)[:5]
        want += [(i, j, -s, r) for r, (s, j) in enumerate(best, 1)]
    got = [(r["query_id"], r["vec_id"], round(r["score"], 9), r["rank"]) for r in V.top_k_batch(df, df.where("vec_id % 20 = 0 and vec_id < 90"), metric=metric).collect()]
    assert sorted(got) == sorted(want)


def test_directories_and_renames(spark):
    ten = "\n".join(f"line {i}" for i in range(9))
    old = spark.createDataFrame([("same", "x\n"), ("gone", "alpha"), ("from", ten), ("mod", "a\nb\nc"), ("pic.png", "abc"), ("ws", " a ")], "path string, content string")
    new = spark.createDataFrame([("same", "x\n"), ("plus", "beta\ngamma"), ("to", ten + "\nline 9"), ("mod", "a\nB\nc"), ("pic.png", "xyz"), ("ws", "a")], "path string, content string")
    got = {r["path"]: (r["status"], r["old_path"]) for r in D.compare_directories(old, new, ignore_whitespace=True).collect()}
    assert got == {"same": ("Unchanged", None), "gone": ("Deleted", None), "to": ("Renamed", "from"), "plus": ("Added", None), "mod": ("Modified", None), "pic.png": ("Unchanged", None), "ws": ("Unchanged", None)}
    s = D.diff_summary(D.compare_directories(old, new, detect_renames=False)).first()
    assert (s["added"], s["deleted"], s["modified"], s["insertions"], s["deletions"]) == (2, 2, 2, 2 + 10 + 1 + 1, 1 + 9 + 1 + 1)


def test_rename_band(spark):
    base = "\n".join(f"l{i}" for i in range(10))
    a = spark.createDataFrame([("y", base)], "path string, content string")
    assert D.renames(a, spark.createDataFrame([("x", base + "\n" + "z" * 30)], "path string, content string")).count() == 0
    assert D.renames(a, spark.createDataFrame([("x", base), ("w", base)], "path string, content string")).first()["old_path"] == "w"
    assert D.renames(a, spark.createDataFrame([("x", "")], "path string, content string")).count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([("f", "\n".join("x" for _ in range(460)))], "path string, content string")
    assert [(r["start_line"], r["end_line"]) for r in W.line_chunks(df, "path", "content").orderBy("start_line").collect()] == [(1, 460), (451, 460)]


def test_severities(spark):
    df = spark.createDataFrame([(s,) for s in ("Critical", "high", "HIGH", "info", "weird", None)], "severity string")
    assert {r[0]: r[1] for r in G.severity_counts(df).collect()} == {"critical": 1, "high": 2, "medium": 0, "low": 0, "info": 1}
    assert {r[0]: r[1] for r in G.open_severity_counts(df).collect()} == {"critical": 1, "high": 2, "info": 2, "weird": 1}
    assert G.audit_counters(df.selectExpr("false as verified", "0.5 as confidence").limit(0)).first()["false_positive_rate"] is None


def test_upsert(spark):
    df = spark.createDataFrame([("1", "a", 1, "old", 1), ("2", "a", 1, "new", 2), ("3", "a", 2, "x", 3), ("3", "a", 2, "y", 4)], "id string, audit_id string, sequence long, v string, arrival int")
    assert sorted((r["sequence"], r["v"]) for r in K.upsert_events(df).collect()) == [(1, "new"), (2, "y")]


def test_compression(spark):
    rows = [(1, i, "system" if i == 1 else "user", f"请检查 {i}") for i in range(6)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.compress(df, 4).orderBy("conv_id", "part", "turn").collect()
    assert [(r["conv_id"], r["part"], r["turn"]) for r in got] == [(1, 0, 1), (1, 1, None), (1, 2, 4), (1, 2, 5), (2, 2, 0)]
    assert got[1]["text"].startswith("[summary of 4 messages]") and "请检查 3" in got[1]["text"]


def test_confidence(spark):
    df = spark.createDataFrame([("exploit success error", 0), ("x" * 250 + " error", 1), (None, None)], "output string, exit_code int")
    assert [(r["verified"], round(r["confidence"], 6)) for r in C.analysed(df).collect()] == [(True, 0.6), (False, 0.5), (False, 0.5)]


def test_handoff_and_enrichment(spark):
    kind = "from_agent string, to_agent string, summary string, work_completed array<string>, key_findings array<struct<title:string,type:string,severity:string>>, insights array<string>, attention_points array<string>, priority_areas array<string>"
    df = spark.createDataFrame([("recon", "audit", "done", ["a"], [("T", "xss", "high")], [], ["p"], [])], kind)
    text = C.handoff_text(df).first()["text"]
    assert "- a" in text and "**1. T**" in text and "⚠️ p" in text and "分析洞察" not in text
    assert C.enrich(spark.range(3), lambda rows: [{"id": r["id"], "said": f"<{r['id']}>"} for r in rows], "id long, said string").count() == 3


def test_recon(spark):
    df = spark.createDataFrame([("src/LoginController.java",), ("package.json",), ("x.tsx",)], "path string")
    assert {(r["file"], r["type"]) for r in R.attack_surface(df).collect()} == {("src/LoginController.java", "web_route"), ("src/LoginController.java", "auth")}
    assert tuple(R.tech_stack(df).first()) == (["Java", "TypeScript"], ["Node.js"])
    names = spark.createDataFrame([("SQLi",), ("weird thing",)], "vuln_type string")
    assert R.relevant_modules(names, spark.createDataFrame([("sql_injection",)], "module string")).count() == 1


EMPLOYEES = [("1", "Pat", "10", None), ("2", "Lee", "9", "x"), ("10", "Fay", None, "y")]


def test_dsl(spark):
    df = spark.createDataFrame([(*r, {"k": r[1]} if r[3] else {}) for r in EMPLOYEES], "id string, name string, salary string, boss string, labels map<string,string>")

    def ids(cond):
        return sorted(r["id"] for r in df.where(cond).collect())

    assert ids(Q.less("salary", "10")) == ["2"] and ids(Q.less("salary", "10", True)) == ["1", "2"]
    assert ids(Q.between("id", "2", "10")) == ["10", "2"] and ids(Q.between("id", "2", "10", False, False)) == []
    assert ids(Q.is_null("boss")) == ["1"] and ids(Q.all_rows("salary")) == ["1", "2"] and ids(Q.all_rows()) == ["1", "10", "2"]
    assert ids(Q.negated(Q.one_of("name", "Pat", "Lee"))) == ["10"] and ids(Q.one_of("name")) == []
    assert ids(Q.greater_field("salary", "id")) == ["1", "2"] and ids(Q.equal_field("id", "salary")) == []
    assert ids(Q.contains("name", "a")) == ["1", "10"] and ids(Q.ends_with("name", "e")) == ["2"]
    assert ids(Q.label("k=(Lee,Fay)")) == ["10", "2"] and ids(Q.label("k!=Lee")) == ["1", "10"] and ids(Q.label("!k")) == ["1"] and ids(Q.label("k")) == ["10", "2"]
    assert [r["id"] for r in Q.ordered(df, "salary").collect()] == ["2", "1", "10"]
    assert [r["id"] for r in Q.ordered(df, "-salary").collect()] == ["10", "1", "2"]
    rows, total = Q.retrieve(df, Q.all_rows(), "id", page=2, size=2)
    assert [r["id"] for r in rows.collect()] == ["10"] and total.first()[0] == 3


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "py"), (2, [0.0, 1.0], "py"), (3, [1.0, 1.0], "js")], "vec_id long, embedding array<double>, label string")
    assert [r["vec_id"] for r in V.top_k(df, [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r["vec_id"] for r in V.top_k(df, [1.0, 0.1], 2, keep=F.col("label") == "py").collect()] == [1, 2]
    assert V.top_k(df, [1.0, 0.0], 1, "l2").first()["score"] == 1.0
    hits = V.top_k(df, [1.0, 0.0], 2).withColumn("text", F.lpad(F.col("vec_id").cast("string"), 300, "z"))
    assert len(V.context_text(hits).first()[0]) == 402


JAVA = """package a.b;
import x.Y;
/* class Fake { } */
public final class Shop extends Base implements One, Two<Q> {
    private static final int LIMIT = 3;
    Map<String, Integer> seen = new HashMap<>();
    @Override
    public int total(List<Item> items) throws E {
        for (Item i : items) { sum(i.price()); }
        return this.cart.size();
    }
    interface Inner { void go(); }
}
"""


def test_java_symbols():
    got = [(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in Y.symbols_of("Shop.java", JAVA)]
    assert got == [("Class", "Shop", 4, 13), ("Method", "total", 7, 11), ("MethodCall", "sum", 9, 9), ("MethodCall", "price", 9, 9), ("MethodCall", "size", 10, 10), ("Interface", "Inner", 12, 12), ("Method", "go", 12, 12)]
    top = Y.symbols_of("Shop.java", JAVA)[0]
    assert top["parent_classes"] == ["Base", "One", "Two<Q>"] and top["package"] == "a.b" and top["modifiers"] == ["public", "final"]
    assert [(f["name"], f["field_type"], f["start_line"]) for f in top["fields"]] == [("LIMIT", "int", 5), ("seen", "Map<String, Integer>", 6)]
    call = Y.symbols_of("Shop.java", JAVA)[2]
    assert call["metadata"] == {"callerClass": "Shop", "callerMethod": "total"}


def test_other_languages():
    py = Y.symbols_of("a.py", "class A:\n    def f(self):\n        g(1).h()\n\ndef top():\n    pass\n")
    assert [(s["kind"], s["name"]) for s in py] == [("Class", "A"), ("Method", "f"), ("MethodCall", "h"), ("MethodCall", "g"), ("Function", "top")]
    rs = Y.symbols_of("a.rs", "struct P { x: i32 }\nfn main() -> i32 {\n    foo::bar(1);\n    s.baz()\n}\n")
    assert [(s["kind"], s["name"]) for s in rs] == [("Struct", "P"), ("Function", "main"), ("MethodCall", "bar"), ("MethodCall", "baz")]
    ts = Y.symbols_of("a.ts", "class K {\n  run(a: number): void { this.go?.stop(a); }\n}\nfunction free() { if (x) { console.log('call()'); } }\n")
    assert [(s["kind"], s["name"]) for s in ts] == [("Class", "K"), ("Method", "run"), ("MethodCall", "stop"), ("Function", "free"), ("MethodCall", "log")]
    assert Y.symbols_of("a.go", "func f() {}") == [] and Y.symbols_of("a.py", "def (") == []
    with pytest.raises(ValueError):
        Y.symbols_of("a.txt", "")
    assert len(Y.symbols_of("a.java", "class A { " + "int x; " * 200 + "}")[0]["code"]) == 503


def test_scalars(spark):
    assert one(spark, S.callee_name(F.col("t")), t="a::b->c?.d") == "d"
    assert one(spark, S.truncated(F.col("t"), 2), t="日本語") == "日本..."
    assert one(spark, S.template_variables(F.col("t")), t="{{a}} {{ b }} {{a}}") == ["a", "b"]
    assert one(spark, S.substituted(F.col("t"), {"x": F.lit("1")}), t="{{x}} ${x} {x}") == "1 1 1"
    assert one(spark, S.fenced_code(F.col("t")), t="hi\n```python\nx = 1\n```\nend") == "x = 1"
    assert one(spark, S.first_json_object(F.col("t")), t='a {"k": 1} b') == '{"k": 1}'
    assert one(spark, S.finding_language(F.col("t")), t="a/b.RB") == "ruby"
    assert one(spark, S.is_binary(F.col("t"), F.lit(bytearray(b"a\x00b"))), t="a.txt") is True
    assert one(spark, S.is_binary(F.col("t"), F.lit(bytearray(b"ab"))), t="a.PNG") is True


def test_filters(spark):
    m = spark.createDataFrame([("a", "b", 1), ("c", "a", 2), ("c", "d", 3)], "sender string, recipient string, timestamp int")
    assert P.message_history(m, "a").count() == 2
    nodes = spark.createDataFrame([("Foo", None), ("x", "foobar"), ("y", "z")], "label string, original_label string")
    assert [r["highlighted"] for r in P.highlighted(nodes, "FOO").collect()] == [True, True, False]
    paths = spark.createDataFrame([("src/a.py",), ("b+c.js",)], "p string")
    assert [paths.where(P.path_matches(F.col("p"), x)).count() for x in ("src/*.py", "b+*", "a.p", "*")] == [1, 1, 1, 2]


def test_scanner_registry(spark):
    df = files(spark, ("a.py", "TODO: x\npassword = 'abc'"))
    scanners = X.Scanners(lines=X.scan_lines)
    scanners.register("rules", lambda f: X.scan_content(f, PASSWORD))
    found = scanners.scan(df)
    assert Counter(r["detector"] for r in found.collect()) == {"RegexScanner": 2, "RegexRule: no-hardcoded-passwords": 1}
    with pytest.raises(ValueError):
        X.Scanners().scan(df)


def test_sql_functions(spark):
    from auditlake.functions import sql

    sql.register(spark)
    df = files(spark, ("a.py", "def f():\n    g()\n"))
    got = spark.sql("SELECT s.kind, s.name FROM {f} f, LATERAL extract_symbols(f.path, f.content) s", f=df).collect()
    assert sorted(map(tuple, got)) == [("Function", "f"), ("MethodCall", "g")]
    assert tuple(spark.sql("SELECT severity_rank('HIGH'), callee_name('a::b->c'), length(snapshot_key('x')), file_extension('p/q.tar.gz')").first()) == (2, "c", 16, "gz")


def test_first_symbols_of_ties_are_repeatable(spark):
    rows = [(f"N{i % 2}", "Class", "f", 1, {"k": str(i)}, i) for i in range(40)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, kind string, file_path string, start_line bigint, metadata map<string,string>, pk bigint")
    for parts in (1, 7):
        assert [r["pk"] for r in T.first_symbols(df.repartition(parts), 25).collect()] == [*range(0, 40, 2), *range(1, 10, 2)]


def test_patterns_without_restarts(spark):
    """The same marks as by the pattern as it is written, on lines of its pieces; and lines of many pieces end."""
    patterns = [
        r"(?i)(logger\.|log\.|print).*\+.*request|.*log.*\+.*user|.*log.*\+.*input", r"a.*b.*\+.*c|.*b|x", r".*a+.*b.*c", r"a|.*b.*c\s+x|b.*", r"(a|ab).*b.*(c|cc)|.*x.*\|.*a", r"[.*]x.*a.*\.\*|.*a.*x\nb",
    ]
    pieces = ["log", "LOG.", "+", "user", "input", "print", "request", "a", "b", "c", "x", "|", ".*", " ", "\n", "\r"]
    rng = random.Random(5)
    texts = spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randrange(30))),) for _ in range(600)], "t string")
    for p in patterns:
        assert X.without_restarts(p) != p
        row = texts.agg(F.count_if(F.col("t").rlike("(?dU)" + p)), F.count_if(F.regexp_replace("t", f"((?dU){p})", "<$1>") != F.regexp_replace("t", f"({X.java_pattern(p)})", "<$1>"))).first()
        assert row[0] >= 5 and row[1] == 0
    assert X.without_restarts(r"(?s).*a.*b.*c") == r"(?s).*a.*b.*c" and X.without_restarts(r".*a.*b.*c|d*") == r".*a.*b.*c|d*"
    began = time.time()
    long = spark.createDataFrame([("log + " * 20_000,)], "t string")
    assert not long.where(F.col("t").rlike(X.java_pattern(patterns[0]))).count() and time.time() - began < 30


def test_calls_after_long_literals(spark):
    """A literal or comment of any length is passed over, and a rule is not run on files of other languages."""
    body = 'x = "' + r"\"eval(0)" * 20_000 + '"\n' + "/* eval(1) * / " + "**eval(2)" * 20_000 + " **/ eval(3)\n'" + r"\\" * 20_000 + "' // eval(4)\neval(5) /* eval(6)"
    rule = {"id": "e", "name": "e", "description": "", "severity": "high", "language": "all", "cwe": None, "query": '(call_expression function: (identifier) @f (#eq? @f "eval"))'}
    found = X.scan_content(files(spark, ("a.js", body)), [rule]).select("line_start").collect()
    assert [r[0] for r in found] == [2, 4]


def spread(df, parts=8):
    """Rows by task: no task of many has a quarter of them."""
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(rows) >= parts and max(rows) * 4 <= sum(rows)


def one_name(spark, n):
    rows = [(f"s{i}", "N", "Class" if i % 2 else "Method", "f", 1 + i % 3, 1 + i % 3 + 9 * (i % 2), "n(N)", "p", ["N"], {"callerMethod": "N"}) for i in range(n)]
    return spark.createDataFrame(rows, "id string, name string, kind string, file_path string, start_line bigint, end_line bigint, code string, package string, parent_classes array<string>, metadata map<string,string>")


@pytest.mark.parametrize("compat", [False, True])
def test_containment_of_one_cell_is_spread(spark, monkeypatch, compat):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = one_name(spark, 400)
    if compat:
        rows = rows.withColumn("end_line", F.when(F.col("kind") == "Class", 4).otherwise(5).cast("long"))
    edges = N.containment_edges(rows, compat)
    want = sum(compat or 1 + i % 3 <= 1 + j % 3 for i in range(1, 400, 2) for j in range(0, 400, 2))
    assert edges.count() == edges.distinct().count() == want and spread(edges)


def test_inheritance_of_one_name_is_spread(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    edges = N.inheritance_edges(one_name(spark, 200))
    assert edges.count() == edges.distinct().count() == 100 * 200 and spread(edges)


def test_call_edges_of_one_name_are_spread(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = one_name(spark, 200)
    edges = N.site_edges(rows.withColumn("kind", F.lit("MethodCall")))
    assert edges.count() == edges.distinct().count() == 200 * 200 and spread(edges)
    edges = N.textual_call_edges(rows.withColumn("code", F.lit("M(x)")).unionByName(one_name(spark, 99).withColumn("id", F.concat(F.lit("t"), "id")).withColumn("name", F.lit("M")).withColumn("kind", F.lit("Struct"))))
    assert edges.count() == edges.distinct().count() == 100 * 99 and spread(edges)


def test_diff_lines_leave_some_texts_at_a_time():
    texts = [None if i % 9 == 0 else "\n".join(f"{i * j % 7}" for j in range(i % 5)) for i in range(300)]
    left, right = pa.array(texts, pa.string()), pa.array(texts[::-1], pa.string())
    pieces = list(D.diff_batches(iter([(left, right)])))
    assert max(map(len, pieces)) <= D.DIFF_TEXTS < 300
    for x, y, got in zip(texts, texts[::-1], [d for p in pieces for d in p.to_pylist()], strict=True):
        p, q = (x or "").splitlines(), (y or "").splitlines()
        want = [(k, i if i is None else i + 1, j if j is None else j + 1, q[j] if i is None else p[i]) for k, i, j in D.shortest_edit(p, q)]
        assert [tuple(r.values()) for r in got] == want


def test_symbols_of_one_partition_are_spread(spark):
    df = files(spark, *((f"f{i}.rs", f"struct S{i} {{ n: u32 }}\nfn f() {{ g() }}\n") for i in range(400))).coalesce(1)
    found = Y.extract_symbols(df)
    assert spread(found)
    assert Counter(r["name"] for r in found.collect()) == {f"S{i}": 1 for i in range(400)} | {"f": 400, "g": 400}


def test_pairs_of_blocks_leave_one_by_one():
    """Python holds what is found in one pair of blocks, not in all pairs of a batch."""
    ids, data = [1, 2, 3], [0.0, 0.0, 1.0, 0.0, 0.0, 2.0]
    side = {"ids": pa.array([ids] * 4, pa.list_(pa.int64())), "data": pa.array([struct.pack("6d", *data)] * 4), "dim": pa.array([2] * 4, pa.int32())}
    batch = pa.RecordBatch.from_pydict({f"{s}_{k}": v for s in "rq" for k, v in side.items()})
    out = list(V._best_of_blocks(1, "l2")(iter([batch])))
    assert [sorted(zip(*b.to_pydict().values(), strict=True)) for b in out] == [[(1, 2, 0.0), (2, 1, 0.0), (3, 1, -3.0)]] * 4
