"""Queries over whole tables: no row is left out before or after the operator."""

from auditlake.plans import coverage, registry  # noqa: F401


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_edge_handles_takes_every_line_item(spark, sf_dir):
    rows = registry.QUERIES["edge_handles"](spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "lineitem").count()
    assert {r["source_handle"] for r in rows} >= {"left", "right"} and all(r["source_handle"] for r in rows)


def test_lines_of_files_of_every_extension(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}

    def doc_id(path):
        return int(path.rsplit("/", 1)[1].split(".")[0])

    got = {doc_id(r["path"]): r["n"] for r in registry.QUERIES["whole_file_lines"](spark, sf_dir).collect()}
    assert got == {k: len(t.removesuffix("\n").split("\n")) for k, t in texts.items() if t}
    got = {doc_id(r["file"]): r["n"] for r in registry.QUERIES["manifest_lines"](spark, sf_dir).collect()}
    want = {k: sum(bool(x.strip()) and not x.strip().startswith("#") for x in t.split("\n")) for k, t in texts.items()}
    assert got == {k: n for k, n in want.items() if n}


def test_git_changes_of_differing_sides(spark, sf_dir):
    """Each text against brute force: paths of both sides, of one, carriage returns and all extensions."""
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    old = {k // 2: t for k, t in texts.items() if k % 2 == 0}
    new = {k // 2 + k // 200: t for k, t in texts.items() if k % 2 == 1}
    want = {}
    for k in old.keys() | new.keys():
        if old.get(k) == new.get(k):
            continue
        a, b = (old.get(k) or "").splitlines(), (new.get(k) or "").splitlines()
        same = longest_common(a, b)
        want[f"d/{k}"] = ("D" if k not in new else "A" if k not in old else "M", same, len(b) - same, len(a) - same)
    got = {r["path"]: tuple(r)[1:] for r in registry.QUERIES["git_change_sides"](spark, sf_dir).collect()}
    assert got == want
    assert sum(x[2] for x in got.values()) and sum(x[3] for x in got.values())


def test_directory_summary_counts_lines_and_renames(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    old = {k // 2: t for k, t in texts.items() if k % 2 == 0}
    new = {k // 2 + k // 200: t for k, t in texts.items() if k % 2 == 1}

    def line_list(text):
        return [x.removesuffix("\r") for x in text.split("\n")] if not text.endswith("\n") and text else [x.removesuffix("\r") for x in text.split("\n")[:-1]]

    def alike(x, y):
        n, m = len(x.encode()), len(y.encode())
        p, q = ({z.strip(" ") for z in t.split("\n")} - {""} for t in (x, y))
        return abs(n - m) <= 0.2 * max(n, m) and p and q and len(p & q) >= 0.8 * len(p | q)

    def rank(x, y):
        p, q = ({z.strip(" ") for z in t.split("\n")} - {""} for t in (x, y))
        return -len(p & q) / len(p | q)

    added, deleted = new.keys() - old.keys(), old.keys() - new.keys()
    claims = {k: min((rank(new[k], old[d]), f"d/{d}") for d in found)[1] for k in added if (found := [d for d in deleted if alike(new[k], old[d])])}
    gone = [d for d in deleted if f"d/{d}" not in claims.values()]
    want = dict(added=len(added) - len(claims), deleted=len(gone), renamed=len(claims), modified=0, unchanged=0, insertions=0, deletions=0)
    want["insertions"] = sum(len(line_list(new[k])) for k in added if k not in claims)
    want["deletions"] = sum(len(line_list(old[k])) for k in gone)
    for k in old.keys() & new.keys():
        a, b = line_list(old[k]), line_list(new[k])
        same = longest_common(a, b)
        want["unchanged" if a == b else "modified"] += 1
        want["insertions"] += len(b) - same
        want["deletions"] += len(a) - same
    want["files"] = len(added) + len(gone) + len(old.keys() & new.keys())
    assert registry.QUERIES["directory_diff_summary"](spark, sf_dir).first().asDict() == want
    assert want["modified"] and want["insertions"] and want["deletions"]


def test_call_graph_emits_every_call_site(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").collect()
    sites = [(f"f{r[0] % 500}", f"f{r[1] * 13 % 500}", f"src/{r[2]}", r[3]) for r in items]
    level = {"f1": 0}
    for depth in range(2):
        for caller, callee, _, _ in sites:
            if level.get(caller) == depth:
                level.setdefault(callee, depth + 1)
    edges = sorted(map(tuple, registry.QUERIES["call_graph_edges"](spark, sf_dir).select("caller", "callee", "file", "line", "level").collect()))
    assert edges == sorted((*x, level[x[0]]) for x in sites if level.get(x[0], 2) < 2)
    assert {line for *_, line, _ in edges} > {1}
    assert {r["node"] for r in registry.QUERIES["call_graph_nodes"](spark, sf_dir).collect()} == set(level)


def test_severity_order_is_whole(spark, sf_dir):
    rows = registry.QUERIES["severity_sorted"](spark, sf_dir).collect()
    orders = {r["o_orderkey"]: r["o_orderdate"] for r in table(spark, sf_dir, "orders").collect()}
    assert len(rows) == len(orders) > 100 and {r["finding_id"] for r in rows} == set(orders)
    place = [(r["rank"], -orders[r["finding_id"]].toordinal(), r["finding_id"]) for r in rows]
    assert place == sorted(place) and {r["rank"] for r in rows} == set(range(1, 7))
