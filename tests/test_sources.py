import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import diff as D
from auditlake.operators import dml as K
from auditlake.sources import files as SF
from auditlake.sources import rules as SR


@pytest.fixture
def project(tmp_path):
    for name, data in {
        "src/a.py": b"x = 1\n", "src/b.txt": b"no", ".hidden/c.py": b"1", "node_modules/d.js": b"1", "build/e.js": b"1", "bad.py": b"\xff\xfe\xfa", "README.md": b"# r", "skip/f.ts": b"1",
    }.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "p")


def names(df):
    return sorted(r["path"] for r in df.collect())


def test_project_scan(spark, project):
    files = SF.read_files(spark, project)
    assert "bad.py" not in names(files)
    assert names(SF.scan_project(files, SF.ignore_patterns("# c\n\nskip/\n/node_modules\n!keep\n"))) == ["build/e.js", "src/a.py"]
    assert names(SF.walk(files)) == ["README.md", "skip/f.ts", "src/a.py", "src/b.txt"]
    assert names(SF.walk(files, include=["src"])) == ["src/a.py", "src/b.txt"]
    assert names(SF.listing(files)) == ["README.md", "build/e.js", "skip/f.ts", "src/a.py", "src/b.txt"]
    assert names(SF.search_names(files, "A.P")) == ["src/a.py"]
    assert SF.read_file(files, "src/a.py").first()["content"] == "x = 1\n"


def test_archives(tmp_path):
    archive = tmp_path / "u.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a/b.py", "1")
        z.writestr("../evil.py", "1")
    assert SF.extract_zip(str(archive), str(tmp_path / "out")) == ["a/b.py"]
    assert not (tmp_path / "evil.py").exists()
    with pytest.raises(ValueError):
        SF.extract_zip("x.tar", str(tmp_path))
    assert SF.store_loose({"x/y.py": b"1", "/etc/z": b"", "../q": b""}, str(tmp_path / "loose")) == ["x/y.py"]


def test_snapshots_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a.py", 5, "s")], "path string, mtime long, name string")
    key = SF.save_snapshot(df, str(tmp_path), "/repo/x")
    assert len(key) == 16 and SF.load_snapshot(spark, str(tmp_path), "/repo/x").count() == 1
    files = spark.createDataFrame([("a.py", 5), ("b.py", 5)], "path string, mtime long")
    assert names(K.changed_files(files, df)) == ["b.py"]
    assert names(K.changed_files(files.withColumn("mtime", F.lit(6).cast("long")), df)) == ["a.py", "b.py"]
    SF.save_report(df, str(tmp_path / "r"))
    assert SF.load_report(spark, str(tmp_path / "r")).first()["name"] == "s"


def test_rules_folder(tmp_path):
    pytest.importorskip("yaml")
    path = SR.save_rule(str(tmp_path), {"id": "one", "name": "n", "severity": "low", "language": "all", "pattern": "a: [b] #c'\""})
    (tmp_path / "set.yaml").write_text("name: s\nrules:\n  - {id: two, name: n, severity: high, language: java, pattern: x}\n")
    (tmp_path / "junk.yaml").write_text("just: text\n")
    rules, skipped = SR.load_rules(str(tmp_path))
    assert [r["id"] for r in rules] == ["one", "two"] and skipped == ["junk.yaml"] and path.endswith("one.yaml")
    assert rules[0]["pattern"] == "a: [b] #c'\""
    assert SR.delete_rule(str(tmp_path), "one") and not SR.delete_rule(str(tmp_path), "../x")
    with pytest.raises(ValueError):
        SR.save_rule(str(tmp_path), {"id": "../x", "name": "", "severity": "", "language": ""})


def test_git(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    body = "\n".join(map(str, range(30)))
    (tmp_path / "a.txt").write_text(body)
    (tmp_path / "b.txt").write_text("one\n")
    git("add", ".")
    git("commit", "-qm", "1")
    git("tag", "v1")
    (tmp_path / "a.txt").rename(tmp_path / "moved.txt")
    (tmp_path / "b.txt").write_text("two\n")
    git("add", "-A")
    git("commit", "-qm", "2")
    changes = SF.git_changes(spark, str(tmp_path), "v1", "main")
    assert sorted(map(tuple, changes.collect())) == [("M", "b.txt", None), ("R", "moved.txt", "a.txt")]
    assert sorted(map(tuple, SF.git_refs(spark, str(tmp_path)).collect())) == [("branch", "main"), ("tag", "v1")]
    assert SF.git_file(str(tmp_path), "v1", "b.txt") == "one\n" and SF.git_commit_time(str(tmp_path), "main") > 0
    old = spark.createDataFrame([("a.txt", body), ("b.txt", "one\n")], "path string, content string")
    new = spark.createDataFrame([("moved.txt", body), ("b.txt", "two\n")], "path string, content string")
    kinds = {r["path"]: {x["kind"] for x in r["lines"]} for r in D.compare_changes(changes, old, new).collect()}
    assert kinds == {"moved.txt": {"Equal"}, "b.txt": {"Delete", "Insert"}}


def test_knowledge_modules(spark):
    df = spark.createDataFrame([("kb/vulns/SQL-Injection.md", "deep"), ("kb/sql injection.md", "near"), ("kb/x.txt", "")], "path string, content string")
    assert [tuple(r) for r in SF.knowledge_modules(df).collect()] == [("sql_injection", "kb/sql injection.md", "near")]


def test_table_rewrites(spark):
    t = spark.createDataFrame([(1, 7, 1), (2, 8, 2)], "id long, project_id long, created_at int")
    out = K.delete_project({"symbols": t, "projects": t}, 7)
    assert out["symbols"].count() == 1 and out["projects"].count() == 2
    graphs = spark.createDataFrame([(1, '{"nodes": [{"id": 1}], "edges": [{"from": "a", "to": "b", "file": "f", "line": 3}, {"from": "", "to": "c"}]}')], "id long, data string")
    assert [tuple(r) for r in K.graph_relations(graphs).collect()] == [(1, "a", "b", "f", 3)]
    symbols = spark.createDataFrame([(1, "old"), (2, "new")], "index_id long, name string")
    indices = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 6, 9)], "id long, project_id long, created_at int")
    assert [r["name"] for r in K.latest_index(spark, indices, symbols, 5).collect()] == ["new"]
    assert [r["is_default"] for r in K.one_default(t, 2).orderBy("id").collect()] == [False, True]
    assert K.set_status(t.withColumn("audit_id", F.col("id")).withColumn("status", F.lit("x")), 1, "done").where("status = 'done'").count() == 1


def test_shared_folder(spark):
    from auditlake.plans.tables import shared_dir, stored

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert stored(df, "t").collect() == df.collect()

    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        sparkContext = spark.sparkContext

    own = shared_dir(Unset)
    assert own == shared_dir(Unset) and own != shared_dir(spark)
