"""Reconnaissance over file tables: technology, attack surface, dependencies, knowledge modules, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalar as S

# File endings and their languages; path parts and their frameworks.
LANGUAGE_ENDINGS = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript", ".java": "Java", ".go": "Go", ".rs": "Rust", ".php": "PHP", ".rb": "Ruby", ".cs": "C#", ".cpp": "C++", ".c": "C"}
FRAMEWORK_PARTS = {"package.json": "Node.js", "requirements.txt": "Python/Pip", "Pipfile": "Python/Pip", "pyproject.toml": "Python/Pip", "pom.xml": "Java/Maven", "build.gradle": "Java/Gradle", "Cargo.toml": "Rust/Cargo", "go.mod": "Go/Module", "composer.json": "PHP/Composer", "Gemfile": "Ruby/Bundler"}
# Attack-surface types, the path words that tell them, and their severities.
SURFACES = {
    "web_route": ("route", "controller", "handler", "api", "view"), "user_input": ("form", "input", "upload", "submit"),
    "database": ("model", "query", "database", "db", "sql"), "auth": ("auth", "login", "permission", "access"),
    "file_operation": ("file", "fs", "io", "upload", "download"), "command_execution": ("exec", "spawn", "shell", "command", "system"),
}
SURFACE_SEVERITIES = {"auth": "high", "command_execution": "high"}
# Aliases of vulnerability types.
ALIASES = {
    "sqli": "sql_injection", "sql injection": "sql_injection", "sql": "sql_injection", "xss": "xss", "cross_site_scripting": "xss",
    "cross site scripting": "xss", "csrf": "csrf", "ssrf": "ssrf", "path_traversal": "path_traversal", "directory traversal": "path_traversal",
    "lfi": "path_traversal", "rfi": "path_traversal", "command_injection": "command_injection", "rce": "command_injection",
    "remote code execution": "command_injection", "xxe": "xxe", "deserialization": "insecure_deserialization",
    "insecure deserialization": "insecure_deserialization", "auth": "authentication", "authentication": "authentication",
    "authorization": "authorization", "idor": "insecure_direct_object_reference",
}
# Stand-ins of manifests that are not parsed.
MANIFEST_STUBS = {"pom.xml": ("maven-project", "maven"), "cargo.toml": ("rust-project", "crates.io"), "go.mod": ("go-project", "go")}


def tech_stack(files: DataFrame) -> DataFrame:
    """One row: sorted distinct languages and frameworks of a file table."""
    langs = F.array_compact(F.array(*(F.when(F.endswith("path", F.lit(e)), F.lit(v)) for e, v in LANGUAGE_ENDINGS.items())))
    works = F.array_compact(F.array(*(F.when(F.contains("path", F.lit(p)), F.lit(v)) for p, v in FRAMEWORK_PARTS.items())))
    sets = files.select(langs.alias("l"), works.alias("f")).agg(F.flatten(F.collect_set("l")).alias("l"), F.flatten(F.collect_set("f")).alias("f"))
    return sets.select(F.array_sort(F.array_distinct("l")).alias("languages"), F.array_sort(F.array_distinct("f")).alias("frameworks"))


def attack_surface(files: DataFrame, path: str = "path") -> DataFrame:
    """(file, type, severity): every surface type whose words the path holds."""
    low = F.lower(F.col(path))

    def hit(words: tuple[str, ...]) -> Column:
        some = F.lit(False)
        for w in words:
            some |= F.contains(low, F.lit(w))
        return some

    found = F.array_compact(F.array(*(F.when(hit(words), F.struct(F.lit(t).alias("type"), F.lit(SURFACE_SEVERITIES.get(t)).cast("string").alias("severity"))) for t, words in SURFACES.items())))
    return files.select(F.col(path).alias("file"), F.explode(found).alias("s")).select("file", "s.type", "s.severity")


def dependencies(files: DataFrame) -> DataFrame:
    """(file, name, version, type, ecosystem) of dependency manifests."""
    name = F.lower(S.basename(F.col("path")))
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    npm = files.where(name == "package.json").select(F.col("path").alias("file"), parsed.alias("p"))
    prod = npm.select("file", F.explode("p.dependencies").alias("name", "version"), F.lit("production").alias("type"))
    dev = npm.select("file", "p.dependencies", F.explode("p.devDependencies").alias("name", "version"))
    kind = F.when(F.coalesce(F.map_contains_key("dependencies", F.col("name")), F.lit(False)), "production").otherwise("development")
    npm = prod.unionByName(dev.select("file", "name", "version", kind.alias("type"))).withColumn("ecosystem", F.lit("npm"))
    lines = files.where(name == "requirements.txt").select(F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = lines.where("line <> '' and line not like '#%'")
    cut = F.when(F.contains("line", F.lit(">=")), F.substring_index("line", ">=", 1)).when(F.contains("line", F.lit("==")), F.substring_index("line", "==", 1)).when(F.contains("line", F.lit("~")), F.substring_index("line", "~", 1)).otherwise(F.col("line"))
    version = F.trim(F.substring(F.col("line"), F.length(cut) + 1, F.length("line")))
    pip = lines.select("file", F.trim(cut).alias("name"), F.when(version == "", "unknown").otherwise(version).alias("version"), F.lit("production").alias("type"), F.lit("pypi").alias("ecosystem"))
    stub = F.lit(None).cast("struct<n:string,e:string>")
    for manifest, (project, ecosystem) in MANIFEST_STUBS.items():
        stub = F.when(name == manifest, F.struct(F.lit(project).alias("n"), F.lit(ecosystem).alias("e"))).otherwise(stub)
    rest = files.select(F.col("path").alias("file"), stub.alias("s")).where("s is not null").select("file", F.col("s.n").alias("name"), F.lit("unknown").alias("version"), F.lit("production").alias("type"), F.col("s.e").alias("ecosystem"))
    return npm.unionByName(pip).unionByName(rest)


def normal_vulnerability(name: Column) -> Column:
    """The standard name of a vulnerability type: an alias's, else snake case."""
    key = F.trim(F.lower(name))
    return F.coalesce(F.try_element_at(S.literal_map(ALIASES), key), F.translate(key, " -", "__"))


def relevant_modules(names: DataFrame, modules: DataFrame, column: str = "vuln_type") -> DataFrame:
    """Names that have a knowledge module."""
    keyed = names.withColumn("module", normal_vulnerability(F.col(column)))
    return keyed.join(modules.select("module"), "module", "left_semi")
