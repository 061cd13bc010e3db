"""File sources and sinks: project scans, listings, archives, snapshots, reports, git refs, knowledge modules."""

from __future__ import annotations

import fnmatch
import subprocess
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import scalar as S

# Directory names that listings leave out, and path parts that scans leave out.
LISTING_SKIPS = ("node_modules", "target", "__pycache__", "dist")
SCAN_SKIPS = ("node_modules", "target", ".git", "dist", "build", "__pycache__", "vendor")
MAX_UPLOAD = 1 << 30


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """files(path, ext, content, size, mtime): all files below root that hold UTF-8 text; path is relative to root.

    Files without content hold nothing to scan and are left out by the file source.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.col("path"), "^(?:file:/+)?/?" + _quoted(base.removeprefix("file://").lstrip("/")) + "/", "")
    readable = raw.where(F.expr("is_valid_utf8(cast(content as string))"))
    return readable.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")).withColumn("ext", S.extension(F.col("path")))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def ignore_patterns(text: str) -> list[str]:
    """Ignore-file lines to regular expressions over relative paths, negations left out."""
    out = []
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith(("#", "!")):
            continue
        anchored = line.startswith("/") or "/" in line.rstrip("/")
        body = fnmatch.translate(line.strip("/").replace("**", "*")).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")
        out.append(("^" if anchored else "(^|/)") + body + "(/|$)")
    return out


def scan_project(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Supported files that are neither hidden nor ignored."""
    keep = S.is_supported(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.")
    for pattern in ignore or []:
        keep &= ~F.col("path").rlike(pattern)
    return files.where(keep)


def walk(files: DataFrame, include: list[str] | None = None, exclude: tuple[str, ...] = SCAN_SKIPS) -> DataFrame:
    """Include and exclude by parts of the relative path; an empty include list takes all."""
    keep = F.lit(True)
    for part in exclude:
        keep &= ~F.contains("path", F.lit(part))
    if include:
        some = F.lit(False)
        for part in include:
            some |= F.contains("path", F.lit(part))
        keep &= some
    return files.where(keep)


def listing(files: DataFrame) -> DataFrame:
    """Visible paths in order: no dotted names, no build folders."""
    hidden = r"(^|/)(\.[^/]*|" + "|".join(LISTING_SKIPS) + r")(/|$)"
    return files.where(~F.col("path").rlike(hidden)).select("path").orderBy("path")


def search_names(files: DataFrame, query: str) -> DataFrame:
    """Visible files whose names hold the query in either case."""
    return listing(files).where(F.contains(F.lower(S.basename(F.col("path"))), F.lit(query.lower())))


def read_file(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("path", "content")


def extract_zip(archive: str, target: str) -> list[str]:
    """Unpack an uploaded archive; entries that would leave the target are skipped."""
    if not archive.endswith(".zip"):
        raise ValueError("only .zip archives are accepted")
    out = []
    with zipfile.ZipFile(archive) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UPLOAD:
            raise ValueError("the archive is larger than 1 GB")
        for info in z.infolist():
            name = PurePosixPath(info.filename)
            if info.is_dir() or name.is_absolute() or ".." in name.parts:
                continue
            z.extract(info, target)
            out.append(str(name))
    return sorted(out)


def store_loose(contents: dict[str, bytes], target: str) -> list[str]:
    """Write uploaded loose files below a folder that is scanned and not kept."""
    out = []
    for name, data in contents.items():
        pure = PurePosixPath(name)
        if pure.is_absolute() or ".." in pure.parts:
            continue
        path = Path(target) / pure
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        out.append(str(pure))
    return sorted(out)


def save_snapshot(symbols: DataFrame, folder: str, repository: str) -> str:
    """Overwrite a repository's index snapshot."""
    key = symbols.sparkSession.range(1).select(S.snapshot_key(F.lit(repository))).first()[0]
    symbols.write.mode("overwrite").parquet(f"{folder}/{key}")
    return key


def load_snapshot(spark: SparkSession, folder: str, repository: str) -> DataFrame:
    key = spark.range(1).select(S.snapshot_key(F.lit(repository))).first()[0]
    return spark.read.parquet(f"{folder}/{key}")


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def _git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True, text=True, timeout=120).stdout


def git_changes(spark: SparkSession, repository: str, old: str, new: str) -> DataFrame:
    """Changed files between two refs: status letter, path, old_path of renames and copies."""
    rows = []
    for line in _git(repository, "diff", "--name-status", "-M", old, new, "--").splitlines():
        status, *paths = line.split("\t")
        rows.append((status[0], paths[-1], paths[0] if len(paths) > 1 else None))
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def git_file(repository: str, ref: str, path: str) -> str:
    return _git(repository, "show", f"{ref}:{path}")


def git_commit_time(repository: str, ref: str) -> int:
    return int(_git(repository, "show", "-s", "--format=%ct", ref).strip())


def git_refs(spark: SparkSession, repository: str) -> DataFrame:
    """Branches and tags."""
    rows = []
    for kind, prefix in (("branch", "refs/heads/"), ("tag", "refs/tags/")):
        names = _git(repository, "for-each-ref", "--format=%(refname)", prefix).split()
        rows += [(kind, n.removeprefix(prefix)) for n in names]
    return spark.createDataFrame(rows, "kind string, name string")


def knowledge_modules(files: DataFrame) -> DataFrame:
    """Markdown modules by normalised name; of equal names the one nearest to the root counts."""
    name = F.lower(F.regexp_replace(S.basename(F.col("path")), r"\.md$", ""))
    found = files.where(F.endswith("path", F.lit(".md"))).withColumn("module", F.translate(name, " -", "__"))
    depth = F.size(F.split("path", "/"))
    return found.groupBy("module").agg(F.min_by(F.struct("path", "content"), F.struct(depth, "path")).alias("m")).select("module", "m.path", "m.content")
