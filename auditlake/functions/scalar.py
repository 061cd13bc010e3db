"""Scalar functions of the audit model as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that are indexed (case-sensitive).
SUPPORTED_EXTENSIONS = ("js", "jsx", "py", "java", "rs", "go", "ts", "tsx", "html", "htm", "vue", "css", "json", "c", "h", "cpp", "hpp", "cc")

# Extension to language of a symbol, and of a finding's file.
SYMBOL_LANGUAGES = {"java": "java", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust"}
FINDING_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "cs": "csharp", "cpp": "cpp", "c": "c"}

# Extensions of binary files.
BINARY_EXTENSIONS = (
    "jpg jpeg png gif bmp ico svg pdf doc docx xls xlsx ppt pptx zip rar 7z tar gz bz2 exe dll so dylib class jar war ear "
    "pyc pyo pyd db sqlite sqlite3 mp3 mp4 avi mov wmv flv wav flac ogg"
).split()

# Ranks of severities; anything else ranks last.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty where there is none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED_EXTENSIONS)


def symbol_language(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SYMBOL_LANGUAGES), extension(path)), F.lit("unknown"))


def finding_language(path: Column) -> Column:
    """Language of a finding's file by its lower-cased extension; python where unknown."""
    return F.coalesce(F.try_element_at(literal_map(FINDING_LANGUAGES), F.lower(F.substring_index(path, ".", -1))), F.lit("python"))


def truncated(text: Column, n: int) -> Column:
    """The first n characters and an ellipsis, or the whole text; never cuts inside a character."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines_of(text: Column) -> Column:
    """Lines without their ends: a carriage return before a line feed goes, and no empty line follows the last one."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def callee_name(text: Column) -> Column:
    """Last segment of a called name, whichever way it is qualified."""
    return F.element_at(F.split(F.regexp_replace(text, r"\?\.|::|->", "."), r"\."), -1)


def symbol_id(file_path: Column, name: Column, start_line: Column) -> Column:
    return F.concat_ws(":", file_path, name, start_line.cast("string"))


def snapshot_key(path: Column) -> Column:
    """16 hexadecimal digits that name a repository's snapshot."""
    return F.substring(F.sha1(path), 1, 16)


def severity_rank(severity: Column, other: int = 6) -> Column:
    rank = F.lit(other)
    for i, name in reversed(list(enumerate(SEVERITIES, 1))):
        rank = F.when(F.lower(severity) == name, i).otherwise(rank)
    return rank


def template_variables(text: Column) -> Column:
    """Distinct names in {{double braces}}, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*(\w+)\s*\}\}"), 1))


def substituted(text: Column, values: dict[str, Column]) -> Column:
    """Fill {{name}}, {name} and ${name}."""
    for name, value in values.items():
        for form in ("{{" + name + "}}", "${" + name + "}", "{" + name + "}"):
            text = F.replace(text, F.lit(form), value)
    return text


def fenced_code(text: Column) -> Column:
    """Content of the first code fence without its language word; the trimmed text where there is none."""
    body = F.regexp_extract(text, r"(?s)```(?:[A-Za-z]{1,19}[^\n]*\n)?(.*?)(?:```|$)", 1)
    return F.trim(F.regexp_replace(F.when(F.contains(text, F.lit("```")), body).otherwise(text), r"^\s+|\s+$", ""))


def first_json_object(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\{[^{}]*\}", 0), F.lit(""))


def is_binary(path: Column, head: Column) -> Column:
    """By extension, else by a zero byte among the first 1024."""
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS) | (F.position(F.lit(b"\x00"), F.substring(head, 1, 1024)) > 0)


def content_id(*columns: Column) -> Column:
    """A stable id of a row's content, where random ids would repeat rows on every run."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def retained_since(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))
