"""Pattern scans: rules or line patterns over files, located findings, union of scanners."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import scalar as S
from auditlake.sources.rules import active_rules, dialect_error

# The built-in line patterns by finding type.
BUILTIN_PATTERNS = {
    "password": r"""(?i)password\s*=\s*['"][^'"]+['"]""",
    "api_key": r"""(?i)api_key\s*=\s*['"][^'"]+['"]""",
    "todo": r"TODO:",
}
# Extensions of languages that have several.
LANGUAGE_EXTENSIONS = {
    "javascript": ("js", "jsx", "ts", "tsx", "mjs", "cjs"), "typescript": ("js", "jsx", "ts", "tsx", "mjs", "cjs"),
    "python": ("py",), "rust": ("rs",), "java": ("java",), "go": ("go",), "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc", "cxx"),
}
#: Noncharacters that set off matches; a file that holds them is scanned with spaces in their places.
START, STOP = "\ufdd0", "\ufdd1"
#: Comments and string literals of the languages with structural rules.
NOT_CODE = r"""//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
SPANS = "array<struct<line_start:int,line_end:int>>"
FINDING = ("file_path", "line_start", "line_end", "detector", "vuln_type", "severity", "description")


def java_pattern(pattern: str) -> str:
    """The same pattern for Java: `.` excludes only a line feed, classes and case folding are Unicode."""
    return "(?dU)" + without_restarts(pattern)


_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\.\*(?![?+*{])|.", re.S)
_LITERAL = re.compile(r"(?:[\w ]|\\[^\w\s])+")


def without_restarts(pattern: str) -> str:
    """The same matches, without trying a line's every place for what stands in its rest.

    Top-level alternatives are cut at `.*`.  One that begins with `.*` matches at the first place of a line that is
    left, or nowhere in it, so it is tried only there.  Of literal text between two `.*`, the first occurrence serves
    if any does, and the last `.*` reaches the same end after it, so no other occurrence is tried.
    """
    flags = re.match(r"\(\?i\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    if ".*" not in body or re.search(r"\(\?[a-zA-Z-]+[:)]|\\[QG]", body) or _parser.parse(pattern).getwidth()[0] == 0:
        return pattern
    depth, alternatives = 0, [[""]]
    for token in _TOKEN.findall(body):
        depth += (token == "(") - (token == ")")
        if depth == 0 and token == "|":
            alternatives.append([""])
        elif depth == 0 and token == ".*":
            alternatives[-1].append("")
        else:
            alternatives[-1][-1] += token
    found = []
    for head, *rest in alternatives:
        start = r"(?:(?<![^\n])|\G)" if rest and not head else ""
        between = "".join(f"(?>.*?{x})" if _LITERAL.fullmatch(x) else f".*{x}" for x in rest[:-1])
        found.append(start + head + between + "".join(f".*{x}" for x in rest[-1:]))
    return (flags[0] if flags else "") + "|".join(found)


def extensions_of(language: str) -> tuple[str, ...] | None:
    """Extensions a rule's language covers; None for all files; an unknown language is its own extension."""
    return None if language in ("all", "*") else LANGUAGE_EXTENSIONS.get(language, (language,))


def rule_extensions(rules: DataFrame) -> DataFrame:
    """(id, ext) for every extension that a rule covers; ext `*` for rules over all files."""
    mapped = F.create_map(*(x for k, v in LANGUAGE_EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    exts = F.when(F.col("language").isin("all", "*"), F.array(F.lit("*"))).otherwise(F.coalesce(F.try_element_at(mapped, F.col("language")), F.array("language")))
    return rules.select("id", F.explode(exts).alias("ext"))


def applicable(files: DataFrame, rules: DataFrame, file_key: str = "path") -> DataFrame:
    """(file, rule id) pairs by extension; the rule side is a small dimension."""
    exts = rule_extensions(rules)
    some = files.select(file_key, "ext").join(exts.where("ext <> '*'"), "ext").select(file_key, "id")
    every = files.select(file_key).crossJoin(exts.where("ext = '*'").select("id"))
    return some.unionByName(every)


def match_spans(content: Column, pattern: str, besides: str | None = None) -> Column:
    """array<struct<line_start, line_end>> of all non-overlapping matches, left to right.

    Matches are set off by marks and the marked text is split at line feeds: the n-th opening and the n-th closing
    mark belong together, and the line that holds one is its place in the array, so a file costs one pass however
    many matches it has.  Text that matches `besides` first is passed over.
    """
    holds = F.contains(content, F.lit(START)) | F.contains(content, F.lit(STOP))
    clean = F.when(holds, F.translate(content, START + STOP, "  ")).otherwise(content)
    if besides is None:
        marked = F.regexp_replace(clean, f"({java_pattern(pattern)})", f"{START}$1{STOP}")
    else:
        marked = F.regexp_replace(clean, f"((?d){besides})|({java_pattern(pattern)})", f"$1{START}$2{STOP}")
        marked = F.replace(marked, F.lit(START + STOP), F.lit(""))

    def places(lines: Column, mark: str) -> Column:
        return F.flatten(F.transform(lines, lambda line, i: F.array_repeat(i + 1, (F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))).cast("int"))))

    def located(lines: Column) -> Column:
        return F.transform(F.arrays_zip(places(lines, START).alias("line_start"), places(lines, STOP).alias("line_end")), lambda x: F.struct(x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))

    # An array of one, so that the marked text is made once for both kinds of marks.
    once = F.get(F.transform(F.array(F.split(marked, "\n", -1)), located), F.lit(0))
    return F.when(content.rlike(java_pattern(pattern)), once).otherwise(F.array().cast(SPANS))


_CALL = re.compile(r"""\(call_expression\s+function:\s*(?:\(identifier\)\s*@(\w+)|\(member_expression\s+object:\s*\(identifier\)\s*@(\w+)\s+property:\s*\(property_identifier\)\s*@(\w+)\s*\))((?:\s*\(\#eq\?\s+@\w+\s+"[^"]*"\s*\))+)\s*\)\s*\Z""")


def call_pattern(query: str) -> str:
    """The call that a structural query describes: of a name, or of an object's property, each told by equality.

    Other structural queries are refused: there is no syntax tree to run them on.
    """
    m = _CALL.match(query.strip())
    names = dict(re.findall(r'@(\w+)\s+"([^"]*)"', m[4])) if m else {}
    parts = [names.get(c) for c in ((m[1],) if m[1] else (m[2], m[3]))] if m else [None]
    if any(p is None for p in parts):
        raise ValueError(f"structural query is not supported: {query}")
    return r"(?<![\w.$])" + r"\s*\.\s*".join(re.escape(p) for p in parts) + r"\s*\("


def finding_columns(rule: dict, kind: str = "RegexRule") -> list[Column]:
    return [
        F.lit(f"{kind}: {rule['id']}").alias("detector"), F.lit(rule.get("cwe") or "Unknown").alias("vuln_type"),
        F.lower(F.lit(rule["severity"])).alias("severity"), F.lit(rule.get("description") or "").alias("description"),
    ]


def _located(spans: Column, rule: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["line_start"].cast("long").alias("line_start"), s["line_end"].cast("long").alias("line_end"), rule.alias("r")))


def scan_content(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings of whole contents: one pass over the files, one literal expression for each active rule.

    A structural rule is read as the call that it describes (see `call_pattern`), located by its first name; calls
    in comments and string literals are none.
    """
    found = []
    for rule in active_rules(rules):
        if rule.get("query"):
            kind, spans = "ASTRule", match_spans(F.col("content"), call_pattern(rule["query"]), NOT_CODE)
            spans = F.transform(spans, lambda s: F.struct(s["line_start"].alias("line_start"), s["line_start"].alias("line_end")))
        else:
            kind, spans = "RegexRule", match_spans(F.col("content"), rule["pattern"])
        exts = extensions_of(rule["language"])
        if exts is not None:
            spans = F.when(F.col("ext").isin(*exts), spans).otherwise(F.array().cast(SPANS))
        found.append(_located(spans, F.struct(*finding_columns(rule, kind))))
    if not found:
        raise ValueError("no active rule")
    one = files.select(F.col("path").alias("file_path"), F.explode(F.concat(*found)).alias("f"))
    return one.select("file_path", "f.line_start", "f.line_end", "f.r.detector", "f.r.vuln_type", "f.r.severity", "f.r.description")


def line_table(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line, text): lines numbered from 1."""
    lines = files.select(F.col(key), F.posexplode(S.lines_of(F.col(content))).alias("pos", "text"))
    return lines.select(key, (F.col("pos") + 1).cast("long").alias("line"), "text")


def scan_lines(files: DataFrame, patterns: dict[str, str] | None = None, severity: str = "high") -> DataFrame:
    """At most one finding for each line and pattern."""
    patterns = BUILTIN_PATTERNS if patterns is None else patterns
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(java_pattern(p)), F.lit(name)) for name, p in patterns.items())))
    rows = line_table(files).select(F.col("path").alias("file_path"), F.col("line").alias("line_start"), F.explode(hits).alias("vuln_type"))
    described = F.concat(F.lit("Found potential "), F.col("vuln_type"), F.lit(" at line "), F.col("line_start").cast("string"))
    return rows.select("file_path", "line_start", F.col("line_start").alias("line_end"), F.lit("RegexScanner").alias("detector"), "vuln_type", F.lit(severity).alias("severity"), described.alias("description"))


def scan_custom(files: DataFrame, rules_by_extension: dict[str, list[dict]]) -> DataFrame:
    """Line scan with rules of each extension: pattern, message, severity."""
    lines = files.select("path", "ext", F.posexplode(S.lines_of(F.col("content"))).alias("pos", "code"))
    cases = []
    for ext, rules in sorted(rules_by_extension.items()):
        for rule in rules:
            if not dialect_error(rule["pattern"]):
                hit = (F.col("ext") == ext) & F.col("code").rlike(java_pattern(rule["pattern"]))
                cases.append(F.when(hit, F.struct(F.lit(rule["severity"]).alias("severity"), F.lit(rule["message"]).alias("message"))))
    found = lines.select(F.col("path").alias("file"), (F.col("pos") + 1).cast("long").alias("line"), "code", F.explode(F.array_compact(F.array(*cases))).alias("r"))
    return found.select("file", "line", "r.severity", "r.message", F.trim("code").alias("code"))


def scan_all(scanners: list[DataFrame]) -> DataFrame:
    """All scanners' findings."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scanners)


class Scanners:
    """Named scanners, each a function from a file table to findings; a scan is the union of what they find."""

    def __init__(self, **scanners: Callable[[DataFrame], DataFrame]):
        self.scanners = dict(scanners)

    def register(self, name: str, scanner: Callable[[DataFrame], DataFrame]) -> None:
        self.scanners[name] = scanner

    def scan(self, files: DataFrame) -> DataFrame:
        if not self.scanners:
            raise ValueError("no scanner is registered")
        return with_finding_id(scan_all([f(files) for f in self.scanners.values()]))


def with_finding_id(findings: DataFrame) -> DataFrame:
    """A content id, so a repeated scan finds the same ids."""
    return findings.withColumn("finding_id", S.content_id(*(F.col(c) for c in ("file_path", "line_start", "line_end", "detector", "vuln_type"))))


def scan_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Files scanned and findings found, counted truly."""
    return files.select(F.count_distinct("path").alias("files_scanned")).crossJoin(findings.select(F.count(F.lit(1)).alias("findings_found")))


def scan(spark: SparkSession, files: DataFrame, rules: list[dict]) -> DataFrame:
    """Rule findings and built-in line findings of a file table, with ids."""
    return Scanners(rules=lambda f: scan_content(f, rules), lines=scan_lines).scan(files)
