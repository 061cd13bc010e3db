"""Symbol extraction: one row for each class, function, method and call of source files.

Python files go through the standard parser.  Java, Rust, TypeScript and JavaScript go through a lexer that
blanks comments and strings and follows brackets; other indexed languages have no symbols.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.plans.tables import task_count

SYMBOLS = (
    "name string, kind string, file_path string, line bigint, start_line bigint, end_line bigint, code string, parent_classes array<string>, package string, "
    "modifiers array<string>, fields array<struct<name:string,field_type:string,start_line:bigint,end_line:bigint,modifiers:array<string>>>, metadata map<string,string>"
)
# Most characters of code kept by kind.
CODE_LIMITS = {"java": {"Class": 500, "Interface": 500, "Method": 300, "MethodCall": 200}}
DEFAULT_LIMIT = 200
#: Symbols put into an Arrow batch together; the last file's may exceed it.
BATCH = 2000
PARSED = {"java": "java", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript"}
GENERIC = ("go", "c", "h", "cpp", "hpp", "cc", "html", "htm", "css", "json", "vue")
_NOT_CALLS = frozenset("if for while switch catch return new function super this synchronized else do try match loop fn in as let mut impl where struct enum trait class interface import typeof await yield assert throw throws void delete instanceof case sizeof".split())


def last_name(text: str) -> str:
    """The last segment of a callee, whichever way it is qualified."""
    return re.sub(r"\?\.|::|->", ".", text).rsplit(".", 1)[-1].strip()


def _cut(code: str, n: int) -> str:
    return code if len(code) <= n else code[:n] + "..."


def _symbol(name, kind, start, end, code, language, *, parents=(), package="", modifiers=(), fields=(), metadata=None) -> dict:
    limit = CODE_LIMITS.get(language, {}).get(kind, DEFAULT_LIMIT)
    return {
        "name": name, "kind": kind, "line": end, "start_line": start, "end_line": end, "code": _cut(code, limit), "parent_classes": list(parents),
        "package": package, "modifiers": list(modifiers), "fields": list(fields), "metadata": {k: v for k, v in (metadata or {}).items() if v},
    }


def python_symbols(text: str) -> list[dict]:
    tree = ast.parse(text)
    out: list[dict] = []

    def visit(node: ast.AST, classes: tuple[str, ...], functions: tuple[str, ...]) -> None:
        if isinstance(node, ast.ClassDef):
            classes = (*classes, node.name)
            out.append(_symbol(node.name, "Class", node.lineno, node.end_lineno, ast.get_source_segment(text, node) or "", "python"))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions = (*functions, node.name)
            owner = classes[-1] if classes else None
            out.append(_symbol(node.name, "Method" if classes else "Function", node.lineno, node.end_lineno, ast.get_source_segment(text, node) or "", "python", metadata={"ownerClass": owner, "callerFunction": node.name}))
        elif isinstance(node, ast.Call):
            name = last_name(ast.get_source_segment(text, node.func) or "")
            if name:
                out.append(_symbol(name, "MethodCall", node.lineno, node.end_lineno, ast.get_source_segment(text, node) or "", "python", metadata={"callerClass": classes[-1] if classes else None, "callerFunction": functions[-1] if functions else None}))
        for child in ast.iter_child_nodes(node):
            visit(child, classes, functions)

    visit(tree, (), ())
    return out


def blanked(text: str, language: str) -> str:
    """The text with comments and literals replaced by spaces, place by place."""
    quotes = r'"(?:[^"\\\n]|\\.)*"' + ("" if language == "rust" else r"|'(?:[^'\\\n]|\\.)*'") + (r"|`(?:[^`\\]|\\.)*`" if language == "typescript" else "") + (r"|'(?:[^'\\\n]|\\.)'" if language == "rust" else "")
    return re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + quotes, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _matching(code: str) -> dict[int, int]:
    """Closing place of every opening bracket."""
    pairs, stack = {}, []
    closes = {")": "(", "}": "{", "]": "["}
    for m in re.finditer(r"[(){}\[\]]", code):
        if m[0] in "({[":
            stack.append((m[0], m.start()))
        else:
            while stack and stack[-1][0] != closes[m[0]]:
                stack.pop()
            if stack:
                pairs[stack.pop()[1]] = m.start()
    return pairs


_CLASS = {
    "java": re.compile(r"((?:\b(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*)\b(class|interface)\s+(\w+)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w.<>,\s]+?))?(?:\s+implements\s+([\w.<>,\s]+?))?\s*\{"),
    "typescript": re.compile(r"()\b(class)\s+(\w+)[^{;]*\{"),
    "rust": re.compile(r"()\b(struct)\s+(\w+)[^{;(]*[{;(]"),
}
_FUNCTION = {
    "java": re.compile(r"(?:^|[;{}])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>{]*>\s*)?[\w.<>\[\],?]+(?:\s*\[\])*\s+(\w+)\s*(\()", re.M),
    "typescript": re.compile(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^>(]*>)?(\()|(?:^|[;{}])\s*(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(\w+)\s*(?:<[^>(]*>)?(\()", re.M),
    "rust": re.compile(r"\bfn\s+(\w+)\s*(?:<[^{(]*>)?\s*(\()"),
}
_AFTER = re.compile(r"\s*(?:->[^{;]*|:[^{;=]*|throws[\w\s.,]*|where[^{;]*)?([{;])")
_CALL = re.compile(r"((?:[\w$]+|\))(?:\s*(?:\.|\?\.|::|->)\s*[\w$]+)*)\s*(?:::<[^>()]*>)?\(")


def lexed_symbols(text: str, language: str) -> list[dict]:
    code = blanked(text, language)
    close = _matching(code)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)
    package = (m[1] if (m := re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M)) else "") if language == "java" else ""
    classes, functions, out = [], [], []
    for m in _CLASS[language].finditer(code):
        opener = m.end() - 1
        end = close.get(opener, opener) if code[opener] in "{(" else opener
        begin = m.start(2) if not m[1].strip() else m.start(1)
        parents = [p.strip() for g in (m.group(4), m.group(5)) if g for p in re.split(r",(?![^<]*>)", g) if p.strip()] if language == "java" else []
        kind = {"class": "Class", "interface": "Interface", "struct": "Struct"}[m[2]]
        fields = java_fields(code, text, opener, end, line) if language == "java" else []
        classes.append((m.start(2), end, m[3]))
        out.append((begin, _symbol(m[3], kind, line(begin), line(end), text[begin : end + 1], language, parents=parents, package=package, modifiers=m[1].split(), fields=fields)))
    declared = set()
    for m in _FUNCTION[language].finditer(code):
        k = 1 if m[1] else 3
        name, bracket = m[k], m.start(k + 1)
        if name in _NOT_CALLS or bracket not in close:
            continue
        after = _AFTER.match(code, close[bracket] + 1)
        if not after or (after[1] == ";" and language == "typescript"):
            continue
        end = close.get(after.start(1), after.start(1)) if after[1] == "{" else after.start(1)
        begin = m.start() + len(m[0]) - len(m[0].lstrip(";{} \t\r\n"))
        functions.append((begin, end, name))
        declared.add(bracket)

    def inside(at: int, spans: list[tuple[int, int, str]]) -> str | None:
        around = [s for s in spans if s[0] < at <= s[1]]
        return max(around)[2] if around else None

    for begin, end, name in functions:
        owner = inside(begin, classes)
        kind = "Method" if language == "java" or (language == "typescript" and owner) else "Function"
        meta = {"ownerClass": owner} if language == "java" else {"callerClass": owner, "callerFunction": name} if language == "typescript" else {"callerFunction": name}
        out.append((begin, _symbol(name, kind, line(begin), line(end), text[begin : end + 1], language, package=package, metadata=meta)))
    for m in _CALL.finditer(code):
        bracket = m.end() - 1
        name = last_name(re.sub(r"\s+", "", m[1]))
        if bracket in declared or not name or name in _NOT_CALLS or name == ")" or name.isdigit():
            continue
        if re.search(r"\b(?:new|fn|function)\s+$", code[max(0, m.start() - 24) : m.start()]):
            continue
        end = close.get(bracket, bracket)
        caller = inside(m.start(), functions)
        meta = {"callerClass": inside(m.start(), classes), "callerMethod": caller} if language == "java" else {"callerClass": inside(m.start(), classes), "callerFunction": caller}
        out.append((m.start(), _symbol(name, "MethodCall", line(m.start()), line(end), text[m.start() : end + 1], language, package=package, metadata=meta)))
    return [s for _, s in sorted(out, key=lambda x: x[0])]


_FIELD = re.compile(r"(?<![\w.])((?:\b(?:public|private|protected|static|final|transient|volatile)\s+)*)(\w[\w.<>\[\],?\s]*?)\s+(\w+)\s*(?:=[^;]*)?;")
_NOT_TYPES = frozenset("return package import throw throws new class interface enum record extends implements".split())


def java_fields(code: str, text: str, opener: int, end: int, line) -> list[dict]:
    """Fields that stand directly in a class body."""
    close, body, at = _matching(code[opener : end + 1]), [], 1
    inner = code[opener : end + 1]
    while at < len(inner) - 1:
        if inner[at] == "{":
            stop = close.get(at, at)
            body.append(re.sub(r"[^\n]", " ", inner[at:stop]) + ";")
            at = stop + 1
        else:
            body.append(inner[at])
            at += 1
    flat, out = "".join(body), []
    for m in _FIELD.finditer(flat):
        kind = " ".join(m[2].split())
        if "(" in m[0].split("=")[0] or not kind or _NOT_TYPES & set(kind.split()):
            continue
        begin = opener + 1 + m.start() + len(m[0]) - len(m[0].lstrip())
        out.append({"name": m[3], "field_type": kind, "start_line": line(begin), "end_line": line(opener + m.end()), "modifiers": m[1].split()})
    return out


def symbols_of(path: str, text: str) -> list[dict]:
    """Symbols of one file; an unknown extension is an error, a text that does not parse has none."""
    ext = path.rpartition(".")[2] if "." in path else ""
    language = PARSED.get(ext)
    if language is None:
        if ext in GENERIC:
            return []
        raise ValueError(f"unsupported extension: {ext}")
    if language == "python":
        try:
            return python_symbols(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
    return lexed_symbols(text, language)


def extract_symbols(files: DataFrame) -> DataFrame:
    """All symbols of a table of supported files (path, content), dealt over tasks: many files may take few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pa.struct([("name", pa.string()), ("field_type", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("modifiers", pa.list_(pa.string()))])
        schema = pa.schema([
            ("name", pa.string()), ("kind", pa.string()), ("file_path", pa.string()), ("line", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("code", pa.string()),
            ("parent_classes", pa.list_(pa.string())), ("package", pa.string()), ("modifiers", pa.list_(pa.string())), ("fields", pa.list_(field)), ("metadata", pa.map_(pa.string(), pa.string())),
        ])
        for batch in batches:
            rows = []
            for path, text in zip(*batch.columns, strict=True):
                path, text = path.as_py(), text.as_py()
                rows += [s | {"file_path": path, "metadata": list(s["metadata"].items())} for s in symbols_of(path, text or "")]
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").repartition(task_count(files.sparkSession)).mapInArrow(run, SYMBOLS)
