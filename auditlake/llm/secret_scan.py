"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns (kinds assign, access, hex).  The method adds kind `lexed`: a lexer
reads the text as source or configuration syntax, in one pass over code, comments and string literals, and
collects name-literal pairs (`name = literal`, `name: literal`, `name := literal`, `"name": "literal"`,
`name => literal`, `name = "a" + "b"`, `name = other`).  Pairs in code define constants.  A name that is used
as a value stands for its latest definition before the use, or for its first one after it; values are
propagated through all of these.  A literal is reported when a name that it reaches is sensitive enough for how
secret-like the name's whole value looks.  Pairs inside comments and inside string literals are reported too (a
commented-out password is leaked all the same), but define and use no constants.

A constant is held as a few numbers about its value (length, characters that occur, classes) and as references
to its operands, never as a copied value, so constants that double each other cost nothing; every literal is
visited once.  Literals, names and chains of constants have no upper length.

No rows move between tasks: every whole text is read where it lies, in time and memory that grow with its
length.  Defined results: null or empty text has no spans; very long texts are lexed whole; rows that repeat an
id are scanned each; an empty table gives an empty result; columns other than id and text are ignored.  Spans
are in code points, end exclusive; they are ordered by start, ties by kind as listed, then by end.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import read_table, texts

# The base patterns, the words that make one possible, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")  # of a maximal run: the same as [0-9a-f]+ with shorter ones dropped
KINDS = ("assign", "access", "hex", "lexed")

# How sensitive a word of a target name is.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3,
    "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "auth": 1, "bearer": 2, "key": 1,
    "api": 1, "private": 1, "access": 1, "signing": 1, "encryption": 1, "client": 1, "cookie": 1, "session": 1,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "todo", "none", "null", "true", "false", "undefined")
#: Name weight plus literal score from which a literal is reported.
THRESHOLD = 5

_ANY_NAME = re.compile("|".join(sorted(NAME_WEIGHTS, key=len, reverse=True)), re.I | re.A)
#: A name, an assignment sign and what starts its value; the name stands at a word's start.
_PAIR_RULE = r"""(?<![\w.$-])(?P<q>["']?)(?P<name>[A-Za-z_$][\w.$-]*+)(?P=q)[\x20\t]*+(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*+(?=[\w"'`$+/])"""
_PAIR = re.compile(_PAIR_RULE, re.A)
#: What the lexer tells apart.  Repeats are possessive and an open comment or string runs on to its natural end,
#: so every character is consumed once.  A quote after a word character is an apostrophe.
_TOKEN = re.compile(
    rf"(?P<pair>{_PAIR_RULE})"
    r"|(?P<comment>(?<!:)//[^\n]*+|(?<![^\s;,{}()\[\]])\#[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)"
    r'|(?P<string>(?<![\w\\])(?:"""(?:[^"\\]++|\\.|\\\n|"(?!""))*+(?:""")?'
    r"|" r"""'{3}(?:[^'\\]++|\\.|\\\n|'(?!''))*+(?:'{3})?|"(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?|`[^`\n]*+`?))""",
    re.A,
)
_STRING = re.compile(r""""((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`""")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]++""")
_NAME = re.compile(r"[A-Za-z_$][\w.$-]*+\Z", re.A)
_REFERENCE = re.compile(r"[A-Za-z_$][\w.$]*+\Z", re.A)
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
_VARIABLE = re.compile(r"\$\{|%\(|\{\{")
_SMALL, _LARGE, _DIGIT = (sum(1 << ord(c) for c in cs) for cs in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_ALL = (1 << 256) - 1


def name_weight(name: str) -> int:
    """The sum over distinct sensitive words of a name (snake, kebab, dotted or camel case)."""
    words = {w.lower() for w in _NAME_WORDS.findall(name)}
    return sum(NAME_WEIGHTS.get(w, 0) for w in words)


#: What is known of a value: length (no longer told apart beyond 2**40), mask of characters, whether it is no literal.
Sketch = tuple[int, int, bool]
NOTHING: Sketch = (0, 0, False)


def _mask(characters) -> int:
    return sum(1 << (o if o < 128 else 128 + o % 128) for o in {o if o < 128 else 128 + o % 128 for o in map(ord, characters)})


def sketch(value: str) -> Sketch:
    bad = any(c.isspace() for c in set(value)) or bool(_PLACEHOLDER.search(value.lower()) or _VARIABLE.search(value))
    return len(value), _mask(set(value)), bad


def joined(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two values one after the other."""
    return min(a[0] + b[0], 1 << 40), a[1] | b[1], a[2] or b[2]


def literal_score(value: Sketch) -> int:
    """0 to 4 by length, variety and character classes; placeholders and references score below any threshold."""
    n, mask, bad = value
    if n < 8 or bad:
        return -9
    classes = sum(bool(mask & m) for m in (_SMALL, _LARGE, _DIGIT, _ALL & ~(_SMALL | _LARGE | _DIGIT)))
    return 1 + (n >= 16) + (mask.bit_count() >= 9) + (classes >= 3)


class _Run:
    """A run without breaks (`a=b=c...`), in which several values may start that all end with it."""

    def __init__(self, text: str, begin: int, end: int):
        self.begin, self.stop = begin, end
        run = text[begin:end]
        self.end = begin + len(run.rstrip("."))
        self._text = run
        self._last: dict[str, int] | None = None

    def sketch(self, at: int) -> Sketch:
        """The sketch of text[at:end], from where each character and a placeholder last stands in the run."""
        if self._last is None:
            run = self._text[: self.end - self.begin]
            self._last = {c: i for i, c in enumerate(run, self.begin)}
            self._bad = max((m.start() + self.begin for m in _PLACEHOLDER.finditer(run.lower())), default=-1)
            self._bad = max(self._bad, max((m.start() + self.begin for m in _VARIABLE.finditer(run)), default=-1))
        return max(0, self.end - at), _mask(c for c, i in self._last.items() if i >= at), self._bad >= at


#: (start, end, sketch or None until it is needed, name if the value may be a constant's, whether quoted)
Operand = tuple[int, int, "Sketch | _Run", "str | None", bool]


def _operands(text: str, at: int, end: int, run: list) -> list[Operand]:
    """The operands of the value that starts at a place and stands before `end`."""
    out: list[Operand] = []
    while True:
        if m := _STRING.match(text, at, end):
            a, b = m.span(m.lastindex or 1)
            out.append((a, b, sketch(text[a:b]), None, True))
            at = m.end()
        elif (run and run[0].begin <= at < run[0].stop) or (m := _BARE.match(text, at, end)):
            if m:
                run[:] = [_Run(text, *m.span())]
            held = run[0]
            stop = max(at, held.end)
            name = text[at:stop] if _NAME.match(text, at, stop) else None
            called = text[held.stop : held.stop + 1] == "(" and (name is None or _REFERENCE.match(text, at, stop))
            if name or not called:
                out.append((at, stop, NOTHING if called else held, name, False))
            at = held.stop
        else:
            return out
        if not (m := _PLUS.match(text, at, end)):
            return out
        at = m.end()


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    if not _ANY_NAME.search(text):
        return []
    pairs: list[tuple[str, list[Operand], bool]] = []  # name, operands, whether in code
    defined: dict[str, list[int]] = {}
    run: list = []
    for token in _TOKEN.finditer(text):
        if token.lastgroup == "pair":
            operands = _operands(text, token.end(), len(text), run)
            if not operands:
                continue
            # "word: prose" defines no constant
            if any(o[4] for o in operands) or token[0].rstrip()[-1] != ":":
                defined.setdefault(token["name"], []).append(len(pairs))
            pairs.append((token["name"], operands, True))
        else:
            inner: list = []
            for m in _PAIR.finditer(text, token.start() + 1, token.end()):
                if operands := _operands(text, m.end(), token.end(), inner):
                    pairs.append((m["name"], operands, False))

    def meant(at: int, operand: Operand) -> int | None:
        """The pair that defines the constant which an operand of pair `at` names."""
        places = defined.get(operand[3]) if operand[3] and pairs[at][2] else None
        if not places:
            return None
        k = bisect.bisect_left(places, at)
        return places[k - 1] if k else next((p for p in places if p != at), None)

    sketches: dict[int, Sketch] = {}

    def value(at: int) -> Sketch:
        """The sketch of a pair's value, after those of the constants in it; a circle adds nothing."""
        waiting, begun = [at], set()
        while waiting:
            now = waiting[-1]
            if now in sketches:
                waiting.pop()
                continue
            inner = [meant(now, o) for o in pairs[now][1]]
            if now not in begun:
                begun.add(now)
                waiting += [i for i in inner if i is not None and i not in sketches and i not in begun]
                continue
            total = NOTHING
            for o, i in zip(pairs[now][1], inner, strict=True):
                total = joined(total, sketches.get(i, NOTHING) if i is not None else o[2].sketch(o[0]) if isinstance(o[2], _Run) else o[2])
            sketches[now] = total
            waiting.pop()
        return sketches[at]

    found: set[tuple[int, int]] = set()
    reached: set[int] = set()
    for at, (name, _, _) in enumerate(pairs):
        weight = name_weight(name)
        if weight < 2 or weight + literal_score(value(at)) < THRESHOLD:
            continue
        waiting = [at]
        while waiting:
            now = waiting.pop()
            if now in reached:
                continue
            reached.add(now)
            for o in pairs[now][1]:
                if (i := meant(now, o)) is not None:
                    waiting.append(i)
                elif o[1] > o[0] and o[2] != NOTHING:
                    found.add((o[0], o[1]))
    return sorted(found)


def scan_text(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind."""
    low = text.lower()
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if any(w in low for w in ASSIGN_WORDS) else []
    access = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in HEX.finditer(text)], "lexed": lexed_spans(text)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in order of start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = [(a, k, b) for k, (_, found) in enumerate(sorted(scan_text(text.as_py()).items(), key=lambda x: KINDS.index(x[0]))) for a, b in found]
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


DIGEST = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def digests(scanned: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = Counter(s["kind"] for s in spans)
                said = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
                base = ",".join(x for x, s in zip(said, spans, strict=True) if s["kind"] != "lexed")
                out.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    return scanned.mapInArrow(run, DIGEST)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(read_table(spark, sf_dir, "documents")))
