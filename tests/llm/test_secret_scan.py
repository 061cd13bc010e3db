import hashlib
import random
import re
import tracemalloc

from auditlake.llm import secret_scan as S


def brute_base(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", "AKIA[A-Z0-9]+", 0, 16),
            ("hex", "[0-9a-f]+", 0, 32),
        )
    ):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(spans)]


def row(doc_id, text):
    base = brute_base(text or "")
    n = [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    return (doc_id, *n, hashlib.sha256(",".join(base).encode()).hexdigest())


def check(got, docs):
    assert sorted(tuple(r)[:5] for r in got) == sorted(row(d, t) for d, t in docs)
    for r in got:
        assert [s for s in r["spans"].split(",") if s and not s.startswith("lexed")] == brute_base(dict(docs)[r["doc_id"]] or "")


def test_base_spans(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "ſecret", "secret", "toKen", "toKen", "api_key", "APIKEY", "=", ": ", ' "', "'", "abc", "0123456789", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "deadbeef", "é", "\n", "𒍅", " "]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(16)))) for i in range(4000)]
    docs += [(9001, None), (9002, ""), (9003, "token=secret=abcdefghij token: api_key: xxxxxxxxx"), (9004, "f" * 500_000), (9005, "word " * 50_000 + "token=abcdefgh")]
    check(S.digests(S.scan(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, spans string"))).collect(), docs)


def test_assignments():
    def found(text):
        return [text[a:b] for a, b in S.lexed_spans(text)]

    assert found('db_password = "hunter2hunter2Z!"') == ["hunter2hunter2Z!"]
    assert found('x = "q9$kfLw02mfPz81a"\nprint(1)\nclientSecret = x') == ["q9$kfLw02mfPz81a"]
    assert found('part = "q9$kfLw0"\nauth_token = part + "2mfPz81a"') == ["q9$kfLw0", "2mfPz81a"]
    assert found('{"private_key": "MIIEvQIBADANBgkq"}') == ["MIIEvQIBADANBgkq"]
    assert found("PASSWORD=changeme-please") == []
    assert found('title = "q9$kfLw02mfPz81a"') == []
    assert found("token := get_token()") == []
    assert found("the password: is long and plain prose") == []


def test_long_literals_and_names():
    """Literals and names of any length; a long quoted one was dropped, a long bare one cut, a long name ignored."""
    long = "".join(random.Random(5).choices("ABCDEFGHIJabcdefghij0123456789+/", k=5000))
    for quote in "\"'`":
        text = f"private_key = {quote}{long}{quote}\n"
        assert S.lexed_spans(text) == [(15, 5015)]
        assert S.lexed_spans(f"blob = {quote}{long}{quote}\npassphrase = blob") == [(8, 5008)]
    assert S.lexed_spans("access_key=" + long) == [(11, 5011)]
    assert S.lexed_spans("access_key: " + long + "...\nx = 1") == [(12, 5012)]
    name = "a" * 500 + "_credentials"
    assert S.lexed_spans(f'"{name}": "q9$kfLw02mfPz81a"') == [(len(name) + 5, len(name) + 21)]
    assert S.lexed_spans(f'k = "{long[:4]}\\"{long[4:]}"\nclient_secret = "{long}\\') == []
    run = "&".join(f"a{i}=1" for i in range(20_000)) + "&access_key=" + long
    assert S.lexed_spans(run) == [(len(run) - 5000, len(run))]


def brute_lexed(statements):
    """Literals that reach a sensitive name; statements are (name, operands), operands (is name, text, span)."""

    def meant(at, name):
        places = [k for k, (n, _) in enumerate(statements) if n == name and k != at]
        before = [k for k in places if k < at]
        return before[-1] if before else places[0] if places else None

    def whole(at, above):
        """The value spelt out and the literals in it; a circle adds nothing."""
        value, literals = "", set()
        for is_name, said, span in statements[at][1]:
            to = meant(at, said) if is_name else None
            if to is None:
                value, literals = value + said, literals | {span}
            elif to not in above:
                more, inner = whole(to, above | {to})
                value, literals = value + more, literals | inner
        return value, literals

    out = set()
    for at, (name, _) in enumerate(statements):
        weight = sum(S.NAME_WEIGHTS.get(w, 0) for w in set(name.lower().split("_")))
        value, literals = whole(at, {at})
        classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        if weight >= 2 and len(value) >= 8 and weight + 1 + (len(value) >= 16) + (len(set(value)) >= 9) + (classes >= 3) >= S.THRESHOLD:
            out |= literals
    return sorted(out)


def test_lexed_as_brute_force():
    """Programs of assignments, some of which use names before they are defined, against values spelt out in full."""
    rng = random.Random(11)
    names = ["alpha", "beta", "gamma", "db_password", "auth_token", "client_secret", "omega"]
    found = 0
    for _ in range(600):
        text, statements = "", []
        for _ in range(rng.randrange(1, 7)):
            name, operands = rng.choice(names), []
            text += rng.choice(["", "# a remark\n", "/* more */ ", 'print("text")\n', "it isn't\n", "  "]) + name + rng.choice([" = ", "=", " := ", " => "])
            for k in range(rng.randrange(1, 4)):
                text += " + " * (k > 0)
                if rng.random() < 0.5:
                    said = rng.choice(names)
                    operands.append((True, said, (len(text), len(text) + len(said))))
                    text += said
                else:
                    said = "".join(rng.choices("abcXYZ123$%", k=rng.randrange(1, 12)))
                    operands.append((False, said, (len(text) + 1, len(text) + 1 + len(said))))
                    text += f'"{said}"'
            statements.append((name, operands))
            text += "\n"
        circle = any(o[0] and o[1] == n for n, os in statements for o in os) or len({n for n, _ in statements}) < len(statements)
        got = S.lexed_spans(text)
        if not circle or not _circles(statements):
            assert got == brute_lexed(statements), text
            found += bool(got)
    assert found > 50


def _circles(statements):
    """Whether a name's value depends on itself (where a circle is cut is not part of the comparison)."""

    def meant(at, name):
        places = [k for k, (n, _) in enumerate(statements) if n == name and k != at]
        before = [k for k in places if k < at]
        return before[-1] if before else places[0] if places else None

    def visit(at, above):
        inner = [meant(at, said) for is_name, said, _ in statements[at][1] if is_name]
        return any(i in above or visit(i, above | {i}) for i in inner if i is not None)

    return any(visit(k, {k}) for k in range(len(statements)))


def test_constants_without_growth():
    """Doubling constants, uses before definitions, circles, and pairs in comments and strings."""
    literal = "q9$kfLw02mfPz81a"
    doubling = f'v0 = "{literal}"\n' + "\n".join(f"v{i} = v{i - 1} + v{i - 1}" for i in range(1, 200)) + "\npassword = v199"
    tracemalloc.start()
    assert S.lexed_spans(doubling) == [(6, 6 + len(literal))]
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert S.lexed_spans(f'password = KEY\nKEY = "{literal}"') == [(22, 38)]
    assert S.lexed_spans("a = b\nb = a\npassword = a") == []
    assert S.lexed_spans(f'# password = "{literal}"') == [(14, 30)]
    assert S.lexed_spans(f"/* token: {literal} */") == [(10, 26)]
    assert S.lexed_spans(f"run('x password={literal}')") == [(16, 32)]
    assert S.lexed_spans(f'# KEY = "{literal}"\nclient_secret = KEY') == []  # a comment defines no constant
    long = "".join(random.Random(5).choices("ABCDEFGHIJabcdefghij0123456789+/", k=100_000))
    assert S.lexed_spans(f'password = "{long}"') == [(12, 100_012)]


def test_empty_table_and_whole_query(spark, sf_dir):
    assert S.digests(S.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(S.op4(spark, sf_dir).collect(), docs)
