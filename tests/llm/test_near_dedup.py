import random
import re

import numpy as np
import pytest

from auditlake.llm import near_dedup as N


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute(docs, size, threshold=80):
    sets = {d: shingle_set(t, size) for d, t in docs if d is not None}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def check(spark, docs, size):
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, component_id int")
    got = [r for r in N.near_dedup(df, size=size).collect()]
    assert len(got) == len(docs)
    want = brute(docs, size)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def test_near_copies_and_edges(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(10):  # similarities on both sides of the threshold
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one Two"), (1004, "ONE\ttwo"), (1005, "two one"), (1006, "x"), (1007, "big " * 60_000), (1008, "big " * 50_000), (1009, docs[3][1]), (1009, docs[3][1]), (None, docs[3][1]), (None, None)]
    check(spark, docs, 4)
    check(spark, docs, N.SHINGLE)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    docs = []
    for i in range(300):
        copy = list(base)
        for k in rng.sample(range(120), 3):  # pairs are near the threshold, on both sides
            copy[k] = f"v{i}x{k}"
        docs.append((i, " ".join(copy)))
    check(spark, docs, 4)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n], word[:n].translate(str.maketrans("ab", "ba"))


def test_words_of_one_polynomial(spark):
    """Words that every polynomial modulo 2**64 takes for equal."""
    docs = []
    for n in (1024, 4096):
        a, b = thue_morse(n)
        docs += [(len(docs), f"one {a} two three"), (len(docs) + 1, f"one {b} two three"), (len(docs) + 2, f"One {a} two  three")]
    check(spark, docs, 4)


def test_confirmed_word_by_word():
    x, y = b"a b c d e f g h i j", b"A b c d e f g h i  j"
    assert N.same_words(x, y, 4, 80) and not N.same_words(x, b"a b c d x f g h i j", 4, 80)
    assert N.same_words(b"a b", b"A  b", 4, 80) and not N.same_words(b"a b", b"a c", 4, 80)


def test_rows_that_repeat_an_id(spark):
    """One id with several texts is one node: it is linked with whatever one of its texts is linked with."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    docs = [(1, a), (5, a + " more"), (5, b), (5, b), (9, b + " more"), (7, c), (7, ""), (3, c + " more"), (None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in N.near_dedup(df).collect() if r["doc_id"])
    assert got == [(1, 1), (3, 3), (5, 1), (5, 1), (5, 1), (7, 3), (7, 3), (9, 1)]


def family(rng, base, n, start):
    out = []
    for i in range(start, start + n):
        copy = list(base)
        for k in rng.sample(range(len(base)), 3):
            copy[k] = f"v{i}x{k}"
        out.append((i, " ".join(copy)))
    return out


def test_related_families(spark, monkeypatch):
    """Two families that share 65 % of their words, and one whose members are all under the threshold: what the
    joins meet grows in proportion."""
    met = {}
    kept = N.stored

    def counting(df, name):
        out = kept(df, name)
        met[name] = met.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "stored", counting)
    sizes = {}
    for n in (200, 800):
        rng = random.Random(n)
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = base[:195] + [f"z{k}" for k in range(105)]
        loose = [f"t{k}" for k in range(100)]
        docs = family(rng, base, 2 * n // 3, 0) + family(rng, other, n // 3, n)
        docs += [(5000 + i, " ".join(loose[:50] + [f"u{i}x{k}" for k in range(16)] + loose[50:])) for i in range(n // 6)]
        met.clear()
        if n == 200:
            check(spark, docs, 5)
        else:
            N.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).count()
        sizes[n] = dict(met)
    for name in ("near-pairs", "near-compared", "near-between", "near-left"):
        few, many = sizes[200].get(name, 0), sizes[800].get(name, 0)
        assert many <= 6 * few + 400, (name, few, many)


@pytest.mark.parametrize("rounds", [0, 1])
def test_prefix_join_of_what_is_left(spark, monkeypatch, rounds):
    """With all members far after each round, the prefix join alone must find the links."""
    monkeypatch.setattr(N, "FAR", 2.0)
    monkeypatch.setattr(N, "ROUNDS", rounds + 1)
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    check(spark, family(rng, base, 40, 0), 5)


def test_empty_and_no_links(spark):
    assert N.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "a b c d e f"), (3, "g h i j k")], 5)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_registers_merge_and_estimate(similarity):
    rng = np.random.default_rng(1)
    est = []
    for _ in range(30):
        n = 1000
        shared = round(2 * n * similarity / (1 + similarity))
        x = rng.integers(0, 1 << 63, 2 * n - shared, np.uint64)
        a, b = N.W.mix(x[:n]), N.W.mix(x[n - shared :])
        r = N.registers([a, b, np.union1d(a, b)])
        assert (np.maximum(r[0], r[1]) == r[2]).all()
        est.append(N.joint_estimate(r[:1], r[1:2], np.array([n]), np.array([len(b)]))[0])
    assert abs(np.mean(est) - similarity) < 0.02


def test_whole_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in N.op8(spark, sf_dir).collect()} == brute(docs, 4)
