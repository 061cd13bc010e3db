import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import substring_dedup as T
from auditlake.llm import suffix_dedup as S


def ordered(docs):
    return sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def brute_bytes(docs, length=100):
    seen, out = set(), []
    for doc_id, text in ordered(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(docs, length):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    n = Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    """Shared passages at random places, near copies, exact copies, periodic texts."""
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice("the of and to alpha beta gamma delta épsilon zeta eta theta 日本 x".split()) + rng.choice(["", "", "s", str(rng.randrange(99))]) for _ in range(k))

    passages = [prose(rng.randrange(20, 80)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = prose(rng.randrange(0, 120))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                words = p.split()
                words[rng.randrange(len(words))] = "edited"
                p = " ".join(words)
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + rng.choice(["", " "]) + p + rng.choice(["", "\n"]) + t[cut:]
        texts.append(t)
    texts += rng.choices(texts, k=20)
    texts += ["", None, "a", "ab" * 400, "abc " * 300, "z" * 99, "z" * 100, "z" * 101, "w " * 34, "v " * 35, "u " * 36, "long " + "q" * 50_000, passages[0]]
    return texts


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_removed int, key string")


@pytest.mark.parametrize("hot,spread", [(4096, 64), (3, 64), (3, 2), (10_000, 2)])
def test_bytes_as_brute_force(spark, hot, spread):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    docs = list(zip(ids, corpus(hot + spread)))
    assert sorted(map(tuple, S.suffix_dedup(frame(spark, docs), hot=hot, spread=spread).collect()), key=str) == brute_bytes(docs)


@pytest.mark.parametrize("hot,spread,window", [(4096, 64, 35), (3, 64, 35), (3, 2, 12), (10_000, 2, 50)])
def test_words_as_brute_force(spark, hot, spread, window):
    docs = list(enumerate(corpus(hot + spread + window)))
    assert sorted(map(tuple, T.substring_dedup(frame(spark, docs), window=window, hot=hot, spread=spread).collect()), key=str) == brute_words(docs, window)


def test_repeated_and_null_ids(spark):
    texts = corpus(9, 30)
    docs = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0])]
    assert sorted(map(tuple, S.suffix_dedup(frame(spark, docs)).collect()), key=str) == brute_bytes(docs)
    assert sorted(map(tuple, T.substring_dedup(frame(spark, docs), window=35).collect()), key=str) == brute_words(docs, 35)


def test_words_of_one_polynomial(spark):
    """Windows that differ in one word, which every polynomial modulo 2**64 takes for equal."""
    docs = []
    for n in (1024, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        for middle in (word, word.translate(str.maketrans("ab", "ba"))):
            docs.append((len(docs), " ".join([f"{n}w{i}" for i in range(20)] + [middle] + [f"{n}v{i}" for i in range(20)])))
    assert sorted(map(tuple, T.substring_dedup(frame(spark, docs), window=35).collect()), key=str) == brute_words(docs, 35)
    assert sorted(map(tuple, S.suffix_dedup(frame(spark, docs)).collect()), key=str) == brute_bytes(docs)


def test_empty_table(spark):
    assert S.suffix_dedup(frame(spark, []).limit(0)).count() == 0
    assert T.substring_dedup(frame(spark, []).limit(0)).count() == 0


def test_small_trees_split_by_longer_prefixes():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 3, 600).astype(np.uint64)
    symbols[300:380] = symbols[20:100]
    where = np.arange(600 - 12)
    words = [tuple(symbols[i : i + 12]) for i in where]
    n = Counter(words)
    want = sorted(i for i in where if n[words[i]] > 1)
    for group in (2, 5, 50, 10_000):
        assert sorted(T.finder(12, group)(symbols, where, where * 0, where, True).tolist()) == want


def test_radix_groups_are_the_repeated_windows():
    raw = np.frombuffer(("abcabd" * 60 + "xyz" * 50).encode(), np.uint8)
    where = np.arange(len(raw) - 99)
    windows = [raw[i : i + 100].tobytes() for i in where]
    n = Counter(windows)
    alive, group = S.radix_groups(raw, where, 100)
    assert sorted(alive.tolist()) == [i for i in where if n[windows[i]] > 1]
    assert len(set(group.tolist())) == sum(k > 1 for k in n.values())


def test_whole_queries(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op3(spark, sf_dir).collect()), key=str) == brute_bytes(docs)
    assert sorted(map(tuple, T.op9(spark, sf_dir).collect()), key=str) == brute_words(docs, 35)
