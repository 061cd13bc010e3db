import random

from pyspark.sql import functions as F

from auditlake.llm import decontamination as D


def brute_tiles(pattern, text, least):
    """Greedy string tiling by comparing all pairs of positions."""
    used_p, used_t, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and p + k not in used_p and t + k not in used_t and pattern[p + k] == text[t + k] != 0:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return covered
        used_p |= set(range(p, p + k))
        used_t |= set(range(t, t + k))
        covered += k


def test_tiles_as_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        pattern = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 26))]
        text = [rng.randrange(0, 5) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.7:
            cut = rng.randrange(len(pattern))
            text += pattern[cut:] + [0] + pattern[:cut]
        for least in (2, 3, 5):
            assert sum(k for k, _, _ in D.tile(pattern, text, least)) == brute_tiles(pattern, text, least)


ITEM = " ".join(f"word{i}" for i in range(24))


def test_reordered_partial_and_clean(spark):
    w = ITEM.split()
    reordered = " ".join(w[16:] + ["x"] + w[8:16] + ["y", "z"] + w[:8])
    docs = [(1, "a b " + ITEM.upper().replace(" ", ", ") + " c"), (2, reordered), (3, " ".join(w[:12])), (4, " ".join(reversed(w))), (5, None), (6, ""), (7, "tiny one"), (7, "tiny one"), (8, "fill " * 100_000 + ITEM)]
    bench = [(10, ITEM), (11, "Tiny, one!"), (12, ""), (13, None), (14, ITEM)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, coverage double")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    got = D.annotate(df, bf).select("doc_id", "_hits").collect()
    ids = [(r["doc_id"], [h["item_id"] for h in r["_hits"]]) for r in got]
    assert sorted(ids) == ids == [(1, [10, 14]), (2, [10, 14]), (3, []), (4, []), (5, []), (6, []), (7, [11]), (7, [11]), (8, [10, 14])]
    small = D.annotate(df, bf, block_chars=10).select("doc_id", F.array_sort(F.transform("_hits", lambda h: h["item_id"])).alias("i")).collect()
    assert sorted((r["doc_id"], r["i"]) for r in small) == ids  # blocks change nothing


def test_empty_sides(spark):
    df, bf = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.annotate(df.limit(0), bf).count() == 0
    assert D.annotate(df, bf.limit(0)).first()["_hits"] == []


def test_whole_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = {i: D.tokens(t) for i, t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()}
    got = {r["doc_id"]: r for r in D.op7(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    spaced = {d: f" {' '.join(D.tokens(t))} " for d, t in docs}
    for d, t in docs:
        words = D.tokens(t)
        want = []
        for i, item in items.items():
            seeds = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
            if not any(f" {' '.join(s)} " in spaced[d] for s in seeds):
                continue
            numbers = {w: n for n, w in enumerate(dict.fromkeys(item), 1)}
            near = [numbers.get(w, 0) for w in words]
            if len(near) * len(item) < 200_000 and brute_tiles([numbers[w] for w in item], near, 5) >= 0.6 * len(item):
                want.append(i)
            elif len(near) * len(item) >= 200_000 and f" {' '.join(item)} " in spaced[d]:
                want.append(i)
        assert got[d]["item_ids"] == sorted(want)
    assert any(r["contaminated"] for r in got.values())
