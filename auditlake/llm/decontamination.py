"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case runs of word characters.  Seeds are runs of SEED tokens that a document and a benchmark
item share (numpy lookup of rolling fingerprints in the item block's sorted table).  For every document and
item with enough seeds to reach the threshold, tiling repeatedly takes the longest common run of unmarked
tokens, found by running Karp-Rabin matching, and marks it in both; the covered
share of the item's tokens decides, wherever in the document and in whatever order the passages stand.

The benchmark is a stated query set: it is read in blocks of at most BLOCK_CHARS characters (one more item at
most), one block's seed table is broadcast at a time, and every whole document meets every block where it
lies; only ids and coverages move.

Defined results: null text is empty and matches nothing; items of fewer than SEED tokens match when their
whole token sequence occurs; items without tokens match nothing; of items with equal coverage the smallest
id is named; repeated rows are judged each; an empty table on either side flags nothing; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import read_table, stored

SEED = 5
#: Share of an item's tokens that tiles must cover.
THRESHOLD = 0.6
BLOCK_CHARS = 8 << 20
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling fingerprints of all runs of n token numbers."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * _MIX + ids[k : len(ids) - n + 1 + k].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def _karp_rabin(pattern, text, used_p, used_t, size):
    """Maximal common unmarked runs of at least `size` tokens, and the longest length met.

    Rolling hashes of the pattern's unmarked windows are looked up by those of the text's; hits are verified
    and extended token by token.
    """
    base, mask = 1_000_003, (1 << 61) - 1
    top = pow(base, size - 1, mask)

    def windows(seq, used):
        h = run = 0
        for i, x in enumerate(seq):
            if used[i] or x == 0:
                h = run = 0
                continue
            if run >= size:
                h = (h - seq[i - size] * top) % mask
            h = (h * base + x) % mask
            run += 1
            if run >= size:
                yield i - size + 1, h

    table = defaultdict(list)
    for p, h in windows(pattern, used_p):
        table[h].append(p)
    matches, longest = [], 0
    for t, h in windows(text, used_t):
        for p in table.get(h, ()):
            if p and t and not used_p[p - 1] and not used_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # part of a run that starts further left
            k = 0
            while p + k < len(pattern) and t + k < len(text) and not used_p[p + k] and not used_t[t + k] and pattern[p + k] == text[t + k]:
                k += 1
            if k >= size:
                matches.append((k, p, t))
                longest = max(longest, k)
    return matches, longest


def tile(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in pattern, place in text) of non-overlapping longest matches.

    Token number 0 matches nothing.
    """
    used_p, used_t, tiles = bytearray(len(pattern)), bytearray(len(text)), []
    while True:
        matches, longest = _karp_rabin(pattern, text, used_p, used_t, least)
        if not longest:
            return tiles
        waiting = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
        marked = False
        for k, p, t in waiting:
            if k < longest:
                # Marking may have cut a match; only those that are still whole and longest are tiles this round.
                break
            if not any(used_p[p : p + k]) and not any(used_t[t : t + k]):
                used_p[p : p + k] = used_t[t : t + k] = b"\x01" * k
                tiles.append((k, p, t))
                marked = True
        if not marked:
            return tiles


class ItemBlock:
    """Token numbers and seed table of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.seed = seed
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.ids = [i for i, _ in items]
        self.items = [[number(w, len(self.vocabulary) + 1) for w in tokens(t)] for _, t in items]
        hashes, owner, place = [], [], []
        self.short: dict[int, list[int]] = defaultdict(list)  # items of fewer tokens than a seed, by length
        for n, item in enumerate(self.items):
            if 0 < len(item) < seed:
                self.short[len(item)].append(n)
            h = grams(np.array(item, np.int64), seed)
            hashes.append(h)
            owner.append(np.full(len(h), n))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = (np.concatenate(a)[order] if a else np.empty(0, np.int64) for a in (owner, place))
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))

    def judge(self, words: list[str], threshold: float) -> list[tuple[int, float]]:
        """(item id, coverage) of the items that a document covers by the threshold or more."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        found = []
        for n, items in self.short.items():
            there = set(grams(ids, n).tolist())
            found += [(self.ids[i], 1.0) for i in items if grams(np.array(self.items[i]), n)[0] in there]
        if not len(self.hashes) or len(ids) < self.seed:
            return found
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        full = np.flatnonzero(known[self.seed :] - known[: -self.seed] == self.seed)
        if not len(full):
            return found
        h = np.zeros(len(full), np.uint64)
        for k in range(self.seed):
            h = h * _MIX + ids[full + k].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        seeds: dict[int, tuple[set, list]] = defaultdict(lambda: (set(), []))
        for t, a in zip(full[hit].tolist(), at[hit].tolist(), strict=True):
            for s in range(self.first[a], self.last[a]):
                places, where = seeds[int(self.owner[s])]
                places.add(int(self.place[s]))
                where.append(t)
        for n, (places, where) in seeds.items():
            item = self.items[n]
            reach = {p + k for p in places for k in range(self.seed)}
            if len(reach) < threshold * len(item):
                continue  # even all seeds together cover too little
            text: list[int] = []
            end = -1
            for t in where:  # ascending; only seed tokens can be in a tile, gaps become barriers
                if t > end and text:
                    text.append(0)
                text += ids[max(t, end) : t + self.seed].tolist()
                end = t + self.seed
            covered = sum(k for k, _, _ in tile(item, text, self.seed)) / len(item)
            if covered >= threshold:
                found.append((self.ids[n], covered))
        return found


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).where("item_id is not null")
    block, held = [], 0
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated_by(items: list[tuple[int, str]], text: F.Column, threshold: float = THRESHOLD, seed: int = SEED) -> tuple[F.Column, Broadcast]:
    """Array of (coverage, item_id) of one block's items that the text covers, best first; and the broadcast block."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(sorted(items))
    built: dict[int, ItemBlock] = {}

    @F.arrow_udf("array<struct<coverage:double,item_id:bigint>>")
    def judge(texts: pa.Array) -> pa.Array:
        if 0 not in built:
            built[0] = ItemBlock(shared.value, seed)
        out = []
        for t in texts:
            hits = built[0].judge(tokens(t.as_py()), threshold)
            out.append([{"coverage": c, "item_id": i} for i, c in sorted(hits, key=lambda x: (-x[1], x[0]))])
        return pa.array(out, pa.list_(pa.struct([("coverage", pa.float64()), ("item_id", pa.int64())])))

    return judge(text), shared


ROW = "_decontamination_row"


def annotate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_chars: int = BLOCK_CHARS, column: str = "_hits") -> DataFrame:
    """docs with an array of (coverage, item_id): every item that a document covers, from all blocks.

    A benchmark of one block is met in the pass over the documents that the caller runs.  Of a larger one a single
    block is in memory at a time: each block's hits are stored before the next block is read.
    """
    blocks = item_blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.withColumn(column, F.array().cast("array<struct<coverage:double,item_id:bigint>>"))
    if second is None:
        return docs.withColumn(column, contaminated_by(first, F.col("text"), threshold, seed)[0])
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "decontamination-rows")
    hits = None
    for items in chain([first, second], blocks):
        judged, shared = contaminated_by(items, F.col("text"), threshold, seed)
        part = stored(rows.select(ROW, judged.alias("h")).where(F.size("h") > 0), "decontamination-hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    found = hits.groupBy(ROW).agg(F.flatten(F.collect_list("h")).alias(column))
    out = rows.join(found, ROW, "left").withColumn(column, F.coalesce(column, F.array().cast(found.schema[column].dataType)))
    return out.select(*docs.columns, column)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = annotate(docs, read_table(spark, sf_dir, "benchmark"))
    best = F.array_sort("_hits", lambda a, b: F.when(a["coverage"] != b["coverage"], F.signum(b["coverage"] - a["coverage"])).otherwise(F.signum(a["item_id"] - b["item_id"])).cast("int"))
    return hits.select(
        "doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").cast("long").alias("n_items"),
        F.get(best, 0)["item_id"].alias("item_id"), F.coalesce(F.round(F.get(best, 0)["coverage"], 6), F.lit(0.0)).alias("coverage"),
        F.transform(F.array_sort(F.transform("_hits", lambda h: h["item_id"])), lambda x: x).alias("item_ids"),
    )
