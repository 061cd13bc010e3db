"""Near-dedup with SetSketch registers.

A document's set is its distinct word shingles (64-bit fingerprints).  Equal sets (equal 128-bit sums of
independently mixed fingerprints, and equal sizes) form a class first, and one representative a class goes on.
A register holds the truncated, exponentially spaced minimum K = floor(1 - log_b(min Exp)); registers merge by
maximum.  Bands of registers put likely partners into buckets.

No bucket is expanded into pairs.  Buckets are searched in rounds of stars:

* The member with the largest buckets is a bucket's centre.  The joint likelihood of the registers estimates every
  other member's similarity to it; members that are not far (FAR) are compared with it on full shingle sets, and
  links are confirmed word by word.
* Members that are not linked with their centre form the next round's bucket, with a centre of their own.  So two
  families that share a bucket each become a star, and each round costs one row a member that is left.

For a pair x, y of one bucket there are these cases in a round with centre c.  Both are linked with c: one
component.  Neither is: both are in the next round.  Only x is: then y's similarity to c is at least 0.6 (the
Jaccard distance is a metric, and two links of 0.2 reach to 0.4), so y is not far, and both differences to c are
known exactly.  For these pairs the components of the stars are found first; then a join on the rare part of the
differences finds every pair that lies in two different components, restricted to elements that stand in
differences of two components and to rows that can still reach the overlap they need (`between_components`).
What is left after ROUNDS rounds, in buckets with a member far from their last centre, is compared with a prefix
join on whole sets (`prefix_pairs`).  Both joins are exact.  So a pair is lost only if it shares no band (3e-6 at
0.8) or if the estimate of a similarity of 0.6 or more falls below FAR (five standard deviations) in every bucket
that it shares.  Components are found by alternating large-star and small-star steps; nothing is collected.

Hot keys (a class or a centre that a third of the rows share) are dealt over several tasks.

Defined results: null or blank texts have an empty set, are linked with nothing and are their own component;
rows that repeat an id are one node (with all their texts' links), and each keeps its own n_shingles; null ids
take part in no link and keep component null; ties go to the smallest id; very long texts are used whole; an
empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import wordcodes as W
from auditlake.llm.common import bounded_batches, read_table, spread_join, stored, texts
from auditlake.operators.graph import connected_components

SHINGLE = 5  # words, unless a contract says otherwise
THRESHOLD = 80  # per cent
REGISTERS, BAND = 160, 5
BASE, RATE = 1.002, 20.0
#: Estimated similarity to a centre under which a member is far from it (see above: 0.6 less five deviations).
FAR = 0.4
#: Rounds of stars; what is left then is compared by a prefix join.
ROUNDS = 3
BLOCK_BYTES = 1 << 20
_RNG = np.random.default_rng(8)
_FACTOR = _RNG.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, REGISTERS, np.uint64)
_PLACE = [int(x) for x in _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)]


def runs_of_words(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of `size` words."""
    n = len(words)
    h = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size if len(h) else 0):
        h += words[k : n - size + 1 + k] * np.uint64(_PLACE[k])
    return W.mix(h)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    words, first = W.word_hashes(data, offsets, W.LOWER_CODE)
    h = runs_of_words(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:  # the whole sequence as one, told from full shingles by its length
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = whole * np.uint64(_BIG) + words[k]
            out.append(W.mix(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_BIG = _PLACE[63]


def set_key(elements: np.ndarray) -> tuple[int, int, int]:
    """128-bit fingerprint of a set, and its size."""
    with np.errstate(over="ignore"):
        a, b = W.mix(elements).sum(dtype=np.uint64), W.mix(elements * np.uint64(_BIG)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64)), len(elements)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    work = np.empty_like(flat)
    for i in range(REGISTERS):
        np.multiply(flat, _FACTOR[i], out=work)
        np.add(work, _SHIFT[i], out=work)
        np.minimum.reduceat(work, at, out=least[i])
    exp = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exp) / np.log(BASE)), 0, 65535).astype(np.uint16).T.copy()


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    bands = regs.reshape(len(regs), -1, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(BAND):
        h = W.mix(h * np.uint64(_BIG) + bands[:, :, k])
    return h.view(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most joint likelihood, given register rows and set sizes."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    up, down = p(u - v * grid), p(v - u * grid)
    likelihood = above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return grid[np.arange(len(grid)), likelihood.argmax(1)]


SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, regs binary, bands array<bigint>"


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Set size, 128-bit set fingerprint, registers and band keys of every document of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                sets = shingles(data, offsets, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                regs = np.zeros((len(sets), REGISTERS), np.uint16)
                key = np.zeros((2, len(sets)), np.uint64)
                bands, n_bands = np.empty(0, np.int64), REGISTERS // BAND
                if len(full):
                    some = [sets[i] for i in full]
                    regs[full] = registers(some)
                    flat, at = np.concatenate(some), np.concatenate([[0], np.cumsum(n[full])])[:-1]
                    key[0, full] = np.add.reduceat(W.mix(flat), at)
                    key[1, full] = np.add.reduceat(W.mix(flat * np.uint64(_BIG)), at)
                    bands = band_keys(regs[full]).ravel()
                ends = np.concatenate([[0], np.cumsum((n > 0) * n_bands)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(np.arange(len(sets) + 1, dtype=np.int32) * (2 * REGISTERS)), pa.py_buffer(regs)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sets)), pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), raw, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands))],
                    [c.split()[0] for c in SKETCH.split(", ")],
                )

    return docs.mapInArrow(run, SKETCH)


def _regs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


@F.arrow_udf(T.DoubleType())
def estimate_column(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    parts = [joint_estimate(_regs_of(a.slice(i, 4096)), _regs_of(b.slice(i, 4096)), np.asarray(n_a.slice(i, 4096), float), np.asarray(n_b.slice(i, 4096), float)) for i in range(0, len(a), 4096)]
    return pa.array(np.concatenate(parts))


def same_words(x: bytes, y: bytes, size: int, threshold: int) -> bool:
    """Whether shingles with equal fingerprints that two texts share are equal words, for as many as the threshold needs."""
    a, b = x.lower().split(), y.lower().split()  # bytes: A-Z, and exactly 0x20 and 0x09-0x0D
    if len(a) < size or len(b) < size:
        return a == b
    (p, at_p), (q, at_q) = (np.unique(runs_of_words(W.word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]), W.LOWER_CODE)[0], size), return_index=True) for t in (x, y))
    _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    equal = sum(a[s : s + size] == b[t : t + size] for s, t in zip(at_p[i].tolist(), at_q[j].tolist(), strict=True))
    return 100 * equal >= threshold * (len(p) + len(q) - equal)


def difference_column(size: int, threshold: int, a: F.Column, b: F.Column) -> F.Column:
    """Set sizes of two texts, the shingles that only one of them has, and whether they are alike, word by word."""

    @F.arrow_udf("struct<n_a:bigint,n_b:bigint,delta:array<bigint>,alike:boolean>")
    def difference(left: pa.Array, right: pa.Array) -> pa.Array:
        known: dict[bytes, np.ndarray] = {}

        def set_of(text: bytes) -> np.ndarray:
            if text not in known:
                if len(known) >= 8:
                    known.pop(next(iter(known)))
                known[text] = shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0]
            return known[text]

        n_a, n_b, deltas, alike = [], [], [], []
        for x, y in zip(left, right, strict=True):
            x, y = x.as_py().encode(), y.as_py().encode()
            p, q = set_of(x), set_of(y)
            n_a.append(len(p))
            n_b.append(len(q))
            deltas.append(np.setxor1d(p, q, assume_unique=True).view(np.int64))
            n, d = len(p) + len(q), len(deltas[-1])
            alike.append(n > d and 100 * (n - d) >= threshold * (n + d) and same_words(x, y, size, threshold))
        ends = np.concatenate([[0], np.cumsum([len(d) for d in deltas])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *deltas])
        parts = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(alike, pa.bool_())]
        return pa.StructArray.from_arrays(parts, ["n_a", "n_b", "delta", "alike"])

    return difference(a, b)


def _compared(pairs: DataFrame, bodies: DataFrame, size: int, threshold: int) -> DataFrame:
    """(a, b, n_a, n_b, delta, alike) of stored pairs, on full sets."""
    left = bodies.select(F.col("nid").alias("a"), F.col("text").alias("t_a"))
    right = bodies.select(F.col("nid").alias("b"), F.col("text").alias("t_b"))
    met = spread_join(pairs.select("a", "b"), right, ["b"], ["a"]).join(left, "a")
    return met.select("a", "b", difference_column(size, threshold, F.col("t_a"), F.col("t_b")).alias("d")).select("a", "b", "d.n_a", "d.n_b", "d.delta", "d.alike")


def star_round(members: DataFrame, known: DataFrame | None, nodes: DataFrame, bodies: DataFrame, size: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (bucket, nid, w): stored comparisons with centres, stored verdicts (a, b, e, alike), stored members that are left.

    Buckets that have one centre become one in the next round; pairs with a known verdict are not compared again.
    """
    centres = members.groupBy("bucket").agg(F.min(F.struct((-F.col("w")).alias("w"), F.xxhash64("nid").alias("h"), "nid")).alias("c"))
    starred = members.join(centres.select("bucket", F.col("c.nid").alias("b")), "bucket").where("nid <> b")
    pairs = stored(starred.groupBy(F.col("nid").alias("a"), "b").agg(F.min("w").alias("w")), "near-pairs")
    fresh = pairs if known is None else stored(pairs.join(known, ["a", "b"], "left_anti"), "near-fresh")
    regs = nodes.select("nid", "regs", "n")
    sides = spread_join(fresh, regs.select(F.col("nid").alias("b"), F.col("regs").alias("r_b"), F.col("n").alias("s_b")), ["b"], ["a"])
    sides = sides.join(regs.select(F.col("nid").alias("a"), F.col("regs").alias("r_a"), F.col("n").alias("s_a")), "a")
    likely = stored(sides.select("a", "b", estimate_column("r_a", "r_b", "s_a", "s_b").alias("e")), "near-likely")
    with bounded_batches(members.sparkSession):
        compared = stored(_compared(likely.where(F.col("e") >= FAR), bodies, size, threshold), "near-compared")
    verdict = likely.join(compared.where("alike").select("a", "b", "alike"), ["a", "b"], "left").select("a", "b", "e", F.coalesce("alike", F.lit(False)).alias("alike"))
    verdict = stored(verdict if known is None else verdict.unionByName(known), "near-verdicts")
    left = pairs.join(verdict.where("not alike"), ["a", "b"]).select(F.col("b").alias("bucket"), F.col("a").alias("nid"), "w", (F.col("e") < FAR).alias("far"))
    several = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max("far").alias("any_far")).where("k > 1")
    left = stored(left.join(several.select("bucket", "any_far"), "bucket").select("bucket", "nid", "w", "any_far"), "near-left")
    return compared, verdict, left


def between_components(compared: DataFrame, label: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs of one centre's members, in different components, whose differences to it leave them alike.

    With t the threshold and tau = (1 - t) / (1 + t), sets are alike when their symmetric difference is at most
    tau times their sizes' sum, so x and y must share need = (|dx| + |dy| - tau (|x| + |y|)) / 2 elements of
    their differences.  One of them is not linked with the centre (y, say: |dy| > tau (|y| + |c|)), so need is
    positive, and the first shared element in any one order of all elements stands among the first
    |dx| - need + 1 of x and the first |dy| - need + 1 of y.  The order puts elements of one component only first
    (they match nothing, but count as places), then rare ones.
    """
    tau = (100 - threshold) / (100 + threshold)
    rows = compared.select(F.col("a").alias("nid"), F.col("b").alias("c"), F.col("n_a").alias("n"), F.col("n_b").alias("n_c"), F.size("delta").alias("d"), (~F.col("alike")).alias("far"), "delta")
    rows = rows.join(label, F.col("nid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "nid")).drop("node", "component")
    mixed = rows.groupBy("c").agg(F.max("far").alias("some"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("some and lo <> hi").select("c")
    rows = stored(rows.join(mixed, "c", "left_semi"), "near-mixed")
    each = rows.select("c", "nid", "label", "far", "n", "d", F.explode("delta").alias("el"))
    short = F.col("d") - tau * F.col("n")
    often = each.groupBy("c", "el").agg(
        F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.when(F.col("far"), short)).alias("least_far"), F.min(short).alias("least")
    ).where("lo <> hi and least_far is not null").select("c", "el", "df", "least_far", "least")
    order = each.select("c", "nid", "el").join(often, ["c", "el"]).groupBy("c", "nid").agg(F.sort_array(F.collect_list(F.struct("df", "el", "least_far", "least"))).alias("els"))
    ranked = order.join(rows.drop("delta"), ["c", "nid"])
    place = F.col("d") - F.size("els") + F.col("i") + 1
    placed = ranked.select("c", "nid", "label", "n", "n_c", "d", "far", "els", F.posexplode("els").alias("i", "e"))
    placed = stored(placed.select("c", "nid", "label", "n", "d", "far", place.alias("p"), "e.el", "e.least_far", "e.least"), "near-places")
    room = F.col("d") - F.col("p") + 1 + 1e-9  # at most so many shared elements follow
    x = placed.where(room >= (short + F.col("least_far")) / 2).select("c", "el", F.col("nid").alias("x"), F.col("label").alias("l_x"), F.col("n").alias("n_x"), F.col("d").alias("d_x"), F.col("p").alias("p_x"))
    y = placed.where("far").where(room >= (short + F.col("least")) / 2).select("c", "el", F.col("nid").alias("y"), F.col("label").alias("l_y"), F.col("n").alias("n_y"), F.col("d").alias("d_y"), F.col("p").alias("p_y"))
    need = (F.col("d_x") + F.col("d_y") - tau * (F.col("n_x") + F.col("n_y"))) / 2
    early = F.least(F.col("d_x") - F.col("p_x"), F.col("d_y") - F.col("p_y")) + 1 >= need - 1e-9
    met = x.join(y, ["c", "el"]).where((F.col("l_x") != F.col("l_y")) & early)
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def prefix_pairs(members: DataFrame, bodies: DataFrame, label: DataFrame, size: int, threshold: int) -> DataFrame:
    """(a, b): pairs of different components that share an element of both sets' prefixes, in an order of all elements."""

    @F.arrow_udf("array<bigint>")
    def elements(column: pa.Array) -> pa.Array:
        sets = [shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]), size)[0] for t in (x.as_py().encode() for x in column)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))

    rows = bodies.join(members.select("nid").distinct(), "nid", "left_semi").join(label, F.col("nid") == F.col("node"), "left")
    rows = rows.select("nid", F.coalesce("component", "nid").alias("label"), elements("text").alias("els"))
    with bounded_batches(members.sparkSession):
        rows = stored(rows, "near-rest")
    each = rows.select("nid", "label", F.size("els").alias("n"), F.explode("els").alias("el"))
    often = each.groupBy("el").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("el", "df")
    order = each.join(often, "el").groupBy("nid", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "el"))).alias("els"))
    placed = order.select("nid", "label", "n", (F.col("n") - F.size("els")).alias("lone"), F.posexplode("els").alias("i", "e")).select("nid", "label", "n", (F.col("lone") + F.col("i") + 1).alias("p"), "e.el")
    prefix = placed.where(100 * (F.col("n") - F.col("p") + 1) >= threshold * F.col("n"))
    x = prefix.select("el", F.col("nid").alias("x"), F.col("label").alias("l_x"), F.col("n").alias("n_x"), F.col("p").alias("p_x"))
    y = prefix.select("el", F.col("nid").alias("y"), F.col("label").alias("l_y"), F.col("n").alias("n_y"), F.col("p").alias("p_y"))
    # Of two alike sets the shared elements number at least threshold * (n_x + n_y) / (100 + threshold).
    early = (100 + threshold) * (F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")) + 1) >= threshold * (F.col("n_x") + F.col("n_y"))
    sized = (100 * F.col("n_x") >= threshold * F.col("n_y")) & (100 * F.col("n_y") >= threshold * F.col("n_x"))
    met = x.join(y, "el").where((F.col("l_x") < F.col("l_y")) & early & sized)
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _components(buckets: DataFrame, nodes: DataFrame, bodies: DataFrame, extra: DataFrame, size: int, threshold: int) -> DataFrame:
    """(node, component) of linked nodes; `extra` holds links that are known beforehand."""
    heavy = buckets.groupBy("bucket").agg((1e6 * F.log(F.count(F.lit(1)).cast("double"))).cast("long").alias("w"))
    weight = buckets.join(heavy, "bucket").groupBy("nid").agg(F.sum("w").alias("w"))
    left, known, going, done = buckets.join(weight, "nid"), None, True, []
    for _ in range(ROUNDS):
        compared, known, left = star_round(left, known, nodes, bodies, size, threshold)
        done.append(compared)
        going = not left.isEmpty()
        if not going:
            break
    compared = done[0]
    for more in done[1:]:
        compared = compared.unionByName(more)
    label = stored(connected_components(compared.where("alike").select("a", "b").unionByName(extra)), "near-labels")
    pairs = between_components(compared, label, threshold)
    rest = left.where("any_far")
    if going and not rest.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(rest, bodies, label, size, threshold)).distinct()
    pairs = stored(pairs, "near-between")
    with bounded_batches(buckets.sparkSession):
        links = stored(_compared(pairs, bodies, size, threshold).where("alike").select("a", "b"), "near-late")
    if links.isEmpty():
        return label
    # The components that late links join, as a graph of their own.
    named = links
    for side in ("a", "b"):
        named = named.join(label.withColumnRenamed("node", side), side, "left").withColumn(f"l_{side}", F.coalesce("component", side)).drop("component")
    above = stored(connected_components(named.select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))), "near-above")
    above = above.withColumnRenamed("node", "under").withColumnRenamed("component", "top")
    lone = named.select(F.explode(F.array("l_a", "l_b")).alias("node")).distinct()
    known = label.unionByName(lone.join(label, "node", "left_anti").withColumn("component", F.col("node")))
    return known.join(above, F.col("component") == F.col("under"), "left").select("node", F.coalesce("top", "component").alias("component"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    plain = texts(docs, id_col, text_col)
    key = ["set_a", "set_b", "n_shingles"]
    with bounded_batches(docs.sparkSession):
        sketched = stored(sketches(plain, size), "near-sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy(*key).agg(F.min("doc_id").alias("rid")).withColumn("nid", F.monotonically_increasing_id()), "near-classes")
    member = spread_join(full.select("doc_id", *key), classes.select("nid", *key), key, ["doc_id"]).select("doc_id", "nid").distinct()
    member = stored(member, "near-members")
    heads = classes.select("nid", F.col("rid").alias("doc_id"), *key)
    nodes = full.join(heads, ["doc_id", *key]).select("nid", F.col("n_shingles").alias("n"), "regs", "bands")
    # Ids that stand in several rows: one row a node, and links between the texts of one id.
    again = member.groupBy("doc_id").agg(F.min("nid").alias("a"), F.count(F.lit(1)).alias("k"))
    several_rows = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    extra = member.join(again.where("k > 1"), "doc_id").select(F.col("nid").alias("b"), "a")
    if several_rows:
        nodes = nodes.dropDuplicates(["nid"])
    rows = nodes.select("nid", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo <> hi").select("bucket")
    buckets = stored(rows.join(several, "bucket").distinct(), "near-buckets")
    in_buckets = buckets.select("nid").distinct()
    nodes = stored(nodes.select("nid", "n", "regs").join(in_buckets, "nid", "left_semi"), "near-nodes")
    bodies = heads.join(in_buckets, "nid", "left_semi").select("nid", "doc_id", *key)
    bodies = _bodies(plain, bodies, sketched, size, several_rows)

    label = _components(buckets, nodes, bodies, extra, size, threshold)
    # A component's name is the smallest id in it.
    rooted = classes.select("nid", "rid").join(label, F.col("nid") == F.col("node"), "left").select("nid", "rid", F.coalesce("component", "nid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rid").alias("found"))
    of_node = stored(spread_join(stored(rooted.select("nid", "root"), "near-roots"), least, ["root"], ["nid"]).select("nid", "found"), "near-names")
    named = spread_join(member, of_node, ["nid"], ["doc_id"]).select("doc_id", "found")
    if several_rows:
        named = named.groupBy("doc_id").agg(F.min("found").alias("found"))
    out = sketched.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.expr("doc_id <=> coalesce(found, doc_id)").alias("kept"))


def _bodies(plain: DataFrame, heads: DataFrame, sketched: DataFrame, size: int, several_rows: bool) -> DataFrame:
    """(nid, text) of one text of every node, stored."""
    if not several_rows:
        return stored(plain.join(heads.select("nid", "doc_id"), "doc_id").select("nid", "text"), "near-bodies")
    # An id may have texts of several classes: sketch its texts again and take one of the node's class.
    few = stored(plain.join(heads.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), "near-texts")
    key = ["set_a", "set_b", "n_shingles"]

    @F.arrow_udf("struct<set_a:bigint,set_b:bigint,n_shingles:bigint>")
    def named(column: pa.Array) -> pa.Array:
        out = [set_key(shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]), size)[0]) for t in (x.as_py().encode() for x in column)]
        return pa.array([dict(zip(key, x, strict=True)) for x in out], pa.struct([(k, pa.int64()) for k in key]))

    with bounded_batches(plain.sparkSession):
        keyed = stored(few.select("doc_id", "text", named("text").alias("k")).select("doc_id", "text", "k.*"), "near-keyed")
    return stored(keyed.join(heads, ["doc_id", *key]).groupBy("nid").agg(F.min("text").alias("text")), "near-bodies")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), size=4)
