"""Windows of L symbols (bytes or words) that occur more than once, for the two repeat-removing operators.

1. Every document is fingerprinted once.  Of the k-grams of each window one anchor is chosen by content (the
   least hash), so equal windows have equal anchors at equal offsets; about 2 / (L - k + 2) of all positions
   are anchors, and only they travel, packed as numpy arrays, to the bucket of their hash.
2. In a bucket, anchors that occur once end there.  Anchors with an equal whole surrounding (all symbols that
   a window around the anchor can hold) are repeats over that whole surrounding (mark R).  One anchor for each
   distinct surrounding of a repeated anchor goes on (mark F).
3. F anchors fetch the symbols of the windows they stand for; the operator's own method (radix passes or suffix
   trees) finds the equal windows among those that share an anchor.
   Surroundings and hot windows are equal when two 64-bit fingerprints over independent symbol values are.
4. R and window marks meet their documents again, and the covered symbols are removed.

Equal surroundings collapse in the map task, so a passage that a third of all documents share ships one row a
task; where one task meets an anchor in many surroundings, these rows are dealt by surrounding instead; and an
anchor with more than HOT surroundings in all sends window fingerprints (collapsed in the task again), which
are dealt by window, instead of symbols.  No bucket holds more than a bounded part of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import wordcodes as W
from auditlake.llm.common import plan_bytes, stored

#: Surroundings of one anchor in one task from which its rows are dealt by surrounding.
SPREAD = 64
#: Surroundings of one anchor in all from which its windows are dealt one by one.
HOT = 4096
#: Text of one document bucket, and anchors' share of one anchor bucket.
DOC_BUCKET_BYTES = 8 << 20
LEAST_BUCKET_BYTES = 256 << 10
#: Text fingerprinted at once: numpy holds about a dozen 8-byte values a symbol meanwhile.
BLOCK_BYTES = 256 << 10
PACKED = "kind int, bucket int, packed binary"
R, FINE, WINDOWS, LOCAL = 1, 2, 3, 4
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Task:
    """What repeats are looked for: symbols of a block, window and anchor length, whether the first one counts."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # bytes, offsets -> codes, offsets
    places: Callable[[np.ndarray, np.ndarray], np.ndarray]  # bytes, offsets -> offsets of each text's symbols
    length: int
    gram: int
    every: bool  # mark every occurrence, or all but the first
    anchor_buckets: int
    doc_buckets: int
    hot: int = HOT
    spread: int = SPREAD
    coded: bool = False  # symbols travel as 64-bit codes instead of bytes

    @property
    def reach(self) -> int:
        return self.length - self.gram


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def gathered(rows: list[bytes], *kinds) -> list[np.ndarray]:
    parts = [unpack(r, *kinds) for r in rows]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, k) for i, k in enumerate(kinds)]


def doc_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    u = key.view(np.uint64)
    return ((u ^ (u >> np.uint64(17)) ^ (u >> np.uint64(31))).view(np.int64) % buckets).astype(np.int32)


def doc_bucket_column(key: F.Column, buckets: int) -> F.Column:
    return F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 17)).bitwiseXOR(F.shiftrightunsigned(key, 31)), F.lit(buckets).cast("long")).cast("int")


def _dealt(kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows of the arrays split by bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(_runs(bucket))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=True):
        yield kind, int(bucket[a]), pack(*(x[order[a:b]] for x in arrays))


def _batches(rows: Iterator[tuple[int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n]) if have < width else x[:n]


def anchors(codes: np.ndarray, offsets: np.ndarray, task: Task, sums: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Anchors of all windows of a block: text, place, first and last window, hash, surrounding's hash."""
    length, gram, n = task.length, task.gram, len(codes)
    none = np.empty(0, np.int64)
    if n < length:
        return dict.fromkeys(("text", "at", "lo", "hi"), none) | dict.fromkeys(("h", "around", "again"), none.view(np.uint64))
    sums = W.prefix_sums(codes) if sums is None else sums
    place = np.arange(n - gram + 1)
    h = W.run_hashes(sums, place, place + gram)
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    least = (sliding_least(ranked, task.reach + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    start = np.flatnonzero(np.arange(n - length + 1) + length <= end[: n - length + 1])
    least = least[start]
    if not len(start):
        return anchors(codes[:0], offsets, task)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    at, lo = least[new], start[new]
    hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
    text = np.searchsorted(offsets, at, side="right") - 1
    left, right = np.maximum(offsets[text], at - task.reach), np.minimum(offsets[text + 1], at + length)
    around = W.mix(W.run_hashes(sums, left, right) + (at - left).astype(np.uint64) * _ODD)
    again = W.run_hashes(W.prefix_sums(W.mix(codes)), left, right)
    return {"text": text, "at": at, "lo": lo, "hi": hi, "h": h[at], "around": around, "again": again}


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys starts."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def collapse(first_keys: list[np.ndarray], key: np.ndarray, at: np.ndarray, every: bool, several: np.ndarray | None = None):
    """Group by first_keys; (order, starts of groups in it, marked, several) with all but `order` in that order.

    marked: occurrences that are known to be repeats; several: whether the group is known to have two places.
    """
    order = np.lexsort((at, key, *first_keys[::-1]))
    new = _runs(*(k[order] for k in first_keys))
    same = ~_runs(*(k[order] for k in first_keys), key[order], at[order])  # one place twice: a repeated row
    group = np.cumsum(new) - 1
    places = np.bincount(group, ~same, minlength=int(new.sum())) if len(order) else np.empty(0)
    many = places > 1
    if several is not None and len(order):
        many |= np.bincount(group, several[order], minlength=len(many)) > 0
    if every:
        marked = many[group] if len(order) else np.empty(0, bool)
    else:
        begin = np.flatnonzero(new)
        first = begin[group] if len(order) else np.empty(0, np.int64)
        marked = (key[order] != key[order][first]) | (at[order] != at[order][first])
    return order, new, marked, (many[group] if len(order) else np.empty(0, bool))


# h, surrounding (two lanes), key, at, at-lo, at-hi, flags
_ANCHOR = (np.uint32, np.uint64, np.uint64, np.int64, np.uint32, np.uint8, np.uint8, np.uint8)
_SEVERAL, _KNOWN = 1, 2


def _map(task: Task, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        keys = np.asarray(batch.column(0))
        for row, data, text_offsets in W.blocks(batch.column(1), BLOCK_BYTES):
            codes, offsets = task.symbols(data, text_offsets)
            x = anchors(codes, offsets, task)
            key, at = keys[row + x["text"]], x["at"] - offsets[x["text"]]
            order, new, marked, several = collapse([x["h"], x["around"], x["again"]], key, at, task.every)
            if marked.any():
                yield from _dealt(R, task.anchor_buckets + doc_bucket(key[order][marked], 64), key[order][marked], at[order][marked].astype(np.uint32))
            go = order[new]
            h = x["h"][go]
            flags = several[new].astype(np.uint8) * _SEVERAL
            surroundings = np.bincount(np.cumsum(_runs(h)) - 1) if len(h) else np.empty(0, np.int64)
            crowd = np.repeat(surroundings >= task.spread, surroundings)
            bucket = ((h >> np.uint64(32)) % np.uint64(task.anchor_buckets)).astype(np.int32)
            lead = _runs(h)  # one row of a crowd still tells its bucket that the anchor repeats
            bucket[crowd & ~lead] = (x["around"][go] % np.uint64(task.anchor_buckets)).astype(np.int32)[crowd & ~lead]
            flags[crowd] |= _KNOWN
            yield from _dealt(
                0, bucket, h.astype(np.uint32), x["around"][go], x["again"][go], key[go], at[go].astype(np.uint32), (x["at"] - x["lo"])[go].astype(np.uint8), (x["at"] - x["hi"])[go].astype(np.uint8), flags
            )


def _meet(task: Task, table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    kinds, packed = table["kind"].to_pylist(), table["packed"].to_pylist()
    ready = [p for k, p in zip(kinds, packed, strict=True) if k == R]
    if ready:
        key, at = gathered(ready, np.int64, np.uint32)
        yield from _dealt(R, doc_bucket(key, task.doc_buckets), key, at)
    rows = [p for k, p in zip(kinds, packed, strict=True) if k == 0]
    if not rows:
        return
    h, around, again, key, at, dlo, dhi, flags = gathered(rows, *_ANCHOR)
    # Anchors with one row end here, before the full sort.
    rank = np.argsort(h, kind="stable")
    lone = _runs(h[rank])
    lone &= np.append(lone[1:], True)
    stay = np.ones(len(h), bool)
    stay[rank[lone]] = (flags[rank[lone]] & _KNOWN) > 0
    h, around, again, key, at, dlo, dhi, flags = (a[stay] for a in (h, around, again, key, at, dlo, dhi, flags))
    order, new, marked, _ = collapse([h, around, again], key, at, task.every, flags & _SEVERAL)
    if marked.any():
        yield from _dealt(R, doc_bucket(key[order][marked], task.doc_buckets), key[order][marked], at[order][marked])
    h_new = _runs(h[order])
    h_group = np.cumsum(h_new) - 1
    n = np.bincount(h_group, new) if len(order) else np.empty(0)
    known = (np.bincount(h_group, flags[order] & _KNOWN) > 0) if len(order) else np.empty(0, bool)
    fine = new & ((n > 1) | known)[h_group] if len(order) else np.empty(0, bool)
    if fine.any():
        hot = ((n >= task.hot) | known)[h_group][fine].astype(np.uint8)
        go = order[fine]
        yield from _dealt(FINE, doc_bucket(key[go], task.doc_buckets), key[go], at[go], dlo[go], dhi[go], hot)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key (all are there)."""
    order = np.argsort(keys, kind="stable")
    return order[np.searchsorted(keys[order], wanted)]


def _text_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["text"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _fetch(task: Task, docs: pa.Table, marks: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """Symbols (or, for hot anchors, fingerprints) of the windows that F anchors stand for.

    Texts are fingerprinted part by part; what is fetched is dealt once for the whole bucket.
    """
    rows = marks["packed"].to_pylist()
    if not rows or not docs.num_rows:
        return
    key, at, dlo, dhi, hot = gathered(rows, np.int64, np.uint32, np.uint8, np.uint8, np.uint8)
    keys = np.asarray(docs["key"].combine_chunks())
    has = np.flatnonzero(np.isin(keys, key))
    cold: list[tuple] = []
    warm: list[tuple] = []
    for part in np.array_split(has, max(1, docs.nbytes // (2 * BLOCK_BYTES))):
        if not len(part):
            continue
        data, text_offsets = _text_block(docs.take(pa.array(part)))
        codes, offsets = task.symbols(data, text_offsets)
        sums = W.prefix_sums(codes)
        mine = np.isin(key, keys[part])
        k, a, lo, hi, is_hot = (x[mine] for x in (key, at.astype(np.int64), dlo.astype(np.int64), dhi.astype(np.int64), hot > 0))
        base = offsets[_lookup(keys[part], k)]
        start, count = a - lo, lo - hi + 1
        some = np.flatnonzero(~is_hot)
        if len(some):
            h = W.run_hashes(sums, base[some] + a[some], base[some] + a[some] + task.gram)
            flat = _ranges(base[some] + start[some], count[some] + task.length - 1)
            cold.append((((h >> np.uint64(32)) % np.uint64(task.anchor_buckets)).astype(np.int32), k[some], start[some], count[some], (codes if task.coded else data)[flat]))
        some = np.flatnonzero(is_hot)
        if len(some):
            one, owner, shift = _ranges(start[some], count[some]), np.repeat(k[some], count[some]), np.repeat(base[some], count[some])
            second = W.prefix_sums(W.mix(codes))
            warm.append((W.run_hashes(sums, shift + one, shift + one + task.length), W.run_hashes(second, shift + one, shift + one + task.length), owner, one))
    if cold:
        bucket, k, start, count, symbols = (np.concatenate(x) for x in zip(*cold, strict=True))
        size = count + task.length - 1
        begin = np.cumsum(size) - size
        for _, b, raw in _dealt(0, bucket, np.arange(len(bucket))):
            [some] = unpack(raw, np.int64)
            yield FINE, b, pack(k[some], start[some].astype(np.uint32), count[some].astype(np.uint16), symbols[_ranges(begin[some], size[some])])
    if warm:
        print_, again, owner, one = (np.concatenate(x) for x in zip(*warm, strict=True))
        order, new, marked, several = collapse([print_, again], owner, one, task.every)
        if marked.any():
            yield from _dealt(LOCAL, task.anchor_buckets + doc_bucket(owner[order][marked], 64), owner[order][marked], one[order][marked].astype(np.uint32))
        go = order[new]
        yield from _dealt(WINDOWS, (print_[go] % np.uint64(task.anchor_buckets)).astype(np.int32), print_[go], again[go], owner[go], one[go].astype(np.uint32), several[new].astype(np.uint8))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges [begin, begin + size), one range after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def as_spans(key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows merged to spans: key, start, end."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order].astype(np.int64)
    new = _runs(key)
    new[1:] |= start[1:] > start[:-1] + length
    last = np.append(np.flatnonzero(new)[1:], len(key)) - 1 if len(key) else np.empty(0, np.int64)
    return key[new], start[new].astype(np.uint32), (start[last] + length).astype(np.uint32)


Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], np.ndarray]
#: (symbols, window starts in them, key, place in the text, every) -> which windows are marked


def _resolve(task: Task, kind: np.dtype, find: Resolver, table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    kinds, packed = table["kind"].to_pylist(), table["packed"].to_pylist()
    by = {k: [p for j, p in zip(kinds, packed, strict=True) if j == k] for k in (FINE, WINDOWS, LOCAL)}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if by[LOCAL]:
        found.append(tuple(gathered(by[LOCAL], np.int64, np.uint32)))
    if by[WINDOWS]:
        h, again, key, start, several = gathered(by[WINDOWS], np.uint64, np.uint64, np.int64, np.uint32, np.uint8)
        order, _, marked, _ = collapse([h, again], key, start, task.every, several)
        found.append((key[order][marked], start[order][marked]))
    if by[FINE]:
        key, start, count, symbols = gathered(by[FINE], np.int64, np.uint32, np.uint16, kind)
        count = count.astype(np.int64)
        size = count + task.length - 1
        shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        where = np.repeat(np.cumsum(size) - size, count) + shift
        owner, place = np.repeat(key, count), np.repeat(start.astype(np.int64), count) + shift
        marked = find(symbols, where, owner, place, task.every)
        found.append((owner[marked], place[marked]))
    for key, start in found:
        spans = as_spans(key, start, task.length)
        yield from _dealt(WINDOWS, doc_bucket(spans[0], task.doc_buckets), *spans)


def _finish(task: Task, docs: pa.Table, marks: pa.Table, digest) -> pa.Table:
    """Rows of one document bucket from `digest(ids, data, text offsets, symbol offsets, removed symbols)`."""
    kinds, packed = marks["kind"].to_pylist(), marks["packed"].to_pylist()
    key_r, at = gathered([p for k, p in zip(kinds, packed, strict=True) if k == R], np.int64, np.uint32)
    key_w, start, end = gathered([p for k, p in zip(kinds, packed, strict=True) if k == WINDOWS], np.int64, np.uint32, np.uint32)
    keys, out = np.asarray(docs["key"].combine_chunks()), []
    every_part = np.array_split(np.arange(docs.num_rows), max(1, docs.nbytes // BLOCK_BYTES))
    for part in every_part:
        if not len(part):
            continue
        some = docs.take(pa.array(part))
        data, text_offsets = _text_block(some)
        offsets = task.places(data, text_offsets)
        edge = np.zeros(int(offsets[-1]) + 1, np.int32)
        for key, a, b in ((key_r, at.astype(np.int64) - task.reach, at.astype(np.int64) + task.length), (key_w, start.astype(np.int64), end.astype(np.int64))):
            mine = np.isin(key, keys[part])
            row = _lookup(keys[part], key[mine])
            np.add.at(edge, np.maximum(a[mine], 0) + offsets[row], 1)
            np.add.at(edge, np.minimum(b[mine] + offsets[row], offsets[row + 1]), -1)
        out.append(digest(some["doc_id"].combine_chunks(), data, text_offsets, offsets, np.cumsum(edge, dtype=np.int32)[:-1] > 0))
    return pa.concat_tables(out)


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) of (doc_id, text): the key orders rows by id and names one row only.

    Ids serve as keys where they are distinct and not null; otherwise rows are sorted by id and text and
    numbered in that order, so equal ids are ordered by their texts.
    """
    ids = docs.select("doc_id")
    odd = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    return stored(docs.orderBy("doc_id", "text").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "repeat-rows")


def remove_repeats(docs: DataFrame, make_task: Callable[[int, int], Task], kind, find: Resolver, digest, schema: str) -> DataFrame:
    """One row a document, as `digest` makes it, of (doc_id, text)."""
    rows = keyed(docs)
    spark = rows.sparkSession
    size = min(plan_bytes(rows), 1 << 46)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By size; on small inputs so many that all tasks have work, but none so small that packing gains nothing.
    least = min(2 * parts, size // LEAST_BUCKET_BYTES)
    task = make_task(_prime(max(least, size // (4 << 20)) + 2), _prime(max(least, 2 * size // DOC_BUCKET_BYTES) + 2))
    dealt = rows.select("key", "doc_id", "text", doc_bucket_column(F.col("key"), task.doc_buckets).alias("bucket"))
    mapped = rows.select("key", "text").mapInArrow(lambda batches: _batches(_map(task, batches)), PACKED)

    def meet(table: pa.Table) -> pa.Table:
        return _table(_meet(task, table))

    # Read by both branches below: Spark reuses the exchange of what was mapped, the costly part.
    marks = mapped.groupBy("bucket").applyInArrow(meet, PACKED)
    fine = marks.where(F.col("kind") == FINE)
    by_doc = dealt.groupBy("bucket")
    fetched = by_doc.cogroup(fine.groupBy("bucket")).applyInArrow(lambda a, b: _table(_fetch(task, a, b)), PACKED)
    spans = fetched.groupBy("bucket").applyInArrow(lambda t: _table(_resolve(task, kind, find, t)), PACKED)
    final = marks.where(F.col("kind") == R).unionByName(spans)
    names = [c.split()[0] for c in schema.split(", ")]

    def finish(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, _types(schema), strict=True)})
        return _finish(task, a, b, digest).select(names)

    return by_doc.cogroup(final.groupBy("bucket")).applyInArrow(finish, schema)


def _types(schema: str) -> list[pa.DataType]:
    return [{"bigint": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]


def _table(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    batches = list(_batches(rows))
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
    return pa.Table.from_batches(batches, schema)
