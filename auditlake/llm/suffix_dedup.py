"""Suffix-array dedup: remove bytes covered by a 100-byte string that also starts earlier.

Suffixes that can repeat (see `repeats`) are ordered only through the threshold's bytes, by most-significant-
digit passes: a pass orders each group of suffixes by their next DIGIT bytes, splits it where these differ and
drops the suffixes that are alone.  What is left in one group after the last pass are exactly the repeated windows; the
first of a group in the order of (document, start) stays.

Defined results: null text is empty; very long texts are read whole; texts shorter than the threshold lose nothing; rows with equal or null
ids are ordered by id and then text (nulls first); identical rows are copies of each other; an empty table
gives an empty result; columns other than id and text are ignored.  Remaining bytes need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import repeats as X
from auditlake.llm import wordcodes as W
from auditlake.llm.common import read_table, texts

THRESHOLD = 100
GRAM = 24
#: Bytes of one radix digit.
DIGIT = 8


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return W.BYTE_CODE[data], offsets


def byte_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return offsets


def radix_groups(symbols: np.ndarray, where: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first `length` bytes with another, in lexicographic order: their numbers, and groups.

    A pass orders each group by the next DIGIT bytes as they are, most significant first, splits it where they
    differ, and drops the suffixes that are alone.
    """
    padded = np.concatenate([symbols, np.zeros(DIGIT, np.uint8)])
    digits = np.zeros(len(symbols), np.uint64)
    for k in range(DIGIT):
        digits = (digits << np.uint64(8)) | padded[k : k + len(symbols)]
    alive, group = np.arange(len(where)), np.zeros(len(where), np.int64)
    for depth in range(0, length, DIGIT):
        digit = digits[where[alive] + depth]
        if depth + DIGIT > length:
            digit = digit >> np.uint64(8 * (depth + DIGIT - length))
        order = np.lexsort((digit, group))
        group, alive, digit = group[order], alive[order], digit[order]
        new = X._runs(group, digit)
        shared = ~(new & np.append(new[1:], True)) if len(new) else new
        group, alive = np.cumsum(new)[shared], alive[shared]
    return alive, group


def find(symbols: np.ndarray, where: np.ndarray, key: np.ndarray, place: np.ndarray, every: bool) -> np.ndarray:
    alive, group = radix_groups(symbols, where, THRESHOLD)
    order, _, marked, _ = X.collapse([group], key[alive], place[alive], every)
    return alive[order][marked]


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digest(ids: pa.Array, data: np.ndarray, text_offsets: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
    total = np.concatenate([[0], np.cumsum(removed)])
    gone = total[text_offsets[1:]] - total[text_offsets[:-1]]
    starts = removed & ~np.concatenate([[False], removed[:-1]]) if len(removed) else removed
    border = text_offsets[:-1][np.diff(text_offsets) > 0]
    starts[border] = removed[border]
    spans = np.concatenate([[0], np.cumsum(starts)])
    kept = [hashlib.sha256(data[a:b] if not n else data[a:b][~removed[a:b]]).hexdigest() for a, b, n in zip(text_offsets[:-1].tolist(), text_offsets[1:].tolist(), gone.tolist(), strict=True)]
    return pa.table({"doc_id": ids, "n_bytes": np.diff(text_offsets), "n_removed": gone, "n_spans": spans[text_offsets[1:]] - spans[text_offsets[:-1]], "kept_sha256": kept})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = X.HOT, spread: int = X.SPREAD) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return X.remove_repeats(texts(docs, id_col, text_col), lambda a, d: X.Task(byte_symbols, byte_places, THRESHOLD, GRAM, False, a, d, hot, spread), np.uint8, find, _digest, RESULT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))
