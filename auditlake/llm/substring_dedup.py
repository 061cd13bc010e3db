"""Substring dedup: remove words covered by a 35-word window that also starts anywhere else.

Suffixes that can repeat (see `repeats`) are split by prefixes of variable length: a group of suffixes that
share a prefix is cut by its next word for as long as it holds more than GROUP suffixes, so every group fits
in memory however common its first words are, and a prefix as long as a window needs no tree at all.  In each
group the depth-limited suffix tree is held as sorted suffixes with the depths of the nodes between
neighbours (their common prefix lengths); internal nodes of depth 35 or more are the repeats.

Words are runs of bytes other than 0x20 and 0x09-0x0D, compared by 64-bit fingerprints.  Defined results: null
text has no words; very long texts are read whole; rows that repeat an id are told apart by text (identical rows are copies of each other, so
their long passages go from all of them); an empty table gives an empty result; columns other than id and
text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import repeats as X
from auditlake.llm import wordcodes as W
from auditlake.llm.common import read_table, texts

WINDOW = 50  # words, unless a contract says otherwise
GRAM = 9
#: Suffixes in one tree at most.
GROUP = 1 << 15


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return W.word_hashes(data, offsets)


def word_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return W.split_words(data, offsets)[2]


def prefix_groups(symbols: np.ndarray, where: np.ndarray, length: int, group: int):
    """(suffix numbers, shared prefix length) of groups that share a prefix; suffixes that stand alone are left out."""
    waiting = [(np.arange(len(where)), 0)]
    while waiting:
        some, depth = waiting.pop()
        if len(some) < 2:
            continue
        if len(some) <= group or depth >= length:
            yield some, depth
            continue
        word = symbols[where[some] + depth]
        order = np.argsort(word, kind="stable")
        some, word = some[order], word[order]
        cut = np.flatnonzero(X._runs(word))
        if len(cut) == 1:  # all share this word: look for the first one that they do not share
            while depth + 1 < length and (symbols[where[some] + depth + 1] == symbols[where[some[0]] + depth + 1]).all():
                depth += 1
            waiting.append((some, depth + 1))
            continue
        small: list[np.ndarray] = []
        held = 0
        for part in np.split(some, cut[1:]):
            if len(part) > group:
                waiting.append((part, depth + 1))
            elif len(part) > 1:  # neighbouring small groups share one tree, under the shorter prefix
                if held + len(part) > group:
                    yield np.concatenate(small), depth
                    small, held = [], 0
                small.append(part)
                held += len(part)
        if small:
            yield np.concatenate(small), depth


def node_depths(symbols: np.ndarray, where: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes that share `depth` words, and the depth (at most `length`) of the node between neighbours."""
    rest = length - depth
    if rest <= 0:
        return np.arange(len(where)), np.full(max(0, len(where) - 1), length)
    grid = symbols[where[:, None] + np.arange(depth, length)]
    order = np.argsort(np.ascontiguousarray(grid.astype(">u8")).view(f"V{8 * rest}").ravel(), kind="stable")
    differs = grid[order[1:]] != grid[order[:-1]]
    return order, np.where(differs.any(1), depth + differs.argmax(1), length)


def finder(length: int, group: int = GROUP):
    def find(symbols: np.ndarray, where: np.ndarray, key: np.ndarray, place: np.ndarray, every: bool) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for some, depth in prefix_groups(symbols, where, length, group):
            order, depths = node_depths(symbols, where[some], depth, length)
            some = some[order]
            deep = np.flatnonzero(np.concatenate([[False], depths >= length]) | np.concatenate([depths >= length, [False]]))
            node = np.cumsum(np.concatenate([[True], depths < length]))[deep].astype(np.int64)
            leaves = some[deep]
            order, _, marked, _ = X.collapse([node], key[leaves], place[leaves], every)
            out.append(leaves[order][marked])
        return np.concatenate(out)

    return find


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _digest(ids: pa.Array, data: np.ndarray, text_offsets: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
    total = np.concatenate([[0], np.cumsum(removed)])
    gone = total[offsets[1:]] - total[offsets[:-1]]
    raw, kept = data.tobytes(), []
    for a, b, first, end, n in zip(text_offsets[:-1].tolist(), text_offsets[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), gone.tolist(), strict=True):
        words = raw[a:b].split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
        if n:
            words = [words[i] for i in np.flatnonzero(~removed[first:end])]
        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": ids, "n_words": np.diff(offsets), "n_removed": gone, "kept_sha256": kept})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = X.HOT, spread: int = X.SPREAD) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    gram = min(GRAM, max(1, window // 2))
    return X.remove_repeats(texts(docs, id_col, text_col), lambda a, d: X.Task(word_symbols, word_places, window, gram, True, a, d, hot, spread, coded=True), np.uint64, finder(window), _digest, RESULT)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), window=35)
