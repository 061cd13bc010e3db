"""SentencePiece encoding and decoding through a table of distinct chunks.

The model joins no piece across the start of a whitespace marker (checked when the model is loaded), so a
text is the sequence of its marked words: a run of markers with what follows up to the next one.  Each task
segments every distinct marked word once with the library, keeps the ids in one flat array, and joins them
back by position with numpy gathers.  Nothing is shuffled and no table grows with the corpus: a task keeps up
to TABLE_CHUNKS chunks of at most LONG_WORD characters, and segments the others once for each block of text.

Defined results: null text is the empty text, which has no ids; repeated rows are encoded each; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import read_table, texts

MARK = "▁"
TABLE_CHUNKS = 120_000
LONG_WORD = 64
#: Characters of text joined back at once.
BLOCK_CHARS = 1 << 20


@lru_cache(maxsize=4)
def load_model(model: str):
    """The processor; refuses a model whose pieces could cross the start of a marker, or that rewrites text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces) or sp.normalize(" ﬁ  a ") != f"{MARK * 2}ﬁ{MARK * 2}a{MARK}":
        raise ValueError("this model's pieces cross whitespace markers, or it normalises text: encode whole texts instead")
    return sp


class ChunkTable:
    """Ids of distinct chunks: chunk number -> flat[offsets[n]:offsets[n + 1]]."""

    def __init__(self, sp):
        self.sp = sp
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 14, np.int64)

    def add(self, chunks: list[str]) -> None:
        """Segment new chunks.  A chunk is named without its first marker, which the library puts in front."""
        ids = self.sp.encode(chunks, num_threads=1)
        lone = [self.sp.piece_to_id(MARK)]
        ids = [x if c else lone for c, x in zip(chunks, ids, strict=True)]
        n, end = len(self.number), int(self.offsets[len(self.number)])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        while n + len(ids) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        total = int(lengths.sum())
        while end + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[end : end + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.offsets[n + 1 : n + 1 + len(ids)] = end + np.cumsum(lengths)
        self.number.update(zip(chunks, range(n, n + len(ids)), strict=True))

    def forget(self, chunks: list[str]) -> None:
        """Drop the chunks that were added last."""
        for c in chunks:
            del self.number[c]

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of chunks, by position, and how many each chunk has."""
        begin = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - begin
        ends = np.cumsum(lengths)
        shift = np.repeat(begin - (ends - lengths), lengths)
        shift += np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[shift], lengths


def marked_words(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0  # an empty word is one more marker of the next chunk, or a lone marker at the end
    for i, word in enumerate(words):
        if word or i == len(words) - 1:
            out.append(" " * spaces + word)
            spaces = 0
        else:
            spaces += 1
    return out


@lru_cache(maxsize=2)
def _table(model: str) -> ChunkTable:
    return ChunkTable(load_model(model))


def _encode_block(table: ChunkTable, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, one after another, and the number of ids of each text."""
    words = [marked_words(t) for t in block]
    new = set().union(*words).difference(table.number)
    kept = [w for w in new if len(w) <= LONG_WORD][: max(0, TABLE_CHUNKS - len(table.number))]
    passing = list(new.difference(kept))
    for some in (kept, passing):
        if some:
            table.add(some)
    get = table.number.__getitem__
    counts = np.fromiter(map(len, words), np.int64, len(words))
    numbers = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(counts.sum()))
    ids, lengths = table.join(numbers)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    table.forget(passing)
    return ids, ends


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    ids, column, start, held, block = batch.column(0), batch.column(1), 0, 0, []
    for i, text in enumerate(column):
        text = text.as_py()
        block.append(text)
        held += len(text)
        if held >= BLOCK_CHARS:
            yield ids.slice(start, i + 1 - start), block
            start, held, block = i + 1, 0, []
    if block:
        yield ids.slice(start), block


def _encode(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _table(model)
    for batch in batches:
        for doc_ids, block in _blocks(batch):
            ids, ends = _encode_block(table, block)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])


def _rows_of(column: pa.ListArray) -> Iterator[list[int]]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield flat[a:b].tolist()


def _decode(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sp = load_model(model)
    for batch in batches:
        yield batch.append_column("text", pa.array([sp.decode(x) for x in _rows_of(batch.column(1))], pa.string()))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, of_ids, of_text = [], [], []
        for ids, text in zip(_rows_of(batch.column(1)), batch.column(2), strict=True):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(text.as_buffer()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], [c.split()[0] for c in DIGEST.split(", ")])


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every document, as the library's encode(text) gives them."""
    return texts(docs, id_col, text_col).mapInArrow(lambda batches: _encode(model, batches), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that the library's decode(ids) gives."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decode(model, batches), "doc_id bigint, ids array<int>, text string")


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode, decode and digest in one pass: the ids never leave the Python worker."""
    model = model or model_path()
    return texts(docs).mapInArrow(lambda batches: _digest(_decode(model, _encode(model, batches))), DIGEST)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"))
