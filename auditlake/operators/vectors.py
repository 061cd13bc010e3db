"""Vector retrieval and text chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors that a packed block holds at most (one vector at least).
BLOCK_BYTES = 1 << 18

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def top_k(table: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """The k best rows for one query vector after an equality filter on metadata; score is 1 - distance."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = cosine_similarity(F.col(vector), q) if metric == "cosine" else 1 - squared_l2(F.col(vector), q)
    rows = table if keep is None else table.where(keep)
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), id_col).limit(k)


def _packed(side: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of vectors of one length: their ids and their numbers as one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                step = max(1, BLOCK_BYTES // max(1, 8 * dim))
                for i in range(0, len(rows), step):
                    values = [[ids[rows[i : i + step]].tolist()], [flat[i : i + step].tobytes()], [dim]]
                    types = (pa.list_(pa.int64()), pa.binary(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [f"{side}_ids", f"{side}_data", f"{side}_dim"])

    return run


def _best_of_blocks(k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best rows of a block for every query of a block.

    A matrix product finds the rows that can be among them; their scores are then taken row by row, so that equal
    vectors have equal scores wherever they stand.
    """

    def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if metric != "cosine":
            return 1 - ((rows - query) ** 2).sum(1)
        return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # A view of one pair of blocks: a batch holds many, and what is found in each goes on at once.
                block = {name: column[at] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                dim = block["r_dim"].as_py()
                if dim != block["q_dim"].as_py():
                    continue
                ids, query_ids = (block[x].values.to_numpy() for x in ("r_ids", "q_ids"))
                rows, queries = (np.frombuffer(block[x].as_buffer()).reshape(len(n), dim) for x, n in (("r_data", ids), ("q_data", query_ids)))
                with np.errstate(all="ignore"):
                    rough = queries @ rows.T
                    size = (rows * rows).sum(1)
                    rough = rough / np.sqrt(size) if metric == "cosine" else 2 * rough - size
                    found = []
                    for i, query_id in enumerate(query_ids.tolist()):
                        others = np.flatnonzero((ids != query_id) & ~np.isnan(rough[i]))
                        if len(others) > k:
                            r = rough[i][others]
                            least = np.partition(r, len(r) - k)[len(r) - k]
                            others = others[r >= least - 1e-9 * max(1.0, abs(least), float(size.max()))]
                        score = scores(rows[others], queries[i])
                        for j in np.lexsort((ids[others], -score))[:k].tolist():
                            found.append((query_id, int(ids[others[j]]), float(score[j])))
                columns = list(zip(*found, strict=True)) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "row_id", "score"])

    return run


def top_k_batch(table: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank) for a stated query set against all rows.

    Both sides are packed into blocks of bounded size and blocks meet blocks, so a pair of vectors costs a share of
    a matrix product; Catalyst broadcasts the queries' blocks only if they are small.  Each pair of blocks keeps k
    rows a query before the shuffle.  Rows without a vector, or of another length than the query's, are no
    partners; nor, by cosine, are zero vectors.
    """

    def packed(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull())
        return rows.mapInArrow(_packed(side), f"{side}_ids array<bigint>, {side}_data binary, {side}_dim int")

    best = packed(table, "r").crossJoin(packed(queries, "q")).mapInArrow(_best_of_blocks(k, metric), "query_id bigint, row_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("row_id").alias(id_col), "score", "rank")


def context_text(hits: DataFrame, text: str = "text", n: int = 3, chars: int = 200) -> DataFrame:
    """One text from the n best hits, each cut to its first characters."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(text).alias("t")))), 1, n)
    return hits.agg(F.array_join(F.transform(best, lambda x: F.substring(x["t"], 1, chars)), "\n\n").alias("context"))
