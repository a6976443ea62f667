"""Exact top-k inner products, by length buckets.

Vectors are sorted by length and cut into buckets of similar length.  For a query q with a known
lower bound t of its k-th score, a bucket whose longest vector has length l can only hold a result
if l * |q| >= t; inside the bucket a result's cosine with q is at least t / (l * |q|), the local
threshold.  A high threshold leaves few values for single coordinates, so such a bucket is pruned by
coordinates; a low one only by length.  What is left is verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COORDINATE_FROM = 0.55
FOCUS = 6
BUCKET_SPREAD = 0.9


class Block:
    """Candidates of one task in buckets of similar length, longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.ids, self.whole, self.lengths = ids[order], x[order], lengths[order]
        self.x = self.whole.astype(np.float64)
        self.buckets = []
        at = 0
        while at < len(ids):
            floor = self.lengths[at] * BUCKET_SPREAD
            end = int(np.searchsorted(-self.lengths, -floor, "right")) if floor else len(ids)
            end = max(end, at + 1)
            self.buckets.append((at, end))
            at = end
        safe = np.where(self.lengths > 0, self.lengths, 1.0)
        self.unit = self.x / safe[:, None]

    def search(self, query: np.ndarray, own: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores with a score of at least ``bound``, without the query's own id."""
        whole, query = query, query.astype(np.float64)
        exact = _exact(self.x, query)
        size = float(np.sqrt((query**2).sum()))
        found_ids, found = np.empty(0, np.int64), np.empty(0, np.int64)
        focus = np.argsort(-np.abs(query))[:FOCUS]
        unit = query / size if size else query
        for at, end in self.buckets:
            longest = self.lengths[at]
            # rounding may not drop a vector that reaches the bound
            if longest * size < bound - 0.5:
                break
            rows = np.arange(at, end)
            if bound > 0 and size:
                local = min(1.0, (bound - 0.5) / (longest * size)) - 1e-9
                if local >= COORDINATE_FROM:
                    rows = self._by_coordinates(at, end, unit, focus, local)
                else:
                    rows = rows[: int(np.searchsorted(-self.lengths[at:end], -((bound - 0.5) / size), "right"))]
            if not len(rows):
                continue
            chosen = slice(at, end) if len(rows) == end - at else rows
            scores = (self.x[chosen] @ query).astype(np.int64) if exact else self.whole[chosen] @ whole
            ids = self.ids[rows]
            keep = (scores >= bound) & (ids != own)
            found_ids = np.concatenate([found_ids, ids[keep]])
            found = np.concatenate([found, scores[keep]])
            if len(found) > k:
                best = np.lexsort((found_ids, -found))[:k]
                found_ids, found = found_ids[best], found[best]
            if len(found) == k:
                bound = max(bound, float(found.min()))
        return found_ids, found

    def _by_coordinates(self, at: int, end: int, unit: np.ndarray, focus: np.ndarray, local: float) -> np.ndarray:
        """Rows whose cosine with the query can reach ``local``, by the query's largest coordinates.

        With c the product over the coordinates seen so far, the rest of the product is at most the
        product of what is left of both lengths.
        """
        rows = np.arange(at, end)
        seen, left_row, left_query = np.zeros(end - at), np.ones(end - at), 1.0
        for f in focus:
            value = self.unit[rows, f]
            seen = seen + value * unit[f]
            left_row = np.maximum(0.0, left_row - value * value)
            left_query = max(0.0, left_query - unit[f] * unit[f])
            able = seen + np.sqrt(left_row * left_query) + 1e-9 >= local
            rows, seen, left_row = rows[able], seen[able], left_row[able]
            if not len(rows):
                break
        return rows


def _exact(x: np.ndarray, query: np.ndarray) -> bool:
    """Whether products and sums stay whole in double arithmetic."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, x.shape[-1]) < 2.0**52


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _answers(k: int, width: int):
    """Task function: rows sorted by block, in each block first the candidates, then the queries.

    Only one block's candidates are held; queries stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            asks = np.asarray(batch.column("asks"))
            ids, bounds = np.asarray(batch.column("id")), np.asarray(batch.column("bound"))
            x = _matrix(batch.column("v"), width)
            edges = np.flatnonzero(np.diff(blocks.astype(np.int64) * 2 + asks)) + 1
            out: list[list[np.ndarray]] = [[], [], []]
            for at in np.split(np.arange(batch.num_rows), edges):
                if not len(at):
                    continue
                if blocks[at[0]] != now:
                    now, held, block = blocks[at[0]], [], None
                if not asks[at[0]]:
                    held.append((ids[at], x[at]))
                    continue
                if block is None:
                    block = Block(
                        np.concatenate([i for i, _ in held]) if held else np.empty(0, np.int64),
                        np.concatenate([v for _, v in held]) if held else np.empty((0, width), np.int64),
                    )
                for i in at:
                    found, scores = block.search(x[i], int(ids[i]), k, float(bounds[i]))
                    for column, values in zip(out, (np.full(len(found), ids[i]), found, scores), strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out],
                ["query_id", "vec_id", "score"],
            )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "ivec",
    block_rows: int = 65_536,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with all other rows.

    ``vector`` holds whole numbers (array<bigint>); ``is_query`` is a condition on the rows.  Ties go
    to the smaller id, and no row with the query's own id is a candidate.  Rows without id, and those
    whose vector is null, empty, holds null or differs in width from most of the table, take no part.
    Ids should be unique: rows that repeat one all count as candidates, and a query is asked once,
    for the smallest of its vectors.  Other columns are ignored.

    Candidates are dealt by hash into blocks of at most about ``block_rows``, so equal vectors don't
    meet in one task, and every query goes to every block: that is the work asked for, in pieces of
    bounded size.  A first pass asks each query in a single block for its k-th score, which bounds
    the search in all blocks.  A block gives at most k rows per query.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)"
    )
    spark = vectors.sparkSession
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, total = widths
    rows = rows.where(F.size("v") == width)
    n = max(-(-total // block_rows), min(total, spark.sparkContext.defaultParallelism))
    candidates = rows.select(
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n)).cast("int").alias("block"),
        F.lit(0).alias("asks"), F.lit(0.0).alias("bound"), "id", "v",
    )
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    lowest = F.lit(-1e300)

    def search(asked: DataFrame) -> DataFrame:
        return (
            candidates.unionByName(asked.select("block", F.lit(1).alias("asks"), "bound", "id", "v"))
            .repartition(n, "block")
            .sortWithinPartitions("block", "asks", "id")
            .mapInArrow(_answers(k, width), "query_id bigint, vec_id bigint, score bigint")
        )

    first = search(
        queries.select("id", "v", lowest.alias("bound"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n)).cast("int").alias("block"))
    )
    bounds = (
        first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    )
    asked = (
        queries.join(bounds, F.col("id") == F.col("query_id"), "left")
        .select("id", "v", F.coalesce(F.col("least").cast("double"), lowest).alias("bound"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        search(asked)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
