"""Retrieval statistics, ranks and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.operators.ordering import rank_within
from pairmatch.operators.pairs import POSITIVE


def candidate_counts(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_candidates, hits) for all queries, from labelled candidate pairs."""
    per_query = pairs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("label") == POSITIVE).alias("hits"),
    )
    return _for_all(queries, per_query)


def _for_all(queries: DataFrame, per_query: DataFrame) -> DataFrame:
    """A row for every query, zeros where it had no candidate."""
    return queries.select("query_id").join(per_query, "query_id", "left").na.fill(
        0, ["n_candidates", "hits"]
    )


def retrieval_stats(
    counts: DataFrame, mode: str | None = "pc", n_candidates: int | None = None
) -> DataFrame:
    """One row: queries with candidates (%), mean candidates of those, originals found (%).

    ``pc`` counts queries that found their original among all queries; ``cp`` counts found
    children among all ``n_candidates``; None leaves the last figure out.
    """
    some = F.col("n_candidates") > 0
    figures = [
        (100.0 * F.count_if(some) / F.count(F.lit(1))).alias("pct_with_candidates"),
        F.avg(F.when(some, F.col("n_candidates"))).alias("mean_candidates"),
    ]
    if mode == "pc":
        found = 100.0 * F.count_if(F.col("hits") > 0) / F.count(F.lit(1))
    elif mode == "cp":
        if n_candidates is None:
            raise ValueError("cp needs the number of candidates")
        found = 100.0 * F.sum("hits") / F.lit(n_candidates)
    elif mode is not None:
        raise ValueError(f"unknown mode {mode!r}")
    if mode is not None:
        figures.append(found.alias("pct_found"))
    return counts.agg(*figures)


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc("cand_id")]


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Adds ``rank``: best score first, ties by candidate id; hot queries are spread out."""
    return rank_within(scored, ["query_id"], _best_first(), "rank")


def topk(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` of each query; every task drops the rest before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(*_best_first())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_ranks(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Per query: first relevant rank, mean reciprocal rank of all relevant, hits in top k."""
    relevant = F.col("label") == POSITIVE
    return ranked.groupBy("query_id").agg(
        F.min(F.when(relevant, F.col("rank"))).alias("first_rank"),
        F.avg(F.when(relevant, 1.0 / F.col("rank"))).alias("mean_reciprocal"),
        F.count_if(relevant & (F.col("rank") <= k)).alias("top_hits"),
    )


def ranking_metrics(ranked: DataFrame, mode: str = "cp", k: int = 3, top: int = 4) -> DataFrame:
    """One row: queries, mrr, mrr_all, precision_at_k and share of first ranks 1..top.

    Queries are those with at least one candidate.  In ``pc`` mode only queries without a
    relevant candidate enter mrr_all and precision, each with a zero; a mean over none is
    null.
    """
    return summarize_ranks(query_ranks(ranked, k), mode, k, top)


def summarize_ranks(per_query: DataFrame, mode: str = "cp", k: int = 3, top: int = 4) -> DataFrame:
    """``ranking_metrics`` from (first_rank, mean_reciprocal, top_hits) of each query."""
    if mode not in ("pc", "cp"):
        raise ValueError(f"unknown mode {mode!r}")
    first = F.col("first_rank")
    reciprocal = F.when(first.isNull(), 0.0).otherwise(1.0 / first)
    every = F.when(first.isNull(), 0.0)
    precision = F.when(first.isNull(), 0.0)
    if mode == "cp":
        every = every.otherwise(F.col("mean_reciprocal"))
        precision = precision.otherwise(F.col("top_hits") / k)
    shares = [
        (100.0 * F.try_divide(F.count_if(first == r), F.count(first))).alias(f"pct_rank_{r}")
        for r in range(1, top + 1)
    ]
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(reciprocal).alias("mrr"),
        F.avg(every).alias("mrr_all"),
        F.avg(precision).alias(f"precision_at_{k}"),
        *shares,
    )


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share (%) of the queries in ``truth`` whose original was found."""
    hits = found.join(
        truth.select("query_id", F.col("truth_id").alias("cand_id")), ["query_id", "cand_id"]
    ).select("query_id").distinct().withColumn("hit", F.lit(1))
    return truth.join(hits, "query_id", "left").agg(
        (100.0 * F.count("hit") / F.count(F.lit(1))).alias("pct_found")
    )
