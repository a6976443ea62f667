"""Queries on scored pairs: batches, ranks, metrics and distances."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from pairmatch.functions.vectors import weighted_score
from pairmatch.lineage import scratch_path
from pairmatch.operators import blocks as bl
from pairmatch.operators import distances as ds
from pairmatch.operators import metrics as mt
from pairmatch.operators import pairs as pr
from pairmatch.operators import scoring as sc
from pairmatch.registry.base import register
from pairmatch.sources import store

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

BATCH = 500

_PACKED_CTE = f"""
packed as (
  select *, n // {BATCH} as batch, n % {BATCH} as slot from (
    select *, row_number() over (order by query_id, cand_id) - 1 as n from pairs) p
)"""
_RANKED_CTE = """
ranked as (
  select *, row_number() over (partition by query_id order by score desc, cand_id) as rank from pairs
),
per_query as (
  select query_id, min(case when label = 1.0 then rank end) as first_rank,
    avg(case when label = 1.0 then 1.0::double / rank end) as mean_reciprocal,
    count(*) filter (where label = 1.0 and rank <= 3) as top_hits
  from ranked group by query_id
)"""


def _rounded(df, *columns, digits=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("pairs", "select query_id, cand_id, label from pairs where label <> 0.5")
def filter_binary_labels(t):
    return pr.filter_binary_labels(t["pairs"]).select("query_id", "cand_id", "label")


@query("pairs", "select query_id, cand_id, label from pairs where label = 1.0")
def filter_positive(t):
    return pr.filter_positive(t["pairs"]).select("query_id", "cand_id", "label")


@query("pairs", "select query_id, cand_id, label, n, batch, slot from packed", _PACKED_CTE)
def pack_batches(t):
    return pr.pack_batches(t["pairs"], BATCH).select("query_id", "cand_id", "label", "n", "batch", "slot")


@query(
    "pairs",
    f"""select query_id, min(n) // {BATCH} as start_batch, min(n) % {BATCH} as start_slot,
          (max(n) + 1) // {BATCH} as end_batch, (max(n) + 1) % {BATCH} as end_slot,
          count(*) filter (where label = 1.0) as n_relevant
        from packed group by query_id""",
    _PACKED_CTE,
)
def batch_index(t):
    return pr.batch_index(pr.pack_batches(t["pairs"], BATCH), BATCH)


@query(
    "pairs",
    """select query_id, position from (
         select query_id, label, n - min(n) over (partition by query_id) as position from packed) p
       where label = 1.0""",
    _PACKED_CTE,
)
def batch_relevant(t):
    return pr.relevant_positions(pr.pack_batches(t["pairs"], BATCH))


@query(
    "pairs",
    """select query_id, cand_id, batch, slot, round(1.0::double / (1 + batch + slot), 9) as score
       from packed""",
    _PACKED_CTE,
)
def score_index_join(t):
    packed = pr.pack_batches(t["pairs"], BATCH).select("query_id", "cand_id", "batch", "slot")
    scores = packed.select(
        "batch", "slot", F.round(F.lit(1.0) / (1 + F.col("batch") + F.col("slot")), 9).alias("score")
    )
    return pr.attach_scores(packed, scores)


_SHUFFLE_SEED, _BATCHES_PER_FOLDER = 7, 8


def _stored_batches(t):
    path = scratch_path(t.spark, "batches")
    store.write_pair_batches(pr.pack_batches(t["pairs"], BATCH), path, _BATCHES_PER_FOLDER)
    return path


@query(
    "pairs",
    "select query_id, cand_id, label, batch, slot, round(score::float::double, 5) as score from packed where label <> 0.5",
    _PACKED_CTE,
)
def read_pair_batches(t):
    stored = store.read_pair_batches(t.spark, _stored_batches(t), binary_only=True)
    return stored.select(
        "query_id", "cand_id", "label", "batch", "slot", F.round(F.col("score").cast("double"), 5).alias("score")
    )


@query(
    "pairs",
    f"""select batch, row_number() over (order by md5(concat('{_SHUFFLE_SEED}-', batch::bigint)), batch) - 1 as place
        from (select distinct batch from packed) b""",
    _PACKED_CTE,
)
def shuffle_batches(t):
    return store.batch_order(t.spark, _stored_batches(t), _SHUFFLE_SEED)


@query("pairs", "select query_id, cand_id, label, score, rank from ranked", _RANKED_CTE)
def rank_candidates(t):
    return mt.rank_candidates(t["pairs"])


@query("pairs", "select query_id, cand_id, label, score, rank from ranked where rank <= 10", _RANKED_CTE)
def topk_per_query(t):
    return mt.topk(t["pairs"], 10)


def _metrics(t, mode):
    return mt.ranking_metrics(mt.rank_candidates(t["pairs"]), mode)


@query(
    "pairs",
    """select count(*) as n_queries, round(avg(coalesce(1.0::double / first_rank, 0)), 9) as mrr
       from per_query""",
    _RANKED_CTE,
)
def mrr(t):
    return _rounded(_metrics(t, "cp").select("n_queries", "mrr"), "mrr", digits=9)


@query(
    "pairs",
    "select round(avg(coalesce(mean_reciprocal, 0)), 9) as mrr_all from per_query",
    _RANKED_CTE,
)
def mrr_all(t):
    return _rounded(_metrics(t, "cp").select("mrr_all"), "mrr_all", digits=9)


@query(
    "pairs",
    """select round(avg(case when first_rank is null then 0.0::double end), 9) as mrr_all,
         round(avg(case when first_rank is null then 0.0::double end), 9) as precision_at_3,
         round(avg(coalesce(1.0::double / first_rank, 0)), 9) as mrr
       from per_query""",
    _RANKED_CTE,
)
def ranking_metrics_pc(t):
    kept = _metrics(t, "pc").select("mrr", "mrr_all", "precision_at_3")
    return _rounded(kept, "mrr", "mrr_all", "precision_at_3", digits=9)


@query(
    "pairs",
    """select round(avg(case when first_rank is null then 0.0::double else top_hits / 3.0::double end), 9)
         as precision_at_3 from per_query""",
    _RANKED_CTE,
)
def precision_at_3(t):
    return _rounded(_metrics(t, "cp").select("precision_at_3"), "precision_at_3", digits=9)


_SHARES = ", ".join(
    f"round(100.0::double * count(*) filter (where first_rank = {r}) / count(first_rank), 9) as pct_rank_{r}"
    for r in range(1, 5)
)


@query("pairs", f"select {_SHARES} from per_query", _RANKED_CTE)
def rank_distribution(t):
    names = [f"pct_rank_{r}" for r in range(1, 5)]
    return _rounded(_metrics(t, "cp").select(*names), *names, digits=9)


_EVAL_CTE = _PACKED_CTE + """,
clipped as (select *, least(greatest(score, 1e-7::double), 1 - 1e-7::double) as c from packed)"""
_LOSS = "avg(-(label * ln(c) + (1 - label) * ln(1 - c)))"
_EVAL = f"""count(*) as n, round({_LOSS}, 9) as loss,
  round(avg(case when round_even(score, 0) = label then 1.0::double else 0.0::double end), 9) as accuracy,
  round(avg(abs(score - label)), 9) as mae,
  round(100.0::double * avg((score - label) * (score - label)), 7) as scaled_mse"""


@query("pairs", f"select batch, {_EVAL} from clipped group by batch", _EVAL_CTE)
def pair_eval_by_file(t):
    figures = sc.evaluate_pairs(pr.pack_batches(t["pairs"], BATCH), "batch", loss_scale=100.0)
    return _rounded(_rounded(figures, "loss", "accuracy", "mae", digits=9), "scaled_mse", digits=7)


@query("pairs", f"select {_EVAL} from clipped", _EVAL_CTE)
def scaled_mse(t):
    figures = sc.evaluate_pairs(t["pairs"], None, loss_scale=100.0)
    return _rounded(_rounded(figures, "loss", "accuracy", "mae", digits=9), "scaled_mse", digits=7)


def _vectors(t):
    return t["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _with_vectors(t):
    return pr.attach_payload(t["pairs"], _vectors(t), _vectors(t))


_DIST = "list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::double - c.embedding[i]::double) * (q.embedding[i]::double - c.embedding[i]::double)))"
_DIST_CTE = f"""
measured as (
  select p.*, {_DIST} as distance
  from pairs p join embeddings q on p.query_id = q.vec_id join embeddings c on p.cand_id = c.vec_id
),
positive as (select distance from measured where label = 1.0)"""


def _digest_sql(v):
    """All elements as whole millionths, digested."""
    return f"md5(array_to_string(list_transform({v}, lambda x: round(x::double * 1000000)::bigint), ','))"


@query(
    "pairs",
    f"""select p.query_id, p.cand_id, {_digest_sql('q.embedding')} as query_digest, {_digest_sql('c.embedding')} as cand_digest
       from pairs p join embeddings q on p.query_id = q.vec_id join embeddings c on p.cand_id = c.vec_id""",
)
def pair_features_join(t):
    def digest(v):
        whole = F.transform(v, lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
        return F.md5(F.array_join(whole.cast("array<string>"), ","))

    return bl.attach_vectors(t["pairs"].select("query_id", "cand_id"), _vectors(t), _vectors(t)).select(
        "query_id", "cand_id", digest("query_vec").alias("query_digest"), digest("cand_vec").alias("cand_digest")
    )


@query("pairs", "select query_id, cand_id, round(distance, 9) as distance from measured", _DIST_CTE)
def squared_l2(t):
    pairs = t["pairs"].select("query_id", "cand_id")
    measured = bl.measure_pairs(pairs, _vectors(t), _vectors(t), lambda: bl.squared_distances, "distance")
    return _rounded(measured, "distance", digits=9)


@query(
    "pairs",
    """select round(quantile_cont(distance, 0.33), 9) as p0, round(quantile_cont(distance, 0.66), 9) as p1
       from positive""",
    _DIST_CTE,
)
def pair_distance_stats(t):
    return _rounded(ds.pair_distance_stats(_with_vectors(t)), "p0", "p1", digits=9)


@query(
    "pairs",
    """select b.bin + 1 as bin, round(lo + b.bin * (hi - lo) / 3, 6) as low,
         round(lo + (b.bin + 1) * (hi - lo) / 3, 6) as high,
         count(distance) as n, round(count(distance)::double / max(total), 9) as share
       from (select unnest(range(0, 3)) as bin) b
       cross join (select min(distance) as lo, max(distance) as hi, count(*) as total from positive) r
       left join positive p on least(floor((p.distance - r.lo) * 3 / (r.hi - r.lo)), 2) = b.bin
       group by b.bin, lo, hi""",
    _DIST_CTE,
)
def distance_histogram(t):
    histogram = ds.distance_histogram(ds.positive_distances(_with_vectors(t)))
    return _rounded(_rounded(histogram, "low", "high"), "share", digits=9)


# Weights of the layers of the deeper network
LAYER_WEIGHTS = (0.0, 0.1, 0.2, 0.3, 0.4)


@query(
    "pairs",
    """select query_id, cand_id,
         round(0.1 * score / 2 + 0.2 * score / 3 + 0.3 * score / 4 + 0.4 * score / 5, 9) as score
       from pairs""",
)
def aggregate_layer_scores(t):
    layers = [F.col("score") / i for i in range(1, 6)]
    return t["pairs"].select(
        "query_id", "cand_id", F.round(weighted_score(layers, LAYER_WEIGHTS), 9).alias("score")
    )


def _closeness():
    def predict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = a.astype(np.float64) - b.astype(np.float64)
        return np.exp(-(apart * apart).sum(axis=1))

    return predict


@query("pairs", "select query_id, cand_id, round(exp(-distance), 6) as score from measured", _DIST_CTE)
def score_pairs(t):
    scored = bl.measure_pairs(t["pairs"].select("query_id", "cand_id"), _vectors(t), _vectors(t), _closeness)
    return _rounded(scored.select("query_id", "cand_id", "score"), "score")


