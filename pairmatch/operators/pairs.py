"""Labelled pairs, numbered batches and what is attached to them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.lineage import SORTED_PARQUET, scratch_path
from pairmatch.operators.ordering import changes, number_rows, with_offset
from pairmatch.operators.skew import split_join

BATCH_SIZE = 10_000
# What a label means
POSITIVE, BETWEEN, NEGATIVE = 1.0, 0.5, 0.0


def label_pairs(
    pairs: DataFrame,
    match: str = "contains",
    query: str = "query_name",
    stem: str = "cand_stem",
    query_stem: str = "query_stem",
) -> DataFrame:
    """Adds ``label``: 1 if the candidate's stem occurs in the query's name, else 0.

    Occurring anywhere also matches a longer post number; ``exact`` compares stems.
    """
    if match == "contains":
        related = F.col(query).contains(F.col(stem))
    elif match == "exact":
        related = F.col(query_stem) == F.col(stem)
    else:
        raise ValueError(f"unknown match {match!r}")
    return pairs.withColumn("label", F.when(related, POSITIVE).otherwise(NEGATIVE))


def filter_binary_labels(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("label") != BETWEEN)


def filter_positive(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("label") == POSITIVE)


def attach_payload(
    pairs: DataFrame, left: DataFrame, right: DataFrame, payload: str = "vec"
) -> DataFrame:
    """Adds ``query_<payload>`` and ``cand_<payload>`` by id; tables are (id, payload)."""
    return pairs.join(
        left.select(F.col("id").alias("query_id"), F.col(payload).alias(f"query_{payload}")),
        "query_id",
    ).join(
        right.select(F.col("id").alias("cand_id"), F.col(payload).alias(f"cand_{payload}")),
        "cand_id",
    )


def attach_scores(packed: DataFrame, scores: DataFrame) -> DataFrame:
    """Predictions (batch, slot, score) back on their pairs, over any number of batches."""
    return packed.join(scores, ["batch", "slot"])


def pack_batches(pairs: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Adds n, batch and slot: the place of each pair in (query_id, cand_id) order."""
    return batched(number_rows(pairs, ["query_id", "cand_id"], "n"), size)


def batched(numbered: DataFrame, size: int) -> DataFrame:
    """Adds batch and slot of the place n."""
    return numbered.select(
        "*",
        F.floor(F.col("n") / size).alias("batch"),
        F.pmod("n", F.lit(size)).alias("slot"),
    )


def _label_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows in (query_id, cand_id) order, true pairs first, become labelled pairs with their place in the task."""
    part = TaskContext.get().partitionId()
    last, related, at = None, False, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column("query_id"), batch.column("cand_id")]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        for column in ids:
            fresh[1:] |= changes(column)
        fresh[0] = last != [column[0].as_py() for column in ids]
        true = batch.column("_true").to_numpy(zero_copy_only=False).astype(bool)
        # a pair is related if the rows of its ids begin with a true one, which may be in an earlier batch
        positive = np.concatenate([[related], true[np.flatnonzero(fresh)]])[np.cumsum(fresh)]
        last, related = [column[-1].as_py() for column in ids], bool(positive[-1])
        labels = pa.array(np.where(positive, POSITIVE, NEGATIVE))
        kept = pa.RecordBatch.from_arrays(
            [*ids, labels, batch.column("score")], ["query_id", "cand_id", "label", "score"]
        ).filter(pa.array(~true))
        places = pa.array(np.arange(at, at + kept.num_rows))
        at += kept.num_rows
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(np.full(kept.num_rows, part)), places], [*kept.schema.names, "_part", "_at"]
        )


def pack_labelled(pairs: DataFrame, truth: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """``pack_batches`` of pairs (query_id, cand_id, score) that get their ``label`` in the same sort.

    A label is positive if the pair is in ``truth`` (query_id, truth_id), which has each pair once.  True pairs are
    sorted in between the others, so pairs are shuffled a single time; they are kept as Parquet, in which sorted ids
    and places take few bytes, until the sizes of the partitions are known.
    """
    known = truth.where("query_id is not null and truth_id is not null").select(
        "query_id", F.col("truth_id").alias("cand_id"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("_true")
    )
    rows = pairs.select("query_id", "cand_id", F.col("score").cast("double").alias("score"), F.lit(False).alias("_true"))
    ordered = rows.unionByName(known).orderBy("query_id", "cand_id", F.desc("_true"))
    schema = T.StructType(
        [*ordered.schema.fields[:2], T.StructField("label", T.DoubleType()), T.StructField("score", T.DoubleType()),
         T.StructField("_part", T.LongType()), T.StructField("_at", T.LongType())]
    )
    path = scratch_path(pairs.sparkSession, "ordered")
    ordered.mapInArrow(_label_in_order, schema).write.options(**SORTED_PARQUET).parquet(path)
    placed = with_offset(pairs.sparkSession.read.parquet(path), F.count(F.lit(1)))
    return batched(placed.withColumn("n", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset"), size)


def _range_columns(first: Column, end: Column, size: int) -> list[Column]:
    return [
        F.floor(first / size).alias("start_batch"),
        F.pmod(first, F.lit(size)).alias("start_slot"),
        F.floor(end / size).alias("end_batch"),
        F.pmod(end, F.lit(size)).alias("end_slot"),
    ]


def batch_index(packed: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Per query: where its pairs start, where they end (exclusive), how many are relevant."""
    per_query = packed.groupBy("query_id").agg(
        F.min("n").alias("first"),
        (F.max("n") + 1).alias("end"),
        F.count_if(F.col("label") == POSITIVE).alias("n_relevant"),
    )
    return per_query.select(
        "query_id", *_range_columns(F.col("first"), F.col("end"), size), "n_relevant"
    )


def relevant_positions(packed: DataFrame) -> DataFrame:
    """(query_id, position): place of every relevant pair among the pairs of its query.

    One row per position rather than one list per query, which would have no size bound.
    """
    firsts = packed.groupBy("query_id").agg(F.min("n").alias("first"))
    return (
        filter_positive(packed)
        .join(firsts, "query_id")
        .select("query_id", (F.col("n") - F.col("first")).alias("position"))
    )


def _looked_up_stems(queries: DataFrame, candidates: DataFrame, match: str) -> DataFrame:
    """(query_id, i, key): the stems that would make a candidate positive for the query.

    For ``contains`` these are the parts of the query's own name that can be a stem at all:
    parts that begin like every stem does and are as long as some stem.  So containment is
    looked up by equality.
    """
    if match == "exact":
        return queries.select("query_id", "i", F.col("stem").alias("key"))
    if match != "contains":
        raise ValueError(f"unknown match {match!r}")
    # one row: two names, and as many lengths as there are different ones
    low, high, lengths = candidates.agg(
        F.min("stem"), F.max("stem"), F.collect_set(F.length("stem"))
    ).first()
    begin = os.path.commonprefix([low or "", high or ""])
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    name = F.col("name")
    starts = F.filter(
        F.sequence(F.lit(1), F.length(name) + 1),
        lambda at: F.substring(name, at, F.lit(len(begin))) == F.lit(begin),
    )

    def parts(at):
        fitting = F.filter(sizes, lambda n: at + n - 1 <= F.length(name))
        return F.transform(fitting, lambda n: F.substring(name, at, n))

    keys = F.array_distinct(F.flatten(F.transform(starts, parts)))
    return queries.select("query_id", "i", F.explode(keys).alias("key"))


def related_pairs(queries: DataFrame, candidates: DataFrame, match: str = "contains") -> DataFrame:
    """(query_id, truth_id): every candidate whose stem the query's name contains, or whose stem is the query's.

    Both tables are (id, name, stem).  Names are looked up by equality, hot stems are split.
    """
    keyed = _looked_up_stems(
        queries.select(F.col("id").alias("query_id"), "name", "stem", F.lit(0).alias("i")), candidates, match
    )
    stems = candidates.select(F.col("id").alias("truth_id"), F.col("stem").alias("key"))
    return split_join(keyed, stems, ["key"], left_id=["query_id"], right_id=["truth_id"]).select("query_id", "truth_id")


def exhaustive_index(
    queries: DataFrame, candidates: DataFrame, match: str = "contains", size: int = BATCH_SIZE
) -> tuple[DataFrame, DataFrame]:
    """The batches of all queries against all candidates, without writing out the product.

    Queries (id, name, stem) go by name and meet the candidates (id, name, stem) in name
    order, so pair number and batch follow from the two positions.  Returned are the range
    of every query (query_id, n_pairs, start_batch, start_slot, end_batch, end_slot,
    n_relevant) and the positive pairs (query_id, cand_id, position, batch, slot, label);
    every other pair in a query's range is negative.  The ranges count candidates by stem
    and never list positive pairs, of which one popular stem can have very many.
    """
    placed = number_rows(
        candidates.select(F.col("id").alias("cand_id"), "name", "stem"), ["name", "cand_id"], "position"
    )
    total = placed.count()
    ordered = number_rows(
        queries.select(F.col("id").alias("query_id"), "name", "stem"), ["name", "query_id"], "i"
    )
    keyed = _looked_up_stems(ordered, placed, match)
    first = F.col("i") * F.lit(total)

    n = first + F.col("position")
    positives = split_join(
        keyed,
        placed.select("cand_id", "position", F.col("stem").alias("key")),
        ["key"],
        left_id=["query_id"],
        right_id=["cand_id"],
    ).select(
        "query_id",
        "cand_id",
        "position",
        F.floor(n / size).alias("batch"),
        F.pmod(n, F.lit(size)).alias("slot"),
        F.lit(POSITIVE).alias("label"),
    )

    per_stem = placed.groupBy(F.col("stem").alias("key")).agg(F.count(F.lit(1)).alias("held"))
    relevant = keyed.join(per_stem, "key").groupBy("query_id").agg(F.sum("held").alias("n_relevant"))
    ranges = ordered.join(relevant, "query_id", "left").select(
        "query_id",
        F.lit(total).cast("bigint").alias("n_pairs"),
        *_range_columns(first, first + total, size),
        F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
    )
    return ranges, positives
