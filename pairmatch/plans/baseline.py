"""The plain baseline: one table of random hyperplanes, nearest rows of the query's bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.bucketwise import Distance
from pairmatch.operators.copies import set_matches
from pairmatch.operators.lsh import near_matches, random_projection_lsh
from pairmatch.plans.retrieve import Retrieval


def lsh_baseline(
    index: DataFrame,
    queries: DataFrame,
    bits: int = 300,
    k: int = 5,
    seed: int = 0,
    radius: int = 0,
) -> DataFrame:
    """(query_id, cand_id, distance, rank): the ``k`` nearest rows of each query's bucket.

    Both inputs are (id, vec).  With ``radius`` 1 the buckets one bit away count as well.
    """
    if radius not in (0, 1):
        raise ValueError("radius must be 0 or 1")
    any_row = index.where(F.col("vec").isNotNull()).select("vec").first()
    dim = len(any_row["vec"]) if any_row else 1  # an empty index has no candidates, whatever the model
    model = random_projection_lsh(bits, dim, seed)
    found = Retrieval(
        model,
        # one band of all bits: a bucket holds equal signatures
        model.layout(bits),
        index,
        queries,
        scorer=Distance(),
        search=near_matches if radius else set_matches,
    )
    return found.top(k).select("query_id", "cand_id", (-F.col("score")).alias("distance"), "rank")
