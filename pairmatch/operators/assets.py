"""Posts as groups of files: roles, retrieval sets, samples and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.names import count_of, number_of, stem
from pairmatch.operators.ordering import number_rows, rank_within


def asset_roles(assets: DataFrame) -> DataFrame:
    """Adds ``role``: the first file of a post is the parent, the others are children.

    Posts with a single file, or whose first file has more than one underscore, are left
    out.  A post needs only its smallest file name and its size, so a hot post is reduced
    map-side and no window has to hold it.
    """
    posts = (
        assets.groupBy("post_id")
        .agg(F.min("filename").alias("_first"), F.count(F.lit(1)).alias("_files"))
        .where((F.col("_files") > 1) & (count_of(F.col("_first"), "_") <= 1))
    )
    role = F.when(F.col("filename") == F.col("_first"), "parent").otherwise("child")
    return assets.join(posts, "post_id").withColumn("role", role).drop("_first", "_files")


def build_retrieval_sets(assets: DataFrame, mode: str = "pc") -> tuple[DataFrame, DataFrame]:
    """(candidates, queries), each (id, post_id, name, stem, vec).

    ``pc``: parents are candidates and children are queries; ``cp``: the other way round.
    A parent's stem is its name without extension, a child's the part before its number.
    """
    if mode not in ("pc", "cp"):
        raise ValueError(f"unknown mode {mode!r}")
    with_roles = asset_roles(assets)

    def side(role: str) -> DataFrame:
        return with_roles.where(F.col("role") == role).select(
            F.col("vec_id").alias("id"),
            "post_id",
            F.col("filename").alias("name"),
            stem(F.col("filename"), "." if role == "parent" else "_").alias("stem"),
            F.col("embedding").alias("vec"),
        )

    parents, children = side("parent"), side("child")
    return (parents, children) if mode == "pc" else (children, parents)


def truth_lookup(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, truth_id): the candidate with exactly the query's stem, null if missing."""
    originals = candidates.groupBy("stem").agg(F.min("id").alias("truth_id"))
    return queries.select(F.col("id").alias("query_id"), "stem").join(
        originals, "stem", "left"
    ).select("query_id", "truth_id")


def sample_groups(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` groups, chosen by a seeded hash of the key."""
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    chosen = df.select(key).distinct().orderBy(draw, key).limit(n)
    return df.join(chosen, key, "left_semi")


def sequential_names(
    df: DataFrame,
    order: Sequence[str],
    fmt: str = "%010d.jpg",
    start: int = 1,
    folder: Sequence[str] = (),
    name: str = "new_name",
) -> DataFrame:
    """Adds a name with the running number, counted per folder if one is given."""
    if folder:
        numbered = rank_within(df, list(folder), list(order), "_i").withColumn(
            "_i", F.col("_i") - 1 + start
        )
    else:
        numbered = number_rows(df, list(order), "_i", start)
    return numbered.withColumn(name, F.format_string(fmt, "_i")).drop("_i")


def make_training_pairs(
    assets: DataFrame, seed: int, exclude_self: bool = True, suffixes: Sequence[str] = (".jpg",)
) -> DataFrame:
    """(post_id, left, right, label) for training a pair scorer.

    For every child: (parent, child, 1), (child, another child of the post, 0.5) if there is
    one, and (parent, parent of a random post, 0).  Files with other suffixes do not count.
    All draws come from hashes of the child's name, so a rerun gives the same pairs.
    """
    usable = assets.where(
        F.substring_index("filename", ".", -1).isin(*[s.lstrip(".") for s in suffixes])
    ).select("post_id", "filename")
    with_roles = asset_roles(usable)
    children = rank_within(
        with_roles.where(F.col("role") == "child").select("post_id", "filename"),
        ["post_id"],
        ["filename"],
        "i",
    )
    # an isolated post cannot be drawn, so the dense number runs over posts with a parent
    posts = number_rows(
        with_roles.groupBy("post_id").agg(
            F.min("filename").alias("parent"), (F.count(F.lit(1)) - 1).alias("n")
        ),
        ["post_id"],
        "k",
    )
    total = posts.count()
    child = children.join(posts, "post_id")

    positive = child.select(
        "post_id", F.col("parent").alias("left"), F.col("filename").alias("right"),
        F.lit(1.0).alias("label"),
    )

    def drawn(kind):
        # wide enough to reach every post of a very large table
        return number_of(F.concat(F.lit(f"{seed}-{kind}-"), F.col("filename")), 15)

    # 1..n without i: go on from i by 1 to n-1 places, in a circle
    other = 1 + F.pmod(F.col("i") + F.pmod(drawn("sibling"), F.col("n") - 1), F.col("n"))
    sibling = (
        child.where(F.col("n") > 1)
        .select("post_id", F.col("filename").alias("left"), other.alias("i"))
        .join(children.select("post_id", "i", F.col("filename").alias("right")), ["post_id", "i"])
        .select("post_id", "left", "right", F.lit(0.5).alias("label"))
    )

    if exclude_self:
        place = F.pmod(drawn("negative"), F.lit(max(total - 1, 1)))
        target = place + F.when(place >= F.col("k"), 1).otherwise(0)
    else:
        target = F.pmod(drawn("negative"), F.lit(max(total, 1)))
    negative = (
        child.select("post_id", F.col("parent").alias("left"), target.alias("k"))
        .join(posts.select("k", F.col("parent").alias("right")), "k")
        .select("post_id", "left", "right", F.lit(0.0).alias("label"))
    )
    return positive.unionByName(sibling).unionByName(negative)
