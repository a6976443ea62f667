"""From link and comment rows to one owner per typed link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions import links as fx
from pairmatch.operators.ordering import rank_within
from pairmatch.sources.store import write_counted

LINK_TYPES = ("image", "imgur_album")


def typed_links(links: DataFrame, apply_typo_fix: bool = False) -> DataFrame:
    """Every class a link belongs to: (link_type, class_rank, link, name, post_id, ord).

    A link may be a direct image and an upload at once.  Class conditions look at one row
    only, so what is left after taking a class away is its negated condition, and all
    classes come out of a single pass without a shuffle.
    """
    link = F.col("link")
    hosted = fx.is_host(link)

    def entry(link_type, rank, target):
        return F.struct(
            F.lit(link_type).alias("link_type"),
            F.lit(rank).alias("class_rank"),
            target.alias("link"),
        )

    # image, album and bare links exclude each other; only an upload comes on top
    main = (
        F.when(fx.has_extension(link), entry("image", 1, fx.fix_typo_extension(link, apply_typo_fix)))
        .when(hosted & fx.is_album_link(link), entry("imgur_album", 0, link))
        .when(hosted & fx.not_gif(link), entry("image", 0, fx.rewrite_no_ext_link(link)))
    )
    upload = F.when(
        link.contains(fx.UPLOAD_HOST), entry("image", 2, fx.append_upload_ext(link))
    )
    return (
        links.where(link.isNotNull())
        .select(F.explode(F.array(main, upload)).alias("t"), "name", "post_id", "ord")
        .where(F.col("t").isNotNull())
        .select("t.link_type", "t.class_rank", "t.link", "name", "post_id", "ord")
    )


def resolve_link_owner(typed: DataFrame) -> DataFrame:
    """(link_type, link, name, post_id): each distinct link with its last owner.

    Last means the highest class and in it the highest ``ord``.  One aggregate that
    combines map-side, so a link that fills a third of the table is no hot spot.
    """
    owner = F.max_by(F.struct("name", "post_id"), F.struct("class_rank", "ord"))
    return (
        typed.groupBy("link_type", "link")
        .agg(owner.alias("owner"))
        .select("link_type", "link", "owner.name", "owner.post_id")
    )


def classify_links(links: DataFrame, apply_typo_fix: bool = False) -> DataFrame:
    """(link, name, post_id, ord) rows to distinct typed links with one owner each."""
    return resolve_link_owner(typed_links(links, apply_typo_fix))


def count_by_type(classified: DataFrame) -> DataFrame:
    return classified.groupBy("link_type").agg(F.count(F.lit(1)).alias("n"))


def write_classified(links: DataFrame, path: str, apply_typo_fix: bool = False) -> dict[str, int]:
    """Write ``classify_links``; how many links each class has, from the same job."""
    kinds = {kind: F.col("link_type") == kind for kind in LINK_TYPES}
    return write_counted(classify_links(links, apply_typo_fix), path, kinds)


def distinct_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("link").isNotNull()).select("link").distinct()


def block_links(links: DataFrame, blocked: Sequence[str] = tuple(fx.BLOCKED_LINKS)) -> DataFrame:
    """Without the links of a short fixed list."""
    return links.where(~F.col("link").isin(*blocked))


def subtract_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` does not have; duplicates on the left stay."""
    known = right.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in left.columns]
    return left.join(known, same, "left_anti")


def direct_replies(comments: DataFrame) -> DataFrame:
    """Comments whose parent is the post itself."""
    return comments.where(F.col("parent_fullname") == F.col("post_fullname"))


def comment_link_rows(comments: DataFrame) -> DataFrame:
    """(link, name, post_id, ord) from direct replies that start with a markdown link."""
    body = F.col("comment_body")
    return (
        direct_replies(comments.where(body.isNotNull()))
        .where(fx.has_markdown_link(body))
        .select(
            fx.extract_markdown_link(body).alias("link"),
            F.lit(None).cast("string").alias("name"),
            F.col("post_fullname").alias("post_id"),
            "ord",
        )
    )


def comments_with_post(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """Rows whose ``post_id`` is among the posts."""
    return rows.join(posts.select("post_id").distinct(), "post_id", "left_semi")


def comment_links(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """(link_type, link, post_id): classified comment links of known posts."""
    classified = classify_links(comment_link_rows(comments))
    return comments_with_post(classified, posts).select("link_type", "link", "post_id")


def comment_file_names(classified: DataFrame) -> DataFrame:
    """Adds ``file_stem``: post id and the running number of the link in its post."""
    ranked = rank_within(classified, ["post_id"], ["link_type", "link"], "suffix")
    return ranked.withColumn(
        "file_stem", F.concat_ws("_", "post_id", F.col("suffix").cast("string"))
    )


def drop_empty_groups(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Groups that have at least one member."""
    return groups.join(members.select(key).distinct(), key, "left_semi")


def drop_placeholder(images: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Images whose bytes equal no placeholder, as their SHA-256 tells; images without bytes stay."""
    known = placeholders.select(F.sha2("content", 256).alias("_digest")).distinct()
    return (
        images.withColumn("_own", F.sha2("content", 256))
        .join(known, F.col("_own") == F.col("_digest"), "left_anti")
        .drop("_own")
    )
