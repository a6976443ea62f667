"""Album pages: the images they list and what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.links import DIRECT_IMAGE, album_all_url, not_gif, owned_name, parse_album_url

_PAGE_JSON = (
    "album_images struct<images: array<struct<hash: string, ext: string>>>, "
    "hash string, ext string"
)
# Fixed pattern: an image's hash and extension on one line
_HASH_AND_EXT = r'(?d)"hash":"([a-zA-Z0-9]+)".*?"ext":"(\.[a-zA-Z0-9]+)"'


def _images_from_json(html: Column) -> Column:
    """The listed images, or the single image of a page without a list."""
    text = F.regexp_replace(F.regexp_extract(html, r"(?s)item:(.*?)\};", 1), "\n", "")
    page = F.from_json(text, _PAGE_JSON)
    listed = F.transform(
        page["album_images"]["images"],
        lambda image: F.struct(
            image["hash"].alias("hash"), F.substring_index(image["ext"], "?", 1).alias("ext")
        ),
    )
    single = F.array(
        F.struct(page["hash"].alias("hash"), F.substring_index(page["ext"], "?", 1).alias("ext"))
    )
    return F.when(page["album_images"].isNotNull(), listed).when(page["hash"].isNotNull(), single)


def _images_from_text(html: Column, key: Column) -> Column:
    """The same by pattern; a first image that is only the album's own key is left out."""
    item = F.regexp_extract(html, r"(?s)(item:.*?\};)", 1)
    counted = F.regexp_extract(item, r'(?s)("images".*?\])', 1)
    text = F.when(item.contains('"count"'), counted).otherwise(item)
    images = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_HASH_AND_EXT), F.lit(1)).alias("hash"),
        F.regexp_extract_all(text, F.lit(_HASH_AND_EXT), F.lit(2)).alias("ext"),
    )
    own_first = (F.size(images) > 1) & (F.get(images, F.lit(0))["hash"] == key)
    return F.when(own_first, F.slice(images, F.lit(2), F.size(images))).otherwise(images)


def album_images(pages: DataFrame, mode: str = "json") -> DataFrame:
    """Pages (…, main_key, html) to one row per image: (…, main_key, position, hash, ext)."""
    if mode == "json":
        images = _images_from_json(F.col("html"))
    elif mode == "regex":
        images = _images_from_text(F.col("html"), F.col("main_key"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(images).alias("at", "image")).select(
        *kept, (F.col("at") + 1).alias("position"), "image.hash", "image.ext"
    )


def album_failures(pages: DataFrame, mode: str = "json") -> DataFrame:
    """Pages (…, main_key, html) from which ``album_images`` gets no row: (…, main_key, reason).

    Reasons: no text, no item on the page, an item that doesn't parse, an item without images.
    """
    html = F.col("html")
    item = F.regexp_extract(html, r"(?s)item:(.*?)\};", 1)
    kept = [c for c in pages.columns if c != "html"]
    if mode == "json":
        images = _images_from_json(html)
        broken = F.from_json(
            F.regexp_replace(item, "\n", ""), f"{_PAGE_JSON}, broken string", {"columnNameOfCorruptRecord": "broken"}
        )["broken"].isNotNull()
    elif mode == "regex":
        images, broken = _images_from_text(html, F.col("main_key")), F.lit(False)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    reason = (
        F.when(html.isNull(), "no text")
        .when(~F.coalesce(html.rlike(r"(?s)item:.*?\};"), F.lit(False)), "no item")
        .when(broken, "item doesn't parse")
        .otherwise("no images")
    )
    return pages.where(F.coalesce(F.size(images), F.lit(0)) <= 0).select(*kept, reason.alias("reason"))


def download_plan(images: DataFrame, first_per_ext: bool = False) -> DataFrame:
    """Adds image_url and file_name, without gif images; positions still count them.

    All images of one extension share a file name; ``first_per_ext`` keeps the first.
    """
    plan = images.where(not_gif(F.col("ext"))).select(
        "*",
        F.concat(F.lit(DIRECT_IMAGE), "hash", "ext").alias("image_url"),
        F.concat("post_id", "ext").alias("file_name"),
    )
    if not first_per_ext:
        return plan
    row = F.struct(*plan.columns)
    return (
        plan.groupBy("post_id", "file_name")
        .agg(F.min_by(row, "position").alias("row"))
        .select("row.*")
    )


def link_plan(classified: DataFrame, subreddit_key: bool = False) -> DataFrame:
    """Adds image_url and file_name to (link_type, link, name, post_id) rows that need no page to be read first.

    These are image links, stored as ``.jpg`` whatever they end with, and album links that have an extension
    and so are images themselves, without gif images.  ``links_with_pages`` has the other album links.
    """
    parsed = parse_album_url(F.col("link"), subreddit_key)
    own = owned_name(F.col("name"), F.col("post_id"))
    return (
        classified.withColumn("_url", F.when(F.col("link_type") == "imgur_album", parsed))
        .where(
            (F.col("link_type") == "image")
            | ((F.col("_url.extension") != "") & not_gif(F.col("_url.extension")))
        )
        .select(
            *classified.columns,
            F.when(F.col("link_type") == "image", F.col("link"))
            .otherwise(F.concat(F.lit(DIRECT_IMAGE), "_url.main_key", "_url.extension"))
            .alias("image_url"),
            F.concat(own, F.coalesce("_url.extension", F.lit(".jpg"))).alias("file_name"),
        )
    )


def links_with_pages(classified: DataFrame, subreddit_key: bool = False) -> DataFrame:
    """(link, main_key, page_url, post_id): album links whose page lists the images.

    ``post_id`` is what the files will be called.  With the page as ``html`` these are rows for ``album_images``.
    Album links that aren't of the album host have no page and are in ``link_failures``.
    """
    parsed = parse_album_url(F.col("link"), subreddit_key)
    return (
        classified.where("link_type = 'imgur_album'")
        .withColumn("_url", parsed)
        .where("_url is not null and _url.extension = ''")
        .select(
            "link",
            F.col("_url.main_key").alias("main_key"),
            album_all_url(F.col("link")).alias("page_url"),
            owned_name(F.col("name"), F.col("post_id")).alias("post_id"),
        )
    )


def link_failures(classified: DataFrame) -> DataFrame:
    """(link, reason): the links from which neither ``link_plan`` nor ``links_with_pages`` makes anything."""
    parsed = parse_album_url(F.col("link"))
    reason = F.when(parsed.isNull(), "not an album link").when(~not_gif(parsed["extension"]), "gif")
    return (
        classified.where("link_type = 'imgur_album'")
        .select("link", reason.alias("reason"))
        .where("reason is not null")
    )


def extension_counts(images: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Images per extension, the most frequent first."""
    return (
        images.groupBy(*by, "ext")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, F.desc("n"), "ext")
    )
