"""Predicates and rewrites of link, comment and album-page columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffixes that make a link an image link
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]
TYPO_SUFFIXES = [
    ".com", ".img", ".jgp", ".jph", ".jpd", ".jpp", ".jpq", ".jog", ".kpg", ".pbg",
]
# What marks an album link
ALBUM_MARKS = ["/a/", "/r/", "/gallery"]
ALBUM_HOST = "imgur"
UPLOAD_HOST = "i.reddituploads.com"
DIRECT_IMAGE = "http://i.imgur.com/"
# Fixed value: a link that never leads to an image
BLOCKED_LINKS = ["http://i.imgur.com/ET4VfDd.jpg"]
# Fixed pattern: protocol, host prefixes, link type, two name parts, position, extension
ALBUM_URL = (
    r"^(https?)://(www\.)?(i\.|m\.)?imgur\.com/(a/|gallery/|r/)?/?(\w*)/?(\w*)(#[0-9]+)?(.\w*)?"
)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def has_extension(link: Column, suffixes: Sequence[str] = (*IMAGE_SUFFIXES, *TYPO_SUFFIXES)) -> Column:
    """Whether the link ends with one of the suffixes, in this exact case."""
    return _any([link.endswith(s) for s in suffixes])


def fix_typo_extension(link: Column, apply: bool = False) -> Column:
    """Mistyped suffixes turned into ``.png``; left alone unless ``apply``."""
    if not apply:
        return link
    names = "|".join(s[1:] for s in TYPO_SUFFIXES)
    return F.regexp_replace(link, rf"\.({names})\z", ".png")


def not_gif(link: Column) -> Column:
    return ~(link.endswith("gif") | link.endswith("gifv"))


def is_host(link: Column, host: str = ALBUM_HOST) -> Column:
    """Whether the host name occurs anywhere in the link."""
    return link.contains(host)


def is_album_link(link: Column) -> Column:
    return _any([link.contains(mark) for mark in ALBUM_MARKS])


def rewrite_no_ext_link(link: Column) -> Column:
    """The direct image link for the last path part, which may be empty."""
    return F.concat(F.lit(DIRECT_IMAGE), F.substring_index(link, "/", -1), F.lit(".jpg"))


def append_upload_ext(link: Column) -> Column:
    return F.concat(link, F.lit(".jpg"))


def has_markdown_link(body: Column) -> Column:
    """Whether the text starts with ``[..](..)``; only a line feed ends a line."""
    return body.rlike(r"(?d)^\[.+\]\(.+\)")


def extract_markdown_link(body: Column) -> Column:
    """What stands between the first ``(`` and the first ``)``."""
    opened, closed = F.instr(body, "("), F.instr(body, ")")
    return F.substring(body, opened + 1, F.greatest(closed - opened - 1, F.lit(0)))


def parse_album_url(link: Column, subreddit_key: bool = False) -> Column:
    """Struct of protocol, link type, main key and extension; null for other hosts.

    The main key is the first name part; with ``subreddit_key`` an ``r/`` link takes the
    second one.
    """
    pattern = "(?dU)" + ALBUM_URL
    part = lambda i: F.regexp_extract(link, pattern, i)
    key = part(5)
    if subreddit_key:
        key = F.when(part(4) == "r/", part(6)).otherwise(key)
    fields = F.struct(
        part(1).alias("protocol"),
        part(4).alias("link_type"),
        key.alias("main_key"),
        part(8).alias("extension"),
    )
    return F.when(link.rlike(pattern), fields)


def album_all_url(link: Column) -> Column:
    """``/a/ID...`` and ``/gallery/ID...`` paths become ``/a/ID/all``."""
    return F.regexp_replace(
        link, r"^([^:/?#]+://[^/?#]*)/(?:a|gallery)/([^/?#]*)[^?#]*", "$1/a/$2/all"
    )


def album_title(html: Column, key: Column) -> Column:
    """The page title with the key in brackets, or just the key."""
    pattern = r"(?d)<title>\s*(.*) - (?:Album on )*?Imgur"
    named = F.concat(F.regexp_extract(html, pattern, 1), F.lit(" ("), key, F.lit(")"))
    return F.when(html.rlike(pattern), named).otherwise(key)


def album_file_title(html: Column, key: Column, given: Column | None = None) -> Column:
    """The title as part of a file name; a caller's name that isn't empty comes before the page's own."""
    title = album_title(html, key)
    if given is not None:
        title = F.when(given != "", given).otherwise(title)
    return slugify(title)


def owned_name(name: Column, post_id: Column) -> Column:
    """What the files of a link are called: its name and its post, or the post alone."""
    return F.concat_ws("_", name, post_id)


@F.arrow_udf(StringType())
def _ascii_only(text: pa.Array) -> pa.Array:
    plain = pc.utf8_normalize(text, form="NFKD")
    return pc.replace_substring_regex(plain, pattern=r"[^\x00-\x7F]", replacement="")


def slugify(text: Column) -> Column:
    """Compatibility-decomposed ASCII without the characters a file name should not have."""
    space = r"\t\n\x0B\f\r\x1C-\x1F "
    kept = F.regexp_replace(_ascii_only(text), rf"[^A-Za-z0-9_{space}\-.)(]", "")
    return F.regexp_replace(kept, rf"\A[{space}]+|[{space}]+\z", "")
