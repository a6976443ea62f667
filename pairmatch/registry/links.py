"""Link, comment and album queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pairmatch.functions import links as fx
from pairmatch.lineage import scratch_path
from pairmatch.operators import albums as al
from pairmatch.operators import links as ln
from pairmatch.registry.base import register
from pairmatch.sources import dumps

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

_EXT = (
    "regexp_matches({0}, '\\.(png|jpg|jpeg|com|img|jgp|jph|jpd|jpp|jpq|jog|kpg|pbg)$')"
)
_ALBUM = "(contains({0}, '/a/') or contains({0}, '/r/') or contains({0}, '/gallery'))"
_GIF = "({0} like '%gif' or {0} like '%gifv')"


def _on_links(expression):
    return lambda t: t["links"].where("link is not null").select(
        "ord", "link", expression(_link()).alias("out")
    )


def _link():
    return F.col("link")


def _link_sql(expression):
    return f"select ord, link, {expression} as out from links where link is not null"


def _link_query(name, column, expression):
    """Register a column function of the link under ``name``."""
    fn = _on_links(column)
    fn.__name__ = name
    query("links", _link_sql(expression))(fn)


_link_query("has_extension", fx.has_extension, _EXT.format("link"))
_link_query("fix_typo_extension", fx.fix_typo_extension, "link")
_link_query(
    "fix_typo_extension_applied",
    partial(fx.fix_typo_extension, apply=True),
    "regexp_replace(link, '\\.(com|img|jgp|jph|jpd|jpp|jpq|jog|kpg|pbg)$', '.png')",
)
_link_query("not_gif", fx.not_gif, f"not {_GIF.format('link')}")
_link_query("is_imgur", fx.is_host, "link like '%imgur%'")
_link_query("is_album_link", fx.is_album_link, _ALBUM.format("link"))
_link_query(
    "rewrite_no_ext_link",
    fx.rewrite_no_ext_link,
    "concat('http://i.imgur.com/', string_split(link, '/')[-1], '.jpg')",
)
_link_query(
    "album_all_url",
    fx.album_all_url,
    "case when regexp_matches(link, '^https?://[^/]*/(a|gallery)/') then "
    "concat(regexp_extract(link, '^(https?://[^/]*)/', 1), '/a/', string_split(link, '/')[5], '/all') "
    "else link end",
)


@query("links", """select ord, concat(link, '.jpg') as link from links
                   where contains(link, 'i.reddituploads.com')""")
def append_upload_ext(t):
    return t["links"].where(_link().contains(fx.UPLOAD_HOST)).select(
        "ord", fx.append_upload_ext(_link()).alias("link")
    )


_PARSE = "'^(https?)://(www\\.)?(i\\.|m\\.)?imgur\\.com/(a/|gallery/|r/)?/?(\\w*)/?(\\w*)(#[0-9]+)?(.\\w*)?'"


@query(
    "links",
    f"""select ord, regexp_extract(link, {_PARSE}, 1) as protocol,
          regexp_extract(link, {_PARSE}, 4) as link_type,
          regexp_extract(link, {_PARSE}, 5) as main_key,
          case when regexp_extract(link, {_PARSE}, 4) = 'r/' then regexp_extract(link, {_PARSE}, 6)
               else regexp_extract(link, {_PARSE}, 5) end as subreddit_key,
          regexp_extract(link, {_PARSE}, 8) as extension
        from links where regexp_matches(link, {_PARSE})""",
)
def parse_imgur_url(t):
    parsed = t["links"].select(
        "ord", fx.parse_album_url(_link()).alias("p"), fx.parse_album_url(_link(), True).alias("s")
    )
    return parsed.where(F.col("p").isNotNull()).select(
        "ord", "p.protocol", "p.link_type", "p.main_key",
        F.col("s.main_key").alias("subreddit_key"), "p.extension",
    )


_TYPED_CTE = f"""
typed as (
  select 'image' as link_type, 0 as class_rank,
         concat('http://i.imgur.com/', string_split(link, '/')[-1], '.jpg') as link, name, post_id, ord
  from links where link like '%imgur%' and not {_EXT.format('link')} and not {_ALBUM.format('link')}
    and not {_GIF.format('link')}
  union all
  select 'image', 1, link, name, post_id, ord from links where {_EXT.format('link')}
  union all
  select 'image', 2, concat(link, '.jpg'), name, post_id, ord from links
  where link like '%i.reddituploads.com%'
  union all
  select 'imgur_album', 0, link, name, post_id, ord from links
  where link like '%imgur%' and not {_EXT.format('link')} and {_ALBUM.format('link')}
),
owned as (
  select link_type, link, name, post_id from (
    select *, row_number() over (partition by link_type, link order by class_rank desc, ord desc) as rn
    from typed) x where rn = 1
)"""


@query("links", "select link_type, class_rank, link, name, post_id, ord from typed", _TYPED_CTE)
def union_links(t):
    return ln.typed_links(t["links"])


@query("links", "select * from owned", _TYPED_CTE)
def classify_links(t):
    return ln.classify_links(t["links"])


@query("links", "select link_type, link, name, post_id from owned where link_type = 'image'", _TYPED_CTE)
def resolve_link_owner(t):
    return ln.resolve_link_owner(ln.typed_links(t["links"]).where("link_type = 'image'"))


@query("links", "select link_type, count(*) as n from owned group by link_type", _TYPED_CTE)
def count_valid_links(t):
    return ln.count_by_type(ln.classify_links(t["links"]))


@query("links", "select link_type, count(*) as n, count(*) as stored from owned group by link_type", _TYPED_CTE)
def write_classified(t):
    """Links of each class, counted while they are written, and what is in the files."""
    path = scratch_path(t.spark, "classified")
    counts = ln.write_classified(t["links"], path)
    counted = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    stored = ln.count_by_type(t.spark.read.parquet(path))
    return stored.select("link_type", counted[F.col("link_type")].alias("n"), F.col("n").alias("stored"))


# cells as they are, spaces and line breaks at their ends included
_DUMP = {
    "quote": '"', "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


@query(
    "comments",
    """select concat(comment_body, chr(10), 'said "', cast(ord as varchar), '",', chr(10)) as comment_body,
         parent_fullname, post_fullname from comments where comment_body is not null""",
)
def read_comment_dump(t):
    """Comments with line breaks and quotes, from a dump whose files are split."""
    path = scratch_path(t.spark, "comments")
    body = F.concat("comment_body", F.lit('\nsaid "'), F.col("ord").cast("string"), F.lit('",\n'))
    told = t["comments"].select("*", body.alias("body"))
    cells = {"comment_body": "body", "parent_fullname": "parent_fullname", "post_fullname": "post_fullname"}
    columns = [F.col(cells[n]).alias(n) if n in cells else F.lit("x").alias(n) for n in dumps.COMMENT_COLUMNS]
    told.select(*columns).write.csv(path, **_DUMP)
    return dumps.read_comment_dump(t.spark, path, split_files=True).drop("ord")


@query("links", "select link, name, post_id from links where link is not null")
def read_link_dump(t):
    """Links of posts whose titles have line breaks, from a dump whose files are split."""
    path = scratch_path(t.spark, "submissions")
    cells = {
        "subreddit_name": F.col("name"), "post_fullname": F.col("post_id"), "post_target_url": F.col("link"),
        "post_title": F.concat(F.lit('on\n"'), F.col("ord").cast("string"), F.lit('"')),
    }
    columns = [cells.get(n, F.lit("x")).alias(n) for n in dumps.SUBMISSION_COLUMNS]
    t["links"].select(*columns).write.csv(path, **_DUMP)
    return dumps.read_link_dump(t.spark, path, split_files=True).drop("ord")


@query("links", "select distinct link from links where link is not null")
def distinct_links(t):
    return ln.distinct_links(t["links"])


@query(
    "links",
    "select ord, link from links where link not in ('http://i.imgur.com/ET4VfDd.jpg', 'http://i.imgur.com/k0.jpg')",
)
def block_links(t):
    blocked = [*fx.BLOCKED_LINKS, "http://i.imgur.com/k0.jpg"]
    return ln.block_links(t["links"], blocked).select("ord", "link")


@query(
    "links",
    f"""select link, name, post_id from links l where link like '%imgur%' and not exists (
          select 1 from links r where r.link = l.link and r.name = l.name and r.post_id = l.post_id
            and {_EXT.format('r.link')})""",
)
def subtract(t):
    hosted = t["links"].where(fx.is_host(_link())).select("link", "name", "post_id")
    return ln.subtract_rows(hosted, hosted.where(fx.has_extension(_link())))


@query("comments", "select ord, comment_body from comments where parent_fullname = post_fullname")
def direct_replies(t):
    return ln.direct_replies(t["comments"]).select("ord", "comment_body")


def _body():
    return F.col("comment_body")


@query(
    "comments",
    """select ord, regexp_matches(comment_body, '^\\[.+\\]\\(.+\\)') as out from comments
       where comment_body is not null""",
)
def has_markdown_link(t):
    return t["comments"].where(_body().isNotNull()).select(
        "ord", fx.has_markdown_link(_body()).alias("out")
    )


_EXTRACT = """substr(comment_body, instr(comment_body, '(') + 1,
  greatest(instr(comment_body, ')') - instr(comment_body, '(') - 1, 0))"""


@query(
    "comments",
    f"select ord, {_EXTRACT} as out from comments where regexp_matches(comment_body, '^\\[.+\\]\\(.+\\)')",
)
def extract_markdown_link(t):
    return t["comments"].where(fx.has_markdown_link(_body())).select(
        "ord", fx.extract_markdown_link(_body()).alias("out")
    )


_COMMENT_CTE = f"""
links as (
  select ord, cast(null as varchar) as name, post_fullname as post_id, {_EXTRACT} as link
  from comments where parent_fullname = post_fullname
    and regexp_matches(comment_body, '^\\[.+\\]\\(.+\\)')
), {_TYPED_CTE}"""


@query(
    "comments posts",
    "select link_type, link, post_id from owned where post_id in (select post_id from posts)",
    _COMMENT_CTE,
)
def comment_links(t):
    return ln.comment_links(t["comments"], t["posts"])


@query(
    "comments posts",
    """select ord, link, post_id from links where post_id in (select post_id from posts)""",
    _COMMENT_CTE,
)
def comments_with_post(t):
    rows = ln.comment_link_rows(t["comments"])
    return ln.comments_with_post(rows, t["posts"]).select("ord", "link", "post_id")


@query(
    "comments posts",
    """select link, concat(post_id, '_', row_number() over (partition by post_id order by link_type, link))
         as file_stem
       from owned where post_id in (select post_id from posts)""",
    _COMMENT_CTE,
)
def comment_file_names(t):
    classified = ln.comment_links(t["comments"], t["posts"])
    return ln.comment_file_names(classified).select("link", "file_stem")


_JSON_CTE = """
items as (
  select page_id, main_key, post_id,
    regexp_extract(html, '(?s)item:(.*?)\\};', 1) as item from albums
),
json_lists as (
  select page_id, main_key, post_id,
    case when json_exists(item, '$.album_images') then
      list_zip(json_extract_string(item, '$.album_images.images[*].hash'),
               json_extract_string(item, '$.album_images.images[*].ext'))
    else list_zip([json_extract_string(item, '$.hash')], [json_extract_string(item, '$.ext')]) end as l
  from items
),
numbered as (
  select page_id, main_key, post_id, unnest(l) as image, unnest(range(1, len(l) + 1)) as position
  from json_lists
),
images as (
  select page_id, main_key, post_id, position, image[1] as hash, string_split(image[2], '?')[1] as ext
  from numbered
)"""


@query(
    "album_pages",
    """select page_id, main_key, case page_id % 5 when 0 then 'no text' when 1 then 'no item'
         when 2 then 'item doesn''t parse' else 'no images' end as reason
       from album_pages where page_id % 5 < 4""",
)
def album_failures(t):
    return al.album_failures(t["album_pages"])


@query("albums", "select * from images", _JSON_CTE)
def album_images(t):
    return al.album_images(t["albums"], "json")


@query(
    "albums",
    """select page_id, main_key, position - dropped as position, hash, ext from (
         select *, case when first_hash = main_key and n > 1 then 1 else 0 end as dropped from (
           select page_id, main_key, hash, ext, position,
             count(*) over (partition by page_id) as n,
             first_value(hash) over (partition by page_id order by position) as first_hash
           from (
             select page_id, main_key, unnest(h) as hash, unnest(e) as ext, unnest(range(1, len(h) + 1)) as position
             from (select page_id, main_key,
                     regexp_extract_all(part, '"hash":"([a-zA-Z0-9]+)".*?"ext":"(\\.[a-zA-Z0-9]+)"', 1) as h,
                     regexp_extract_all(part, '"hash":"([a-zA-Z0-9]+)".*?"ext":"(\\.[a-zA-Z0-9]+)"', 2) as e
                   from (select page_id, main_key, case when contains(item, '"count"')
                           then regexp_extract(item, '(?s)"images".*?\\]') else item end as part
                         from (select page_id, main_key, regexp_extract(html, '(?s)item:.*?\\};') as item
                               from albums) a) b) c) d) e) f
       where position > dropped""",
)
def album_images_regex(t):
    return al.album_images(t["albums"], "regex").select("page_id", "main_key", "position", "hash", "ext")


@query(
    "albums",
    """select page_id, position, concat('http://i.imgur.com/', hash, ext) as image_url,
         concat(post_id, ext) as file_name
       from images where ext not like '%gif' and ext not like '%gifv'""",
    _JSON_CTE,
)
def album_download_plan(t):
    return al.download_plan(al.album_images(t["albums"])).select(
        "page_id", "position", "image_url", "file_name"
    )


@query(
    "albums",
    """select post_id, concat(post_id, ext) as file_name, min(position) as position
       from images where ext not like '%gif' group by post_id, ext""",
    _JSON_CTE,
)
def album_download_plan_first(t):
    return al.download_plan(al.album_images(t["albums"]), first_per_ext=True).select(
        "post_id", "file_name", "position"
    )


@query(
    "albums",
    """select page_id, concat(regexp_extract(html, '<title>\\s*(.*) - (?:Album on )*?Imgur', 1),
         ' (', main_key, ')') as title from albums""",
)
def album_title(t):
    return t["albums"].select("page_id", fx.album_title(F.col("html"), F.col("main_key")).alias("title"))


@query(
    "albums",
    """select page_id, case when page_id % 4 = 0 then concat('Ete ', page_id, ' la')
         else concat('T', page_id, ' (', main_key, ')') end as title from albums""",
)
def album_file_title(t):
    given = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("\u00c9t\u00e9: "), "page_id", F.lit("/ l\u00e0")))
    given = F.when(F.col("page_id") % 4 == 1, "").otherwise(given)
    return t["albums"].select(
        "page_id", fx.album_file_title(F.col("html"), F.col("main_key"), given).alias("title")
    )


# the last owner of every link, whatever its class
_FETCH_CTE = """
last as (
  select link, max_by(concat(name, '_', post_id), ord) as own, max(ord) % 8 as kind, min(ord) as ord
  from fetch_links group by link)"""


@query(
    "fetch_links",
    """select case kind when 1 then 'imgur_album' else 'image' end as link_type,
         case when kind = 1 then concat('http://i.imgur.com/k', ord, '.bmp')
              when kind = 4 then concat('http://i.imgur.com/k', ord, '.jpg')
              when kind = 5 then concat(link, '.jpg') else link end as image_url,
         concat(own, case kind when 1 then '.bmp' else '.jpg' end) as file_name
       from last where kind in (0, 1, 4, 5)""",
    _FETCH_CTE,
)
def link_plan(t):
    """What to fetch for links that are images themselves, and under which name."""
    return al.link_plan(ln.classify_links(t["fetch_links"])).select("link_type", "image_url", "file_name")


@query(
    "fetch_links",
    """select link, case kind when 2 then concat('al', ord) else concat('g', ord) end as main_key,
         case kind when 2 then concat('http://imgur.com/a/al', ord, '/all')
           else concat('https://imgur.com/a/g', ord, '/all') end as page_url,
         own as post_id
       from last where kind in (2, 6)""",
    _FETCH_CTE,
)
def links_with_pages(t):
    return al.links_with_pages(ln.classify_links(t["fetch_links"]))


@query(
    "fetch_links",
    "select link, case kind when 3 then 'gif' else 'not an album link' end as reason from last where kind in (3, 7)",
    _FETCH_CTE,
)
def link_failures(t):
    return al.link_failures(ln.classify_links(t["fetch_links"]))


@query("albums", "select ext, count(*) as n from images group by ext order by n desc, ext", _JSON_CTE)
def extension_counts(t):
    return al.extension_counts(al.album_images(t["albums"]))


# the letters of these texts differ from plain ones by accents only
@query(
    "",
    """select doc_id, trim(regexp_replace(strip_accents(text), '[^A-Za-z0-9_\\s\\-.)(]', '', 'g'),
         chr(9) || chr(10) || chr(12) || chr(13) || ' ') as slug from documents""",
)
def slugify(t):
    return t["documents"].select("doc_id", fx.slugify(F.col("text")).alias("slug"))


@query(
    "",
    """select doc_id from documents where text not in (
         select text from documents group by text having count(*) > 1)""",
)
def drop_placeholder(t):
    """Texts stand in for image bytes; a text held by several documents is a placeholder."""
    images = t["documents"].select("doc_id", F.col("text").cast("binary").alias("content"))
    repeated = images.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ln.drop_placeholder(images, repeated).select("doc_id")
