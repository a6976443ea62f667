"""Inputs for checks and benchmarks, derived from the given tables.

Every view has one SQL text for Spark and DuckDB.  A few marks differ between the two:
``{R:x}`` is the 32-bit number of the string x and ``{W:x}`` its 60-bit number,
``{SEQ:n}`` a row for each of 0 to n-1, ``{NUDGED}`` the embedding with a small shift that
depends on row and element, ``{SHIFTED:a}`` with one of size a, and ``{ESC}`` names the escape character of a pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["links"] = """
select event_id as ord, event_type as name, concat('t3_', cast(event_id % 701 as string)) as post_id,
  case event_id % 14
    when 0 then concat('http://i.imgur.com/k', cast(event_id % 97 as string), '.jpg')
    when 1 then concat('http://imgur.com/k', cast(event_id % 97 as string))
    when 2 then concat('http://imgur.com/a/al', cast(event_id % 53 as string))
    when 3 then concat('https://imgur.com/gallery/ga', cast(event_id % 31 as string))
    when 4 then concat('http://imgur.com/r/pics/k', cast(event_id % 97 as string))
    when 5 then concat('http://i.imgur.com/k', cast(event_id % 97 as string), '.gifv')
    when 6 then concat('http://imgur.com/k', cast(event_id % 97 as string), '/')
    when 7 then concat('http://i.reddituploads.com/u', cast(event_id % 41 as string))
    when 8 then concat('http://site', cast(event_id % 17 as string), '.com')
    when 9 then concat('http://cdn.example.org/p', cast(event_id % 61 as string), '.jgp')
    when 10 then concat('http://cdn.example.org/p', cast(event_id % 61 as string), '.PNG')
    when 11 then concat('http://i.imgur.com/k', cast(event_id % 97 as string), '.jpg?1')
    when 12 then null
    else concat('https://www.example.org/article/', cast(event_id % 29 as string)) end as link
from events
"""

# links of which every event brings a new one
VIEWS["fetch_links"] = """
select event_id as ord, event_type as name, concat('t3_', cast(user_id as string)) as post_id,
  case event_id % 8
    when 0 then concat('http://i.imgur.com/k', cast(event_id as string), '.jpg')
    when 1 then concat('http://imgur.com/r/k', cast(event_id as string), '.bmp')
    when 2 then concat('http://imgur.com/a/al', cast(event_id as string))
    when 3 then concat('http://imgur.com/gallery/g', cast(event_id as string), '.gif')
    when 4 then concat('http://imgur.com/k', cast(event_id as string))
    when 5 then concat('http://i.reddituploads.com/u', cast(event_id % 41 as string))
    when 6 then concat('https://imgur.com/gallery/g', cast(event_id as string), '/new')
    else concat('http://share.example.org/imgur/a/x', cast(event_id as string)) end as link
from events
"""

VIEWS["comments"] = """
select event_id as ord, concat('t3_', cast(event_id % 701 as string)) as post_fullname,
  case when event_id % 5 = 0 then concat('t1_', cast(event_id as string))
       else concat('t3_', cast(event_id % 701 as string)) end as parent_fullname,
  case event_id % 8
    when 0 then concat('[edit](http://i.imgur.com/c', cast(event_id % 89 as string), '.png)')
    when 1 then concat('[a (b) c](http://i.imgur.com/c', cast(event_id % 89 as string), '.png)')
    when 2 then concat('[a) b](http://i.imgur.com/c', cast(event_id % 89 as string), '.png)')
    when 3 then concat('see [edit](http://i.imgur.com/c', cast(event_id % 89 as string), '.png)')
    when 4 then concat('[x](http://imgur.com/a/al', cast(event_id % 53 as string), ') thanks')
    when 5 then concat('[x](http://u.example.org/w_(', cast(event_id % 7 as string), ').jpg)')
    when 6 then null
    else concat('[x](http://imgur.com/c', cast(event_id % 89 as string), ')') end as comment_body
from events
"""

# posts that were fetched: those of one event type
VIEWS["posts"] = """
select distinct concat('t3_', cast(event_id % 701 as string)) as post_id
from events where event_type = (select min(event_type) from events)
"""

# children look like the first file of their post
VIEWS["assets"] = """
select vec_id, concat('t3_p', cast(post as string)) as post_id,
  {SHIFTED:k / 60} as embedding,
  case when vec_id % 4 = 0 and post % 7 <> 3 then concat('t3_p', cast(post as string), '.jpg')
       else concat('t3_p', cast(post as string), '_', cast(1000 + k as string),
                   case when vec_id % 13 = 0 then '.png' else '.jpg' end) end as filename
from (
  select e.vec_id, f.embedding, cast(floor(e.vec_id / 4) as bigint) as post, e.vec_id % 4 as k
  from embeddings e join embeddings f on f.vec_id = e.vec_id - e.vec_id % 4) s
where not (post % 11 = 5 and k > 0)
"""

# some twenty drawn candidates for every vector, met by equality
VIEWS["pairs"] = """
select query_id, cand_id,
  case when draw % 10 = 0 then cast(1.0 as double)
       when draw % 10 = 1 then cast(0.5 as double) else cast(0.0 as double) end as label,
  {R:concat('score-', cast(query_id as string), '-', cast(cand_id as string))} % 200
    / cast(200 as double) as score
from (
  select query_id, cand_id,
    {R:concat('rel-', cast(query_id as string), '-', cast(cand_id as string))} as draw
  from (
    select distinct d.query_id, c.vec_id as cand_id
    from (
      select query_id, {R:concat('pair-', cast(query_id as string), '-', cast(k as string))}
          % (select max(vec_id) + 1 from embeddings) as drawn
      from (select vec_id as query_id, {SEQ:20} as k from embeddings) s
    ) d join embeddings c on c.vec_id = d.drawn
  ) p where query_id <> cand_id
) r
"""

# child files next to parents whose post number starts the child's own, or is drawn
VIEWS["name_pairs"] = """
select distinct c.vec_id as query_id, p.vec_id as cand_id, c.filename as query_name,
  concat(c.post_id, '') as query_stem, p.post_id as cand_stem
from (
  select vec_id, filename, post_id,
    case when k < 3 then substr(post_id, 1, 5 + k)
         else concat('t3_p', cast({R:concat('np-', cast(vec_id as string), '-', cast(k as string))} % 97 as string))
    end as other
  from (select vec_id, filename, post_id, {SEQ:6} as k from assets where filename like '%\\_%\\_%' {ESC}) s
) c join (select vec_id, post_id from assets where filename not like '%\\_%\\_%' {ESC}) p on p.post_id = c.other
"""

VIEWS["albums"] = """
select page_id, concat('al', cast(page_id as string)) as main_key, concat('t3_', cast(page_id as string)) as post_id,
  case when page_id % 3 = 0
       then concat('<title>T', cast(page_id as string), ' - Imgur</title> item: {"hash":"h', cast(page_id as string), '","ext":".jpg?1"} };')
       else concat('<title>T', cast(page_id as string), ' - Album on Imgur</title> item: {"album_images":{"count":3,"images":[{"hash":"',
            case when page_id % 2 = 0 then concat('al', cast(page_id as string)) else 'first' end, '","ext":".jpg"},{"hash":"b',
            cast(page_id as string), '","ext":".png"},{"hash":"c', cast(page_id as string), '","ext":".gif"}]}} };') end as html
from pages
"""

# pages of which only every fifth lists an image
VIEWS["album_pages"] = """
select page_id, main_key, case page_id % 5
    when 0 then null
    when 1 then replace(html, 'item:', 'entry:')
    when 2 then concat('item: {"hash":"h', cast(page_id as string), '", };')
    when 3 then 'item: {"album_images":{"count":0,"images":[]}} };'
    else html end as html
from albums
"""

VIEWS["splices"] = """
select vec_id, embedding, concat('Tp_D_CND_M_N_ani0', cast(100 + vec_id % 37 as string), '_sec0', cast(100 + vec_id % 41 as string), '_0', cast(vec_id as string), '.tif') as sp_name
from embeddings
"""

VIEWS["originals"] = """
select vec_id, au_name, embedding from (
  select vec_id, au_name, embedding, min(vec_id) over (partition by au_name) as kept from (
    select vec_id, embedding,
      case when vec_id % 2 = 0 then concat('Au_ani_0', cast(100 + vec_id % 37 as string), '.jpg')
           else concat('Au_sec_0', cast(100 + vec_id % 41 as string), '.jpg') end as au_name
    from embeddings) a) b
where vec_id = kept
"""

VIEWS["qvec"] = """
select vec_id, {NUDGED} as embedding from embeddings
"""

# views that read other views
_USES = {"name_pairs": ["assets"], "album_pages": ["albums"]}

_SPARK_MARKS = {
    "R": "cast(conv(substring(md5({x}),1,8),16,10) as bigint)",
    "W": "cast(conv(substring(md5({x}),1,15),16,10) as bigint)",
    "SEQ": "explode(sequence(0, {x} - 1))",
    "NUDGED": "transform(embedding, (x, i) -> cast(x as double) + 0.05D * (((vec_id * 31 + i * 17) % 11) - 5) / 5.0D)",
    "SHIFTED": "transform(embedding, (x, i) -> cast(x as double) + ({x}) * (((vec_id * 31 + i * 17) % 11) - 5) / 5.0D)",
    "ESC": "",
}
_DUCKDB_MARKS = {
    "R": "cast(('0x' || substr(md5({x}),1,8)) as bigint)",
    "W": "cast(('0x' || substr(md5({x}),1,15)) as bigint)",
    "SEQ": "unnest(range(0, {x}))",
    "NUDGED": "list_transform(embedding, lambda x, i: cast(x as double) + 0.05::double * (((vec_id * 31 + (i - 1) * 17) % 11) - 5) / 5.0::double)",
    "SHIFTED": "list_transform(embedding, lambda x, i: cast(x as double) + ({x}) * (((vec_id * 31 + (i - 1) * 17) % 11) - 5) / 5.0::double)",
    "ESC": "escape '\\'",
}


def render(text: str, marks: dict[str, str]) -> str:
    """SQL with its marks replaced for one engine."""
    out = []
    at = 0
    for found in re.finditer(r"\{(R|W|SEQ|NUDGED|SHIFTED|ESC)(:)?", text):
        if found.start() < at:
            continue
        depth, end = 1, found.end()
        while depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        argument = text[found.end() : end - 1]
        out.append(text[at : found.start()])
        out.append(marks[found.group(1)].replace("{x}", argument))
        at = end
    return "".join(out) + text[at:]


def duckdb_sql(text: str) -> str:
    return render(text, _DUCKDB_MARKS)


def view_sql(*names: str) -> str:
    """``with`` clause that defines the given views for DuckDB."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_USES.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    return ",\n".join(f"{name} as ({duckdb_sql(VIEWS[name])})" for name in ordered)


# given schemas save a look into the files
_SCHEMAS = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    if name in BASE_TABLES:
        reader = spark.read
        if name in _SCHEMAS:
            reader = reader.schema(_SCHEMAS[name])
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    text = render(VIEWS[name], _SPARK_MARKS)
    for other in [*_USES.get(name, []), *BASE_TABLES]:
        if re.search(rf"\b(?:from|join) {other}\b", text):
            view = f"pairmatch_{other}"
            table(spark, sf_dir, other).createOrReplaceTempView(view)
            text = re.sub(rf"\b(from|join) {other}\b", rf"\1 {view}", text)
    return spark.sql(text)
