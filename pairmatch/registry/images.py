"""Image queries on small pictures drawn from the vectors."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pairmatch.lineage import scratch_path
from pairmatch.operators import images as im
from pairmatch.registry.base import register

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


def _pictures(t):
    """8 x 8 pictures of all elements: three channels, the elements and two shifted copies of them, or one for every seventh.

    The bytes of every eleventh picture are cut short.
    """
    byte = F.transform("embedding", lambda x: F.floor(F.abs(x) * 1000).cast("int") % 256)
    three = F.flatten(F.transform(byte, lambda x, i: F.array(x, F.get(byte, (i + 1) % 64), F.get(byte, (i + 2) % 64))))
    channels = F.when(F.col("vec_id") % 7 == 3, 1).otherwise(3)
    shown = F.when(channels == 3, three).otherwise(byte)
    shown = F.when(F.col("vec_id") % 11 == 5, F.slice(shown, 1, 10)).otherwise(shown)
    data = F.unhex(F.array_join(F.transform(shown, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return t["embeddings"].select(
        F.col("vec_id").cast("string").alias("origin"),
        F.struct(
            F.col("vec_id").cast("string").alias("origin"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            channels.alias("nChannels"),
            F.when(channels == 3, 16).otherwise(0).alias("mode"),
            data.alias("data"),
        ).alias("image"),
    )


_PIXEL_CTE = """
pixel as (
  select vec_id, i // 8 as y, i % 8 as x, c,
    cast(floor(abs(embedding[(i + c) % 64 + 1]::float) * 1000::float) as int) % 256 as v
  from embeddings, (select unnest(range(0, 64)) as i) s, (select unnest(range(0, 3)) as c) r
  where vec_id % 7 <> 3 and vec_id % 11 <> 5)"""


@query("", "select cast(vec_id as varchar) as origin from embeddings where vec_id % 7 <> 3")
def filter_channels(t):
    return im.filter_channels(_pictures(t)).select("origin")


@query(
    "",
    """select cast(vec_id as varchar) as origin, y, x, c, round(avg(v), 4) as v from (
         select vec_id, y // 4 as y, x // 4 as x, c, v from pixel) p group by vec_id, y, x, c""",
    _PIXEL_CTE,
)
def prepare_images(t):
    prepared = im.prepare_images(_pictures(t), 2)
    return prepared.select("origin", F.posexplode("pixels").alias("i", "v")).select(
        "origin",
        F.floor(F.col("i") / 6).alias("y"),
        F.floor(F.col("i") / 3 % 2).alias("x"),
        (F.col("i") % 3).alias("c"),
        F.round(F.col("v").cast("double"), 4).alias("v"),
    )


@query(
    "",
    """select cast(vec_id as varchar) as origin, y * 12 + x * 3 + c as i, round(avg(v), 6) as v from (
         select vec_id, y // 2 as y, x // 2 as x, c, v from pixel) p group by vec_id, y, x, c""",
    _PIXEL_CTE,
)
def extract_features(t):
    found = im.extract_features(im.filter_channels(_pictures(t)))
    return found.select("origin", F.posexplode("vec").alias("i", "v")).withColumn(
        "v", F.round(F.col("v").cast("double"), 6)
    )


@query(
    "",
    """select cast(vec_id as varchar) as origin, y * 12 + x * 3 + c as i,
         round(avg(v) - case c when 0 then 103.939 when 1 then 116.779 else 123.68 end, 3)::double as v from (
         select vec_id, y // 2 as y, x // 2 as x, c, v from pixel) p group by vec_id, y, x, c""",
    _PIXEL_CTE,
)
def center_channels(t):
    found = im.extract_features(im.filter_channels(_pictures(t)))
    centered = found.select("origin", im.center_channels(F.col("vec").cast("array<double>")).alias("vec"))
    return centered.select("origin", F.posexplode("vec").alias("i", "v")).withColumn(
        "v", F.round("v", 3)
    )


@query(
    "",
    """select cast(vec_id as varchar) as origin, y * 9 + x * 3 + c as i, round(sum(v * rows * columns) * 9 / 64 + 0.0001, 2) as v from (
         select vec_id, p.y as py, p.x as px, c, v, ty.k as y, tx.k as x,
           least(p.y + 1, (ty.k + 1) * 8.0::double / 3) - greatest(p.y, ty.k * 8.0::double / 3) as rows,
           least(p.x + 1, (tx.k + 1) * 8.0::double / 3) - greatest(p.x, tx.k * 8.0::double / 3) as columns
         from pixel p, (select unnest(range(0, 3)) as k) ty, (select unnest(range(0, 3)) as k) tx) a
       where rows > 0 and columns > 0 group by vec_id, y, x, c""",
    _PIXEL_CTE,
)
def prepare_images_uneven(t):
    """A size that doesn't divide the picture's: pixels count by the area they share."""
    prepared = im.prepare_images(_pictures(t), 3)
    return prepared.select("origin", F.posexplode("pixels").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double") + 0.0001, 2))


@query(
    "",
    """select cast(vec_id as varchar) as origin, true as failed from embeddings where vec_id % 7 <> 3 and vec_id % 11 = 5""",
)
def image_failures(t):
    failures = im.image_failures(im.filter_channels(_pictures(t)))
    return failures.select("origin", (F.length("error") > 0).alias("failed"))


@query("", "select count(*) as n from embeddings where vec_id % 7 <> 3 and vec_id % 11 <> 5")
def count_done(t):
    """How many pictures came through the preparation."""
    return im.prepare_images(_pictures(t), 2).agg(F.count(F.lit(1)).alias("n"))


@query(
    "",
    """select count(*) filter (where vec_id % 11 <> 5) as kept, count(*) filter (where vec_id % 11 = 5) as failed,
         count(*) filter (where vec_id % 11 <> 5) as stored from embeddings where vec_id % 7 <> 3""",
)
def write_prepared(t):
    """Pictures kept and failed, counted while they are written, and what is in the files."""
    path = scratch_path(t.spark, "prepared")
    counts = im.write_prepared(_pictures(t), path, 2)
    return t.spark.read.parquet(path).agg(
        F.lit(counts["kept"]).alias("kept"), F.lit(counts["failed"]).alias("failed"), F.count(F.lit(1)).alias("stored")
    )
