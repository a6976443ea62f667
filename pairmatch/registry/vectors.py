"""Queries on vectors: hashing, candidate search and the whole retrieval.

The SQL does the hash from scratch, including the inverse square root of the kernel, which
it finds by Newton-Schulz iteration instead of an eigendecomposition.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmatch.functions import vectors as fv
from pairmatch.functions.bands import BandLayout, split_bands
from pairmatch.lineage import scratch_path
from pairmatch.operators import assets as at
from pairmatch.operators import candidates as cd
from pairmatch.operators import klsh as kl
from pairmatch.operators import lsh as ls
from pairmatch.operators import metrics as mt
from pairmatch.operators import pairs as pr
from pairmatch.operators import prefixes as px
from pairmatch.operators import scoring as sc
from pairmatch.operators.ordering import rank_within
from pairmatch.plans.baseline import lsh_baseline
from pairmatch.plans.retrieve import retrieve as run_retrieval
from pairmatch.registry.assets import NEWTON_CTE, segment_sums, trained_scorer
from pairmatch.registry.base import register
from pairmatch.sources import store
from pairmatch.streaming.probe import probe_index as probe_stored
from pairmatch.streaming.probe import read_probes, start_probe_sink

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)

P, T, B, R, SEED = 32, 8, 32, 8, 1

_IDX = "idx as (select vec_id as id, embedding as vec from embeddings)"
_QRY = "qry as (select vec_id as id, embedding as vec from qvec)"


def _klsh_cte(p=P, t=T, b=B, seed=SEED, sources=f"{_IDX}, {_QRY}", rounds=16):
    square = "power(list_distance({0}, {1}), 2)"

    def columns(m):
        return f"list_transform(range(1, {p} + 1), lambda j: list_transform({m}, lambda r: r[j]))"

    def product(x, y_columns):
        return f"list_transform({x}, lambda u: list_transform({y_columns}, lambda v: list_dot_product(u, v)))"

    def hashed(name, source):
        return f"""{name} as (
          select id, list_transform(ws, lambda w: case when list_dot_product(kc, w) > 0 then 1 else 0 end) as bits
          from (select id, ws, list_transform(kx, lambda v, i: v - ms[i] - km + g) as kc
                from (select *, list_avg(kx) as km
                      from (select id, ws, ms, g, list_transform(ss,
                              lambda s: exp(-{square.format('x', 's')} / 64.0::double)) as kx
                            from (select id, list_transform(vec, lambda v: v::double) as x from {source}) v,
                              weights, centers, grand) a) b) c)"""

    return f"""{sources},
samp as (
  select i, s from (
    select row_number() over (order by md5(concat('{seed}-', id)), id) - 1 as i,
      list_transform(vec, lambda v: v::double) as s from idx) x where i < {p}),
kern as (
  select a.i, b.i as j, exp(-{square.format('a.s', 'b.s')} / 64.0::double) as k from samp a, samp b),
means as (select i, avg(k) as m from kern group by i),
grand as (select avg(k) as g from kern),
centered as (
  select kern.i, kern.j, k - a.m - b.m + g as k
  from kern join means a on kern.i = a.i join means b on kern.j = b.i, grand),
scale as (select sqrt(sum(k * k)) as size from centered),
start as (
  select list(r order by i) as a,
    list_transform(range(0, {p}), lambda i: list_transform(range(0, {p}),
      lambda j: case when i = j then 1.0::double else 0.0::double end)) as one
  from (select i, list(k / size + 1.0::double / {p} order by j) as r from centered, scale group by i) x),
steps(n, y, z) as (
  select 0, a, one from start
  union all
  select n + 1, {product('y', 'hc')}, {product('h', 'zc')} from (
    select n, y, h, zc, {columns('h')} as hc from (
      select n, y, zc, list_transform({product('z', 'yc')}, lambda r, i: list_transform(r,
        lambda v, j: 0.5 * ((case when i = j then 3.0::double else 0.0::double end) - v))) as h
      from (select n, y, z, {columns('y')} as yc, {columns('z')} as zc from steps where n < {rounds}) x) x) x),
root as (
  select i, z[i + 1] as r from steps, (select unnest(range(0, {p})) as i) where n = {rounds}),
picks as (
  select distinct bit, {{R:concat('{seed}-pick-', cast(bit as string), '-', cast(k as string))}} % {p} as pick
  from (select unnest(range(0, {b})) as bit) b, (select unnest(range(0, {t})) as k) k),
weight as (
  select bit, i, sum((r[pick + 1] - 1.0::double / {p}) / sqrt(size)) as w from picks, root, scale group by bit, i),
weights as (
  select list(w order by bit) as ws from (
    select bit, list(w order by i) as w from weight group by bit) x),
centers as (select list(s order by samp.i) as ss, list(m order by samp.i) as ms from samp join means on samp.i = means.i),
{hashed('hidx', 'idx')},
{hashed('hqry', 'qry')}"""


def _bands_cte(bands=B // R, width=R):
    def cut(name, source):
        return f"""{name} as (
          select id, band, array_to_string(list_slice(bits, band * {width} + 1, (band + 1) * {width}), '') as key
          from {source}, (select unnest(range(0, {bands})) as band) b)"""

    return f"""{cut('bidx', 'hidx')}, {cut('bqry', 'hqry')},
cand as (
  select distinct q.id as query_id, c.id as cand_id
  from bqry q join bidx c on q.band = c.band and q.key = c.key)"""


_KLSH = _klsh_cte()
_CAND = f"{_KLSH}, {_bands_cte()}"


def _index(t):
    return t["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _queries(t):
    return t["qvec"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _truth(t):
    return t["qvec"].select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("truth_id"))


def _model(t):
    return kl.KLSH(P, T, B, SEED).fit(_index(t))


def _signed(t, rows=R):
    model = _model(t)
    layout = model.layout(rows)
    return model.signatures(_index(t), layout), model.signatures(_queries(t), layout), layout


@query(
    "",
    """select vec_id as id from embeddings order by md5(concat('3-', vec_id)), vec_id limit 100""",
)
def sample_rows(t):
    return kl.sample_rows(_index(t), "id", 100, seed=3).select("id")


_KERNEL_CTE = f"""{_KLSH},
kernels as (
  select id, unnest(kx) as raw, unnest(list_transform(kx, lambda v, i: v - ms[i] - km + g)) as centered,
    unnest(range(0, {P})) as i
  from (select *, list_avg(kx) as km
        from (select id, ms, g, list_transform(ss, lambda s: exp(-power(list_distance(x, s), 2) / 64.0::double)) as kx
              from (select id, list_transform(vec, lambda v: v::double) as x from idx) v, centers, grand) a) b)"""


@query("qvec", "select id, i, round(raw, 6) as k from kernels", _KERNEL_CTE)
def rbf_kernel(t):
    rows = _model(t).kernel_rows(_index(t), centered=False)
    return rows.select("id", F.posexplode_outer("kernel").alias("i", "k")).withColumn("k", F.round("k", 6))


@query("qvec", "select id, i, round(centered, 6) as k from kernels", _KERNEL_CTE)
def center_kernel(t):
    rows = _model(t).kernel_rows(_index(t))
    return rows.select("id", F.posexplode_outer("kernel").alias("i", "k")).withColumn("k", F.round("k", 6))


@query("qvec", "select i, round(m, 9) as column_mean, round(g, 9) as grand_mean from means, grand", _KLSH)
def kernel_means(t):
    sample = kl.sample_rows(_index(t), "id", P, SEED)
    kernel = _model(t).kernel_rows(sample, centered=False).select(F.posexplode_outer("kernel").alias("i", "k"))
    columns = kernel.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.avg("k").alias("m"))
    # P rows; columns are equally long, so the mean of their means is the grand mean
    grand = F.avg("m").over(Window.partitionBy(F.lit(0)))
    return columns.select("i", F.round("m", 9).alias("column_mean"), F.round(grand, 9).alias("grand_mean"))


@query("qvec", "select bit, i, round(w, 6) as w from weight", _KLSH)
def klsh_fit(t):
    model = _model(t)
    rows = [(bit, i, float(model.weights[i, bit])) for bit in range(B) for i in range(P)]
    return t.spark.createDataFrame(rows, "bit long, i long, w double").withColumn("w", F.round("w", 6))


@query("qvec", "select id, array_to_string(bits, '') as bits from hidx", _KLSH)
def klsh_hash(t):
    hashed = _model(t).transform(_index(t))
    return hashed.select("id", F.array_join("bits", "").alias("bits"))


@query("qvec", "select id, band, key from bidx", _CAND)
def band_split(t):
    model = _model(t)
    bands = split_bands(F.col("bits"), model.layout(R))
    return model.transform(_index(t)).select("id", F.posexplode(bands).alias("band", "key"))


@query(
    "qvec",
    f"""select band, key, count(*) as n from (
          select id, band, list_sum(list_transform(list_slice(bits, band * {R} + 1, (band + 1) * {R}),
            lambda v, i: v * (1 << (i - 1)))) as key
          from hidx, (select unnest(range(0, {B // R})) as band) b) x group by band, key""",
    _KLSH,
)
def build_buckets(t):
    index, _, layout = _signed(t)
    return cd.bucket_sizes(index, layout)


@query("qvec", "select query_id, cand_id from cand", _CAND)
def band_candidates(t):
    index, queries, layout = _signed(t)
    return cd.band_candidates(index, queries, layout)


BUCKET_TARGET = 4
_SPLIT_CTE = f"""{_KLSH},
texts as (select id, array_to_string(bits, '') as s from hidx),
asked as (select id, array_to_string(bits, '') as s from hqry),
starts as (
  select band, depth from (select unnest(range(0, {B // R})) as band) b, (select unnest(range({R}, {B} + 1)) as depth) d),
prefixes as (
  select s, band, depth, substr(s || s, band * {R} + 1, depth) as prefix
  from (select distinct s from texts) t, starts),
sizes as (select band, depth, prefix, count(*) as n from prefixes group by band, depth, prefix),
leaves as (
  select s, band, min(depth) as depth from prefixes join sizes using (band, depth, prefix)
  where n <= {BUCKET_TARGET} group by s, band),
placed_ids as (
  select id, band, depth, substr(s || s, band * {R} + 1, depth) as prefix, s from texts join leaves using (s))"""


@query(
    "qvec",
    """select band, depth, prefix, count(*) as n, count(distinct s) as n_signatures
       from placed_ids group by band, depth, prefix""",
    _SPLIT_CTE,
)
def split_buckets(t):
    index, _, layout = _signed(t)
    return px.split_bucket_sizes(index, layout, BUCKET_TARGET)


@query(
    "qvec",
    f"""select distinct q.id as query_id, c.id as cand_id
        from placed_ids c join asked q on substr(q.s || q.s, band * {R} + 1, depth) = prefix""",
    _SPLIT_CTE,
)
def split_band_candidates(t):
    index, queries, layout = _signed(t)
    return px.split_candidates(index, queries, layout, BUCKET_TARGET)


@query("qvec", "select query_id, count(*) as n from cand group by query_id", _CAND)
def union_candidates(t):
    counts = _retrieval(t).counts()
    return counts.where("n_candidates > 0").select("query_id", F.col("n_candidates").alias("n"))


@query("qvec", "select query_id, cand_id from cand", _CAND)
def probe_index(t):
    model = _model(t)
    layout = model.layout(R)
    path = scratch_path(t.spark, "bands")
    store.write_band_index(model.signatures(_index(t), layout), layout, path, model)
    return probe_stored(
        model.signatures(_queries(t), layout), store.load_band_index(t.spark, path), layout, model
    )


@query("qvec", "select query_id, cand_id from cand", _CAND)
def probe_stream(t):
    model = _model(t)
    layout = model.layout(R)
    path = scratch_path(t.spark, "probes")
    store.write_band_index(model.signatures(_index(t), layout), layout, f"{path}/bands", model)
    _queries(t).repartition(4).write.parquet(f"{path}/queries")
    stored = store.load_band_index(t.spark, f"{path}/bands")
    arriving = t.spark.readStream.schema(_queries(t).schema).option("maxFilesPerTrigger", 2)
    found = probe_stored(model.signatures(arriving.parquet(f"{path}/queries"), layout), stored, layout, model)
    # the second run goes on from the checkpoint of the first and adds nothing
    for _ in range(2):
        start_probe_sink(found, f"{path}/found", f"{path}/checkpoint").awaitTermination()
    return read_probes(t.spark, f"{path}/found").select("query_id", "cand_id")


_STATS_CTE = f"""{_CAND},
counts as (
  select q.id as query_id, count(c.cand_id) as n, count(*) filter (where c.cand_id = q.id) as hits
  from qry q left join cand c on c.query_id = q.id group by q.id)"""
_STATS = """round(100.0::double * count(*) filter (where n > 0) / count(*), 6) as pct_with_candidates,
  round(avg(case when n > 0 then n end), 6) as mean_candidates"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query(
    "qvec",
    f"select {_STATS}, round(100.0::double * count(*) filter (where hits > 0) / count(*), 6) as pct_found from counts",
    _STATS_CTE,
)
def retrieval_stats_pc(t):
    return _rounded(_retrieval(t).stats())


@query("qvec", f"select {_STATS} from counts", _STATS_CTE)
def retrieval_stats_unlabelled(t):
    return _rounded(mt.retrieval_stats(_retrieval(t).counts(), None))


def _retrieval_cp(t):
    """Parents look for their children, which are told by their stems."""
    children, parents = at.build_retrieval_sets(t["assets"], "cp")
    truth = pr.related_pairs(parents, children)
    return run_retrieval(children, parents, truth, P, T, B, R, SEED)


_ASSET_SOURCES = """
numbered as (
  select *, row_number() over (partition by post_id order by filename) as rn,
    count(*) over (partition by post_id) as files, min(filename) over (partition by post_id) as first_name
  from assets),
roles as (
  select * from numbered where files > 1 and length(first_name) - length(replace(first_name, '_', '')) <= 1),
idx as (select vec_id as id, embedding as vec, regexp_replace(filename, '_[^_]*$', '') as stem from roles where rn > 1),
qry as (select vec_id as id, embedding as vec, filename as name from roles where rn = 1)"""


@query(
    "assets",
    f"""select round(100.0::double * count(distinct c.query_id) / (select count(*) from qry), 6) as pct_with_candidates,
          round(count(*)::double / count(distinct c.query_id), 6) as mean_candidates,
          round(100.0::double * count(*) filter (where contains(q.name, i.stem)) / (select count(*) from idx), 6) as pct_found
        from cand c join qry q on c.query_id = q.id join idx i on c.cand_id = i.id""",
    f"{_klsh_cte(sources=_ASSET_SOURCES)}, {_bands_cte()}",
)
def retrieval_stats_cp(t):
    return _rounded(_retrieval_cp(t).stats("cp"))


# the search by sorted bits needs equal signatures, so it gets a short hash
PERM_BITS, N_PERM = 8, 4
_PERM_CTE = f"""{_klsh_cte(b=PERM_BITS)},
perms as (
  select perm, list(i order by md5(concat('2-', perm, '-', i)), i) as ix
  from (select unnest(range(0, {N_PERM})) as perm) p, (select unnest(range(0, {PERM_BITS})) as i) b
  group by perm),
placed as (
  select perm, id, key, row_number() over (partition by perm order by key, id) as pos
  from (select perm, id, array_to_string(list_transform(ix, lambda i: bits[i + 1]), '') as key from hidx, perms) x),
wanted as (
  select perm, id, array_to_string(list_transform(ix, lambda i: bits[i + 1]), '') as key from hqry, perms),
windows as (
  select w.perm, w.id as query_id, min(p.pos) as first
  from wanted w join placed p on w.perm = p.perm and w.key = p.key group by w.perm, w.id)"""


@query(
    "qvec",
    f"""select distinct query_id, p.id as cand_id from windows w join placed p
          on w.perm = p.perm and p.pos >= first - {2 * N_PERM} and p.pos < first + {2 * N_PERM}""",
    _PERM_CTE,
)
def permutation_candidates(t):
    model = kl.KLSH(P, T, PERM_BITS, SEED).fit(_index(t))
    layout = model.layout(PERM_BITS)
    return cd.permutation_candidates(
        model.signatures(_index(t), layout), model.signatures(_queries(t), layout),
        layout, N_PERM, seed=2,
    )


@query("qvec", "select perm, id, key as permuted from placed", _PERM_CTE)
def permute_bits(t):
    hashed = kl.KLSH(P, T, PERM_BITS, SEED).fit(_index(t)).transform(_index(t))
    orders = cd.permutations(PERM_BITS, N_PERM, 2)
    permuted = F.array(
        *[F.array_join(fv.permute_bits(F.col("bits"), order), "") for order in orders]
    )
    return hashed.select("id", F.posexplode(permuted).alias("perm", "permuted"))


@query("qvec", "select perm, id, pos - 1 as place from placed", _PERM_CTE)
def sort_by_bits(t):
    model = kl.KLSH(P, T, PERM_BITS, SEED).fit(_index(t))
    layout = model.layout(PERM_BITS)
    keys = cd.sort_keys(model.signatures(_index(t), layout), layout, N_PERM, 2)
    return rank_within(keys.select("perm", "key", "id"), ["perm"], ["key", "id"], "pos").select(
        "perm", "id", (F.col("pos") - 1).alias("place")
    )


LSH_BITS, LSH_SEED = 10, 11
_LSH_CTE = f"""
planes as (
  select bit, list(w order by j) as w from (
    select bit, j,
      sqrt(-2.0::double * ln(({{R:concat('{LSH_SEED}-', cast(bit as string), '-', cast(j as string), '-u')}} + 1) / 4294967297.0::double))
      * cos(2.0::double * pi() * {{R:concat('{LSH_SEED}-', cast(bit as string), '-', cast(j as string), '-v')}} / 4294967296.0::double) as w
    from (select unnest(range(0, {LSH_BITS})) as bit) b, (select unnest(range(0, 64)) as j) d) x group by bit),
codes as (
  select side, id, list(case when list_dot_product(x, w) > 0 then 1 else 0 end order by bit) as code
  from (select 'c' as side, vec_id as id, list_transform(embedding, lambda v: v::double) as x from embeddings
        union all select 'q', vec_id, list_transform(embedding, lambda v: v::double) from qvec) v, planes
  group by side, id),
measured as (
  select q.id as query_id, c.id as cand_id,
    list_sum(list_transform(list_zip(q.code, c.code), lambda p: abs(p[1] - p[2]))) as apart,
    list_sum(list_transform(range(1, 65), lambda i:
      (qv.embedding[i]::double - cv.embedding[i]::double) * (qv.embedding[i]::double - cv.embedding[i]::double))) as distance
  from codes q join codes c on q.side = 'q' and c.side = 'c'
    join qvec qv on qv.vec_id = q.id join embeddings cv on cv.vec_id = c.id),
nearest as (
  select * from (
    select *, row_number() over (partition by query_id order by distance, cand_id) as rank
    from measured where apart <= {{RADIUS}}) x where rank <= 5)"""


def _lsh_cte(radius):
    return _LSH_CTE.replace("{RADIUS}", str(radius))


def _lsh_model():
    return ls.random_projection_lsh(LSH_BITS, 64, LSH_SEED)


@query(
    "qvec",
    "select id, array_to_string(code, '') as bits from codes where side = 'c'",
    _lsh_cte(0),
)
def random_projection_lsh(t):
    return _lsh_model().transform(_index(t)).select("id", F.array_join("bits", "").alias("bits"))


_NEAREST = "select query_id, cand_id, round(distance, 6) as distance, rank from nearest"


@query("qvec", _NEAREST, _lsh_cte(0))
def lsh_topk(t):
    found = lsh_baseline(_index(t), _queries(t), LSH_BITS, 5, LSH_SEED)
    return found.withColumn("distance", F.round("distance", 6))


@query("qvec", _NEAREST, _lsh_cte(1))
def lsh_topk_radius(t):
    found = lsh_baseline(_index(t), _queries(t), LSH_BITS, 5, LSH_SEED, radius=1)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "qvec",
    """select round(100.0::double * count(distinct n.query_id) / (select count(*) from qvec), 6) as pct_found
       from nearest n where n.query_id = n.cand_id""",
    _lsh_cte(0),
)
def baseline_recall(t):
    found = lsh_baseline(_index(t), _queries(t), LSH_BITS, 5, LSH_SEED)
    return _rounded(mt.recall(found, _truth(t)))


@query(
    "qvec",
    """select q.id as id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: abs(p[1] - p[2]))) as distance,
         list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: abs(p[1] - p[2]))) as packed
       from hqry q join hidx c on q.id = c.id""",
    _KLSH,
)
def hamming_distance(t):
    model = _model(t)
    layout = model.layout(R)
    words = model.signatures(_index(t), layout).join(
        model.signatures(_queries(t), layout).withColumnRenamed("sig", "qsig"), "id"
    ).select("id", fv.packed_hamming_distance(F.col("sig"), F.col("qsig")).alias("packed"))
    bits = model.transform(_index(t)).join(
        model.transform(_queries(t), out="qbits").select("id", "qbits"), "id"
    )
    return bits.select(
        "id", fv.hamming_distance(F.col("bits"), F.col("qbits")).alias("distance")
    ).join(words, "id")


_SCORED_CTE = f"""{_CAND},
scored as (
  select c.query_id, c.cand_id, case when c.query_id = c.cand_id then 1 else 0 end as label,
    exp(-list_sum(list_transform(range(1, 65), lambda i:
      (q.vec[i]::double - x.vec[i]::double) * (q.vec[i]::double - x.vec[i]::double)))) as score
  from cand c join qry q on c.query_id = q.id join idx x on c.cand_id = x.id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, cand_id) as rank from scored),
per_query as (select query_id, min(case when label = 1 then rank end) as first_rank from ranked group by query_id)"""


def _retrieval(t, **options):
    return run_retrieval(_index(t), _queries(t), _truth(t), P, T, B, R, SEED, **options)


_TOP = """select query_id, cand_id, cast(label as double) as label, round(score, 6) as score, rank
  from ranked where rank <= 10"""


@query("qvec", _TOP, _SCORED_CTE)
def retrieve(t):
    return _retrieval(t).top(10).withColumn("score", F.round("score", 6))


_LEARNED_CTE = f"""{NEWTON_CTE.replace("ranked", "filed")},
{_SCORED_CTE}""".replace(
    "exp(-list_sum(list_transform(range(1, 65), lambda i:\n      (q.vec[i]::double - x.vec[i]::double) * (q.vec[i]::double - x.vec[i]::double))))",
    f"1.0::double / (1.0::double + exp(-list_dot_product((select w from fitted), {segment_sums('q.vec', 'x.vec')})))",
)


@query("assets qvec", _TOP, _LEARNED_CTE)
def retrieve_learned(t):
    """The candidates ranked by a scorer that was trained on the pairs of posts."""
    return _retrieval(t, scorer=trained_scorer(t)).top(10).withColumn("score", F.round("score", 6))


@query(
    "assets qvec",
    """select count(*) as n_queries, round(avg(coalesce(1.0::double / first_rank, 0)), 6) as mrr from per_query""",
    _LEARNED_CTE,
)
def retrieve_metrics_learned(t):
    return _rounded(_retrieval(t, scorer=trained_scorer(t)).metrics().select("n_queries", "mrr"))


def _closeness():
    def predict(a, b):
        return np.exp(-((a - b) ** 2).sum(axis=1))

    return predict


@query("qvec", _TOP, _SCORED_CTE)
def retrieve_with_model(t):
    """The candidates scored in batches by a model of the two vectors."""
    return _retrieval(t, scorer=sc.PairModel(_closeness, dim=64)).top(10).withColumn("score", F.round("score", 6))


_SHARES = ", ".join(
    f"round(100.0::double * count(*) filter (where first_rank = {r}) / count(first_rank), 6) as pct_rank_{r}"
    for r in range(1, 5)
)


@query(
    "qvec",
    f"""select count(*) as n_queries, round(avg(coalesce(1.0::double / first_rank, 0)), 6) as mrr, {_SHARES}
        from per_query""",
    _SCORED_CTE,
)
def retrieve_metrics(t):
    figures = _retrieval(t).metrics()
    return _rounded(figures.select("n_queries", "mrr", *[f"pct_rank_{r}" for r in range(1, 5)]))


@query(
    "qvec",
    f"select {_STATS}, round(100.0::double * count(*) filter (where hits > 0) / count(*), 6) as pct_found from counts",
    _STATS_CTE.replace(_CAND, f"{_klsh_cte(300, 30, 180, 0, rounds=20)}, {_bands_cte(20, 9)}"),
)
def retrieve_default_hash(t):
    """The retrieval with the usual 180 bits in bands of nine."""
    return _rounded(run_retrieval(_index(t), _queries(t), _truth(t)).stats())


_SCORED_CP_CTE = _SCORED_CTE.replace(_CAND, f"{_klsh_cte(sources=_ASSET_SOURCES)}, {_bands_cte()}").replace(
    "c.query_id = c.cand_id then", "contains(q.name, x.stem) then"
).split("per_query as")[0] + """per_query as (
  select query_id, min(case when label = 1 then rank end) as first_rank,
    avg(case when label = 1 then 1.0::double / rank end) as reciprocal,
    count(*) filter (where label = 1 and rank <= 3) as top_hits
  from ranked group by query_id)"""


@query("assets", _TOP, _SCORED_CP_CTE)
def retrieve_cp(t):
    """The best ten children of every parent."""
    return _retrieval_cp(t).top(10).withColumn("score", F.round("score", 6))


@query(
    "assets",
    f"""select count(*) as n_queries, round(avg(coalesce(1.0::double / first_rank, 0)), 6) as mrr,
          round(avg(coalesce(reciprocal, 0)), 6) as mrr_all, round(avg(top_hits / 3.0::double), 6) as precision_at_3, {_SHARES}
        from per_query""",
    _SCORED_CP_CTE,
)
def retrieve_metrics_cp(t):
    return _rounded(_retrieval_cp(t).metrics("cp"))


_BATCH_ROWS = 700
_BATCHED_CTE = f"""{_SCORED_CTE},
packed as (select *, row_number() over (order by query_id, cand_id) - 1 as n from scored)"""


def _batched(t):
    return _retrieval(t).write_batches(scratch_path(t.spark, "retrieved"), _BATCH_ROWS)


@query(
    "qvec",
    f"""select query_id, cast(floor(min(n) / {_BATCH_ROWS}) as bigint) as start_batch, min(n) % {_BATCH_ROWS} as start_slot,
         cast(floor((max(n) + 1) / {_BATCH_ROWS}) as bigint) as end_batch, (max(n) + 1) % {_BATCH_ROWS} as end_slot,
         count(*) filter (where label = 1) as n_relevant
       from packed group by query_id""",
    _BATCHED_CTE,
)
def retrieve_batches(t):
    """Every candidate pair written as a labelled batch, and where each query's pairs begin and end."""
    return _batched(t)[0]


@query(
    "qvec",
    """select query_id, n - first as position from (
         select query_id, label, n, min(n) over (partition by query_id) as first from packed) x where label = 1""",
    _BATCHED_CTE,
)
def retrieve_positions(t):
    return _batched(t)[1]


@query(
    "qvec",
    """select query_id, cand_id, cast(label as double) as label,
         round(cast(cast(score as float) as double), 6) as score,
         cast(floor(n / 700) as bigint) as batch, n % 700 as slot from packed""",
    _BATCHED_CTE,
)
def retrieve_pairs(t):
    """The stored batches of a retrieval, read back."""
    path = scratch_path(t.spark, "retrieved")
    _retrieval(t).write_batches(path, _BATCH_ROWS)
    stored = store.read_pair_batches(t.spark, path)
    return stored.select(
        "query_id", "cand_id", F.col("label").cast("double").alias("label"),
        F.round(F.col("score").cast("double"), 6).alias("score"), "batch", "slot",
    )


_SPLIT_FOUND_CTE = f"""{_SPLIT_CTE},
cand as (
  select distinct q.id as query_id, c.id as cand_id
  from placed_ids c join asked q on substr(q.s || q.s, band * {R} + 1, depth) = prefix),
{_SCORED_CTE.removeprefix(_CAND).lstrip(",")}"""


@query("qvec", _TOP, _SPLIT_FOUND_CTE)
def retrieve_split(t):
    """The retrieval with buckets that split until they are small."""
    return _retrieval(t, target=BUCKET_TARGET).top(10).withColumn("score", F.round("score", 6))


@query(
    "qvec",
    f"""select {_STATS}, round(100.0::double * count(*) filter (where hits > 0) / count(*), 6) as pct_found
        from (select q.id as query_id, count(c.cand_id) as n, count(*) filter (where c.cand_id = q.id) as hits
              from qry q left join cand c on c.query_id = q.id group by q.id) counts""",
    _SPLIT_FOUND_CTE,
)
def retrieval_stats_split(t):
    return _rounded(_retrieval(t, target=BUCKET_TARGET).stats())
