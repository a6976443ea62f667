"""Queries on posts, their files and spliced images."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pairmatch.functions.names import stem
from pairmatch.operators import assets as at
from pairmatch.operators import links as ln
from pairmatch.operators import pairs as pr
from pairmatch.operators import scoring as sc
from pairmatch.operators import splices as sp
from pairmatch.registry.base import register

QUERIES: dict = {}
ORACLES: dict = {}
query = partial(register, QUERIES, ORACLES)


@query(
    "assets",
    """select vec_id, regexp_replace(filename, '_[^_]*$', '') as child_stem,
         regexp_replace(filename, '\\.[^.]*$', '') as parent_stem from assets""",
)
def asset_stem(t):
    name = F.col("filename")
    return t["assets"].select(
        "vec_id", stem(name, "_").alias("child_stem"), stem(name, ".").alias("parent_stem")
    )


_ROLES_CTE = """
ranked as (
  select *, row_number() over (partition by post_id order by filename) as rn,
    count(*) over (partition by post_id) as files,
    min(filename) over (partition by post_id) as first_name
  from assets
),
roles as (
  select vec_id, post_id, filename, embedding, rn, case when rn = 1 then 'parent' else 'child' end as role
  from ranked
  where files > 1 and length(first_name) - length(replace(first_name, '_', '')) <= 1
),
parents as (
  select vec_id as id, post_id, filename as name, regexp_replace(filename, '\\.[^.]*$', '') as stem
  from roles where role = 'parent'
),
children as (
  select vec_id as id, post_id, filename as name, regexp_replace(filename, '_[^_]*$', '') as stem
  from roles where role = 'child'
)"""


@query("assets", "select vec_id, post_id, filename, role from roles", _ROLES_CTE)
def asset_roles(t):
    return at.asset_roles(t["assets"]).select("vec_id", "post_id", "filename", "role")


@query("assets", "select post_id, filename from ranked where rn = 1", _ROLES_CTE)
def first_in_post(t):
    return t["assets"].groupBy("post_id").agg(F.min("filename").alias("filename"))


def _sets(t, mode):
    candidates, queries = at.build_retrieval_sets(t["assets"], mode)
    keep = ["id", "post_id", "name", "stem"]
    return candidates.select(*keep), queries.select(*keep)


def _both(t, mode):
    candidates, queries = _sets(t, mode)
    return candidates.withColumn("side", F.lit("candidate")).unionByName(
        queries.withColumn("side", F.lit("query"))
    )


_BOTH_SQL = """select id, post_id, name, stem, '{}' as side from parents
  union all select id, post_id, name, stem, '{}' from children"""


@query("assets", _BOTH_SQL.format("candidate", "query"), _ROLES_CTE)
def build_retrieval_sets(t):
    return _both(t, "pc")


@query("assets", _BOTH_SQL.format("query", "candidate"), _ROLES_CTE)
def build_retrieval_sets_cp(t):
    return _both(t, "cp")


@query(
    "assets",
    """select c.id as query_id, p.id as truth_id from children c left join
         (select stem, min(id) as id from parents group by stem) p on c.stem = p.stem""",
    _ROLES_CTE,
)
def truth_lookup(t):
    candidates, queries = _sets(t, "pc")
    return at.truth_lookup(queries, candidates)


# the product is counted here in plain SQL; the operator gets by without it
_PRODUCT_CTE = (
    _ROLES_CTE
    + """,
product as (
  select q.id as query_id, c.id as cand_id, contains(q.name, c.stem) as related, c.position,
    q.i * c.total + c.position as n, q.i * c.total as lo, (q.i + 1) * c.total as hi, c.total
  from (select *, row_number() over (order by name, id) - 1 as i from {q}) q,
       (select *, row_number() over (order by name, id) - 1 as position, count(*) over () as total from {c}) c
)"""
)
_RANGES_SQL = """select query_id, max(total) as n_pairs,
    max(lo) // 1000 as start_batch, max(lo) % 1000 as start_slot,
    max(hi) // 1000 as end_batch, max(hi) % 1000 as end_slot,
    count(*) filter (where related) as n_relevant
  from product group by query_id"""


def _product_cte(q, c):
    return _PRODUCT_CTE.replace("{q}", q).replace("{c}", c)


@query("assets", _RANGES_SQL, _product_cte("children", "parents"))
def exhaustive_pairs(t):
    candidates, queries = _sets(t, "pc")
    return pr.exhaustive_index(queries, candidates, size=1000)[0]


@query("assets", _RANGES_SQL, _product_cte("parents", "children"))
def exhaustive_pairs_cp(t):
    candidates, queries = _sets(t, "cp")
    return pr.exhaustive_index(queries, candidates, size=1000)[0]


@query(
    "assets",
    """select query_id, cand_id, position, n // 1000 as batch, n % 1000 as slot, cast(1.0 as double) as label
       from product where related""",
    _product_cte("children", "parents"),
)
def exhaustive_relevant(t):
    candidates, queries = _sets(t, "pc")
    return pr.exhaustive_index(queries, candidates, size=1000)[1]


@query(
    "name_pairs",
    """select query_id, cand_id, cast(case when contains(query_name, cand_stem) then 1 else 0 end as double) as label,
         cast(case when query_stem = cand_stem then 1 else 0 end as double) as exact from name_pairs""",
)
def label_pairs(t):
    by_part = pr.label_pairs(t["name_pairs"])
    both = pr.label_pairs(by_part.withColumnRenamed("label", "part"), match="exact")
    return both.select("query_id", "cand_id", F.col("part").alias("label"), F.col("label").alias("exact"))


_TRAINING_CTE = (
    _ROLES_CTE.replace("from assets", "from assets where filename like '%.jpg'")
    + """,
posts as (
  select post_id, max(name) as parent, max(n) as n, row_number() over (order by post_id) - 1 as k
  from (select post_id, case when role = 'parent' then filename end as name,
          count(*) filter (where role = 'child') over (partition by post_id) as n from roles) x
  group by post_id
),
kids as (
  select r.post_id, r.filename, r.rn - 1 as i, p.parent, p.n, p.k,
    {W:concat('7-sibling-', r.filename)} as hs, {W:concat('7-negative-', r.filename)} as hn,
    (select count(*) from posts) as total
  from roles r join posts p on r.post_id = p.post_id where r.role = 'child'
),
drawn as (
  select *, case when n > 1 then 1 + (i + hs % (n - 1)) % n end as j,
    hn % (total - 1) + case when hn % (total - 1) >= k then 1 else 0 end as other
  from kids
)"""
)


_TRAINING = """select post_id, parent as left, filename as right, cast(1.0 as double) as label from drawn
       union all
       select a.post_id, a.filename, b.filename, 0.5 from drawn a join drawn b
         on a.post_id = b.post_id and a.j = b.i
       union all
       select a.post_id, a.parent, b.parent, 0.0 from drawn a join posts b on a.other = b.k"""


@query("assets", _TRAINING, _TRAINING_CTE)
def make_training_pairs(t):
    return at.make_training_pairs(t["assets"], seed=7)


# training of a pair scorer: eight stretches of the vectors, ridge penalty, Newton steps with the inverse
# Hessian by Newton-Schulz iteration
SEGMENTS, RIDGE = 8, 0.01
_AT = range(1, SEGMENTS + 2)


def segment_sums(a: str, b: str) -> str:
    """SQL for a one and the sums of |a - b| over the stretches of two vectors of 64 elements."""
    step = 64 // SEGMENTS
    return f"""list_prepend(1.0::double, list_transform(range(0, {SEGMENTS}), lambda s: list_sum(list_transform(range(1, {step + 1}),
      lambda i: abs({a}[s * {step} + i]::double - {b}[s * {step} + i]::double)))))"""


def _product(x: str, symmetric: str) -> str:
    return f"list_transform({x}, lambda u: list_transform({symmetric}, lambda c: list_dot_product(u, c)))"


NEWTON_CTE = f"""{_TRAINING_CTE},
train as (
  select label as y, {segment_sums("l.embedding", "r.embedding")} as x
  from ({_TRAINING}) p join assets l on l.filename = p.left join assets r on r.filename = p.right),
newton(n, w) as (
  select 0, [{", ".join(["0.0::double"] * len(_AT))}]
  union all
  select n + 1, list_transform(w, lambda v, i: v + list_dot_product(inv[i], g)) from (
    select n, w, g, list_reduce(list_prepend(one, list_transform(range(0, 40), lambda k: h)),
      lambda v, m: list_transform({_product(_product("v", "m"), "v")},
        lambda r, i: list_transform(r, lambda e, j: 2.0::double * v[i][j] - e))) as inv
    from (
      select n, w, g, h, list_transform(h, lambda r, i: list_transform(r,
        lambda e, j: case when i = j then 1.0::double / ({" + ".join(f"h[{i}][{i}]" for i in _AT)}) else 0.0::double end)) as one
      from (
        select n, w, [{", ".join(f"sum((y - p) * x[{i}]) / count(*) - {RIDGE} * any_value(w[{i}])" for i in _AT)}] as g,
          [{", ".join("[" + ", ".join(f"sum(p * (1 - p) * x[{i}] * x[{j}]) / count(*) + {RIDGE if i == j else 0.0}" for j in _AT) + "]" for i in _AT)}] as h
        from (select n, w, y, x, 1.0::double / (1.0::double + exp(-list_dot_product(w, x))) as p from newton, train where n < 12) a
        group by n, w) b) c) d),
fitted as (select w from newton where n = 12)"""


def trained_scorer(t):
    """A scorer trained on the pairs of posts, by their files' vectors."""
    files = t["assets"].select(F.col("filename").alias("id"), F.col("embedding").alias("vec"))
    pairs = at.make_training_pairs(t["assets"], seed=7)
    pairs = pairs.select(F.col("left").alias("query_id"), F.col("right").alias("cand_id"), "label")
    return sc.train_pair_scorer(
        pr.attach_payload(pairs, files, files), binary_only=False, features=sc.segment_distances(SEGMENTS), reg=RIDGE
    )


@query(
    "assets",
    f"""select p.post_id, "left", "right", label, round(1.0::double / (1.0::double + exp(-list_dot_product(w, {segment_sums("l.embedding", "r.embedding")}))), 6) as score
        from ({_TRAINING}) p join assets l on l.filename = p.left join assets r on r.filename = p.right, fitted""",
    NEWTON_CTE,
)
def train_pair_scorer(t):
    """The scores of the training pairs by the model they were used for."""
    scorer = trained_scorer(t)
    files = t["assets"].select(F.col("filename").alias("id"), F.col("embedding").alias("vec"))
    pairs = at.make_training_pairs(t["assets"], seed=7)
    named = pairs.withColumns({"query_id": F.col("left"), "cand_id": F.col("right")})
    scored = sc.apply_pair_scorer(pr.attach_payload(named, files, files), scorer)
    return scored.select("post_id", "left", "right", "label", F.round("score", 6).alias("score"))


@query("assets", f"select i, round(w[i + 1], 5) as w from fitted, (select unnest(range(0, {SEGMENTS + 1})) as i) s", NEWTON_CTE)
def pair_scorer_weights(t):
    weights = F.array(*[F.lit(w) for w in trained_scorer(t).weights])
    # one row for the intercept and each feature, beside a table of one row
    return t["assets"].agg(F.count(F.lit(1))).select(F.posexplode(weights).alias("i", "w")).select(
        F.col("i").cast("bigint").alias("i"), F.round("w", 5).alias("w")
    )


@query(
    "assets",
    """select vec_id, post_id from assets where post_id in (
         select post_id from (select distinct post_id from assets) p
         order by md5(concat('5-', post_id)), post_id limit 50)""",
)
def sample_groups(t):
    return at.sample_groups(t["assets"], "post_id", 50, seed=5).select("vec_id", "post_id")


@query(
    "assets",
    """select vec_id, printf('%010d.jpg', row_number() over (order by filename, vec_id)) as new_name,
         printf('data_batch_%03d', row_number() over (partition by post_id order by filename) - 1) as in_post
       from assets""",
)
def sequential_names(t):
    named = at.sequential_names(t["assets"].select("vec_id", "post_id", "filename"), ["filename", "vec_id"])
    both = at.sequential_names(
        named, ["filename"], "data_batch_%03d", 0, folder=["post_id"], name="in_post"
    )
    return both.select("vec_id", "new_name", "in_post")


@query(
    "assets posts",
    """select post_id from posts where post_id in (
         select replace(post_id, 't3_p', 't3_') from assets)""",
)
def drop_empty_groups(t):
    members = t["assets"].select(F.replace("post_id", F.lit("t3_p"), F.lit("t3_")).alias("post_id"))
    return ln.drop_empty_groups(t["posts"], members, "post_id")


def _splice_inputs(t):
    keys = sp.splice_keys(F.col("sp_name"))
    splices = t["splices"].select(F.col("sp_name").alias("file"), keys["s1"].alias("s1"),
                                  keys["s2"].alias("s2"), F.col("embedding").alias("vec"))
    originals = t["originals"].select(
        sp.original_key(F.col("au_name")).alias("key"), F.col("embedding").alias("vec")
    )
    return splices, originals


_DIST = "list_sum(list_transform(range(1, 65), lambda i: ({0}[i]::double - {1}[i]::double) * ({0}[i]::double - {1}[i]::double)))"
_SPLICE_CTE = f"""
keyed as (
  select sp_name as file, embedding as vec, string_split(sp_name, '_')[6] as s1, string_split(sp_name, '_')[7] as s2
  from splices
),
au as (
  select concat(string_split(au_name, '_')[2], replace(string_split(au_name, '_')[3], '.jpg', '')) as key,
    embedding as vec from originals
),
measured as (
  select k.file, s1, s2, {_DIST.format('a.vec', 'k.vec')} as d1, {_DIST.format('b.vec', 'k.vec')} as d2
  from keyed k join au a on k.s1 = a.key join au b on k.s2 = b.key
),
matched as (
  select file, case when d1 < d2 then s1 else s2 end as au, case when d1 < d2 then d1 else d2 end as distance
  from measured
),
numbered as (
  select file, au, row_number() over (partition by au order by file) as number from matched
)"""


@query(
    "splices originals",
    """select file as name, s1 as key1, s2 as key2 from keyed
       union all select au_name, concat(string_split(au_name, '_')[2],
         replace(string_split(au_name, '_')[3], '.jpg', '')), null from originals""",
    _SPLICE_CTE,
)
def splice_name_keys(t):
    splices, _ = _splice_inputs(t)
    originals = t["originals"].select(
        F.col("au_name").alias("name"), sp.original_key(F.col("au_name")).alias("key1"),
        F.lit(None).cast("string").alias("key2"),
    )
    return splices.select(
        F.col("file").alias("name"), F.col("s1").alias("key1"), F.col("s2").alias("key2")
    ).unionByName(originals)


@query("splices originals", "select file, au, round(distance, 6) as distance from matched", _SPLICE_CTE)
def splice_source_join(t):
    return sp.match_splices(*_splice_inputs(t)).withColumn("distance", F.round("distance", 6))


@query(
    "splices originals",
    "select file, au, number, concat(au, '_', number, '.jpg') as pair_name from numbered",
    _SPLICE_CTE,
)
def splice_sequence(t):
    numbered = sp.number_splices(sp.match_splices(*_splice_inputs(t)))
    return numbered.select("file", "au", "number", "pair_name")


@query("splices originals", "select au, count(*) as n from matched group by au", _SPLICE_CTE)
def splice_counts(t):
    return sp.splice_counts(sp.match_splices(*_splice_inputs(t)))


@query(
    "splices originals",
    "select au, file, concat(au, '_', number, '.jpg') as pair_name, 1 as label from numbered",
    _SPLICE_CTE,
)
def casia_pairs(t):
    splices, originals = _splice_inputs(t)
    return sp.splice_pairs(sp.number_splices(sp.match_splices(splices, originals)), originals)
