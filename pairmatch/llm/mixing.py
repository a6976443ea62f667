"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of domains, languages and sources.  The children of a node share its
budget by weight, but none gets more than it can supply in ``max_epochs`` epochs; what a child can't
use goes to its siblings by their weights, and what all children together can't use was never given
to their parent, because a parent's supply is the sum of theirs, those without weight left out.  Each leaf then takes whole epochs
and the beginning of one more, in the seeded order of that epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.operators.ordering import running_total

LEVELS = ("domain", "lang", "source")
NONE = "(none)"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != ""))
    return F.when(text.isNull(), 0).otherwise(words).cast("bigint")


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget``: the part of the parent's budget ``above`` that each node gets.

    Nodes are filled up in the order of supply to weight, so those that run short come first: a node
    is short if its fair part of what is left exceeds its supply.  The others divide the rest by
    weight, rounded down.  A node without weight or supply gets nothing.
    """
    able = (F.col("weight") > 0) & (F.col("supply") > 0)
    weight = F.when(able, F.col("weight")).otherwise(0)
    supply = F.when(able, F.col("supply")).otherwise(0)
    nodes = nodes.withColumns({"_w": weight, "_s": supply}).withColumn(
        "_ratio", F.when(able, F.col("_s") / F.col("_w")).otherwise(0.0)
    )
    order = Window.partitionBy(*parent).orderBy("_ratio", name)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    given = F.coalesce(F.sum("_s").over(upto), F.lit(0))
    nodes = nodes.withColumn("_left", F.col("above") - given).withColumn("_rest", F.sum("_w").over(onward))
    short = F.col("_s") * F.col("_rest") <= F.col("_w") * F.col("_left")
    nodes = nodes.withColumn("_short", short)
    taken = F.sum(F.when(F.col("_short"), F.col("_s")).otherwise(0)).over(whole)
    sharing = F.sum(F.when(F.col("_short"), 0).otherwise(F.col("_w"))).over(whole)
    nodes = nodes.withColumns({"_taken": taken, "_sharing": sharing})
    part = F.expr("case when _short then _s when _sharing = 0 then 0 else (_w * (above - _taken)) div _sharing end")
    return nodes.withColumn("budget", part.cast("bigint")).drop(
        "_w", "_s", "_ratio", "_left", "_rest", "_short", "_taken", "_sharing"
    )


def leaf_budgets(supplies: DataFrame, weights: DataFrame, budget: Column | int, max_epochs: int) -> DataFrame:
    """Budget of every (domain, lang, source) in ``supplies`` (and tokens), one row per leaf.

    weights: rows (domain, lang, source, weight), whole numbers; one with a null source weighs a
    language in its domain, one with null lang and source a domain.  What has no row weighs 1.
    """
    weights = weights.select(*(F.col(c).cast("string") for c in LEVELS), F.col("weight").cast("bigint"))
    leaves = supplies.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).alias("supply"))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        own = weights.where(F.col(level).isNotNull())
        for below in LEVELS[depth + 1 :]:
            own = own.where(F.col(below).isNull())
        own = own.groupBy(*path).agg(F.max("weight").alias(f"w{depth}"))
        leaves = leaves.join(own, path, "left").withColumn(f"w{depth}", F.coalesce(f"w{depth}", F.lit(1)))
    above = leaves.select(F.lit(0).alias("_root")).distinct().withColumn("above", F.lit(budget).cast("bigint"))
    nodes = above
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth]) or ["_root"]
        # what a leaf can supply counts for a node only if all nodes between have weight
        usable = F.lit(True)
        for below in range(depth + 1, len(LEVELS)):
            usable = usable & (F.col(f"w{below}") > 0)
        here = leaves.groupBy(*path).agg(
            F.sum(F.when(usable, F.col("supply")).otherwise(0)).alias("supply"), F.sum("tokens").alias("tokens"), F.max(f"w{depth}").alias("weight")
        )
        if depth == 0:
            here = here.withColumn("_root", F.lit(0))
        here = here.join(nodes.select(*parent, "above"), parent)
        nodes = share_out(here, parent, level).select(*path, "tokens", F.col("budget").alias("above"))
    return nodes.withColumnRenamed("above", "budget")


def mix(
    documents: DataFrame, weights: DataFrame, domain: Column, share: float = 0.5, max_epochs: int = 4, seed: str = "mix",
    tokens: Column | None = None,
) -> DataFrame:
    """Selected documents: (doc_id, version, domain, lang, source, n_tokens, epochs).

    Takes about ``share`` of all tokens, as far as the supply allows.  ``epochs`` says how many
    times a document is taken; an epoch's order is by a hash of seed, epoch and doc_id, and the last,
    partial epoch is the longest beginning of that order that fits, so a leaf falls short of its budget by fewer tokens
    than the first document that doesn't fit has; that rest isn't given to others.  ``tokens`` counts a document's
    tokens, words by default.  Weights times tokens must stay below 2**63.

    Nulls in domain, lang or source are a node of their own, called "(none)".  Documents without
    tokens, null texts among them, are never taken.  Rows that repeat doc_id and text are one unit, with all
    their tokens; texts that share a doc_id are told apart by ``version``, a hash of the text.  Only
    ids and counts are sorted, by ranges over all tasks, so a source with a third of the rows is
    spread.  Other columns are ignored.
    """
    counted = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("version"),
        F.coalesce(domain.cast("string"), F.lit(NONE)).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        (word_count(F.col("text")) if tokens is None else tokens.cast("bigint")).alias("n_tokens"),
    )
    units = cut_lineage(
        counted.groupBy("doc_id", "version", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    )
    supplies = units.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = supplies.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(supplies, weights, int(total * share), max_epochs)
    budgets = budgets.withColumn("whole", F.expr("budget div tokens")).withColumn(
        "rest", F.col("budget") - F.col("whole") * F.col("tokens")
    )
    placed = units.join(cut_lineage(budgets.drop("tokens")), list(LEVELS)).where("budget > 0")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = placed.withColumn("_turn", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    summed = running_total(keyed, LEVELS, ["_turn", "doc_id", "version"], "n_tokens", "_sofar")
    again = (F.col("_sofar") + F.col("n_tokens") <= F.col("rest")).cast("bigint")
    return (
        summed.withColumn("epochs", F.col("whole") + again)
        .where("epochs > 0")
        .select("doc_id", "version", *LEVELS, "n_tokens", "epochs")
    )


def oracle(documents: str, weights: str, domain: str, share: float, max_epochs: int, seed: str) -> str:
    """SQL for ``mix``; ``documents`` and ``weights`` are queries, doc_id must be unique."""

    def level(depth: int) -> str:
        level, path = LEVELS[depth], ", ".join(LEVELS[: depth + 1])
        parent = ", ".join(LEVELS[:depth]) or "root"
        up = f"join b{depth - 1} using ({parent})" if depth else "cross join b_root"
        root = "" if depth else "root, "
        usable = " and ".join(["true", *(f"w{d} > 0" for d in range(depth + 1, len(LEVELS)))])
        return f"""
n{depth} as (
    select {root}{path}, t.tokens, above, case when weight > 0 and supply > 0 then weight else 0 end as w,
           case when weight > 0 and supply > 0 then supply else 0 end as s
    from (select {path}, sum(case when {usable} then supply else 0 end)::bigint as supply, sum(tokens)::bigint as tokens,
                 max(w{depth}) as weight from weighed group by {path}) t
    {up}
), m{depth} as (
    select *, above - coalesce(sum(s) over (partition by {parent} order by case when w > 0 then s / w else 0 end, {level}
                                            rows between unbounded preceding and 1 preceding), 0) as lft,
           sum(w) over (partition by {parent} order by case when w > 0 then s / w else 0 end, {level}
                        rows between current row and unbounded following) as rst
    from n{depth}
), k{depth} as (
    select *, s * rst <= w * lft as short from m{depth}
), b{depth} as (
    select {path}, tokens, case when short then s when sharing = 0 then 0 else (w * (above0 - taken)) // sharing end::bigint as above
    from (select * exclude (above), above as above0,
                 sum(case when short then s else 0 end) over (partition by {parent}) as taken,
                 sum(case when short then 0 else w end) over (partition by {parent}) as sharing from k{depth})
)"""

    def own_weights(depth: int) -> str:
        path = ", ".join(LEVELS[: depth + 1])
        only = "".join(f" and {c} is null" for c in LEVELS[depth + 1 :])
        return f"""
    left join (select {path}, max(weight) as weight{depth} from weights where {LEVELS[depth]} is not null{only} group by {path}) using ({path})"""

    return f"""
with units as (
    select doc_id, coalesce({domain}, '{NONE}') as domain, coalesce(lang, '{NONE}') as lang, coalesce(source, '{NONE}') as source,
           len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as n_tokens
    from ({documents})
    where len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) > 0
), weights as ({weights}), leaves as (
    select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {max_epochs})::bigint as supply
    from units group by all
), weighed as (
    select leaves.*, coalesce(weight0, 1) as w0, coalesce(weight1, 1) as w1, coalesce(weight2, 1) as w2
    from leaves{own_weights(0)}{own_weights(1)}{own_weights(2)}
), b_root as (
    select 0 as root, floor(sum(tokens)::double * {share})::bigint as above from leaves
),{level(0)},{level(1)},{level(2)}, picks as (
    select *, sum(n_tokens) over (partition by domain, lang, source order by key, doc_id) as upto
    from (
        select u.*, above // tokens as whole, above - (above // tokens) * tokens as rest,
               ('0x' || substr(md5('{seed}|' || (above // tokens) || '|' || doc_id), 1, 15))::bigint as key
        from units u join b2 using (domain, lang, source) where above > 0)
)
select doc_id, domain, lang, source, n_tokens, (whole + case when upto <= rest then 1 else 0 end)::bigint as epochs
from picks where whole + case when upto <= rest then 1 else 0 end > 0"""
