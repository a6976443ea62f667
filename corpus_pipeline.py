"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.deploy import ship_package
from pairmatch.lineage import cut_lineage, scratch_path
from pairmatch.llm import decontaminate, jaccard, linededup, mixing, toxicity
from pairmatch.llm.common import fresh, table
from pairmatch.llm.queries import EPOCHS, SEED, SHARE, WEIGHTS, source_domain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose toxicity score reaches 0.3 go; null and empty texts stay, rows that repeat are told alike."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: later copies of line runs go, and documents that have nothing else.

    Null texts stay null and empty ones empty; rows that repeat doc_id and text get the same text.  ``n_chars``, if there is
    one, counts the characters that stay; all other columns are kept, whatever their names.
    """
    ship_package(spark)
    # the two counts get their names, columns that have them others
    taken = [n for n in docs.columns if n.lower() in ("n_lines", "n_removed")]
    aside = dict(zip(taken, fresh([*docs.columns, "n_lines", "n_removed"], *(n.lower() for n in taken)), strict=True))
    left = linededup.remove_repeated_lines(docs.toDF(*(aside.get(n, n) for n in docs.columns)))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    shortened = F.when(F.col("n_removed") > 0, F.length("text"))
    return left.where(~emptied).select(
        *(
            shortened.otherwise(F.col("n_chars")).cast("bigint").alias(n) if n == "n_chars" else F.col(f"`{aside.get(n, n)}`").alias(n)
            for n in docs.columns
        )
    )


def unit() -> Column:
    """One number for doc_id and text, never null: texts that share a doc_id, or have none, are told apart."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, on five words and a similarity of 0.8: one row of each group stays.

    It has the smallest doc_id, and of several texts under that the smallest hash; rows without doc_id
    come last.  Of rows that repeat doc_id and text, the one with the smallest other columns stays.
    Texts without words are no copies of each other.
    """
    ship_package(spark)
    found = jaccard.jaccard_components(docs.select(unit().alias("doc_id"), "text"), percent=80, length=5)
    units = cut_lineage(
        found.groupBy(F.col("doc_id").alias("unit"), F.col("component_id").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    )
    names = docs.select(
        unit().alias("unit"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"),
    ).dropDuplicates(["unit"])
    stays = (
        units.join(names, "unit")
        .groupBy("group")
        .agg(F.min(F.struct("unnamed", "id", "version", "unit")).alias("least"))
        .select(F.col("least.unit").alias("unit"))
    )
    left = without(docs, units.join(stays, "unit", "left_anti"))
    repeated = cut_lineage(units.where("n > 1").select("unit"))
    if repeated.isEmpty():
        return left
    rows = left.join(repeated, unit() == repeated.unit, "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    once = rows.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("0"), *others)).alias("rest"))
    once = once.select(*(c if c in ("doc_id", "text") else F.col("rest").getField(c) for c in docs.columns))
    return without(left, repeated).union(once.toDF(*docs.columns))


def without(docs: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose unit isn't in ``units``."""
    return docs.join(units, unit() == units.unit, "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows whose text holds a benchmark item go, with or without doc_id; null and empty texts stay."""
    ship_package(spark)
    leaks = decontaminate.find_leaks(docs.select(unit().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select(F.col("doc_id").alias("unit")).distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents of the mix, with domain, n_tokens and epochs; columns called so before are replaced.

    Documents without words, null texts among them, aren't taken; rows that repeat doc_id and text are taken together; rows
    without doc_id, source or lang take part.
    """
    ship_package(spark)
    picked = mixing.mix(docs, spark.sql(WEIGHTS), source_domain(), share=SHARE, max_epochs=EPOCHS, seed=SEED)
    kept = [n for n in docs.columns if n.lower() not in ("domain", "n_tokens", "epochs")]
    doc, version, own = fresh(kept, "doc", "version", "own")
    picked = picked.select(F.col("doc_id").alias(doc), F.col("version").alias(version), "domain", "n_tokens", "epochs")
    marked = docs.select(*(F.col(f"`{n}`") for n in kept), F.xxhash64("text").alias(own))
    return marked.join(
        picked, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(version))
    ).drop(doc, version, own)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: The scores of the first stage come from a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them are in the session's shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return out
        path = scratch_path(spark, f"stage{number}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
