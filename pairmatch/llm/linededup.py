"""Removal of repeated runs of lines, with a suffix array over line ids.

Documents are sequences of line ids.  Distributed prefix doubling ranks their suffixes by the first
1, 2, 4, ... lines: a suffix's next rank comes from its own rank and that of the suffix so many lines
on.  Suffixes of equal rank stand together in the suffix array and share that many lines, so they
form an interval of at least that longest common prefix.  The first suffix of an interval in the
order of the corpus is the first copy of the run; the lines of all others go.

A run of R lines is met at each of its R - L + 1 suffixes with at least L lines, so ranking by the first
L lines is enough for every run of L lines or more, and a suffix that starts with a line nothing
repeats is settled at once.  Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.llm.common import fresh
from pairmatch.operators.ordering import number_rows

_BLANKS = " \t\r"
_AT = ["doc", "version", "seq"]


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def _doc(documents: DataFrame, doc: str = "_doc", version: str = "_version") -> DataFrame:
    """Columns to sort documents by: null ids first, and texts that share an id by hash."""
    return documents.withColumns(
        {
            doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))),
            version: F.xxhash64("text"),
        }
    )


def line_ids(documents: DataFrame, long_words: int) -> DataFrame:
    """Rows (doc, version, seq, line, a, b, long): the lines that aren't blank, numbered without gaps.

    ``line`` is the number among all lines, ``a`` and ``b`` make the 128-bit id of the line without blanks
    around it, ``long`` says whether it has ``long_words`` words.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda text, at: F.struct(at.alias("line"), _trimmed(text).alias("text"))),
        lambda line: line["text"] != "",
    )
    return (
        _doc(documents.select("doc_id", F.col("text").cast("string")))
        .select(F.col("_doc").alias("doc"), F.col("_version").alias("version"), F.posexplode(lines).alias("seq", "one"))
        .select(
            *_AT,
            F.col("one.line").alias("line"),
            F.xxhash64("one.text").alias("a"),
            F.xxhash64(F.lit(17), F.col("one.text")).alias("b"),
            (F.size(F.split("one.text", "[ \t]+")) >= long_words).alias("long"),
        )
    )


def _ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank``, the place of the ``keys`` in their order, and leaves out what occurs once."""
    groups = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return suffixes.join(number_rows(groups, keys, "rank"), keys).drop(*keys)


def suffix_ranks(documents: DataFrame, min_lines: int = 2, long_words: int = 10) -> tuple[DataFrame, DataFrame]:
    """Suffixes that share their first line, and their first ``min_lines`` lines, with another one.

    Both have rows (doc, version, seq, rank); the first also (line, long).  Equal ranks are one interval
    of the suffix array, and ranks follow the order of the suffixes.
    """
    first = cut_lineage(_ranked(line_ids(documents, long_words), ["a", "b"]).dropDuplicates(_AT))
    ranks, have = first.select(*_AT, "rank"), 1
    while have < min_lines:
        step = min(have, min_lines - have)
        further = ranks.select("doc", "version", (F.col("seq") - step).alias("seq"), F.col("rank").alias("second"))
        pairs = ranks.withColumnRenamed("rank", "head").join(further, _AT)
        ranks = cut_lineage(_ranked(pairs, ["head", "second"]))
        have += step
    return first, ranks


def _later(ranks: DataFrame) -> DataFrame:
    """Suffixes that aren't the first of their interval, with the first one as ``source``."""
    place = F.struct(*_AT)
    firsts = ranks.groupBy("rank").agg(F.min(place).alias("source"))
    return ranks.join(firsts, "rank").where(place > F.col("source"))


def repeated_runs(documents: DataFrame, min_lines: int = 2) -> DataFrame:
    """Later copies as maximal runs: (doc, version, seq, n_lines, source_doc, source_version, source_seq).

    ``seq`` counts lines that aren't blank.  A run goes on as long as the source's next line follows.
    """
    _, ranks = suffix_ranks(documents, min_lines)
    later = _later(ranks).withColumn("ahead", F.col("seq") - F.col("source.seq"))
    chain = ["doc", "version", "source.doc", "source.version", "ahead"]
    nth = F.row_number().over(Window.partitionBy(*chain).orderBy("seq"))
    return (
        later.withColumn("island", F.col("seq") - nth)
        .groupBy("doc", "version", F.col("source.doc").alias("source_doc"), F.col("source.version").alias("source_version"),
                 "ahead", "island")
        .agg(F.min("seq").alias("seq"), (F.count(F.lit(1)) + (min_lines - 1)).alias("n_lines"))
        .select("doc", "version", "seq", "n_lines", "source_doc", "source_version", (F.col("seq") - F.col("ahead")).alias("source_seq"))
    )


def remove_repeated_lines(documents: DataFrame, min_lines: int = 2, long_words: int = 10) -> DataFrame:
    """``documents`` with later copies of repeated lines removed from ``text``, and ``n_lines``, ``n_removed``.

    A line goes if it is part of a run of at least ``min_lines`` lines that begins earlier as well,
    in the order of doc_id and lines, or if it has at least ``long_words`` words and occurs earlier.
    Lines count as equal without blanks around them; blank lines belong to no run and stay.  Copies
    within a document and runs that overlap themselves count too.

    A null text stays null with 0 lines and a null doc_id sorts first.  Rows that repeat doc_id and
    text are one document and get the same text; texts that share a doc_id sort by hash.  All other
    columns are kept, whatever their names, but for columns called like the two counts, which those replace.
    """
    doc, version, spots = fresh([*documents.columns, "text"], "_doc", "_version", "_gone")
    first, ranks = suffix_ranks(documents, min_lines, long_words)
    starts = _later(ranks).select("doc", "version", F.explode(F.sequence("seq", F.col("seq") + (min_lines - 1))).alias("seq"))
    single = _later(first.where("long").select(*_AT, "rank")).select(*_AT)
    gone = first.join(starts.union(single), _AT, "left_semi")
    gone = gone.groupBy("doc", "version").agg(F.array_sort(F.collect_list("line")).alias(spots))
    lines = F.split("text", "\n")
    edges = F.concat(F.array(F.lit(-1)), F.col(spots), F.array(F.size(lines)))
    # one element that holds both arrays, so that the text is split once and not for every piece
    held = F.array(F.struct(lines.alias("lines"), edges.alias("edges")))
    pieces = F.transform(
        held,
        lambda h: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(h["edges"]) - 2),
                lambda j: F.slice(
                    h["lines"], F.get(h["edges"], j) + 2, F.get(h["edges"], j + 1) - F.get(h["edges"], j) - 1
                ),
            )
        ),
    )
    names = [n for n in documents.columns if n.lower() not in ("n_lines", "n_removed")]
    joined = _doc(documents.withColumn("text", F.col("text").cast("string")), doc, version).join(
        gone.select(F.col("doc").alias(doc), F.col("version").alias(version), spots), [doc, version], "left"
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    return joined.select(
        *(
            F.when(F.col(spots).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n")).alias("text")
            if n == "text"
            else F.col(f"`{n}`")
            for n in names
        ),
        n_lines.alias("n_lines"),
        F.coalesce(F.size(spots), F.lit(0)).cast("bigint").alias("n_removed"),
    )


ORACLE = """
with l as (
    select doc_id, hash_of, i, trim(x, ' ' || chr(9) || chr(13)) as x
    from (select doc_id, md5(text) as hash_of, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i,
                 unnest(string_split(text, chr(10))) as x from documents where text is not null)
), s as (
    select *, row_number() over (partition by doc_id order by i) as seq,
           lead(x) over (partition by doc_id order by i) as nxt
    from l where x <> ''
), f as (
    select *, row_number() over (partition by x order by doc_id, seq) > 1 as again,
           nxt is not null and row_number() over (partition by x, nxt order by doc_id, seq) > 1 as again2
    from s
), g as (
    select doc_id, i,
           (again and len(string_split_regex(x, '[ ' || chr(9) || ']+')) >= 10) or again2
           or coalesce(lag(again2) over (partition by doc_id order by i), false) as gone
    from f
), k as (
    select l.doc_id, l.i, o.x, coalesce(g.gone, false) as gone
    from l left join g on l.doc_id = g.doc_id and l.i = g.i
    join (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i,
                 unnest(string_split(text, chr(10))) as x from documents) o
      on l.doc_id = o.doc_id and l.i = o.i
)
select d.doc_id, case when d.text is null then null else coalesce(t.text, '') end as text,
       coalesce(t.n_lines, 0) as n_lines, coalesce(t.n_removed, 0) as n_removed
from documents d left join (
    select doc_id, string_agg(x, chr(10) order by i) filter (not gone) as text, count(*) as n_lines,
           count(*) filter (gone) as n_removed
    from k group by doc_id) t on d.doc_id = t.doc_id
"""
