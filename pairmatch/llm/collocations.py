"""Phrases of words that keep company, with stripes.

A stripe belongs to a prefix of words and counts the words that follow it.  The stripe of the empty prefix
holds the words of a language and its total; the stripes of one, two and three words hold the phrases of two, three
and four.  Tasks count in memory and send their stripes whenever they hold ``_HELD`` words, many in a block; stripes are
then added up element by element.  Every phrase that is frequent has a frequent beginning and a frequent
end, so only followers between such are counted, one length after the other.

One table of stripes gives all that is asked: the elements are the counts of the extended phrases, the
counts of a phrase's parts are elements of shorter prefixes, and the largest elements over the stripes that a
phrase begins, or ends, tell whether a longer phrase holds nearly all of its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.llm.common import bound_batches, id_filter, may_hold, placed_words, scramble, signed, small_batches, stored, text_bytes

_HELD = 1 << 21
_ROWS = 50_000
_BLOCKS_PER_PARTITION = 4
_SHARES = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.zeros(256, np.int32)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
_PARTING = _ENDS.astype(bool)
_PARTING[[0x20, 0x09]] = True


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of each prefix with a word after it."""
    with np.errstate(over="ignore"):
        return scramble(prefix * _STEP + word)


def _words(batch: pa.RecordBatch):
    """Words of all texts of a batch: hash by language, text's place, number of their piece, begin and end, and the bytes."""
    data, offsets = text_bytes(batch.column("text"))
    hashes, begins, ends = placed_words(data, offsets, _PARTING)
    row = np.searchsorted(offsets, begins, "right") - 1
    first, last = int(offsets[0]), int(offsets[-1])
    breaks = np.zeros(last - first + 1, np.int32)
    np.cumsum(_ENDS[data[first:last]], out=breaks[1:])
    piece = breaks[begins - first].astype(np.int64) + row  # both only grow
    names = batch.column("lang").to_pylist()
    seeds = {name: xxhash.xxh3_64_intdigest(name) for name in set(names)}
    seed = np.array([seeds[name] for name in names], np.uint64)
    return scramble(hashes ^ seed[row]), row, piece, begins, ends, data


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the stripe of the empty prefix, (w, lang, word, n), and a row without word for each language's total."""
    held: dict[int, list] = {}
    totals: dict[str, int] = {}
    schema = pa.schema([("w", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def stripe() -> Iterator[pa.RecordBatch]:
        rows = [(np.uint64(w).astype(np.int64), lang, word.decode(), n) for w, (lang, word, n) in held.items()]
        rows += [(0, lang, None, n) for lang, n in totals.items()]
        for i in range(0, len(rows), _ROWS):
            columns = zip(*rows[i : i + _ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        held.clear()
        totals.clear()

    for batch in small_batches(batches, "text"):
        words, row, _, begins, ends, data = _words(batch)
        names = batch.column("lang").to_pylist()
        for lang, n in zip(names, np.bincount(row, minlength=len(names)).tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + n
        distinct, at, count = np.unique(words, return_index=True, return_counts=True)
        for w, i, n in zip(distinct.tolist(), at.tolist(), count.tolist(), strict=True):
            seen = held.get(w)
            if seen:
                seen[2] += n
            else:
                held[w] = [names[row[i]], data[begins[i] : ends[i]].tobytes().lower(), n]
        if len(held) >= _HELD // 8:
            yield from stripe()
    yield from stripe()


def _stripes(size: int, blocks: int, frequent, hot: np.ndarray):
    """Task function: stripes of the phrases of ``size`` words whose two longest parts may be frequent.

    Rows (block, prefix, next, n) hold the stripes of a share of all prefixes, element by element, equal prefixes next to each
    other.  The stripe of a hot prefix is cut by the following word and dealt to all blocks.
    """

    def sent(prefix: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
        keys, at, count = np.unique(_longer(prefix, following), return_index=True, return_counts=True)
        prefix, following = prefix[at], following[at]
        block = (np.where(np.isin(prefix, hot), keys, prefix) % np.uint64(blocks)).astype(np.int32)
        order = np.lexsort((prefix, block))
        prefix, following, count, block = prefix[order], following[order], count[order], block[order]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        edges = pa.array(np.append(starts, len(block)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[starts]), *(pa.ListArray.from_arrays(edges, pa.array(v)) for v in (signed(prefix), signed(following), count.astype(np.int32)))],
            ["block", "prefix", "next", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, followers, held = [], [], 0
        for batch in small_batches(batches, "text"):
            words, _, piece, _, _, _ = _words(batch)
            count = len(words) - size + 1
            if count <= 0:
                continue
            keys = words
            for i in range(1, size - 1):
                keys = _longer(keys[:-1], words[i:])
            often = np.asarray(may_hold(frequent.value, pa.array(signed(keys))))
            at = np.flatnonzero((piece[:count] == piece[size - 1 :]) & often[:-1] & often[1:])
            prefixes.append(keys[at])
            followers.append(words[at + size - 1])
            held += len(at)
            if held >= _HELD:
                yield sent(np.concatenate(prefixes), np.concatenate(followers))
                prefixes, followers, held = [], [], 0
        if held:
            yield sent(np.concatenate(prefixes), np.concatenate(followers))

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("prefix", "next"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(_longer(prefix, word))), batch.column("words"), batch.column("f")], ["key", "words", "f"]
        )


def stripes_of_length(texts: DataFrame, size: int, shorter: DataFrame, least: int, total: int) -> DataFrame:
    """The phrases of ``size`` words that occur ``least`` times or more: (key, words, f), from those of one word less."""
    # the counts of one length sum up to ``total`` at most, so that there are 1,000 hot prefixes at most
    hot = shorter.where(1000 * F.col("f") >= total).select("key").collect()
    hot = np.array([r.key for r in hot], np.int64).view(np.uint64)
    frequent = id_filter(shorter, "key")
    blocks = _BLOCKS_PER_PARTITION * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = (
        texts.mapInArrow(_stripes(size, blocks, frequent, hot), "block int, prefix array<bigint>, next array<bigint>, n array<int>")
        .repartition("block")
        .select("block", F.inline(F.arrays_zip("prefix", "next", "n")))
        .groupBy("block", "prefix", "next")
        .agg(F.sum("n").alias("f"))
        .where(F.col("f") >= least)
    )
    named = added.join(shorter.select(F.col("key").alias("prefix"), F.col("words").alias("before")), "prefix")
    named = named.select("prefix", "next", F.concat("before", F.array("next")).alias("words"), "f")
    found = cut_lineage(named.mapInArrow(_keyed, "key bigint, words array<bigint>, f bigint"))
    frequent.unpersist()
    return found


def _exact(column: str | int) -> Column:
    return (F.lit(column) if isinstance(column, int) else F.col(column)).cast("decimal(19,0)")


def collocations(
    documents: DataFrame, max_words: int = 4, least: int = 30, percent: int = 80, top: int = 2000, scale: int = 2_000_000
) -> DataFrame:
    """The best phrases of each language: rows (lang, rank, phrase, a, l, r, n, score).

    Words stand between spaces and tabs, pieces of text between ``. , ; : ! ?`` and line ends; A-Z count as
    a-z.  A phrase is 2 to ``max_words`` words of one piece that occur together ``least`` times or more in the language,
    overlaps included.  Cut after k words it has a score of scale * a / (l + r), rounded down, from the counts of the whole, the
    beginning and the rest; its lowest score counts, of ties the one with the smallest k.  A phrase is left out if one with
    a further word on either side occurs in ``percent`` hundredths of its places or more.  n is the number of words in the language.
    Ranks go by score, a, and the phrase's bytes.

    A null text has no words, a null language is ``und``; texts that repeat count each time, doc_id and other columns are
    ignored, and an empty table gives no rows.  Products are decimals, so that no count overflows.  Words and phrases are
    told apart by 64-bit hashes.
    """
    bound_batches(documents.sparkSession)
    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    counted = texts.mapInArrow(_vocabulary, "w bigint, lang string, word string, n bigint")
    counted = cut_lineage(
        counted.groupBy("w", "lang", "word").agg(F.sum("n").alias("f")).where(F.col("word").isNull() | (F.col("f") >= least))
    )
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    vocabulary = counted.where("word is not null")
    total = totals.agg(F.sum("n")).first()[0] or 0
    levels = [vocabulary.select(F.col("w").alias("key"), F.array("w").alias("words"), "f")]
    for size in range(2, max_words + 1):
        levels.append(stripes_of_length(texts, size, levels[-1], least, total))

    def part(begin, length) -> Column:
        return F.xxhash64(F.slice("words", begin, length))

    phrases = levels[1]
    longer = None
    for level in levels[2:]:
        phrases = phrases.union(level)
        longer = level if longer is None else longer.union(level)
    phrases = phrases.select("words", F.col("f").alias("a"), F.xxhash64("words").alias("id"))
    counts = phrases.select("id", F.col("a").alias("f")).union(levels[0].select(F.xxhash64("words").alias("id"), "f"))

    kept = phrases
    if longer is not None:
        sides = longer.select(F.explode(F.array(part(1, F.size("words") - 1), part(2, F.size("words") - 1))).alias("id"), "f")
        kept = phrases.join(sides.groupBy("id").agg(F.max("f").alias("most")), "id", "left").where(
            F.col("most").isNull() | (_exact(100) * _exact("most") < _exact(percent) * _exact("a"))
        )
    cuts = (
        kept.select("id", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
        .select("id", "words", "a", "k", part(1, F.col("k")).alias("one"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("two"))
        .join(counts.select(F.col("id").alias("one"), F.col("f").alias("l")), "one")
        .join(counts.select(F.col("id").alias("two"), F.col("f").alias("r")), "two")
        .withColumn("_scaled", _exact(scale) * _exact("a"))
        .withColumn("_both", _exact("l") + _exact("r"))
        .withColumn("score", F.expr("_scaled div _both"))
    )
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("id", "a").agg(least_cut, F.min("words").alias("words"))
    spoken = (
        scored.select("id", F.posexplode("words").alias("at", "w"))
        .join(vocabulary.select("w", "lang", "word"), "w")
        .groupBy("id")
        .agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("said"))
        .select("id", "lang", F.array_join(F.col("said.word"), " ").alias("phrase"))
    )
    order = (F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.join(spoken, "id")
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod("id", F.lit(_SHARES)).alias("share"))
        # the best of a language are among the best of its shares, so that no task ranks all its phrases
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


_PIECES = r"[.,;:!?\x0A-\x0D]"

#: The same with the parameters that are the defaults.
ORACLE = f"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '{_PIECES}')) as piece
    from documents
), w as (
    select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces
), total as (
    select lang, sum(len(w))::bigint as n from w group by lang
), grams as (
    select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) as g
    from w, (values (1), (2), (3), (4)) s(size) where len(w) >= size
), f as (
    select lang, g, count(*)::bigint as f from grams group by all having count(*) >= 30
), sides as (
    select lang, g[1:len(g) - 1] as g, f from f where len(g) > 2
    union all select lang, g[2:len(g)], f from f where len(g) > 2
), most as (
    select lang, g, max(f) as most from sides group by all
), kept as (
    select f.lang, f.g, f.f as a from f left join most using (lang, g)
    where len(f.g) > 1 and (most is null or 100::hugeint * most < 80::hugeint * f.f)
), cuts as (
    select kept.lang, kept.g, a, k, one.f as l, two.f as r, (2000000::hugeint * a // (one.f + two.f))::bigint as score
    from (select *, unnest(range(1, len(g))) as k from kept) kept
    join f one on one.lang = kept.lang and one.g = kept.g[1:k] join f two on two.lang = kept.lang and two.g = kept.g[k + 1:len(kept.g)]
), best as (
    select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank,
       array_to_string(g, ' ') as phrase, a, l, r, n, score
from best join total using (lang) qualify rank <= 2000
"""
