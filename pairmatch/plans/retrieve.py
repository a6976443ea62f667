"""The whole retrieval: hash, find candidates, score, rank and measure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import cut_lineage
from pairmatch.operators.blocks import bucket_measures
from pairmatch.operators.bucketwise import (
    TARGETS_PER_ROW,
    BlockScorer,
    Closeness,
    RowScorer,
    ahead_in_blocks,
    best_in_blocks,
    best_in_task,
    count_in_blocks,
    listed_in_blocks,
    score_rows,
)
from pairmatch.operators.candidates import band_rows
from pairmatch.operators.copies import (
    copy_sets,
    memberships,
    places_in_set,
    set_matches,
    signed_rows,
)
from pairmatch.operators.hashing import HashModel
from pairmatch.operators.klsh import KLSH
from pairmatch.operators.lsh import near_matches, near_probes
from pairmatch.operators.metrics import retrieval_stats, summarize_ranks
from pairmatch.operators.ordering import rank_within, running_total
from pairmatch.operators.pairs import (
    BATCH_SIZE,
    NEGATIVE,
    POSITIVE,
    attach_payload,
    batch_index,
    batched,
    pack_labelled,
    relevant_positions,
)
from pairmatch.operators.placed import placed_pairs
from pairmatch.operators.prefixes import first_shared_key, split_keys, split_set_matches
from pairmatch.operators.skew import split_join
from pairmatch.sources.store import BATCHES_PER_FOLDER, read_pair_batches, write_pair_batches


# exp(-|a - b|^2), which needs no training
by_closeness = Closeness()


@dataclass
class Retrieval:
    """A retrieval whose stages are computed once, when first asked for.

    ``index`` and ``queries`` are (id, vec), ``truth`` is (query_id, truth_id) with any number
    of originals per query, or None.  Candidates are searched, scored and ranked between distinct
    vectors; copies enter as weights.  Among equal scores, distinct vectors go by their
    smallest id and copies by their own.  ``search`` finds pairs of distinct vectors and
    ``scorer`` adds ``score`` to pairs with ``query_vec`` and ``cand_vec``, by an expression
    or a trained model.

    Counts, the best candidates and ranks are found bucket by bucket without a table of pairs: the search compares
    block against block and only what is left of a block leaves its task.  A ``BlockScorer`` scores there, a ``RowScorer``
    scores all pairs of a block there for the best candidates, any other scorer gets the pairs of a block as a stream of rows; only ranks by such a scorer, a search of one's own
    and ``target`` need all scored pairs as a table, like ``pairs``.

    With ``target``, the buckets of a band are split by further bits until at most that many different
    signatures of the index share one, so candidates per query stay bounded while the index grows.
    """

    model: HashModel
    layout: BandLayout
    index: DataFrame
    queries: DataFrame
    truth: DataFrame | None = None
    scorer: Callable[[DataFrame], DataFrame] = by_closeness
    search: Callable[[DataFrame, DataFrame, BandLayout], DataFrame] = set_matches
    target: int | None = None

    def __post_init__(self) -> None:
        if self.target is not None and self.search is not set_matches:
            raise ValueError("split buckets are a search of their own")
        if self.truth is None:
            self.truth = self.queries.select(F.col("id").alias("query_id"), F.col("id").alias("truth_id")).limit(0)
        self.truth = self.truth.select("query_id", "truth_id").where("truth_id is not null").distinct()

    @cached_property
    def _index_rows(self) -> DataFrame:
        return cut_lineage(signed_rows(self.index, self.model, self.layout))

    @cached_property
    def _query_rows(self) -> DataFrame:
        return cut_lineage(signed_rows(self.queries, self.model, self.layout))

    @cached_property
    def _index_sets(self) -> DataFrame:
        return cut_lineage(copy_sets(self._index_rows))

    @cached_property
    def _query_sets(self) -> DataFrame:
        return cut_lineage(copy_sets(self._query_rows))

    @cached_property
    def _bucket_keys(self) -> DataFrame:
        return split_keys(self._index_sets, self._query_sets, self.layout, self.target)

    @cached_property
    def matches(self) -> DataFrame:
        """(query_gid, cand_gid, copies): pairs of distinct vectors found by the search."""
        if self._in_blocks and self.search is set_matches and "scored" in self.__dict__:
            return self.scored.select("query_gid", "cand_gid", "copies")
        if self.target is not None:
            return cut_lineage(
                split_set_matches(self._index_sets, self._query_sets, self._bucket_keys, self.layout)
            )
        return cut_lineage(self.search(self._index_sets, self._query_sets, self.layout))

    @cached_property
    def _query_members(self) -> DataFrame:
        """(query_id, query_gid, query_sig) of every query."""
        return memberships(self._query_rows, self._query_sets).select(
            F.col("id").alias("query_id"), F.col("gid").alias("query_gid"), F.col("sig").alias("query_sig")
        )

    @cached_property
    def _found(self) -> DataFrame:
        """(query_id, query_gid, truth_id, truth_gid): originals that share a band with their query.

        Whether they do can be read off the two signatures, without looking at candidates.
        """
        wanted = self.truth.select(F.col("truth_id").alias("id"))
        originals = memberships(
            self._index_rows.join(wanted, "id", "left_semi"), self._index_sets
        ).select(
            F.col("id").alias("truth_id"), F.col("gid").alias("truth_gid"), F.col("sig").alias("truth_sig")
        )
        found = self._query_members.join(self.truth, "query_id").join(originals, "truth_id")
        if self.target is None:
            shared = self.layout.first_shared_band(F.col("query_sig"), F.col("truth_sig"))
        else:
            for side in ("query", "truth"):
                keys = self._bucket_keys.select(F.col("sig").alias(f"{side}_sig"), F.col("keys").alias(f"{side}_keys"))
                found = found.join(keys, f"{side}_sig")
            shared = first_shared_key(F.col("query_keys"), F.col("truth_keys"), self.layout)
        return cut_lineage(
            found.where(shared.isNotNull()).select("query_id", "query_gid", "truth_id", "truth_gid")
        )

    def _copies_of(self, gids: DataFrame) -> DataFrame:
        """(id, gid, sig, copies) of the index rows in those of the sets that have copies."""
        several = self._index_sets.where(F.col("copies") > 1).join(gids, "gid", "left_semi")
        return memberships(self._index_rows, several)

    def counts(self) -> DataFrame:
        """(query_id, n_candidates, hits) of every query; hits are the originals it found."""
        if self._in_buckets and "matches" not in self.__dict__:
            met = count_in_blocks(*self._sides(vectors=False), self.layout, self._rows_in_bands)
            per_set = met.groupBy("query_gid").agg(F.sum("n").alias("n_candidates"))
        else:
            per_set = self.matches.groupBy("query_gid").agg(F.sum("copies").alias("n_candidates"))
        hits = self._found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
        return (
            self._query_members.select("query_id", "query_gid")
            .join(per_set, "query_gid", "left")
            .join(hits, "query_id", "left")
            .select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "hits")])
        )

    def stats(self, mode: str = "pc") -> DataFrame:
        """Share of queries with candidates, mean candidates and recall.

        Recall is of queries that found an original (``pc``) or of index rows found as one (``cp``).
        """
        return retrieval_stats(self.counts(), mode, self.index.count() if mode == "cp" else None)

    @property
    def _in_buckets(self) -> bool:
        """Whether candidates are what falls in the same buckets, so that blocks can be compared."""
        one_bit_off = self.search is near_matches and self.layout.bands == 1
        return self.target is None and (self.search is set_matches or one_bit_off)

    @property
    def _in_blocks(self) -> bool:
        return self._in_buckets and isinstance(self.scorer, BlockScorer) and self.scorer.works_on_tiles

    @cached_property
    def _rows_in_bands(self) -> int:
        """About how many rows both sides have in all bands."""
        asked = self._query_sets.count() * (1 if self.search is set_matches else self.layout.bits + 1)
        return (self._index_sets.count() + asked) * self.layout.bands

    def _with_vectors(self) -> tuple[DataFrame, DataFrame]:
        """(query_gid, sig, vec) and (cand_gid, sig, copies, vec)."""
        queries, index = (df.select(F.col("id").alias("gid"), "vec") for df in (self.queries, self.index))
        return (
            self._query_sets.join(queries, "gid").select(F.col("gid").alias("query_gid"), "sig", "vec"),
            self._index_sets.join(index, "gid").select(F.col("gid").alias("cand_gid"), "sig", "copies", "vec"),
        )

    def _sides(self, vectors: bool = True, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows of both sides for each band, or for the queries ``asked``, which have more columns."""
        if vectors:
            lefts, rights = self._with_vectors()
        else:
            lefts = self._query_sets.select(F.col("gid").alias("query_gid"), "sig")
            rights = self._index_sets.select(F.col("gid").alias("cand_gid"), "sig", "copies")
        if asked is not None:
            lefts = lefts.join(asked, "query_gid", "left")
        if self.search is near_matches:
            lefts = near_probes(lefts, self.layout)
        return band_rows(lefts, self.layout), band_rows(rights, self.layout)

    @cached_property
    def scored(self) -> DataFrame:
        """(query_gid, cand_gid, copies, score): every candidate pair of distinct vectors."""
        if self._in_blocks and self.search is set_matches:
            measured = bucket_measures(
                self._index_sets.join(self.index.select(F.col("id").alias("gid"), "vec"), "gid"),
                self._query_sets.join(self.queries.select(F.col("id").alias("gid"), "vec"), "gid"),
                self.layout,
                self.scorer.rows,
            )
            return cut_lineage(measured.withColumnRenamed("measure", "score"))
        pairs = attach_payload(
            self.matches.select(F.col("query_gid").alias("query_id"), F.col("cand_gid").alias("cand_id"), "copies"),
            self.queries, self.index,
        ).withColumnsRenamed({"query_id": "query_gid", "cand_id": "cand_gid"})
        return cut_lineage(self.scorer(pairs).select("query_gid", "cand_gid", "copies", "score"))

    def _ahead(self) -> tuple[DataFrame, DataFrame]:
        """(query_gid, truth_gid, ahead): copies before the originals found, and (query_gid) of queries with candidates."""
        if not self._in_blocks or self.search is not set_matches or "scored" in self.__dict__:
            total = running_total(
                self.scored, ["query_gid"], [F.desc("score"), F.asc("cand_gid")], "copies", "ahead"
            )
            return (
                total.select("query_gid", F.col("cand_gid").alias("truth_gid"), "ahead"),
                self.matches.select("query_gid").distinct(),
            )
        queries, index = self._with_vectors()
        wanted = self._found.select("query_gid", F.col("truth_gid").alias("cand_gid")).distinct()
        pairs = (
            wanted.join(queries.withColumnsRenamed({"sig": "_qsig", "vec": "query_vec"}), "query_gid")
            .join(index.withColumnsRenamed({"sig": "_csig", "vec": "cand_vec"}), "cand_gid")
            .where(self.layout.first_shared_band(F.col("_qsig"), F.col("_csig")).isNotNull())
            .select("query_gid", "cand_gid", "copies", "query_vec", "cand_vec")
        )
        targets = cut_lineage(score_rows(pairs, self.scorer).withColumn("tid", F.monotonically_increasing_id()))
        # a query may have any number of originals, a row of it has a few
        numbered = rank_within(targets.select("query_gid", "cand_gid", "score", "tid"), ["query_gid"], ["tid"], "_nth")
        asked = numbered.groupBy("query_gid", F.floor((F.col("_nth") - 1) / TARGETS_PER_ROW).alias("_part")).agg(
            F.collect_list(F.struct("tid", F.col("cand_gid").alias("gid"), "score")).alias("targets")
        )
        met = cut_lineage(
            ahead_in_blocks(*self._sides(asked=asked.drop("_part")), self.layout, self.scorer, self._rows_in_bands)
            .groupBy("query_gid", "tid")
            .agg(F.sum("ahead").alias("ahead"))
        )
        # an original that is there several times, if ids are
        tied = running_total(targets, ["query_gid", "cand_gid", "score"], ["tid"], "copies", "_tied")
        ahead = tied.join(met.where("tid is not null").select("tid", "ahead"), "tid", "left").select(
            "query_gid", F.col("cand_gid").alias("truth_gid"), (F.coalesce("ahead", F.lit(0)) + F.col("_tied")).alias("ahead")
        )
        return ahead, met.select("query_gid").distinct()

    def query_ranks(self, k: int = 3) -> DataFrame:
        """(query_id, first_rank, mean_reciprocal, top_hits) of queries with candidates."""
        ahead, some = self._ahead()
        originals = self._found.select(F.col("truth_gid").alias("gid"))
        places = places_in_set(self._copies_of(originals)).withColumnRenamed("id", "truth_id")
        rank = F.col("ahead") + F.coalesce("place", F.lit(0)) + 1
        per_query = (
            self._found.join(ahead, ["query_gid", "truth_gid"])
            .join(places, "truth_id", "left")
            .groupBy("query_id")
            .agg(
                F.min(rank).alias("first_rank"),
                F.avg(1.0 / rank).alias("mean_reciprocal"),
                F.count_if(rank <= k).alias("top_hits"),
            )
        )
        return (
            self._query_members.join(some, "query_gid", "left_semi")
            .select("query_id")
            .join(per_query, "query_id", "left")
            .na.fill(0, ["top_hits"])
        )

    def metrics(self, mode: str = "cp", k: int = 3) -> DataFrame:
        return summarize_ranks(self.query_ranks(k), mode, k)

    def _near_best(self, k: int) -> DataFrame:
        """Rows of ``scored`` that have the ``k`` best of every query among them."""
        if "scored" in self.__dict__ or not self._in_buckets:
            return self.scored
        if self._in_blocks or (isinstance(self.scorer, RowScorer) and not isinstance(self.scorer, BlockScorer)):
            return best_in_blocks(*self._sides(), self.layout, self.scorer, k, self._rows_in_bands)
        pairs = listed_in_blocks(*self._sides(), self.layout, self._rows_in_bands)
        return best_in_task(self.scorer(pairs), k)

    def top(self, k: int = 10) -> DataFrame:
        """(query_id, cand_id, label, score, rank): the best ``k`` candidates of every query.

        The best k ids are among the k first ids of the k best distinct vectors, so every
        step keeps at most that many and each task drops the rest before its shuffle.
        """
        best = Window.partitionBy("query_gid").orderBy(F.desc("score"), "cand_gid")
        sets = cut_lineage(
            self._near_best(k).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        )
        by_id = Window.partitionBy("gid").orderBy("id")
        members = (
            self._copies_of(sets.select(F.col("cand_gid").alias("gid")))
            .select("gid", "id")
            .withColumn("_m", F.row_number().over(by_id))
            .where(F.col("_m") <= k)
            .select(F.col("gid").alias("cand_gid"), F.col("id").alias("member"))
        )
        within = Window.partitionBy("query_gid").orderBy(F.desc("score"), "cand_gid", "cand_id")
        listed = (
            sets.join(members, "cand_gid", "left")
            .select(
                "query_gid", "cand_gid", "score",
                # a vector without copies is named by its only id
                F.coalesce("member", "cand_gid").alias("cand_id"),
            )
            .withColumn("rank", F.row_number().over(within))
            .where(F.col("rank") <= k)
        )
        positive = self.truth.select("query_id", F.col("truth_id").alias("cand_id"), F.lit(POSITIVE).alias("label"))
        return (
            self._query_members.select("query_id", "query_gid")
            .join(listed, "query_gid")
            .join(positive, ["query_id", "cand_id"], "left")
            .select("query_id", "cand_id", F.coalesce("label", F.lit(NEGATIVE)).alias("label"), "score", "rank")
        )

    def _with_ids(self) -> tuple[DataFrame, DataFrame]:
        """(gid, sig, vec) of all ids of both sides: a vector is there for each of its copies, named by the copy's id."""
        sides = []
        for rows, sets, given in (
            (self._query_rows, self._query_sets, self.queries), (self._index_rows, self._index_sets, self.index)
        ):
            vectors = given.select(F.col("id").alias("gid"), "vec")
            sides.append(memberships(rows, sets).join(vectors, "gid").select(F.col("id").alias("gid"), "sig", "vec"))
        return sides[0], sides[1]

    def _id_pairs(self) -> DataFrame:
        """(query_id, cand_id, score): every candidate pair of ids.

        Blocks are compared by id, as each pair of ids is a row in the end, so no pair is joined or stored on the way.
        """
        if self._in_blocks and self.search is set_matches:
            queries, index = self._with_ids()
            measured = bucket_measures(index.withColumn("copies", F.lit(1).cast("bigint")), queries, self.layout, self.scorer.rows)
            return measured.select(
                F.col("query_gid").alias("query_id"), F.col("cand_gid").alias("cand_id"), F.col("measure").alias("score")
            )
        asked = cut_lineage(
            split_join(
                self._query_members.select("query_id", "query_gid"), self.scored,
                ["query_gid"], left_id=["query_id"], right_id=["cand_gid"],
            ).select("query_id", "cand_gid", "copies", "score")
        )
        # a vector without copies is named by its only id
        single = asked.where("copies = 1").select("query_id", F.col("cand_gid").alias("cand_id"), "score")
        several = asked.where("copies > 1").select("query_id", "cand_gid", "score")
        members = self._copies_of(several.select(F.col("cand_gid").alias("gid"))).select(
            F.col("gid").alias("cand_gid"), F.col("id").alias("cand_id")
        )
        copied = split_join(several, members, ["cand_gid"], left_id=["query_id"], right_id=["cand_id"])
        return single.unionByName(copied.select("query_id", "cand_id", "score"))

    def pairs(self) -> DataFrame:
        """(query_id, cand_id, label, score): every candidate pair of ids, labelled 1 if it is in ``truth``, else 0.

        Copies are written out here and only here, so there are as many rows as ``counts`` adds up to.  A vector
        with very many copies on either side is split over several tasks.
        """
        positive = self.truth.select("query_id", F.col("truth_id").alias("cand_id"), F.lit(POSITIVE).alias("label"))
        return (
            self._id_pairs()
            .join(positive, ["query_id", "cand_id"], "left")
            .select("query_id", "cand_id", F.coalesce("label", F.lit(NEGATIVE)).alias("label"), "score")
        )

    def write_batches(self, path: str, size: int = BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
        """Write all candidate pairs as labelled, numbered batches of ``size``; (ranges, positions) of the queries in them.

        Ranges are those of ``batch_index``, positions those of ``relevant_positions``, both read off the stored
        batches; queries without candidates have neither.  ``read_pair_batches`` reads the pairs back.  Pairs that are found
        in blocks get their places from counts and are never sorted as pairs; their scores are stored as 32-bit floats, as they are read.
        """
        if self._in_blocks and self.search is set_matches:
            queries, index = self._with_ids()
            pairs, per_task = placed_pairs(index, queries, self.truth, self.layout, self.scorer)
            folders = 2 + per_task // (size * BATCHES_PER_FOLDER)
            write_pair_batches(batched(pairs, size), path, folders_in_task=folders)
        else:
            write_pair_batches(pack_labelled(self._id_pairs(), self.truth, size), path)
        stored = read_pair_batches(self.index.sparkSession, path)
        return batch_index(stored, size), relevant_positions(stored)


def retrieve(
    index: DataFrame,
    queries: DataFrame,
    truth: DataFrame | None = None,
    p: int = 300,
    t: int = 30,
    b: int = 180,
    r: int = 9,
    seed: int = 0,
    scorer: Callable[[DataFrame], DataFrame] = by_closeness,
    target: int | None = None,
) -> Retrieval:
    """Fit the hash on the index and set up the retrieval of all queries."""
    model = KLSH(p, t, b, seed).fit(index)
    return Retrieval(model, model.layout(r), index, queries, truth, scorer, target=target)
