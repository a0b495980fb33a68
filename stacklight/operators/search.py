"""Exact search: an ISBN probe, else two-stage trigram search over a stored index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import isbn_shaped, similarity
from . import gram_index
from .catalog import live, scope
from .gram_index import GramIndex
from .state import checkpoint

#: Cells of the matrices that one step of word_similarities() fills.
CELLS = 2_000_000


def _offsets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of the row of each element of a column of lists, and its place in its row."""
    size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def word_similarities(queries: pa.Array, targets: pa.Array) -> np.ndarray:
    """For each pair of a query's distinct grams and a target's grams in order: the most that the query shares with a contiguous
    extent of the target, over the different grams of both.

    All pairs go together. A gram of an extent counts where it didn't stand in the extent before, so the counts of the extents that
    begin at one place are running sums; a step does one beginning for all pairs."""
    q_row, _ = _offsets(queries)
    t_row, t_at = _offsets(targets)
    if not len(q_row) or not len(t_row):
        return np.zeros(len(targets))
    code = pa.chunked_array([queries.flatten(), targets.flatten()]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    q_code, t_code = code[: len(q_row)], code[len(q_row) :]
    n = int(code.max(initial=0)) + 1
    wanted = np.isin(t_row * n + t_code, q_row * n + q_code)
    # where the same gram stood last in its target, -1 if nowhere
    order = np.argsort(t_row * n + t_code, kind="stable")
    same = np.append(False, np.diff((t_row * n + t_code)[order]) == 0)
    before = np.full(len(t_row), -1, np.int64)
    before[order[same]] = t_at[order[np.flatnonzero(same) - 1]]

    size, n_query = np.bincount(t_row, minlength=len(targets)), np.bincount(q_row, minlength=len(queries))
    start, best = np.cumsum(size) - size, np.zeros(len(targets))
    by_size, lo = np.argsort(size, kind="stable")[::-1], 0
    while lo < len(by_size) and size[by_size[lo]]:
        width = int(size[by_size[lo]])
        some = by_size[lo : lo + max(1, CELLS // width)]  # pairs of like lengths
        lo += len(some)
        at = start[some][:, None] + np.arange(width)
        inside = np.arange(width) < size[some][:, None]
        at = np.where(inside, at, 0)
        hit, last = wanted[at] & inside, before[at]
        for i in range(width):
            rows = np.flatnonzero(hit[:, i])
            if not len(rows):
                continue
            new = (last[rows, i:] < i) & inside[rows, i:]
            both = np.cumsum(new & hit[rows, i:], 1)
            score = np.where(hit[rows, i:], both / (n_query[some[rows]][:, None] + np.cumsum(new, 1) - both), 0.0)
            best[some[rows]] = np.maximum(best[some[rows]], score.max(1))
    return best


def trigram_candidates(queries: DataFrame, index: GramIndex, least: float = 0.3) -> DataFrame:
    """queries (query) -> query, id, field, shared, n, n_query where the field holds at least `least` of the query's trigrams."""
    found = gram_index.candidates(gram_index.asked(queries), index, least)
    return found.select("query", "id", F.when(F.col("is_title"), "title").otherwise("authors").alias("field"), F.col("shared").cast("long").alias("shared"), "n", F.size("query_grams").alias("n_query"))


def search_exact(queries: DataFrame, works: DataFrame, limit: int = 20, source_id: int | None = None, word_floor: float = 0.6, plain_floor: float = 0.3, floor: float = 0.45, index: GramIndex | None = None) -> DataFrame:
    """queries (query) -> query, id, score, rank. An ISBN hit scores 1.0 and shuts out the fuzzy search; else the better of the
    word similarities to title and authors, if one reaches word_floor, or plain similarity to the title plain_floor, and `floor`.
    source_id: of one source's works only. index: that of all works, built for the call if none is given.

    Word similarity is at most the share of the query's trigrams that a field holds, so only fields that hold `floor` are scored."""
    rows = scope(live(works), source_id)
    isbn = queries.withColumn("isbn", isbn_shaped(F.col("query"))).where("isbn is not null")
    hits = isbn.join(rows.select("id", F.explode("isbns").alias("isbn")), "isbn").select("query", "id", F.lit(1.0).alias("score")).distinct()
    rest = queries.join(hits.select("query").distinct(), "query", "left_anti")
    index = index or gram_index.build(works)
    found = gram_index.candidates(gram_index.asked(rest), index, floor, source_id)

    def score(batches):
        for b in batches:
            s = word_similarities(b.column("query_grams"), b.column("grams"))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), b.column("plain"), pa.array(s)], names=["query", "id", "plain", "score"])

    # the title's plain similarity goes along; a work whose title holds too few of the grams can't reach it
    plain = F.when(F.col("is_title"), similarity(F.col("query_grams"), F.array_distinct("grams")))
    scored = found.select("query", "query_grams", "id", "grams", plain.alias("plain")).mapInArrow(score, f"query string, id {works.schema['id'].dataType.simpleString()}, plain double, score double")
    # written, since three branches read it: the scores are computed once
    best = checkpoint(scored.groupBy("query", "id").agg(F.max("score").alias("score"), F.max("plain").alias("plain")).where(F.col("score") >= floor), "scored")
    sure = best.where(F.col("score") >= word_floor).drop("plain")
    # plain similarity is at most the share of the query's grams that the title holds, but a field of the authors may have found it
    doubtful = best.where(F.col("score") < word_floor)
    titles = index.fields.where("is_title").select("id", "grams")
    known = doubtful.where("plain IS NOT NULL").select("query", "id", "score", "plain")
    asked = gram_index.asked(rest).select("query", F.col("grams").alias("query_grams"))
    looked = doubtful.where("plain IS NULL").drop("plain").join(titles, "id").join(asked, "query").select("query", "id", "score", similarity(F.col("query_grams"), F.array_distinct("grams")).alias("plain"))
    other = known.unionByName(looked).where(F.col("plain") >= plain_floor).drop("plain")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = sure.unionByName(other).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.unionByName(hits.withColumn("rank", F.row_number().over(w)))
