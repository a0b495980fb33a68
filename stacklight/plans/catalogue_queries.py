"""Registered queries over the catalogue operators, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, sql
from ..functions import text as T
from ..operators import catalog, evaluation, factors, interactions, marc, merge, rank, search, vectors
from ..operators.state import new_path
from ..streaming import feed
from . import adapters as A
from .registry import query

# vectors -----------------------------------------------------------------------------------------------------------


def _probes(spark, sf_dir):
    """The stated probes: every tenth live work."""
    e = A.live_embeddings(spark, sf_dir).where("work_id % 10 = 0")
    return e.select(F.col("work_id").alias("probe"), F.col("vector").alias("probe_vector"), F.col("source_id").alias("probe_source"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_SCORED = "scored AS (SELECT probe, work_id, source_id, list_dot_product(vector, probe_vector) AS score, is_title_only FROM lemb, probes WHERE work_id <> probe{mask}), ranked AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, work_id) AS rank FROM scored) "
_TOP = "SELECT probe, work_id, CAST(source_id AS BIGINT) AS source_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"


@query(A.with_("probes").rstrip() + ", " + _SCORED.format(mask=" AND source_id = probe_source") + _TOP)
def similar_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.similar(_probes(spark, sf_dir), A.live_blocks(spark, sf_dir), 10), "score")


@query(A.with_("probes").rstrip() + ", " + _SCORED.format(mask=" AND NOT is_title_only") + _TOP)
def similar_cross_source(spark, sf_dir):
    return _rounded(vectors.similar(_probes(spark, sf_dir), A.live_blocks(spark, sf_dir), 10, cross_source=True, exclude_title_only=True), "score")


_RERANK = (
    A.with_("probes", "lfac").rstrip()
    + ", "
    + _SCORED.format(mask=" AND source_id = probe_source").rstrip()
    + ", pool AS (SELECT r.probe, r.work_id, r.score AS content_score, f.factors, f.n_patrons, q.factors AS pf, q.n_patrons AS pn FROM ranked r LEFT JOIN lfac f ON f.work_id = r.work_id LEFT JOIN lfac q ON q.work_id = r.probe WHERE rank <= 50), "
    "owned AS (SELECT *, CASE WHEN factors IS NOT NULL AND n_patrons >= {floor} AND pf IS NOT NULL AND pn >= {floor} THEN list_dot_product(factors, pf) END AS own FROM pool), "
    "counted AS (SELECT *, count(own) OVER (PARTITION BY probe) AS n_scored, quantile_cont(own, 0.5) OVER (PARTITION BY probe) AS fallback FROM owned), "
    "blended AS (SELECT *, CASE WHEN n_scored >= 3 THEN (0.7 * content_score + 0.3 * coalesce(own, fallback)) / (0.7 + 0.3) ELSE content_score END AS score FROM counted), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, content_score DESC, work_id) AS rank FROM blended) "
)
_RERANK_OUT = "SELECT probe, work_id, round(content_score, 6) AS content_score, round(score, 6) AS score, CASE WHEN n_scored >= 3 THEN round(own, 6) END AS collaborative_score, CASE WHEN n_scored >= 3 AND own IS NOT NULL THEN 'hybrid' ELSE 'content' END AS signal, rank FROM placed WHERE rank <= 10"


def _reranked(spark, sf_dir, weights):
    pool = vectors.similar(_probes(spark, sf_dir), A.live_blocks(spark, sf_dir), weights.pool)
    fac = A.live_factors(spark, sf_dir)
    candidates = pool.join(fac, "work_id", "left").select("probe", "work_id", F.col("score").alias("content_score"), "factors", "n_patrons")
    own = fac.where("work_id % 10 = 0").select(F.col("work_id").alias("probe"), F.col("factors").alias("probe_vector"), F.col("n_patrons").alias("probe_patrons"))
    return rank.rerank(candidates, own, weights)


@query(_RERANK.replace("{floor}", "3") + _RERANK_OUT)
def similar_hybrid(spark, sf_dir):
    return _rounded(_reranked(spark, sf_dir, rank.Weights()), "content_score", "score", "collaborative_score")


@query(_RERANK.replace("{floor}", "7") + _RERANK_OUT)
def similar_abstain(spark, sf_dir):
    """No work has seven patrons behind it: content order stands."""
    return _rounded(_reranked(spark, sf_dir, rank.Weights(min_patrons=7)), "content_score", "score", "collaborative_score")


_HEADED = "SELECT *, CASE WHEN n_scored >= 3 AND own IS NOT NULL THEN 'hybrid' ELSE 'content' END AS signal FROM placed WHERE rank <= 10"


@query(_RERANK.replace("{floor}", "3") + "SELECT probe, count(*) FILTER (WHERE signal = 'hybrid') AS hybrid_count, bool_or(score <> content_score) AS collaborative_applied, bool_and(signal = 'hybrid') AS borrowed FROM (" + _HEADED + ") GROUP BY probe")
def borrowed_heading(spark, sf_dir):
    return rank.borrowed_heading(_reranked(spark, sf_dir, rank.Weights()))


@query(_RERANK.replace("{floor}", "3") + "SELECT probe, string_agg(work_id || ':' || signal || ':' || split_part(source_record_id, ':', -1) || ':' || title, '|' ORDER BY rank) AS results, count(*) FILTER (WHERE signal = 'hybrid') AS hybrid_count, bool_or(score <> content_score) AS collaborative_applied FROM (" + _HEADED + ") h JOIN live ON live.id = h.work_id GROUP BY probe")
def similar_payloads(spark, sf_dir):
    """The answer of the similarity read: payloads in order with their signals, and what the heading needs."""
    summary = catalog.work_summary(A.works(spark, sf_dir).withColumn("score", F.lit(None).cast("double")), A.items(spark, sf_dir), A.sources(spark, sf_dir))
    out = catalog.similar_payload(_reranked(spark, sf_dir, rank.Weights()), summary)
    shown = F.transform("results", lambda r: F.concat_ws(":", r["id"], r["signal"], r["biblionumber"], r["title"]))
    return out.select("probe", F.array_join(shown, "|").alias("results"), "hybrid_count", "collaborative_applied")


_KEYED = "keys AS (SELECT id AS work_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^(the|a|an|le|la|les|un|une|des) ', '') || '|' || trim(regexp_replace(regexp_replace(lower(authors[1]), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM (SELECT id, 'The ' || split_part(title, ' ', 1) AS title, [split_part(publisher, '#', 1)] AS authors FROM live))"
_SEMANTIC = A.with_("probes").rstrip() + ", " + _SCORED.format(mask="").rstrip() + ", " + _KEYED + ", best AS (SELECT probe, work_id, score, rank, key FROM ranked JOIN keys USING (work_id) WHERE rank <= 40 AND score >= 0.1), kept AS (SELECT probe, work_id, score, key FROM (SELECT *, row_number() OVER (PARTITION BY probe, key ORDER BY rank) AS e FROM best) WHERE e = 1), out AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, work_id) AS rank FROM kept) "


def _keys(spark, sf_dir):
    """Keys that editions share: of the first word of the title, behind an article, and the maker's name without its number."""
    w = catalog.live(A.works(spark, sf_dir))
    title, author = F.concat(F.lit("The "), F.split_part("title", F.lit(" "), F.lit(1))), F.split_part("publisher", F.lit("#"), F.lit(1))
    return w.select(F.col("id").alias("work_id"), T.canonical_key(title, F.array(author)).alias("key"))


@query(_SEMANTIC + "SELECT probe, work_id, key, round(score, 6) AS score, rank FROM out WHERE rank <= 10")
def semantic_topk_floor(spark, sf_dir):
    out = vectors.semantic_search(_probes(spark, sf_dir), A.live_blocks(spark, sf_dir), _keys(spark, sf_dir), min_score=0.1, cross_source=True)
    return _rounded(out.select("probe", "work_id", "key", "score", "rank"), "score")


@query(_SEMANTIC + "SELECT probe, work_id, round(score, 6) AS score FROM out WHERE rank <= 10 AND work_id % 5 <> 0")
def already_shown_anti(spark, sf_dir):
    shown = A.embeddings(spark, sf_dir).where("work_id % 5 = 0").select("work_id")
    return catalog.already_shown(semantic_topk_floor(spark, sf_dir), shown).select("probe", "work_id", "score")


def _tier_sql() -> str:
    def part(n: int, wanted: int, floor: float, where: str) -> str:
        return (
            f"best{n} AS (SELECT probe, work_id, score, rank, key FROM ranked JOIN keys USING (work_id) WHERE rank <= {4 * wanted} AND score >= {floor} AND {where}), "
            f"kept{n} AS (SELECT probe, work_id, score FROM (SELECT *, row_number() OVER (PARTITION BY probe, key ORDER BY rank) AS e FROM best{n}) WHERE e = 1), "
            f"out{n} AS (SELECT probe, work_id, score FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, work_id) AS place FROM kept{n}) WHERE place <= {wanted})"
        )

    head = A.with_("probes").rstrip() + ", " + _SCORED.format(mask="").rstrip() + ", " + _KEYED + ", " + part(1, 5, 0.1, "probe % 20 = 0") + ", " + part(2, 15, 0.15, "probe % 20 <> 0")
    return head + ", every AS (SELECT probe, 'rescue' AS tier, work_id, score FROM out1 UNION ALL SELECT probe, 'related', work_id, score FROM out2 WHERE work_id % 5 <> 0), placed AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, work_id) AS rank FROM every) SELECT probe, tier, work_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5"


@query(_tier_sql())
def search_tiers(spark, sf_dir):
    """Rescue where the catalogue found nothing (every other probe), else related works without those that the page shows."""
    ids = A.live_embeddings(spark, sf_dir).where("work_id % 5 = 0").agg(F.collect_set("work_id").alias("shown"))
    probes = _probes(spark, sf_dir).withColumn("hits", F.when(F.col("probe") % 20 == 0, 0).otherwise(1)).crossJoin(ids)  # one row
    return _rounded(vectors.tiers(probes, A.live_blocks(spark, sf_dir), _keys(spark, sf_dir), 5, 0.1), "score")


@query(A.with_("emb") + "SELECT work_id, round(list_sum(list_transform(vector, lambda x: x * x)), 6) AS norm2 FROM emb")
def vector_normalize(spark, sf_dir):
    e = A.embeddings(spark, sf_dir).withColumn("vector", vectors.normalize(F.col("vector")))
    return e.select("work_id", F.round(vectors.dot(F.col("vector"), F.col("vector")), 6).alias("norm2"))


# catalogue ---------------------------------------------------------------------------------------------------------

_SUMMARY = A.with_("sources", "live", "items") + "SELECT w.id, source_id, s.name AS source_name, source_record_id, split_part(source_record_id, ':', -1) AS biblionumber, title, publisher, publication_year, authors, coalesce(list_transform(languages, lambda x: trim(x)), CAST([] AS VARCHAR[])) AS languages, coalesce(subjects, CAST([] AS VARCHAR[])) AS subjects, isbns, coalesce(n, 0) AS copies_total, coalesce(a, 0) AS copies_available, coalesce(last_had_items, true) OR coalesce(n, 0) > 0 AS has_holdings FROM live w LEFT JOIN (SELECT work_id, count(*) AS n, count(*) FILTER (WHERE due_date IS NULL) AS a FROM items GROUP BY 1) i ON i.work_id = w.id JOIN sources s ON s.id = source_id"


@query(_SUMMARY)
def work_summary(spark, sf_dir):
    return catalog.work_summary(A.works(spark, sf_dir), A.items(spark, sf_dir), A.sources(spark, sf_dir))


@query("SELECT * FROM (" + _SUMMARY + ") WHERE id = 42")
def one_work(spark, sf_dir):
    return catalog.work(A.works(spark, sf_dir), A.items(spark, sf_dir), A.sources(spark, sf_dir), 42)


@query("SELECT id, json_object('id', id, 'biblionumber', biblionumber, 'source', source_name, 'available', CASE WHEN has_holdings THEN copies_available ELSE -1 END, 'year', publication_year) AS payload FROM (" + _SUMMARY + ")")
def work_payload(spark, sf_dir):
    """Fields of the JSON payloads, the nested ones included; no availability reads as -1."""
    rows = catalog.payload(work_summary(spark, sf_dir))
    get = lambda path: F.get_json_object("payload", path)
    fields = F.struct(get("$.id").cast("long").alias("id"), get("$.biblionumber").alias("biblionumber"), get("$.source.name").alias("source"), F.coalesce(get("$.availability.available").cast("long"), F.lit(-1)).alias("available"), get("$.publication_year").cast("int").alias("year"))
    return rows.select("id", F.to_json(fields).alias("payload"))


@query(A.with_("live") + ", wanted AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'CAT-' || p_brand || ':' || p_partkey END AS query FROM part WHERE p_partkey % 5 = 0) SELECT query, min(id) AS id FROM wanted JOIN live ON query = source_record_id OR (regexp_full_match(query, '[0-9]+') AND ends_with(source_record_id, ':' || query)) GROUP BY query HAVING count(*) = 1")
def record_id_lookup(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").where("p_partkey % 5 = 0")
    key = F.col("p_partkey").cast("string")
    wanted = p.select(F.when(F.col("p_partkey") % 2 == 0, key).otherwise(F.concat(F.lit("CAT-"), "p_brand", F.lit(":"), key)).alias("query")).distinct()
    return catalog.by_record_id(A.works(spark, sf_dir), wanted)


@query(A.with_("live") + ", own AS (SELECT * FROM live WHERE source_id = 2), wanted AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS query FROM part WHERE p_partkey % 5 = 0) SELECT query, min(id) AS id FROM wanted JOIN own ON ends_with(source_record_id, ':' || query) GROUP BY query HAVING count(*) = 1")
def record_id_in_source(spark, sf_dir):
    wanted = A.table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("query")).distinct()
    return catalog.by_record_id(A.works(spark, sf_dir), wanted, source_id=2)


@query(A.with_("sources", "live") + "SELECT s.id, any_value(s.name) AS name, count(DISTINCT w.id) AS works, count(DISTINCT e.vec_id) AS embedded, count(DISTINCT CASE WHEN e.vec_id % 4 <> 0 THEN e.vec_id END) AS factorised FROM sources s LEFT JOIN live w ON w.source_id = s.id LEFT JOIN embeddings e ON e.vec_id = w.id GROUP BY s.id")
def source_coverage(spark, sf_dir):
    return catalog.source_breakdown(A.sources(spark, sf_dir), A.works(spark, sf_dir), A.embeddings(spark, sf_dir), A.factors(spark, sf_dir))


@query(A.with_("sources", "live", "items", "emb", "fac") + "SELECT (SELECT count(*) FROM live) AS works, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM emb) AS embeddings, (SELECT count(*) FROM fac) AS factors, (SELECT count(*) FROM live) - (SELECT count(*) FROM emb) AS unembedded, (SELECT strftime(max(last_harvest), '%Y-%m-%dT%H:%M:%S+00:00') FROM sources) AS last_harvest, (SELECT strftime(max(trained_at), '%Y-%m-%dT%H:%M:%S+00:00') FROM fac) AS trained_at, 'ok' AS status")
def health(spark, sf_dir):
    return catalog.health(A.works(spark, sf_dir), A.items(spark, sf_dir), A.embeddings(spark, sf_dir), A.factors(spark, sf_dir), A.sources(spark, sf_dir))


@query(A.with_("live") + "SELECT lower(title) AS title_key, count(*) AS n FROM live GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark, sf_dir):
    return catalog.duplicate_titles(A.works(spark, sf_dir))


@query(A.with_("live") + "SELECT topic, count(*) AS n FROM (SELECT unnest(subjects) AS topic FROM live) WHERE length(topic) BETWEEN 4 AND 40 AND regexp_matches(topic, '^[A-Z]') GROUP BY 1 HAVING count(*) BETWEEN 8 AND 400")
def topic_counts(spark, sf_dir):
    return catalog.topic_counts(A.works(spark, sf_dir), pattern="^[A-Z]")


_STALE = A.with_("live") + "SELECT w.id, title, title_alternate, subjects, summary, contents, w.content_hash FROM live w LEFT JOIN embeddings e ON e.vec_id = w.id WHERE (e.vec_id IS NULL OR e.vec_id % 5 = 0 OR e.vec_id % 7 = 0 OR e.vec_id % 11 = 0)"


def _stored_vectors(spark, sf_dir):
    w = A.works(spark, sf_dir)
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, "old").otherwise("m").alias("model"), F.when(F.col("vec_id") % 11 == 0, 1).otherwise(2).alias("embedder_version"))
    return e.join(w.select("id", "content_hash"), "id").select(F.col("id").alias("work_id"), F.when(F.col("id") % 5 == 0, "changed").otherwise(F.col("content_hash")).alias("source_hash"), "model", "embedder_version")


@query(_STALE)
def stale_works(spark, sf_dir):
    return catalog.stale_works(A.works(spark, sf_dir), _stored_vectors(spark, sf_dir), "m", 2)


@query(_STALE + " AND source_id = 3")
def stale_in_source(spark, sf_dir):
    return catalog.stale_works(A.works(spark, sf_dir), _stored_vectors(spark, sf_dir), "m", 2, source_id=3)


@query("SELECT (SELECT count(*) FROM (" + _STALE + ")) AS pending, (SELECT count(*) FROM part WHERE p_partkey % 97 <> 0) AS total")
def embedding_backlog(spark, sf_dir):
    return catalog.embedding_backlog(A.works(spark, sf_dir), _stored_vectors(spark, sf_dir), "m", 2)


@query(A.with_("fac") + "SELECT count(*) AS n, max(trained_at) AS newest FROM fac")
def cache_probe(spark, sf_dir):
    return catalog.freshness(A.factors(spark, sf_dir), "trained_at")


@query("SELECT event_type AS kind, count(*) AS queries, count(*) FILTER (WHERE user_id % 3 = 0) AS zero_results, count(*) FILTER (WHERE user_id % 3 = 0 AND value > 10) AS rescued, round(CASE WHEN count(*) FILTER (WHERE user_id % 3 = 0) > 0 THEN 100.0 * count(*) FILTER (WHERE user_id % 3 = 0 AND value > 10) / count(*) FILTER (WHERE user_id % 3 = 0) END, 4) AS rate FROM events GROUP BY 1")
def rescue_rate(spark, sf_dir):
    runs = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("exact_hits"), (F.col("value") > 10).cast("int").alias("rescued_hits"))
    return catalog.rescue_rate(runs)


@query(A.with_("live") + "SELECT isbn, count(*) AS n FROM (SELECT DISTINCT id, unnest(isbns) AS isbn FROM (SELECT id, [lpad(CAST(id % 500 AS VARCHAR), 10, '0')] AS isbns FROM live)) GROUP BY 1 HAVING count(*) > 1")
def shared_isbns(spark, sf_dir):
    isbn = F.lpad((F.col("id") % 500).cast("string"), 10, "0")
    return evaluation.shared_isbns(A.works(spark, sf_dir).withColumn("isbns", F.array(isbn)))


@query(A.with_("loans", "fac") + "SELECT patron_ref, count(DISTINCT work_id) AS n FROM loans WHERE work_id IN (SELECT work_id FROM fac) GROUP BY 1 ORDER BY n DESC, patron_ref LIMIT 2")
def popular_patrons(spark, sf_dir):
    return evaluation.popular_patrons(A.loans(spark, sf_dir), A.factors(spark, sf_dir))


@query(
    A.with_("loans", "fac").rstrip()
    + ", own AS (SELECT DISTINCT patron_ref, work_id FROM loans WHERE work_id IN (SELECT work_id FROM fac)), "
    "linked AS (SELECT DISTINCT x.work_id AS a, y.work_id AS b FROM own x JOIN own y ON x.patron_ref = y.patron_ref AND x.work_id < y.work_id), "
    "pairs AS (SELECT list_dot_product(CAST(x.factors AS DOUBLE[]), CAST(y.factors AS DOUBLE[])) AS cosine, l.a IS NOT NULL AS hit FROM fac x JOIN fac y ON x.work_id < y.work_id LEFT JOIN linked l ON l.a = x.work_id AND l.b = y.work_id) "
    "SELECT count(*) FILTER (hit) AS linked_pairs, round(avg(cosine) FILTER (hit), 6) AS linked_mean, round(avg(cosine) FILTER (NOT hit), 6) AS other_mean, round(avg(cosine) FILTER (hit) - avg(cosine) FILTER (NOT hit), 6) AS gap FROM pairs"
)
def co_borrow_gap(spark, sf_dir):
    return _rounded(evaluation.co_borrow_gap(A.loans(spark, sf_dir), A.factors(spark, sf_dir)), "linked_mean", "other_mean", "gap")


# interactions ------------------------------------------------------------------------------------------------------


@query(A.with_("interactions") + "SELECT * FROM interactions")
def interactions_by_pair(spark, sf_dir):
    return interactions.interactions(A.loans(spark, sf_dir))


@query(A.with_("interactions") + "SELECT patron_ref, work_id, CAST(least(greatest(1 + n_loans + 2 * n_renewals + 4 * greatest(n_loans - 1, 0), 1), 40) AS DOUBLE) AS confidence FROM interactions")
def confidence(spark, sf_dir):
    rows = interactions.interactions(A.loans(spark, sf_dir))
    return rows.select("patron_ref", "work_id", interactions.confidence(F.col("n_loans"), F.col("n_renewals")).alias("confidence"))


def _core_sql(works_floor: int, patrons_floor: int) -> str:
    steps, last = [], "purchases"
    for i in range(5):
        steps.append(f"w{i} AS (SELECT * FROM {last} WHERE work_id IN (SELECT work_id FROM {last} GROUP BY 1 HAVING count(*) >= {patrons_floor}))")
        steps.append(f"p{i} AS (SELECT * FROM w{i} WHERE patron_ref IN (SELECT patron_ref FROM w{i} GROUP BY 1 HAVING count(*) >= {works_floor}))")
        last = f"p{i}"
    return A.with_("purchases").rstrip() + ", " + ", ".join(steps) + f" SELECT * FROM {last}"


@query(_core_sql(10, 12))
def kcore(spark, sf_dir):
    return interactions.k_core(interactions.interactions(A.events_loans(spark, sf_dir)), 10, 12)


@query(A.with_("interactions") + "SELECT count(*) AS n_interactions, count(DISTINCT patron_ref) AS n_patrons, count(DISTINCT work_id) AS n_works, round(100.0 * count(*) / (count(DISTINCT patron_ref) * count(DISTINCT work_id)), 6) AS density, CAST(greatest(16, least(128, count(*) // (4 * (count(DISTINCT patron_ref) + count(DISTINCT work_id))))) AS INT) AS factors FROM interactions")
def training_stats(spark, sf_dir):
    s = interactions.training_stats(interactions.interactions(A.loans(spark, sf_dir)))
    return _rounded(s.withColumn("factors", interactions.choose_factors(F.col("n_patrons"), F.col("n_works"), F.col("n_interactions"))), "density")


@query("SELECT o_custkey AS work_id, dense_rank() OVER (ORDER BY o_custkey) - 1 AS work_id_idx FROM (SELECT DISTINCT o_custkey FROM orders)")
def matrix_index(spark, sf_dir):
    return interactions.index(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work_id")), "work_id")


@query(A.with_("interactions") + "SELECT work_id, count(*) AS n_patrons FROM interactions GROUP BY 1")
def n_patrons(spark, sf_dir):
    return interactions.patrons_per_work(interactions.interactions(A.loans(spark, sf_dir)))


@query()
def als_factors(spark, sf_dir):
    """The whole refit (interactions, k-core, rank by the matrix, 15 rounds); learned values have no SQL form."""
    return interactions.factorise(A.events_loans(spark, sf_dir))


_WEIGHT = "least(greatest(1 + n_loans + 2 * n_renewals + 4 * greatest(n_loans - 1, 0), 1), 40)"


def _rounds_sql(rounds: int) -> str:
    """Alternating least squares of rank 1, where every solution is a quotient of sums."""
    half = "SELECT r.{own} AS id, sum(c * v) / ((SELECT sum(v * v) FROM {of}) + 0.1 + sum((c - 1) * v * v)) AS v FROM r JOIN {of} y ON y.id = r.{other} GROUP BY 1"
    steps = ", ".join(f"p{i} AS ({half.format(own='patron', other='work', of=f'w{i}')}), w{i + 1} AS ({half.format(own='work', other='patron', of=f'p{i}')})" for i in range(rounds))
    return (
        A.with_("interactions").rstrip()
        + f", r AS (SELECT CAST(patron_ref AS BIGINT) AS patron, work_id AS work, CAST({_WEIGHT} AS DOUBLE) AS c FROM interactions), "
        + "w0 AS (SELECT work AS id, (CAST('0x' || left(md5('5:' || work || ':0'), 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296 AS v FROM (SELECT DISTINCT work FROM r)), "
        + steps
        + f" SELECT id, round(v, 6) AS value FROM w{rounds}"
    )


@query(_rounds_sql(3))
def factor_rounds(spark, sf_dir):
    """Three rounds of the factor model at rank 1 over all interactions."""
    rows = interactions.interactions(A.loans(spark, sf_dir))
    c = interactions.confidence(F.col("n_loans"), F.col("n_renewals")).cast("double").alias("c")
    works = factors.alternate(rows.select(F.col("patron_ref").cast("long").alias("patron"), F.col("work_id").alias("work"), c), 1, 3, seed=5)
    return works.select("id", F.round(F.get("vector", F.lit(0)), 6).alias("value"))


def _plane(spark, sf_dir):
    """Factors of two dimensions, so that the normal equations have a closed form in SQL."""
    e = A.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("work_id"), F.slice("embedding", 1, 2).alias("vector"))


_FOLDED = (
    A.with_("interactions").rstrip()
    + ", k AS (SELECT patron_ref, n_loans, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z, least(greatest(1 + n_loans + 2 * n_renewals + 4 * greatest(n_loans - 1, 0), 1), 40) AS c FROM interactions JOIN embeddings ON vec_id = work_id), "
    "s AS (SELECT patron_ref, count(*) AS n_works, CAST(sum(n_loans) AS BIGINT) AS n_loans, sum(c * y * y) + 0.1 AS a, sum(c * y * z) AS b, sum(c * z * z) + 0.1 AS d, sum(c * y) AS e, sum(c * z) AS f FROM k GROUP BY 1), "
    "x AS (SELECT patron_ref, n_works, n_loans, (d * e - b * f) / (a * d - b * b) AS x, (a * f - b * e) / (a * d - b * b) AS w FROM s), "
    "folded AS (SELECT patron_ref, CASE WHEN n_works >= 3 THEN x / sqrt(x * x + w * w) END AS x, CASE WHEN n_works >= 3 THEN w / sqrt(x * x + w * w) END AS w, n_works, n_loans FROM x) "
)


@query(_FOLDED + "SELECT patron_ref, round(x, 4) AS x, round(w, 4) AS w, n_works, n_loans FROM folded")
def fold_in(spark, sf_dir):
    got = interactions.fold_in(interactions.interactions(A.loans(spark, sf_dir)), _plane(spark, sf_dir))
    return got.select("patron_ref", *[F.round(F.get("vector", F.lit(i)).cast("double"), 4).alias(n) for i, n in enumerate("xw")], "n_works", "n_loans")


@query(
    _FOLDED + ", scored AS (SELECT patron_ref, vec_id AS work_id, CAST(CAST(x AS FLOAT) AS DOUBLE) * embedding[1] + CAST(CAST(w AS FLOAT) AS DOUBLE) * embedding[2] AS score FROM folded, embeddings WHERE CAST(patron_ref AS BIGINT) % 20 = 0 AND x IS NOT NULL), "
    "fresh AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.patron_ref = s.patron_ref AND i.work_id = s.work_id)) "
    "SELECT patron_ref, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY patron_ref ORDER BY score DESC, work_id) AS rank FROM fresh) WHERE rank <= 10"
)
def folded_rank(spark, sf_dir):
    rows = interactions.interactions(A.loans(spark, sf_dir)).where("cast(patron_ref as long) % 20 = 0")  # the stated probes
    plane = _plane(spark, sf_dir)
    return interactions.folded_ranking(interactions.fold_in(rows, plane), plane, rows).select("patron_ref", "rank", F.round("score", 4).alias("score"))


@query(A.with_("loans") + "SELECT patron_ref, work_id, count(*) AS n_loans, CAST(sum(renewals) AS BIGINT) AS n_renewals FROM loans WHERE patron_ref = '7' GROUP BY ALL")
def one_patron(spark, sf_dir):
    return interactions.of_patron(A.loans(spark, sf_dir), "7")


# merges ------------------------------------------------------------------------------------------------------------


def _works_state(spark, sf_dir):
    w = A.table(spark, sf_dir, "part")
    base = w.select((F.col("p_size") % 5).alias("source_id"), F.col("p_partkey").cast("string").alias("source_record_id"), F.col("p_name").alias("title"), F.sha2("p_name", 256).alias("content_hash"), F.col("p_brand").alias("items_hash"), F.lit(False).alias("deleted"), F.col("p_partkey").alias("k"))
    batch = base.where("k % 2 = 0").withColumns({"title": F.when(F.col("k") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "content_hash": F.when(F.col("k") % 3 == 0, F.lit("new")).otherwise(F.col("content_hash")), "items_hash": F.when(F.col("k") % 5 == 0, F.lit("i")).otherwise(F.col("items_hash")), "deleted": F.col("k") % 7 == 0})
    target = base.where("k % 4 <> 2").withColumn("deleted", F.col("k") % 13 == 0)
    return target.drop("k"), batch.drop("k")


_MERGE = """WITH base AS (SELECT p_size % 5 AS source_id, CAST(p_partkey AS VARCHAR) AS source_record_id, p_name AS title, sha256(p_name) AS content_hash, p_brand AS items_hash, p_partkey AS k FROM part),
j AS (SELECT *, k % 4 <> 2 AS stored, k % 2 = 0 AS arrived, k % 3 = 0 AS changed, k % 7 = 0 AS gone, k % 13 = 0 AS was_gone, CASE WHEN k % 5 = 0 THEN 'i' ELSE items_hash END AS new_items FROM base WHERE k % 4 <> 2 OR k % 2 = 0),
a AS (SELECT *, CASE WHEN NOT arrived THEN 'kept' WHEN gone AND stored THEN 'deleted' WHEN gone THEN 'ignored' WHEN NOT stored THEN 'inserted' WHEN NOT changed THEN 'unchanged' ELSE 'updated' END AS action FROM j),
merged AS (SELECT source_id, source_record_id, CASE WHEN action IN ('inserted', 'updated') AND changed THEN title || '!' ELSE title END AS title, CASE WHEN action IN ('inserted', 'updated') AND changed THEN 'new' ELSE content_hash END AS content_hash, CASE WHEN action IN ('inserted', 'updated', 'unchanged') THEN new_items ELSE items_hash END AS items_hash, CASE WHEN action = 'deleted' THEN true WHEN action = 'kept' THEN was_gone ELSE false END AS deleted, action, action IN ('inserted', 'updated') OR (action = 'unchanged' AND items_hash <> new_items) AS items_changed FROM a WHERE action <> 'ignored') """


@query(_MERGE + "SELECT * FROM merged")
def upsert_works(spark, sf_dir):
    return merge.merge_works(*_works_state(spark, sf_dir))


@query(_MERGE + "SELECT source_id, source_record_id, title, content_hash, items_hash, deleted FROM merged")
def upsert_in_buckets(spark, sf_dir):
    """The same merge into a stored table, bucket by bucket: a first version, and a second one by the batch."""
    target, batch = _works_state(spark, sf_dir)
    stored = feed.table(spark, new_path(spark, "works"), buckets=16)
    stored.apply(target, merge.merge_by(feed.KEYS))
    stored.apply(batch, merge.merge_works)
    return stored.read()


@query(_MERGE + "SELECT action, count(*) AS n, count(*) FILTER (WHERE items_changed) AS items_refreshed FROM merged GROUP BY 1")
def upsert_counters(spark, sf_dir):
    return upsert_works(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if("items_changed").alias("items_refreshed"))


@query(_MERGE + "SELECT source_id, source_record_id FROM merged WHERE deleted")
def tombstones(spark, sf_dir):
    return upsert_works(spark, sf_dir).where("deleted").select("source_id", "source_record_id")


@query("SELECT l_partkey AS work_id, l_suppkey AS owning_branch FROM lineitem WHERE l_partkey % 3 <> 0 UNION ALL SELECT ps AS work_id, sup AS owning_branch FROM (SELECT DISTINCT l_partkey AS ps, l_suppkey AS sup FROM lineitem WHERE l_partkey % 3 = 0 AND (l_partkey % 6 = 0 OR l_partkey % 5 = 1))")
def replace_items(spark, sf_dir):
    i = A.items(spark, sf_dir).select("work_id", "owning_branch")
    return merge.replace_items(i, i.where("work_id % 3 = 0").select("work_id"), i.where("work_id % 6 = 0 or work_id % 5 = 1").distinct())


@query("SELECT CAST(1 AS INT) AS source_id, o_orderkey AS source_loan_id, o_custkey AS work_id, CAST(o_custkey AS VARCHAR) AS patron_ref, o_orderdate AS checked_out_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 7 DAY END AS checked_in_at, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS renewals, CASE WHEN o_orderkey % 2 = 1 THEN 'inserted' WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE 'kept' END AS action FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_loans(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.lit(1).alias("source_id"), F.col("o_orderkey").alias("source_loan_id"), F.col("o_custkey").alias("work_id"), F.col("o_custkey").cast("string").alias("patron_ref"), F.col("o_orderdate").alias("checked_out_at"))
    target = o.where("source_loan_id % 2 = 0").select("*", F.lit(None).cast("timestamp").alias("checked_in_at"), F.lit(0).alias("renewals"))
    batch = o.where("source_loan_id % 3 = 0").select("*", F.expr("checked_out_at + interval 7 day").alias("checked_in_at"), F.lit(1).alias("renewals"))
    late = batch.withColumn("work_id", F.when(F.col("source_loan_id") % 2 == 0, -1).otherwise(F.col("work_id")))  # stored works stay
    return merge.merge_loans(target, late)


_RESOLVED = A.with_("live") + ", firsts AS (SELECT source_id, split_part(source_record_id, ':', -1) AS biblio_id, min(id) AS work_id FROM (SELECT id, source_id, CASE WHEN id % 31 = 0 THEN source_record_id || 'x' WHEN id % 29 = 0 THEN 'CAT:' || (id + 3) ELSE source_record_id END AS source_record_id FROM live) WHERE regexp_full_match(split_part(source_record_id, ':', -1), '[0-9]+') GROUP BY ALL), r AS (SELECT o_orderkey AS loan_id, work_id FROM orders LEFT JOIN firsts ON CAST(o_custkey * 3 AS VARCHAR) = biblio_id AND o_orderkey % 5 = source_id) "


def _resolved(spark, sf_dir):
    """Some record ids end in no number, and some in another work's."""
    loans = A.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("source_id"), F.col("o_orderkey").alias("loan_id"), (F.col("o_custkey") * 3).cast("string").alias("biblio_id"))
    rid = F.when(F.col("id") % 31 == 0, F.concat("source_record_id", F.lit("x"))).when(F.col("id") % 29 == 0, F.concat(F.lit("CAT:"), (F.col("id") + 3).cast("string"))).otherwise(F.col("source_record_id"))
    return merge.resolve_loans(loans, A.works(spark, sf_dir).withColumn("source_record_id", rid))


@query(_RESOLVED + "SELECT * FROM r")
def loan_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(_RESOLVED + "SELECT count(*) AS loans, count(*) FILTER (WHERE work_id IS NULL) AS unresolved FROM r")
def unresolved_counts(spark, sf_dir):
    return _resolved(spark, sf_dir).agg(F.count(F.lit(1)).alias("loans"), F.count_if(F.col("work_id").isNull()).alias("unresolved"))


@query(A.with_("live") + "SELECT o_orderkey AS loan_id, id AS work_id FROM orders LEFT JOIN live ON source_record_id = 'CAT-Brand#11:' || o_custkey AND source_id = o_orderkey % 5")
def loans_by_record(spark, sf_dir):
    """Loans read from the library's database, by whole record ids."""
    loans = A.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("source_id"), F.col("o_orderkey").alias("loan_id"), F.concat(F.lit("CAT-Brand#11:"), F.col("o_custkey").cast("string")).alias("biblio_id"))
    return merge.resolve_exact(loans, A.works(spark, sf_dir))


@query(A.with_("works") + "SELECT doc_id AS rating_id, max(id) AS work_id FROM labels LEFT JOIN works ON split_part(source_record_id, ':', -1) = CAST(doc_id % 2000 AS VARCHAR) AND source_id = doc_id % 5 GROUP BY 1")
def ratings_resolution(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("source_id"), F.col("doc_id").alias("rating_id"), (F.col("doc_id") % 2000).cast("string").alias("biblio_id"))
    return merge.resolve_ratings(rows, A.works(spark, sf_dir)).select("rating_id", "work_id")


_DB_STORE = """WITH base AS (SELECT CAST(p_size % 5 AS BIGINT) AS source_id, CAST(p_partkey AS VARCHAR) AS source_record_id, p_name AS title, sha256(p_name) AS content_hash, p_brand AS items_hash, p_partkey AS k FROM part),
a AS (SELECT *, k % 4 <> 2 AS stored, k % 2 = 0 AS arrived, CASE WHEN k % 2 <> 0 THEN 'kept' WHEN k % 4 = 2 THEN 'new' WHEN k % 3 = 0 OR k % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM base WHERE k % 4 <> 2 OR k % 2 = 0)
SELECT CAST(source_id AS INT) AS source_id, source_record_id, CASE WHEN action IN ('new', 'updated') AND k % 3 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN action IN ('new', 'updated') AND k % 3 = 0 THEN 'new' ELSE content_hash END AS content_hash, CASE WHEN action IN ('new', 'updated') AND k % 5 = 0 THEN 'i' ELSE items_hash END AS items_hash, action = 'kept' AND k % 13 = 0 AS deleted, action FROM a"""


@query(_DB_STORE)
def store_works(spark, sf_dir):
    target, batch = _works_state(spark, sf_dir)
    return merge.store_works(target, batch.drop("deleted")).withColumn("source_id", F.col("source_id").cast("int"))


@query(
    "SELECT count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_custkey % 7 <> 0) AS inserted, count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_custkey % 7 <> 0) AS updated, count(*) FILTER (WHERE o_custkey % 7 = 0) AS unresolved, "
    "count(*) FILTER (WHERE o_custkey % 7 <> 0 AND o_orderkey % 5 = 0) AS current, count(*) FILTER (WHERE o_custkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS historical FROM orders WHERE o_orderkey % 3 = 0"
)
def loan_counters(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.lit(1).alias("source_id"), F.col("o_orderkey").alias("source_loan_id"), F.col("o_custkey").alias("work_id"), F.col("o_custkey").cast("string").alias("patron_ref"), F.col("o_orderdate").alias("checked_out_at"))
    target = o.where("source_loan_id % 2 = 0").select("*", F.lit(None).cast("timestamp").alias("checked_in_at"), F.lit(0).alias("renewals"))
    back = F.when(F.col("source_loan_id") % 5 != 0, F.col("checked_out_at").cast("timestamp"))
    batch = o.where("source_loan_id % 3 = 0").select("*", back.alias("checked_in_at"), F.lit(1).alias("renewals"))
    return merge.store_loans(target, batch.withColumn("work_id", F.when(F.col("work_id") % 7 != 0, F.col("work_id"))))[1]


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey % 8 = 0 WHEN n_regionkey = 0 THEN NULL WHEN n_regionkey = 1 THEN false ELSE true END AS last_had_items, CASE WHEN n_nationkey % 4 = 0 THEN TIMESTAMP '2025-05-05' ELSE CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS TIMESTAMP) END AS last_harvest FROM nation")
def source_stamps(spark, sf_dir):
    s = A.sources(spark, sf_dir)
    runs = s.where("id % 4 = 0").select("id", F.lit("2025-05-05").cast("timestamp").alias("finished_at"), F.when(F.col("id") % 8 == 0, 3).otherwise(0).alias("n_items"))
    return merge.stamp_sources(s, runs)


@query("SELECT n_nationkey AS version, n_name AS description FROM nation WHERE n_nationkey % 3 <> 0")
def pending_migrations(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("version"), F.col("n_name").alias("description"))
    return merge.pending_migrations(n, n.where("version % 3 = 0"))


@query("SELECT p_partkey AS work_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def upsert_embeddings(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"))
    old, new = p.where("work_id % 2 = 0").withColumn("model", F.lit("old")), p.where("work_id % 3 = 0").withColumn("model", F.lit("new"))
    return merge.merge_by_key(old, new, ["work_id"])


@query("SELECT n_name AS base_url, 'marc21' AS metadata_prefix, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'unimarc' ELSE 'old' END AS marc_flavour, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS header FROM nation")
def upsert_sources(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("base_url"), F.lit("marc21").alias("metadata_prefix"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    headers = lambda v: F.create_map(F.lit("x"), F.lit(v))
    old = n.withColumns({"marc_flavour": F.lit("old"), "request_headers": headers("old")}).drop("k")
    new = n.withColumns({"marc_flavour": F.when(F.col("k") % 2 == 0, "unimarc"), "request_headers": F.when(F.col("k") % 3 == 0, headers("new")).otherwise(F.create_map().cast("map<string,string>"))}).drop("k")
    return merge.merge_sources(old, new).select("base_url", "metadata_prefix", "name", "marc_flavour", F.col("request_headers")["x"].alias("header"))


@query("SELECT l_partkey AS work_id, CASE WHEN l_linestatus = 'O' THEN 'current' ELSE 'history' END AS kind FROM lineitem")
def union_loans(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), "l_linestatus")
    part = lambda open_, kind: rows.where((F.col("l_linestatus") == "O") == open_).select("work_id", F.lit(kind).alias("kind"))
    return merge.union_loans(part(True, "current"), part(False, "history"))


@query("SELECT doc_id AS work_id, 1 + quality * 4 AS rating FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1 + toxic FROM labels WHERE doc_id % 3 = 0")
def upsert_ratings(spark, sf_dir):
    r = A.table(spark, sf_dir, "labels")
    return merge.merge_by_key(r.select(F.col("doc_id").alias("work_id"), (1 + F.col("quality") * 4).alias("rating")), r.where("doc_id % 3 = 0").select(F.col("doc_id").alias("work_id"), (1 + F.col("toxic")).alias("rating")), ["work_id"])


# scalars -----------------------------------------------------------------------------------------------------------


def _part(spark, sf_dir, *cols):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *cols)


@query("SELECT p_partkey AS id, regexp_replace(p_name, '[\\s:/;,=.]+$', '') AS title FROM part")
def isbd_strip(spark, sf_dir):
    return _part(spark, sf_dir, T.strip_isbd(F.concat("p_name", F.lit(" : "))).alias("title"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '080442' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || 'X' WHEN p_partkey % 3 = 1 THEN '9780670' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS isbn FROM part")
def isbn_clean(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("0-80442-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("x (pbk.)"))).when(k % 3 == 1, F.concat(F.lit("978-0-670-"), F.lpad(k.cast("string"), 6, "0"), F.lit(" :"))).otherwise(F.concat(F.lit("12345"), F.lit(" (alk. paper)")))
    return _part(spark, sf_dir, T.clean_isbn(raw).alias("isbn"))


@query("SELECT o_orderkey AS id, CAST(year(o_orderdate) AS SMALLINT) AS year FROM orders")
def year_extract(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.extract_year(F.concat(F.lit("c"), F.date_format("o_orderdate", "yyyy"), F.lit(". 12345"))).alias("year"))


@query("SELECT p_partkey AS id, 'L''' || p_name AS title FROM part")
def nonfiling(spark, sf_dir):
    return _part(spark, sf_dir, T.strip_nonfiling(F.concat(F.lit("[L']"), "p_name")).alias("title"))


def _folded_sql(column: str) -> str:
    """Letters of two letters and those without a decomposition first, then the accents."""
    for letter, plain in (T.LETTER_PAIRS | T.PLAIN_LETTERS).items():
        column = f"replace({column}, '{letter}', '{plain}')"
    return f"strip_accents({column})"


@query(f"SELECT doc_id, {_folded_sql('lower(text)')} AS folded, {_folded_sql("lower('Œuvres de Ærø, Łódź et Đakovo: ' || doc_id || ' Straßen')")} AS title FROM documents")
def accent_fold(spark, sf_dir):
    title = F.concat(F.lit("Œuvres de Ærø, Łódź et Đakovo: "), F.col("doc_id").cast("string"), F.lit(" Straßen"))
    return A.table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"), T.fold(title).alias("title"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN ['gle', 'eng'] WHEN p_partkey % 4 = 1 THEN ['fre'] WHEN p_partkey % 4 = 2 THEN ['gla'] ELSE CAST([] AS VARCHAR[]) END AS languages FROM part")
def language_chain(spark, sf_dir):
    k = F.col("p_partkey") % 4
    a101 = F.when(k == 1, F.array(F.lit("Fre"), F.lit("und")))
    a041 = F.when(k == 0, F.array(F.lit("gleeng"), F.lit("gle"))).when(k == 2, F.array(F.lit("junk")))
    f008 = F.concat(F.lit("x" * 35), F.when(k == 3, "mul").otherwise("gla"), F.lit(" d"))
    return _part(spark, sf_dir, T.language_chain(a101, a041, f008).alias("languages"))


@query("SELECT p_partkey AS id, p_name || '. ' || p_type AS core, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS description, false AS is_title_only FROM part")
def text_compose(spark, sf_dir):
    t = T.build_text(F.col("p_name"), F.lit(None), F.array("p_type", F.lit(" ")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit("  "))
    return _part(spark, sf_dir, t.alias("t")).select("id", "t.*")


@query("SELECT p_partkey AS id, sha256(p_name || chr(31) || p_brand || chr(31) || p_size) AS content_hash FROM part")
def content_hash(spark, sf_dir):
    return _part(spark, sf_dir, hashing.flat_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("content_hash"))


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


@query("SELECT c_custkey, left(sha256(unhex('{1}') || unhex(sha256(unhex('{0}') || encode(CAST(c_custkey AS VARCHAR))))), 32) AS patron_ref FROM customer".format(*_pads(A.SECRET)))
def patron_ref(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select("c_custkey", hashing.patron_reference(F.col("c_custkey"), A.SECRET).alias("patron_ref"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'l ' ELSE '' END || trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def edition_key(spark, sf_dir):
    """An elided article stays: its apostrophe is a blank by then."""
    return _part(spark, sf_dir, T.canonical_key(F.concat(F.when(F.col("p_partkey") % 2 == 0, "L'").otherwise("The "), "p_name"), F.array("p_brand")).alias("key"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(date_diff('second', o_orderdate, l_shipdate) / 86400.0, 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def days_held(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return A.table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.round(T.days_held(F.col("o_orderdate"), F.col("l_shipdate")), 6).alias("days"))


@query("SELECT page_id, split_part(split_part(url, '//', -1), '/', 1) AS host FROM pages")
def source_names(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.source_name(F.col("url")).alias("host"))


# search ------------------------------------------------------------------------------------------------------------


_GRAMS = "grams AS (SELECT id, field, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(text, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM (SELECT id, 'title' AS field, lower(title) AS text FROM live UNION ALL SELECT id, 'authors', lower(array_to_string(authors, ' ')) FROM live))"


_SPLIT = "list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: w <> '')"
_LISTED = "flatten(list_transform(" + _SPLIT + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


def _candidates_sql(modulus: int) -> str:
    return A.with_("live").rstrip() + ", " + _GRAMS + f", q AS (SELECT DISTINCT title AS query FROM live WHERE id % {modulus} = 0), qg AS (SELECT query, list_distinct(" + _LISTED.format("lower(query)") + ") AS g FROM q) SELECT query, id, field, len(grams.g) AS n, len(qg.g) AS n_query, len(list_intersect(grams.g, qg.g)) AS shared FROM qg, grams WHERE len(list_intersect(grams.g, qg.g)) >= greatest(1, 0.3 * len(qg.g))"


@query(_candidates_sql(20))
def trigram_candidates(spark, sf_dir):
    """The titles of the stated works, every twentieth id, against all works."""
    w = A.works(spark, sf_dir)
    q = catalog.live(w).where("id % 20 = 0").select(F.col("title").alias("query")).distinct()
    return search.trigram_candidates(q, A.gram_index(spark, sf_dir))


def _typo_sql(column: str) -> str:
    """The longest word (the first of equal ones) with its middle characters exchanged, in every place."""
    words = f"string_split({column}, ' ')"
    longest = f"list_filter({words}, lambda w: length(w) = list_max(list_transform({words}, lambda x: length(x))))[1]"
    return f"(SELECT array_to_string(list_transform({words}, lambda w: CASE WHEN w = l AND length(w) > 3 THEN substring(l, 1, length(l) // 2 - 1) || substring(l, length(l) // 2 + 1, 1) || substring(l, length(l) // 2, 1) || substring(l, length(l) // 2 + 2) ELSE w END), ' ') FROM (SELECT {longest} AS l))"


def _search_sql(scope: str = "") -> str:
    """word similarity: the best of all extents that begin and end with a shared trigram, each as distinct trigrams."""
    extent = "list_distinct(t[i:j])"
    shared = f"len(list_intersect({extent}, q))"
    best = f"coalesce(list_max(list_transform(p, lambda i: list_max(list_transform(list_filter(p, lambda j: j >= i), lambda j: {shared} / (len(q) + len({extent}) - {shared}))))), 0)"
    return (
        A.with_("live").rstrip()
        + f", own AS (SELECT * FROM live {scope}), "
        + "stated AS (SELECT id, title, isbns, " + _typo_sql("title") + " AS typo FROM live WHERE id % 20 = 0), "
        "asked AS (SELECT typo AS query FROM stated UNION SELECT isbns[1] FROM stated UNION SELECT 'zzzzqqqxyz'), "
        "hits AS (SELECT DISTINCT query, id FROM asked JOIN (SELECT id, unnest(isbns) AS isbn FROM own) ON isbn = query AND regexp_full_match(query, '[0-9]{9}([0-9]{3})?[0-9A-Za-z]')), "
        "rest AS (SELECT query, list_distinct(" + _LISTED.format("lower(query)") + ") AS q FROM asked WHERE query NOT IN (SELECT query FROM hits)), "
        "texts AS (SELECT id, " + _LISTED.format("lower(title)") + " AS tt, " + _LISTED.format("lower(array_to_string(authors, ' '))") + " AS ta FROM own), "
        "pairs AS (SELECT query, id, q, tt, ta FROM rest, texts WHERE len(list_intersect(list_distinct(tt), q)) >= 0.45 * len(q) OR len(list_intersect(list_distinct(ta), q)) >= 0.45 * len(q)), "
        "sides AS (SELECT query, id, q, t, list_filter(range(1, len(t) + 1), lambda i: list_contains(q, t[i])) AS p, side FROM (SELECT query, id, q, tt AS t, 1 AS side FROM pairs UNION ALL SELECT query, id, q, ta, 2 FROM pairs)), "
        "ws AS (SELECT query, id, side, " + best + " AS s, len(list_intersect(list_distinct(t), q)) / (len(q) + len(list_distinct(t)) - len(list_intersect(list_distinct(t), q))) AS plain FROM sides), "
        "scored AS (SELECT query, id, max(s) AS score, max(CASE WHEN side = 1 THEN plain END) AS plain FROM ws GROUP BY ALL), "
        "fuzzy AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scored WHERE score >= 0.45 AND (score >= 0.6 OR plain >= 0.3)) "
        "SELECT query, id, round(score, 6) AS score, rank FROM fuzzy WHERE rank <= 20 UNION ALL SELECT query, id, 1.0, row_number() OVER (PARTITION BY query ORDER BY id) FROM hits"
    )


def _asked(spark, sf_dir):
    """Titles with a transposition and ISBNs of the stated works, every twentieth id, and nonsense."""
    w = catalog.live(A.works(spark, sf_dir)).where("id % 20 = 0")
    return w.select(T.transpose_typo(F.col("title")).alias("query")).union(w.select(F.get("isbns", F.lit(0)))).union(spark.sql("select 'zzzzqqqxyz'")).distinct()


@query(_search_sql())
def search_exact(spark, sf_dir):
    return _rounded(search.search_exact(_asked(spark, sf_dir), A.works(spark, sf_dir), index=A.gram_index(spark, sf_dir)), "score")


@query(_search_sql("WHERE source_id = 1"))
def search_in_source(spark, sf_dir):
    return _rounded(search.search_exact(_asked(spark, sf_dir), A.works(spark, sf_dir), source_id=1, index=A.gram_index(spark, sf_dir)), "score")


@query(
    A.with_("live").rstrip()
    + ", t AS (SELECT id, title, CASE WHEN id % 2 = 0 THEN title || ' Œ' ELSE authors[1] END AS other FROM live), "
    + "g AS (SELECT id, list_distinct(" + _LISTED.format("lower(title)") + ") AS a, list_distinct(" + _LISTED.format("replace(lower(other), 'œ', 'oe')") + ") AS b FROM t) "
    "SELECT t.id, title AS bare, list_sort(a) AS grams, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity, CASE WHEN t.id % 2 = 0 THEN 1.0 END AS word_similarity, "
    "left(sha256(unhex('{1}') || unhex(sha256(unhex('{0}') || encode(CAST(t.id AS VARCHAR))))), 32) AS patron FROM t JOIN g USING (id)".format(*_pads(A.SECRET))
)
def sql_functions(spark, sf_dir):
    """The functions by their names in SQL; a title stands whole in itself with a word more, so its word similarity is 1."""
    sql.register(spark, A.SECRET)
    catalog.live(A.works(spark, sf_dir)).createOrReplaceTempView("live_works")
    return spark.sql(
        """SELECT id, strip_isbd(concat(title, ' :/ ')) AS bare, array_sort(trigrams(title)) AS grams, round(trigram_similarity(title, other), 6) AS similarity,
        round(CASE WHEN id % 2 = 0 THEN word_similarity(title, other) END, 6) AS word_similarity, patron_reference(CAST(id AS STRING)) AS patron
        FROM (SELECT id, title, CASE WHEN id % 2 = 0 THEN concat(title, ' Œ') ELSE authors[0] END AS other FROM live_works)"""
    )


# marc --------------------------------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MARCXML record for each part."""
    sub = lambda code, value: F.concat(F.lit(f'<subfield code="{code}">'), value, F.lit("</subfield>"))
    field = lambda tag, *subs: F.concat(F.lit(f'<datafield tag="{tag}" ind1=" " ind2=" ">'), *subs, F.lit("</datafield>"))
    k = F.col("p_partkey")
    xml = F.concat(
        F.lit('<record xmlns="http://www.loc.gov/MARC21/slim"><leader>     nam a22     2  4500</leader>'),
        field("020", sub("a", F.concat(F.lit("978067"), F.lpad(k.cast("string"), 7, "0"), F.lit(" (pbk.)")))),
        field("100", sub("a", F.concat("p_brand", F.lit(",")))),
        field("245", sub("a", F.concat("p_name", F.lit(" :"))), sub("b", F.concat("p_brand", F.lit(" /")))),
        field("260", sub("b", F.concat("p_brand", F.lit(","))), sub("c", F.concat(F.lit("c"), (1900 + F.col("p_size")).cast("string"), F.lit(".")))),
        field("650", sub("a", F.col("p_type")), sub("x", F.lit("History."))),
        F.when(k % 2 == 0, field("952", sub("p", k.cast("string")))).otherwise(F.lit("")),
        F.lit("</record>"),
    )
    return marc.dealt(A.table(spark, sf_dir, "part"), "p_partkey").select(k.cast("string").alias("source_record_id"), (k % 97 == 0).alias("deleted"), marc.parse(xml).alias("rec"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, regexp_replace(p_name, '[\\s:/;,=.]+$', '') || ' : ' || p_brand AS title, p_brand AS author, '978067' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS isbn, p_type || ' — History' AS subject, p_brand AS publisher, CAST(1900 + p_size AS SMALLINT) AS publication_year FROM part WHERE p_partkey % 97 <> 0")
def marc_works(spark, sf_dir):
    w = marc.works_batch(marc.map_records(records(spark, sf_dir)))
    one = lambda c: F.get(c, F.lit(0))
    return w.select("source_record_id", "title", one("authors").alias("author"), one("isbns").alias("isbn"), one("subjects").alias("subject"), "publisher", "publication_year")


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_record_id, CAST(p_partkey AS VARCHAR) AS barcode FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 97 <> 0")
def marc_items(spark, sf_dir):
    return marc.items_batch(marc.map_records(records(spark, sf_dir))).select("source_record_id", "barcode")


@query("SELECT CASE WHEN p_partkey % 97 = 0 THEN 'deleted' ELSE 'mapped' END AS status, count(*) AS n FROM part GROUP BY 1")
def marc_counters(spark, sf_dir):
    return marc.counted(marc.map_records(records(spark, sf_dir)))


@query("SELECT tag, round(100.0 * n / (SELECT count(*) FROM part), 4) AS percent, CAST(0 AS DOUBLE) AS percent_repeated FROM (SELECT unnest(['020', '100', '245', '260', '650']) AS tag, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT '952', count(*) FROM part WHERE p_partkey % 2 = 0)")
def marc_field_profile(spark, sf_dir):
    return marc.field_profile(records(spark, sf_dir))
