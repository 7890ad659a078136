"""Registered queries over the test tables and their DuckDB equivalents.

Every query takes whole tables. A few have no SQL: what needs an encoder, a tagger or a model's answers is tested against
plain Python on small fixtures instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessergraph.functions import text
from tessergraph.operators import build, candidates, collect, graph, judge, similarity
from tessergraph.plans import adapters, release, retrieve
from tessergraph.plans.adapters import with_views
from tessergraph.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scalar functions.


@registered(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal FROM documents")
def normalize_text(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@registered(with_views("v_pairs") + r"SELECT pair_id, trim(regexp_replace(concat_ws(' ', nullif(raw_api, ''), nullif(canonical_api, ''), nullif(reference, ''), nullif(ku, '')), '\s+', ' ', 'g')) AS body FROM v_pairs")
def pair_text(spark, d):
    rows = adapters.pairs(spark, d)
    return rows.select("pair_id", text.pair_text(rows.columns).alias("body"))


@registered(with_views("v_tutorial") + "SELECT _ord, coalesce(nullif(canonical_api, ''), nullif(api, ''), '') AS chosen FROM v_tutorial")
def first_nonempty(spark, d):
    rows = adapters.tutorial(spark, d)
    return rows.select("_ord", text.first_nonempty(rows.columns, ("canonical_api", "resolved_api", "api")).alias("chosen"))


@registered(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z][a-z0-9_.$]*|\p{Nd}+')) AS INTEGER) AS n_tokens FROM documents")
def tokenize_counts(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@registered(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_.$]*|\p{Nd}+'))), ' ') AS tokens FROM documents")
def token_sets(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(text.token_set(F.col("text"))), " ").alias("tokens"))


@registered(r"SELECT doc_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS folded FROM documents")
def casefold_text(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", text.casefold(text.normalize_text(F.col("text"))).alias("folded"))


@registered(r"SELECT doc_id, sha256(lang || chr(0) || replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS ku_identity FROM documents")
def ku_identity(spark, d):
    folded = text.casefold(text.normalize_text(F.col("text")))
    return adapters.table(spark, d, "documents").select("doc_id", text.identity(F.col("lang"), folded).alias("ku_identity"))


@registered("SELECT doc_id, printf('PAIR-%06d', doc_id * 1234567) AS pair_id, 'docs:API:' || source AS api_node, 'docs:KU:' || source || ':' || doc_id AS ku_node FROM documents")
def node_ids(spark, d):
    one, source = F.lit("docs"), F.col("source")
    return adapters.table(spark, d, "documents").select(
        "doc_id",
        text.pair_id(F.col("doc_id") * 1234567).alias("pair_id"),
        text.api_node_id(one, source).alias("api_node"),
        text.ku_node_id(one, source, F.col("doc_id").cast("string")).alias("ku_node"),
    )


@registered(with_views("v_pairs") + "SELECT pair_id, array_to_string(list_filter(list_transform(string_split(lamic_role, '|'), lambda x: trim(x)), lambda x: x <> ''), ',') AS roles FROM v_pairs")
def split_roles(spark, d):
    return adapters.pairs(spark, d).select("pair_id", F.array_join(text.split_trimmed(F.col("lamic_role")), ",").alias("roles"))


@registered(with_views("v_scores") + "SELECT query_id, pair_id, round_even(score, 6) AS shown, score FROM v_scores")
def pair_previews(spark, d):
    rows = _scores(spark, d).join(adapters.pairs(spark, d).select("pair_id", "canonical_api", "ku"), "pair_id")
    shown = rows.withColumn("p", text.preview(F.col("pair_id"), F.col("canonical_api"), F.col("score"), F.col("ku")))
    return shown.select("query_id", "p.pair_id", F.col("p.score").alias("shown"), "score")


# Sources.


@registered("SELECT 'd' || (item_id % 3) AS dataset, CAST(item_id AS INTEGER) AS query_id, text AS query, source || ',' || source AS labels FROM (SELECT item_id, text, 'src' || (item_id % 7) AS source FROM benchmark)")
def load_queries_labels(spark, d):
    source = F.concat(F.lit("src"), F.col("item_id") % 7)
    rows = adapters.table(spark, d, "benchmark").select(
        F.concat(F.lit("d"), F.col("item_id") % 3).alias("dataset"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.concat(source, F.lit("| |  "), source, F.lit("|")).alias("ground_truth_apis")
    )
    return files.shape_queries(rows).withColumn("labels", F.array_join("ground_truth_apis", ",")).drop("ground_truth_apis")


@registered("SELECT 'd' || (item_id % 3) AS dataset, array_to_string(list_sort(list(item_id)), ',') AS ids FROM benchmark GROUP BY 1")
def validate_release(spark, d):
    rows = adapters.table(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id") % 3).alias("dataset"), F.col("item_id").cast("int").alias("query_id"))
    return release.query_sets(rows).select("dataset", F.array_join("ids", ",").alias("ids"))


# Collecting.

_COLLECTED = with_views("v_tutorial", "v_stackoverflow", "v_references") + r"""
, u AS (
  SELECT 0 AS rk, 'SG' AS ku_source, trim(regexp_replace(api, '\s+', ' ', 'g')) AS raw_api, trim(regexp_replace(ku, '\s+', ' ', 'g')) AS ku, canonical_api, _ord FROM v_tutorial
  UNION ALL SELECT 1, 'QA', trim(regexp_replace(api, '\s+', ' ', 'g')), trim(regexp_replace(answer, '\s+', ' ', 'g')), '', _ord FROM v_stackoverflow
), n AS (SELECT *, row_number() OVER (ORDER BY rk, _ord) AS i FROM u WHERE raw_api <> '' AND ku <> '')
SELECT printf('PAIR-%06d', i) AS pair_id, 'docs' AS dataset, ku_source, raw_api, n.canonical_api,
  coalesce(CASE WHEN a.key IS NOT NULL THEN a.reference ELSE b.reference END, '') AS reference,
  coalesce(CASE WHEN a.key IS NOT NULL THEN a.reference_origin ELSE b.reference_origin END, '') AS reference_origin, ku, '' AS identified_relevance, '' AS relevant_groundtruth
FROM n LEFT JOIN v_references a ON a.key = lower(coalesce(nullif(n.canonical_api, ''), raw_api)) LEFT JOIN v_references b ON b.key = lower(raw_api)
"""


@registered(_COLLECTED)
def collect_pairs(spark, d):
    found, _ = collect.collect(adapters.tutorial(spark, d), adapters.stackoverflow(spark, d), adapters.specification(spark, d), "docs")
    return found.drop("_ord")


@registered(with_views("v_references") + "SELECT canonical_api, reference, reference_origin, row_number() OVER (ORDER BY _ord) AS place FROM v_references")
def collect_references(spark, d):
    held = collect.references(adapters.specification(spark, d))
    return held.select(*collect.REFERENCE_COLUMNS, F.row_number().over(Window.orderBy("_ord")).alias("place"))  # a row for each API of the specification


# Building.


def _admitted(spark, d) -> DataFrame:
    return build.default_dataset(build.admit(adapters.pairs(spark, d)))


def _built(spark, d) -> tuple[DataFrame, DataFrame]:
    held = collect.references(adapters.specification(spark, d))
    return build.build(adapters.pairs(spark, d), held, adapters.declarations(spark, d), adapters.relations(spark, d))


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a scan gives them; edges in the order of their places."""
    nodes, edges = _built(spark, d)
    order = F.col("_place._rank").cast("long") * (1 << 40) + F.col("_place._ord.a") * 64 + F.col("_place._ord.b") % 64
    return nodes.withColumn("_ord", F.coalesce("_ord", F.lit(-1))), edges.withColumn("_ord", order)


@registered(with_views("v_pairs") + "SELECT pair_id, dataset, canonical_api FROM v_pairs WHERE identified_relevance = '1' AND canonical_api <> ''")
def phase2_admission(spark, d):
    return _admitted(spark, d).select("pair_id", "dataset", "canonical_api")


@registered(with_views("v_api_nodes") + "SELECT * FROM v_api_nodes")
def api_nodes(spark, d):
    return build.api_nodes(_admitted(spark, d), collect.references(adapters.specification(spark, d)))


@registered(with_views("v_ku_nodes") + "SELECT * EXCLUDE (_ord) FROM v_ku_nodes")
def ku_nodes(spark, d):
    return build.ku_nodes(_admitted(spark, d)).drop("_ord")


@registered(with_views("v_raw_edges") + "SELECT source, target, relation, basis FROM v_raw_edges WHERE rk = 0")
def role_edges(spark, d):
    return build.role_edges(_admitted(spark, d)).select("source", "target", "relation", "basis")


@registered(with_views("v_raw_edges") + "SELECT source, target, relation, evidence, basis FROM v_raw_edges WHERE rk = 1")
def same_ku_edges(spark, d):
    return build.same_ku_edges(build.ku_nodes(_admitted(spark, d))).select("source", "target", "relation", "evidence", "basis")


@registered(with_views("v_raw_edges") + "SELECT source, target, relation, evidence, basis FROM v_raw_edges WHERE rk = 3")
def external_edges(spark, d):
    return build.external_edges(adapters.declarations(spark, d), 3, "official_declaration").select("source", "target", "relation", "evidence", "basis")


@registered(with_views("v_raw_edges", "v_nodes") + "SELECT source, target, relation FROM v_raw_edges WHERE rk = 3 AND source <> target AND source IN (SELECT node_id FROM v_nodes) AND target IN (SELECT node_id FROM v_nodes)")
def edge_integrity(spark, d):
    nodes, _ = _built(spark, d)
    return build.with_ends(build.external_edges(adapters.declarations(spark, d), 3, ""), nodes).select("source", "target", "relation")


@registered(with_views("v_edges") + "SELECT source, target, relation, evidence, basis FROM v_edges")
def edge_dedupe_last_wins(spark, d):
    return _built(spark, d)[1].select("source", "target", "relation", "evidence", "basis")


@registered(with_views("v_edges", "v_nodes") + "SELECT (SELECT count(*) FROM v_nodes) AS nodes, (SELECT count(*) FROM v_edges) AS edges")
def graph_counts(spark, d):
    return build.counts(*_built(spark, d))


# Candidates.


@registered(with_views("v_overlap") + 'SELECT "left", "right", score FROM v_overlap WHERE "left" < "right"')
def jaccard_pairs(spark, d):
    return candidates.overlaps(adapters.language_pairs(spark, d), "score")


@registered(with_views("v_top", instead=adapters.TWO_APIS) + 'SELECT "left", "right", score FROM v_top WHERE same_api')
def same_api_topk(spark, d):
    return candidates.best_partners(candidates.coded_units(adapters.two_api_pairs(spark, d)), cross_api_k=0).select("left", "right", "score")


@registered(with_views("v_top") + 'SELECT "left", "right", score FROM v_top WHERE NOT same_api')
def cross_api_topk(spark, d):
    return candidates.best_partners(candidates.coded_units(adapters.language_pairs(spark, d)), same_api_k=0).select("left", "right", "score")


@registered(with_views("v_mentions") + 'SELECT "left", api FROM v_mentions')
def mention_pairs(spark, d):
    return candidates.mentions(adapters.language_pairs(spark, d))


@registered(
    with_views("v_top", "v_mentions", instead=adapters.TWO_APIS)
    + """SELECT least("left", "right") AS "left", greatest("left", "right") AS "right", max(score) AS score FROM (SELECT "left", "right", score FROM v_top
    UNION ALL SELECT o."left", o."right", o.score FROM v_overlap o JOIN v_mentions m ON m."left" = o."left" AND m.api = o.right_api) GROUP BY 1, 2"""
)
def ku_candidates(spark, d):
    return candidates.ku_candidates(adapters.two_api_pairs(spark, d))


# Similarity.


def _scores(spark, d) -> DataFrame:
    return similarity.score_pairs(adapters.queries(spark, d), adapters.pair_vectors(spark, d))


@registered(with_views("v_scores") + "SELECT query_id, pair_id, score FROM v_scores")
def cosine_scores(spark, d):
    return _scores(spark, d).select("query_id", "pair_id", "score")


@registered(with_views("v_scores") + "SELECT query_id, pair_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS place FROM v_scores QUALIFY place <= 5")
def initial_top5(spark, d):
    return retrieve.first_pairs((adapters.queries(spark, d), adapters.pair_vectors(spark, d))).select("query_id", "pair_id", "score", "place")


_BM25 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_.$]*|\p{Nd}+') AS t FROM documents), q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_.$]*|\p{Nd}+') AS t FROM benchmark),
    tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, len(t), term), tot AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    raw AS (SELECT term, ln(any_value(tot.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, tot GROUP BY term),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw), qt AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY 1, 2)"""
_BM25_SCORE = "sum(k * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean)))"


@registered(_BM25 + f" SELECT item_id AS target, doc_id AS doc, round({_BM25_SCORE}, 5) AS lexical FROM tf JOIN idf USING (term) JOIN qt USING (term), tot GROUP BY 1, 2")
def bm25_scores(spark, d):
    docs = adapters.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.tokens(F.col("text")).alias("terms"))
    asked = adapters.table(spark, d, "benchmark").select(F.col("item_id").alias("target"), text.tokens(F.col("text")).alias("terms"))
    return similarity.bm25(docs, asked).withColumn("lexical", F.round("lexical", 5))


@registered(
    _BM25
    + f""" SELECT target, doc, lexical, place FROM (SELECT CAST(item_id AS VARCHAR) AS target, CAST(doc_id AS VARCHAR) AS doc, round({_BM25_SCORE}, 6) AS lexical,
    row_number() OVER (PARTITION BY item_id ORDER BY round({_BM25_SCORE}, 6) DESC, CAST(doc_id AS VARCHAR)) AS place FROM tf JOIN idf USING (term) JOIN qt USING (term), tot GROUP BY item_id, doc_id) WHERE place <= 10"""
)
def bm25_topk(spark, d):
    docs = adapters.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.tokens(F.col("text")).alias("terms"))
    asked = adapters.table(spark, d, "benchmark").select(F.col("item_id").alias("target"), text.tokens(F.col("text")).alias("terms"))
    return similarity.top_bm25(docs, asked, 10)


@registered(
    with_views("v_scores")
    + """, s AS (SELECT query_id AS target, CAST(right(pair_id, 6) AS BIGINT) AS doc_ord, pair_id AS doc, score AS semantic, CAST((CAST(right(pair_id, 6) AS BIGINT) * 7) % 13 AS DOUBLE) AS lexical, CAST((CAST(right(pair_id, 6) AS BIGINT) * 5) % 11 AS DOUBLE) AS structural FROM v_scores),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY lexical DESC, doc_ord) AS a, row_number() OVER (PARTITION BY target ORDER BY semantic DESC, doc_ord) AS b, row_number() OVER (PARTITION BY target ORDER BY structural DESC, doc_ord) AS c FROM s),
    f AS (SELECT target, doc, doc_ord, 1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b) + 1.0::DOUBLE / (60 + c) AS rrf FROM r)
    SELECT target, doc, row_number() OVER (PARTITION BY target ORDER BY rrf DESC, doc_ord) AS rank, round(rrf, 12) AS rrf FROM f QUALIFY rank <= 6"""
)
def rrf_fusion(spark, d):
    place = F.right("pair_id", F.lit(6)).cast("long")
    rows = _scores(spark, d).select(
        F.col("query_id").alias("target"), F.col("pair_id").alias("doc"), place.alias("doc_ord"), F.col("score").alias("semantic"), (place * 7 % 13).cast("double").alias("lexical"), (place * 5 % 11).cast("double").alias("structural")
    )
    return similarity.fuse(rows).select("target", "doc", "rank", F.round("rrf", 12).alias("rrf"))


@registered()
def rrf_demonstrations(spark, d):
    """Six demonstrations for each unlabelled pair, from all labelled ones."""
    rows = adapters.pair_vectors(spark, d)
    rows = similarity.with_signature(rows, F.col("ku"))
    labelled = F.col("identified_relevance") != ""
    return similarity.select_demonstrations(rows.where(labelled), rows.where(~labelled))


@registered(with_views("v_lang", "v_overlap") + """SELECT o."left", o."right", a.canonical_api AS left_api, b.canonical_api AS right_api, length(a.ku) + length(b.ku) AS chars FROM v_overlap o
    JOIN v_lang a ON a.pair_id = o."left" JOIN v_lang b ON b.pair_id = o."right" WHERE o."left" < o."right\"""")
def candidate_rows(spark, d):
    """All pairs that share a token, with what a relation judge is shown; of the texts, their lengths go along."""
    rows = adapters.language_pairs(spark, d).withColumn("chars", F.length("ku").cast("long"))
    found = candidates.overlaps(rows, "left_api", "right_api", "left_chars", "right_chars")
    return found.select("left", "right", "left_api", "right_api", (F.col("left_chars") + F.col("right_chars")).alias("chars"))


@registered()
def encoded_texts(spark, d):
    """Vectors of all documents from the offline encoder, and their lengths' squares."""
    rows = similarity.with_vectors(adapters.table(spark, d, "documents").select("doc_id", "text"), F.col("text"))
    return rows.select("doc_id", F.round(similarity.dot("embedding", "embedding"), 4).alias("norm"))


# Reading the graph.


@registered(with_views("v_neighbors") + "SELECT node_id, dir, neighbor, relation FROM v_neighbors")
def neighbors(spark, d):
    return graph.neighbors(graph.index_edges(_graph(spark, d)[1])).select("node_id", "dir", "neighbor", "relation")


@registered(
    with_views("v_neighbors", "v_nodes")
    + "SELECT a.api, n.dir, n.neighbor, n.relation FROM v_nodes a JOIN v_neighbors n ON n.node_id = a.node_id WHERE a.kind = 'API' AND n.relation IN ('subtype_of', 'accepts', 'returns')"
)
def api_neighbors(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.api_neighbors(graph.index_nodes(nodes), graph.index_edges(edges)).select("api", "dir", "neighbor", "relation")


@registered(
    with_views("v_neighbors")
    + "SELECT node_id, dir, neighbor, relation FROM v_neighbors WHERE relation IN ('task_related', 'complements', 'constrains', 'contrasts_with', 'same_ku')"
)
def ku_neighbors(spark, d):
    return graph.ku_neighbors(graph.index_edges(_graph(spark, d)[1])).select("node_id", "dir", "neighbor", "relation")


@registered(with_views("v_nodes") + "SELECT pair_id, node_id FROM v_nodes WHERE kind = 'KU'")
def pair_nodes(spark, d):
    return graph.first_node(graph.index_nodes(_graph(spark, d)[0]), "KU", "pair_id")


@registered(with_views("v_api_links") + "SELECT * FROM v_api_links")
def api_expansions(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.api_links(nodes, graph.index_edges(edges))


@registered(with_views("v_ku_links") + "SELECT pair_id, dir, relation, target FROM v_ku_links")
def ku_expansions(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.ku_links(nodes, graph.index_edges(edges)).select("pair_id", "dir", "relation", "target")


@registered(with_views("v_roles") + "SELECT * FROM v_roles")
def roles_by_pair(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.roles_by_pair(nodes, graph.index_edges(edges))


# Retrieval.

_SEEDED = with_views("v_scores", "v_roles") + """, seed AS (SELECT query_id, pair_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) AS place FROM v_scores QUALIFY place <= 5),
disc AS (SELECT DISTINCT s.query_id, p.canonical_api AS api FROM seed s JOIN v_pairs p USING (pair_id))
"""


def _seeded(spark, d):
    """(vectors of queries and pairs, the seeds of each query)."""
    vectors = retrieve.materialize(adapters.queries(spark, d).select(*judge.IDS, "embedding")), retrieve.materialize(adapters.pair_vectors(spark, d).select("dataset", "pair_id", "embedding"))
    return vectors, retrieve.materialize(retrieve.first_pairs(vectors))


@registered(
    _SEEDED
    + """, un AS (SELECT d.query_id, d.api, coalesce(r.role, 'all') AS role, p.pair_id, s.score FROM disc d JOIN v_pairs p ON p.canonical_api = d.api JOIN v_scores s ON s.query_id = d.query_id AND s.pair_id = p.pair_id
    LEFT JOIN v_roles r ON r.pair_id = p.pair_id WHERE NOT EXISTS (SELECT 1 FROM seed e WHERE e.query_id = d.query_id AND e.pair_id = p.pair_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, api, role ORDER BY score DESC, pair_id) AS place FROM un QUALIFY place <= 6)
    SELECT query_id, api, role, string_agg(pair_id, ',' ORDER BY place) AS pair_ids FROM b GROUP BY 1, 2, 3"""
)
def read_actions(spark, d):
    vectors, seeds = _seeded(spark, d)
    nodes, edges = _graph(spark, d)
    units = retrieve.materialize(retrieve.library(adapters.pairs(spark, d), graph.roles_by_pair(nodes, graph.index_edges(edges))))
    found = seeds.join(units, ["dataset", "pair_id"]).select(*judge.IDS, "api").distinct()
    rows = retrieve.read_actions(retrieve.frontier(found, units, vectors, 41), seeds, 6)
    return rows.select("query_id", "api", "role", F.array_join("pair_ids", ",").alias("pair_ids"))


_JUDGED = """, a AS (SELECT query_id, pair_id, score, CAST(CAST(right(pair_id, 6) AS BIGINT) % 4 AS INTEGER) AS api_fit, CAST(CAST(right(pair_id, 6) AS BIGINT) % 3 AS INTEGER) AS ku_support FROM v_scores)
"""


def _assessed(spark, d) -> DataFrame:
    number = F.right("pair_id", F.lit(6)).cast("long")
    return _scores(spark, d).withColumns({"api_fit": (number % 4).cast("int"), "ku_support": (number % 3).cast("int"), "keep": F.lit(True)})


@registered(
    with_views("v_scores") + _JUDGED
    + "SELECT query_id, pair_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(ku_support > 0 AS INT) DESC, api_fit DESC, ku_support DESC, score DESC, pair_id) AS place FROM a"
)
def verified_rank(spark, d):
    place = F.row_number().over(retrieve.window(*retrieve.rank_key([F.desc("score"), "pair_id"])))
    return _assessed(spark, d).select("query_id", "pair_id", place.alias("place"))


@registered(
    with_views("v_scores") + _JUDGED
    + "SELECT query_id, pair_id, row_number() OVER (PARTITION BY query_id ORDER BY api_fit DESC, ku_support DESC, score DESC, pair_id) AS place FROM a WHERE api_fit > 0 AND ku_support > 0 QUALIFY place <= 30"
)
def pool_cap(spark, d):
    return retrieve.cap_pool(retrieve.accepted(_assessed(spark, d)), 30).select("query_id", "pair_id", "place")


@registered(
    """SELECT doc_id, CAST(greatest(0, least(3, doc_id % 9 - 2)) AS INTEGER) AS api_fit, CAST(greatest(0, least(2, doc_id % 7 - 3)) AS INTEGER) AS ku_support FROM documents"""
)
def clamp_assessments(spark, d):
    return adapters.table(spark, d, "documents").select("doc_id", text.clamp(F.col("doc_id") % 9 - 2, 3).alias("api_fit"), text.clamp(F.col("doc_id") % 7 - 3, 2).alias("ku_support"))


@registered(
    """SELECT doc_id, 'P' || doc_id AS pair_id, CAST(least(3, doc_id % 6) AS INTEGER) AS api_fit, CAST(least(2, doc_id % 4) AS INTEGER) AS ku_support, doc_id % 2 = 0 AS keep, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || ',' || source ELSE '' END AS missing_needs FROM documents"""
)
def parse_judgement(spark, d):
    needs = F.when(F.col("doc_id") % 3 == 0, F.format_string('"%s"', "lang")).when(F.col("doc_id") % 3 == 1, F.format_string('["%s","%s"]', "lang", "source")).otherwise("7")
    content = F.concat(
        F.format_string('Sure: {"assessments":[{"pair_id":"P%d","api_fit":%d,"ku_support":%d,"keep":%s,"missing_needs":', "doc_id", F.col("doc_id") % 6, F.col("doc_id") % 4, F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false")),
        needs, F.lit("}]} done"),
    )
    rows = judge.parse_assessments(adapters.table(spark, d, "documents").select("doc_id", content.alias("content"), "lang", "source"))
    return rows.select("doc_id", "pair_id", "api_fit", "ku_support", "keep", F.array_join("missing_needs", ",").alias("missing_needs"))


@registered(
    """SELECT doc_id, CAST(doc_id % 2 AS VARCHAR) AS identified_relevance, CASE WHEN doc_id % 3 = 0 THEN 'has_example|has_guidance' ELSE lang || '|' || source END AS lamic_role,
    CASE WHEN doc_id % 5 = 0 THEN source ELSE lang || ' | ' || source END AS lamic_evidence, 'since ' || doc_id AS lamic_reasoning FROM documents"""
)
def parse_label_answers(spark, d):
    roles = F.when(F.col("doc_id") % 3 == 0, '"has_example| has_guidance"').otherwise(F.format_string('["%s","%s"]', "lang", "source"))
    clues = F.when(F.col("doc_id") % 5 == 0, F.format_string('"%s"', "source")).otherwise(F.format_string('["%s","%s"]', "lang", "source"))
    head = F.format_string('Well, {"identified_relevance":"%d","reasoning":"since %d","roles":', F.col("doc_id") % 2, "doc_id")
    rows = adapters.table(spark, d, "documents").select("doc_id", F.concat(head, roles, F.lit(',"clues":'), clues, F.lit("}")).alias("content"))
    return judge.parse_labels(rows).drop("content")


@registered(
    """SELECT 'docs:KU:' || lang || ':' || doc_id AS source, 'docs:KU:' || source || ':' || (doc_id + 1) AS target, CASE doc_id % 3 WHEN 0 THEN 'complements' ELSE 'constrains' END AS relation,
    lang AS evidence, 'llm_quote_grounded' AS basis, lang AS evidence_source, source AS evidence_target FROM documents WHERE doc_id % 3 <> 2"""
)
def judged_relation_edges(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, " Complements ").when(F.col("doc_id") % 3 == 1, "constrains").otherwise("same_ku")
    answer = F.format_string('{"relations":[{"relation":"%s","evidence_source":"%s","evidence_target":"%s"}]}', name, F.col("lang"), F.col("source"))
    rows = adapters.table(spark, d, "documents").select(
        F.col("doc_id").alias("_ord"), answer.alias("content"), F.lit("docs").alias("left_dataset"), F.lit("docs").alias("right_dataset"), F.col("lang").alias("left_api"), F.col("source").alias("right_api"),
        F.col("doc_id").cast("string").alias("left"), (F.col("doc_id") + 1).cast("string").alias("right"),
    )
    return build.judged_edges(judge.parse_relations(rows)).drop("_rank", "_ord")


def _rule_verifier(asked: DataFrame, step: int) -> DataFrame:
    """Assessments by a rule on the pair's number, which rejects half of all pairs."""
    number = F.right("pair_id", F.lit(6)).cast("long")
    return asked.select(*judge.IDS, "pair_id", (number % 4).cast("int").alias("api_fit"), (number % 3).cast("int").alias("ku_support"), F.lit(True).alias("keep"), F.array().cast("array<string>").alias("missing_needs"))


def _replayed(spark, d):
    """Retrieval with recorded answers: a first run's rule and choices are written down, and a second one replays them."""
    nodes, edges = _graph(spark, d)
    index = retrieve.make_index(adapters.pairs(spark, d), (adapters.queries(spark, d), adapters.pair_vectors(spark, d)), nodes, edges)
    asked = retrieve.materialize(adapters.queries(spark, d).select("dataset", "query_id", "query"))
    said: list[DataFrame] = []

    def verify(rows: DataFrame, step: int) -> DataFrame:
        said.append(retrieve.materialize(_rule_verifier(rows, step).withColumn("step", F.lit(step))))
        return said[-1]

    _, state, _ = retrieve.retrieve(asked, index, verify=verify)
    answers = retrieve.materialize(reduce(DataFrame.unionByName, said))
    choices = retrieve.materialize(state.trace.select(*judge.IDS, "step", "action_id", "reason"))
    return retrieve.retrieve(asked, index, verify=judge.replay_verifier(answers), choose=judge.replay_policy(choices), known=state.frontier)


def _retrieved(spark, d):
    nodes, edges = _graph(spark, d)
    vectors = adapters.queries(spark, d), adapters.pair_vectors(spark, d)
    index = retrieve.make_index(adapters.pairs(spark, d), vectors, nodes, edges)
    asked = retrieve.materialize(adapters.queries(spark, d).select("dataset", "query_id", "query"))
    return asked, index, retrieve.retrieve(asked, index)


#: What _rule_verifier() says of a pair, in SQL: whether it is accepted, and the order of those that are.
_ACCEPTED = "CAST(right(pair_id, 6) AS BIGINT) % 4 > 0 AND CAST(right(pair_id, 6) AS BIGINT) % 3 > 0"
_RANKED = "CAST(right(pair_id, 6) AS BIGINT) % 4 DESC, CAST(right(pair_id, 6) AS BIGINT) % 3 DESC, score DESC, pair_id"


def _unrolled(steps: int = 6, expansions: int = 3, batch: int = 6, cap: int = 30, top: int = 15, accepted: str = "true", ranked: str = "score DESC, pair_id") -> str:
    """The loop as common table expressions: states e (examined), d (discovered), w (pool) and c (control) of each step."""
    sql = with_views("v_scores", "v_roles", "v_api_links", "v_ku_links") + f""", p AS MATERIALIZED (SELECT pair_id, canonical_api AS api FROM v_pairs), sc AS MATERIALIZED (SELECT query_id, pair_id, score FROM v_scores),
    ro AS MATERIALIZED (SELECT * FROM v_roles), al AS MATERIALIZED (SELECT * FROM v_api_links), kl AS MATERIALIZED (SELECT * FROM v_ku_links),
    e0 AS MATERIALIZED (SELECT query_id, pair_id FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pair_id) <= 5),
    d0 AS MATERIALIZED (SELECT DISTINCT query_id, api FROM e0 JOIN p USING (pair_id)), c0 AS MATERIALIZED (SELECT DISTINCT query_id, 0 AS x, false AS stopped FROM e0),
    w0 AS MATERIALIZED (SELECT query_id, pair_id FROM e0 JOIN sc USING (query_id, pair_id) WHERE {accepted} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {ranked}) <= {cap})"""
    for k in range(1, steps + 1):
        j = k - 1
        sql += f""",
    u{k} AS MATERIALIZED (SELECT d.query_id, d.api, coalesce(r.role, 'all') AS role, p.pair_id, s.score FROM d{j} d JOIN c{j} c ON c.query_id = d.query_id AND NOT c.stopped JOIN p ON p.api = d.api
      JOIN sc s ON s.query_id = d.query_id AND s.pair_id = p.pair_id LEFT JOIN ro r ON r.pair_id = p.pair_id WHERE NOT EXISTS (SELECT 1 FROM e{j} e WHERE e.query_id = d.query_id AND e.pair_id = p.pair_id)),
    f{k} AS MATERIALIZED (SELECT query_id, min((api, role)) AS ar FROM u{k} GROUP BY query_id),
    r{k} AS MATERIALIZED (SELECT u.query_id, u.api, u.role, u.pair_id, row_number() OVER (PARTITION BY u.query_id ORDER BY u.score DESC, u.pair_id) AS place FROM u{k} u JOIN f{k} f ON f.query_id = u.query_id AND f.ar = (u.api, u.role) QUALIFY place <= {batch}),
    o{k} AS MATERIALIZED (SELECT c.query_id FROM c{j} c WHERE NOT c.stopped AND c.x < {expansions} AND c.query_id NOT IN (SELECT query_id FROM f{k})),
    g{k} AS MATERIALIZED (SELECT d.query_id, min((d.api, a.relation, a.target)) AS t FROM d{j} d JOIN o{k} USING (query_id) JOIN al a ON a.api = d.api WHERE NOT EXISTS (SELECT 1 FROM d{j} z WHERE z.query_id = d.query_id AND z.api = a.target) GROUP BY d.query_id),
    h{k} AS MATERIALIZED (SELECT e.query_id, min((e.pair_id, l.dir, l.place, l.relation, l.target)) AS t FROM e{j} e JOIN o{k} USING (query_id) JOIN kl l ON l.pair_id = e.pair_id WHERE e.query_id NOT IN (SELECT query_id FROM g{k})
      AND NOT EXISTS (SELECT 1 FROM e{j} z WHERE z.query_id = e.query_id AND z.pair_id = l.target) GROUP BY e.query_id),
    a{k} AS MATERIALIZED (SELECT query_id, 'READ_API' AS action, 'READ_API:' || any_value(api) || ':' || any_value(role) AS action_id, string_agg(pair_id, ',' ORDER BY place) AS verified FROM r{k} GROUP BY query_id
      UNION ALL SELECT query_id, 'EXPAND_API', 'EXPAND_API:' || struct_extract(t, 1) || ':' || struct_extract(t, 2) || ':' || struct_extract(t, 3), '' FROM g{k}
      UNION ALL SELECT query_id, 'EXPAND_KU', 'EXPAND_KU:' || struct_extract(t, 1) || ':' || struct_extract(t, 4) || ':' || struct_extract(t, 5), struct_extract(t, 5) FROM h{k}
      UNION ALL SELECT query_id, 'STOP', 'STOP', '' FROM c{j} WHERE NOT stopped AND query_id NOT IN (SELECT query_id FROM f{k} UNION ALL SELECT query_id FROM g{k} UNION ALL SELECT query_id FROM h{k})),
    e{k} AS MATERIALIZED (SELECT query_id, pair_id FROM e{j} UNION SELECT query_id, pair_id FROM r{k} UNION SELECT query_id, struct_extract(t, 5) FROM h{k}),
    d{k} AS MATERIALIZED (SELECT query_id, api FROM d{j} UNION SELECT query_id, struct_extract(t, 3) FROM g{k} UNION SELECT query_id, p.api FROM h{k} JOIN p ON p.pair_id = struct_extract(t, 5)),
    w{k} AS MATERIALIZED (SELECT query_id, pair_id FROM (SELECT query_id, pair_id FROM w{j} UNION SELECT query_id, pair_id FROM r{k} UNION SELECT query_id, struct_extract(t, 5) FROM h{k}) JOIN sc USING (query_id, pair_id)
      WHERE {accepted} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {ranked}) <= {cap}),
    x{k} AS MATERIALIZED (SELECT query_id, string_agg(pair_id, ',' ORDER BY pair_id) AS removed FROM (
      SELECT query_id, pair_id FROM w{j} WHERE NOT EXISTS (SELECT 1 FROM w{k} w WHERE w.query_id = w{j}.query_id AND w.pair_id = w{j}.pair_id)
      UNION SELECT query_id, pair_id FROM (SELECT query_id, pair_id FROM r{k} UNION SELECT query_id, struct_extract(t, 5) FROM h{k}) WHERE NOT ({accepted})) GROUP BY query_id),
    c{k} AS MATERIALIZED (SELECT c.query_id, c.x + CAST(coalesce(a.action IN ('EXPAND_API', 'EXPAND_KU'), false) AS INT) AS x, c.stopped OR coalesce(a.action = 'STOP', false) AS stopped FROM c{j} c LEFT JOIN a{k} a USING (query_id))"""
    return sql + f""",
    t AS ({" UNION ALL ".join(f"SELECT query_id, {k} AS step, action, action_id, verified, coalesce(removed, '') AS removed FROM a{k} LEFT JOIN x{k} USING (query_id)" for k in range(1, steps + 1))}),
    ranked AS (SELECT query_id, pair_id, api, score, row_number() OVER (PARTITION BY query_id ORDER BY {ranked}) AS place FROM w{steps} JOIN sc USING (query_id, pair_id) JOIN p USING (pair_id) QUALIFY place <= {top})
    """


@registered(_unrolled() + "SELECT query_id, place, pair_id, api, score FROM ranked")
def retrieve_heuristic(spark, d):
    _, _, (ranked, _, _) = _retrieved(spark, d)
    return ranked.select("query_id", "place", "pair_id", "api", "score")


@registered(_unrolled() + "SELECT query_id, step, action, action_id, verified, removed FROM t")
def retrieve_trace(spark, d):
    _, _, (_, state, _) = _retrieved(spark, d)
    return state.trace.select("query_id", "step", "action", "action_id", F.array_join("verified_pair_ids", ",").alias("verified"), F.array_join("removed_pair_ids", ",").alias("removed"))


@registered(_unrolled(accepted=_ACCEPTED, ranked=_RANKED) + "SELECT query_id, step, action, action_id, verified, removed FROM t")
def retrieve_replayed_trace(spark, d):
    """Recorded answers and choices, replayed: pairs go by rejection and by the cap."""
    _, state, _ = _replayed(spark, d)
    return state.trace.select("query_id", "step", "action", "action_id", F.array_join("verified_pair_ids", ",").alias("verified"), F.array_join("removed_pair_ids", ",").alias("removed"))


@registered(_unrolled(accepted=_ACCEPTED, ranked=_RANKED) + "SELECT query_id, place, pair_id, api, score FROM ranked")
def retrieve_replayed(spark, d):
    """The best pairs under recorded answers, in the order of their assessments."""
    ranked, _, _ = _replayed(spark, d)
    return ranked.select("query_id", "place", "pair_id", "api", "score")


_LISTS = {"initial_pair_ids": ("e0", "pair_id", "score DESC, pair_id"), "observed_pair_ids": ("e6", "pair_id", "pair_id"), "candidate_pool_pair_ids": ("w6", "pair_id", "score DESC, pair_id"), "ranked_pair_ids": ("ranked", "pair_id", "place")}


@registered(
    _unrolled()
    + ", "
    + ", ".join(f"l{i} AS (SELECT query_id, string_agg(x.{c}, ',' ORDER BY {o}) AS {name} FROM {t} x {'JOIN sc USING (query_id, pair_id)' if 'score' in o else ''} GROUP BY query_id)" for i, (name, (t, c, o)) in enumerate(_LISTS.items()))
    + """, l9 AS (SELECT query_id, string_agg(api, ',' ORDER BY api) AS discovered_apis FROM d6 GROUP BY query_id), n AS (SELECT query_id, count(*) AS events, string_agg(action, ',' ORDER BY step) AS actions FROM t GROUP BY query_id)
    SELECT 'docs' AS dataset, query_id, q.query, initial_pair_ids, observed_pair_ids, candidate_pool_pair_ids, ranked_pair_ids, discovered_apis, events, actions
    FROM v_queries q JOIN l0 USING (query_id) JOIN l1 USING (query_id) JOIN l2 USING (query_id) JOIN l3 USING (query_id) JOIN l9 USING (query_id) JOIN n USING (query_id)"""
)
def retrieve_results(spark, d):
    """The nested result rows, their lists joined."""
    asked, index, (ranked, state, seeds) = _retrieved(spark, d)
    rows = retrieve.results(asked, index, ranked, state, seeds)
    joined = lambda name: F.array_join(name, ",").alias(name)
    return rows.select(
        "dataset", "query_id", "query", joined("initial_pair_ids"), joined("observed_pair_ids"), joined("candidate_pool_pair_ids"), F.array_join("ranked_pairs.pair_id", ",").alias("ranked_pair_ids"),
        joined("discovered_apis"), F.size("trace").cast("long").alias("events"), F.array_join("trace.action", ",").alias("actions"),
    )
