"""The jobs as queries over the test tables, and their SQL. Each runs twice into one new folder, which stays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import collect_pairs, publish_graph
from jobs.common import read_config
from tessergraph.plans.adapters import VIEWS, with_views
from tessergraph.sources.durable import shared_dir


def _twice(job, spark: SparkSession, config: str, sf_dir: str, inputs: dict[str, str], outputs: list[str]) -> DataFrame:
    """The whole output of a job after a second run into the same new folder."""
    folder = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    paths = {f"{x}.path": f"{sf_dir}/{name}.parquet" for x, name in inputs.items()} | {x: f"{folder}/{x}" for x in outputs}
    for _ in range(2):
        out = job(spark, read_config(config, **paths))
    return out


def collect_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {"tutorial": "documents", "answers": "conversations", "specification": "benchmark"}
    out = _twice(collect_pairs.run, spark, collect_pairs.CONFIG, sf_dir, inputs, ["output", "checkpoint"])
    return out.select("pair_key", "dataset", "ku_source", "raw_api", "canonical_api", "reference", "reference_origin", "ku")


def publish_graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = {"pairs": "documents", "pairs.join": "labels", "references": "benchmark", "declarations": "nation"}
    out = _twice(publish_graph.run, spark, publish_graph.CONFIG, sf_dir, inputs, ["output"])
    return out.select(
        "dataset",
        "part",
        *[F.col(f"node.{c}").alias(f"node_{c}") for c in ("node_id", "kind", "api", "ku_identity", "source", "reference")],
        *[F.col(f"edge.{c}").alias(f"edge_{c}") for c in ("source", "target", "relation", "evidence", "basis")],
        *[F.col(f"class.{c}").alias(f"class_{c}") for c in ("ku_identity", "node_id", "size", "links")],
    )


def queries() -> dict:
    return {"job1_collect_pairs": collect_pairs_query, "job2_publish_graph": publish_graph_query}


_FOLD = lambda x: f"replace(lower({x}), 'ß', 'ss')"

COLLECT_SQL = (
    with_views("v_tutorial", "v_references")
    + rf"""
, u AS (
  SELECT 'SG' AS ku_source, trim(regexp_replace(api, '\s+', ' ', 'g')) AS raw_api, trim(regexp_replace(ku, '\s+', ' ', 'g')) AS ku, canonical_api, [_ord] AS o FROM v_tutorial
  UNION ALL SELECT 'QA', trim(regexp_replace(role, '\s+', ' ', 'g')), trim(regexp_replace(text, '\s+', ' ', 'g')), '', [conv_id, turn] FROM conversations
), n AS (
  SELECT *, sha256(ku_source || chr(0) || {_FOLD("raw_api")} || chr(0) || {_FOLD("ku")}) AS pair_key FROM u WHERE raw_api <> '' AND ku <> ''
  QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY o) = 1
)
SELECT pair_key, 'docs' AS dataset, ku_source, raw_api, n.canonical_api, coalesce(CASE WHEN a.key IS NOT NULL THEN a.reference ELSE b.reference END, '') AS reference,
  coalesce(CASE WHEN a.key IS NOT NULL THEN a.reference_origin ELSE b.reference_origin END, '') AS reference_origin, ku
FROM n LEFT JOIN v_references a ON a.key = {_FOLD("coalesce(nullif(n.canonical_api, ''), raw_api)")} LEFT JOIN v_references b ON b.key = {_FOLD("raw_api")}
"""
)

PUBLISH_SQL = (
    "WITH v_spec AS (" + VIEWS["v_spec"][1] + "), v_references AS (" + VIEWS["v_references"][1] + ")"
    + rf""", p AS (
  SELECT d.doc_id AS _ord, d.lang AS dataset, CASE WHEN doc_id % 2 = 0 THEN 'SG' ELSE 'QA' END AS ku_source, source AS api, d.lang || ':API:' || source AS api_node, d.lang || ':KU:' || source || ':' || printf('PAIR-%06d', doc_id + 1) AS node_id,
    sha256(CASE WHEN doc_id % 2 = 0 THEN 'SG' ELSE 'QA' END || chr(0) || {_FOLD(r"trim(regexp_replace(text, '\s+', ' ', 'g'))")}) AS ku_identity, l.toxic
  FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1
), n AS (
  SELECT dataset, node_id, 'KU' AS kind, api, ku_identity, ku_source AS source, '' AS reference FROM p
  UNION ALL SELECT dataset, api_node, 'API', a.api, '', '', coalesce(r.reference, '') FROM (SELECT DISTINCT dataset, api_node, api FROM p) a LEFT JOIN v_references r ON r.key = lower(a.api)
), x AS (
  SELECT dataset, node_id AS source, api_node AS target, 'has_guidance' AS relation, '' AS evidence, 'lamic' AS basis FROM p
  UNION ALL SELECT dataset, node_id, api_node, 'has_constraint', '', 'lamic' FROM p WHERE toxic = 1
  UNION ALL SELECT DISTINCT ON (source, target, relation) * FROM (
    SELECT k AS dataset, k || ':API:src' || n_nationkey AS source, k || ':API:src' || n_regionkey AS target, ['subtype_of', 'accepts', 'returns'][n_regionkey % 3 + 1] AS relation, n_name AS evidence, 'official_declaration' AS basis
    FROM (SELECT *, ['en', 'de', 'fr', 'es'][n_nationkey % 4 + 1] AS k FROM nation) WHERE n_nationkey <> n_regionkey)
), e AS (SELECT * FROM x WHERE source IN (SELECT node_id FROM n) AND target IN (SELECT node_id FROM n)
), s AS (SELECT dataset, ku_identity, api, count(*) AS same FROM p GROUP BY ALL
), z AS (SELECT dataset, ku_identity, CAST(sum(same) AS BIGINT) AS size FROM s GROUP BY ALL HAVING count(*) > 1
), c AS (SELECT p.dataset, p.ku_identity, p.node_id, z.size, z.size - s.same AS links FROM p JOIN s USING (dataset, ku_identity, api) JOIN z USING (dataset, ku_identity))
SELECT dataset, 'node' AS part, node_id AS node_node_id, kind AS node_kind, api AS node_api, ku_identity AS node_ku_identity, source AS node_source, reference AS node_reference,
  NULL AS edge_source, NULL AS edge_target, NULL AS edge_relation, NULL AS edge_evidence, NULL AS edge_basis, NULL AS class_ku_identity, NULL AS class_node_id, NULL AS class_size, NULL AS class_links FROM n
UNION ALL SELECT dataset, 'edge', NULL, NULL, NULL, NULL, NULL, NULL, source, target, relation, evidence, basis, NULL, NULL, NULL, NULL FROM e
UNION ALL SELECT dataset, 'class', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ku_identity, node_id, size, links FROM c
"""
)


def oracle_sql() -> dict:
    return {"job1_collect_pairs": COLLECT_SQL, "job2_publish_graph": PUBLISH_SQL}
