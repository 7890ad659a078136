"""Reading the graph: look-ups, neighbours, roles and expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.functions.relations import API_RELATIONS, KU_RELATIONS, RELATIONS
from tessergraph.functions.text import normalize_ends


def index_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node_id, the last one; ``_ord`` is the first one's place."""
    rest = [c for c in nodes.columns if c not in ("node_id", "_ord")]
    held = nodes.groupBy("node_id").agg(F.max_by(F.struct(*rest), "_ord").alias("_row"), F.min("_ord").alias("_ord"))
    return held.select("node_id", "_row.*", "_ord")


def index_edges(edges: DataFrame) -> DataFrame:
    """Edges of known relations, trimmed and lower-cased."""
    return edges.withColumn("relation", F.lower(normalize_ends(F.coalesce("relation", F.lit(""))))).where(F.col("relation").isin(*RELATIONS))


def first_node(nodes: DataFrame, kind: str, key: str) -> DataFrame:
    """(key, node_id): the first node of a kind for each key."""
    return nodes.where(F.col("kind") == kind).groupBy(key).agg(F.min_by("node_id", "_ord").alias("node_id"))


def neighbors(edges: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, dir, _ord, neighbor, relation): a node's edges outward (dir 0), then inward (1), each in file order.

    No relations mean all; an edge from a node to itself appears both ways.
    """
    kept = edges.where(F.col("relation").isin(*relations)) if relations else edges
    out = kept.select(F.col("source").alias("node_id"), F.lit(0).alias("dir"), "_ord", F.col("target").alias("neighbor"), "relation")
    back = kept.select(F.col("target").alias("node_id"), F.lit(1).alias("dir"), "_ord", F.col("source").alias("neighbor"), "relation")
    return out.unionByName(back)


def api_neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(api, dir, _ord, neighbor, relation) over API relations."""
    return first_node(nodes, "API", "api").join(neighbors(edges, API_RELATIONS), "node_id").drop("node_id")


def ku_neighbors(edges: DataFrame) -> DataFrame:
    return neighbors(edges, KU_RELATIONS)


def roles_by_pair(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, role): relations of any name between a unit and an API, whichever way they point."""
    ends = nodes.select("node_id", "kind", "pair_id")
    a = ends.select(F.col("node_id").alias("source"), F.col("kind").alias("sk"), F.col("pair_id").alias("sp"))
    b = ends.select(F.col("node_id").alias("target"), F.col("kind").alias("tk"), F.col("pair_id").alias("tp"))
    met = edges.select("source", "target", "relation").join(a, "source").join(b, "target")
    pair = F.when((F.col("sk") == "KU") & (F.col("tk") == "API"), F.col("sp")).when((F.col("sk") == "API") & (F.col("tk") == "KU"), F.col("tp"))
    return met.select(pair.alias("pair_id"), F.col("relation").alias("role")).where(F.col("pair_id").isNotNull()).distinct()


def api_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(api, relation, target): APIs that an API leads to."""
    targets = nodes.where("kind = 'API'").select(F.col("node_id").alias("neighbor"), F.col("api").alias("target"))
    return api_neighbors(nodes, edges).join(targets, "neighbor").select("api", "relation", "target").distinct()


def ku_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, dir, _ord, relation, target): units that a unit leads to, in the order of neighbours."""
    targets = nodes.where("kind = 'KU'").select(F.col("node_id").alias("neighbor"), F.col("pair_id").alias("target"))
    return first_node(nodes, "KU", "pair_id").join(ku_neighbors(edges), "node_id").join(targets, "neighbor").select("pair_id", "dir", "_ord", "relation", "target")


def expansions(links: DataFrame, found: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Links from what a query has found to what it has not seen. found and seen: (dataset, query_id, key)."""
    ids = ["dataset", "query_id"]
    known = seen.select(*ids, F.col(key).alias("target"))
    return found.join(links, key).join(known, [*ids, "target"], "left_anti")


def first_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
