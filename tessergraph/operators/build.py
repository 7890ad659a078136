"""Building the two-layer graph: API and knowledge-unit nodes, role, identity, judged and external edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.functions.relations import API_KU_RELATIONS, KU_RELATIONS, RELATIONS
from tessergraph.functions.text import api_node_id, casefold, identity, ku_node_id, normalize_ends, normalize_text, split_trimmed
from tessergraph.sources.durable import materialize

NODE_COLUMNS = [
    "node_id", "dataset", "kind", "api_node", "api", "canonical_owner", "pair_id", "ku_identity", "source", "task", "text", "reference", "reference_origin",
]
EDGE_COLUMNS = ["source", "target", "relation", "evidence", "basis", "evidence_source", "evidence_target"]


def column(df: DataFrame, name: str, default: str = ""):
    """A column, or a default where the table lacks it."""
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit(default)


def admit(pairs: DataFrame) -> DataFrame:
    """Pairs labelled relevant (all, where there are no labels) with an API, which is trimmed here once."""
    api = normalize_ends(column(pairs, "canonical_api"))
    return pairs.where((column(pairs, "identified_relevance", "1") == "1") & (api != "")).withColumn("canonical_api", api)


def default_dataset(admitted: DataFrame) -> DataFrame:
    """Fills blank data sets with the first admitted row's, or with ``dataset``; a build is of one data set."""
    own = normalize_ends(column(admitted, "dataset"))
    first = admitted.agg(F.min_by(own, "_ord").alias("_first"))
    name = F.coalesce(F.nullif("_first", F.lit("")), F.lit("dataset"))
    return admitted.join(F.broadcast(first)).withColumn("dataset", F.coalesce(F.nullif(own, F.lit("")), name)).withColumn("_graph", name).drop("_first")  # one row


def own_datasets(admitted: DataFrame) -> DataFrame:
    """Keeps each row's own data set, for a build of many data sets at once; blank ones become ``dataset``."""
    name = F.coalesce(F.nullif(normalize_ends(column(admitted, "dataset")), F.lit("")), F.lit("dataset"))
    return admitted.withColumn("dataset", name).withColumn("_graph", name)


def api_nodes(admitted: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """A node for each API: owner and description from its reference row, or else from its first pair, as a whole record."""
    fields = ("canonical_owner", "reference", "reference_origin")
    firsts = admitted.groupBy(F.col("canonical_api").alias("api"), "_graph").agg(
        F.min_by(F.struct(*[column(admitted, c).alias(c) for c in fields]), "_ord").alias("_row")
    )
    if references is not None:
        key = casefold(normalize_text(column(references, "canonical_api")))
        held = references.select(key.alias("_key"), F.struct(*[column(references, c).alias(c) for c in fields]).alias("_ref"), "_ord").where("_key <> ''")
        held = held.groupBy("_key").agg(F.max_by("_ref", "_ord").alias("_ref"))
        firsts = firsts.withColumn("_key", casefold("api")).join(held, "_key", "left").withColumn("_row", F.coalesce("_ref", "_row"))
    blank = F.lit("")
    return firsts.select(
        api_node_id(F.col("_graph"), F.col("api")).alias("node_id"),
        F.col("_graph").alias("dataset"),
        F.lit("API").alias("kind"),
        blank.alias("api_node"),
        "api",
        F.col("_row.canonical_owner").alias("canonical_owner"),
        *[blank.alias(c) for c in ("pair_id", "ku_identity", "source", "task", "text")],
        F.col("_row.reference").alias("reference"),
        F.col("_row.reference_origin").alias("reference_origin"),
    )


def ku_nodes(admitted: DataFrame) -> DataFrame:
    """A node for each admitted pair, with ``_ord``."""
    pair = normalize_ends(F.col("pair_id"))
    blank = F.lit("")
    return admitted.select(
        ku_node_id(F.col("_graph"), F.col("canonical_api"), pair).alias("node_id"),
        F.col("_graph").alias("dataset"),
        F.lit("KU").alias("kind"),
        api_node_id(F.col("_graph"), F.col("canonical_api")).alias("api_node"),
        F.col("canonical_api").alias("api"),
        blank.alias("canonical_owner"),
        pair.alias("pair_id"),
        identity(column(admitted, "ku_source"), casefold(normalize_text(column(admitted, "ku")))).alias("ku_identity"),
        column(admitted, "ku_source").alias("source"),
        column(admitted, "task").alias("task"),
        column(admitted, "ku").alias("text"),
        blank.alias("reference"),
        blank.alias("reference_origin"),
        "_ord",
    )


def _edge(df: DataFrame, rank: int, **values) -> DataFrame:
    given = {c: values.get(c, F.lit("")) for c in EDGE_COLUMNS}
    return df.select(*[v.alias(c) for c, v in given.items()], F.lit(rank).alias("_rank"), values["order"].alias("_ord"))


def role_edges(admitted: DataFrame) -> DataFrame:
    """From a unit to its API, one for each valid role of its pair."""
    pair = normalize_ends(F.col("pair_id"))
    rows = admitted.select("*", F.posexplode(split_trimmed(column(admitted, "lamic_role"))).alias("_at", "_role")).where(F.col("_role").isin(*API_KU_RELATIONS))
    return _edge(
        rows, 0, source=ku_node_id(F.col("_graph"), F.col("canonical_api"), pair), target=api_node_id(F.col("_graph"), F.col("canonical_api")),
        relation=F.col("_role"), evidence=column(admitted, "lamic_evidence"), basis=F.lit("lamic"), order=F.struct(F.col("_ord").alias("a"), F.col("_at").cast("long").alias("b")),
    )


def identity_classes(units: DataFrame) -> DataFrame:
    """(dataset, ku_identity, node_id, api, _ord, size, links): the units of equal identity, where they are of two APIs or more.

    A class stands for the same_ku edges between its units: one between any two of different APIs. ``size`` counts its units,
    ``links`` a unit's edges, so both are known without listing any. Counts are summed before they are dealt by class.
    """
    by = ["dataset", "ku_identity"]
    own = units.groupBy(*by, "api").agg(F.count("*").alias("_same"))
    classes = own.groupBy(*by).agg(F.sum("_same").alias("size"), F.count("*").alias("_apis")).where("_apis > 1").drop("_apis")
    held = own.join(classes, by).withColumn("links", F.col("size") - F.col("_same")).drop("_same")
    return units.select(*by, "api", "node_id", "_ord").join(held, [*by, "api"]).select(*by, "node_id", "api", "_ord", "size", "links")


#: Units of a class that are paired in one task with as many others.
CLASS_BLOCK = 1_000


def same_ku_edges(units: DataFrame) -> DataFrame:
    """From an earlier unit to a later one of equal identity and another API.

    Only classes of two APIs are expanded. A large class is cut into blocks of about CLASS_BLOCK units, and blocks meet
    blocks, so no task holds all pairs of a class; a class of one block meets itself alone.
    """
    classes = identity_classes(units)
    blocks = F.ceil(F.col("size") / CLASS_BLOCK).cast("int")
    held = classes.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("node_id", "_ord"), F.col("_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    side = lambda p, keys: held.select("dataset", "ku_identity", *keys, F.col("node_id").alias(p), F.col("api").alias(f"{p}a"), F.col("_ord").alias(f"{p}o"))
    left = side("l", [F.col("_block").alias("_lb"), F.explode(every).alias("_rb")])
    right = side("r", [F.col("_block").alias("_rb"), F.explode(every).alias("_lb")])
    met = left.join(right, ["dataset", "ku_identity", "_lb", "_rb"]).where((F.col("lo") < F.col("ro")) & (F.col("la") != F.col("ra")))
    return _edge(
        met, 1, source=F.col("l"), target=F.col("r"), relation=F.lit("same_ku"), evidence=F.col("ku_identity"), basis=F.lit("deterministic_identity"),
        order=F.struct(F.col("lo").alias("a"), F.col("ro").alias("b")),
    )


def judged_edges(judged: DataFrame) -> DataFrame:
    """From (left_dataset, left_api, left, ..., relations array<struct<relation, evidence_source, evidence_target>>, _ord)."""
    rows = judged.select("*", F.posexplode("relations").alias("_at", "_r"))
    rows = rows.withColumn("_relation", F.lower(normalize_ends(F.coalesce("_r.relation", F.lit(""))))).where(
        F.col("_relation").isin(*[r for r in KU_RELATIONS if r != "same_ku"])
    )
    quote = lambda name: F.coalesce(F.col(f"_r.{name}"), F.lit(""))
    return _edge(
        rows, 2, source=ku_node_id(F.col("left_dataset"), F.col("left_api"), F.col("left")), target=ku_node_id(F.col("right_dataset"), F.col("right_api"), F.col("right")),
        relation=F.col("_relation"), evidence=quote("evidence_source"), basis=F.lit("llm_quote_grounded"), evidence_source=quote("evidence_source"),
        evidence_target=quote("evidence_target"), order=F.struct(F.col("_ord").alias("a"), F.col("_at").cast("long").alias("b")),
    )


def external_edges(rows: DataFrame, rank: int, basis: str) -> DataFrame:
    """Rows of a declarations or relations file with a known relation; ``basis`` only where the file has no such column."""
    relation = F.lower(normalize_ends(column(rows, "relation")))
    return _edge(
        rows.where(relation.isin(*RELATIONS)), rank, source=column(rows, "source"), target=column(rows, "target"), relation=relation,
        evidence=column(rows, "evidence"), basis=column(rows, "basis", basis), order=F.struct(F.col("_ord").alias("a"), F.lit(0).cast("long").alias("b")),
    )


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different nodes that are both there."""
    ids = nodes.select("node_id").distinct()
    kept = edges.where(F.col("source") != F.col("target"))
    return kept.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def last_wins(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the last one's values at the first one's place."""
    place = F.struct("_rank", "_ord")
    payload = F.struct("evidence", "basis", "evidence_source", "evidence_target")
    held = edges.groupBy("source", "target", "relation").agg(F.max_by(payload, place).alias("_last"), F.min(place).alias("_place"))
    return held.select("source", "target", "relation", "_last.*", "_place")


def assemble(
    admitted: DataFrame, references: DataFrame | None = None, declarations: DataFrame | None = None, relations: DataFrame | None = None, judged: DataFrame | None = None, expand: bool = True
) -> tuple[DataFrame, DataFrame]:
    """build() of admitted pairs whose data sets are settled; without ``expand`` there are no same_ku edges, see identity_classes()."""
    admitted = materialize(admitted)  # read for nodes, identities, roles and ends
    units = materialize(ku_nodes(admitted))
    nodes = materialize(api_nodes(admitted, references).withColumn("_ord", F.lit(None).cast("long"))).unionByName(units)
    parts = [role_edges(admitted)]
    if expand:
        parts.append(same_ku_edges(units))
    if judged is not None:
        parts.append(judged_edges(judged))
    for rank, (table, basis) in enumerate(((declarations, "official_declaration"), (relations, "lamic")), 3):
        if table is not None:
            parts.append(external_edges(table, rank, basis))
    edges = last_wins(with_ends(reduce(DataFrame.unionByName, parts), nodes))
    return nodes, edges


def build(
    pairs: DataFrame, references: DataFrame | None = None, declarations: DataFrame | None = None, relations: DataFrame | None = None, judged: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one data set; nodes order by (kind, api or _ord), edges by _place."""
    return assemble(default_dataset(admit(pairs)), references, declarations, relations, judged)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
