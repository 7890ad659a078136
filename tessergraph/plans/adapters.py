"""The test tables in the shapes that the operators take, with the same views in SQL for the oracles.

``documents`` stands for pairs and tutorial text, ``benchmark`` for the specification and the queries, ``conversations`` for
question-and-answer text, ``nation`` for declarations, and ``embeddings`` for encoded texts. All views take whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("_ord"), F.upper(F.concat(F.lit("src"), item % 25)).alias("api"), F.col("text").alias("description"), F.concat(F.lit("item"), item).alias("origin")
    )


def tutorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_ord"), F.col("source").alias("api"), F.col("text").alias("ku"), canonical.alias("canonical_api"))


def stackoverflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("_ord"), F.col("role").alias("api"), F.col("text").alias("answer"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    roles = F.concat_ws("|", F.when(F.col("quality") == 1, "has_guidance"), F.when(F.col("toxic") == 1, " has_constraint "), F.when(F.col("lang") == "de", "bogus_role"))
    return rows.select(
        F.col("doc_id").alias("_ord"),
        F.format_string("PAIR-%06d", F.col("doc_id") + 1).alias("pair_id"),
        F.lit("docs").alias("dataset"),
        F.when(F.col("lang") == "en", "SG").otherwise("QA").alias("ku_source"),
        F.col("source").alias("raw_api"),
        F.col("source").alias("canonical_api"),
        F.lit("").alias("reference"),
        F.lit("").alias("reference_origin"),
        F.col("text").alias("ku"),
        F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("identified_relevance"),
        roles.alias("lamic_role"),
        F.lit("").alias("lamic_evidence"),
    )


# API names that the texts mention, some often, some hardly ever and one never, of one character up.
WORDS = (
    "shan", "entre", "nicht", "para", "und der", "stion o", "onthe", "einen", "schlich", "verein", "mentre", "que la", "erst und", "ouer", "shther", "auxent",
    "rouen", "zuver", "bege", "andhe", "reatin", "Inther", "lichkeit", "elleaux", "con el", "License", "123", "@", "Zu", "que les", "$", "edand",
)


def language_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose APIs are 32 words and parts of words, so that texts mention other APIs."""
    return pairs(spark, sf_dir).withColumn("canonical_api", F.element_at(F.array(*map(F.lit, WORDS)), (F.col("_ord") * 7 % len(WORDS) + 1).cast("int")))


def two_api_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two APIs: all units of a group meet, and nearly every text mentions the other API."""
    return pairs(spark, sf_dir).withColumn("canonical_api", F.when(F.col("ku_source") == "SG", "en").otherwise("ein"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    relation = F.when(key % 4 == 0, "subtype_of").when(key % 4 == 1, " Accepts ").when(key % 4 == 2, "returns").otherwise("not_a_relation")
    return table(spark, sf_dir, "nation").select(
        key.cast("long").alias("_ord"), F.concat(F.lit("docs:API:src"), key).alias("source"), F.concat(F.lit("docs:API:src"), F.col("n_regionkey")).alias("target"), relation.alias("relation"), F.col("n_name").alias("evidence")
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).where("identified_relevance = '1'")
    node = lambda a, p: F.concat(F.lit("docs:KU:"), a, F.lit(":"), p)
    # Neighbours by rank, by a join on the rank: no task sees all rows.
    ranked = number(rows)
    after = ranked.select((F.col("index") - 1).alias("index"), F.col("canonical_api").alias("next_api"), F.col("pair_id").alias("next_pair"))
    kind = F.element_at(F.array(*map(F.lit, ("task_related", "complements", "constrains", "contrasts_with"))), (F.col("_ord") % 4 + 1).cast("int"))
    return ranked.join(after, "index", "left").select("_ord", node(F.col("canonical_api"), F.col("pair_id")).alias("source"), node(F.col("next_api"), F.col("next_pair")).alias("target"), kind.alias("relation"), F.lit("").alias("evidence"))


def number(rows: DataFrame) -> DataFrame:
    from tessergraph.operators.collect import number_rows

    return number_rows(rows.withColumn("_one", F.lit(0)), "_one").drop("_one")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "embedding").join(F.broadcast(rows.agg(F.count("*").alias("vectors"))))  # one row


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _vectors(spark, sf_dir)
    n = F.broadcast(held.agg(F.max("vectors").alias("n")))  # one row
    own = pairs(spark, sf_dir).join(n).withColumn("vec_id", F.col("_ord") % F.col("n"))
    return own.join(held.select("vec_id", "embedding"), "vec_id").drop("vec_id", "n")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _vectors(spark, sf_dir)
    n = F.broadcast(held.agg(F.max("vectors").alias("n")))  # one row
    asked = table(spark, sf_dir, "benchmark").join(n).withColumn("vec_id", F.col("item_id") % F.col("n"))
    return asked.join(held.select("vec_id", "embedding"), "vec_id").select(F.lit("docs").alias("dataset"), (F.col("item_id") + 1).cast("int").alias("query_id"), F.col("text").alias("query"), "embedding")


VIEWS = {
    "v_spec": ([], "SELECT item_id AS _ord, upper('src' || (item_id % 25)) AS api, text AS description, 'item' || item_id AS origin FROM benchmark"),
    "v_tutorial": ([], "SELECT doc_id AS _ord, source AS api, text AS ku, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS canonical_api FROM documents"),
    "v_stackoverflow": ([], "SELECT conv_id * 1000 + turn AS _ord, role AS api, text AS answer FROM conversations"),
    "v_pairs": (
        [],
        """SELECT d.doc_id AS _ord, printf('PAIR-%06d', d.doc_id + 1) AS pair_id, 'docs' AS dataset, CASE WHEN d.lang = 'en' THEN 'SG' ELSE 'QA' END AS ku_source,
        d.source AS raw_api, d.source AS canonical_api, '' AS reference, '' AS reference_origin, d.text AS ku, coalesce(CAST(l.quality AS VARCHAR), '') AS identified_relevance,
        concat_ws('|', CASE WHEN l.quality = 1 THEN 'has_guidance' END, CASE WHEN l.toxic = 1 THEN ' has_constraint ' END, CASE WHEN d.lang = 'de' THEN 'bogus_role' END) AS lamic_role,
        '' AS lamic_evidence FROM documents d LEFT JOIN labels l USING (doc_id)""",
    ),
    "v_lang": (["v_pairs"], f"SELECT * REPLACE ({list(WORDS)}[_ord * 7 % {len(WORDS)} + 1] AS canonical_api) FROM v_pairs"),
    "v_declarations": (
        [],
        """SELECT n_nationkey AS _ord, 'docs:API:src' || n_nationkey AS source, 'docs:API:src' || n_regionkey AS target,
        CASE n_nationkey % 4 WHEN 0 THEN 'subtype_of' WHEN 1 THEN ' Accepts ' WHEN 2 THEN 'returns' ELSE 'not_a_relation' END AS relation, n_name AS evidence FROM nation""",
    ),
    "v_relations": (
        ["v_pairs"],
        """SELECT _ord, 'docs:KU:' || canonical_api || ':' || pair_id AS source, 'docs:KU:' || lead(canonical_api) OVER (ORDER BY _ord) || ':' || lead(pair_id) OVER (ORDER BY _ord) AS target,
        CASE _ord % 4 WHEN 0 THEN 'task_related' WHEN 1 THEN 'complements' WHEN 2 THEN 'constrains' ELSE 'contrasts_with' END AS relation, '' AS evidence FROM v_pairs WHERE identified_relevance = '1'""",
    ),
    "v_pair_vec": (["v_pairs"], "SELECT p.*, e.embedding FROM v_pairs p JOIN embeddings e ON e.vec_id = p._ord % (SELECT count(*) FROM embeddings)"),
    "v_queries": (
        [],
        "SELECT 'docs' AS dataset, CAST(b.item_id + 1 AS INTEGER) AS query_id, b.text AS query, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id % (SELECT count(*) FROM embeddings)",
    ),
    "v_ku_nodes": (
        ["v_pairs"],
        r"""SELECT 'docs:KU:' || canonical_api || ':' || pair_id AS node_id, 'docs' AS dataset, 'KU' AS kind, 'docs:API:' || canonical_api AS api_node, canonical_api AS api, '' AS canonical_owner, pair_id,
        sha256(ku_source || chr(0) || replace(lower(trim(regexp_replace(ku, '\s+', ' ', 'g'))), 'ß', 'ss')) AS ku_identity, ku_source AS source, '' AS task, ku AS text, '' AS reference, '' AS reference_origin, _ord
        FROM v_pairs WHERE identified_relevance = '1' AND canonical_api <> ''""",
    ),
    "v_references": (
        ["v_spec"],
        r"""SELECT key, arg_max(canonical_api, _ord) AS canonical_api, arg_max(reference, _ord) AS reference, arg_max(reference_origin, _ord) AS reference_origin, min(_ord) AS _ord FROM (
        SELECT lower(api) AS key, api AS canonical_api, trim(regexp_replace(description, '\s+', ' ', 'g')) AS reference, origin AS reference_origin, _ord FROM v_spec) WHERE reference <> '' GROUP BY key""",
    ),
    "v_api_nodes": (
        ["v_pairs", "v_references"],
        """SELECT 'docs:API:' || p.api AS node_id, 'docs' AS dataset, 'API' AS kind, '' AS api_node, p.api, '' AS canonical_owner, '' AS pair_id, '' AS ku_identity, '' AS source, '' AS task, '' AS text,
        coalesce(r.reference, '') AS reference, coalesce(r.reference_origin, '') AS reference_origin
        FROM (SELECT DISTINCT canonical_api AS api FROM v_pairs WHERE identified_relevance = '1' AND canonical_api <> '') p LEFT JOIN v_references r ON r.key = lower(p.api)""",
    ),
    "v_raw_edges": (
        ["v_ku_nodes", "v_pairs", "v_declarations", "v_relations"],
        r"""SELECT 0 AS rk, _ord AS a, i AS b, 'docs:KU:' || canonical_api || ':' || pair_id AS source, 'docs:API:' || canonical_api AS target, trim(role) AS relation, '' AS evidence, 'lamic' AS basis
        FROM (SELECT *, unnest(string_split(lamic_role, '|')) AS role, generate_subscripts(string_split(lamic_role, '|'), 1) AS i FROM v_pairs WHERE identified_relevance = '1')
        WHERE trim(role) IN ('has_explanation', 'has_guidance', 'has_example', 'has_constraint')
        UNION ALL SELECT 1, l._ord, r._ord, l.node_id, r.node_id, 'same_ku', l.ku_identity, 'deterministic_identity' FROM v_ku_nodes l JOIN v_ku_nodes r USING (ku_identity) WHERE l._ord < r._ord AND l.api <> r.api
        UNION ALL SELECT 3, _ord, 0, source, target, lower(trim(relation)), evidence, 'official_declaration' FROM v_declarations
        WHERE lower(trim(relation)) IN ('subtype_of', 'accepts', 'returns')
        UNION ALL SELECT 4, _ord, 0, source, target, relation, evidence, 'lamic' FROM v_relations""",
    ),
    "v_nodes": (["v_api_nodes", "v_ku_nodes"], "SELECT node_id, kind, api, pair_id FROM v_api_nodes UNION ALL SELECT node_id, kind, api, pair_id FROM v_ku_nodes"),
    "v_edges": (
        ["v_raw_edges", "v_nodes"],
        """SELECT source, target, relation, arg_max(evidence, (rk, a, b)) AS evidence, arg_max(basis, (rk, a, b)) AS basis, min((rk, a, b)) AS place FROM v_raw_edges
        WHERE source <> target AND source IN (SELECT node_id FROM v_nodes) AND target IN (SELECT node_id FROM v_nodes) GROUP BY source, target, relation""",
    ),
    "v_overlap": (
        ["v_lang"],
        r"""SELECT a.pair_id AS "left", b.pair_id AS "right", any_value(a.api) AS left_api, any_value(b.api) AS right_api, count(*) / greatest(1, any_value(a.n) + any_value(b.n) - count(*)) AS score
        FROM (SELECT pair_id, api, len(t) AS n, unnest(t) AS token FROM (SELECT pair_id, canonical_api AS api, list_distinct(regexp_extract_all(lower(ku), '[a-z][a-z0-9_.$]*|\p{Nd}+')) AS t FROM v_lang)) a
        JOIN (SELECT pair_id, api, len(t) AS n, unnest(t) AS token FROM (SELECT pair_id, canonical_api AS api, list_distinct(regexp_extract_all(lower(ku), '[a-z][a-z0-9_.$]*|\p{Nd}+')) AS t FROM v_lang)) b
        ON a.token = b.token AND a.pair_id <> b.pair_id GROUP BY a.pair_id, b.pair_id""",
    ),
    "v_top": (
        ["v_overlap"],
        """SELECT *, left_api = right_api AS same_api FROM v_overlap QUALIFY row_number() OVER (PARTITION BY "left", left_api = right_api ORDER BY score DESC, "right") <= 3""",
    ),
    "v_mentions": (
        ["v_lang"],
        """SELECT DISTINCT p.pair_id AS "left", a.api FROM v_lang p JOIN (SELECT DISTINCT canonical_api AS api FROM v_lang) a ON a.api <> p.canonical_api AND contains(lower(p.ku), lower(a.api))""",
    ),
    "v_scores": (
        ["v_queries", "v_pair_vec"],
        "SELECT q.dataset, q.query_id, p.pair_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM v_queries q JOIN v_pair_vec p USING (dataset)",
    ),
    "v_neighbors": (
        ["v_edges"],
        """SELECT source AS node_id, 0 AS dir, place, target AS neighbor, relation FROM v_edges UNION ALL SELECT target, 1, place, source, relation FROM v_edges""",
    ),
    "v_roles": (
        ["v_edges", "v_nodes"],
        """SELECT DISTINCT CASE WHEN s.kind = 'KU' THEN s.pair_id ELSE t.pair_id END AS pair_id, e.relation AS role FROM v_edges e JOIN v_nodes s ON s.node_id = e.source JOIN v_nodes t ON t.node_id = e.target WHERE s.kind <> t.kind""",
    ),
    "v_api_links": (
        ["v_neighbors", "v_nodes"],
        """SELECT DISTINCT a.api, n.relation, t.api AS target FROM v_nodes a JOIN v_neighbors n ON n.node_id = a.node_id JOIN v_nodes t ON t.node_id = n.neighbor
        WHERE a.kind = 'API' AND t.kind = 'API' AND n.relation IN ('subtype_of', 'accepts', 'returns')""",
    ),
    "v_ku_links": (
        ["v_neighbors", "v_nodes"],
        """SELECT a.pair_id, n.dir, n.place, n.relation, t.pair_id AS target FROM v_nodes a JOIN v_neighbors n ON n.node_id = a.node_id JOIN v_nodes t ON t.node_id = n.neighbor
        WHERE a.kind = 'KU' AND t.kind = 'KU' AND n.relation IN ('task_related', 'complements', 'constrains', 'contrasts_with', 'same_ku')""",
    ),
}


#: The view behind two_api_pairs(), in the place of v_lang.
TWO_APIS = {"v_lang": (["v_pairs"], "SELECT * REPLACE (CASE WHEN ku_source = 'SG' THEN 'en' ELSE 'ein' END AS canonical_api) FROM v_pairs")}


def with_views(*names: str, instead: dict[str, tuple[list[str], str]] | None = None) -> str:
    """WITH and the views, those they need first; some may be replaced."""
    order: list[str] = []
    views = VIEWS | (instead or {})

    def visit(name: str) -> None:
        for below in views[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({views[n][1]})" for n in order) + "\n"
