"""Builds the two-layer graphs of all data sets in the input and publishes each as a whole.

    python -m jobs.publish_graph --config jobs/publish_graph.toml --pairs P --references R --declarations D --output O

Output, in the folder ``output``:

``graph``   partitioned by ``dataset``; ``part`` says what a row is, and so which of the columns ``node``, ``edge`` and
            ``class`` it has. Classes stand for the same_ku edges between units of equal text, see
            tessergraph.operators.build.identity_classes; they grow with the units, not with their pairs.
``report``  JSON lines: rows of each data set by part and kind or relation

All parts of a data set are written in one go and replace its partition, so its nodes, edges and classes always fit each
other. Data sets that the input lacks stay as they are. Running again over the same input gives the same output.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, load, log, shaped
from tessergraph.operators import build, collect

CONFIG = str(Path(__file__).with_suffix(".toml"))

NODE = [c for c in build.NODE_COLUMNS if c != "dataset"]
CLASS = {"ku_identity": "string", "node_id": "string", "api": "string", "_ord": "long", "size": "long", "links": "long"}
_strings = lambda names: ", ".join(f"{c}: string" for c in names)
GRAPH = (
    f"part string, node struct<{_strings(NODE)}, _ord: long>, "
    f"edge struct<{_strings(build.EDGE_COLUMNS)}, _place: struct<_rank: int, _ord: struct<a: long, b: long>>>, "
    f"class struct<{', '.join(f'{c}: {t}' for c, t in CLASS.items())}>, dataset string"
)


def read_graph(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(GRAPH).parquet(f"{output}/graph")


def parts(admitted: DataFrame, references: DataFrame | None, declarations: DataFrame | None) -> DataFrame:
    """All rows of the graphs of admitted pairs, in the table's columns."""
    nodes, edges = build.assemble(admitted, references, declarations, expand=False)
    classes = build.identity_classes(nodes.where("kind = 'KU'"))  # from the written nodes, whose identities are known
    homes = nodes.select(F.col("node_id").alias("source"), "dataset").distinct()
    rows = {
        "node": nodes.select("dataset", F.struct(*NODE, "_ord").alias("node")),
        "edge": edges.join(homes, "source").select("dataset", F.struct(*build.EDGE_COLUMNS, "_place").alias("edge")),
        "class": classes.select("dataset", F.struct(*CLASS).alias("class")),
    }
    whole = None
    for part, df in rows.items():
        own = df.withColumn("part", F.lit(part))
        whole = own if whole is None else whole.unionByName(own, allowMissingColumns=True)
    return whole.select("part", "node", "edge", "class", "dataset")


def report(graph: DataFrame) -> DataFrame:
    """(dataset, part, kind, rows): nodes by kind, edges by relation, classes together."""
    kind = F.coalesce("node.kind", "edge.relation", F.lit("same_ku"))
    return graph.groupBy("dataset", "part", kind.alias("kind")).agg(F.count("*").alias("rows"))


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Publishes the graph of each data set of the input and returns the whole published table."""
    output = config["output"]
    inputs = {name: shaped(load(spark, config[name]), config[name]) for name in ("pairs", "references", "declarations") if name in config}
    for name in inputs:
        log.info("publish_graph: %s from %s", name, config[name]["path"])
    references = collect.references(inputs["references"]) if "references" in inputs else None
    admitted = build.own_datasets(build.admit(inputs["pairs"]))
    whole = parts(admitted, references, inputs.get("declarations"))
    # Rows are dealt so that a data set's files are few, and a large one is still written by many tasks.
    whole.hint("rebalance", "dataset").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(f"{output}/graph")
    graph = read_graph(spark, output)
    told = report(graph)
    told.coalesce(1).write.mode("overwrite").json(f"{output}/report")  # a row for each data set and kind
    for r in spark.read.schema(told.schema).json(f"{output}/report").groupBy("part").agg(F.sum("rows").alias("rows"), F.count_distinct("dataset").alias("sets")).collect():
        log.info("publish_graph: %s/graph has %d rows of %s in %d data sets", output, r["rows"], r["part"], r["sets"])
    return graph


if __name__ == "__main__":
    command_line(run, "publish_graph", CONFIG, ["pairs", "references", "declarations"], ["output"])
