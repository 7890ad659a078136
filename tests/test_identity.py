"""Units of equal text: classes, and the edges that they stand for."""

import random

from pyspark.sql import functions as F

from tessergraph.operators import build


def units(spark, rows):
    table = spark.createDataFrame([(i, f"P{i}", d, "SG", a, k, "1") for i, (d, a, k) in enumerate(rows)], "_ord long, pair_id string, dataset string, ku_source string, canonical_api string, ku string, identified_relevance string")
    return build.own_datasets(build.admit(table))


def plain_edges(rows):
    return {(i, j) for j, b in enumerate(rows) for i, a in enumerate(rows[:j]) if a[0] == b[0] and a[1] != b[1] and a[2].split() == b[2].split()}


def edges_of(df):
    number = lambda c: int(c.rsplit("P", 1)[1])
    found = [(number(r.source), number(r.target)) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_edges_and_link_counts(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(draw.choice("de"), draw.choice("ABC"), draw.choice(["x  y", "x y", "z", "one", f"own {i}"])) for i in range(150)]
    made = build.ku_nodes(units(spark, rows))
    want = plain_edges(rows)
    for block in (1_000, 7):  # classes of one block, and of many
        monkeypatch.setattr(build, "CLASS_BLOCK", block)
        assert edges_of(build.same_ku_edges(made)) == want
    links = {int(r.node_id.rsplit("P", 1)[1]): (r.links, r.size) for r in build.identity_classes(made).collect()}
    assert {i: n for i, (n, _) in links.items()} == {i: sum(i in e for e in want) for e in want for i in e}


def test_a_large_group_as_a_class(spark):
    """10,000 units of one text over three APIs build without listing their edges, of which there would be 3e7."""
    rows = spark.range(10_000).select(
        F.col("id").alias("_ord"), F.format_string("P%d", "id").alias("pair_id"), F.lit("d").alias("dataset"), F.lit("SG").alias("ku_source"), F.format_string("A%d", F.col("id") % 3).alias("canonical_api"), F.lit("one text").alias("ku")
    )
    admitted = build.own_datasets(build.admit(rows))
    nodes, edges = build.assemble(admitted, expand=False)
    assert (nodes.count(), edges.count()) == (10_003, 0)
    classes = build.identity_classes(build.ku_nodes(admitted))
    assert classes.agg(F.sum("links"), F.max("size"), F.count("*")).first() == (2 * (3334 * 3333 + 3334 * 3333 + 3333 * 3333), 10_000, 10_000)
