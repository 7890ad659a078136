"""Model modes against a fake client, the contract of answers, and shared storage."""

import json
from argparse import Namespace

import pytest
from pyspark.sql import functions as F

from tessergraph.operators import candidates, judge
from tessergraph.plans import cli, retrieve
from tessergraph.sources import durable, files
from tests.test_core import frame


def fake_call(system, user, max_tokens=1200):
    """Picks the first legal action and keeps every pair; says how much it was shown."""
    asked = json.loads(user)
    if system == judge.CONTROL_PROMPT:
        assert asked["query"].startswith("query") and all({"pair_id", "api", "score", "knowledge_unit", "api_fit", "ku_support", "missing_needs"} <= set(e) for e in asked["evidence"])
        return json.dumps({"action_id": asked["legal_actions"][0]["id"], "reason": f"{len(asked['evidence'])} shown, best {asked['evidence'][0]['pair_id']}"})
    rows = [{"pair_id": p["pair_id"], "api_fit": 9, "ku_support": "1", "keep": False} for p in asked["pairs"]]
    rows += [{"pair_id": p["pair_id"], "api_fit": 1, "ku_support": 1, "keep": True, "missing_needs": "more"} for p in asked["pairs"]]  # the last answer on a pair counts
    return "Here: " + json.dumps({"assessments": rows + [{"pair_id": "of no one", "api_fit": 1}]})


def small_graph(spark):
    pairs = frame(spark, [(f"P{i}", f"A{i % 2}", f"text {i}", "d") for i in range(12)], ["pair_id", "canonical_api", "ku", "dataset"])
    nodes = frame(spark, [("a0", "API", "A0", ""), ("a1", "API", "A1", ""), ("k0", "KU", "A0", "P0")], ["node_id", "kind", "api", "pair_id"])
    edges = frame(spark, [("a0", "a1", "accepts"), ("k0", "a0", "has_example")], ["source", "target", "relation"])
    scores = spark.createDataFrame([("d", q, f"P{i}", 1 - i * q / 100 if i % 2 == 0 else -float(i)) for q in (1, 2) for i in range(12)], "dataset string, query_id int, pair_id string, score double")
    queries = spark.createDataFrame([("d", q, f"query {q}") for q in (1, 2)], "dataset string, query_id int, query string")
    return queries, pairs, scores, nodes, edges


def test_model_mode_follows_the_heuristic_one(spark, monkeypatch):
    monkeypatch.setattr(cli, "client", lambda args: fake_call)
    args = Namespace(verifier="llm", controller="llm", ledger=None)
    plain = {r.query_id: r for r in retrieve.run(*small_graph(spark)).collect()}
    got = {r.query_id: r for r in retrieve.run(*small_graph(spark), **cli.judges(args)).collect()}
    for q in (1, 2):
        assert [e.action_id for e in got[q].trace] == [e.action_id for e in plain[q].trace]
        assert [p.pair_id for p in got[q].ranked_pairs] == [p.pair_id for p in plain[q].ranked_pairs]
        assert got[q].trace[0].reason == "5 shown, best P0"
        assert got[q].verification["P0"].missing_needs == ["more"]


def test_scores_from_vectors_equal_the_table(spark):
    queries, pairs, _, nodes, edges = small_graph(spark)
    vectors = queries.withColumn("embedding", F.array(F.col("query_id").cast("float"), F.lit(1.0).cast("float"))), pairs.withColumn("embedding", F.array(F.col("_ord").cast("float"), F.lit(0.5).cast("float")))
    from tessergraph.operators.similarity import score_pairs

    one = retrieve.run(queries, pairs, vectors, nodes, edges).drop("query").orderBy("query_id").collect()
    assert one == retrieve.run(queries, pairs, score_pairs(*vectors), nodes, edges).drop("query").orderBy("query_id").collect()


def test_all_queries_may_stop_early(spark):
    rows = retrieve.run(*small_graph(spark), retrieve.Budget(max_actions=50)).collect()
    assert all(r.trace[-1].action == "STOP" and len(r.trace) < 10 for r in rows)


@pytest.mark.parametrize("parse", [judge.parse_labels, judge.parse_relations, judge.parse_assessments])
def test_answers_without_an_object_are_errors(spark, parse):
    assert parse(frame(spark, [("P1", 'so {"relations": []}')], ["pair_id", "content"]).drop("pair_id")).collect() is not None
    for bad in ("no object", "[1]", "{broken", ""):
        with pytest.raises(Exception, match="no JSON object"):
            parse(frame(spark, [("P1", bad)], ["pair_id", "content"]).drop("pair_id")).collect()


def test_order_of_candidates(spark):
    rows = [("a", "b", 0.2), ("a", "c", 0.9), ("b", "c", 0.2), ("a", "d", 0.5)]
    table = spark.createDataFrame(rows, '`left` string, `right` string, score double').repartition(3)
    got = [tuple(r)[:3] for r in candidates.ordered(table).orderBy("_ord").collect()]
    assert got == sorted(rows, key=lambda r: (-r[2], r[0], r[1]))


def test_shared_folder_is_needed_off_one_machine(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="share"):
        durable.shared_dir(Cluster)
    assert durable.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")



def test_order_over_several_csv_files(spark, tmp_path):
    rows = spark.range(5_000).select(F.format_string('n%d, "q"', "id").alias("name"), (F.lit(10_000) - F.col("id")).alias("_ord")).repartition(7)
    files.write_csv(rows.repartitionByRange(4, "_ord").sortWithinPartitions("_ord").drop("_ord"), f"{tmp_path}/four", ["name"])
    files.write_csv(rows, f"{tmp_path}/out", ["name"])
    assert len(list((tmp_path / "four").glob("part-*.csv"))) == 4
    for folder in ("four", "out"):
        again = files.read_csv(spark, f"{tmp_path}/{folder}")
        assert again.select("_ord").distinct().count() == 5_000
        assert [r.name for r in again.orderBy("_ord").collect()] == [f'n{i}, "q"' for i in range(4_999, -1, -1)]
