"""The jobs over growing copies of small tables, run again and again, and from their command lines."""

import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import collect_pairs, publish_graph, registry
from jobs.common import load_stream, read_config

ROOT = Path(__file__).resolve().parent.parent


def key(source, api, ku):
    return hashlib.sha256("\0".join((source, " ".join(api.split()).casefold(), " ".join(ku.split()).casefold())).encode()).hexdigest()


def plain_pairs(docs, turns):
    """{pair_key: (ku_source, api, ku)} of the first of equal pairs."""
    out = {}
    for source, rows in (("SG", sorted(docs)), ("QA", sorted(turns))):
        for *_, api, ku in rows:
            api, ku = " ".join((api or "").split()), " ".join((ku or "").split())
            if api and ku:
                out.setdefault(key(source, api, ku), (source, api, ku))
    return out


@pytest.fixture
def intake(spark, tmp_path):
    """A config over folders that put() adds files to."""
    config = read_config(collect_pairs.CONFIG, output=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
    for name, folder in (("tutorial", "docs"), ("answers", "turns"), ("specification", "spec")):
        config[name]["path"] = str(tmp_path / folder)

    def put(docs=(), turns=()):
        for folder, rows, schema in (("docs", docs, "doc_id long, source string, text string"), ("turns", turns, "conv_id long, turn long, role string, text string")):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    spark.createDataFrame([(0, "A map of things"), (1, "A second")], "item_id long, text string").write.parquet(str(tmp_path / "spec"))
    return config, put


def held(df):
    return {r.pair_key: (r.ku_source, r.raw_api, r.ku) for r in df.collect()}


def test_growing_input(spark, intake):
    config, put = intake
    docs = [(1, "SRC0", "Use  the map"), (0, "src0", "use the MAP"), (2, "src1", "Straße"), (3, "src1", None), (4, None, "x"), (6, "src1", " ")]
    turns = [(1, 0, "src0", "use the map"), (1, 1, "src9", "ask")]
    put(docs, turns)
    first = collect_pairs.run(spark, config)
    assert held(first) == plain_pairs(docs, turns)
    found = {r.pair_key: r for r in first.collect()}
    assert found[key("SG", "src0", "use the map")].reference == "A map of things" and found[key("SG", "src1", "strasse")].reference_origin == "item1"
    again = collect_pairs.run(spark, config)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))

    more_docs, more_turns = [(9, "src1", "STRASSE"), (8, "src2", "new\ttext"), (7, "Src2", "New text"), (0, "src0", "use the map")], [(2, 0, "src9", "ASK"), (2, 1, "src9", "answer")]
    put(more_docs, more_turns)
    second = collect_pairs.run(spark, config)
    rows = second.collect()
    assert len(rows) == len({r.pair_key for r in rows})
    new = {k: v for k, v in plain_pairs(more_docs, more_turns).items() if k not in plain_pairs(docs, turns)}
    assert held(second) == plain_pairs(docs, turns) | new and {r.batch for r in rows if r.pair_key in new} == {1}
    assert {r.batch for r in rows} == {0, 1} and new[key("SG", "src2", "new text")] == ("SG", "Src2", "New text")
    apis = {r.api_key: r for r in spark.read.parquet(f"{config['output']}/apis").collect()}
    assert {k: (r.tutorial_pairs, r.answer_pairs, r.described) for k, r in apis.items()} == {"src0": (1, 1, True), "src1": (1, 0, True), "src2": (1, 0, False), "src9": (0, 2, False)}
    assert apis["src0"].spellings == ["src0"]


def test_many_runs_equal_one(spark, small, tmp_path, intake):
    """Whole tables in three parts, a run after each, hold the same pairs as one run over everything."""
    config, put = intake
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    for k in range(3):
        put(docs[k::3], turns[k::3])
        out = collect_pairs.run(spark, config)
    assert set(held(out)) == set(plain_pairs(docs, turns))
    whole = registry.collect_pairs_query(spark, small)
    assert held(whole) == plain_pairs(docs, turns)


def test_a_batch_that_is_run_again(spark, intake):
    """A crash after the write and before the checkpoint: the same batch comes again, whole or half written before."""
    config, put = intake
    put([(0, "a", "x"), (1, "b", "y")], [(0, 0, "c", "z")])
    before = sorted(map(tuple, collect_pairs.run(spark, config).collect()))
    named = collect_pairs.collect.references(spark.createDataFrame([], "_ord long, api string, description string, origin string"))
    batch = spark.createDataFrame([(0, "SG", "d", "new", "", [2]), (0, "SG", "a", "x", "", [3]), (1, "QA", "c", "Z", "", [1, 0]), (1, "QA", "c", "y", "", [1, 1])], "src_rank int, ku_source string, raw_api string, ku string, canonical_api string, _ord array<long>")
    results = []
    for rows in (batch.where("ku_source = 'SG'"), batch, batch):
        collect_pairs.take(rows, 1, named, config["output"], "docs")
        results.append(sorted(map(tuple, collect_pairs.read_pairs(spark, config["output"]).collect())))
    assert results[1] == results[2] and len(results[2]) == len(before) + 2 and set(before) < set(results[2])


def test_empty_and_single_files(spark, tmp_path, intake):
    config, put = intake
    put()
    assert collect_pairs.run(spark, config).count() == 0
    put([(5, "a", "x")])
    assert held(collect_pairs.run(spark, config)) == plain_pairs([(5, "a", "x")], [])
    files = [p for p in (tmp_path / "docs").glob("part-*.parquet") if spark.read.parquet(str(p)).count()]
    stream = load_stream(spark, {"path": str(files[0])})
    query = stream.writeStream.format("memory").queryName("single_file").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "single")).start()
    query.awaitTermination()
    assert [r.doc_id for r in spark.table("single_file").collect()] == [5]


def graph_config(tmp_path, small):
    paths = {"pairs": "documents", "pairs.join": "labels", "references": "benchmark", "declarations": "nation"}
    return read_config(publish_graph.CONFIG, output=str(tmp_path / "graph"), **{f"{k}.path": f"{small}/{v}.parquet" for k, v in paths.items()})


def rows_of(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def test_graphs_are_replaced_by_data_set(spark, tmp_path, small):
    config = graph_config(tmp_path, small)
    whole = rows_of(publish_graph.run(spark, config))
    assert whole == rows_of(publish_graph.run(spark, config)) and len(whole) > 100
    told = {(r.dataset, r.part, r.kind): r["rows"] for r in spark.read.json(f"{config['output']}/report").collect()}
    assert sum(told.values()) == len(whole)
    # One data set's input changes: its whole graph is replaced, the others stay.
    fewer = graph_config(tmp_path, small)
    fewer["pairs"]["where"] = "lang = 'en' AND doc_id % 2 = 0"
    after = publish_graph.run(spark, fewer)
    kept = [x for x in whole if json.loads(x)["dataset"] != "en"]
    assert rows_of(after.where("dataset <> 'en'")) == kept and kept
    units = after.where("dataset = 'en' AND part = 'node' AND node.kind = 'KU'").select(F.right("node.pair_id", F.lit(6)).cast("int").alias("n")).collect()
    assert units and all(r.n % 2 == 1 for r in units)
    ends = {r.node_id for r in after.where("part = 'node'").select("node.node_id").collect()}
    assert all({r.source, r.target} <= ends for r in after.where("part = 'edge'").select("edge.source", "edge.target").collect())
    publish_graph.run(spark, config)
    assert rows_of(publish_graph.read_graph(spark, config["output"])) == whole


def test_graph_without_pairs(spark, tmp_path, small):
    config = graph_config(tmp_path, small)
    config["pairs"]["where"] = "false"
    assert publish_graph.run(spark, config).count() == 0


def test_identities_are_worked_out_once(spark, tmp_path, small):
    """Classes are made of the written nodes: no digest of a text is left in the plan of what is published."""
    config = graph_config(tmp_path, small)
    pairs = publish_graph.shaped(publish_graph.load(spark, config["pairs"]), config["pairs"])
    rows = publish_graph.parts(publish_graph.build.own_datasets(publish_graph.build.admit(pairs)), None, None)
    assert "sha2" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_command_lines(spark, tmp_path, small):
    """Both command lines in sessions of their own, the config's paths replaced; they log what they read and wrote."""
    runs = {
        "collect_pairs": {"tutorial": f"{small}/documents.parquet", "answers": f"{small}/conversations.parquet", "specification": f"{small}/benchmark.parquet", "output": f"{tmp_path}/pairs", "checkpoint": f"{tmp_path}/check"},
        "publish_graph": {"config": f"{tmp_path}/own.toml", "declarations": f"{small}/nation.parquet", "output": f"{tmp_path}/graph"},
    }
    text = (ROOT / "jobs/publish_graph.toml").read_text()
    for name in ("documents", "labels", "benchmark"):
        text = text.replace(f'"{name}.parquet"', f'"{small}/{name}.parquet"')
    (tmp_path / "own.toml").write_text(text)
    for job, options in runs.items():
        args = [x for k, v in options.items() for x in (f"--{k}", v)]
        env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
        assert done.returncode == 0, done.stderr[-2000:]
        assert all(path in done.stderr for k, path in options.items() if k not in ("config", "checkpoint", "specification"))
    assert collect_pairs.read_pairs(spark, f"{tmp_path}/pairs").count() > 100
    assert publish_graph.read_graph(spark, f"{tmp_path}/graph").count() > 100
