"""The retrieve command over a whole small release, and the ledger of a model's answers."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessergraph.functions.relations import DATASETS
from tessergraph.operators import judge, similarity
from tessergraph.plans import cli
from tests.test_core import frame

WORDS = ["list of numbers", "map of names", "read a file", "close a stream", "sort by key", "parse a date"]


@pytest.fixture(scope="module")
def whole_release(tmp_path_factory):
    """Nine data sets of 30 queries and eight pairs each, as CSV files."""
    root = tmp_path_factory.mktemp("release")

    def put(path, columns, rows):
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", encoding="utf-8", newline="") as out:
            csv.writer(out).writerows([columns, *rows])

    queries = [(name, i, f"how to {WORDS[(i + k) % 6]}", f"A{i % 3}| |B") for k, name in enumerate(DATASETS) for i in range(30, 0, -1)]
    put(root / "queries.csv", ["dataset", "query_id", "query", "ground_truth_apis"], queries)
    for name in DATASETS:
        pairs = [(f"PAIR-{i:06d}", name, "SG", f"A{i % 3}", f"{WORDS[i % 6]}, {name} {i}") for i in range(8)]
        put(root / name / "knowledge_pairs.csv", ["pair_id", "dataset", "ku_source", "canonical_api", "ku"], pairs)
        nodes = [(f"{name}:API:A{i}", name, "API", f"A{i}", "") for i in range(3)] + [(f"{name}:KU:{a}:{p}", name, "KU", a, p) for p, _, _, a, _ in pairs]
        put(root / name / "nodes.csv", ["node_id", "dataset", "kind", "api", "pair_id"], nodes)
        put(root / name / "edges.csv", ["source", "target", "relation"], [(f"{name}:API:A0", f"{name}:API:A1", "accepts"), (f"{name}:KU:A0:PAIR-000000", f"{name}:API:A0", "has_example")])
    return root


def command(spark, root, out, *options):
    before = spark.conf.get("spark.sql.caseSensitive")
    args = ["retrieve", "--queries", f"{root}/queries.csv", "--data-root", str(root), "--output", str(out), "--controller", "heuristic", "--verifier", "similarity", "--max-actions", "2", *options]
    try:
        cli.main(args)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def seeds(name, query):
    """The first five pairs by the offline encoder, in plain Python."""
    encode = similarity.hashed_encoder()
    texts = [f"A{i % 3} {WORDS[i % 6]}, {name} {i}" for i in range(8)]
    scores = encode(texts).astype(float) @ encode([query])[0].astype(float)
    return [f"PAIR-{i:06d}" for i in sorted(range(8), key=lambda i: (-round(float(scores[i]), 9), i))[:5]]


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*.json")) for x in p.read_text(encoding="utf-8").splitlines()]


def test_one_query(spark, whole_release, tmp_path, capsys):
    command(spark, whole_release, tmp_path, "--dataset", "math", "--query-id", "7")
    (row,) = lines(tmp_path / "math.json")
    assert (row["dataset"], row["query_id"], row["query"], row["ground_truth_apis"]) == ("math", 7, "how to " + WORDS[(7 + DATASETS.index("math")) % 6], ["A1", "B"])
    assert row["initial_pair_ids"] == seeds("math", row["query"])
    assert len(row["trace"]) == 2 and row["trace"][0]["action"] == "READ_API" and {p["pair_id"] for p in row["ranked_pairs"]} <= set(row["observed_pair_ids"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"written": f"{tmp_path}/math.json", "queries": 1}


def test_words_of_ones_own(spark, whole_release, tmp_path):
    command(spark, whole_release, tmp_path, "--dataset", "text", "--query", "sort numbers by key", "--query-id", "3")
    (row,) = lines(tmp_path / "text.json")
    assert (row["query_id"], row["query"], row.get("ground_truth_apis", [])) == (0, "sort numbers by key", []) and row["initial_pair_ids"] == seeds("text", row["query"])


def test_a_data_set_and_all(spark, whole_release, tmp_path):
    command(spark, whole_release, tmp_path, "--dataset", "smack", "--max-actions", "1")
    own = {r["query_id"]: r for r in lines(tmp_path / "smack.json")}
    assert sorted(own) == list(range(1, 31))
    (tmp_path / "results.json").mkdir()
    (tmp_path / "results.json" / "part-left-over.json").write_text('{"dataset": "old"}\n')  # of an earlier run
    command(spark, whole_release, tmp_path, "--all", "--max-actions", "1")
    rows = lines(tmp_path / "results.json")
    assert sorted((r["dataset"], r["query_id"]) for r in rows) == sorted((d, i) for d in DATASETS for i in range(1, 31))
    assert {r["query_id"]: r for r in rows if r["dataset"] == "smack"} == own


def test_a_release_that_lacks_a_file(spark, whole_release, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing"):
        from tessergraph.plans import release

        release.validate_release(spark, str(tmp_path / "nothing"), f"{whole_release}/queries.csv")
    with pytest.raises(SystemExit):
        command(spark, whole_release, tmp_path)


def counting(folder, fail_after=None):
    """A model that leaves a file for each call, and breaks off after some."""

    def call(system, user, max_tokens=1200):
        import os
        import uuid

        if fail_after is not None and len(os.listdir(folder)) >= fail_after:
            raise RuntimeError("the model is gone")
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return f"{system}: {json.loads(user)['q'].upper()}"

    return call


def test_a_ledger_asks_nothing_twice(spark, tmp_path, monkeypatch):
    """A model that breaks off midway: what was written before is not asked again, and equal prompts are asked once."""
    monkeypatch.setattr(judge, "CHUNK", 10)
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"question {i % 60}", "x") for i in range(90)], "i long, q string, content2 string").repartition(3)
    with pytest.raises(Exception, match="the model is gone"):
        judge.ask(rows, counting(calls, 35), "S", ["q"], ledger=ledger)
    before, kept = len(list(calls.iterdir())), judge.read_ledger(spark, ledger).count()
    assert before >= 35 and 10 <= kept <= 35
    got = judge.ask(rows, counting(calls), "S", ["q"], ledger=ledger)
    assert {(r.i, r.content) for r in got.collect()} == {(i, f"S: QUESTION {i % 60}") for i in range(90)} and got.columns == [*rows.columns, "content"]
    assert len(list(calls.iterdir())) == before + 60 - kept
    again = judge.ask(rows.unionByName(spark.createDataFrame([(99, "question 100", "x")], rows.schema)), counting(calls), "S", ["q"], ledger=ledger)
    assert again.count() == 91 and len(list(calls.iterdir())) == before + 61 - kept
    assert judge.ask(rows, counting(calls), "other", ["q"], ledger=ledger).where("content LIKE 'other%'").count() == 90
    assert len(list(calls.iterdir())) == before + 121 - kept


def test_top_pairs_against_numpy(spark, monkeypatch):
    """Blocks, parts, ties by id, groups and vectors of several lengths; nulls meet nothing."""
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 4)
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 16)
    draw = np.random.default_rng(5)
    vec = lambda n: [float(x) for x in np.round(draw.normal(size=n), 1)]
    queries = [("d" if i % 3 else "e", i, vec(5 if i % 7 else 3)) for i in range(25)] + [("d", 90, None), ("d", 91, [None, 1.0])]
    pairs = [("d" if i % 2 else "e", f"P{i:03}", ["a"] if i % 3 else ["a", "b"], vec(5 if i % 5 else 3)) for i in range(120)]
    pairs += [(d, f"T{p}", g, v) for d, p, g, v in pairs[:30]] + [("d", "N1", ["a"], None), ("d", "N2", ["a"], [1.0, None, 1.0, 1.0, 1.0]), ("d", "N3", [], vec(5))]
    q = spark.createDataFrame(queries, "dataset string, query_id int, embedding array<float>")
    p = spark.createDataFrame(pairs, "dataset string, pair_id string, groups array<string>, embedding array<float>")
    got = {}
    for r in similarity.top_pairs(q, p, 4, F.lit("k")).orderBy("place").collect():
        got.setdefault((r.dataset, r.query_id, r.group), []).append((r.pair_id, r.score))
    want = {}
    f = lambda v: [float(np.float32(x)) for x in v]
    for d, i, v in queries[:25]:
        for group in "ab":
            found = []
            for e, name, groups, w in pairs:
                if e == d and group in groups and w is not None and None not in w and len(w) == len(v):
                    total = 0.0
                    for x, y in zip(f(v), f(w)):
                        total += x * y
                    found.append((-total, name))
            if found:
                want[d, i, group] = [(name, -s) for s, name in sorted(found)[:4]]
    assert got == want and len(want) > 40
