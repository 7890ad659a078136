import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessergraph.functions import text
from tessergraph.operators import build, candidates, collect, graph, judge, similarity
from tessergraph.plans import release, retrieve
from tessergraph.sources import files


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns)).withColumn("_ord", F.monotonically_increasing_id())


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("value", ["a b\x1cc", "  x \n\t y ", "", None, "\x85 z", "no change"])
def test_normalize_like_split(spark, value):
    assert one(spark, value, text.normalize_text) == " ".join((value or "").split())


@pytest.mark.parametrize("value", ["Foo.bar$ _x 9a", "List<Map> a_b.c 12", None, "É ü x1"])
def test_tokens(spark, value):
    assert one(spark, value, text.tokens) == re.findall(r"[a-z][a-z0-9_.$]*|\d+", (value or "").lower())


def test_first_nonempty_takes_blanks(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")  # as the command lines do: files may have both api and API
    try:
        rows = frame(spark, [("  ", "Map", ""), ("", "Set", ""), ("", "", "")], ["api", "API", "raw_api"])
        got = [r.x for r in rows.select(text.first_nonempty(rows.columns, ("api", "API", "missing")).alias("x")).collect()]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert got == ["  ", "Set", ""]


def test_identity_and_ids(spark):
    row = spark.createDataFrame([("SG", "  Straße\nX ")], "s string, k string")
    got = row.select(text.identity(F.col("s"), text.casefold(text.normalize_text(F.col("k")))).alias("x")).first().x
    assert got == hashlib.sha256("SG\0strasse x".encode()).hexdigest()
    ids = spark.range(1).select(text.pair_id(F.lit(7)).alias("a"), text.pair_id(F.lit(1234567)).alias("b")).first()
    assert (ids.a, ids.b) == ("PAIR-000007", "PAIR-1234567")


def test_coercions(spark):
    clamps = spark.createDataFrame([("9", "-1"), ("2", "1"), ("x", None)], "f string, s string")
    assert [tuple(r) for r in clamps.select(text.clamp(F.col("f"), 3), text.clamp(F.col("s"), 2)).collect()] == [(3, 0), (2, 1), (0, 0)]
    assert one(spark, 'say {"a":1} end', text.json_object) == '{"a":1}' and one(spark, "none", text.json_object) is None
    assert one(spark, '["a","b"]', text.string_or_list) == ["a", "b"]
    assert one(spark, '"a"', text.string_or_list) == ["a"] and one(spark, "7", text.string_or_list) == []
    assert one(spark, " a | |b|", text.split_trimmed) == ["a", "b"]


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿id,ku,more\n1,"a ""q"" , x\ny",\n2,b\n', encoding="utf-8")
    rows = files.read_csv(spark, path)
    assert [tuple(r)[:3] for r in rows.orderBy("_ord").collect()] == [("1", 'a "q" , x\ny', ""), ("2", "b", "")]
    files.write_csv(rows, tmp_path / "out", ["ku", "id", "absent"])
    again = files.read_csv(spark, tmp_path / "out").orderBy("_ord").collect()
    assert [(r.ku, r.id, r.absent) for r in again] == [('a "q" , x\ny', "1", ""), ("b", "2", "")]
    digest = files.file_digests(spark, path).first().sha256
    assert digest == hashlib.sha256(path.read_bytes()).hexdigest()
    files.write_json(tmp_path / "x" / "y.json", {"é": 1})
    assert "é" in (tmp_path / "x" / "y.json").read_text(encoding="utf-8")


def test_queries_and_release(spark):
    rows = frame(spark, [("b", "2", "q", "A| B ||"), ("a", "10", "r", ""), ("a", "9", "s", "C")], ["dataset", "query_id", "query", "ground_truth_apis"])
    shaped = files.shape_queries(rows)
    assert [(r.dataset, r.query_id, r.ground_truth_apis) for r in shaped.collect()] == [("a", 9, ["C"]), ("a", 10, []), ("b", 2, ["A", "B"])]
    assert files.shape_queries(rows, "b").count() == 1
    release.check_queries(shaped.where("dataset = 'a'"), ("a",), range(9, 11))
    with pytest.raises(release.ReleaseError):
        release.check_queries(shaped, ("a",), range(9, 11))
    with pytest.raises(release.ReleaseError):
        release.check_queries(shaped.where("dataset = 'a'"), ("a",), range(1, 3))


def test_collect(spark):
    spec = frame(spark, [("Map", "d1", "o1"), ("List", "d2", ""), ("MAP", " d3 ", ""), ("", "lost", ""), ("Empty", "", "")], ["api", "description", "origin"])
    tutorial = frame(spark, [("map", "first", "List"), ("x", "", ""), ("Map", "second\nline", "")], ["api", "ku", "canonical_api"])
    answers = frame(spark, [("list", "third"), ("none", "fourth")], ["api", "answer"])
    pairs, refs = collect.collect(tutorial, answers, spec, "d")
    assert [(r.canonical_api, r.reference, r.reference_origin) for r in refs.orderBy("_ord").collect()] == [("MAP", "d3", ""), ("List", "d2", "")]
    got = [(r.pair_id, r.ku_source, r.raw_api, r.ku, r.reference, r.reference_origin) for r in pairs.orderBy("_ord").collect()]
    assert got == [
        ("PAIR-000001", "SG", "map", "first", "d2", ""),  # the canonical API's record, empty origin and all
        ("PAIR-000002", "SG", "Map", "second line", "d3", ""),
        ("PAIR-000003", "QA", "list", "third", "d2", ""),
        ("PAIR-000004", "QA", "none", "fourth", "", ""),
    ]
    assert pairs.select(*collect.PAIR_COLUMNS).columns == collect.PAIR_COLUMNS


def test_numbering_over_blocks(spark):
    rows = spark.range(0, 5 << 20, 70_001).select(F.lit(0).alias("rank"), F.col("id").alias("_ord"))
    got = [r["index"] for r in collect.number_rows(rows, "rank").orderBy("_ord").collect()]
    assert got == list(range(1, len(got) + 1))


def test_numbering_is_dealt_out(spark):
    """Neighbouring rows, with their texts, are numbered by several tasks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = spark.range(400_000).select(F.lit(0).alias("rank"), F.col("id").alias("_ord"))
        found = collect.number_rows(rows, "rank").withColumn("part", F.spark_partition_id())
        own = found.groupBy("part").agg(F.count("*").alias("n"), F.sum((F.col("index") == F.col("_ord") + 1).cast("int")).alias("right")).collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r.right for r in own) == 400_000 and max(r.n for r in own) < 200_000


PAIRS = ["pair_id", "dataset", "ku_source", "canonical_api", "ku", "identified_relevance", "lamic_role", "canonical_owner"]


def graph_input(spark):
    rows = [
        ("P1", "", "SG", " Map ", "same text", "1", "has_example|bogus| has_guidance", "own"),
        ("P2", "d", "SG", "List", "Same  TEXT", "1", "", ""),
        ("P3", "d", "QA", "List", "same text", "1", "has_constraint", ""),
        ("P4", "d", "SG", "Set", "other", "0", "has_example", ""),
        ("P5", "d", "SG", " ", "other", "1", "has_example", ""),
    ]
    return frame(spark, rows, PAIRS)


def test_build(spark):
    edge = ["source", "target", "relation", "evidence"]
    declared = frame(
        spark,
        [("dataset:API:Map", "dataset:API:List", " Subtype_Of ", "a"), ("dataset:API:Map", "dataset:API:Map", "returns", "loop"), ("dataset:API:Map", "no", "returns", ""), ("dataset:API:Map", "dataset:API:List", "likes", "")],
        edge,
    )
    related = frame(spark, [("dataset:KU:Map:P1", "dataset:API:Map", "has_example", "new"), ("dataset:API:Map", "dataset:API:List", "subtype_of", "b")], edge)
    refs = frame(spark, [("map", "described", "o")], ["canonical_api", "reference", "reference_origin"])
    nodes, edges = build.build(graph_input(spark), refs, declared, related)
    held = {r.node_id: r for r in nodes.collect()}
    assert set(held) == {"dataset:API:Map", "dataset:API:List", "dataset:KU:Map:P1", "dataset:KU:List:P2", "dataset:KU:List:P3"}
    assert (held["dataset:API:Map"].reference, held["dataset:API:Map"].canonical_owner) == ("described", "")
    got = [(r.source[8:], r.target[8:], r.relation, r.evidence, r.basis) for r in edges.orderBy("_place").collect()]
    same = held["dataset:KU:Map:P1"].ku_identity
    assert got == [
        ("KU:Map:P1", "API:Map", "has_example", "new", "lamic"),
        ("KU:Map:P1", "API:Map", "has_guidance", "", "lamic"),
        ("KU:List:P3", "API:List", "has_constraint", "", "lamic"),
        ("KU:Map:P1", "KU:List:P2", "same_ku", same, "deterministic_identity"),
        ("API:Map", "API:List", "subtype_of", "b", "lamic"),
    ]
    assert tuple(build.counts(nodes, edges).first()) == (5, 5)


def test_admission_without_labels(spark):
    assert build.admit(graph_input(spark).drop("identified_relevance")).count() == 4


def test_judged_edges(spark):
    answers = frame(spark, [('x {"relations":[{"relation":" Complements ","evidence_source":"s","evidence_target":"t"},{"relation":"same_ku"}]}',), ("{}",)], ["content"])
    rows = judge.parse_relations(answers).select("*", *[F.lit(v).alias(c) for c, v in (("left", "P1"), ("left_dataset", "d"), ("left_api", "A"), ("right", "P2"), ("right_dataset", "d"), ("right_api", "B"))])
    got = build.judged_edges(rows).collect()
    assert [(r.source, r.target, r.relation, r.evidence, r.evidence_target) for r in got] == [("d:KU:A:P1", "d:KU:B:P2", "complements", "s", "t")]


def plain_candidates(pairs, k):
    tokens = {p: set(re.findall(r"[a-z][a-z0-9_.$]*|\d+", t.lower())) for p, _, t in pairs}
    score = lambda a, b: len(tokens[a] & tokens[b]) / max(1, len(tokens[a] | tokens[b]))
    found = {}
    for p, api, ku in pairs:
        for same in (True, False):
            best = sorted(((-score(p, q), q) for q, other, _ in pairs if q != p and (other == api) == same and score(p, q) > 0))[:k]
            found |= {tuple(sorted((p, q))): -s for s, q in best}
        found |= {tuple(sorted((p, q))): score(p, q) for q, other, _ in pairs if other != api and other.lower() in ku.lower() and score(p, q) > 0}
    return found


def test_candidates(spark):
    draw = random.Random(4)
    words = ["map", "hash", "list", "get", "put", "x1", "HashMap", "sort", "iter"]
    pairs = [(f"P{i:02}", draw.choice(["Map", "List", "Sort"]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 7)))) for i in range(40)]
    table = frame(spark, pairs, ["pair_id", "canonical_api", "ku"])
    got = {(r.left, r.right): r.score for r in candidates.ku_candidates(table, 2, 2).collect()}
    assert got == pytest.approx(plain_candidates(pairs, 2))
    assert candidates.candidate_rows(table.withColumn("dataset", F.lit("d")), candidates.ku_candidates(table, 2, 2)).count() == len(got)


def plain_bm25(docs, query):
    from collections import Counter
    from math import log

    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    seen = Counter(t for d in docs for t in set(d))
    idf = {t: log(n - c + 0.5) - log(c + 0.5) for t, c in seen.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else low for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query) for d in docs]


def test_demonstrations(spark):
    draw = random.Random(7)
    words = "open the file with a reader and close it 1 2 Map.get() x_y".split()
    rows = [(f"D{i}", "A", " ".join(draw.choice(words) for _ in range(draw.randint(3, 12)))) for i in range(14)]
    table = frame(spark, rows, ["pair_id", "canonical_api", "ku"])
    ready = similarity.with_signature(similarity.with_vectors(table, text.pair_text(table.columns)), F.col("ku")).cache()
    got = {}
    for r in similarity.select_demonstrations(ready, ready, 6).orderBy("target", "rank").collect():
        got.setdefault(r.target, []).append(r.doc)
    encode, tag = similarity.hashed_encoder(), similarity.shape_tagger()
    texts = [f"A {ku}" for _, _, ku in rows]
    terms = [re.findall(r"[a-z][a-z0-9_.$]*|\d+", t.lower()) for t in texts]
    vectors = encode(texts).astype(float)
    tags = [set(tag(ku)) for _, _, ku in rows]
    for i, (name, _, _) in enumerate(rows):
        lists = (plain_bm25(terms, terms[i]), [round(float(v), 12) for v in vectors @ vectors[i]], [len(tags[i] & t) / max(1, len(tags[i] | t)) for t in tags])
        total = [0.0] * len(rows)
        for values in lists:
            for place, j in enumerate(sorted(range(len(rows)), key=lambda j: (-round(values[j], 9), j))):
                total[j] += 1 / (61 + place)
        want = sorted(range(len(rows)), key=lambda j: (-total[j], j))[:6]
        assert len(set(got[name]) & {rows[j][0] for j in want}) >= 5  # last bits may turn a tie


def test_graph_reading(spark):
    nodes = frame(spark, [("a", "API", "A", ""), ("b", "API", "B", ""), ("k", "KU", "A", "P1"), ("m", "KU", "B", "P2"), ("a2", "API", "A", "")], ["node_id", "kind", "api", "pair_id"])
    edges = frame(
        spark,
        [("a", "b", " Accepts "), ("a", "a", "returns"), ("k", "m", "complements"), ("k", "a", "has_example"), ("b", "m", "same_ku"), ("a", "b", "nothing")],
        ["source", "target", "relation"],
    )
    kept = graph.index_edges(edges)
    near = [(r.dir, r.neighbor, r.relation) for r in graph.neighbors(kept).where("node_id = 'a'").orderBy("dir", "_ord").collect()]
    assert near == [(0, "b", "accepts"), (0, "a", "returns"), (1, "a", "returns"), (1, "k", "has_example")]
    assert {(r.api, r.node_id) for r in graph.first_node(nodes, "API", "api").collect()} == {("A", "a"), ("B", "b")}
    assert {tuple(r) for r in graph.roles_by_pair(nodes, kept).collect()} == {("P1", "has_example"), ("P2", "same_ku")}
    assert {tuple(r) for r in graph.api_links(nodes, kept).collect()} == {("A", "accepts", "B"), ("B", "accepts", "A"), ("A", "returns", "A")}
    assert {(r.pair_id, r.target) for r in graph.ku_links(nodes, kept).collect()} == {("P1", "P2"), ("P2", "P1")}


def plain_retrieve(pairs, scores, roles, api_links, ku_links, budget):
    api = dict(pairs)
    order = lambda ps: sorted(ps, key=lambda p: (-scores[p], p))
    seen = set(order(scores)[:5])
    found, used, trace = {api[p] for p in seen}, 0, []
    for _ in range(budget.max_actions):
        reads = {}
        for p, a in pairs:
            if a in found and p not in seen:
                for role in roles.get(p, {"all"}):
                    reads.setdefault((a, role), []).append(p)
        if reads:
            key = min(reads)
            trace.append(f"READ_API:{key[0]}:{key[1]}")
            seen |= set(order(reads[key])[: budget.read_batch])
            continue
        apis = sorted((a, r, t) for a, r, t in api_links if a in found and t not in found) if used < budget.max_expansions else []
        units = sorted((p, d, o, r, t) for p, d, o, r, t in ku_links if p in seen and t not in seen) if used < budget.max_expansions else []
        if apis:
            trace.append("EXPAND_API:" + ":".join(apis[0]))
            found.add(apis[0][2])
        elif units:
            p, _, _, r, t = units[0]
            trace.append(f"EXPAND_KU:{p}:{r}:{t}")
            seen.add(t)
            found.add(api[t])
        else:
            trace.append("STOP")
            break
        used += 1
    return trace, order(seen)[:15], seen


@pytest.mark.parametrize("n, budget", [(8, retrieve.Budget()), (25, retrieve.Budget(read_batch=2)), (60, retrieve.Budget(max_actions=4, candidate_cap=10)), (12, retrieve.Budget(max_expansions=1))])
def test_retrieval(spark, n, budget):
    draw = random.Random(n)
    pairs = [(f"P{i:03}", f"A{draw.randint(0, max(2, n // 3))}") for i in range(n)]
    nodes = [(f"api:{a}", "API", a, "") for a in sorted({a for _, a in pairs})] + [(f"ku:{p}", "KU", a, p) for p, a in pairs]
    edges = [(f"ku:{p}", f"api:{a}", draw.choice(["has_example", "has_guidance"])) for p, a in pairs if draw.random() < 0.6]
    names = [x[0] for x in nodes if x[1] == "API"]
    edges += [(draw.choice(names), draw.choice(names), draw.choice(["accepts", "returns"])) for _ in range(n // 2)]
    edges += [(f"ku:P{draw.randrange(n):03}", f"ku:P{draw.randrange(n):03}", "complements") for _ in range(n // 2)]
    table = frame(spark, [(p, a, f"text {p}", "d") for p, a in pairs], ["pair_id", "canonical_api", "ku", "dataset"])
    node_table, edge_table = frame(spark, nodes, ["node_id", "kind", "api", "pair_id"]), frame(spark, edges, ["source", "target", "relation"])
    values = {q: {p: draw.randint(0, 9) / 10 for p, _ in pairs} for q in (1, 2, 3)}
    scores = spark.createDataFrame([("d", q, p, s) for q, own in values.items() for p, s in own.items()], "dataset string, query_id int, pair_id string, score double")
    queries = spark.createDataFrame([("d", q, f"query {q}") for q in values], "dataset string, query_id int, query string")
    got = {r.query_id: r for r in retrieve.run(queries, table, scores, node_table, edge_table, budget).collect()}
    kept = graph.index_edges(edge_table)
    roles = {}
    for r in graph.roles_by_pair(node_table, kept).collect():
        roles.setdefault(r.pair_id, set()).add(r.role)
    api_links = [tuple(r) for r in graph.api_links(node_table, kept).collect()]
    ku_links = [(r.pair_id, r.dir, r._ord, r.relation, r.target) for r in graph.ku_links(node_table, kept).collect()]
    for q, own in values.items():
        trace, ranked, seen = plain_retrieve(pairs, own, roles, api_links, ku_links, budget)
        assert [e.action_id for e in got[q].trace] == trace
        assert [p.pair_id for p in got[q].ranked_pairs] == ranked[: budget.candidate_cap]
        assert got[q].observed_pair_ids == sorted(seen) and len(got[q].candidate_pool_pair_ids) <= budget.candidate_cap
        assert set(got[q].verification) == set(ranked[: budget.candidate_cap])


def test_replayed_judges(spark):
    table = frame(spark, [(f"P{i}", "A", "t", "d") for i in range(8)], ["pair_id", "canonical_api", "ku", "dataset"])
    none = frame(spark, [], ["node_id", "kind", "api", "pair_id"]), frame(spark, [], ["source", "target", "relation"])
    scores = spark.createDataFrame([("d", 1, f"P{i}", 1 - i / 10) for i in range(8)], "dataset string, query_id int, pair_id string, score double")
    queries = spark.createDataFrame([("d", 1, "q")], "dataset string, query_id int, query string")
    budget = retrieve.Budget(max_actions=2)
    schema = "dataset string, query_id int, step int, pair_id string, api_fit int, ku_support int, keep boolean, missing_needs array<string>"
    fits = {"P0": (3, 1), "P1": (2, 2), "P2": (3, 0), "P3": (1, 1), "P4": (3, 2), "P5": (0, 2), "P6": (3, 2), "P7": (2, 1)}
    answers = [("d", 1, s, p, *fits[p], True, []) for p in fits for s in (0, 1, 2, 3)]
    chosen = spark.createDataFrame([("d", 1, 1, "READ_API:A:all", "more"), ("d", 1, 2, "STOP", "done")], "dataset string, query_id int, step int, action_id string, reason string")
    run = lambda rows, picks: retrieve.run(queries, table, scores, *none, budget, verify=judge.replay_verifier(spark.createDataFrame(rows, schema)), choose=judge.replay_policy(picks)).first()
    got = run(answers, chosen)
    assert [p.pair_id for p in got.ranked_pairs] == ["P4", "P6", "P0", "P1", "P7", "P3"]
    assert [(e.action, e.reason, e.removed_pair_ids) for e in got.trace] == [("READ_API", "more", ["P5"]), ("STOP", "done", [])]
    with pytest.raises(judge.JudgeError):
        run([a for a in answers if a[3] != "P6"], chosen)
    with pytest.raises(judge.JudgeError):
        run(answers, chosen.withColumn("action_id", F.lit("READ_API:B:all")))


def test_labels(spark):
    columns = ["pair_id", "canonical_api", "ku", "identified_relevance"]
    labelled = frame(spark, [("P1", "A", "x", "1"), ("P2", "A", "y", "0")], columns)
    assert judge.label_pairs(labelled).count() == 2
    with pytest.raises(judge.JudgeError):
        judge.label_pairs(frame(spark, [("P1", "A", "x", "")], columns))
    answers = frame(spark, [("P1", 'ok {"identified_relevance":"True","roles":"has_example| has_guidance","clues":"c","reasoning":"r"}'), ("P2", '{"roles":["a","b"],"clues":["c","d"]}')], ["pair_id", "content"])
    with pytest.raises(judge.JudgeError):
        judge.label_pairs(labelled, recorded=answers)
    got = judge.label_pairs(labelled, demonstrations=labelled, recorded=answers.drop("_ord")).orderBy("pair_id").collect()
    assert [(r.identified_relevance, r.lamic_role, r.lamic_evidence, r.lamic_reasoning) for r in got] == [("True", "has_example|has_guidance", "c", "r"), ("0", "a|b", "c | d", "")]
    assert judge.parse_object('a {"x": 1} b') == {"x": 1}
    for bad in ("nothing", "[1]"):
        with pytest.raises(judge.JudgeError):
            judge.parse_object(bad)


def test_model_client_needs_a_key(monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(judge.JudgeError):
        judge.chat_client("http://localhost:1", "m", "NO_SUCH_KEY")("s", "u")


def test_command_lines(spark, tmp_path):
    from tessergraph.plans import cli

    for name, body in {
        "spec": "api,description\nMap,a map\n", "tutorial": 'api,ku\nMap,"put, then get"\n', "answers": "api,answer\nmap,use a map\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(body)
    args = ["collect", "--tutorial", f"{tmp_path}/tutorial.csv", "--stackoverflow", f"{tmp_path}/answers.csv", "--specification", f"{tmp_path}/spec.csv", "--output", f"{tmp_path}/pairs"]
    cli.main(args)
    pairs = files.read_csv(spark, f"{tmp_path}/pairs").withColumn("identified_relevance", F.lit("1")).withColumn("canonical_api", F.lit("Map"))
    files.write_csv(pairs, f"{tmp_path}/labelled")
    cli.main(["label", "--input", f"{tmp_path}/labelled", "--output", f"{tmp_path}/again"])
    cli.main(["build", "--pairs", f"{tmp_path}/again", "--output", f"{tmp_path}/graph"])
    nodes, edges = files.load_graph(spark, f"{tmp_path}/graph/nodes.csv", f"{tmp_path}/graph/edges.csv")
    assert [r.kind for r in nodes.orderBy("_ord").collect()] == ["API", "KU", "KU"] and edges.columns[:-1] == build.EDGE_COLUMNS
    with pytest.raises(SystemExit):
        cli.main(["retrieve", "--dataset", "no such"])


def test_stream_of_queries(spark, tmp_path):
    from tessergraph.streaming.queries import retrieve_stream

    pairs = frame(spark, [(f"P{i}", "A", "t", "d") for i in range(6)], ["pair_id", "canonical_api", "ku", "dataset"]).withColumn("embedding", F.array(F.col("_ord").cast("float")))
    none = frame(spark, [], ["node_id", "kind", "api", "pair_id"]), frame(spark, [], ["source", "target", "relation"])
    asked = spark.createDataFrame([("d", 1, "q", [1.0]), ("d", 2, "r", [-1.0])], "dataset string, query_id int, query string, embedding array<float>")
    asked.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in")
    retrieve_stream(stream, pairs, *none, f"{tmp_path}/out", f"{tmp_path}/check", retrieve.Budget(max_actions=1)).awaitTermination()
    got = {r.query_id: len(r.ranked_pairs) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 6, 2: 6}


def test_entry_and_names():
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and json.dumps(sorted(names))


def test_scores_of_blocks(spark, monkeypatch):
    """Scores of all pairs as ordered sums, null where a vector is null, holds a null or has another length; no row-by-row join."""
    from tessergraph.operators import similarity

    draw = random.Random(4)
    vectors = [[draw.uniform(-1, 1) for _ in range(5)] for _ in range(40)] + [[1.0, None, 2.0, 0.0, 1.0], None, [1.0], []]
    rows = [("a" if i % 3 else "b", i, v) for i, v in enumerate(vectors)] + [(None, 99, vectors[0])]
    queries = spark.createDataFrame(rows, "dataset string, query_id int, embedding array<double>").repartition(3)
    pairs = spark.createDataFrame([(d, f"P{i}", v) for d, i, v in rows], "dataset string, pair_id string, embedding array<double>").repartition(2)
    want = {}
    for d, i, v in rows[:-1]:
        for e, j, w in rows[:-1]:
            if d == e:
                total = 0.0
                for x, y in zip(v or [], w or []):
                    total = None if None in (total, x, y) else total + x * y
                want[i, f"P{j}"] = None if v is None or w is None or len(v) != len(w) else total
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    for few in (64, 0):
        monkeypatch.setattr(similarity, "QUERY_BLOCKS", few)
        found = similarity.score_pairs(queries, pairs)
        got = found.collect()
        assert {(r.query_id, r.pair_id): r.score for r in got} == want and len(got) == len(want)
        assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()
