"""Command lines: collect, label, build and retrieve.

python -m tessergraph.plans.cli collect --tutorial T --stackoverflow S --specification D --output P
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessergraph.functions.relations import DATASETS
from tessergraph.functions.text import pair_text
from tessergraph.operators import build as builder
from tessergraph.operators import judge, similarity
from tessergraph.operators.candidates import candidate_rows, ku_candidates, ordered
from tessergraph.operators.collect import PAIR_COLUMNS, REFERENCE_COLUMNS, collect
from tessergraph.plans import release, retrieve
from tessergraph.sources.files import dataset_paths, load_graph, read_csv, write_csv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessergraph")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("collect")
    for name in ("tutorial", "stackoverflow", "specification", "output"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--reference-output")
    one.add_argument("--dataset", default="")
    two = commands.add_parser("label")
    two.add_argument("--input", required=True)
    two.add_argument("--output", required=True)
    two.add_argument("--demonstrations")
    three = commands.add_parser("build")
    three.add_argument("--pairs", required=True)
    three.add_argument("--output", required=True)
    for name in ("references", "declarations", "relations"):
        three.add_argument(f"--{name}")
    three.add_argument("--same-api-k", type=int, default=3)
    three.add_argument("--cross-api-k", type=int, default=3)
    four = commands.add_parser("retrieve")
    four.add_argument("--dataset", choices=DATASETS)
    four.add_argument("--query")
    four.add_argument("--query-id", type=int)
    four.add_argument("--queries", default="queries.csv")
    four.add_argument("--data-root", default="datasets")
    four.add_argument("--output", default="outputs")
    four.add_argument("--all", action="store_true")
    four.add_argument("--controller", choices=("heuristic", "llm"), default="llm")
    four.add_argument("--verifier", choices=("similarity", "llm"), default="llm")
    for name, value in (("max-actions", 6), ("max-expansions", 3), ("read-batch", 6), ("candidate-cap", 30)):
        four.add_argument(f"--{name}", type=int, default=value)
    for sub in (one, two, three, four):
        sub.add_argument("--shared-dir", help="a folder that the driver and all executors share, for intermediates")
    for sub in (two, three, four):
        sub.add_argument("--endpoint")
        sub.add_argument("--chat-model")
        sub.add_argument("--key-env", default="CHAT_API_KEY")
        sub.add_argument("--run-llm", action="store_true")
        sub.add_argument("--ledger", help="a folder that keeps a model's answers by prompt, so that none is asked for twice")
    return top


def client(args):
    if not (args.endpoint and args.chat_model):
        raise judge.JudgeError("a model needs --endpoint and --chat-model")
    return judge.chat_client(args.endpoint, args.chat_model, args.key_env)


def run_collect(spark: SparkSession, args) -> dict:
    tables = [read_csv(spark, getattr(args, n)) for n in ("tutorial", "stackoverflow", "specification")]
    pairs, references = collect(*tables, dataset=args.dataset)
    write_csv(pairs, args.output, PAIR_COLUMNS)
    if args.reference_output:
        write_csv(references, args.reference_output, REFERENCE_COLUMNS)
    return {"written": args.output}


def demonstrations(pairs, pool):
    """(target, demonstrations): the chosen rows of the pool, as JSON."""
    ready = lambda df: similarity.with_signature(similarity.with_vectors(df, pair_text(df.columns)), F.col("ku"))
    chosen = similarity.select_demonstrations(ready(pool), ready(pairs))
    rows = pool.select(F.col("pair_id").alias("doc"), F.to_json(F.struct(*[c for c in pool.columns if c != "_ord"])).alias("row"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "row"))), lambda x: x["row"]), ", ")
    return chosen.join(rows, "doc").groupBy("target").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("demonstrations"))


def run_label(spark: SparkSession, args) -> dict:
    pairs = read_csv(spark, args.input)
    pool = read_csv(spark, args.demonstrations) if args.demonstrations else pairs
    pool = pool.where(F.col("identified_relevance").isin("0", "1"))
    call = client(args) if args.run_llm else None
    write_csv(judge.label_pairs(pairs, call, demonstrations(pairs, pool) if call else None, ledger=args.ledger), args.output)
    return {"written": args.output}


def run_build(spark: SparkSession, args) -> dict:
    pairs = read_csv(spark, args.pairs)
    others = {n: read_csv(spark, getattr(args, n)) if getattr(args, n) else None for n in ("references", "declarations", "relations")}
    judged = None
    if args.run_llm:
        admitted = builder.default_dataset(builder.admit(pairs))
        found = retrieve.materialize(ordered(ku_candidates(admitted, args.same_api_k, args.cross_api_k)))
        rows = candidate_rows(admitted, found)
        judged = judge.parse_relations(judge.ask(rows, client(args), judge.RELATION_PROMPT, ["left_api", "left_ku", "right_api", "right_ku"], ledger=args.ledger))
    nodes, edges = builder.build(pairs, judged=judged, **others)
    write_csv(nodes.withColumn("_ord", F.struct(F.col("kind"), F.coalesce("_ord", F.lit(0)), F.col("api"))), f"{args.output}/nodes.csv", builder.NODE_COLUMNS)
    write_csv(edges.withColumn("_ord", F.col("_place")), f"{args.output}/edges.csv", builder.EDGE_COLUMNS)
    return builder.counts(nodes, edges).first().asDict()


def judges(args) -> dict:
    """The verifier and the policy that the options name."""
    out = {}
    if args.verifier == "llm":
        call = client(args)

        def verify(asked, step):
            item = F.struct("pair_id", F.col("canonical_api").alias("api"), F.col("ku").alias("knowledge_unit"))
            batch = asked.groupBy(*judge.IDS, "query").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("pairs"))
            answers = judge.ask(batch, call, judge.VERIFY_PROMPT, ["query", "pairs"], 3000, nested=("pairs",), ledger=args.ledger)
            found = judge.parse_assessments(answers).select(*judge.IDS, "at", "pair_id", *judge.ASSESSMENT)
            return judge.replay_verifier(retrieve.materialize(found.withColumn("step", F.lit(step))))(asked, step)

        out["verify"] = verify
    if args.controller == "llm":
        call = client(args)

        def choose(actions, step, seen):
            item = F.struct("place", F.struct(F.col("action_id").alias("id"), "type", "role", "pair_ids", F.col("target_api").alias("target"), "target_pair").alias("action"))
            listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["action"])
            batch = actions.groupBy(*judge.IDS).agg(F.to_json(listed).alias("legal_actions")).join(seen.withColumn("evidence", F.to_json("evidence")), judge.IDS)
            answers = judge.ask(batch, call, judge.CONTROL_PROMPT, ["query", "evidence", "legal_actions"], nested=("evidence", "legal_actions"), ledger=args.ledger)
            picked = F.from_json(judge.answer_object(F.col("content")), "action_id string, reason string")
            own = answers.select(*judge.IDS, F.lit(step).alias("step"), picked["action_id"].alias("action_id"), F.coalesce(picked["reason"], F.lit("")).alias("reason"))
            return judge.replay_policy(retrieve.materialize(own))(actions, step)

        out["choose"] = choose
    return out


def run_retrieve(spark: SparkSession, args) -> dict:
    queries = release.validate_release(spark, args.data_root, args.queries)
    if not args.all:
        if not args.dataset:
            raise SystemExit("--dataset is needed unless --all is given")
        queries = queries.where(F.col("dataset") == args.dataset)
        if args.query_id is not None:
            queries = queries.where(F.col("query_id") == args.query_id)
        if args.query:
            queries = spark.createDataFrame([(args.dataset, 0, args.query, [])], queries.schema)
    names = DATASETS if args.all else [args.dataset]
    budget = retrieve.Budget(args.max_actions, args.max_expansions, args.read_batch, args.candidate_cap)
    path = f"{args.output}/{'results' if args.all else args.dataset}.json"
    for k, name in enumerate(names):
        paths = dataset_paths(args.data_root, name)
        pairs = read_csv(spark, paths["pairs"]).withColumn("dataset", F.lit(name))
        nodes, edges = load_graph(spark, paths["nodes"], paths["edges"])
        own = queries.where(F.col("dataset") == name)
        vectors = similarity.with_vectors(own, F.col("query")), similarity.with_vectors(pairs, pair_text(pairs.columns))
        found = retrieve.run(own, pairs, vectors, nodes, edges, budget, **judges(args))
        found.write.mode("append" if k else "overwrite").json(path)  # JSON lines, a row a query
    return {"written": path, "queries": spark.read.schema("query_id int").json(path).count()}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessergraph").getOrCreate()
    if args.shared_dir:
        spark.conf.set("spark.checkpoint.dir", args.shared_dir)
    spark.conf.set("spark.sql.caseSensitive", "true")  # files may have columns that differ in case only
    runs = {"collect": run_collect, "label": run_label, "build": run_build, "retrieve": run_retrieve}
    print(json.dumps(runs[args.command](spark, args), ensure_ascii=False))


if __name__ == "__main__":
    main()
