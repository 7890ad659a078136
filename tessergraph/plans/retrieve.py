"""Adaptive retrieval for all queries at once.

State is keyed by (dataset, query_id): examined pairs, discovered APIs, assessments, the candidate pool and a control row.
Each step lists legal actions, lets a policy choose one a query, applies it and verifies what it returned. Steps are bounded,
and every step's state is written to the shared folder. Ties that the pool's order leaves open go to the higher score, then
to the smaller pair id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.operators import graph
from tessergraph.operators.judge import ASSESSMENT, IDS, constant_verifier
from tessergraph.functions.text import preview
from tessergraph.operators.similarity import dot, top_pairs
from tessergraph.sources.durable import drop_materialized, materialize

SEED, TOP = 5, 15

# The reasons that the built-in policy gives.
REASONS = {
    "READ_API": "deepen the highest-ranked discovered API",
    "EXPAND_API": "broaden the current evidence graph",
    "EXPAND_KU": "broaden the current evidence graph",
    "STOP": "no unread or legal graph action remains",
}


@dataclass(frozen=True)
class Budget:
    max_actions: int = 6
    max_expansions: int = 3
    read_batch: int = 6
    candidate_cap: int = 30


def window(*order):
    return Window.partitionBy(*IDS).orderBy(*order)


def initial(scores: DataFrame, count: int = SEED) -> DataFrame:
    """The first pairs of each query by score, then id, with their place."""
    return scores.withColumn("place", F.row_number().over(window(F.desc("score"), "pair_id"))).where(F.col("place") <= count)


def rank_key(tie: list) -> list:
    """The pool's order: supported first, then fit, then support, then the tie-break."""
    return [F.desc((F.col("ku_support") > 0).cast("int")), F.desc("api_fit"), F.desc("ku_support"), *tie]


def accepted(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("keep") & (F.col("api_fit") > 0) & (F.col("ku_support") > 0))


def cap_pool(pool: DataFrame, cap: int) -> DataFrame:
    """pool: (ids, pair_id, score, assessment). The first ``cap`` of each query, with their place."""
    place = F.row_number().over(window(*rank_key([F.desc("score"), "pair_id"])))
    return pool.withColumn("place", place).where(F.col("place") <= cap)


def scorer(scores: DataFrame | tuple[DataFrame, DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Adds ``score`` to rows (ids, pair_id): from a table of scores, or from the vectors of queries and of pairs."""
    if isinstance(scores, DataFrame):
        return lambda rows: rows.join(scores.select(*IDS, "pair_id", "score"), [*IDS, "pair_id"])
    asked = scores[0].select(*IDS, F.col("embedding").alias("_q"))
    held = scores[1].select("dataset", "pair_id", F.col("embedding").alias("_p"))
    return lambda rows: rows.join(asked, IDS).join(held, ["dataset", "pair_id"]).withColumn("score", dot("_q", "_p")).drop("_q", "_p")


def frontier(found: DataFrame, units: DataFrame, scores: DataFrame | tuple[DataFrame, DataFrame], count: int) -> DataFrame:
    """(ids, api, role, pair_id, score): the best ``count`` pairs of each role of APIs that queries have found, found (ids, api).

    units: (dataset, pair_id, api, roles). A loop that reads less than ``count`` pairs never needs another pair of these APIs,
    so their scores are worked out once, when the API is found.
    """
    if isinstance(scores, DataFrame):
        each = found.join(units, ["dataset", "api"]).join(scores.select(*IDS, "pair_id", "score"), [*IDS, "pair_id"]).withColumn("role", F.explode("roles"))
        place = F.row_number().over(Window.partitionBy(*IDS, "api", "role").orderBy(F.desc("score"), "pair_id"))
        return each.withColumn("place", place).where(F.col("place") <= count).select(*IDS, "api", "role", "pair_id", "score")
    asked = found.join(scores[0].select(*IDS, "embedding"), IDS)
    held = units.join(scores[1].select("dataset", "pair_id", "embedding"), ["dataset", "pair_id"]).withColumnRenamed("roles", "groups")
    best = top_pairs(asked, held, count, F.col("api"))
    return best.select(*IDS, F.col("key").alias("api"), F.col("group").alias("role"), "pair_id", "score")


def opened(found: DataFrame, index: Index, budget: Budget, known: DataFrame | None = None) -> DataFrame:
    """frontier() of APIs that queries have found, at what a loop can read; taken from ``known`` for those that it has."""
    most = SEED + budget.max_actions * budget.read_batch
    if known is None:
        return frontier(found, index.units, index.scores, most)
    by = [*IDS, "api"]
    have, rest = known.join(found, by, "left_semi"), found.join(known.select(*by).distinct(), by, "left_anti")
    return have if rest.isEmpty() else have.unionByName(frontier(rest, index.units, index.scores, most))


def library(pairs: DataFrame, roles: DataFrame) -> DataFrame:
    """(dataset, pair_id, api, roles): a pair without a role has ``all``."""
    own = roles.groupBy("pair_id").agg(F.collect_set("role").alias("roles"))
    return pairs.select("dataset", "pair_id", F.col("canonical_api").alias("api")).join(own, "pair_id", "left").select("dataset", "pair_id", "api", F.coalesce("roles", F.array(F.lit("all"))).alias("roles"))


def read_actions(best: DataFrame, examined: DataFrame, batch: int) -> DataFrame:
    """(ids, api, role, pair_ids, scores): unread pairs of a frontier by role, the best ``batch`` of each."""
    unread = best.join(examined.select(*IDS, "pair_id"), [*IDS, "pair_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*IDS, "api", "role").orderBy(F.desc("score"), "pair_id"))
    first = unread.withColumn("place", place).where(F.col("place") <= batch)
    listed = first.groupBy(*IDS, "api", "role").agg(F.sort_array(F.collect_list(F.struct("place", "pair_id", "score"))).alias("_read"))
    return listed.select(*IDS, "api", "role", F.col("_read.pair_id").alias("pair_ids"), F.col("_read.score").alias("scores"))


def _action(df: DataFrame, rank: int, type_: str, id_: list, role=None, pair_ids=None, scores=None, api=None, pair=None, a=None, n=None, m=None, b=None, c=None) -> DataFrame:
    """Rows as actions of a type; ``place`` orders a query's actions by rank, then by what is given for a, n, m, b and c."""
    none, text, number = F.lit(None).cast("string"), lambda x: F.lit("") if x is None else x, lambda x: F.lit(0).cast("long") if x is None else x.cast("long")
    blank = lambda kind: F.array().cast(f"array<{kind}>")
    place = F.struct(F.lit(rank).alias("k"), text(a).alias("a"), number(n).alias("n"), number(m).alias("m"), text(b).alias("b"), text(c).alias("c"))
    return df.select(
        *IDS, F.lit(type_).alias("type"), F.concat_ws(":", F.lit(type_), *id_).alias("action_id"), (none if role is None else role).alias("role"),
        (blank("string") if pair_ids is None else pair_ids).alias("pair_ids"), (blank("double") if scores is None else scores).alias("scores"),
        (none if api is None else api).alias("target_api"), (none if pair is None else pair).alias("target_pair"), place.alias("place"),
    )


def reads(state: State, live: DataFrame, budget: Budget) -> DataFrame:
    """The reading actions of live queries (ids)."""
    rows, col = read_actions(state.frontier.join(live, IDS, "left_semi"), state.examined, budget.read_batch), F.col
    return _action(rows, 0, "READ_API", ["api", "role"], role=col("role"), pair_ids=col("pair_ids"), scores=col("scores"), a=col("api"), b=col("role"))


def moves(state: State, index: Index, live: DataFrame, budget: Budget) -> DataFrame:
    """The other actions of live queries (ids): expansions while their budget lasts, and stopping."""
    col = F.col
    open_ = state.control.where(col("expanded") < budget.max_expansions).join(live, IDS, "left_semi").select(*IDS)
    apis = graph.expansions(index.api_links, state.discovered.join(open_, IDS, "left_semi"), state.discovered, "api")
    units = graph.expansions(index.ku_links, state.examined.join(open_, IDS, "left_semi"), state.examined, "pair_id")
    return (
        _action(apis, 1, "EXPAND_API", ["api", "relation", "target"], api=col("target"), a=col("api"), b=col("relation"), c=col("target")).distinct()
        .unionByName(_action(units, 2, "EXPAND_KU", ["pair_id", "relation", "target"], pair=col("target"), a=col("pair_id"), n=col("dir"), m=col("_ord"), b=col("relation")))
        .unionByName(_action(live, 3, "STOP", []))
    )


def legal_actions(state: State, index: Index, budget: Budget) -> DataFrame:
    """(ids, type, action_id, role, pair_ids, scores, target_api, target_pair, place): every live query's actions in order."""
    live = state.control.where(~F.col("stopped")).select(*IDS)
    return reads(state, live, budget).unionByName(moves(state, index, live, budget))


def heuristic_policy(actions: DataFrame, step: int, seen: DataFrame | None = None) -> DataFrame:
    """The first action in order: reading, then APIs, then units, then stopping."""
    reason = F.coalesce(*[F.when(F.col("type") == t, F.lit(r)) for t, r in REASONS.items()])
    return graph.first_per(actions, IDS, ["place"]).withColumn("reason", reason)


@dataclass
class Index:
    """What all queries share."""

    pairs: DataFrame  # dataset, pair_id, canonical_api, ku
    best: DataFrame | None  # dataset, query_id, pair_id, score, place of each query's first pairs
    scores: DataFrame | tuple[DataFrame, DataFrame] | None  # a table of scores, or the vectors of queries and of pairs
    units: DataFrame  # dataset, pair_id, api, roles
    api_links: DataFrame
    ku_links: DataFrame


@dataclass
class State:
    examined: DataFrame  # ids, pair_id, score
    discovered: DataFrame  # ids, api
    frontier: DataFrame  # ids, api, role, pair_id, score
    assessed: DataFrame  # ids, pair_id, assessment
    pool: DataFrame  # ids, pair_id, place
    control: DataFrame  # ids, expanded, stopped
    trace: DataFrame
    held: DataFrame  # the table that all parts are read from


def make_index(pairs: DataFrame, scores: DataFrame | tuple[DataFrame, DataFrame], nodes: DataFrame, edges: DataFrame) -> Index:
    """Pairs are unique by (dataset, pair_id): the last row of an id counts. scores: a table, or the vectors of queries and pairs."""
    if isinstance(scores, DataFrame):
        scores = materialize(scores)
    else:
        scores = materialize(scores[0].select(*IDS, "embedding")), materialize(scores[1].select("dataset", "pair_id", "embedding"))
    return with_scores(graph_index(pairs, nodes, edges), scores)


def with_scores(index: Index, scores: DataFrame | tuple[DataFrame, DataFrame]) -> Index:
    """The index with the scores of some queries: a written table of them, or the written vectors of queries and pairs."""
    return replace(index, best=materialize(first_pairs(scores)), scores=scores)


def first_pairs(scores: DataFrame | tuple[DataFrame, DataFrame], count: int = SEED) -> DataFrame:
    """initial() of a table of scores, or of vectors; vectors meet in blocks, and no table of all scores is made."""
    if isinstance(scores, DataFrame):
        return initial(scores, count)
    held = scores[1].select("dataset", "pair_id", "embedding", F.array(F.lit("")).alias("groups"))
    return top_pairs(scores[0].select(*IDS, "embedding"), held, count, F.lit("")).select(*IDS, "pair_id", "score", "place")


def graph_index(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> Index:
    """What does not depend on the queries; with_scores() adds the rest."""
    held = pairs.groupBy("dataset", "pair_id").agg(F.max_by(F.struct("canonical_api", "ku"), "_ord").alias("_row")).select("dataset", "pair_id", "_row.*")
    nodes, edges = materialize(graph.index_nodes(nodes)), materialize(graph.index_edges(edges))  # read three times
    held = materialize(held)
    links = graph.ku_links(nodes, edges)
    known = held.select(F.col("pair_id").alias("target")).distinct()
    index = Index(
        held,
        None,
        None,
        materialize(library(held, graph.roles_by_pair(nodes, edges))),
        materialize(graph.api_links(nodes, edges)),
        materialize(links.join(known, "target", "left_semi")),
    )
    drop_materialized(nodes)
    drop_materialized(edges)
    return index


def _asked(rows: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    return rows.select(*IDS, "pair_id").join(index.pairs, ["dataset", "pair_id"]).join(queries.select(*IDS, "query"), IDS)


EVENT = "step int, action string, action_id string, reason string, role string, read_pair_ids array<string>, returned_pair_ids array<string>, returned_api_ids array<string>, verified_pair_ids array<string>, removed_pair_ids array<string>"


def _saved(**parts: DataFrame) -> State:
    """Writes all parts of a state as one table, a struct column for each, and reads them from it."""
    rows = None
    for name, df in parts.items():
        own = df.select(F.lit(name).alias("part"), *IDS, F.struct(*[c for c in df.columns if c not in IDS]).alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    held = materialize(rows.hint("rebalance"))  # in few files, however many parts have met
    return State(**{name: held.where(F.col("part") == name).select(*IDS, f"{name}.*") for name in parts}, held=held)


def evidence(state: State, index: Index, queries: DataFrame) -> DataFrame:
    """(ids, query, evidence): what a policy is shown of each query's pool, best first."""
    shown = state.pool.join(state.examined, [*IDS, "pair_id"]).join(index.pairs, ["dataset", "pair_id"]).join(state.assessed, [*IDS, "pair_id"])
    item = preview(F.col("pair_id"), F.col("canonical_api"), F.col("score"), F.col("ku"))
    rows = shown.select(*IDS, F.struct("place", F.struct(*[item[c].alias(c) for c in ("pair_id", "api", "score", "knowledge_unit")], "api_fit", "ku_support", "missing_needs").alias("shown")).alias("item"))
    listed = rows.groupBy(*IDS).agg(F.transform(F.sort_array(F.collect_list("item")), lambda x: x["shown"]).alias("evidence"))
    kind = listed.schema["evidence"].dataType.simpleString()
    return queries.select(*IDS, "query").join(listed, IDS, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def retrieve(
    queries: DataFrame,
    index: Index,
    budget: Budget = Budget(),
    verify: Callable[[DataFrame, int], DataFrame] = constant_verifier,
    choose: Callable[[DataFrame, int, DataFrame], DataFrame] = heuristic_policy,
    known: DataFrame | None = None,
) -> tuple[DataFrame, State, DataFrame]:
    """(ranked, state, seeds): ranked is (ids, place, pair_id, api, score, assessment) of each query's best pairs; see results().

    verify gets the asked pairs and the step; choose the legal actions, the step and evidence(). A step is two or three written
    tables, which go with the next one; the loop ends early when every query has stopped. Every score is worked out once:
    a pair's when its API is found, or when an expansion reaches it. known: the frontier of a run of the same queries over
    the same index with the same budget, whose scores are not worked out again.
    """
    apis = index.units.select("dataset", "pair_id", "api")
    seeds = materialize(index.best.join(queries.select(*IDS), IDS, "left_semi").select(*IDS, "pair_id", "score", "place"))
    assessed = _answers(verify, seeds.select(*IDS, "pair_id"), index, queries, 0)
    found, read = seeds.join(apis, ["dataset", "pair_id"]).select(*IDS, "api").distinct(), seeds.select(*IDS, "pair_id", "score")
    state = _saved(
        examined=read,
        discovered=found,
        frontier=opened(found, index, budget, known),
        assessed=assessed,
        pool=cap_pool(accepted(assessed).join(read, [*IDS, "pair_id"]), budget.candidate_cap).select(*IDS, "pair_id", "place"),
        control=queries.select(*IDS, F.lit(0).alias("expanded"), F.lit(False).alias("stopped")),
        trace=queries.sparkSession.createDataFrame([], f"dataset string, query_id int, {EVENT}").select(*[F.col(c).cast(queries.schema[c].dataType) for c in IDS], *[c.split()[0] for c in EVENT.split(", ")]),
    )
    for step in range(1, budget.max_actions + 1):
        state = _step(state, index, queries, budget, verify, choose, step, known)
        if state.control.where(~F.col("stopped")).isEmpty():
            break
    retained = state.pool
    final = _answers(verify, retained.select(*IDS, "pair_id"), index, queries, budget.max_actions + 1)
    again = retained.join(final, [*IDS, "pair_id"]).join(state.examined, [*IDS, "pair_id"]).join(apis, ["dataset", "pair_id"])
    place = F.row_number().over(window(*rank_key([F.col("retained_place"), F.desc("score")])))
    ranked = again.withColumnRenamed("place", "retained_place").withColumn("place", place).where(F.col("place") <= TOP)
    return ranked.select(*IDS, "place", "pair_id", "api", "score", *ASSESSMENT), state, seeds


def _answers(verify: Callable, rows: DataFrame, index: Index, queries: DataFrame, step: int) -> DataFrame:
    """A verifier's assessments of rows (ids, pair_id), written if they are more than constants, which need no texts."""
    if verify is constant_verifier:
        return verify(rows, step).select(*IDS, "pair_id", *ASSESSMENT)
    return materialize(verify(_asked(rows, index, queries), step).select(*IDS, "pair_id", *ASSESSMENT))


def _decisions(state: State, index: Index, queries: DataFrame, budget: Budget, choose: Callable, step: int) -> list[DataFrame]:
    """What the policy chose for each live query, as written tables.

    The built-in policy reads while there is something to read, so it looks at the graph only for queries that have not.
    """
    kept = lambda df: materialize(df.select(*IDS, "type", "action_id", "reason", "role", "pair_ids", "scores", "target_api", "target_pair"))
    if choose is not heuristic_policy:
        actions = materialize(legal_actions(state, index, budget))
        out = [kept(choose(actions, step, evidence(state, index, queries)))]
        drop_materialized(actions)
        return out
    live = state.control.where(~F.col("stopped")).select(*IDS)
    out = [kept(choose(reads(state, live, budget), step))]
    idle = live.join(out[0].select(*IDS), IDS, "left_anti")
    return out if idle.isEmpty() else [*out, kept(choose(moves(state, index, idle, budget), step))]


def _step(state: State, index: Index, queries: DataFrame, budget: Budget, verify: Callable, choose: Callable, step: int, known: DataFrame | None = None) -> State:
    apis = index.units.select("dataset", "pair_id", "api")
    decisions = _decisions(state, index, queries, budget, choose, step)
    chosen = reduce(DataFrame.unionByName, decisions)
    kind = F.col("type")
    read = chosen.where(kind == "READ_API").select(*IDS, F.explode(F.arrays_zip("pair_ids", "scores")).alias("_read")).select(*IDS, F.col("_read.pair_ids").alias("pair_id"), F.col("_read.scores").alias("score"))
    returned, discovered, open_ = read, state.discovered, state.frontier
    if not chosen.where(kind.isin("EXPAND_API", "EXPAND_KU")).isEmpty():
        reached = chosen.where(kind == "EXPAND_KU").select(*IDS, F.col("target_pair").alias("pair_id"))
        returned = read.unionByName(scorer(index.scores)(reached).select(*IDS, "pair_id", "score"))
        found = chosen.where(kind == "EXPAND_API").select(*IDS, F.col("target_api").alias("api")).unionByName(reached.join(apis, ["dataset", "pair_id"]).select(*IDS, "api"))
        found = materialize(found.join(state.discovered, [*IDS, "api"], "left_anti").distinct())
        decisions.append(found)
        if not found.isEmpty():
            discovered = discovered.unionByName(found)
            open_ = open_.unionByName(opened(found, index, budget, known))
    new = _answers(verify, returned.select(*IDS, "pair_id"), index, queries, step)
    assessed = state.assessed.join(new, [*IDS, "pair_id"], "left_anti").unionByName(new)
    examined = state.examined.unionByName(returned)
    taken = accepted(new).select(*IDS, "pair_id")
    members = state.pool.select(*IDS, "pair_id").unionByName(taken).distinct()
    pool = cap_pool(members.join(assessed, [*IDS, "pair_id"]).join(examined, [*IDS, "pair_id"]), budget.candidate_cap).select(*IDS, "pair_id", "place")
    lost = state.pool.select(*IDS, "pair_id").join(pool, [*IDS, "pair_id"], "left_anti")
    removed = returned.select(*IDS, "pair_id").join(taken, [*IDS, "pair_id"], "left_anti").unionByName(lost).groupBy(*IDS).agg(F.sort_array(F.collect_set("pair_id")).alias("removed"))
    blank = F.array().cast("array<string>")
    event = chosen.join(removed, IDS, "left").select(
        *IDS, F.lit(step).alias("step"), kind.alias("action"), "action_id", "reason", F.when(kind == "READ_API", F.col("role")).alias("role"),
        F.when(kind == "READ_API", F.col("pair_ids")).otherwise(blank).alias("read_pair_ids"),
        F.when(kind == "EXPAND_KU", F.array("target_pair")).otherwise(blank).alias("returned_pair_ids"),
        F.when(kind == "EXPAND_API", F.array("target_api")).otherwise(blank).alias("returned_api_ids"),
        F.when(kind == "READ_API", F.col("pair_ids")).when(kind == "EXPAND_KU", F.array("target_pair")).otherwise(blank).alias("verified_pair_ids"),
        F.when(kind.isin("READ_API", "EXPAND_KU"), F.coalesce("removed", blank)).otherwise(blank).alias("removed_pair_ids"),
    )
    control = state.control.join(chosen.select(*IDS, kind.alias("_did")), IDS, "left").select(
        *IDS,
        (F.col("expanded") + F.coalesce(F.col("_did").isin("EXPAND_API", "EXPAND_KU").cast("int"), F.lit(0))).alias("expanded"),
        (F.col("stopped") | F.coalesce(F.col("_did") == "STOP", F.lit(False))).alias("stopped"),
    )
    out = _saved(
        examined=examined,
        discovered=discovered,
        frontier=open_,
        assessed=assessed,
        pool=pool,
        control=control,
        trace=state.trace.unionByName(event),
    )
    for df in (state.held, *decisions, new):
        drop_materialized(df)
    return out


def results(queries: DataFrame, index: Index, ranked: DataFrame, state: State, seeds: DataFrame) -> DataFrame:
    """A nested row for each query, as the JSON output has it."""
    ordered = lambda df, name: df.groupBy(*IDS).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "pair_id"))), lambda x: x["pair_id"]).alias(name))
    texts = index.pairs.select("dataset", "pair_id", F.col("ku").alias("knowledge_unit"))
    item = F.struct("place", "pair_id", "api", "score", "knowledge_unit", *ASSESSMENT)
    best = ranked.join(texts, ["dataset", "pair_id"]).groupBy(*IDS).agg(F.sort_array(F.collect_list(item)).alias("_best"))
    best = best.select(
        *IDS,
        F.transform("_best", lambda x: F.struct(x["pair_id"], x["api"], x["score"], x["knowledge_unit"])).alias("ranked_pairs"),
        F.map_from_entries(F.transform("_best", lambda x: F.struct(x["pair_id"], F.struct(x["pair_id"], *[x[a] for a in ASSESSMENT])))).alias("verification"),
    )
    events = [c for c in state.trace.columns if c not in IDS]
    parts = [
        ordered(seeds, "initial_pair_ids"),
        state.examined.groupBy(*IDS).agg(F.sort_array(F.collect_set("pair_id")).alias("observed_pair_ids")),
        ordered(state.pool, "candidate_pool_pair_ids"),
        state.discovered.groupBy(*IDS).agg(F.sort_array(F.collect_set("api")).alias("discovered_apis")),
        best,
        state.trace.groupBy(*IDS).agg(F.sort_array(F.collect_list(F.struct(*events))).alias("trace")),
    ]
    out = queries.select(*[c for c in (*IDS, "query", "ground_truth_apis") if c in queries.columns])
    for part in parts:
        out = out.join(part, IDS, "left")
    return out


def run(queries: DataFrame, pairs: DataFrame, scores: DataFrame | tuple[DataFrame, DataFrame], nodes: DataFrame, edges: DataFrame, budget: Budget = Budget(), **judges) -> DataFrame:
    index = make_index(pairs, scores, nodes, edges)
    ranked, state, seeds = retrieve(queries, index, budget, **judges)
    return results(queries, index, ranked, state, seeds)
