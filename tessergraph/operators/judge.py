"""Judges: where a language model may decide. Each has an offline stand-in and one that replays recorded answers.

A verifier gives assessments of (query, pair) rows; a policy picks an action; a labeller labels pairs; a relation judge
names relations of candidate pairs. Recorded answers are tables, so runs are repeatable and need no network.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.functions.text import answer_object, clamp, split_trimmed, string_or_list
from tessergraph.sources.durable import drop_materialized, materialize

IDS = ["dataset", "query_id"]
ASSESSMENT = ["api_fit", "ku_support", "keep", "missing_needs"]

LABEL_PROMPT = (
    "Decide whether the knowledge unit explains how the API is used. Answer with one JSON object with the keys identified_relevance (1 or 0), "
    "roles (of has_explanation, has_guidance, has_example, has_constraint), clues (quotes from the text) and reasoning (a short sentence)."
)
RELATION_PROMPT = (
    "Name the relations between two knowledge units: task_related, complements, constrains or contrasts_with. Answer with one JSON object with the key "
    "relations, a list of objects with the keys relation, evidence_source and evidence_target; leave it empty if the texts support none."
)
CONTROL_PROMPT = (
    "You steer a search for API knowledge. Pick one of the listed actions from the evidence given. Answer with one JSON object with the keys action_id and reason."
)
VERIFY_PROMPT = (
    "Assess every listed pair for the query: api_fit from 0 to 3, ku_support from 0 to 2, keep (true or false) and missing_needs (a list). Answer with one "
    "JSON object with the key assessments, a list of objects with pair_id and those keys."
)


class JudgeError(ValueError):
    """A judge's answer breaks its contract."""


def chat_client(endpoint: str, model: str, key_env: str, timeout: float = 120) -> Callable[[str, str, int], str]:
    """A client for a chat-completions service: temperature 0, no retries. The key is read from the environment at call time."""

    def call(system: str, user: str, max_tokens: int = 1200) -> str:
        key = os.environ.get(key_env)
        if not key:
            raise JudgeError(f"the environment has no {key_env}")
        body = {"model": model, "temperature": 0, "max_tokens": max_tokens, "enable_thinking": False}
        body["messages"] = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        request = urllib.request.Request(endpoint.rstrip("/") + "/chat/completions", json.dumps(body, ensure_ascii=False).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)["choices"][0]["message"].get("content") or ""

    return call


LEDGER = "prompt_key string, content string"
#: Prompts that are asked between two writes of a ledger.
CHUNK = 2_000


def ask(
    df: DataFrame, call: Callable[[str, str, int], str], system: str, fields: list[str], max_tokens: int = 1200, name: str = "content", nested: tuple[str, ...] = (), ledger: str | None = None
) -> DataFrame:
    """Adds a model's answer about the given fields of each row, asked from the executors; nested fields hold JSON already.

    With a ledger, a folder of answers by prompt, only prompts that it lacks are asked, each once however many rows have it;
    see record(). Without one a row is asked whenever its task runs.
    """
    prompt = lambda r: json.dumps({f: json.loads(r[f]) if f in nested else r[f] for f in fields}, ensure_ascii=False, default=str)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            batch[name] = [prompt(r) if ledger else call(system, prompt(r), max_tokens) for r in rows]
            yield batch

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {name} string"
    out = df.mapInPandas(told, schema)
    if not ledger:
        return out
    keyed = out.withColumn("prompt_key", prompt_key(F.lit(system), F.col(name), F.lit(max_tokens))).withColumnRenamed(name, "_prompt")
    keyed = materialize(keyed)
    record(keyed.select("prompt_key", "_prompt").dropDuplicates(["prompt_key"]), call, system, max_tokens, ledger)
    answers = read_ledger(df.sparkSession, ledger).withColumnRenamed("content", name)
    return keyed.join(answers, "prompt_key").select(*df.columns, name)


def prompt_key(system: Column, prompt: Column, max_tokens: Column) -> Column:
    """The key of a prompt: a digest of all that is sent."""
    return F.sha2(F.concat_ws("\0", system, prompt, max_tokens.cast("string")), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(prompt_key, content), an answer for each prompt; the folder is made where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).groupBy("prompt_key").agg(F.min("content").alias("content"))


def record(prompts: DataFrame, call: Callable[[str, str, int], str], system: str, max_tokens: int, ledger: str) -> None:
    """Asks the prompts (prompt_key, _prompt) that a ledger lacks and appends their answers, CHUNK by CHUNK.

    What was appended is never asked again, so a run that breaks off, or an executor that is lost, costs the answers of one
    chunk at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"prompt_key": batch["prompt_key"], "content": [call(system, p, max_tokens) for p in batch["_prompt"]]})

    spark = prompts.sparkSession
    missing = materialize(prompts.join(read_ledger(spark, ledger), "prompt_key", "left_anti"))
    parts = -(-missing.count() // CHUNK)
    for k in range(parts):
        own = missing.where(F.pmod(F.xxhash64("prompt_key"), F.lit(parts)) == k)
        own.mapInPandas(run, LEDGER).write.mode("append").parquet(ledger)
    drop_materialized(missing)


def parse_object(content: str) -> dict:
    """The JSON object in a model's answer."""
    start, end = content.find("{"), content.rfind("}")
    try:
        value = json.loads(content[start : end + 1] if 0 <= start < end else content)
    except json.JSONDecodeError as error:
        raise JudgeError(f"the answer is no JSON: {error}") from error
    if not isinstance(value, dict):
        raise JudgeError("the answer is no JSON object")
    return value


def parse_labels(answers: DataFrame, content: str = "content") -> DataFrame:
    """Adds identified_relevance, lamic_role, lamic_evidence and lamic_reasoning from label answers; one without JSON is an error."""
    body = answer_object(F.col(content))
    raw = F.from_json(body, "identified_relevance string, reasoning string")
    roles, clues = F.get_json_object(body, "$.roles"), F.get_json_object(body, "$.clues")
    bare = lambda x: F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>"))
    listed = F.coalesce(bare(roles), split_trimmed(roles))
    return answers.withColumns(
        {
            "identified_relevance": F.coalesce(raw["identified_relevance"], F.lit("0")),
            "lamic_role": F.array_join(listed, "|"),
            "lamic_evidence": F.array_join(F.coalesce(bare(clues), F.filter(F.array(clues), lambda x: x.isNotNull())), " | "),
            "lamic_reasoning": F.coalesce(raw["reasoning"], F.lit("")),
        }
    )


def parse_relations(answers: DataFrame, content: str = "content") -> DataFrame:
    """Adds relations from relation answers; an answer without any has an empty list, one without JSON is an error."""
    body = F.from_json(answer_object(F.col(content)), "relations array<struct<relation:string, evidence_source:string, evidence_target:string>>")
    return answers.withColumn("relations", F.coalesce(body["relations"], F.from_json(F.lit("[]"), "array<struct<relation:string, evidence_source:string, evidence_target:string>>")))


def parse_assessments(answers: DataFrame, content: str = "content") -> DataFrame:
    """(ids..., at, pair_id, api_fit 0-3, ku_support 0-2, keep, missing_needs) from verifier answers; keep must be a JSON boolean.

    at: the place in the answer, of which the last on a pair counts. An answer without JSON is an error.
    """
    item = "struct<pair_id:string, api_fit:string, ku_support:string, keep:string, missing_needs:string>"
    body = F.from_json(answer_object(F.col(content)), f"assessments array<{item}>")
    rows = answers.select(*[c for c in answers.columns if c != content], F.posexplode(body["assessments"]).alias("at", "_a"))
    needs = F.when(F.col("_a.missing_needs").startswith("["), string_or_list(F.col("_a.missing_needs"))).otherwise(
        F.filter(F.array("_a.missing_needs"), lambda x: x.isNotNull() & ~x.rlike(r"^\s*(\{|-?\d|true$|false$|null$)"))
    )
    return rows.select(
        *[c for c in rows.columns if c != "_a"],
        F.col("_a.pair_id").alias("pair_id"),
        clamp(F.col("_a.api_fit"), 3).alias("api_fit"),
        clamp(F.col("_a.ku_support"), 2).alias("ku_support"),
        (F.coalesce("_a.keep", F.lit("false")) == "true").alias("keep"),
        needs.alias("missing_needs"),
    )


def constant_verifier(asked: DataFrame, step: int) -> DataFrame:
    """The deterministic mode: every pair fits and is kept."""
    return asked.select(
        *IDS, "pair_id", F.lit(1).alias("api_fit"), F.lit(1).alias("ku_support"), F.lit(True).alias("keep"), F.array().cast("array<string>").alias("missing_needs")
    )


def replay_verifier(recorded: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """Assessments from a table of (dataset, query_id, step, pair_id, ...); every asked pair must have one.

    Answers on pairs that were not asked about do not count. Of several on one pair the last does, by ``at`` if there is one.
    """

    def verify(asked: DataFrame, step: int) -> DataFrame:
        last = F.max_by(F.struct(*ASSESSMENT), F.col("at") if "at" in recorded.columns else F.lit(0))
        own = recorded.where(F.col("step") == step).groupBy(*IDS, "pair_id").agg(last.alias("_last")).select(*IDS, "pair_id", "_last.*")
        if not asked.join(own, [*IDS, "pair_id"], "left_anti").isEmpty():
            raise JudgeError("verification must score every pair it was asked about")
        return asked.select(*IDS, "pair_id").join(own, [*IDS, "pair_id"])

    return verify


def replay_policy(recorded: DataFrame) -> Callable[..., DataFrame]:
    """Choices from a table of (dataset, query_id, step, action_id, reason); each must be a legal action."""

    def choose(actions: DataFrame, step: int, seen: DataFrame | None = None) -> DataFrame:
        own = recorded.where(F.col("step") == step).select(*IDS, "action_id", "reason")
        live = actions.select(*IDS).distinct()
        if not live.join(own, IDS, "left_semi").join(actions.join(own.drop("reason"), [*IDS, "action_id"], "left_semi"), IDS, "left_anti").isEmpty():
            raise JudgeError("the controller chose an illegal action")
        return actions.join(own, [*IDS, "action_id"])

    return choose


def label_pairs(
    pairs: DataFrame, call: Callable[[str, str, int], str] | None = None, demonstrations: DataFrame | None = None, recorded: DataFrame | None = None, ledger: str | None = None
) -> DataFrame:
    """Labels pairs. Without a model or recorded answers all must be labelled already, and stay as they are.

    With one, every row is labelled anew. demonstrations: (target, demonstrations) for the prompt; recorded: (pair_id, content).
    """
    labelled = F.col("identified_relevance").isin("0", "1")
    if call is None and recorded is None:
        if not pairs.where(~F.coalesce(labelled, F.lit(False))).isEmpty():
            raise JudgeError("labelling pairs without labels needs a model or recorded answers")
        return pairs
    if demonstrations is None or demonstrations.isEmpty():
        raise JudgeError("labelling needs a pool of labelled demonstrations")
    if recorded is not None:
        answers = pairs.join(recorded.select("pair_id", "content"), "pair_id")
    else:
        shown = pairs.join(demonstrations.withColumnRenamed("target", "pair_id"), "pair_id", "left")
        answers = ask(shown, call, LABEL_PROMPT, [c for c in shown.columns if c != "_ord"], ledger=ledger).drop("demonstrations")
    return parse_labels(answers).drop("content")
