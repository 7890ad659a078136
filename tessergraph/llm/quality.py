"""Quality rules with host-level verdicts, in DataFrame functions only.

Rules judge each document by itself. Their failures are then summed by host, each host's failure rate is shrunk towards
an empirical beta prior fitted to all hosts, and a host whose shrunk rate is over a limit has all its documents rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import SPACE_CLASS, WORD_CLASS, materialize, sized, split_words, table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when its shrunk failure rate is over this.
HOST_LIMIT = 0.5
#: A host's verdict is joined in so many parts, so that a host with a third of all rows is no hot key.
SALTS = 32


def repeat_words(words: Column) -> Column:
    """Words in windows of five words that a text holds twice or more, first occurrences included.

    Windows that may repeat are found by sorting 32-bit hashes packed with their positions (a primitive sort); those are
    then compared as whole windows, so the count is exact.
    """
    w = WINDOW
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - w),
        lambda i: F.shiftleft(F.hash(F.slice(words, i + 1, w)).cast("long"), 32).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(words) > w, hashes).otherwise(F.array().cast("array<long>"))


def _positions(df: DataFrame) -> DataFrame:
    """From words and packed to the sorted positions of windows that occur more than once."""
    w = WINDOW
    high = lambda x: F.shiftright(x, 32)
    at = lambda x: F.col("packed")[x]
    df = df.withColumn("packed", F.sort_array("packed"))
    last = F.size("packed") - 1
    maybe = F.filter(
        "packed",
        lambda x, i: ((i > 0) & (high(x) == high(F.get("packed", i - 1)))) | ((i < last) & (high(x) == high(F.get("packed", i + 1)))),
    )
    df = df.withColumn("maybe", maybe)
    whole = F.sort_array(
        F.transform(
            "maybe",
            lambda x: F.struct(F.slice("words", x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") + 1, w).alias("w"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("i")),
        )
    )
    df = df.withColumn("whole", whole)
    end = F.size("whole") - 1
    twice = F.filter(
        "whole",
        lambda x, i: ((i > 0) & (x["w"] == F.get("whole", i - 1)["w"])) | ((i < end) & (x["w"] == F.get("whole", i + 1)["w"])),
    )
    return df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))


def rule_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One struct column ``row`` with all of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has none of any.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct(*docs.columns).alias("row"), text.alias("__text"))
    df = df.withColumn("words", split_words(F.col("__text")))
    df = _positions(df.withColumn("packed", repeat_words(F.col("words"))))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD_CLASS))
    n = F.size("words").cast("long")
    df = df.select(
        "row",
        n.alias("n_words"),
        F.length(F.regexp_replace("__text", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host_col: str = "source") -> DataFrame:
    """(host, n, failed, rate, host_rejected) for every non-null host.

    The beta prior is fitted to the hosts' rates by moments; where they do not vary it is Beta(1, 1) about their mean.
    """
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    moments = hosts.agg(
        F.avg(F.col("failed") / F.col("n")).alias("mean"), F.coalesce(F.var_samp(F.col("failed") / F.col("n")), F.lit(0.0)).alias("var")
    )
    mean = F.least(F.greatest(F.col("mean"), F.lit(1e-3)), F.lit(1 - 1e-3))
    strength = F.when(F.col("var") > 0, F.greatest(mean * (1 - mean) / F.col("var") - 1, F.lit(2.0))).otherwise(F.lit(2.0))
    prior = moments.select((mean * strength).alias("alpha"), ((1 - mean) * strength).alias("beta"))
    rate = (F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))
    return (
        hosts.join(F.broadcast(prior))  # one row
        .select("host", "n", "failed", rate.alias("rate"))
        .withColumn("host_rejected", F.col("rate") > HOST_LIMIT)
    )


def judge(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row a document: doc_id, the rules' counts, base_failed, host_rate and kept.

    Repeated rows are judged like any others; a null host has no verdict. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.col(host_col).alias("source"))
    judged = materialize(rule_columns(rows).withColumns({"doc_id": F.col("row.doc_id"), "source": F.col("row.source")}).drop("row"))
    hosts = host_verdicts(judged).select("host", "rate", "host_rejected").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(hosts, (salted["source"] == hosts["host"]) & (salted["salt"] == hosts["salt"]), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """The documents that the rules and their hosts' verdicts keep, with the columns of docs."""
    judged = materialize(rule_columns(docs).select("row", F.col(f"row.{host_col}").alias("host"), "base_failed"))
    rejected = materialize(host_verdicts(judged, "host").where("host_rejected").select("host"))
    return judged.where(~F.col("base_failed")).join(sized(rejected), "host", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g
), m AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k FROM c WHERE n > 1
), s AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS k FROM m GROUP BY doc_id
), b AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(s.k, 0) AS n_repeat_words
  FROM d LEFT JOIN s USING (doc_id)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
), h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM f WHERE source IS NOT NULL GROUP BY source
), q AS (SELECT least(greatest(avg(failed / n), 1e-3), 1 - 1e-3) AS mean, coalesce(var_samp(failed / n), 0) AS v FROM h
), p AS (SELECT mean, CASE WHEN v > 0 THEN greatest(mean * (1 - mean) / v - 1, 2) ELSE 2 END AS k FROM q
), r AS (SELECT source, (failed + mean * k) / (n + k) > 0.5 AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM f LEFT JOIN r USING (source)
"""
