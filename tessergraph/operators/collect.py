"""Collecting (API, knowledge unit) pairs from a specification, a tutorial and question-and-answer text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.functions.text import casefold, first_nonempty, normalize_text, pair_id

# Column names that inputs may use, in order of preference.
SPEC_API = ("canonical_api", "resolved_api", "api", "API", "raw_api")
SPEC_TEXT = ("description", "DP", "reference", "ku", "KI")
SPEC_ORIGIN = ("reference_origin", "origin", "source")
RAW_API = ("api", "API", "raw_api")
CANONICAL_API = ("canonical_api", "resolved_api")
SOURCES = (("SG", ("ku", "KI", "segment", "SG")), ("QA", ("ku", "KI", "answer", "QA")))

PAIR_COLUMNS = ["pair_id", "dataset", "ku_source", "raw_api", "canonical_api", "reference", "reference_origin", "ku", "identified_relevance", "relevant_groundtruth"]
REFERENCE_COLUMNS = ["canonical_api", "reference", "reference_origin"]

#: Rows of a block that is numbered by itself.
BLOCK_BITS = 13


def number_rows(df: DataFrame, rank: str, order: str = "_ord") -> Column | DataFrame:
    """Adds ``index``, the 1-based place by (rank, order), without one task for all rows.

    Rows are numbered inside blocks of neighbouring places; the blocks' counts, a row for each, give the offsets.
    """
    blocked = df.withColumn("_block", F.shiftright(F.col(order), BLOCK_BITS))
    before = F.sum("n").over(Window.orderBy(rank, "_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = blocked.groupBy(rank, "_block").agg(F.count("*").alias("n"))
    offsets = counts.select(rank, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(rank, "_block").orderBy(order))
    return blocked.withColumn("_inside", inside).join(offsets, [rank, "_block"]).withColumn("index", F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def references(specification: DataFrame) -> DataFrame:
    """A description for each case-folded API: the last row's values at the first row's place."""
    columns = specification.columns
    rows = specification.select(
        normalize_text(first_nonempty(columns, SPEC_API)).alias("canonical_api"),
        normalize_text(first_nonempty(columns, SPEC_TEXT)).alias("reference"),
        normalize_text(first_nonempty(columns, SPEC_ORIGIN)).alias("reference_origin"),
        "_ord",
    ).where((F.col("canonical_api") != "") & (F.col("reference") != ""))
    held = rows.withColumn("key", casefold("canonical_api")).groupBy("key").agg(
        F.max_by(F.struct(*REFERENCE_COLUMNS), "_ord").alias("row"), F.min("_ord").alias("_ord")
    )
    return held.select("key", "row.*", "_ord")


def shaped(tutorial: DataFrame, stackoverflow: DataFrame) -> DataFrame:
    """(src_rank, ku_source, raw_api, ku, canonical_api, _ord) of both inputs' rows that have an API and a text; streams as well as tables."""
    parts = []
    for rank, ((source, names), table) in enumerate(zip(SOURCES, (tutorial, stackoverflow))):
        columns = table.columns
        parts.append(
            table.select(
                F.lit(rank).alias("src_rank"),
                F.lit(source).alias("ku_source"),
                normalize_text(first_nonempty(columns, RAW_API)).alias("raw_api"),
                normalize_text(first_nonempty(columns, names)).alias("ku"),
                normalize_text(first_nonempty(columns, CANONICAL_API)).alias("canonical_api"),
                "_ord",
            ).where((F.col("raw_api") != "") & (F.col("ku") != ""))
        )
    return parts[0].unionByName(parts[1])


def described(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Adds reference and reference_origin from references(): the canonical API's record, or else the raw one's, as a whole."""
    record = F.struct("reference", "reference_origin")
    wanted = rows.withColumn("_key", casefold(F.coalesce(F.nullif("canonical_api", F.lit("")), "raw_api"))).withColumn("_raw", casefold("raw_api"))
    one = named.select(F.col("key").alias("_key"), record.alias("_one"))
    two = named.select(F.col("key").alias("_raw"), record.alias("_two"))
    found = wanted.join(one, "_key", "left").join(two, "_raw", "left").withColumn("_found", F.coalesce("_one", "_two"))
    return found.select(*rows.columns, *[F.coalesce(f"_found.{c}", F.lit("")).alias(c) for c in ("reference", "reference_origin")])


def collect(tutorial: DataFrame, stackoverflow: DataFrame, specification: DataFrame, dataset: str = "") -> tuple[DataFrame, DataFrame]:
    """(pairs, references); both keep ``_ord``, their order.

    A pair takes the description of its canonical API, or else of its raw one, as a whole record.
    """
    named = references(specification)
    found = described(number_rows(shaped(tutorial, stackoverflow), "src_rank"), named)
    pairs = found.select(
        pair_id(F.col("index")).alias("pair_id"),
        F.lit(dataset).alias("dataset"),
        *["ku_source", "raw_api", "canonical_api", "reference", "reference_origin", "ku"],
        F.lit("").alias("identified_relevance"),
        F.lit("").alias("relevant_groundtruth"),
        F.col("index").alias("_ord"),
    )
    return pairs, named.drop("key")
