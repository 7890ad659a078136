"""CSV and JSON sources and sinks.

CSV cells are strings. Spark reads an empty cell and a missing one as null; both become the empty string here. Each row
gets ``_ord``, its place in the file, because file order decides ties further on.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.functions.text import split_trimmed

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
#: Rows that Spark numbers in one task; ``_ord`` is a file's rank times this and the row's number.
FILE_ROWS = 1 << 33


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of strings with ``_ord``: files by their path, rows as they stand in them, whatever files Spark reads together.

    A byte-order mark before the first column's name is dropped.
    """
    raw = spark.read.options(**CSV).csv(str(path))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(FILE_ROWS - 1))
    named = raw.select("*", F.col("_metadata.file_path"), place).toDF(*[c.lstrip("\ufeff") for c in raw.columns], "__file", "__place")
    filled = named.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in named.columns[:-2]], "__file", "__place")
    if len(raw.inputFiles()) < 2:
        return filled.withColumn("_ord", F.col("__place")).drop("__file", "__place")
    paths = sorted(r[0] for r in raw.select("_metadata.file_path").distinct().collect())  # a row a file
    ranks = spark.createDataFrame(list(enumerate(paths)), "__rank long, __file string")
    ranked = filled.join(F.broadcast(ranks), "__file")
    return ranked.withColumn("_ord", F.col("__rank") * FILE_ROWS + F.col("__place")).drop("__rank", "__file", "__place")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of CSV files with headers, each a range of the order, by name; read_csv() reads them in that order.

    Columns that df lacks are empty, other ones are left out. A table that is small gives one file.
    """
    columns = columns or [c for c in df.columns if c != "_ord"]
    ordered = df.orderBy("_ord") if "_ord" in df.columns else df
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    ordered.select(*cells).write.mode("overwrite").options(**options).csv(str(path))


def write_json(path: str | Path, value) -> None:
    """A small driver-side value as indented JSON, non-ASCII characters kept."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(str(path)).select("path", F.sha2("content", 256).alias("sha256"))


def dataset_paths(root: str, dataset: str) -> dict[str, str]:
    folder = os.path.join(str(root), dataset)
    return {"folder": folder, **{name: os.path.join(folder, file) for name, file in (("pairs", "knowledge_pairs.csv"), ("nodes", "nodes.csv"), ("edges", "edges.csv"))}}


def shape_queries(rows: DataFrame, dataset: str | None = None) -> DataFrame:
    """(dataset, query_id, query, ground_truth_apis) in the order of data set and id; labels are split, trimmed, not empty."""
    if dataset:
        rows = rows.where(F.col("dataset") == dataset)
    shaped = rows.select("dataset", F.col("query_id").cast("int").alias("query_id"), "query", split_trimmed(F.col("ground_truth_apis")).alias("ground_truth_apis"))
    return shaped.orderBy("dataset", "query_id")


def load_queries(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    return shape_queries(read_csv(spark, path), dataset)


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    return read_csv(spark, nodes_path), read_csv(spark, edges_path)
