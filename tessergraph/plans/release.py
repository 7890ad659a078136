"""Checking that a release of queries and data sets is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.functions.relations import DATASETS, QUERY_IDS
from tessergraph.sources.files import dataset_paths, load_queries


class ReleaseError(ValueError):
    pass


def query_sets(queries: DataFrame) -> DataFrame:
    """(dataset, ids) with the ids sorted; a row for each data set."""
    return queries.groupBy("dataset").agg(F.sort_array(F.collect_list("query_id")).alias("ids"))


def check_queries(queries: DataFrame, datasets: tuple[str, ...] = DATASETS, ids: range = QUERY_IDS) -> None:
    """The query file must name exactly these data sets, and have exactly these ids for each."""
    held = {r["dataset"]: r["ids"] for r in query_sets(queries).limit(len(datasets) + 1).collect()}
    if set(held) != set(datasets):
        raise ReleaseError(f"the query file must hold exactly the data sets {', '.join(datasets)}")
    for name in datasets:
        if held[name] != list(ids):
            raise ReleaseError(f"{name} must have the query ids {ids.start} to {ids.stop - 1}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def validate_release(spark: SparkSession, root: str, queries_path: str) -> DataFrame:
    """The release's queries, once its query file and every data set's files are there."""
    queries = load_queries(spark, queries_path)
    check_queries(queries)
    for name in DATASETS:
        for path in dataset_paths(root, name).values():
            if not path_exists(spark, path):
                raise FileNotFoundError(path)
    return queries
