"""What the corpus operators share: table access, durable intermediates and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.sources.durable import drop_materialized, materialize

#: The six white-space characters that separate words; every other character belongs to a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts; several copies of a batch are in memory at once, in the JVM and in Python.
TEXT_BATCH = 4 << 20
#: Rows of ids or host names that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bounded_batches(df: DataFrame) -> None:
    """Keeps the session's Arrow batches small, whatever the length of the texts."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    plain = re.fullmatch(r"(\d+)b?", conf.get(name) or "")
    if not plain or not 0 < int(plain[1]) <= TEXT_BATCH:
        conf.set(name, str(TEXT_BATCH))


def sized(keys: DataFrame) -> DataFrame:
    """A table of keys, broadcast if it has few enough rows. It is counted first, so it should be cheap to read."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Stands for a null id in Python, where a null would turn a whole batch of ids into floating point.
NO_ID = -(2**63)


def plain_id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def restored(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != NO_ID, F.col(column)))


def split_words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable; nodes without edges are absent.

    Edges with a null end join nothing. No edges give no rows.
    Alternating large-star and small-star steps; each shuffles edges only, aggregates the minimum of a node before the
    shuffle, and ends in a table in the shared folder. A hub joins its own minimum, which adaptive execution can split.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u"), F.least("m", "u").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .union(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = materialize(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialized(now)
        now = after
        if tuple(state) == seen:
            break
        seen = tuple(state)
    labels = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.union(roots.join(labels.select("node"), "node", "left_anti"))


#: Links of a task that are held before they are reduced to those that still join the same nodes.
MOST_LINKS = 500_000


def forest(links: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that join the same nodes: from each node to the smallest that it is joined with."""
    nodes, ends = np.unique(links[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    head = np.arange(len(nodes))
    while (head[a] != head[b]).any():  # heads of linked nodes hook on to the lower one, then all nodes jump to their head's head
        x, y = head[a], head[b]
        np.minimum.at(head, np.maximum(x, y), np.minimum(x, y))
        while (head != (far := head[head])).any():
            head = far
        apart = head[a] != head[b]
        a, b = a[apart], b[apart]
    other = head != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[other], "b": nodes[head[other]]})


def thinned(links: DataFrame) -> DataFrame:
    """Links that join the same nodes, reduced in as few tasks as MOST_LINKS allows. They are counted first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n > MOST_LINKS:
                held = [forest(pd.concat(held))]
                n = len(held[0])
        if held:
            yield forest(pd.concat(held))

    return links.coalesce(links.count() // MOST_LINKS + 1).mapInPandas(run, "a long, b long")


def joined(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b), a written table: what one task can hold needs no rounds of shuffles."""
    less = materialize(thinned(links))
    if links.count() > MOST_LINKS:
        return components(less)
    return less.select(F.col("a").alias("node"), F.col("b").alias("component")).union(less.select("b", "b").distinct())
