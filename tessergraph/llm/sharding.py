"""Sharding by sampled splitters.

Keys are (hash of the text, document id), so equal texts lie together and no key is hot. A size-weighted sample of keys
gives quantile splitters for many fine ranges; the exact bytes of each range place it on the line of all bytes, which is
cut into equal shards. A range that a cut goes through is subdivided exactly, by its running sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.common import materialize, table

#: Expected number of sampled keys, which bounds what the driver holds; of fine ranges, at least; and of rows in a range, as
#: long as there are enough sampled keys. None of them changes the law.
SAMPLE_KEYS = 20_000
FINE_RANGES = 512
RANGE_ROWS = 100_000


def _range_of(keys: np.ndarray, ids: np.ndarray):
    """A vectorised function from (key, id) to the number of splitters at or below it."""

    @F.pandas_udf("int")
    def find(key: pd.Series, doc: pd.Series) -> pd.Series:
        k, d = key.to_numpy(np.int64), doc.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for at in np.flatnonzero(low < high):  # equal keys: the document id decides
            low[at] += np.searchsorted(ids[low[at] : high[at]], d[at], "right")
        return pd.Series(low.astype(np.int32))

    return find


def assign_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, sample: int = SAMPLE_KEYS, carry: bool = False
) -> DataFrame:
    """Assigns each row a shard of near-equal bytes and a gapless slot in it.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and, to ``carry``, a struct ``row`` of all columns of
    docs; else its other columns are not read. A null text counts as empty; a null id sorts as the smallest. Repeated rows,
    and different rows of one id or of none, are placed each by itself. Shards differ by at most one text's bytes; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("tie"),
            *([F.struct(*docs.columns).alias("row")] if carry else []),
        )
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or max(FINE_RANGES, min(sample, count // RANGE_ROWS))
    drawn = (F.pmod(F.xxhash64("tie", F.lit("splitter")), F.lit(1 << 30)) / (1 << 30)) < F.col("size") * (sample / max(total, 1))
    picked = sorted(rows.where(drawn).select("key", "tie").distinct().collect())
    picked = [picked[len(picked) * i // ranges] for i in range(1, ranges)] if len(picked) >= ranges else picked
    cuts = np.array(picked, dtype=np.int64).reshape(-1, 2)
    placed = rows.withColumn("range", _range_of(cuts[:, 0].copy(), cuts[:, 1].copy())("key", "tie"))
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()
    before, ahead, b, n = [], [], 0, 0
    held = {r["range"]: r for r in sums}
    for i in range(len(picked) + 1):
        before.append(b)
        ahead.append(n)
        if i in held:
            b, n = b + held[i]["bytes"], n + held[i]["n"]
    spark = docs.sparkSession
    starts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(before, ahead))], "range int, before long, ahead long")
    own = Window.partitionBy("range").orderBy("key", "tie", "size", "text_crc32")
    ranked = (
        placed.join(F.broadcast(starts), "range")  # at most as many rows as sampled keys
        .withColumn("place", F.col("before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.col("ahead") + F.row_number().over(own) - 1)
        .withColumn("shard", F.least(F.floor(F.col("place") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
    )
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, task_rows: int = RANGE_ROWS) -> None:
    """Writes docs as one folder a shard, ``shard=K``; each shard is written by several tasks, split by slot and in its order.

    Every row is written once with all its columns, null ids and repeated rows too. If docs has a column ``shard`` the
    folders are named ``shard_=K``, and so on. An empty table gives an empty one.
    """
    name = "shard"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    placed = assign_shards(docs, shards, carry=True)
    part = F.floor(F.col("slot") / task_rows)
    dealt = placed.repartition("shard", part).sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
