"""Keeps a table of (API, knowledge unit) pairs up to date while tutorials and answers keep arriving as new files.

    python -m jobs.collect_pairs --config jobs/collect_pairs.toml --tutorial T --answers A --specification S --output O --checkpoint C

Each run takes the files that no run has taken before, as a file stream's checkpoint knows them, shapes their rows into
pairs, looks their descriptions up, and adds those that are new: a pair is known by its API, kind of source and text,
case-folded and with white space evened out. Output, in the folder ``output``:

``pairs``  partitioned by ``batch`` and ``ku_source``: pair_key, dataset, raw_api, canonical_api, reference,
           reference_origin, ku; of equal pairs the first, by batch, then by the input's order
``apis``   a row for each case-folded API: its spellings, pairs by kind of source, and whether it has a description

A batch that is run again, after a crash between its write and the checkpoint's, replaces its own partitions with the same
rows: what it compares with are only earlier batches. A run without new files changes nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, load, load_stream, log, shaped
from tessergraph.functions.text import casefold, identity
from tessergraph.operators import collect
from tessergraph.sources.durable import sized

PAIRS = "pair_key string, dataset string, raw_api string, canonical_api string, reference string, reference_origin string, ku string, batch long, ku_source string"
CONFIG = str(Path(__file__).with_suffix(".toml"))


def read_pairs(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PAIRS).parquet(f"{output}/pairs")


def keyed(rows: DataFrame) -> DataFrame:
    """Adds pair_key to shaped rows, and leaves the first row of each."""
    source = F.concat("ku_source", F.lit("\0"), casefold("raw_api"))
    keys = rows.withColumn("pair_key", identity(source, casefold("ku")))
    rest = ["ku_source", "raw_api", "ku", "canonical_api"]
    return keys.groupBy("pair_key").agg(F.min_by(F.struct(*rest), "_ord").alias("first")).select("pair_key", "first.*")


def take(rows: DataFrame, batch: int, named: DataFrame, output: str, dataset: str) -> None:
    """Adds a batch's new pairs to the table. Doing it again for the same batch and rows gives the same table."""
    spark = rows.sparkSession
    arrived, written = Observation(), Observation()
    firsts = keyed(rows.observe(arrived, F.count("*").alias("rows")))
    keys = read_pairs(spark, output).where(F.col("batch") < batch).select("pair_key")
    fresh = firsts.join(keys, "pair_key", "left_anti")
    found = collect.described(fresh, named).withColumns({"dataset": F.lit(dataset), "batch": F.lit(batch).cast("long")})
    columns = [c.split()[0] for c in PAIRS.split(", ")]
    out = found.select(*columns).observe(written, F.count("*").alias("rows"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "ku_source").parquet(f"{output}/pairs")
    log.info("collect_pairs: batch %d read %d rows with an API and a text, wrote %d new pairs to %s/pairs", batch, arrived.get["rows"], written.get["rows"], output)


def summary(pairs: DataFrame) -> DataFrame:
    """A row for each case-folded API of the pairs."""
    of = lambda source: F.sum((F.col("ku_source") == source).cast("long"))
    return pairs.groupBy(casefold("raw_api").alias("api_key")).agg(
        F.sort_array(F.collect_set("raw_api")).alias("spellings"), of("SG").alias("tutorial_pairs"), of("QA").alias("answer_pairs"), F.max(F.col("reference") != "").alias("described")
    )


def run(spark: SparkSession, config: dict) -> DataFrame:
    """Takes what is new into the table of pairs and returns the whole table."""
    output = config["output"]
    none = spark.createDataFrame([], PAIRS)
    none.write.mode("append").partitionBy("batch", "ku_source").parquet(f"{output}/pairs")  # the folder, on the first run
    streams = []
    for name in ("tutorial", "answers"):
        spec = config[name]
        order = F.array(*[F.expr(x).cast("long") for x in spec["order"]]).alias("_ord")
        stream = load_stream(spark, spec)
        streams.append(stream.select(*[F.expr(e).alias(c) for c, e in spec["columns"].items()], order))
        log.info("collect_pairs: %s from %s", name, spec["path"])
    named = sized(collect.references(shaped(load(spark, config["specification"]), config["specification"])))
    batch = lambda rows, number: take(rows, number, named, output, config["dataset"])
    query = collect.shaped(*streams).writeStream.foreachBatch(batch).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    pairs = read_pairs(spark, output)
    summary(pairs).write.mode("overwrite").parquet(f"{output}/apis")
    log.info("collect_pairs: %s/apis written anew", output)
    return pairs


if __name__ == "__main__":
    command_line(run, "collect_pairs", CONFIG, ["tutorial", "answers", "specification"], ["output", "checkpoint"])
