"""What the jobs share: config files, inputs and the command line.

An input is a table of a config: ``path`` and ``format``, ``columns`` (SQL expressions by name), and optionally ``join``, a
table with a path and the columns ``on`` which it is joined from the left, and ``where``. Paths may be remote: only Spark
reads and writes them. The config file itself is a small local file.
"""

from __future__ import annotations

import argparse
import logging
import re
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def load(spark: SparkSession, spec: dict) -> DataFrame:
    return spark.read.format(spec.get("format", "parquet")).options(**spec.get("options", {})).load(spec["path"])


def load_stream(spark: SparkSession, spec: dict) -> DataFrame:
    """The files of an input as a stream, with the columns that they have now.

    The path goes to Spark as a pattern that matches nothing else, so that it may be a single file as well as a folder.
    """
    path = spec["path"].rstrip("/")
    pattern = path if re.search(r"[*?{\[]", path) else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.format(spec.get("format", "parquet")).options(**spec.get("options", {})).schema(load(spark, spec).schema).load(pattern)


def shaped(rows: DataFrame, spec: dict) -> DataFrame:
    """An input's rows with the columns that its config names."""
    if "join" in spec:
        rows = rows.join(load(rows.sparkSession, spec["join"]), spec["join"]["on"], "left")
    if "where" in spec:
        rows = rows.where(spec["where"])
    return rows.select(*[F.expr(e).alias(name) for name, e in spec["columns"].items()])


def read_config(path: str, **changes: str | None) -> dict:
    """A config file's values; ``changes`` that are given replace them. A dotted name reaches into a table."""
    config = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for name, value in changes.items():
        if value is not None:
            *tables, last = name.split(".")
            held = config
            for table in tables:
                held = held[table]
            held[last] = value
    return config


def command_line(job: Callable[[SparkSession, dict], DataFrame], name: str, config: str, inputs: list[str], outputs: list[str], argv: list[str] | None = None) -> None:
    """Runs a job in a session of its own: --config, and an option for each path in it."""
    parser = argparse.ArgumentParser(prog=name, description=job.__doc__)
    parser.add_argument("--config", default=config, help="a TOML file; the other options replace its paths")
    for x in (*inputs, *outputs):
        parser.add_argument(f"--{x}")
    args = vars(parser.parse_args(argv))
    changes = {f"{x}.path": args[x] for x in inputs} | {x: args[x] for x in outputs}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, read_config(args["config"], **changes))
    finally:
        spark.stop()
