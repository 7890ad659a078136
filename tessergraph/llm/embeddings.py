"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Every vector has a home cell, the centre of largest cosine. It is a guest in each other cell whose boundary with its home
is within ``margin`` of it. The distances of two linked vectors from the boundary between their homes add up to at most
their own distance, sqrt(2 - 2 * limit), so with half of that as the margin at least one of them is a guest in the home of
the other, whatever the vectors' directions. A link is counted for a home vector in its home cell, and there for its guest
too if the home vector is no guest in the guest's home; so every link is counted once from each side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import drop_materialized, joined, materialize, table

LIMIT = 0.95
#: Half the distance of two vectors at the limit, and a little for rounding.
MARGIN = 0.5 * (2 - 2 * LIMIT) ** 0.5 + 1e-6
#: Vectors that the centres are fitted on; any centres give right links, good ones give even cells.
FIT_SAMPLE = 20_000
PER_CELL, MOST_CELLS = 2_000, 1_024
#: Rows of a block; a cell of more rows is compared block by block, in tasks of their own.
BLOCK = 8_192
#: Cosines that are held at a time.
CELLS = 1_000_000


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: assign by largest cosine, then make each centre the direction of its members' sum."""
    sample = _unit(sample.astype(np.float64))
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        centres[full] = _unit(sums[full])
    return centres


def _cells_of(vectors: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells, and which cells each vector lies in or near."""
    near = vectors @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
    return home, near[np.arange(len(home)), home][:, None] - near <= margin * apart[home]


def _spanning(tied: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that a block's matrix of links joins."""
    out: list[tuple[int, int]] = []
    open_rows, open_cols = tied.any(1), tied.any(0)
    while open_rows.any():
        front = np.array([open_rows.argmax()])
        root = rows[front[0]]
        open_rows[front] = False
        while len(front):
            hit = np.flatnonzero(open_cols & tied[front].any(0))
            open_cols[hit] = False
            out += [(root, c) for c in cols[hit]]
            front = np.flatnonzero(open_rows & tied[:, hit].any(1)) if len(hit) else hit
            open_rows[front] = False
            out += [(root, r) for r in rows[front]]
    return out


def _linked(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, limit: float) -> np.ndarray:
    """Which cosines are at least limit, in doubles; those that single precision puts clearly below it are not computed again."""
    slack = 1e-5 + 4 * np.finfo(np.float32).eps * x.shape[1]
    maybe = x32 @ y32.T >= limit - slack
    at, to = np.nonzero(maybe)
    if len(at) > 0.02 * maybe.size:
        return x @ y.T >= limit
    for k in range(0, len(at), 20_000):
        i, j = at[k : k + 20_000], to[k : k + 20_000]
        maybe[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= limit
    return maybe


def compare_blocks(pdf: pd.DataFrame, limit: float = LIMIT, kind: str = "<f4") -> pd.DataFrame:
    """One block pair: home rows (side 0) against all rows (side 1). Gives counts (kind 0) and spanning links (kind 1)."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(left) or not len(right):
        return pd.DataFrame({"kind": [], "a": [], "b": []}, dtype=np.int64)
    ids, others = left["node"].to_numpy(), right["node"].to_numpy()
    x, y = (_unit(_rows(part["raw"], kind)) for part in (left, right))
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    times, own_times = right["copies"].to_numpy(), left["copies"].to_numpy()
    # Bits of the cells that each home row lies in; a guest whose home is not among them is counted here, too.
    lies_in = np.unpackbits(np.frombuffer(b"".join(left["cells"]), np.uint8).reshape(len(left), -1), axis=1)
    homes = right["home_cell"].to_numpy()
    counts, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    tied = np.zeros((len(x), len(y)), bool)
    step = max(1, CELLS // len(y))
    for k in range(0, len(x), step):
        hit = _linked(x[k : k + step], y, x32[k : k + step], y32, limit) & (ids[k : k + step, None] != others[None])
        at, to = np.nonzero(hit)
        if not len(at):
            continue
        tied[k : k + step] = hit
        counts[k : k + step] = hit @ times
        unseen = lies_in[k + at, homes[to]] == 0
        np.add.at(back, to[unseen], own_times[k + at[unseen]])
    edges = _spanning(tied, ids, others)
    ids, counts = np.concatenate([ids, others]), np.concatenate([counts, back])
    some = counts > 0
    ends = np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame(
        {
            "kind": np.concatenate([np.zeros(some.sum(), np.int64), np.ones(len(ends), np.int64)]),
            "a": np.concatenate([ids[some], ends[:, 0]]),
            "b": np.concatenate([counts[some], ends[:, 1]]),
        }
    )


def _rows(raw: pd.Series, kind: str) -> np.ndarray:
    """Vectors of one length from their bytes, as doubles."""
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def as_bytes(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, raw): arrays without null components as little-endian bytes, which move and compare as one value; null stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]) * np.dtype(kind).itemsize
            values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), kind)
            buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)]
            raw = pa.Array.from_buffers(pa.binary(), len(column), buffers)
            raw = pa.array(raw.to_pylist(), pa.binary(), mask=column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else raw
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw], ["vec_id", "raw"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, raw binary")


def centres_by_width(nodes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Centres for each vector length in bytes that has enough vectors for two cells; others are one cell each."""
    large = nodes.groupBy(F.length("raw").alias("n")).count().where(F.col("count") >= 2 * PER_CELL)
    counts = {r["n"]: r["count"] for r in large.collect()}  # at most a row for each 2 * PER_CELL vectors
    if not counts:
        return {}
    drawn = nodes.where(F.length("raw").isin(*counts)).orderBy(F.xxhash64("node")).limit(FIT_SAMPLE).select("raw").toPandas()["raw"]
    found = {}
    for width, own in drawn.groupby(drawn.str.len()):
        found[int(width)] = fit_centres(_rows(own, kind), max(1, min(MOST_CELLS, counts[int(width)] // PER_CELL)))
    return found


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, margin: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; links are cosines of at least ``limit``, in doubles.

    All links are found, unless a ``margin`` below half the distance of two vectors at the limit is asked for. Null, zero or
    non-finite vectors, and those with null components or a null id, have no links. Vectors of different lengths have none
    with each other; each length has cells of its own. Repeated vectors and rows are linked like any others. An empty table
    gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    margin = 0.5 * (2 - 2 * limit) ** 0.5 + 1e-6 if margin is None else margin
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.col("vec_id").isNull() | F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = materialize(as_bytes(rows.select("vec_id", F.when(~F.coalesce(bad, F.lit(True)), F.col("v")).alias("v")), kind))
    good = rows.where("raw IS NOT NULL")
    nodes = materialize(good.groupBy("raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    all_centres = centres_by_width(nodes, kind)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, own in batch.groupby(batch["raw"].str.len()):
                if width in all_centres:
                    home, within = _cells_of(_unit(_rows(own["raw"], kind)), all_centres[width], margin)
                else:
                    home, within = np.zeros(len(own), np.int64), np.ones((len(own), 1), bool)
                at, cell = np.nonzero(within)
                bits = [x.tobytes() for x in np.packbits(within, axis=1)]
                cells = [bits[a] if h else b"" for a, h in zip(at.tolist(), (home[at] == cell).tolist())]
                out = own.iloc[at].reset_index(drop=True)
                yield out.assign(width=np.int32(width), cell=cell.astype(np.int32), home=home[at] == cell, home_cell=home[at].astype(np.int32), cells=cells)

    dealt = nodes.mapInPandas(assign, "raw binary, node long, copies long, width int, cell int, home boolean, home_cell int, cells binary")
    dealt = materialize(dealt.withColumn("u", F.pmod(F.xxhash64("node", F.lit("block")), F.lit(1 << 20)).cast("int")))
    blocks = dealt.groupBy("width", "cell").agg(
        F.ceil(F.greatest(F.count_if("home"), F.lit(1)) / BLOCK).cast("int").alias("left_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("right_blocks")
    )
    dealt_out = dealt.join(F.broadcast(blocks), ["width", "cell"])  # a row a cell
    part = lambda n: F.floor(F.col("u") * F.col(n) / (1 << 20)).cast("int")
    about = ("node", "copies", "home_cell")
    left = dealt_out.where("home").select(
        "width", "cell", part("left_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"), F.lit(0).alias("side"), *about, "cells", "raw"
    )
    right = dealt_out.select(
        "width", "cell", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), part("right_blocks").alias("j"), F.lit(1).alias("side"), *about, F.lit(b"").alias("cells"), "raw"
    )
    found = materialize(
        left.unionByName(right).groupBy("width", "cell", "i", "j").applyInPandas(lambda pdf: compare_blocks(pdf, limit, kind), "kind long, a long, b long")
    )
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    groups = joined(found.where("kind = 1").select("a", "b"))
    heads = nodes.join(counts, "node", "left").join(groups, "node", "left")
    heads = materialize(
        heads.select("raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    for df in (nodes, dealt, found):
        drop_materialized(df)
    linked = rows.join(heads, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a
), m AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM e JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
