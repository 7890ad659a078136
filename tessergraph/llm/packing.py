"""Best-fit packing by length patterns.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity`` numbers)
reaches the driver. Patterns of a few lengths, those of two or three that fill a sequence and those that best-fit finds, get
repeat counts by non-negative least squares on the histogram; counts are rounded down to what is there, and what is left is
packed best-fit, by groups of equal lengths. Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.common import bounded_batches, materialize, plain_id, restored, table

CAPACITY = 1024
END_ID = 2
#: Patterns of three lengths tried for each length.
TRIPLES = 4
SWEEPS = 60
#: Pieces of one length are ranked in so many parts, so that a frequent length is no hot key.
SALTS = 32


@lru_cache(2)
def _encoder(path: str, ranks: str):
    """A function from a text to the ids that the tokenizer file ``path`` gives, its added tokens included.

    ranks: a rank file of the same vocabulary. Added tokens are cut out of the text first, the leftmost one at a time, and
    what stands between them is encoded by itself; a file whose added tokens need more than that is read by ``tokenizers``.
    """
    import json

    import public_tokenizers
    import tiktoken

    from tessergraph.llm.bpe import read_ranks

    with open(path, encoding="utf-8") as held:
        file = json.load(held)
    added = file.get("added_tokens", [])
    if file.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    core = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={t["content"]: t["id"] for t in added})
    names = [t["content"] for t in added]
    return lambda text: core.encode(text, allowed_special="all") if any(n in text for n in names) else core.encode_ordinary(text)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def pieces(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenises whole texts (null: empty) and cuts them: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Repeated rows give repeated pieces; a null id stays null, as does the one id of -2**63. An empty table gives no rows.
    """

    bounded_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, ranks)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = encode(text) if text else []
                ids.append(end_id)
                raw = memoryview(array("I", ids)).cast("B")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = raw[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(own), *([ids[start : start + length]] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": batch["doc_id"].dtype})

    picked = docs.select(plain_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text"))
    return restored(picked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids))


Pattern = tuple[int, ...]


def exact_fills(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of two and three lengths that fill a sequence; counts[n]: pieces of length n."""
    there = np.flatnonzero(counts[:capacity])
    there = there[there > 0]
    patterns = [(a, capacity - a) for a in range(1, capacity // 2 + 1) if counts[a] and counts[capacity - a]]
    for a in there.tolist():
        others = there[(there <= (capacity - a) // 2)]
        others = others[counts[capacity - a - others] > 0]
        if len(others):
            order = others[np.argsort(-counts[others] * counts[capacity - a - others], kind="stable")[:TRIPLES]]
            patterns += [(a, int(b), capacity - a - int(b)) for b in order]
    return sorted({tuple(sorted(p)) for p in patterns})


def fit_patterns(counts: np.ndarray, patterns: dict[Pattern, float]) -> list[tuple[Pattern, int]]:
    """Non-negative least squares of the histogram on patterns, from the repeats given with them; (lengths, repeats), rounded down.

    Rounding never takes a piece that is not there, and patterns with more repeats are served first.
    """
    names = list(patterns)
    columns = [[(n, p.count(n)) for n in sorted(set(p))] for p in names]
    norms = [sum(k * k for _, k in c) for c in columns]
    x, rest = [float(patterns[p]) for p in names], counts.astype(float)
    for j, column in enumerate(columns):
        for n, k in column:
            rest[n] -= k * x[j]
    rest = rest.tolist()
    for _ in range(SWEEPS):  # coordinate descent on |A x - counts|^2 over x >= 0
        moved = 0.0
        for j, column in enumerate(columns):
            new = max(0.0, x[j] + sum(k * rest[n] for n, k in column) / norms[j])
            if step := new - x[j]:
                for n, k in column:
                    rest[n] -= step * k
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    left, out = counts.copy(), []
    for j in sorted(range(len(names)), key=lambda j: (-x[j], names[j])):
        times = min(int(x[j]), min((int(left[n]) // k for n, k in columns[j]), default=0))
        if times > 0:
            out.append((names[j], times))
            for n, k in columns[j]:
                left[n] -= k * times
    return out


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over groups of equal pieces: each piece goes to the fullest sequence it fits."""
    rooms: list[int] = []
    held: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], times: int, room: int) -> None:
        if room == 0:
            done.append((lengths, times))
        else:
            if room not in held:
                insort(rooms, room)
            held.setdefault(room, []).append((lengths, times))

    for n in range(capacity, 0, -1):
        c = int(counts[n])
        while c:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                lengths, times, room = (), c, capacity
            else:
                room = rooms[at]
                lengths, times = held[room].pop()
                if not held[room]:
                    del held[room]
                    rooms.pop(at)
            most = room // n
            full = min(times, c // most)
            if full:
                put(lengths + (n,) * most, full, room - most * n)
                c, times = c - full * most, times - full
            if times and 0 < c < most:
                put(lengths + (n,) * c, 1, room - c * n)
                c, times = 0, times - 1
            if times and lengths:
                put(lengths, times, room)
    return done + [g for room in rooms for g in held[room]]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with repeats that use every piece of the histogram exactly once, in as few sequences as one of three fits needs.

    The fits are of exact fills, of these and the patterns that best-fit finds in this histogram, and of best-fit's patterns
    from its own repeats; the last leaves no residual, so the plan is never longer than best-fit's.
    """
    found: dict[Pattern, float] = {}
    for lengths, times in best_fit(counts, capacity):
        key = tuple(sorted(lengths))
        found[key] = found.get(key, 0) + times
    fills = dict.fromkeys(exact_fills(counts, capacity), 0.0)
    plans = []
    for patterns in (fills, fills | dict.fromkeys(found, 0.0), found):
        fitted = fit_patterns(counts, patterns)
        left = counts.copy()
        for lengths, times in fitted:
            for n in lengths:
                left[n] -= times
        plans.append(fitted + best_fit(left, capacity))
    return min(plans, key=lambda p: sum(times for _, times in p))


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. Repeated rows are pieces of their own; no pieces give no rows."""
    spark = cut_pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    rows, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, times in plan(counts, capacity):
        at = 0
        for n in sorted(set(lengths), reverse=True):
            each = lengths.count(n)
            rows.append((n, int(used[n]), int(used[n]) + each * times, base, each, at))
            used[n] += each * times
            at += each * n
        base += times
    names = ("length", "low", "high", "base", "each", "at")
    # From Arrow the rows reach the JVM as they are; a list of them would start Python workers of another kind on the executors.
    places = spark.createDataFrame(pa.table(dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T))))
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most capacity * SALTS rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(parts), (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before")).drop("l", "s", "own", "before", "salt")
    placed = ranked.join(F.broadcast(places.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    inner = F.col("rank") - F.col("low")
    return placed.withColumns(
        {
            "sequence_id": (F.col("base") + F.floor(inner / F.col("each"))).cast("long"),
            "offset": (F.col("at") + F.pmod(inner, F.col("each")) * F.col("length")).cast("long"),
        }
    ).drop("l", "low", "high", "base", "each", "at", "rank")


def pack_documents(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    path: a tokenizer file; ranks: the rank file of its vocabulary. A null or empty text is one piece, the end id alone.
    Repeated rows, and documents of one id or of none, are packed each by itself. Equal lengths are ranked by doc_id, piece
    and hash, so ties change nothing but which of equal pieces goes where. An empty table gives no rows. Only doc_id and
    text are read, so other columns cannot clash.
    """
    return pack(materialize(pieces(docs, path, ranks, capacity)), capacity)


def sequences(docs: DataFrame, path: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the document and offset of each piece.

    Nulls, repeats and empty tables are as in pack_documents.
    """
    placed = pack(materialize(pieces(docs, path, ranks, capacity, with_ids=True)), capacity)
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return held.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer file and the rank file of its vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())
