"""Phrase mining by hashed buckets: frequent phrases of two to five words, scored by how tightly they hold together.

Pass n reads all texts, counts phrases of n words exactly, and counts those of n + 1 words in hashed buckets. A bucket that
is too small holds no frequent phrase, so its bit is off in a bitmap that the next pass gets; that pass also gets a bitmap
of the frequent phrases of n words, and counts a longer phrase exactly only where both bitmaps allow it. Both may let rare
phrases through and never hold a frequent one back, so the counts that remain are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessergraph.llm.common import bounded_batches, drop_materialized, materialize, sized, table

MOST_WORDS = 5
LEAST = 100
TOP = 2000
#: Buckets of a pass, and bits of a bitmap: 2 MB, whatever the size of the corpus.
BUCKET_BITS = 24
#: Bytes of text of one language that are cut together, and phrases and buckets that a task holds before it hands them on.
BLOCK, MOST_COUNTS, MOST_SLOTS = 4 << 20, 200_000, 4_000_000
#: Parts that each language's phrases are ranked in before their firsts meet.
SALTS = 32

#: A byte that UTF-8 never has stands for the end of a piece.
END = b"\xff"
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
SPREAD, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Buckets of a part of a bitmap; parts are added up and returned one by one.
PART_BITS = 16


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word's spelling, number of each word's piece, spellings) of UTF-8 texts joined by END."""
    raw = np.frombuffer(text.translate(LETTERS), np.uint8)
    ends = raw == END[0]
    inside = ~((raw == ord(" ")) | ends)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    first, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), np.cumsum(ends, dtype=np.int64)[first], words.dictionary.to_pylist()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = crc32(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * SPREAD) >> np.uint64(64 - bits)


def phrase_hashes(own: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row, from the words' hashes."""
    out = own
    for k in range(1, n):
        out = out[:-1] * STEP + own[k:]
    return out


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def cells(at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """How often each bucket occurs, by part: (part, 16-bit places, then 32-bit counts)."""
    found, times = np.unique(at, return_counts=True)
    part = found >> np.uint64(PART_BITS)
    for k in np.unique(part):
        mine = slice(*np.searchsorted(part, [k, k + np.uint64(1)]))
        yield int(k), found[mine].astype("<u2").tobytes() + times[mine].astype("<u4").tobytes()


def bitmap(counted: DataFrame, least: int) -> np.ndarray:
    """A bit for each bucket with ``least`` or more, from (part, cells). Tasks add parts up one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(held) // 6
                total = sums.setdefault(part, np.zeros(1 << PART_BITS, np.int64))
                total[np.frombuffer(held, "<u2", n)] += np.frombuffer(held, "<u4", n, 2 * n)
        rows = [(k, np.packbits(v >= least, bitorder="little").tobytes()) for k, v in sums.items()]
        if rows:
            yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in rows], pa.int32()), "cells": pa.array([b for _, b in rows], pa.binary())})

    size = 1 << (PART_BITS - 3)
    bits = np.zeros(1 << (BUCKET_BITS - 3), np.uint8)
    for row in counted.select("part", "cells").repartition("part").mapInArrow(run, "part int, cells binary").collect():  # 2 MB in all
        bits[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["cells"], np.uint8)
    return bits


COUNTS = "lang string, phrase string, n long, part int, cells binary"


def _batch(counts: list[tuple[str, bytes, int]], parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n, m = len(counts), len(parts)
    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([c[0] for c in counts] + [None] * m, pa.string()),
            "phrase": pa.array([c[1] for c in counts] + [None] * m, pa.binary()).cast(pa.string()),
            "n": pa.array([c[2] for c in counts] + [None] * m, pa.int64()),
            "part": pa.array([None] * n + [p[0] for p in parts], pa.int32()),
            "cells": pa.array([None] * n + [p[1] for p in parts], pa.binary()),
        }
    )


def counter(n: int, buckets: np.ndarray | None, frequent: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (lang, text) to COUNTS: phrases of n words with their counts, and buckets of n + 1 words, both of a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bytes], int] = {}
        later: list[np.ndarray] = []
        waiting: dict[str, list[bytes]] = {}

        def count(lang: str) -> None:
            codes, piece, names = cut(END.join(waiting.pop(lang)))
            if len(codes) < n:
                return
            own = word_hashes(lang, names)[codes]
            keep = piece[: len(piece) - n + 1] == piece[n - 1 :]
            if n > 1:
                shorter = has(frequent, slots(phrase_hashes(own, n - 1), BUCKET_BITS))
                keep &= has(buckets, slots(phrase_hashes(own, n), BUCKET_BITS)) & shorter[:-1] & shorter[1:]
            at = np.flatnonzero(keep)
            ids = codes[at]
            for k in range(1, n):
                ids = pd.factorize(ids * len(names) + codes[at + k])[0].astype(np.int64)
            _, first, times = np.unique(ids, return_index=True, return_counts=True)
            for start, m in zip(at[first].tolist(), times.tolist()):
                key = lang, b" ".join([names[c] for c in codes[start : start + n]])
                counts[key] = counts.get(key, 0) + m
            if n < MOST_WORDS and len(codes) > n:
                both = keep[:-1] & keep[1:] & (piece[: len(piece) - n] == piece[n:])
                later.append(slots(phrase_hashes(own, n + 1), BUCKET_BITS)[both])

        def handed_on() -> Iterator[pa.RecordBatch]:
            if counts:
                yield _batch([(*k, m) for k, m in counts.items()], [])
                counts.clear()
            if later:
                yield _batch([], list(cells(np.concatenate(later))))
                later.clear()

        def counted(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                del sizes[lang]
                count(lang)
                if len(counts) > MOST_COUNTS or sum(map(len, later)) > MOST_SLOTS:
                    yield from handed_on()

        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= BLOCK:
                    yield from counted([lang])
                elif sum(sizes.values()) >= 4 * BLOCK:  # of many languages, none of which fills a block
                    yield from counted([*sizes])
        yield from counted([*sizes])
        yield from handed_on()

    return run


def marker() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From frequent phrases (lang, phrase) to the buckets that they fall in, as (part, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
            found = [phrase_hashes(word_hashes(lang, words), len(words)) for lang, words in ((a, b.split(b" ")) for a, b in rows)]
            parts = list(cells(slots(np.concatenate(found), BUCKET_BITS))) if found else []
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in parts], pa.int32()), "cells": pa.array([c for _, c in parts], pa.binary())})

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of one to five words with ``least`` or more occurrences, (lang, n) of all words), written tables.

    A null text has no words, a null language is ``und``. Rows that repeat count each time; whole texts are counted, whatever
    their length; an empty table gives no rows. Other columns are not read.
    """
    bounded_batches(docs)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found, totals, buckets, frequent = [], None, None, None
    for n in range(1, MOST_WORDS + 1):
        raw = materialize(texts.mapInArrow(counter(n, buckets, frequent), COUNTS))
        exact = raw.where("phrase IS NOT NULL")
        if n == 1:
            totals = materialize(exact.groupBy("lang").agg(F.sum("n").alias("n")))
        held = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        found.append(materialize(held.select("lang", F.lit(n).alias("words"), "phrase", "f")))
        if n == MOST_WORDS or found[-1].isEmpty():
            break
        buckets = bitmap(raw.where("part IS NOT NULL"), least)
        frequent = bitmap(found[-1].select("lang", "phrase").mapInArrow(marker(), "part int, cells binary"), 1)
        drop_materialized(raw)
    return reduce(DataFrame.union, found), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two or more words: the cut of the lowest score, of equal ones the first.

    Both sides of a cut occur at least as often as the phrase, so both are among the phrases. Numbers are multiplied as
    decimals of 38 digits: exact up to 1e15 words.
    """
    joined = lambda start, n: F.array_join(F.slice("parts", start, n), " ")
    cuts = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("parts"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    side = lambda part, f: phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(sized(totals), "lang")
    exact = lambda c: c.cast("decimal(18,0)")
    score = F.call_function("div", exact(F.col("a") * 1000) * exact(F.col("n")), exact(F.col("l")) * exact(F.col("r")))
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def unabsorbed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of two or more words that no longer frequent phrase holds as often.

    A phrase never occurs more often than a part of it, so it is enough to look at phrases of one word more.
    """
    longer = phrases.where("words > 2").select("lang", "f", F.col("words") - 1, F.split("phrase", " ").alias("parts")).toDF("lang", "f", "words", "parts")
    within = F.array(*[F.array_join(F.slice("parts", start, F.col("words")), " ") for start in (1, 2)])
    taken = longer.select("lang", F.explode(within).alias("phrase"), "f").distinct()
    return phrases.where("words > 1").join(taken, ["lang", "phrase", "f"], "left_anti").select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, then count, then spelling; see frequent_phrases()."""
    phrases, totals = frequent_phrases(docs, text_col, lang_col, least)
    ranked = materialize(scored(phrases, totals).join(unabsorbed(phrases), ["lang", "phrase"], "left_semi"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, 6) AS r(m) WHERE len(w) >= m))
  GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(list_slice(x, 1, k), ' ') AS head, array_to_string(list_slice(x, k + 1, m), ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS x, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), s AS (
  SELECT c.lang, c.m, c.phrase, a, c.k, h.f AS l, e.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(h.f AS HUGEINT) * e.f) AS BIGINT) AS score
  FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f e ON e.lang = c.lang AND e.phrase = c.tail JOIN t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s
WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = s.lang AND z.m > s.m AND 100 * z.f >= 100 * s.a AND contains(' ' || z.phrase || ' ', ' ' || s.phrase || ' '))
QUALIFY rank <= 2000
"""
