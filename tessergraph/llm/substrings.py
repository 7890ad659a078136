"""Substring dedup by difference-cover anchors.

A window is 20 consecutive words. Anchors are windows of 8 words at positions whose remainder modulo 13 lies in the
difference cover {0, 1, 3, 9}: for any two positions some shift below 13 brings both into the cover, so equal windows of
20 words always share an aligned anchor. Only anchors are hashed and dealt. Each carries a hash of the 12 words on either
side; among anchors equal with their surroundings, all but the first repeat every window about them. Anchors that repeat
with other surroundings are extended: the windows about them are hashed and compared one by one. Both passes read sorted
rows as a stream, so a frequent passage is never held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import bounded_batches, materialize, plain_id, restored, sized, table

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
SIDE = PERIOD - 1
#: Bytes of text hashed at a time. Workers keep the powers of twice as many places for each hash.
CHUNK = 1 << 16
ROW = "h long, c long, k long, t long, p int, done boolean"
#: Rows that are looked at together before they are dealt; several copies of them are in memory, in the JVM and in Python.
MERGED_ROWS = 50_000
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(4)
def _constants(seed: int) -> tuple[np.ndarray, int, int]:
    draw = np.random.default_rng(seed)
    base = int(draw.integers(0, 1 << 62)) * 8 + 5  # odd, so it has an inverse modulo 2**64
    return draw.integers(0, 1 << 64, 256, dtype=np.uint64), base % (1 << 64), pow(base, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64. Those of a long text are made for it alone, and not kept."""
    if n < 2 * CHUNK and base in _powers:
        return _powers[base][: n + 1]
    out = np.full(max(n + 1, 2 * CHUNK), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n < 2 * CHUNK:
        _powers[base] = out
    return out[: n + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[j] * base ** j, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values))[: len(values)], out=out[1:])
    return out


def _range(sums: np.ndarray, low: np.ndarray, high: np.ndarray, inverse: int) -> np.ndarray:
    """A hash of values[low:high], the same wherever the values stand."""
    return _mix((sums[high] - sums[low]) * _power(inverse, len(sums))[low])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_sums(raw: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums over the hashes of a text's words."""
    values, base, inverse = _constants(seed)
    starts, ends = word_spans(raw)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in chunks, so that a very long text takes bounded memory
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK)))
        low, high = starts[at], ends[stop - 1]
        sums = _sums(values[raw[low:high]], base)
        hashes[at:stop] = _range(sums, starts[at:stop] - low, ends[at:stop] - low, inverse) + (ends[at:stop] - starts[at:stop]).astype(np.uint64)
        at = stop
    return _sums(_mix(hashes), base)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the positions, hashes and hashes with surroundings of its anchors."""
    inverse = _constants(0)[2]
    cover = np.array(COVER)
    for text in texts:
        sums = word_sums(_bytes(text), 0)
        n = len(sums) - 1
        if n < WINDOW:
            none = np.empty(0, np.uint64)
            yield np.empty(0, np.int32), none, none
            continue
        at = (np.arange(0, n, PERIOD)[:, None] + cover).ravel()
        at = at[at + ANCHOR <= n]
        low, high = np.maximum(at - SIDE, 0), np.minimum(at + ANCHOR + SIDE, n)
        around = _range(sums, low, high, inverse) + _mix(((at - low) * 64 + (high - at)).astype(np.uint64))
        yield at.astype(np.int32), _range(sums, at, at + ANCHOR, inverse), around


def _deal_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            own = batch.iloc[k : k + 256]
            found = list(anchors(own["text"].tolist()))
            yield pd.DataFrame(
                {
                    "h": np.concatenate([f[1] for f in found]).view(np.int64),
                    "c": np.concatenate([f[2] for f in found]).view(np.int64),
                    "k": np.repeat(own["k"].to_numpy(), [len(f[0]) for f in found]),
                    "t": np.repeat(own["t"].to_numpy(), [len(f[0]) for f in found]),
                    "p": np.concatenate([f[0] for f in found]),
                }
            )


def _texts_of(frame: pd.DataFrame) -> np.ndarray:
    """Which of the texts of its id a row is of; frames without ``t`` have one text an id."""
    return frame["t"].to_numpy() if "t" in frame else np.zeros(len(frame), np.int64)


def combined(frame: pd.DataFrame) -> pd.DataFrame:
    """Adds ``done``: rows of a batch that repeat an earlier row's (h, c). Those are settled, and dealt evenly.

    Of a passage that many documents share, a batch then sends one row by its hash, however often it holds it.
    """
    h, c, k, t, p = *(frame[x].to_numpy() for x in "hck"), _texts_of(frame), frame["p"].to_numpy()
    order = np.lexsort((p, t, k, c, h))
    h, c, k, t, p = h[order], c[order], k[order], t[order], p[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    done = again & ((k != k[head]) | (t != t[head]) | (p != p[head]))  # a repeated row of the first itself is not settled
    spread = _mix((k ^ t).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64)).view(np.int64)
    out = pd.DataFrame({"h": np.where(done, spread, h), "c": c, "k": k, "t": t, "p": p, "done": done})
    return out if "t" in frame else out.drop(columns="t")


def repeated_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (h, c, k, t, p): (k, p, whole, t), whole where an earlier anchor has equal surroundings.

    Anchors that only repeat with other surroundings come out with whole = 0, once for each surroundings. Rows that are done
    come out whole, and count for no other row. Across batches
    it carries the last row's hashes, the first row of its (h, c), and whether its h was seen with more than one c.
    """
    last = None  # h, c, k, p and t of the first row of the last (h, c); emitted: whether its h is known to have several c
    emitted = False
    named = lambda batch, out: out if "t" in batch else out.drop(columns="t")
    for batch in batches:
        done = batch["done"].to_numpy(bool)
        if done.any():
            yield named(batch, batch.loc[done, ["k", "p"]].assign(whole=True, t=_texts_of(batch)[done]))
            batch = batch[~done]
        n = len(batch)
        if not n:
            continue
        h, c, k, t, p = *(batch[x].to_numpy() for x in "hck"), _texts_of(batch), batch["p"].to_numpy()
        new_h, new_c = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        if last is not None:
            new_h[0] = h[0] != last[0]
            new_c[0] = new_h[0] or c[0] != last[1]
        heads = np.flatnonzero(new_c)
        head = np.cumsum(new_c) - 1  # the row that began this row's (h, c); -1: one of an earlier batch
        first_k = np.where(head < 0, last[2] if last else 0, k[heads[np.maximum(head, 0)]] if len(heads) else 0)
        first_p = np.where(head < 0, last[3] if last else 0, p[heads[np.maximum(head, 0)]] if len(heads) else 0)
        first_t = np.where(head < 0, last[4] if last else 0, t[heads[np.maximum(head, 0)]] if len(heads) else 0)
        whole = ~new_c & ((k != first_k) | (t != first_t) | (p != first_p))
        # Heads that share h with another head.
        group = np.cumsum(new_h)[heads] if len(heads) else np.empty(0, np.int64)
        several = np.zeros(len(heads), bool)
        several[1:] |= group[1:] == group[:-1]
        several[:-1] |= group[1:] == group[:-1]
        out_k, out_p, out_t = [], [], []
        if last is not None and len(heads) and group[0] == 0:  # the last batch's h goes on with another c
            several[group == 0] = True
            if not emitted:
                out_k.append(last[2])
                out_p.append(last[3])
                out_t.append(last[4])
                emitted = True
        picked = heads[several]
        out = pd.DataFrame(
            {
                "k": np.concatenate([k[whole], np.array(out_k, np.int64), k[picked]]),
                "p": np.concatenate([p[whole], np.array(out_p, np.int32), p[picked]]).astype(np.int32),
                "whole": np.concatenate([np.ones(whole.sum(), bool), np.zeros(len(out_k) + len(picked), bool)]),
                "t": np.concatenate([t[whole], np.array(out_t, np.int64), t[picked]]),
            }
        )
        yield named(batch, out)
        if len(heads):
            at = heads[-1]
            if group[-1] > 0:
                emitted = False
            emitted = emitted or bool(several[-1])
            last = (h[at], c[at], k[at], p[at], t[at])


def _windows_about(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that hold an anchor at one of these positions."""
    starts = (np.asarray(at)[:, None] - np.arange(PERIOD)).ravel()
    return np.unique(starts[(starts >= 0) & (starts + WINDOW <= n)])


def _deal_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    one, two = _constants(1)[2], _constants(2)[2]
    for batch in batches:
        for k, t, text, at in zip(batch["k"].tolist(), batch["t"].tolist(), batch["text"].tolist(), batch["part"].tolist()):
            raw = _bytes(text)
            first, second = word_sums(raw, 1), word_sums(raw, 2)
            starts = _windows_about(at, len(first) - 1)
            yield pd.DataFrame(
                {
                    "h": _range(first, starts, starts + WINDOW, one).view(np.int64),
                    "c": _range(second, starts, starts + WINDOW, two).view(np.int64),
                    "k": np.full(len(starts), k, np.int64),
                    "t": np.full(len(starts), t, np.int64),
                    "p": starts.astype(np.int32),
                }
            )


def _merged(frames: Iterator[pd.DataFrame], rows: int = MERGED_ROWS) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _repeated_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for out in repeated_anchors(batches):
        yield out.loc[out["whole"], ["k", "t", "p"]]


def covered(n: int, whole, starts) -> np.ndarray:
    """Which of n words a repeated window covers."""
    found = [np.asarray(starts, np.int64)] if starts is not None else []
    if whole is not None and len(whole):
        found.append(_windows_about(np.asarray(whole, np.int64), n))
    if not found:
        return np.zeros(n, bool)
    at = np.concatenate(found)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(change[:n]) > 0


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, text, keep..., whole, starts): each text with the anchors and windows that repeat an earlier one.

    A text is known by its id and, where rows of one id have different texts, by its hash ``t`` (0 elsewhere).
    """
    bounded_batches(docs)
    texts = docs.select(plain_id(F.col(id_col)).alias("k"), F.col(text_col).alias("text"), *keep)
    hashed = texts.select("k", F.xxhash64("text").alias("t"))
    shared = sized(materialize(hashed.groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("k", F.lit(True).alias("__shared"))))
    texts = texts.join(shared, "k", "left").withColumn("t", F.when(F.col("__shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("__shared")
    dealt = texts.select("k", "t", "text").mapInPandas(lambda x: map(combined, _merged(_deal_anchors(x))), ROW)
    found = dealt.repartition("h").sortWithinPartitions("h", "c", "k", "t", "p").mapInPandas(repeated_anchors, "k long, p int, whole boolean, t long")
    marks = materialize(
        found.groupBy("k", "t").agg(
            F.collect_set(F.when(~F.col("whole"), F.col("p"))).alias("part"), F.collect_set(F.when(F.col("whole"), F.col("p"))).alias("whole")
        )
    )
    joined = texts.join(marks, ["k", "t"], "left")
    windows = joined.where(F.size("part") > 0).select("k", "t", "text", "part").mapInPandas(lambda x: map(combined, _merged(_deal_windows(x))), ROW)
    later = windows.repartition("h").sortWithinPartitions("h", "c", "k", "t", "p").mapInPandas(_repeated_windows, "k long, t long, p int")
    starts = later.groupBy("k", "t").agg(F.collect_set("p").alias("starts"))
    return joined.drop("part").join(starts, ["k", "t"], "left").drop("t")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A word is removed if a window of 20 words that covers it also starts earlier: in a document of smaller id, or earlier
    in the same one. A null text has no words; a null id comes before all others. Different texts of one id (or of none)
    are documents of their own, in the order of their hashes; repeated rows give repeated results and do not count as each
    other's copies. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, whole, starts in zip(batch["text"].tolist(), batch["whole"].tolist(), batch["starts"].tolist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), whole, starts)
                if gone.any():
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((len(gone), int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = marked(docs.select("doc_id", "text")).withColumnRenamed("k", "doc_id")
    return restored(rows.select("doc_id", "text", "whole", "starts").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def cut_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their texts; the columns of docs, n_chars kept true if there is one.

    White space before a removed word goes with it; other white space stays. A text of nothing but repeats becomes empty.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, wholes: pd.Series, all_starts: pd.Series) -> pd.Series:
        out = []
        for text, whole, starts in zip(texts.tolist(), wholes.tolist(), all_starts.tolist()):
            if text is not None and (whole is not None and len(whole) or starts is not None and len(starts)):
                raw = text.encode("utf-8", "surrogatepass")
                spans = [m.span() for m in _WORD.finditer(raw)]
                gone = covered(len(spans), whole, starts).tolist()
                parts, at = [], 0
                for (_, end), g in zip(spans, gone):
                    if not g:
                        parts.append(raw[at:end])
                    at = end
                if any(gone):
                    text = b"".join(parts).decode("utf-8", "surrogatepass").strip(" \t\n\v\f\r")
            out.append(text)
        return pd.Series(out, dtype=object)

    rest = tuple(c for c in docs.columns if c not in (text_col,))
    renamed = docs.select(F.col(text_col).alias("text"), F.struct(*rest).alias("__row"), F.col("doc_id").alias("__id"))
    rows = marked(renamed, "__id", "text", ("__row",)).withColumn("__cut", cut("text", "whole", "starts"))
    return rows.select(*[F.col("__cut").alias(c) if c == text_col else F.length("__cut").cast("long").alias(c) if c == "n_chars" else F.col(f"__row.{c}") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE again
), l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""
