"""SimHash near-duplicates by a generalised pigeonhole.

Two fingerprints within ``radius`` bits are within t_i bits on some part i of the bits, for any thresholds with
sum(t_i + 1) > radius. Correlated bits are put into one part; a dynamic programme on estimated candidate counts chooses the
thresholds (-1: the part is not probed). Each fingerprint is dealt to the keys within half the threshold of its own on each
part; fingerprints that share a key are compared on all bits. Only different fingerprints take part, so copies cost nothing,
and a large bucket gives spanning links, not all its pairs.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import MOST_LINKS, bounded_batches, drop_materialized, forest, joined, materialize, plain_id, restored, sized, table, thinned  # noqa: F401

BITS = 64
SEED = 42
RADIUS = 4
#: Fingerprints that correlations and candidate counts are estimated on; the plan's cost depends on them, not the result.
SAMPLE = 4_000
#: Costs of a dealt row and of a comparison, in microseconds.
ROW_COST, COMPARE_COST = 1.5, 0.004
#: Buckets up to this many rows are compared pair by pair; larger ones by breadth-first search.
SMALL_BUCKET = 24
#: Larger ones up to this many rows are first thinned to the nodes with a link.
DENSE_BUCKET = 16_384
#: Rows of a stripe: keys about a part's value that more nodes have are compared stripe against stripe, in tasks of their own.
STRIPE = 16_384
#: Pairs that are compared at a time, which bounds the memory of a comparison.
CELLS = 500_000
#: Bits set; numpy would count those of a negative number's absolute value.
_popcount = lambda x: np.bitwise_count(x.view(np.uint64))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.frombuffer(array("Q", [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())]), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, shingles): shingles is their number, repeats included. A null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.array([fingerprint(h) for h in hashes], np.int64), "shingles": np.array([len(h) for h in hashes], np.int64)})

    bounded_batches(docs)
    picked = docs.select(plain_id(docs[id_col]).alias("doc_id"), docs[text_col].alias("text"))
    return restored(picked.mapInPandas(run, "doc_id long, fp long, shingles long"))


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near-equal size; each takes, one after another, the free bit most correlated with those it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0)
    spread = np.sqrt((bits**2).sum(0)) + 1e-9
    tied = np.abs(bits.T @ bits) / spread[:, None] / spread[None]
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [min(free)]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: tied[b, own].mean())
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _keys(width: int, threshold: int) -> int:
    return 0 if threshold < 0 else sum(comb(width, k) for k in range((threshold + 1) // 2 + 1))


def plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """The parts' bits and thresholds of least estimated cost for n fingerprints."""
    if len(sample) < 2:
        sample = np.array([0, -1], np.int64)
    left, right = sample[: SAMPLE // 2 : 2], sample[1 : SAMPLE // 2 : 2]
    apart = left[:, None] ^ right[None]
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, radius + 2):
        groups = group_bits(sample, parts)
        most = min(radius, 4)
        costs = []
        for group in groups:
            distance = _popcount(apart & np.int64(_signed(_mask(group))))
            costs.append({-1: 0.0})
            for t in range(most + 1):
                rows = _keys(len(group), t)
                shared = max(float((distance <= t).mean()), sum(comb(len(group), k) for k in range(t + 1)) / 2 ** len(group))
                costs[-1][t] = ROW_COST * rows + COMPARE_COST * n * shared
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of t + 1 so far
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for had, (c, ts) in least.items():
                for t, more in cost.items():
                    at = min(had + t + 1, radius + 1)
                    if at not in new or c + more < new[at][0]:
                        new[at] = (c + more, ts + [t])
            least = new
        if radius + 1 in least and least[radius + 1][0] < best[0]:
            best = (least[radius + 1][0], list(zip(groups, least[radius + 1][1])))
    return [(g, t) for g, t in best[1] if t >= 0]


def deal(nodes: DataFrame, parts: list[tuple[list[int], int]], column: str = "fp", first: int = 0) -> DataFrame:
    """A row for each node and key of a fingerprint column: key, flips (bits changed), limit (the part's threshold) and the node's columns."""
    out = None
    for k, (bits, threshold) in enumerate(parts, first):
        flips = [(_signed(_mask(c)), size) for size in range((threshold + 1) // 2 + 1) for c in combinations(bits, size)]
        masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(s).alias("s")) for m, s in flips])
        one = nodes.withColumn("flip", F.explode(masks)).select(
            F.xxhash64(F.lit(k), F.col(column).bitwiseAND(F.lit(_signed(_mask(bits))).cast("long")).bitwiseXOR(F.col("flip.m"))).alias("key"),
            F.col("flip.s").alias("flips"),
            F.lit(threshold).alias("limit"),
            *nodes.columns,
        )
        out = one if out is None else out.unionAll(one)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_pairs(rows: DataFrame, left: Column, left_blocks: Column, right_blocks: Column) -> DataFrame:
    """A row for each pair (i, j) of a left and a right stripe that a node takes part in; side 0: left, 1: right, 2: both.

    Every node lies in one right stripe and those that ``left`` holds for in one left stripe too, by a hash of ``node``.
    """
    own_i = F.pmod(F.xxhash64("node", F.lit("left")), left_blocks).cast("int")
    own_j = F.pmod(F.xxhash64("node", F.lit("right")), right_blocks).cast("int")
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    as_left = F.transform(upto(right_blocks), lambda j: place(own_i, j, F.when(j == own_j, 2).otherwise(0)))
    as_right = F.transform(F.filter(upto(left_blocks), lambda i: ~(left & (i == own_i))), lambda i: place(i, own_j, F.lit(1)))
    return rows.withColumn("__at", F.explode(F.when(left, F.concat(as_left, as_right)).otherwise(as_right))).select(*rows.columns, "__at.i", "__at.j", "__at.side")


def spread_hot(dealt: DataFrame, nodes: DataFrame, parts: list[tuple[list[int], int]], column: str = "fp", first: int = 0) -> DataFrame:
    """Adds ``side`` to what deal() gave, and splits the keys about values of a part that over STRIPE nodes share.

    Nodes may have a group ``c``. Nodes of one group need not be compared, so those of a hot key's largest group are only
    right rows: a hot group costs a row for each member. Values are counted before anything is dealt out by key.
    """
    values = None
    for k, (bits, _) in enumerate(parts, first):
        own = nodes.select(F.lit(k).alias("k"), F.col(column).bitwiseAND(F.lit(_signed(_mask(bits))).cast("long")).alias("own"), (F.col("c") if "c" in nodes.columns else F.col("node")).alias("c"))
        values = own if values is None else values.unionAll(own)
    hot = materialize(values.groupBy("k", "own").count().where(F.col("count") > STRIPE).select("k", "own"))
    if hot.isEmpty():
        return dealt.withColumn("side", F.lit(2))
    hot = materialize(values.join(sized(hot), ["k", "own"]).groupBy("k", "own", "c").count())
    hot = hot.groupBy("k", "own").agg(F.sum("count").alias("n"), F.max("count").alias("largest"), F.max_by("c", "count").alias("main"))
    about = None
    for k, (bits, threshold) in enumerate(parts, first):
        flips = [_signed(_mask(c)) for size in range((threshold + 1) // 2 + 1) for c in combinations(bits, size)]
        own = hot.where(F.col("k") == k).withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])))
        own = own.select(F.xxhash64(F.lit(k), F.col("own").bitwiseXOR(F.col("m"))).alias("hot_key"), "n", "largest", "main")
        about = own if about is None else about.unionAll(own)
    size = lambda x: F.greatest(F.ceil(x / STRIPE), F.lit(1)).cast("int")
    keys = about.groupBy("hot_key").agg(F.max_by("main", "largest").alias("main"), size(F.sum("n") - F.max("largest")).alias("left_blocks"), size(F.sum("n")).alias("right_blocks"))
    flagged = dealt.join(sized(materialize(keys)), F.col("key") == F.col("hot_key"), "left")
    left = ~F.col("c").eqNullSafe(F.col("main")) if "c" in dealt.columns else F.lit(True)
    one = F.col("hot_key").isNull()  # a key that is not hot is one pair of stripes, and each row of it on both sides
    places = block_pairs(flagged, left | one, F.coalesce("left_blocks", F.lit(1)), F.coalesce("right_blocks", F.lit(1)))
    key = F.when(one, F.col("key")).otherwise(F.xxhash64("key", "i", "j"))
    return places.select(key.alias("key"), *[c for c in dealt.columns if c != "key"], "side")


def in_buckets(rows: DataFrame, compare: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]]) -> DataFrame:
    """Deals rows by key, sorts them by key and node, and gives compare() whole buckets of at least two rows, with their starts.

    A task's links are reduced to a forest, so a group that fills many buckets gives a link for each member, not for each pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, n = [], 0
        for found in compared(batches):
            links.append(found)
            n += len(found)
            if n > MOST_LINKS:
                links = [forest(pd.concat(links))]
                n = len(links[0])
        if links:
            yield forest(pd.concat(links))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if held and len(batch) and batch["key"].iat[-1] == held[-1]["key"].iat[-1]:
                held.append(batch)  # all one bucket so far
                continue
            yield from ready(pd.concat([*held, batch], ignore_index=True), held)
        if held:
            yield from ready(pd.concat(held, ignore_index=True), None)

    def ready(rows: pd.DataFrame, held: list | None) -> Iterator[pd.DataFrame]:
        key = rows["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        if held is not None:
            held.clear()
            if len(starts):
                held.append(rows.iloc[starts[-1] :])
                rows, starts = rows.iloc[: starts[-1]], starts[:-1]
        sizes = np.diff(np.append(starts, len(rows)))
        many = np.repeat(sizes > 1, sizes)
        if many.any():
            rows, sizes = rows[many].reset_index(drop=True), sizes[sizes > 1]
            yield from compare(rows, np.cumsum(sizes) - sizes)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInPandas(run, "a long, b long")


def _near(n: int, starts: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that are near in buckets of at most ``largest`` of n rows, by comparing each row with later ones."""
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(np.where(sizes <= largest, starts + sizes, 0), sizes)
    at, left, right = np.arange(n), [], []
    for lag in range(1, largest):
        at = at[at + lag < ends[at]]
        if not len(at):
            break
        found = at[near(at, at + lag)]
        left.append(found)
        right.append(found + lag)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _search(fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of a large bucket: each node found is linked to the one whose search found it."""
    if len(fp) <= DENSE_BUCKET:  # only nodes with a link take part
        rows = max(1, CELLS // len(fp))
        tied = np.concatenate([(_popcount(fp[k : k + rows, None] ^ fp[None]) <= radius).sum(1) > 1 for k in range(0, len(fp), rows)])
        fp, node = fp[tied], node[tied]
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = left[:1], left[1:]
        root = node[front[0]]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            k = 0
            while k < len(front):
                open_ = np.flatnonzero(~hit)
                if not len(open_):
                    break
                step = max(1, CELLS // len(open_))
                hit[open_] = (_popcount(fp[left[open_]][:, None] ^ fp[front[k : k + step]][None]) <= radius).any(1)
                k += step
            front, left = left[hit], left[~hit]
            out += [(root, node[i]) for i in front]
    return out


def _across(left: np.ndarray, right: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of left and right rows that are near, CELLS comparisons at a time."""
    step = max(1, CELLS // max(1, len(right)))
    for k in range(0, len(left), step):
        i, j = np.nonzero(near(left[k : k + step, None], right[None]))
        if len(i):
            yield left[k + i], right[j]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all nodes (node, fp) within radius of each other, directly or over others linked so."""
    sample = nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64)
    parts = plan(sample, nodes.count(), radius)

    def compare(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        node, fp, flips, limit = (rows[c].to_numpy() for c in ("node", "fp", "flips", "limit"))
        near = lambda i, j: (_popcount(fp[i] ^ fp[j]) <= radius) & (flips[i] + flips[j] <= limit[i])
        a, b = _near(len(rows), starts, near, SMALL_BUCKET)
        yield pd.DataFrame({"a": node[a], "b": node[b]}).query("a != b").drop_duplicates()
        sizes, side = np.diff(np.append(starts, len(rows))), rows["side"].to_numpy()
        for s, n in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
            if (side[s : s + n] == 2).all():
                yield pd.DataFrame(_search(fp[s : s + n], node[s : s + n], radius), columns=["a", "b"], dtype=np.int64)
                continue
            at = np.arange(s, s + n)
            for a, b in _across(at[side[at] != 1], at[side[at] != 0], near):
                yield pd.DataFrame({"a": node[a], "b": node[b]}).query("a != b")

    own = nodes.select("node", "fp")
    return in_buckets(spread_hot(deal(own, parts), own, parts), compare)


def near_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From (doc_id, fp) to (doc_id, fp, component): the smallest doc_id reachable over links within radius."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where(F.col("node").isNotNull()))
    found = joined(materialize(links(nodes, radius)))
    heads = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(heads, "fp", "left").select("doc_id", "fp", "component")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    A null or wordless text has fingerprint zero, which links like any other. Repeated rows give repeated rows. A null
    doc_id gets the component of its fingerprint's other documents, or null. Other columns are not read.
    """
    prints = materialize(fingerprints(docs, words).select("doc_id", "fp"))
    return near_components(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Near copies for dropping: five words, Jaccard similarity of shingle sets at least this.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Candidates have two fingerprints, of the hashes and of the hashes mixed anew. They agree within COPY_LIMIT bits on one of
#: COPY_PARTS parts of either, and differ in up to COPY_RADIUS of all 128 bits. At a similarity of 0.8 about 19 bits differ,
#: with a spread of 4, and 998 of 1,000 pairs agree so on a part; unlike pairs differ in 64 bits, with a spread of 6.
COPY_PARTS, COPY_LIMIT, COPY_RADIUS = 4, 2, 34


def _mixed(hashes: np.ndarray) -> np.ndarray:
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def double_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, fp2, shingles, digest): of the set of distinct shingles two fingerprints, the number and a hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in batch["text"]]
            rows = [(fingerprint(h), fingerprint(_mixed(h)), len(h), _signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))) for h in found]
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": columns[0], "fp2": columns[1], "shingles": columns[2], "digest": columns[3]})

    bounded_batches(docs)
    picked = docs.select(plain_id(docs["doc_id"]).alias("doc_id"), docs["text"].alias("text"))
    return restored(picked.mapInPandas(run, "doc_id long, fp long, fp2 long, shingles long, digest long"))


def _may_be_copies(one: Column, two: Column, apart: Column, similarity: float, radius: int) -> Column:
    """Whether two nodes are compared: sizes that allow the similarity, and near fingerprints."""
    fp = F.bit_count(one["fp"].bitwiseXOR(two["fp"]))
    near = (fp <= radius) | (fp + F.bit_count(one["fp2"].bitwiseXOR(two["fp2"])) <= COPY_RADIUS)
    return apart & (F.least(one["shingles"], two["shingles"]) >= similarity * F.greatest(one["shingles"], two["shingles"])) & near


def clumps(nodes: DataFrame, similarity: float = COPY_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(node, component) of nodes (node, fp, fp2, shingles) joined by near fingerprints whose sizes allow the similarity.

    Any two such nodes that may be similar are in one clump. First each node is linked to the smallest one that agrees with
    it on a part, if they are near: that joins a hot group at a row for each member and part. Then all nodes are dealt out
    by flipped parts and only those of different groups are compared, so the members of a group make no more links.
    """
    sample = nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp", "fp2").toPandas()
    parts = {}
    for column in ("fp", "fp2"):
        held = sample[column].to_numpy(np.int64)
        parts[column] = [(g, COPY_LIMIT) for g in group_bits(held if len(held) > 1 else np.array([0, -1], np.int64), COPY_PARTS)]
    about = F.struct("node", "fp", "fp2", "shingles")
    exact = None
    for column, own in parts.items():
        rows = deal(nodes.select("node", "fp", "fp2", "shingles"), [(g, -1) for g, _ in own], column, COPY_PARTS * (column == "fp2"))
        exact = rows if exact is None else exact.unionAll(rows)
    exact = exact.select("key", about.alias("one"))
    first = exact.groupBy("key").agg(F.min("one").alias("two"), F.count("*").alias("n")).where("n > 1").select("key", "two")
    near = _may_be_copies(F.col("one"), F.col("two"), F.col("one.node") != F.col("two.node"), similarity, radius)
    stars = materialize(exact.join(first, "key").where(near).select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct())
    groups = joined(stars)
    grouped = materialize(nodes.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")))
    found = []
    for column, own in parts.items():  # one after the other: each deals many rows
        found.append(materialize(_near_in_buckets(grouped, column, own, similarity, radius)))
    over = joined(found[0].unionAll(found[1])).select(F.col("node").alias("c"), F.col("component").alias("over"))
    out = grouped.join(over, "c", "left").where("component IS NOT NULL OR over IS NOT NULL")
    out = materialize(out.select("node", F.coalesce("over", "c").alias("component")))
    for df in (stars, grouped, *found):
        drop_materialized(df)
    return out


def _near_in_buckets(nodes: DataFrame, column: str, parts: list[tuple[list[int], int]], similarity: float, radius: int) -> DataFrame:
    """Links of the groups ``c`` of near nodes which agree on a part of one fingerprint column, but for the flipped bits."""
    dealt = None
    for k, part in enumerate(parts):
        # One number for the shingles, the part and the flipped bits keeps the many rows short.
        number = (F.col("shingles") * 64 + k * 8 + F.col("flips")).alias("about")
        own = deal(nodes.select("node", "c", "fp", "fp2", "shingles"), [part], column, k).select("key", "node", "c", "fp", "fp2", number)
        dealt = own if dealt is None else dealt.unionAll(own)
    mask = np.array([_signed(_mask(g)) for g, _ in parts], np.int64)

    def compare(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        c, one, two, about, side = (rows[x].to_numpy() for x in ("c", "fp", "fp2", "about", "side"))
        size, flips = about >> 6, about & 7
        own = (one if column == "fp" else two) & mask[about >> 3 & 7]

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fit = (c[i] != c[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
            apart = _popcount(one[i] ^ one[j])
            close = (apart <= radius) | (apart + _popcount(two[i] ^ two[j]) <= COPY_RADIUS)
            return fit & close & (_popcount(own[i] ^ own[j]) == flips[i] + flips[j])

        a, b = _near(len(rows), starts, near, SMALL_BUCKET)
        yield pd.DataFrame({"a": c[a], "b": c[b]}).drop_duplicates()
        sizes = np.diff(np.append(starts, len(rows)))
        for s, n in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
            at = np.arange(s, s + n)
            names, groups, counts = np.unique(c[at], return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            left, right = at[side[at] != 1], at[side[at] != 0]
            if len(left) == len(right) == n:  # a whole bucket: no need to begin at the rows of its largest group
                left = at[groups != counts.argmax()]
            for a, b in _across(left, right, near):
                yield pd.DataFrame({"a": c[a], "b": c[b]}).drop_duplicates()

    return in_buckets(spread_hot(dealt, nodes, parts, column), compare)


#: Shingles of a stripe of a clump; a clump of more is compared stripe against stripe.
STRIPE_SHINGLES = 500_000


def member_sets(docs: DataFrame, clumped: DataFrame, words: int) -> DataFrame:
    """(node, component, s): the distinct shingles, as sorted 64-bit hashes, of the documents that clumped names with their digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch["text"]]
            own = np.array([_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], np.int64) == batch["digest"].to_numpy()
            yield pd.DataFrame({"node": batch["node"][own], "component": batch["component"][own], "s": [s.view(np.int64) for s, k in zip(sets, own) if k]})

    bounded_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(sized(clumped.select("node", "component", "digest")), "node").select("node", "component", "digest", "text").mapInPandas(run, "node long, component long, s array<long>")


def similar_links(docs: DataFrame, clumped: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all members of a clump (node, component, shingles, digest) whose shingle sets are similar.

    Sets of 64-bit hashes are compared exactly. Each member is first compared with the one that names its clump. The rest of
    a clump, those not alike with it, is then compared with all members; so a group of copies costs a row for each of them.
    """
    members = materialize(member_sets(docs, clumped, words))
    pivots = materialize(members.where("node = component").dropDuplicates(["component"]).select("component", F.col("s").alias("p")))
    common = F.size(F.array_intersect("s", "p"))
    alike = common >= F.lit(similarity) * (F.size("s") + F.size("p") - common)
    stars = members.where("node <> component").join(pivots, "component").where(alike).select(F.col("node").alias("a"), F.col("component").alias("b"))
    stars = materialize(stars.distinct())
    placed = clumped.join(stars.select(F.col("a").alias("node"), F.lit(True).alias("star")), "node", "left")
    placed = materialize(placed.withColumn("g", F.when(F.col("star"), F.col("component")).otherwise(F.col("node"))).select("node", "component", "g", "shingles"))
    left = F.col("g") != F.col("component")
    blocks = lambda x: F.ceil((F.sum(x) + 1) / STRIPE_SHINGLES).cast("int")
    sizes = placed.groupBy("component").agg(
        F.max(left).alias("some"), blocks(F.when(left, F.col("shingles")).otherwise(0)).alias("left_blocks"), blocks(F.col("shingles")).alias("right_blocks")
    )
    rest = placed.join(sizes.where("some").drop("some"), "component")
    keyed = block_pairs(rest, left, F.col("left_blocks"), F.col("right_blocks")).select("node", "g", "side", F.xxhash64("component", "i", "j").alias("key"))

    def compare(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        g, side, sets = rows["g"].to_numpy(), rows["side"].to_numpy(), rows["s"].tolist()
        for s, n in zip(starts.tolist(), np.diff(np.append(starts, len(rows))).tolist()):
            found = _similar(g[s : s + n], side[s : s + n], sets[s : s + n], similarity)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    links = materialize(in_buckets(keyed.join(members.select("node", "s"), "node"), compare))
    for df in (members, pivots, placed):
        drop_materialized(df)
    return links.unionAll(stars)


def _similar(group: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the groups of similar sets, a left one (side 0 or 2) and a right one (side 1 or 2).

    With the shingles of every set in one order, the rarest first, two similar sets share one of the first
    n - ceil(similarity * n) + 1 shingles of each, so only sets that do are compared, and only those of groups not joined yet.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = rank[which]
    ranks = ranks[np.lexsort((ranks, owner))]
    first = np.maximum(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
    early = np.flatnonzero((np.arange(len(owner)) - np.repeat(ends - sizes, sizes) < first[owner]) & (side[owner] != 0))
    early = early[np.argsort(ranks[early], kind="stable")]
    keys, holder = ranks[early], owner[early]
    label = np.unique(group, return_inverse=True)[1]
    mine, out = np.zeros(len(counts), bool), []
    for at in np.flatnonzero((side != 1) & (sizes > 0)).tolist():
        own = ranks[ends[at] - sizes[at] : ends[at]]
        low, high = np.searchsorted(keys, own[: first[at]], "left"), np.searchsorted(keys, own[: first[at]], "right")
        like = np.unique(holder[_ranges(low, high - low)])
        like = like[(label[like] != label[at]) & (np.minimum(sizes[like], sizes[at]) >= similarity * np.maximum(sizes[like], sizes[at]))]
        mine[own] = True
        while len(like):  # a part of them at a time
            part = like[: max(1, int(np.searchsorted(np.cumsum(sizes[like]), CELLS)))]
            like = like[len(part) :]
            common = np.add.reduceat(mine[ranks[_ranges(ends[part] - sizes[part], sizes[part])]].astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            part = part[common >= similarity * (sizes[part] + sizes[at] - common)]
            if len(part):
                met, one = np.unique(label[part], return_index=True)
                out += [(group[at], group[x]) for x in part[one].tolist()]
                label[np.isin(label, met)] = label[at]
                like = like[label[like] != label[at]]
        mine[own] = False
    return out


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each range, n of them, one range after the other."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def drop_near_copies(docs: DataFrame, words: int = COPY_WORDS, radius: int = RADIUS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id, with the columns of docs.

    Documents of equal shingle sets are one node; nodes are linked where their sets are at least ``similarity`` alike.
    Fingerprints, those within ``radius`` among them, only say which nodes are compared. Rows of one doc_id count as one
    document. A null doc_id stays.
    """
    prints = materialize(double_fingerprints(docs, words))
    columns = ("fp", "fp2", "shingles", "digest")
    own = prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("own"), F.count("*").alias("times"))
    own = materialize(own.select("doc_id", "own.*", "times"))
    nodes = materialize(own.groupBy(*columns).agg(F.min("doc_id").alias("node")))
    clumped = clumps(nodes.drop("digest"), similarity, radius)
    wanted = materialize(clumped.join(nodes.select("node", "shingles", "digest"), "node"))
    linked = joined(similar_links(docs, wanted, words, similarity))
    copies = own.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
    gone = materialize(copies.union(linked.where("node <> component").select("node")).distinct())
    again = materialize(own.where("times > 1").select("doc_id"))
    for df in (prints, own, nodes, clumped, wanted):
        drop_materialized(df)
    kept = docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
