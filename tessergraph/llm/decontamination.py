"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are words. A window is ten consecutive words of a benchmark item, or all of a shorter item. Of each window of a text
the lowest hash of its four-word grams is kept as a fingerprint, so two texts that share a window share its fingerprint,
wherever it stands. Fingerprints of documents that the benchmark has too are extended: the windows about them are compared,
word by word, with the items' windows. The result is exact; fingerprints only say where to look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import materialize, sized, table

SPAN = 10
GRAM = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The words of a text (null: none), A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def gram_hashes(words: Column, span: int) -> Column:
    """A number for each gram, its hash above its place, for texts of ``span`` words or more; otherwise none."""
    k = min(GRAM, span)
    packed = F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.shiftleft(F.hash(*[F.get(words, i + j) for j in range(k)]).cast("long"), 32).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(words) >= span, packed).otherwise(F.array().cast("array<long>"))


def lowest(grams: Column, span: int) -> Column:
    """The lowest gram of each window of ``span`` words, the first one of equals, each once."""
    wide = span - min(GRAM, span) + 1
    least = lambda i: F.least(*[F.get(grams, i + j) for j in range(wide)]) if wide > 1 else F.get(grams, i)
    found = F.transform(F.sequence(F.lit(0), F.size(grams) - wide), least)
    return F.array_distinct(F.when(F.size(grams) >= wide, found).otherwise(F.array().cast("array<long>")))


def item_windows(items: DataFrame, item_col: str = "item_id", span: int = SPAN) -> DataFrame:
    """(item, span, window, hash, uid): every window of every item, as words joined by spaces, with its fingerprint; a written table.

    An item without words has none; one of fewer words than ``span`` has itself. A null id is the empty string.
    """
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), plain_words(F.col("text")).alias("words"))
    words = words.withColumn("span", F.least(F.size("words"), F.lit(span))).where("span > 0")
    starts = F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)
    each = words.select("item", "span", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.col("span")))).alias("part"))
    low = F.coalesce(*[F.when(F.col("span") == n, F.array_min(gram_hashes(F.col("part"), n))) for n in range(1, span + 1)])
    return materialize(each.select("item", "span", F.array_join("part", " ").alias("window"), F.shiftright(low, 32).cast("int").alias("hash"), F.monotonically_increasing_id().alias("uid")))


def marked(docs: DataFrame, known: DataFrame, spans: list[int], doc_col: str) -> DataFrame:
    """From documents to (uid, doc, n_words, span, place, start, context), a written table.

    Each document has one row of span 0, and one for each of its fingerprints in ``known`` (span, hash), with the words that
    a window with that fingerprint can reach: ``start`` is the first one's place. One pass reads, cuts and probes.
    """
    rows = docs.select(F.col(doc_col).alias("doc"), F.col("text").alias("said"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc", plain_words(F.col("said")).alias("words"))
    rows = rows.withColumns({f"grams{n}": gram_hashes(F.col("words"), n) for n in spans})
    none = F.array().cast("array<string>")

    def row(span: int, hashed: Column, place: Column, start: Column, context: Column) -> Column:
        return F.struct(F.lit(span).alias("span"), hashed.alias("hash"), place.alias("place"), start.alias("start"), context.alias("context"))

    def reach(n: int):
        def one(packed: Column) -> Column:
            place = packed.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
            start = F.greatest(F.lit(0), place - (n - min(GRAM, n)))
            return row(n, F.shiftright(packed, 32).cast("int"), place, start, F.slice("words", start + 1, place + n - start))

        return one

    marks = [F.transform(lowest(F.col(f"grams{n}"), n), reach(n)) for n in spans]
    base = F.array(row(0, F.hash("uid"), F.lit(-1), F.lit(0), none))
    each = rows.select("uid", "doc", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(base, *marks)).alias("mark")).select("uid", "doc", "n_words", "mark.*")
    probed = each.join(sized(known.withColumn("known", F.lit(True))), ["span", "hash"], "left")
    return materialize(probed.where((F.col("span") == 0) | F.col("known")).select("uid", "doc", "n_words", "span", "place", "start", "context"))


def covered(spans: Column) -> Column:
    """How many places a set of (start, end) covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    add = lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"), (s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("total")
    )
    return F.aggregate(F.sort_array(spans), start, add, lambda s: s["total"])


def overlaps(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", span: int = SPAN) -> DataFrame:
    """(doc, n_words, spans, items), one row for each row of docs.

    spans: array<struct<start, end>> of the windows that items have, by word; items: the sorted ids, as strings, of all items
    with a window in the document. Both are empty where nothing is shared. Rows of docs that repeat or share an id, or have
    none, are looked at each by itself; items that repeat count once by id. A null or empty text has no words, and an empty
    table of items leaves every document clean. No other columns are read. The items' ids are gathered once for each
    different set of windows, not for each document, and a window that many documents share meets one row.
    """
    windows = item_windows(items, item_col, span)
    known = windows.select("span", "hash").distinct()
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # as many as span at most
    seen = marked(docs, known, spans, doc_col)
    places = windows.groupBy("window").agg(F.min("uid").alias("win"))
    members = windows.join(places, "window").select("win", "item").distinct()

    last = F.least(F.col("place"), F.col("start") + F.size("context") - F.col("span"))
    about = F.transform(F.sequence("start", last), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("context", s - F.col("start") + 1, F.col("span")), " ").alias("window")))
    hits = seen.where("span > 0").where(last >= F.col("start")).select("uid", "span", F.explode(about).alias("at")).select("uid", "span", "at.*")
    met = hits.join(sized(places), "window").select("uid", F.struct("start", (F.col("start") + F.col("span")).alias("end")).alias("part"), "win")
    found = met.groupBy("uid").agg(F.sort_array(F.collect_set("part")).alias("spans"), F.sort_array(F.collect_set("win")).alias("wins"))

    sets = found.select("wins").distinct()
    lists = sets.select("wins", F.explode("wins").alias("win")).join(members, "win").groupBy("wins").agg(F.sort_array(F.collect_set("item")).alias("items"))
    dirty = found.join(lists, "wins").select("uid", "spans", "items")
    base = seen.where("span = 0").select("uid", "doc", "n_words")
    none = lambda name: F.coalesce(name, F.array().cast(dirty.schema[name].dataType)).alias(name)
    return base.join(dirty, "uid", "left").select("doc", "n_words", none("spans"), none("items"))


def query(spark, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = covered(F.col("spans"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), g AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)
), h AS (SELECT doc_id, item_id, s, g.n FROM g JOIN v ON g.n = v.n AND g.win = v.win
), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id
), m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
