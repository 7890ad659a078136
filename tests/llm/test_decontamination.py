"""Shared windows against a brute-force search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessergraph.llm import decontamination
from tests.llm.helpers import awkward_docs, none_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    """Lists of (n_words, hit places, item ids), one for each text."""
    wanted = {}
    for item, text in items:
        w = plain(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        w, hit, found = plain(text), set(), set()
        for n in {len(k) for k in wanted}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wanted:
                    hit.update(range(s, s + n))
                    found |= wanted[tuple(w[s : s + n])]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def rows_of(df):
    return sorted((r.n_words, sorted({p for s in r.spans for p in range(s.start, s.end)}), r["items"]) for r in df.collect())


def test_words():
    assert plain("Don't STOP, naïve Ünit_3\x00x—y") == ["don", "t", "stop", "naïve", "Ünit", "3", "x—y"]


def test_against_brute_force(spark):
    """Few different words, so that windows repeat, overlap and nearly match; items from one word up."""
    draw = random.Random(5)
    said = lambda n, words="abcd": " ".join(draw.choice(words) for _ in range(n))
    items = [(i, said(draw.randint(0, 25))) for i in range(30) if i != 4] + [(4, "solo"), (40, "two words"), (41, "Two; WORDS"), (None, said(12)), (42, None), (7, said(11)), (43, "é ü é ü é ü é ü é ü é")]
    docs = [said(draw.randint(0, 60)) for _ in range(60)] + [said(20, "wxyz") for _ in range(20)] + ["a solo act", "TWO-words", None, "", "?!", "é ü é ü é ü é ü é ü", items[3][1]]
    docs += [f"{said(5, 'pq')} {text} {said(5, 'pq')}" for _, text in items if text] + docs[:3]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontamination.overlaps(table, held)) == sorted(brute(docs, items))


def test_long_spans_are_all_found(spark):
    """Every shared span of ten words is hit and none of nine, in long texts of many words."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choices(words, k=40))) for i in range(50)]
    docs = []
    for _, text in items:
        w = text.split()
        for n in (9, 10, 11, 23):
            s = draw.randint(0, 40 - n)
            docs.append(" ".join([*draw.choices(words, k=200), *w[s : s + n], *draw.choices(words, k=200)]))
    docs.append(" ".join(draw.choices(words, k=60_000)) + " " + items[9][1])
    table, held = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(bool(f) for _, _, f in want) >= 151
    assert rows_of(decontamination.overlaps(table, held)) == sorted(want)


def test_awkward_rows_and_many_keys(spark, monkeypatch):
    """Nulls, repeats, clashing names and empty tables; and the same result where nothing is small enough to broadcast."""
    docs = awkward_docs(spark).withColumns({c: F.lit("x") for c in ("uid", "window", "win", "spans", "items")})
    held = [r.text for r in docs.collect()]
    items = spark.createDataFrame([(1, held[3], "x"), (2, held[0], "x"), (2, held[0], "x"), (3, "", "x")], "item_id long, text string, words string")
    want = sorted(brute(held, [(r.item_id, r.text) for r in items.collect()]))
    assert rows_of(decontamination.overlaps(docs, items)) == want and sum(bool(f) for *_, f in want) >= 4
    clean = decontamination.overlaps(docs, none_of(items)).collect()
    assert len(clean) == len(held) and not any(r.spans or r["items"] for r in clean)
    assert decontamination.overlaps(none_of(docs), items).count() == 0
    monkeypatch.setattr(decontamination, "sized", lambda keys: keys)
    assert rows_of(decontamination.overlaps(docs, items)) == want


def test_query(spark, small):
    rows = decontamination.query(spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = dict(zip(docs, brute(docs.values(), items)))
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
