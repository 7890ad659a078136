"""Phrases against plain counting in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessergraph.llm import phrases
from tests.llm.helpers import awkward_docs, none_of


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top=2000):
    """{lang: [(rank, phrase, a, l, r, n, score), ...]} of rows (text, lang)."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = {q for p, a in held.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * counts[q := p[i : i + m]]}
        rows = []
        for p, a in held.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        if rows:
            out[lang] = [(i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return out


def result(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.lang].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed, n=300):
    draw = random.Random(seed)
    say = lambda k: " ".join(draw.choice(["a", "b", "c", "D", "ñu", "e.", "f,", "new york", "to be or not to be", "x\ty", "one word", "İ", "\x1cz"]) for _ in range(k))
    return [(say(draw.randint(0, 40)), draw.choice(["en", "de", None, ""])) for _ in range(n)] + [(None, "en"), ("", "fr"), ("only. these. once!", "fr"), ("to be or not to be " * 900, "en")]


@pytest.mark.parametrize("least", [5, 40])
def test_against_brute_force(spark, least):
    rows = corpus(3)
    table = spark.createDataFrame([(t, x, "p") for t, x in rows], "text string, lang string, phrase string").repartition(5)
    assert result(phrases.collocations(table, least=least)) == brute(rows, least)


def test_small_blocks_buckets_and_ranks(spark, monkeypatch):
    """The same result when tasks hand on after every block, buckets are shared by many phrases, and ranks are cut."""
    rows = corpus(4)
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, 8, 7)
    for name, value in {"BLOCK": 300, "MOST_COUNTS": 20, "MOST_SLOTS": 50, "SALTS": 3}.items():
        monkeypatch.setattr(phrases, name, value)
    assert result(phrases.collocations(table, least=8, top=7)) == want
    monkeypatch.setattr(phrases, "BUCKET_BITS", 17)
    assert result(phrases.collocations(table, least=8, top=7)) == want


def test_bitmaps_hold_no_frequent_phrase_back(spark):
    rows = [(t,) for t, _ in corpus(6)]
    table = spark.createDataFrame(rows, "text string").withColumn("lang", F.lit("en"))
    found, totals = phrases.frequent_phrases(table, least=30)
    counts, n = Counter(), 0
    for (text,) in rows:
        for w in pieces(text):
            n += len(w)
            counts.update(" ".join(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    assert {r.phrase: r.f for r in found.collect()} == {p: f for p, f in counts.items() if f >= 30}
    assert [r.n for r in totals.collect()] == [n]


def test_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, and cuts that tie after flooring."""
    big = 9 * 10**12
    rows = [("x", 2, "a b", big), ("x", 1, "a", big + 7), ("x", 1, "b", big + 11), ("x", 3, "a b c", 100), ("x", 2, "b c", 101), ("x", 1, "c", 10**6 + 3)]
    table = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    total = 10**14 + 1
    got = {r.phrase: (r.score, r.l, r.r) for r in phrases.scored(table, spark.createDataFrame([("x", total)], "lang string, n long")).collect()}
    f = {p: n for _, _, p, n in rows}
    assert got["a b"] == (1000 * big * total // (f["a"] * f["b"]), f["a"], f["b"])
    assert got["a b c"] == min([(1000 * 100 * total // (f["a"] * f["b c"]), f["a"], f["b c"]), (1000 * 100 * total // (f["a b"] * f["c"]), f["a b"], f["c"])])


def test_awkward_rows(spark):
    docs = awkward_docs(spark).withColumn("n", F.lit(1))
    want = brute([(r.text, r.lang) for r in docs.collect()], 20)
    assert result(phrases.collocations(docs, least=20)) == want and want
    assert phrases.collocations(none_of(docs)).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
