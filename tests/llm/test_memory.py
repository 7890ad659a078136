"""What Python workers hold on executors: bounded by rows and chunks, and no workers that nothing needs."""

import random
import tracemalloc

import numpy as np
import pandas as pd

from tessergraph.llm import packing, substrings

from .helpers import prose


def test_dealt_anchors_take_little_memory():
    draw = random.Random(5)
    text = prose(draw, 4000)
    frames = (pd.DataFrame({"k": range(i, i + 20), "t": 0, "text": [text] * 20}) for i in range(0, 400, 20))  # half a million anchors
    list(map(substrings.combined, substrings._merged(substrings._deal_anchors(iter([pd.DataFrame({"k": [0], "t": 0, "text": [text]})])))))
    tracemalloc.start()
    try:
        rows = sum(len(f) for f in map(substrings.combined, substrings._merged(substrings._deal_anchors(frames))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    at = (np.arange(0, 4000, substrings.PERIOD)[:, None] + substrings.COVER).ravel()
    assert rows == 400 * (at + substrings.ANCHOR <= 4000).sum()
    assert peak < 24e6


def test_powers_of_a_long_text_are_not_kept(monkeypatch):
    monkeypatch.setattr(substrings, "_powers", {})
    text = "a b c d " * 400_000
    sums = [substrings.word_sums(substrings._bytes(text), seed) for seed in (0, 1, 2)]
    base, inverse = substrings._constants(0)[1:]
    for n in (len(sums[0]), 10):  # as long as the text, and short again
        assert substrings._power(base, n)[3] == pow(base, 3, 1 << 64) and len(substrings._power(base, n)) == n + 1
        assert int(substrings._power(inverse, n)[-1]) == pow(inverse, n, 1 << 64)
    assert sum(x.nbytes for x in substrings._powers.values()) <= 7e6


def test_hashes_are_the_same_in_chunks(monkeypatch):
    draw = random.Random(6)
    texts = [prose(draw, 900), "x" * 500 + " y z " * 60, "é" * 300 + " " + prose(draw, 40)]
    whole = list(substrings.anchors(texts))
    monkeypatch.setattr(substrings, "CHUNK", 64)
    monkeypatch.setattr(substrings, "_powers", {})
    for one, two in zip(whole, substrings.anchors(texts)):
        assert all((a == b).all() for a, b in zip(one, two))


def test_places_of_sequences_need_no_python_worker(spark):
    pieces = spark.sql("SELECT id AS doc_id, 0 AS piece, 0L AS start, 1 + id % 700 AS length, id AS ids_crc32 FROM range(3000)")
    for rows in (pieces, pieces.limit(0)):
        packed = packing.pack(rows)
        plan = packed._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "ExternalRDD" not in plan
        assert packed.count() == rows.count() == packed.where("sequence_id >= 0 AND offset + length <= 1024").count()
