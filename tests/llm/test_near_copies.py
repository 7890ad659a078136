import random

import numpy as np

from tessergraph.llm import simhash
from tests.llm.helpers import prose
from tests.llm.test_pipeline import shingles
from tests.llm.test_text_operators import brute_components


def kept_and_wanted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = [(a, b) for b in range(len(sets)) for a in range(b) if alike(a, b)]
    heads = brute_components(links, range(len(sets)))
    return sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()), sorted(set(heads.values()))


def changed(draw, text, n):
    w = text.split()
    for at in draw.sample(range(len(w)), n):
        w[at] = f"n{draw.getrandbits(40)}"
    return " ".join(w)


def test_fingerprints_alone_drop_nothing(spark):
    """A family of one template, pairwise under 0.8: some are within four bits of each other, none is a copy."""
    draw = random.Random(5)
    base = prose(draw, 300)
    got, want = kept_and_wanted(spark, [changed(draw, base, 5) for _ in range(400)])
    assert got == want and len(want) > 300


def test_links_of_every_distinct_text(spark):
    """Chains of drifting copies: members far from the first one have links of their own."""
    draw = random.Random(6)
    texts = []
    for _ in range(12):
        text = prose(draw, 400)
        for _ in range(12):
            texts.append(text)
            text = changed(draw, text, 6)
    draw.shuffle(texts)
    got, want = kept_and_wanted(spark, texts)
    assert got == want and len(want) == 12


def test_sizes_are_of_distinct_shingles(spark):
    draw = random.Random(7)
    texts = []
    for _ in range(6):
        base = prose(draw, 1000)
        w = base.split()
        texts += [base, " ".join([*w, *prose(draw, 150).split(), *w[200:300]])]
    got, want = kept_and_wanted(spark, texts)
    assert got == want == list(range(0, 12, 2))
    text = prose(draw, 200)
    got, want = kept_and_wanted(spark, [text, f"{text} {text}"])
    assert got == want == [0]


def test_similar_sets_in_one_clump():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 60, 40)).astype(np.int64) for _ in range(150)] + [np.empty(0, np.int64)]
    for limit in (0.5, 0.6, 0.8):
        links = [(a, b) for b in range(150) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= limit * len(np.union1d(sets[a], sets[b]))]
        found = simhash._similar(np.arange(151), np.full(151, 2), sets, limit)
        assert brute_components(found, range(151)) == brute_components(links, range(151))
        side = np.where(np.arange(151) < 70, 0, 1)
        between = [p for p in links if p[0] < 70 <= p[1]]
        found = simhash._similar(np.arange(151), side, sets, limit)
        assert brute_components(found, range(151)) == brute_components(between, range(151))


def test_hot_clump_in_stripes(spark, monkeypatch):
    """One clump of two families and loose members, in many stripes, all about keys that most rows share."""
    draw = random.Random(10)
    one = prose(draw, 200)
    two = changed(draw, one, 12)
    texts = [changed(draw, one, 1) for _ in range(120)] + [changed(draw, two, 1) for _ in range(60)] + [changed(draw, one, 9) for _ in range(60)]
    texts += [one, one, prose(draw, 20_000)]
    draw.shuffle(texts)
    whole = kept_and_wanted(spark, texts)
    monkeypatch.setattr(simhash, "STRIPE", 20)
    monkeypatch.setattr(simhash, "STRIPE_SHINGLES", 4_000)
    monkeypatch.setattr(simhash, "CELLS", 500)
    assert kept_and_wanted(spark, texts) == whole
    assert whole[0] == whole[1] and len(whole[0]) > 20


def test_recall_near_the_limit(spark):
    """Pairs of similarity 0.80 to 0.85, with a repeated passage in half of them."""
    draw = random.Random(11)
    texts = []
    for k in range(150):
        base = prose(draw, 300)
        w = changed(draw, base, 6).split()
        texts += [base, " ".join([*w, *w[40:90]] if k % 2 else w)]
    got, want = kept_and_wanted(spark, texts)
    missed = len(got) - len(want)
    assert set(want) <= set(got) and missed <= 0.02 * 150


def test_thinned_links_join_the_same_nodes(spark):
    draw = random.Random(9)
    links = [(draw.randint(0, 500), draw.randint(0, 500)) for _ in range(300)] + [(1000 + draw.randint(0, 30), 1000 + draw.randint(0, 30)) for _ in range(3000)]
    found = [tuple(r) for r in simhash.thinned(spark.createDataFrame(links, "a long, b long").repartition(20)).collect()]
    nodes = {x for p in links for x in p}
    assert brute_components(found, nodes) == brute_components(links, nodes) and len(found) < len(nodes)
