import numpy as np
import pytest

from tessergraph.llm import embeddings
from tests.llm.test_text_operators import brute_components


@pytest.mark.parametrize("spectrum, far", [(1.0, 0.32), (0.7, 0.32), (0.0, 0.32)])
def test_default_margin_finds_all_links(spark, monkeypatch, spectrum, far):
    """Steps with the vectors' own spread, in many cells: counts from both sides and components equal brute force."""
    draw = np.random.default_rng(3)
    monkeypatch.setattr(embeddings, "PER_CELL", 60)
    spread = np.arange(1, 9.0) ** -spectrum
    base = draw.normal(size=(700, 8)) * spread
    step = draw.normal(size=(700, 8)) * spread
    step -= base * ((step * base).sum(1) / (base * base).sum(1))[:, None]
    step *= (np.linalg.norm(base, axis=1) / np.linalg.norm(step, axis=1) * draw.uniform(0.1, far, 700))[:, None]
    vectors = np.vstack([base, base + step, base[:40]]).astype(np.float32)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tied = unit @ unit.T >= 0.95
    np.fill_diagonal(tied, False)
    want = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(tied))], range(len(vectors)))
    assert [got[i].n_links for i in range(len(vectors))] == tied.sum(1).tolist()
    assert [got[i].component_id for i in range(len(vectors))] == [want[i] for i in range(len(vectors))]


@pytest.mark.parametrize("size, per_cell", [(3, 60), (8, 6), (64, 40)])
def test_steps_across_boundaries(spark, monkeypatch, size, per_cell):
    """Vectors near the middle between two others, stepped to either side of it, and a second vector length with cells of its own."""
    draw = np.random.default_rng(size)
    monkeypatch.setattr(embeddings, "PER_CELL", per_cell)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(draw.normal(size=(500, size)))
    toward = unit(base[draw.permutation(500)] - base * 0.5)
    steps = draw.choice([0.05, 0.15, 0.31], 500)[:, None]
    vectors = np.vstack([base, unit(base + steps * toward), unit(base - steps * toward)]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(10_000 + i, [float(x) for x in v] + [0.0]) for i, v in enumerate(vectors[:700])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    for first, own in ((0, vectors), (10_000, vectors[:700])):
        own = unit(own.astype(np.float64))
        tied = own @ own.T >= 0.95
        np.fill_diagonal(tied, False)
        want = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(tied))], range(len(own)))
        assert [got[first + i].n_links for i in range(len(own))] == tied.sum(1).tolist()
        assert [got[first + i].component_id for i in range(len(own))] == [first + want[i] for i in range(len(own))]
