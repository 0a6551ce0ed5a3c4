"""Links of planted near pairs among thousands of vectors, through cells and tiles, against all pairs."""

import numpy as np
import pytest

from casewright.llm import embeddings


def planted(n, size, seed, low=0.93, high=0.94):
    """``n`` random unit vectors and as many partners at a cosine just above the threshold."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((n, size)))
    aside = rng.standard_normal((n, size))
    aside = unit(aside - (aside * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(low, high, (n, 1))
    return np.vstack([base, base * cosine + aside * np.sqrt(1 - cosine**2)])


def judged(spark, vectors, labels):
    frame = spark.createDataFrame([(k, v.tolist(), int(x)) for k, (v, x) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    return {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}


def links_of(vectors, labels, threshold=0.93):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros(len(unit), int)
    for at in range(0, len(unit), 1000):
        near = (unit[at : at + 1000] @ unit.T >= threshold) & (labels[at : at + 1000, None] == labels[None, :])
        out[at : at + 1000] = near.sum(axis=1) - 1
    return out


def test_recall_at_the_threshold(spark):
    """12,000 planted vectors in one label: cells of three signs."""
    vectors = planted(6000, 64, 1)
    labels = np.zeros(len(vectors), int)
    want, got = links_of(vectors, labels), judged(spark, vectors, labels)
    found = sum(min(got[k].n_links, w) for k, w in enumerate(want))
    assert all(got[k].n_links <= w for k, w in enumerate(want))
    assert found / want.sum() >= 0.999


@pytest.mark.parametrize(("cell", "tile"), [(2048, 2048), (64, 16), (1 << 20, 32)])
def test_cells_and_tiles_are_exact_on_clear_pairs(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(3)
    vectors = planted(150, 32, 2, 0.97, 0.99)
    dense = vectors[:1] + rng.standard_normal((120, 32)) * 0.02
    vectors = np.vstack([vectors, dense, vectors[:40], vectors[:3] * 7])
    labels = rng.integers(0, 2, len(vectors))
    labels[300:420] = labels[0]
    want, got = links_of(vectors, labels), judged(spark, vectors, labels)
    assert {k: r.n_links for k, r in got.items()} == dict(enumerate(want.tolist()))
    assert {r.component_id for k, r in got.items() if 300 <= k < 420} == {0}


def test_different_vectors_under_one_id_are_apart(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (5, [0.01, 1.0], 0), (6, [1.0, 0.0, 0.0], 0), (7, [1.0, 0.0, 0.01], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (5, 1, 1), (6, 1, 6), (7, 1, 6)]


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1e-200, -1e-200], 0)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
