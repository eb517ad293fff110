"""Embedding links near the threshold, over many cells, against brute force."""

import numpy as np
import pytest

from lithoframe.llm import embedding_dedup


def pairs_near(rng, n, dim, cosine):
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y])


@pytest.mark.parametrize("block", [1024, 16])
def test_all_links_near_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 256)  # most vectors have no part in the centroids, as in a large table
    v = pairs_near(np.random.default_rng(7), 1000, 64, 0.901)
    links = ((v @ v.T) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.link(df, cell_rows=10).collect()}
    assert links.sum() >= 2000
    assert [got[i].n_links for i in range(len(v))] == links.tolist()
    assert [got[i + 1000].component_id for i in range(1000)] == list(range(1000))


def test_cells_within_the_angle_cover_links_of_thousands_of_cells():
    rng = np.random.default_rng(8)
    v = pairs_near(rng, 500, 64, 0.9001)
    c = rng.normal(size=(4096, 64))
    home, near = embedding_dedup.near_cells(v, c / np.linalg.norm(c, axis=1, keepdims=True), 0.9)
    a, b = np.arange(500), np.arange(500, 1000)
    assert near[a, home[b]].all() and near[b, home[a]].all() and near[a, home[a]].all()


def test_vectors_are_dealt_once_not_to_every_cell(spark, monkeypatch):
    """What is written grows with the vectors, not with the cells that each may link with."""
    written = {}
    keep = embedding_dedup.staged

    def staged(df, label, *rest):
        out = keep(df, label, *rest)
        written[label] = written.get(label, 0) + (out.count() if label != "emb-blocks" else sum(len(r.rep) // 8 for r in out.collect()))
        return out

    monkeypatch.setattr(embedding_dedup, "staged", staged)
    v = pairs_near(np.random.default_rng(9), 400, 16, 0.95)
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = embedding_dedup.link(df, cell_rows=20)
    assert found.count() == len(v)
    assert written["emb-blocks"] == len(v) and max(written.values()) <= 2 * len(v) and "emb-cells" not in written
    x = np.asarray(v, dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [r.n_links for r in found.orderBy("vec_id").collect()] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
