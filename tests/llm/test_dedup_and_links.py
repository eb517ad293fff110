"""Exact dedup, n-gram join and embedding dedup against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from lithoframe.llm import embedding_dedup, exact_dedup, ngram_join
from lithoframe.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id int, h string, rep string"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in enumerate(texts)], schema)


def classes(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_exact(spark):
    texts = ["a b", None, "", "A b", "a b", "a  b", "a b", "long " * 50_000, "long " * 50_000]
    got = {r.doc_id: r for r in exact_dedup.duplicate_groups(table(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_duplicates(table(spark, texts))
    assert kept.columns == table(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(x) for x in groups.values())


def test_exact_empty_and_repeated_rows(spark):
    assert exact_dedup.duplicate_groups(table(spark, []).limit(0)).count() == 0
    twice = table(spark, ["x y", "x y"]).union(table(spark, ["x y", "x y"]))
    rows = exact_dedup.duplicate_groups(twice).collect()
    assert len(rows) == 4 and {r.group_size for r in rows} == {4} and [r.kept for r in rows].count(True) == 2


def brute_shingles(text, words=5):
    w = [x for x in (text or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_join(texts, threshold=0.8):
    sets = [brute_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
    n = [0] * len(texts)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return classes(len(texts), links), n


def near_copies(rng, count, length=60, edits=2):
    base = [f"w{x}" for x in rng.integers(0, 500, length)]
    out = []
    for _ in range(count):
        w = list(base)
        for p in rng.integers(0, length, edits):
            w[p] = f"e{rng.integers(0, 10_000)}"
        out.append(" ".join(w))
    return out


def test_ngram_join_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = near_copies(rng, 40, 80, 1) + near_copies(rng, 12, 200, 3) + near_copies(rng, 4, 12, 1)
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 900, 70)) for _ in range(30)]
    texts += [None, "", " \t\n", "one two", "ONE\ttwo ", "one two three", "a b c d e", "a b c d e", texts[3], texts[3].upper()]
    component, links = brute_join(texts)
    got = {r.doc_id: r for r in ngram_join.link(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == component
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_ngram_join_cuts_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = near_copies(np.random.default_rng(2), 60, 90, 1)
    component, links = brute_join(texts)
    got = {r.doc_id: r for r in ngram_join.link(table(spark, texts)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == component


def test_ngram_join_table(spark, data):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    assert [i for i, _ in rows] == list(range(len(rows)))
    component, links = brute_join([t for _, t in rows])
    got = {r.doc_id: r for r in ngram_join.link(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert [got[i].n_links for i, _ in rows] == links
    assert [got[i].class_id for i, _ in rows] == component


def test_ngram_join_edges(spark):
    assert ngram_join.link(table(spark, []).limit(0)).count() == 0
    twice = table(spark, ["a b c d e f"]).union(table(spark, ["a b c d e f"]))
    assert [(r.doc_id, r.n_links) for r in ngram_join.link(twice).collect()] == [(0, 1), (0, 1)]
    kept = ngram_join.drop_near_duplicates(table(spark, ["p q r s t u", "P q r s t u", "", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and "keep_id" in kept.columns


def test_prefixes_shorten_until_recall():
    near, far = np.zeros(ngram_join.BINS), np.zeros(ngram_join.BINS)
    near[-4:], far[0] = 100, 100  # similarities of 0.98 and more; of 0.8
    assert ngram_join.next_depth(near, 0.8, 20, 6, 0.9999) is None
    assert ngram_join.next_depth(far, 0.8, 20, 6, 0.9999) == 4 and ngram_join.next_depth(far, 0.8, 20, 4, 0.9999) is None
    assert ngram_join.next_depth(far, 0.8, 20, 6, 0.999) == 5 and ngram_join.next_depth(near + far / 100, 0.8, 20, 6, 0.9999) == 4
    assert ngram_join.next_depth(np.zeros(ngram_join.BINS), 0.8, 20, 6, 0.9999) is None and ngram_join.next_depth(far, 0.8, 1, 6, 1.0) == 1


def test_labels_are_prefixes():
    labels = ngram_join.labels_of([np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.arange(10, 90, dtype=np.uint64)], 20, 6).reshape(3, 20, 2)
    for depth in range(1, 7):
        same = [bool(ngram_join._shared(labels[:1, t], labels[2:, t], depth)[0, 0]) for t in range(20)]
        assert ngram_join._shared(labels[:1, 0], labels[1:2, 0], depth).all()
        assert depth == 1 or all(b or not a for a, b in zip(same, before, strict=True))  # noqa: F821
        before = same


@pytest.mark.parametrize("start", [6, 2])
def test_ngram_join_levels_agree(spark, monkeypatch, start):
    monkeypatch.setattr(ngram_join, "DEPTH", start)
    rng = np.random.default_rng(7)
    texts = [t for n in (60, 25, 18) for _ in range(4) for t in near_copies(rng, 6, n, 1)]
    component, links = brute_join(texts)
    got = {r.doc_id: r for r in ngram_join.link(table(spark, texts)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links and [got[i].class_id for i in range(len(texts))] == component


def test_ngram_join_ids_null_or_with_two_texts(spark):
    t1, t2 = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, t1), (1, t2), (2, t1 + " x"), (3, t2 + " y"), (None, t1 + " z"), (None, "alone here it stands still"), (7, t1), (None, None)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_links, r.class_id or 0, r.kept) for r in got) == sorted([(1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (0, 3, 1, False), (0, 0, 0, True), (7, 3, 1, False), (0, 0, 0, True)])


def brute_vectors(v, threshold=0.9):
    ok = [x is not None and len(x) > 0 and all(y is not None and np.isfinite(y) for y in x) and any(x) for x in v]
    links = []
    for i in range(len(v)):
        for j in range(i + 1, len(v)):
            if ok[i] and ok[j] and len(v[i]) == len(v[j]):
                a, b = np.asarray(v[i], float), np.asarray(v[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links.append((i, j))
    n = [0] * len(v)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return classes(len(v), links), n


def vectors(rng, n=120, dim=16):
    centre = rng.normal(size=(6, dim))
    v = [list(map(float, centre[i % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 1.0]))) for i in range(n)]
    return v + [v[0], v[0], [2 * x for x in v[1]], None, [], [0.0] * dim, [None] + v[2][1:], [float("nan")] + v[2][1:], [float("inf")] + v[2][1:], [1.0, 0.0], [1.0, 0.1], [-0.0, 1.0], [0.0, 1.0]]


def test_embeddings_one_cell(spark):
    v = vectors(np.random.default_rng(3))
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, rep int")
    component, links = brute_vectors(v)
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert [got[i].n_links for i in range(len(v))] == links
    assert [got[i].component_id for i in range(len(v))] == component
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_embeddings_ids_null_or_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (None, [1.0, 0.2]), (None, [-1.0, 0.0]), (None, None)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in got) == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (0, 2, 1, False), (0, 0, 0, True), (0, 0, 0, True)])


def test_embeddings_small_tables_have_cells(spark, monkeypatch):
    fitted = []
    fit = embedding_dedup.spherical_kmeans
    monkeypatch.setattr(embedding_dedup, "spherical_kmeans", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted(map(tuple, df.collect()))
    component, links = brute_vectors([v for _, v in rows])
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert [got[i].n_links for i, _ in rows] == links and [got[i].component_id for i, _ in rows] == [rows[c][0] for c in component]
    assert len(fitted) == 1 and len(fitted[0]) > 1


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings_many_cells(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    v = [list(map(float, c + rng.normal(size=24) * 0.08)) for c in rng.normal(size=(60, 24)) for _ in range(8)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    _, links = brute_vectors(v)
    got = {r.vec_id: r for r in embedding_dedup.link(df, cell_rows=40).collect()}
    found = sum(r.n_links for r in got.values())
    assert sum(links) * 0.98 <= found <= sum(links)
    assert all(got[i].n_links <= links[i] for i in got)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (600, 700), (700, 600)]
    want = classes(701, edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges for x in e}
