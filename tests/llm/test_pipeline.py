"""Mixing, packing, labelling and the pipeline, against brute force and held-out labels."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lithoframe.llm import language_id, mixing, packing, quality
from lithoframe.llm.html_extract import extract, main_text
from lithoframe.llm.queries import op5_language_id, op8_quality_rank, op9_source_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, block int, k int, h int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "x", 2, 3, 4) for i, t, lang, s in rows], DOCS)


def words(n, k=0):
    return " ".join(f"w{(k * 7 + j) % 50}" for j in range(n))


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    got = mixing.targets([10, 1000, 5, 300], [3, 1, 2, 3])
    assert math.isclose(sum(got), 1.5 * 1315) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 5, 300], strict=True))
    assert mixing.targets([0, 0], [3, 1]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_splitting_tree():
    quotas = [1000, 0, 37, 5]
    out = mixing.splitting_tree(quotas, 13, 1)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 4
    assert (out == mixing.splitting_tree(quotas, 13, 1)).all()


def mix_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, words(int(n), i), "en", ["b", None, "a", "c"][int(s)]) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 900), rng.choice(4, 900, p=[0.6, 0.1, 0.1, 0.2]), strict=True))]
    rows += [(900, None, "en", "a"), (901, "", None, None), (902, words(5), "en", "b"), (902, words(5), "en", "b"), (None, words(9), "en", "c")]
    return rows, docs_of(spark, rows).withColumns({"_shard": F.lit(1), "_place": F.lit(2), "_words": F.lit(3), "own_size": F.lit(4), "words": F.lit(5)})


def test_mix_rows_are_the_plan(spark):
    rows, df = mix_rows(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "_shard_1", "_place_1"] and {tuple(r) for r in mixed.select("_shard", "_words", "own_size", "words").distinct().collect()} == {(1, 3, 4, 5)}
    n = Counter(r.doc_id for r in mixed.collect())
    whole = {r.doc_id: r.times * (2 if r.doc_id == 902 else 1) for r in mixing.plan(df, split_documents=False).collect() if r.size}
    assert n == Counter({i: t for i, t in whole.items() if t})
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0 and mixing.tally(df.limit(0)).count() == 0


def test_mix_holds_quotas(spark):
    """Shards are disjoint runs of whole blocks of the lengths the tree gave; their words are the tally and meet the targets."""
    rows, df = mix_rows(spark)
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in ("a", "b", "c", None)}
    goal = dict(zip(sizes, mixing.targets(list(sizes.values()), [3, 1, 2, 3]), strict=True))
    planned = mixing.plan(df).cache()
    drawn = mixing.draw(planned, shards=7).collect()
    shard = defaultdict(set)
    for r in drawn:
        shard[r.src, r["pass"], r.block].add(r.shard)
    assert all(len(x) == 1 for x in shard.values()) and len({r.shard for r in drawn}) == 7  # disjoint
    for src in sizes:  # runs: the shards follow each other over the permuted blocks, as long as the tree says
        order = [next(iter(shard[b])) for b in sorted((b for b in shard if b[0] == src), key=lambda b: b[1:])]
        assert order == sorted(order)
    sources = [s for s in sizes if any(b[0] == s for b in shard)]
    tree = mixing.splitting_tree([sum(b[0] == s for b in shard) for s in sources], 7, 20)
    assert [[sum(b[0] == s and shard[b] == {k} for b in shard) for s in sources] for k in range(7)] == tree.tolist()
    got = mixing.tally(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.tally(df.repartition(3)).collect()))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.src] and math.isclose(r.target, goal[r.src])
        taken[r.src] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 + 5 for s in goal)  # the repeated row is decided once
    by_hand = Counter()
    for r in drawn:
        by_hand[r.doc_id, r.src, r["size"]] += r.words
    assert {(r.doc_id, r.src, r["size"]): r.taken for r in got if r.taken} == dict(by_hand)
    words_of = mixing.mix(df, split_documents=True, shards=7).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()
    assert {r.source: r.n for r in words_of if r.source != "b"} == {s: taken[s] for s in ("a", "c", None)}


def test_mix_table(spark, data):
    got = op9_source_mix(spark, data).toPandas()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (got.taken <= 2 * got["size"]).all()


def test_boundaries_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        tops = np.sort(rng.choice(60, n, replace=False)).tolist()
        counts = rng.integers(1, 20, n).tolist()
        for k in (1, 2, 3, 20):
            got = packing.best_boundaries(tops, counts, k)
            cost = lambda ends: sum(min(e for e in ends if e >= t) * c for t, c in zip(tops, counts, strict=True))
            best = min(cost([*some, tops[-1]]) for m in range(min(k, n)) for some in combinations(tops[:-1], m))
            assert len(got) <= k and got[-1] == tops[-1] and cost(got) == best


def test_pack(spark):
    rng = np.random.default_rng(6)
    rows = [(i, words(int(n)), "en", "s") for i, n in enumerate(rng.integers(0, 200, 500))] + [(1000, None, "en", "s"), (1001, words(5000), "en", "s"), (3, words(7), "en", "s")]
    got = packing.pack(docs_of(spark, rows), buckets=4, token_budget=1000).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i, len((t or "").split())) for i, t, _, _ in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.length <= r.padded
        batches[r.batch].append(r)
    for b in batches.values():
        assert len({(r.bucket, r.padded) for r in b}) == 1 and sorted(r.position for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].padded <= 1000
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0


def test_language(spark):
    got = op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    rows = [(0, "the cat", "en", "s"), (1, None, "en", "s"), (2, "12 !?", None, "s"), (3, "der hund", "de", "s"), (4, "x" * 3_000_000, None, "s")]
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, rows), F.lit(True)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3)] == ["en", "und", "und", "de"] and got[1].score == got[2].score == 0
    kept = language_id.keep_identified(docs_of(spark, rows), F.lit(True))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4] and kept.columns == docs_of(spark, rows).columns
    none = language_id.identify(docs_of(spark, rows), F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"} and language_id.identify(docs_of(spark, rows).limit(0), F.lit(True)).count() == 0


def test_language_pieces():
    text = "Größe und Länge " * 40
    whole = sorted(np.concatenate([f.ravel() for _, _, f in language_id.cells([text, "ab"])]).tolist())
    limit = language_id.pieces.__defaults__
    language_id.pieces.__defaults__ = (7,)
    try:
        assert sorted(np.concatenate([f.ravel() for _, _, f in language_id.cells([text, "ab"])]).tolist()) == whole
    finally:
        language_id.pieces.__defaults__ = limit


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op8_quality_rank(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.97 and got.score.between(0, 1).all()
    rows = docs_of(spark, [(0, None, "en", "s"), (1, "", "en", "s"), (2, "word " * 200_000, "en", "s")])
    none = quality.rate(rows, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality.rate(rows.limit(0), labels, F.lit(True)).count() == 0
    assert all(np.isfinite(quality.features(t)).all() for t in (None, "", "a", "\x00" * 100))


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class=ad>Buy the of and.</div><article><h1>A &amp; B</h1><p>So it\n  is<br>now.<p><b>Bold.<br><p>the of and in on " + "x " * 90 + "</article><div id='comments'><p>I am of the view that it is so.</div><footer>&copy; x</footer>"
    want = "A & B\n\nSo it is now.\n\nBold.\n\nthe of and in on" + " x" * 90
    assert extract(page) == want
    rows = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (1, "u", page, "t"), (4, "u", "<p" * 1000, "t"), (5, "u", "<p>the of and it is " + "the long of it " * 50_000, "t")], "page_id long, url string, html string, text string")
    got = main_text(rows).collect()
    assert len(got) == 6 and [r.n_chars for r in got][:4] == [len(want), 0, 0, len(want)] and got[5].n_chars > 700_000
    assert main_text(rows.limit(0)).count() == 0


def test_html_edges():
    body = "So it is that the cat of the house was on the mat and in the sun with all that it had. " * 4
    for page, want in [
        (f'<body><script src="a"/>code of the script</script><p>{body}</p></body>', body.strip()),
        (f"<body><svg/><p>{body}</p></body>", body.strip()),
        (f"<body><p>{body}</p><p>{body} © the owner of it</p></body>", f"{body.strip()}\n\n{body}© the owner of it".replace("  ", " ")),
        (f"<body><p>{body}</p><div>© 2024 the firm</div></body>", body.strip()),
        (f'<body><div class="share-price-news"><p>{body}</p></div><div class="share-buttons"><p>{body}</p></div><div class="site-footer"><p>{body}</p></div></body>', body.strip()),
    ]:
        assert extract(page) == want
    long_ = "这是一个关于猫和狗的很长的故事它们住在河边的房子里每天都一起玩耍" * 5
    assert extract(f"<body><nav>首页 新闻</nav><p>{long_}</p><p>{long_}。</p><footer>版权</footer></body>") == f"{long_}\n\n{long_}。"


def test_html_brute_force_pages(spark, data):
    """On every page of the table, the operator's rows are those of the rules applied one page at a time."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in main_text(pages.repartition(3)).collect()}
    want = {r.page_id: (r.url, extract(r.html), len(extract(r.html))) for r in pages.collect()}
    assert got == want and sum(n > 0 for _, _, n in got.values()) > 0.8 * len(got)


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, data)
        assert after.columns == docs.columns
        assert after.count() > 0.5 * docs.count()
        docs = after
    assert corpus_pipeline.run(spark, data).count() == docs.count()
