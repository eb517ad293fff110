"""Jobs over whole tables, against brute force on small ones."""

import hashlib
import math

import pytest

from lithoframe.operators import coding, gossip, versions
from lithoframe.plans import inputs
from lithoframe.plans.catalog import HERE, PIECES, QUERIES, K


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def gf_product(a, b):
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = (a << 1) ^ (0x11B if a & 128 else 0), b >> 1
    return out


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """Contents of 0 to 400 bytes, more than eight of them."""
    d = str(tmp_path_factory.mktemp("items"))
    texts = ["", "x", *["".join(chr(97 + int(digest(i, n), 16) % 26) for n in range(40 * i)) for i in range(2, 11)]]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, [t.encode() for t in texts]


def test_tags_cover_all_contents_and_bytes(spark, items):
    d, texts = items
    want = {}
    for cid, data in enumerate(texts):
        size = max(1, -(-len(data) // K))
        parts = [data.ljust(size * K, b"\0")[j * size : (j + 1) * size] for j in range(K)]
        for p in range(PIECES):
            c = [int(digest("e", cid, p, j)[:6], 16) % 255 + 1 for j in range(K)]
            piece = [0] * size
            for j in range(K):
                piece = [x ^ gf_product(c[j], y) for x, y in zip(piece, parts[j], strict=True)]
            for t in range(coding.TAG_BYTES):
                tag = 0
                for off, b in enumerate(piece):
                    tag ^= gf_product(int(digest("m", cid, t, off)[:2], 16), b)
                want[cid, p, t] = tag
    assert {(r.cid, r.p, r.t): r.tag for r in QUERIES["mac_tags"](spark, d).collect()} == want
    same = QUERIES["mac_combine_identity"](spark, d).collect()
    assert sorted((r.cid, r.p) for r in same) == [(c, p) for c in range(len(texts)) for p in range(K)] and all(r.same for r in same)


def test_targets_plans_and_samples_cover_all_contents(spark, data):
    alive = sorted(r.node for r in inputs.alive(spark, data).collect())
    held = {(r.cid, r.node): r.piece_count for r in inputs.holders(spark, data).collect()}
    contents = [r.cid for r in inputs.k_of(spark, data).collect()]

    def walk(cid, nodes):
        start = int(digest(cid)[:7], 16) % len(nodes)
        return nodes[start:] + nodes[:start]

    others = [n for n in alive if n != HERE]
    want = {}
    for cid in contents:
        tiers = [1 if held.get((cid, n)) == 1 else 2 if (cid, n) not in held else 3 for n in walk(cid, others)]
        want[cid] = walk(cid, others)[tiers.index(min(tiers))], min(tiers)
    assert {r.cid: (r.target, r.tier) for r in QUERIES["distribution_target"](spark, data).collect()} == want

    n = max(1, math.ceil(math.log(len(alive))))
    assert sorted(map(tuple, QUERIES["fanout_sample"](spark, data).select("cid", "node").collect())) == sorted((c, x) for c in contents for x in walk(c, alive)[:n])

    elected = [r for r in QUERIES["elect_top_n"](spark, data).collect() if held[r.cid, r.node] >= 2]
    assert sorted(map(tuple, QUERIES["repair_plan"](spark, data).select("cid", "rank", "target").collect())) == sorted((r.cid, r.rank, want[r.cid][0]) for r in elected if r.cid in want)


def merkle(hashes):
    while len(hashes) > 1:
        pairs = [(hashes[k], hashes[min(k + 1, len(hashes) - 1)]) for k in range(0, len(hashes), 2)]
        hashes = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in pairs]
    return hashes[0]


def test_merkle_root_of_long_pages(spark, tmp_path):
    pages = ["", "a" * 1024, "b" * 65_537, "c" * 65_536 + "d", "c" * 65_536 + "e", "f" * 140_000]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {i: merkle([hashlib.sha256(h[k : k + 1024].encode().ljust(1024, b"\0")).hexdigest() for k in range(0, len(h), 1024)]) for i, h in enumerate(pages) if h}
    assert {r.page_id: r.root for r in QUERIES["merkle_root"](spark, str(tmp_path)).collect()} == want
    none = spark.createDataFrame([], "g int, pos int, hash string")
    assert versions.merkle_roots(none, "g").collect() == []


def test_batches_run_on_over_spans_of_keys(spark):
    span = 1 << 20
    ids = [*range(-3, 250), *range(span - 130, span + 270), *range(5 * span, 40 * span, span), 10**12]
    got = gossip.batches(spark.createDataFrame([(i,) for i in ids[::-1]], "doc_id long"), "doc_id", 100)
    assert got.columns == ["doc_id", "batch"]
    assert {r.doc_id: r.batch for r in got.collect()} == {x: k // 100 for k, x in enumerate(ids)}
    assert sorted(str(r.batch) for r in gossip.batches(spark.createDataFrame([(7,), (None,)], "doc_id long"), "doc_id", 1).collect()) == ["0", "1"]


def test_objects_of_all_documents(spark, data):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    have = set(docs.values())
    got = QUERIES["object_contains"](spark, data).collect()
    assert sorted((r.item_id, r.present) for r in got) == sorted([(-1 - i, True) for i in docs] + [(i, t in have) for i, t in items.items()])
    got = QUERIES["object_get"](spark, data).collect()
    want = {sha(t): t if t in have else None for t in [*docs.values(), *items.values()]}
    assert len(got) == len(want) and {r.cid: r.data for r in got} == want


def roots_of(log, at):
    live = {}
    for version, page, cid in sorted(log, key=lambda x: x[0]):
        if version <= at:
            live[page] = cid
    entries = sorted((p, c) for p, c in live.items() if c is not None)
    body = len(entries).to_bytes(4, "little") + b"".join(p.to_bytes(4, "little") + bytes.fromhex(c) for p, c in entries)
    return len(entries), hashlib.sha256(body).hexdigest()


def test_commits_cover_the_log(spark, data):
    log = [(r.version, r.page_num, r.cid) for r in inputs.page_log(spark, data).collect()]
    last = max(x[0] for x in log)
    got = {r.version: (r.pages, r.root) for r in QUERIES["commit_chain"](spark, data).collect()}
    assert got == {v: roots_of(log, v) for v in {*range(100, last + 1, 100), last}}


def test_commits_with_gaps_and_tombstones(spark):
    one = "ab" * 32
    log = [(2, 5, one), (3, 5, None), (31, 1, one), (32, 5, None), (57, 1, None)]
    rows = versions.commit_roots(spark.createDataFrame(log, "version int, page_num int, cid string"), 10).collect()
    assert {r.version: (r.pages, r.root) for r in rows} == {v: roots_of(log, v) for v in (10, 20, 30, 40, 50, 57)}


def test_all_products(spark, data):
    assert {(r.x, r.y): r.product for r in QUERIES["gf_tables"](spark, data).collect()} == {(x, y): gf_product(x, y) for x in range(256) for y in range(256)}
