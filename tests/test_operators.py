"""Operators on small fixed inputs and as invariants."""

import importlib.util
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from lithoframe.functions import digests as dg
from lithoframe.functions.gf256 import products, tables
from lithoframe.operators import coding, gossip, health, objects, tracker, versions
from lithoframe.streaming import folds

field = st.integers(0, 255)


@given(field, field, field)
def test_field_axioms(a, b, c):
    m = products()
    assert m[a, b] == m[b, a] and m[m[a, b], c] == m[a, m[b, c]] and m[a, b ^ c] == m[a, b] ^ m[a, c]
    exp, log = tables()
    if a:
        assert m[a, exp[255 - log[a]]] == 1


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=0, max_size=200), st.integers(1, 8), st.randoms())
def test_any_independent_pieces_decode(data, k, rng):
    size = max(1, -(-len(data) // k))
    body = np.frombuffer(data.ljust(k * size, b"\0"), dtype=np.uint8).reshape(k, size)
    m = products()
    vectors = np.asarray([[rng.randrange(1, 256) for _ in range(k)] for _ in range(k + 4)], dtype=np.uint8)
    coded = np.stack([np.bitwise_xor.reduce(m[v[:, None], body], axis=0) for v in vectors])
    rank, out, useful = coding.eliminate(vectors, coded)
    assert rank == useful.sum() <= k
    if rank == k:
        assert out.tobytes()[: len(data)] == data
    assert coding.eliminate(vectors[:1].repeat(3, axis=0), coded[:1].repeat(3, axis=0))[0] == 1


def test_formulas(spark):
    df = spark.createDataFrame([(32, 96, 80), (16, 48, 48), (8, 32, 32), (4, 24, 24), (1, 18, 18)], "k int, target long, made long")
    got = df.select("k", dg.target_pieces(F.col("k")).alias("t"), dg.encoder_pieces(F.col("k")).alias("m"), "target", "made").collect()
    assert all(r.t == r.target and r.m == r.made for r in got)


def test_node_loss(spark):
    holders = spark.createDataFrame([(c, n, 4) for c in range(50) for n in range(10)], "cid int, node int, piece_count int")
    dead = spark.createDataFrame([(n,) for n in range(3)], "node int")
    assert {r.available for r in tracker.available(holders).collect()} == {40}
    left = tracker.remove_nodes(holders, dead)
    assert {r.available for r in tracker.available(left).collect()} == {28}
    k = spark.createDataFrame([(c, 32) for c in range(50)], "cid int, k int")
    assert {(r.severity, r.deficit) for r in health.triage(left, k).collect()} == {("critical", 4)}
    assert health.triage(holders.limit(0), k).filter("available = 0 and severity = 'critical'").count() == 50


def test_ranking_ties_and_nan(spark):
    rows = [("c", 3, 5, 0.5), ("c", 1, 5, 0.5), ("c", 2, 5, 0.9), ("c", 4, 9, 0.1), ("c", 5, 9, float("nan"))]
    got = health.rank(spark.createDataFrame(rows, "cid string, node int, uptime int, reputation double")).orderBy("rank").collect()
    assert [r.node for r in got] == [4, 2, 1, 3]


def test_cursor_wraps(spark):
    contents = spark.createDataFrame([(i,) for i in range(10)], "cid long")
    assert sorted(r.cid for r in health.cursor_batch(contents, 0.3, 8).collect()) == [0, 8, 9]
    assert sorted(r.cid for r in health.cursor_batch(contents, 0.0001, 13).collect()) == [3]
    assert health.cursor_batch(contents.limit(0), 0.5, 0).count() == 0


def test_objects(spark, tmp_path):
    data = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (b"",)], "data binary")
    store = objects.put(data)
    assert store.count() == 3 and objects.put(data, store).count() == 0
    objects.write_objects(store, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.rdd.getNumPartitions() >= 1 and "PartitionFilters" in back.filter("shard = 'ca'")._jdf.queryExecution().toString()
    wanted = objects.put(data).select("cid").union(spark.createDataFrame([("0" * 64,)], "cid string"))
    got = {r.cid: r.data for r in objects.get(back, wanted).collect()}
    assert got["0" * 64] is None and sorted(bytes(v) for v in got.values() if v is not None) == [b"", b"a", b"b"]
    assert objects.delete(store, store.limit(1).select("cid")).count() in (2, 3)
    bad = store.withColumn("data", F.lit(b"zz"))
    with pytest.raises(Exception, match="doesn't match"):
        objects.get(bad, store.select("cid")).collect()


def test_bloom(spark):
    keys = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("cid"))
    others = spark.range(10_000, 12_000).select(F.sha2(F.col("id").cast("string"), 256).alias("cid"))
    bloom = objects.bloom_build(keys)
    assert objects.bloom_contains(keys, bloom).filter("not maybe").count() == 0
    assert objects.bloom_contains(others, bloom).filter("maybe").count() < 40
    assert objects.bloom_contains(keys, objects.bloom_build(keys.limit(0))).filter("maybe").count() == 0


def test_merkle_and_index(spark):
    import hashlib

    h = lambda *x: hashlib.sha256(b"".join(bytes.fromhex(y) for y in x)).hexdigest()
    leaf = [hashlib.sha256(bytes([i])).hexdigest() for i in range(3)]
    rows = [("one", 0, leaf[0])] + [("two", i, leaf[i]) for i in range(2)] + [("three", i, leaf[i]) for i in range(3)]
    got = {r.g: r.root for r in versions.merkle_roots(spark.createDataFrame(rows, "g string, pos int, hash string"), "g", 3).collect()}
    two = h(leaf[0], leaf[1])
    assert got == {"one": leaf[0], "two": two, "three": h(two, h(leaf[2], leaf[2]))}


def test_pages_and_snapshots(spark):
    files = spark.createDataFrame([(1, b"x" * 2050), (2, b""), (3, b"y" * 1024)], "k int, data binary")
    got = sorted((r.k, r.page_num, bytes(r.data)) for r in versions.to_pages(files, "k", "data", 1024).collect())
    assert [(k, n, len(b)) for k, n, b in got] == [(1, 0, 1024), (1, 1, 1024), (1, 2, 1024), (3, 0, 1024)] and got[2][2] == b"xx" + b"\0" * 1022
    log = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (0, 2, "c"), (1, 3, None)], "page_num int, version int, cid string")
    at = lambda v: sorted((r.page_num, r.cid) for r in versions.snapshot(log, v, ["page_num"], "cid").collect())
    assert at(1) == [(0, "a"), (1, "b")] and at(2) == [(0, "c"), (1, "b")] and at(3) == [(0, "c")] and at(0) == []


def test_compare_and_swap(spark):
    rows = [(1, "o", "o", True, None, "r1"), (2, "o", "o", True, "r0", "r2"), (3, "o", "o", True, "r1", "r3"), (4, "x", "o", True, "r3", "r4"), (5, "o", "o", False, "r3", "r5"), (6, "o", "o", True, None, "r6")]
    log = spark.createDataFrame([("d", *r) for r in rows], "db string, seq int, writer string, owner string, signed boolean, expected string, root string")
    got = [r.verdict for r in versions.fold_writes(log, "db", "seq").orderBy("seq").collect()]
    assert got == ["accepted", "conflict", "accepted", "unauthorized", "bad_signature", "accepted"]


def test_membership_transitions(spark):
    cases = {
        1: ([("alive", 0)], ("alive", 0, 1, 0)),
        2: ([("suspect", 3), ("alive", 3)], ("alive", 3, 0, 0)),
        3: ([("alive", 2), ("suspect", 2), ("alive", 1)], ("suspect", 2, 1, 0)),
        4: ([("alive", 2), ("dead", 0), ("alive", 0)], ("dead", 0, 1, 1)),
        5: ([("dead", 4), ("alive", 4), ("alive", 5)], ("alive", 5, 0, 0)),
        6: ([("dead", 1), ("suspect", 9), ("ping", 0)], ("dead", 1, 0, 0)),
    }
    rows = [(n, i, k, m) for n, (log, _) in cases.items() for i, (k, m) in enumerate(log)]
    got = {r.node: tuple(r)[1:] for r in folds.membership(spark.createDataFrame(rows, "node int, seq int, kind string, inc int")).collect()}
    assert got == {n: want for n, (_, want) in cases.items()}
    for n, (log, want) in cases.items():
        st_, inc, up, down = folds.UNKNOWN, 0, 0, 0
        for kind, m in log:
            st_, inc, event = folds.member_step(st_, inc, kind, m)
            up, down = up + (event == "connected"), down + (event == "disconnected")
        assert (folds.STATE_NAMES[st_], inc, up, down) == want, n


def test_clock(spark):
    stamp = lambda ms, n: (ms << 16) | n
    rows = [(1, 0, 1000, None), (1, 1, 1000, None), (1, 2, 900, None), (2, 0, 1000, stamp(1400, 7)), (2, 1, 1000, stamp(1600, 0)), (2, 2, 50_000, stamp(10, 0)), (3, 0, 5, stamp(5, 65_535)), (3, 1, 5, None), (4, 0, 1000, stamp(1400, 65_535)), (4, 1, 1000, None)]
    got = {r.node: tuple(r)[1:] for r in folds.hybrid_clock(spark.createDataFrame(rows, "node int, seq int, wall_ms long, remote long")).collect()}
    assert got[1] == (stamp(1000, 2), 0, 0) and got[2] == (stamp(1400, 8), 1, 1) and got[4] == (stamp(1401, 0), 0, 0)
    assert got[3][0] > stamp(5, 0)


def test_programs(spark):
    rows = [(1, i, "error") for i in range(12)] + [(2, i, "ok" if i == 9 else "error") for i in range(15)] + [(3, i, "fuel" if i % 2 else "error") for i in range(8)]
    got = {r.program: tuple(r)[1:] for r in folds.program_runs(spark.createDataFrame(rows, "program int, seq int, outcome string")).collect()}
    assert got == {1: ("quarantined", 10, 10), 2: ("running", 5, 15), 3: ("running", 4, 8)}


def test_gossip(spark):
    members = spark.createDataFrame([(3, "dead"), (2, "alive"), (1, "suspect"), (4, "alive")], "node int, state string")
    assert sorted(r.node for r in gossip.gossip_top(members, 3).collect()) == [1, 2, 4]
    n = spark.createDataFrame([(2**i + d,) for i in range(5, 20) for d in (-1, 0, 1)], "n long")
    assert all(r.k == math.ceil(math.log2(r.n)) for r in n.select("n", dg.piggyback_count(F.col("n")).alias("k")).collect())


def test_sql_errors(spark):
    with pytest.raises(ParseException):
        spark.sql("SELEC 1")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM no_such_table_here")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("corpus_pipeline") is None:
        assert not any(n.startswith("op1_") for n in entry.queries())
