"""Named queries over the test tables, and the same in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.functions import digests as dg
from lithoframe.functions import gf256
from lithoframe.operators import coding, gossip, health, objects, tracker, versions
from lithoframe.plans import inputs
from lithoframe.plans.inputs import SQL
from lithoframe.plans.sql_surface import TABLES, TEXTS
from lithoframe.session import table, views
from lithoframe.streaming import folds, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

HERE = 3  # the node that scans and repairs


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle.format(**SQL, CELLS=CELLS, GF=GF)
        return f

    return register


#: GF(2^8) in the oracle: e(i, x) powers of 3, m(a, b, p) products of non-zero elements.
GF = """RECURSIVE e(i, x) AS (SELECT 0, 1 UNION ALL SELECT i + 1, xor(xor(x * 2, CASE WHEN x >= 128 THEN 283 ELSE 0 END), x) FROM e WHERE i < 254),
m AS (SELECT ea.x AS a, eb.x AS b, ec.x AS p FROM e ea, e eb, e ec WHERE (ea.i + eb.i) % 255 = ec.i)"""
K, PIECES = 4, 6
CELLS = f"""cells AS (SELECT cid, CAST(floor(pos / sz) AS INT) AS j, CAST(pos % sz AS INT) AS off, CASE WHEN pos < len THEN CAST('0x' || substr(h, 2 * pos + 1, 2) AS INT) ELSE 0 END AS b FROM (
SELECT *, unnest(range(sz * {K})) AS pos FROM (SELECT item_id AS cid, hex(encode(text)) AS h, octet_length(encode(text)) AS len, greatest(CAST(ceil(octet_length(encode(text)) / {K}.0) AS BIGINT), 1) AS sz FROM benchmark)))"""


def _coef(seed: str, *cols: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(cols)})), 1, 6) AS BIGINT) % 255 + 1 AS INT)"


VECTORS = f"vec AS (SELECT *, {_coef('e', 'cid', 'p', 'j')} AS c FROM (SELECT DISTINCT cid FROM cells), (SELECT unnest(range({PIECES})) AS p), (SELECT unnest(range({K})) AS j))"
CODED = "coded AS (SELECT cells.cid, vec.p, off, CAST(bit_xor(coalesce(m.p, 0)) AS INT) AS b FROM cells JOIN vec ON cells.cid = vec.cid AND cells.j = vec.j LEFT JOIN m ON m.a = vec.c AND m.b = cells.b GROUP BY cells.cid, vec.p, off)"


# -- objects ---------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS cid, substr(sha256(text), 1, 2) AS shard FROM documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", dg.cid(F.col("text")).alias("cid"), dg.shard(dg.cid(F.col("text"))).alias("shard"))


def _store(spark, d):
    return objects.put(table(spark, d, "documents").select(F.col("text").alias("data")))


@query("SELECT DISTINCT sha256(text) AS cid, octet_length(encode(text)) AS bytes FROM documents")
def put_dedup(spark, d):
    return _store(spark, d).select("cid", F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT DISTINCT sha256(text) AS cid FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def put_incremental(spark, d):
    docs = table(spark, d, "documents")
    first = objects.put(docs.filter("doc_id % 2 = 0").select(F.col("text").alias("data")))
    return objects.put(docs.filter("doc_id % 2 = 1").select(F.col("text").alias("data")), first).select("cid")


@query("SELECT count(DISTINCT text) AS objects, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT text, max(octet_length(encode(text))) AS n FROM documents GROUP BY text)")
def object_usage(spark, d):
    return objects.usage(_store(spark, d))


@query("SELECT substr(sha256(text), 1, 2) AS shard, count(DISTINCT text) AS objects FROM documents GROUP BY 1")
def shard_histogram(spark, d):
    return objects.shard_histogram(_store(spark, d))


@query("SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) AS present FROM benchmark b UNION ALL SELECT -1 - doc_id AS item_id, TRUE AS present FROM documents")
def object_contains(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", "text").union(table(spark, d, "documents").select(-1 - F.col("doc_id"), "text"))
    return objects.contains(_store(spark, d), asked.select("item_id", dg.cid(F.col("text")).alias("cid"))).select("item_id", "present")


@query("SELECT sha256(text) AS cid, max(text) AS data FROM documents GROUP BY 1 UNION ALL SELECT DISTINCT sha256(text), NULL FROM benchmark WHERE text NOT IN (SELECT text FROM documents)")
def object_get(spark, d):
    asked = table(spark, d, "documents").select("text").union(table(spark, d, "benchmark").select("text"))
    return objects.get(_store(spark, d), asked.select(dg.cid(F.col("text")).alias("cid")).distinct())


@query("SELECT DISTINCT sha256(text) AS cid FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0')")
def object_delete(spark, d):
    gone = table(spark, d, "documents").filter("source = 'src0'").select(dg.cid(F.col("text")).alias("cid"))
    return objects.delete(_store(spark, d), gone).select("cid")


@query("SELECT item_id, item_id % 5 <> 0 AS intact FROM benchmark")
def integrity_check(spark, d):
    b = table(spark, d, "benchmark")
    damaged = F.when(F.col("item_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return b.select("item_id", dg.verify(damaged, dg.cid(F.col("text"))).alias("intact"))


@query("SELECT CAST(count(DISTINCT text) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS missed FROM documents")
def bloom_no_false_negative(spark, d):
    store = _store(spark, d).select("cid")
    told = objects.bloom_contains(store, objects.bloom_build(store))
    return told.agg(F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("maybe")).alias("missed"))


@query("SELECT sha256(text) AS cid, upper(sha256(text)) = upper(sha256(text)) AND length(sha256(text)) = 64 AS round_trip, FALSE AS short_ok FROM benchmark")
def cid_hex_parse(spark, d):
    c = dg.cid(F.col("text"))
    return table(spark, d, "benchmark").select(c.alias("cid"), (F.lower(F.hex(dg.parse_cid(F.upper(c)))) == c).alias("round_trip"), dg.parse_cid(F.substring(c, 1, 62)).isNotNull().alias("short_ok"))


@query("""SELECT '{{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","raw":"' || lower(hex(encode(n_name))) || '"}}' AS json FROM nation""")
def json_sink(spark, d):
    return objects.as_json(table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_name").cast("binary").alias("raw")))


# -- versions ---------------------------------------------------------------------------------------

_PAGES = "(SELECT page_id, page_num, sz, substr(h, CAST(page_num * 2048 + 1 AS BIGINT), 2048) AS part FROM (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS sz, unnest(range(CAST(ceil(octet_length(encode(html)) / 1024.0) AS BIGINT))) AS page_num FROM pages))"
_PAGE_CIDS = f"(SELECT page_id, CAST(page_num AS INT) AS page_num, sha256(unhex(rpad(part, 2048, '0'))) AS cid FROM {_PAGES})"


def _pages(spark, d):
    return versions.to_pages(table(spark, d, "pages"), "page_id", "html", 1024)


def _index(spark, d):
    return versions.page_index(_pages(spark, d))


@query(f"SELECT page_id, page_num, cid FROM {_PAGE_CIDS}")
def page_chunks(spark, d):
    return _index(spark, d).select("page_id", "page_num", "cid")


_LE = "substr(printf('%08x', {n}), 7, 2) || substr(printf('%08x', {n}), 5, 2) || substr(printf('%08x', {n}), 3, 2) || substr(printf('%08x', {n}), 1, 2)"


def _le(n: str) -> str:
    return _LE.replace("{n}", n)


_ROOT = f"SELECT page_id, CAST(count(*) AS INT) AS pages, sha256(unhex({_le('count(*)')} || string_agg({_le('page_num')} || cid, '' ORDER BY page_num))) AS root FROM {_PAGE_CIDS} GROUP BY page_id"


@query(_ROOT)
def root_cid(spark, d):
    return versions.root_cid(_index(spark, d), ["page_id"])


@query(f"SELECT page_id, CAST(count(*) AS BIGINT) AS entries, TRUE AS same, TRUE AS cut_rejected FROM {_PAGE_CIDS} GROUP BY page_id")
def index_round_trip(spark, d):
    listed = _index(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_num").cast("long").alias("page_num"), "cid"))).alias("e"))
    text = F.concat(dg.le32(F.size("e")), F.array_join(F.transform("e", lambda x: F.concat(dg.le32(x["page_num"]), x["cid"])), ""))
    rows = listed.withColumn("s", text)
    return rows.select("page_id", F.size(versions.parse_index(F.col("s"))).cast("long").alias("entries"), (versions.parse_index(F.concat("s", F.lit("ffff"))) == F.col("e")).alias("same"), versions.parse_index(F.expr("substring(s, 1, length(s) - 2)")).isNull().alias("cut_rejected"))


def _merkle_sql(levels: int) -> str:
    at = f"l0 AS (SELECT page_id, CAST(page_num AS BIGINT) AS pos, cid AS hash, count(*) OVER (PARTITION BY page_id) AS n FROM {_PAGE_CIDS})"
    for k in range(levels):
        at += f", l{k + 1} AS (SELECT page_id, pos, hash, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT page_id, pos // 2 AS pos, CASE WHEN max(n) = 1 THEN arg_min(hash, pos) ELSE sha256(unhex(arg_min(hash, pos) || arg_max(hash, pos))) END AS hash FROM l{k} GROUP BY page_id, pos // 2))"
    return f"WITH {at} SELECT page_id, hash AS root FROM l{levels}"


@query(_merkle_sql(6))
def merkle_root(spark, d):
    leaves = _index(spark, d).select("page_id", F.col("page_num").alias("pos"), F.col("cid").alias("hash"))
    return versions.merkle_roots(leaves, "page_id")


@query("SELECT page_num, arg_max(v, version) AS last_order FROM (SELECT *, version AS v FROM {page_log}) GROUP BY page_num")
def dirty_page_overwrite(spark, d):
    return versions.latest(inputs.page_log(spark, d).withColumn("v", F.col("version")), ["page_num"], "version", "v").select("page_num", F.col("v").alias("last_order"))


_AT = "SELECT page_num, cid FROM (SELECT *, row_number() OVER (PARTITION BY page_num ORDER BY version DESC) AS rn FROM {{page_log}} WHERE version <= {v}) WHERE rn = 1 AND cid IS NOT NULL"


@query(_AT.replace("{{page_log}}", "{page_log}").replace("{v}", "500"))
def snapshot_at_version(spark, d):
    return versions.snapshot(inputs.page_log(spark, d), 500, ["page_num"], "cid")


@query(_AT.replace("{{page_log}}", "{page_log}").replace("{v}", "1000000000"))
def page_tombstone(spark, d):
    return versions.snapshot(inputs.page_log(spark, d), 1_000_000_000, ["page_num"], "cid")


_CHAIN = f"""WITH log AS (SELECT * FROM {{page_log}}), last AS (SELECT max(version) AS m FROM log), c AS (SELECT DISTINCT least(x, m) AS v FROM (SELECT m, unnest(range(100, m + 100, 100)) AS x FROM last)),
e AS (SELECT v, page_num, cid FROM (SELECT c.v, l.page_num, l.cid, row_number() OVER (PARTITION BY c.v, l.page_num ORDER BY l.version DESC) AS rn FROM c JOIN log l ON l.version <= c.v) WHERE rn = 1 AND cid IS NOT NULL)
SELECT v AS version, CAST(count(*) AS INT) AS pages, sha256(unhex({_le('count(*)')} || string_agg({_le('page_num')} || cid, '' ORDER BY page_num))) AS root FROM e GROUP BY v"""


@query(_CHAIN)
def commit_chain(spark, d):
    """Commits at every hundredth version, and at the last."""
    return versions.commit_roots(inputs.page_log(spark, d), 100)


@query("""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY o_orderkey) AS rn FROM {writes}), f AS (
SELECT DISTINCT db, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS o_orderkey, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS verdict FROM l
UNION ALL SELECT l.db, l.rn, l.o_orderkey, CASE WHEN l.signed AND l.writer = l.owner AND (l.expected IS NULL OR f.cur IS NULL OR l.expected = f.cur) THEN l.root ELSE f.cur END,
CASE WHEN NOT l.signed THEN 'bad_signature' WHEN l.writer <> l.owner THEN 'unauthorized' WHEN l.expected IS NOT NULL AND f.cur IS NOT NULL AND l.expected <> f.cur THEN 'conflict' ELSE 'accepted' END
FROM f JOIN l ON l.db = f.db AND l.rn = f.rn + 1) SELECT db, o_orderkey, verdict FROM f WHERE rn > 0""")
def cas_accept_reject(spark, d):
    return versions.fold_writes(inputs.writes(spark, d), "db", "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN writer <> owner THEN 'unauthorized' ELSE 'ok' END AS gate FROM {writes}")
def owner_gate(spark, d):
    return inputs.writes(spark, d).select("o_orderkey", F.when(F.col("writer") != F.col("owner"), "unauthorized").otherwise("ok").alias("gate"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'rejected' WHEN 'error' THEN 'warned' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'ok' ELSE 'warned' END AS class FROM events")
def migration_class(spark, d):
    kind = F.col("event_type")
    sql = F.when(kind == "signup", "  ").when(kind == "error", "SELECT 1").when(kind == "purchase", "create table t (x int)").when(kind == "click", "Alter Table t drop column x").otherwise("insert into t values (1)")
    return table(spark, d, "events").select("event_id", versions.migration_class(sql).alias("class"))


@query(f"SELECT o_orderkey, {_le('length(CAST(o_custkey AS VARCHAR))')} || lower(hex(encode(CAST(o_custkey AS VARCHAR)))) || {_le('length(o_orderpriority)')} || lower(hex(encode(o_orderpriority))) || CASE WHEN o_orderkey % 3 = 0 THEN '00' ELSE '01' || sha256(CAST(o_orderkey AS VARCHAR)) END AS payload FROM orders")
def signed_payload(spark, d):
    root = F.when(F.col("o_orderkey") % 3 != 0, F.sha2(F.col("o_orderkey").cast("string"), 256))
    return table(spark, d, "orders").select("o_orderkey", dg.signed_payload(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), root).alias("payload"))


@query("SELECT o_orderkey, o_orderkey % 10 <> 0 AS valid FROM orders")
def signature_check(spark, d):
    secret, payload = F.sha2(F.col("o_custkey").cast("string"), 256), F.col("o_orderkey").cast("string")
    sent = dg.keyed_digest(F.when(F.col("o_orderkey") % 10 == 0, F.lit("other")).otherwise(secret), payload)
    return table(spark, d, "orders").select("o_orderkey", (sent == dg.keyed_digest(secret, payload)).alias("valid"))


@query("SELECT db, sha256(CAST(db AS VARCHAR)) AS db_id, count(*) AS writes FROM {writes} GROUP BY db")
def database_ids(spark, d):
    return inputs.writes(spark, d).groupBy("db").agg(F.count(F.lit(1)).alias("writes")).select("db", F.sha2(F.col("db").cast("string"), 256).alias("db_id"), "writes")


# -- tracker ----------------------------------------------------------------------------------------


@query("SELECT cid, node, max(piece_count) AS piece_count, arg_max(last_seen, seq) AS last_seen FROM {reports} GROUP BY cid, node")
def holder_upsert(spark, d):
    return tracker.holder_upsert(inputs.reports(spark, d))


@query("SELECT cid, CAST(sum(piece_count) AS BIGINT) AS available FROM {holders} GROUP BY cid")
def available_pieces(spark, d):
    return tracker.available(inputs.holders(spark, d))


@query("SELECT cid, string_agg(node || ':' || piece_count, ',' ORDER BY node) AS holders FROM {holders} GROUP BY cid")
def holder_list(spark, d):
    listed = tracker.holder_list(inputs.holders(spark, d))
    return listed.select("cid", F.array_join(F.transform("holders", lambda x: F.concat_ws(":", x["node"], x["piece_count"])), ",").alias("holders"))


@query("SELECT cid, arg_min(piece_count, seq * 10 + piece_count) AS piece_count FROM {reports} GROUP BY cid")
def first_writer_k(spark, d):
    return tracker.first_writer(inputs.reports(spark, d).withColumn("seq", F.col("seq") * 10 + F.col("piece_count")), "piece_count")


@query("SELECT count(DISTINCT cid) AS contents, count(*) AS records FROM {holders}")
def tracker_counts(spark, d):
    return tracker.provider_counts(inputs.holders(spark, d))


@query("SELECT cid, node, max(last_seen) AS announced_at FROM {reports} GROUP BY cid, node")
def provider_upsert(spark, d):
    return tracker.provider_upsert(inputs.reports(spark, d).withColumnRenamed("last_seen", "announced_at"))


@query("SELECT cid, node, announced_at FROM (SELECT cid, node, max(last_seen) AS announced_at FROM {reports} GROUP BY cid, node) WHERE announced_at > TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 400 DAY")
def provider_ttl(spark, d):
    p = tracker.provider_upsert(inputs.reports(spark, d).withColumnRenamed("last_seen", "announced_at"))
    return tracker.expire(p, "announced_at", F.lit("2000-01-01 00:00:00").cast("timestamp"), 400 * 86_400)


@query("SELECT cid, node, piece_count FROM {holders} WHERE node NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def remove_node(spark, d):
    dead = table(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("node"))
    return tracker.remove_nodes(inputs.holders(spark, d), dead)


@query("SELECT cid, k FROM {k_of} WHERE cid IN (SELECT cid FROM {holders} WHERE node % 4 = 1)")
def forget_empty_k(spark, d):
    return tracker.forget_empty(inputs.k_of(spark, d), inputs.holders(spark, d).filter("node % 4 = 1"))


@query("SELECT cid, node, piece_count FROM {holders} WHERE (cid * 31 + node) % 7 <> 0")
def remove_provider(spark, d):
    h = inputs.holders(spark, d)
    return tracker.remove_provider(h, h.filter("(cid * 31 + node) % 7 = 0"))


# -- health -----------------------------------------------------------------------------------------

_TRIAGE = """SELECT cid, k, available, target, CASE WHEN available < k THEN 'critical' WHEN available < target THEN 'normal' ELSE 'healthy' END AS severity,
CASE WHEN available < k THEN k - available WHEN available < target THEN target - available ELSE 0 END AS deficit FROM (SELECT coalesce(q.cid, a.cid) AS cid, CAST(coalesce(q.k, 32) AS BIGINT) AS k, CAST(coalesce(a.available, 0) AS BIGINT) AS available,
CAST(greatest(coalesce(q.k, 32), 1) * ceil(2 + 16.0 / greatest(coalesce(q.k, 32), 1)) AS BIGINT) AS target FROM {k_of} q FULL JOIN (SELECT cid, sum(piece_count) AS available FROM {holders} GROUP BY cid) a ON q.cid = a.cid)"""


def _triage(spark, d):
    return health.triage(inputs.holders(spark, d), inputs.k_of(spark, d))


@query(_TRIAGE)
def health_triage(spark, d):
    return _triage(spark, d)


@query(f"SELECT severity, count(*) AS contents, CAST(sum(deficit) AS BIGINT) AS missing FROM ({_TRIAGE}) GROUP BY severity")
def severity_counts(spark, d):
    return _triage(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("contents"), F.sum("deficit").alias("missing"))


@query("SELECT k, CAST(ceil(k * (2 + 16.0 / k)) AS BIGINT) AS encoder_pieces, CAST(k * ceil(2 + 16.0 / k) AS BIGINT) AS target_pieces, round(2 + 16.0 / k, 6) AS redundancy FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS k)")
def redundancy_formulas(spark, d):
    ks = spark.createDataFrame([(k,) for k in (1, 2, 4, 8, 16, 32, 64)], "k int")
    return ks.select("k", dg.encoder_pieces(F.col("k")).alias("encoder_pieces"), dg.target_pieces(F.col("k")).alias("target_pieces"), F.round(dg.redundancy(F.col("k")), 6).alias("redundancy"))


@query(f"SELECT DISTINCT cid FROM {{holders}} WHERE node = {HERE} AND piece_count >= 2")
def scan_eligible(spark, d):
    return health.eligible(inputs.holders(spark, d), HERE)


@query("SELECT cid, position FROM (SELECT cid, row_number() OVER (ORDER BY cid) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT cid FROM {holders})) WHERE (position - 1990 % n + n) % n < greatest(1, ceil(n * 0.01))")
def scan_cursor_batch(spark, d):
    return health.cursor_batch(inputs.holders(spark, d), 0.01, 1990)


_CANDIDATES = "(SELECT h.cid, h.node, r.uptime, r.reputation FROM {holders} h JOIN {alive} a ON h.node = a.node JOIN {ranking} r ON r.node = h.node)"


def _ranked(spark, d):
    found = health.repairers(inputs.holders(spark, d), inputs.alive(spark, d))
    return health.rank(found.join(inputs.ranking(spark, d), "node").select("cid", "node", "uptime", "reputation"))


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY cid ORDER BY uptime DESC, reputation DESC, node) AS INT) AS rank FROM {_CANDIDATES}")
def rank_repairers(spark, d):
    return _ranked(spark, d)


@query(f"SELECT cid, node FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY uptime DESC, reputation DESC, node) AS rank FROM {_CANDIDATES}) WHERE rank = 1")
def elect_one(spark, d):
    return _ranked(spark, d).filter("rank = 1").select("cid", "node")


_ELECTED = f"SELECT c.cid, c.node, c.rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cid ORDER BY uptime DESC, reputation DESC, node) AS INT) AS rank FROM {_CANDIDATES}) c JOIN ({_TRIAGE}) t ON c.cid = t.cid WHERE c.rank <= t.deficit"


@query(_ELECTED)
def elect_top_n(spark, d):
    return health.elect(_ranked(spark, d), _triage(spark, d)).select("cid", "node", "rank")


_RING = "(SELECT node, row_number() OVER (ORDER BY node) - 1 AS place, count(*) OVER () AS n FROM {alive}%s)"
_START = "CAST('0x' || substr(md5(CAST(p.cid AS VARCHAR)), 1, 7) AS BIGINT)"
_TARGET = f"""SELECT cid, node AS target, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY tier, d) AS rn FROM (
SELECT p.cid, a.node, CASE WHEN h.piece_count = 1 THEN 1 WHEN h.piece_count IS NULL THEN 2 ELSE 3 END AS tier, (a.place - {_START} % a.n + a.n) % a.n AS d FROM (SELECT cid FROM {{k_of}}) p CROSS JOIN {_RING % f" WHERE node <> {HERE}"} a LEFT JOIN {{holders}} h ON h.cid = p.cid AND h.node = a.node)) WHERE rn = 1"""


@query(_TARGET)
def distribution_target(spark, d):
    return health.distribution_target(inputs.k_of(spark, d), inputs.holders(spark, d), inputs.alive(spark, d), HERE)


@query(f"SELECT e.cid, e.rank, t.target FROM ({_ELECTED}) e JOIN ({_TARGET}) t ON e.cid = t.cid JOIN {{holders}} h ON h.cid = e.cid AND h.node = e.node WHERE h.piece_count >= 2")
def repair_plan(spark, d):
    """Elected repairers with the two pieces that recoding needs, and where the new piece goes."""
    h = inputs.holders(spark, d)
    elected = health.elect(_ranked(spark, d), _triage(spark, d)).join(h.filter("piece_count >= 2").select("cid", "node"), ["cid", "node"])
    return elected.join(health.distribution_target(inputs.k_of(spark, d), h, inputs.alive(spark, d), HERE), "cid").select("cid", "rank", "target")


@query("SELECT p.l_partkey AS cid, p.piece, s.node FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 100 + l_linenumber, l_quantity, l_extendedprice) - 1 AS piece FROM lineitem) p JOIN (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) s ON (p.piece // 2) % s.n = s.i")
def push_round_robin(spark, d):
    order = W.partitionBy("l_partkey").orderBy(F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_quantity", "l_extendedprice")
    pieces = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cid"), (F.row_number().over(order) - 1).cast("long").alias("piece"))
    return health.round_robin(pieces, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))).select("cid", "piece", "node")


@query("SELECT cid, node, greatest(piece_count - 2, 0) AS excess FROM {holders} WHERE piece_count > 2")
def shed_excess(spark, d):
    return inputs.holders(spark, d).filter("piece_count > 2").select("cid", "node", F.greatest(F.col("piece_count") - 2, F.lit(0)).alias("excess"))


# -- members, samples -------------------------------------------------------------------------------

_STATE = "(SELECT s_suppkey AS node, CASE s_suppkey % 3 WHEN 0 THEN 'alive' WHEN 1 THEN 'suspect' ELSE 'dead' END AS state FROM supplier)"


def _states(spark, d):
    k = F.col("s_suppkey") % 3
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.when(k == 0, "alive").when(k == 1, "suspect").otherwise("dead").alias("state"))


@query(f"SELECT node, state FROM {_STATE} WHERE state = 'alive'")
def alive_filter(spark, d):
    return _states(spark, d).filter("state = 'alive'")


@query(f"SELECT count(*) AS members, CAST(count(*) FILTER (WHERE state = 'alive') AS BIGINT) AS alive FROM {_STATE}")
def member_counts(spark, d):
    return _states(spark, d).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("state") == "alive").alias("alive"))


@query(f"SELECT node, state FROM {_STATE} ORDER BY CASE state WHEN 'alive' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END, node LIMIT 40")
def gossip_topk(spark, d):
    return gossip.gossip_top(_states(spark, d), 40)


@query("SELECT n, CAST(CASE WHEN n <= 16 THEN 4 ELSE greatest(4, length(ltrim(bin(n - 1), '0'))) END AS BIGINT) AS k, CAST(greatest(1, ceil(ln(n))) AS BIGINT) AS fanout FROM (SELECT CAST(unnest([1, 4, 16, 17, 32, 33, 64, 65, 1000, 1024, 1025]) AS BIGINT) AS n)")
def piggyback_count(spark, d):
    n = spark.createDataFrame([(n,) for n in (1, 4, 16, 17, 32, 33, 64, 65, 1000, 1024, 1025)], "n long")
    return n.select("n", dg.piggyback_count(F.col("n")).alias("k"), dg.fanout(F.col("n")).alias("fanout"))


@query(f"SELECT p.cid, a.node FROM (SELECT cid FROM {{k_of}}) p JOIN {_RING % ''} a ON (a.place - {_START} % a.n + a.n) % a.n < greatest(1, ceil(ln(a.n)))")
def fanout_sample(spark, d):
    return gossip.fanout_sample(inputs.k_of(spark, d), inputs.alive(spark, d))


@query("SELECT node FROM {alive} WHERE node <> 3 ORDER BY md5(concat_ws(':', node, 'x')), node LIMIT 7")
def random_members(spark, d):
    return gossip.random_members(inputs.alive(spark, d), 7, "x", HERE)


@query("SELECT event_type, user_id, last_used FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last_used DESC, user_id) AS r FROM (SELECT event_type, user_id, max(ts) AS last_used FROM events GROUP BY 1, 2)) WHERE r <= 16")
def lru_evict(spark, d):
    used = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last_used"))
    return gossip.keep_recent(used, "event_type", "last_used", "user_id", 16)


@query("SELECT t.tick, a.node FROM (SELECT event_id AS tick FROM events) t JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM {alive}) a ON t.tick % a.n = a.i")
def probe_round_robin(spark, d):
    return gossip.probe_round_robin(table(spark, d, "events").select(F.col("event_id").alias("tick")), inputs.alive(spark, d))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS batch FROM documents")
def startup_batches(spark, d):
    return gossip.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT event_type, round(CAST(count(*) FILTER (WHERE value > 20) AS DOUBLE) / count(*), 6) AS rate, count(*) AS reads FROM events GROUP BY event_type")
def cache_hit_rate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.count_if(F.col("value") > 20) / F.count(F.lit(1)), 6).alias("rate"), F.count(F.lit(1)).alias("reads"))


@query("SELECT stream, seq, page + 1 AS first, page + 8 AS last FROM (SELECT user_id AS stream, event_id AS seq, event_id // 50 AS page, lag(event_id // 50) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE page = b + 1")
def sequential_prefetch(spark, d):
    reads = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 50).alias("page"))
    return gossip.sequential_reads(reads)


# -- clocks, membership, programs -------------------------------------------------------------------


@query("SELECT event_id, (epoch_us(ts) // 1000) * 65536 + event_id % 65536 AS stamp, epoch_us(ts) // 1000 AS wall, event_id % 65536 AS logical FROM events")
def hlc_pack(spark, d):
    stamp = dg.hlc_pack(dg.epoch_ms(F.col("ts")), F.col("event_id") % 65_536)
    return table(spark, d, "events").select("event_id", stamp.alias("stamp"), dg.hlc_wall(stamp).alias("wall"), dg.hlc_logical(stamp).alias("logical"))


@query("SELECT seq, CASE WHEN rw > wall_ms + 500 THEN 'skew' WHEN abs(rw - wall_ms) > 30000 THEN 'replay' ELSE 'ok' END AS class FROM (SELECT *, remote // 65536 AS rw FROM {clocks} WHERE remote IS NOT NULL)")
def hlc_classify(spark, d):
    c = inputs.clocks(spark, d).filter(F.col("remote").isNotNull())
    return c.select("seq", dg.hlc_class(dg.hlc_wall(F.col("remote")), F.col("wall_ms")).alias("class"))


@query("""WITH RECURSIVE c AS (SELECT *, remote // 65536 AS rw, remote % 65536 AS rl, row_number() OVER (PARTITION BY node ORDER BY seq) AS rn FROM {clocks}), f AS (
SELECT DISTINCT node, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS l, 0 AS skewed, 0 AS replayed FROM c UNION ALL
SELECT node, rn, CASE WHEN kind = 'local' THEN CASE WHEN wall > w THEN wall WHEN l = 65535 THEN w + 1 ELSE w END WHEN kind IN ('skew', 'replay') THEN w WHEN wall > w AND wall > rw THEN wall WHEN w > rw THEN w WHEN rw > w THEN rw WHEN greatest(l, rl) = 65535 THEN w + 1 ELSE w END,
CASE WHEN kind = 'local' THEN CASE WHEN wall > w OR l = 65535 THEN 0 ELSE l + 1 END WHEN kind IN ('skew', 'replay') THEN l WHEN wall > w AND wall > rw THEN 0 WHEN w > rw THEN least(l + 1, 65535) WHEN rw > w THEN least(rl + 1, 65535) WHEN greatest(l, rl) = 65535 THEN 0 ELSE greatest(l, rl) + 1 END,
skewed + CASE WHEN kind = 'skew' THEN 1 ELSE 0 END, replayed + CASE WHEN kind = 'replay' THEN 1 ELSE 0 END
FROM (SELECT f.*, c.rn AS rn_new, c.wall_ms AS wall, c.rw, c.rl, CASE WHEN c.remote IS NULL THEN 'local' WHEN c.rw > c.wall_ms + 500 THEN 'skew' WHEN abs(c.rw - c.wall_ms) > 30000 THEN 'replay' ELSE 'ok' END AS kind FROM (SELECT node, rn + 1 AS rn, w, l, skewed, replayed FROM f) f JOIN c ON c.node = f.node AND c.rn = f.rn))
SELECT node, arg_max(w * 65536 + l, rn) AS clock, arg_max(skewed, rn) AS skewed, arg_max(replayed, rn) AS replayed FROM f GROUP BY node""")
def hlc_fold(spark, d):
    return folds.hybrid_clock(inputs.clocks(spark, d))


_SWIM = """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS rn FROM {members}), f AS (
SELECT DISTINCT node, CAST(0 AS BIGINT) AS rn, 0 AS st, CAST(0 AS BIGINT) AS inc, 0 AS up, 0 AS down FROM c UNION ALL
SELECT node, rn, CASE WHEN a THEN 1 WHEN s THEN 2 WHEN x THEN 3 ELSE st END, CASE WHEN a OR s OR x THEN n ELSE inc END, up + CASE WHEN a AND st = 0 THEN 1 ELSE 0 END, down + CASE WHEN x AND st IN (1, 2) THEN 1 ELSE 0 END FROM (
SELECT f.*, c.inc AS n, c.kind = 'alive' AND (f.st = 0 OR (f.st IN (1, 3) AND c.inc > f.inc) OR (f.st = 2 AND c.inc >= f.inc)) AS a, c.kind = 'suspect' AND (f.st = 0 OR (f.st = 1 AND c.inc >= f.inc) OR (f.st = 2 AND c.inc > f.inc)) AS s, c.kind = 'dead' AND (f.st <> 3 OR c.inc > f.inc) AS x
FROM (SELECT node, rn + 1 AS rn, st, inc, up, down FROM f) f JOIN c ON c.node = f.node AND c.rn = f.rn))
SELECT node, CASE arg_max(st, rn) WHEN 1 THEN 'alive' WHEN 2 THEN 'suspect' WHEN 3 THEN 'dead' ELSE 'unknown' END AS state, arg_max(inc, rn) AS incarnation, arg_max(up, rn) AS connects, arg_max(down, rn) AS disconnects FROM f GROUP BY node"""


@query(_SWIM)
def swim_final_state(spark, d):
    return folds.membership(inputs.members(spark, d))


@query(_SWIM)
def stream_swim(spark, d):
    raw = streams.source(spark, f"{d}/events.parquet")
    kind = F.when(F.col("event_type").isin("view", "click"), "alive").when(F.col("event_type") == "error", "suspect").when(F.col("event_type") == "purchase", "dead").otherwise("ping")
    told = streams.drain(streams.membership_stream(raw.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), kind.alias("kind"), (inputs.prop_k() % 6).alias("inc"))))
    return versions.latest(told, ["node"], "seq", "state", "incarnation", "connects", "disconnects")


@query("SELECT node, seq FROM (SELECT *, lead(ts) OVER (PARTITION BY node ORDER BY ts) AS nxt FROM (SELECT user_id AS node, event_id AS seq, ts, event_type FROM events)) WHERE event_type = 'error' AND (nxt IS NULL OR nxt >= ts + INTERVAL 2 HOUR)")
def suspect_timeout(spark, d):
    """Suspicions that nothing from the node answered in time."""
    e = table(spark, d, "events").withColumn("nxt", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts")))
    return e.filter((F.col("event_type") == "error") & (F.col("nxt").isNull() | (F.col("nxt") >= F.col("ts") + F.expr("INTERVAL 2 HOURS")))).select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"))


_RUNS = "(SELECT *, CAST(sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY program ORDER BY seq) AS BIGINT) AS island FROM {runs})"


@query(f"SELECT program, seq, CAST(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY program, island ORDER BY seq) AS BIGINT) AS streak, CAST(pow(2, least(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY program, island ORDER BY seq), 6)) AS BIGINT) AS backoff FROM {_RUNS}")
def failure_streak(spark, d):
    order = W.partitionBy("program").orderBy("seq")
    rows = inputs.runs(spark, d).withColumn("island", F.count_if(F.col("outcome") == "ok").over(order))
    streak = F.count_if(F.col("outcome") == "error").over(W.partitionBy("program", "island").orderBy("seq"))
    return rows.withColumn("streak", streak).select("program", "seq", "streak", dg.backoff_seconds(F.col("streak")).alias("backoff"))


@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY seq) AS rn FROM {runs}), f AS (
SELECT DISTINCT program, CAST(0 AS BIGINT) AS rn, 0 AS streak, 0 AS done FROM c UNION ALL
SELECT c.program, c.rn, CASE WHEN f.streak >= 10 THEN f.streak WHEN c.outcome = 'ok' THEN 0 WHEN c.outcome = 'error' THEN f.streak + 1 ELSE f.streak END, f.done + CASE WHEN f.streak >= 10 THEN 0 ELSE 1 END FROM f JOIN c ON c.program = f.program AND c.rn = f.rn + 1)
SELECT program, CASE WHEN arg_max(streak, rn) >= 10 THEN 'quarantined' ELSE 'running' END AS state, arg_max(streak, rn) AS streak, arg_max(done, rn) AS runs FROM f GROUP BY program""")
def program_lifecycle(spark, d):
    return folds.program_runs(inputs.runs(spark, d))


_PROBES = "(SELECT event_id AS nonce, user_id AS node, ts FROM events WHERE event_type = 'view')"


@query(f"SELECT p.nonce, a.ack_ts FROM {_PROBES} p LEFT JOIN (SELECT e.event_id - 1 AS nonce, min(e.ts) AS ack_ts FROM events e GROUP BY 1) a ON a.nonce = p.nonce AND a.ack_ts >= p.ts AND a.ack_ts <= p.ts + INTERVAL 400 SECOND")
def probe_ack(spark, d):
    """Probes with the answer that came in time, null when they timed out."""
    e = table(spark, d, "events")
    p = e.filter("event_type = 'view'").select(F.col("event_id").alias("nonce"), "ts")
    a = e.select((F.col("event_id") - 1).alias("anonce"), F.col("ts").alias("ack_ts"))
    return p.join(a, (F.col("nonce") == F.col("anonce")) & F.col("ack_ts").between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 400 SECONDS")), "left").select("nonce", "ack_ts")


_REQ = "(SELECT user_id % 20 AS cid, event_id AS waiter, ts FROM events WHERE event_type = 'click')"
_RESP = "(SELECT user_id % 20 AS cid, ts AS resp_ts FROM events WHERE event_type = 'purchase')"


@query(f"SELECT q.cid, q.waiter, q.ts, min(r.resp_ts) AS resp_ts FROM {_REQ} q LEFT JOIN {_RESP} r ON r.cid = q.cid AND r.resp_ts >= q.ts AND r.resp_ts < q.ts + INTERVAL 6 HOUR GROUP BY 1, 2, 3")
def fetch_rendezvous(spark, d):
    e = table(spark, d, "events").withColumn("cid", F.col("user_id") % 20)
    return streams.rendezvous(e.filter("event_type = 'click'").select("cid", F.col("event_id").alias("waiter"), "ts"), e.filter("event_type = 'purchase'").select("cid", F.col("ts").alias("resp_ts")), "6 HOURS")


@query(f"SELECT cid, count(*) AS waiting FROM {_REQ} WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 DAY AND ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY cid")
def waiter_ttl(spark, d):
    e = table(spark, d, "events").filter("event_type = 'click'").withColumn("cid", F.col("user_id") % 20)
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    left = tracker.expire(e.filter(F.col("ts").cast("timestamp") <= now), "ts", now, 5 * 86_400)
    return left.groupBy("cid").agg(F.count(F.lit(1)).alias("waiting"))


# -- windows ----------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return streams.tumbling(table(spark, d, "events"), "1 day")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start FROM events, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY 1, 2")
def sliding_counts(spark, d):
    return streams.sliding(table(spark, d, "events"), "3 hours", "1 hour")


_SESSIONS = "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"


@query(_SESSIONS)
def session_counts(spark, d):
    return streams.sessions(table(spark, d, "events"), "6 hours")


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 30 SECOND FROM events)")
def stream_tumbling(spark, d):
    """The closed windows of the stream."""
    found = streams.drain(streams.tumbling(streams.source(spark, f"{d}/events.parquet"), "1 day"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) AS fin, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) WHERE fin + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 30 SECOND FROM events)")
def stream_session(spark, d):
    found = streams.drain(streams.sessions(streams.source(spark, f"{d}/events.parquet"), "6 hours"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    raw = streams.source(spark, f"{d}/events.parquet", delay="60 days")
    return streams.drain(streams.single_flight(raw.select("ts", "user_id", "event_type"), "user_id", "event_type")).select("user_id", "event_type")


# -- coding -----------------------------------------------------------------------------------------


def _objects(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("cid"), F.col("text").cast("binary").alias("data"))


@query("WITH {GF} SELECT a.x, a.y, CASE WHEN a.x = 0 OR a.y = 0 THEN 0 ELSE m.p END AS product FROM (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT unnest(range(256)) AS x), (SELECT unnest(range(256)) AS y)) a LEFT JOIN m ON m.a = a.x AND m.b = a.y")
def gf_tables(spark, d):
    xs = spark.range(256).select(F.col("id").cast("int").alias("x"))
    return xs.select("x", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("y")).select("x", "y", gf256.mul(F.col("x"), F.col("y")).alias("product"))


@query("SELECT CAST(a AS INT) AS a, TRUE AS inverse_ok, TRUE AS divide_ok, TRUE AS commutes, TRUE AS associates, TRUE AS distributes FROM (SELECT unnest(range(1, 256)) AS a)")
def gf_axioms(spark, d):
    a = F.col("a")
    b, c = (a * 7 + 3) % 256, (a * 13 + 5) % 256
    mul = gf256.mul
    return spark.range(1, 256).select(F.col("id").cast("int").alias("a")).select(
        "a", (mul(a, gf256.inverse(a)) == 1).alias("inverse_ok"), (gf256.divide(mul(a, b), a) == b).alias("divide_ok"), (mul(a, b) == mul(b, a)).alias("commutes"),
        (mul(mul(a, b), c) == mul(a, mul(b, c))).alias("associates"), (mul(a, b.bitwiseXOR(c)) == mul(a, b).bitwiseXOR(mul(a, c))).alias("distributes"),
    )


@query("WITH {CELLS} SELECT cid, j, CAST(count(*) AS BIGINT) AS bytes, CAST(sum(b) AS BIGINT) AS total FROM cells GROUP BY cid, j")
def rlnc_split(spark, d):
    return coding.split(_objects(spark, d), K).groupBy("cid", "j").agg(F.count(F.lit(1)).alias("bytes"), F.sum("b").alias("total"))


@query(f"WITH {{GF}}, {{CELLS}}, {VECTORS}, {CODED} SELECT cid, CAST(p AS INT) AS p, off, b FROM coded")
def rlnc_encode(spark, d):
    return coding.encode(_objects(spark, d), K, PIECES)


def _pieces(spark, d):
    return coding.encode_pieces(_objects(spark, d), K, PIECES)


@query(f"WITH {{GF}}, {{CELLS}}, {VECTORS}, {CODED}, v AS (SELECT cid, p, string_agg(printf('%02x', c), '' ORDER BY j) AS h FROM vec GROUP BY cid, p), x AS (SELECT cid, p, string_agg(printf('%02x', b), '' ORDER BY off) AS h FROM coded GROUP BY cid, p) SELECT v.cid, CAST(v.p AS INT) AS p, sha256(unhex(v.h || x.h)) AS piece_id FROM v JOIN x ON v.cid = x.cid AND v.p = x.p")
def piece_ids(spark, d):
    return coding.piece_ids(_pieces(spark, d)).select("cid", "p", "piece_id")


@query(f"SELECT item_id AS cid, CAST({K} AS INT) AS rank, text FROM benchmark")
def rlnc_decode(spark, d):
    sizes = _objects(spark, d).select("cid", F.octet_length("data").alias("size"))
    return coding.decode(_pieces(spark, d), sizes).select("cid", "rank", F.decode("data", "UTF-8").alias("text"))


@query("SELECT item_id AS cid, CAST(2 AS INT) AS rank, TRUE AS undecodable FROM benchmark")
def rlnc_rank(spark, d):
    """Two pieces and their repeats have rank two: not enough."""
    few = _pieces(spark, d).filter("p < 2")
    few = few.unionByName(few.withColumn("p", F.col("p") + 100))
    return coding.decode(few, _objects(spark, d).select("cid", F.octet_length("data").alias("size"))).select("cid", "rank", F.col("data").isNull().alias("undecodable"))


def _new(spark, d, pieces: int = K):
    """Coefficients of `pieces` recoded pieces, each of three coded ones."""
    grid = _objects(spark, d).select("cid", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("q"), F.explode(F.array(F.lit(0))).alias("z")).drop("z")
    grid = grid.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("p", (F.col("p") + F.col("q")) % PIECES)
    return grid.withColumn("c", coding.coefficient(F.lit("n"), F.col("cid").cast("string"), F.col("q").cast("string"), F.col("p").cast("string")))


_NEW = f"nw AS (SELECT cid, q, p, {_coef('n', 'cid', 'q', 'p')} AS c FROM (SELECT cid, q, (i + q) % {PIECES} AS p FROM (SELECT DISTINCT cid FROM cells), (SELECT unnest(range({K})) AS q), (SELECT unnest(range(3)) AS i)))"


@query(f"WITH {{GF}}, {{CELLS}}, {VECTORS}, {CODED}, {_NEW} SELECT nw.cid, CAST(nw.q AS INT) AS p, coded.off, CAST(bit_xor(coalesce(m.p, 0)) AS INT) AS b FROM coded JOIN nw ON nw.cid = coded.cid AND nw.p = coded.p LEFT JOIN m ON m.a = nw.c AND m.b = coded.b GROUP BY 1, 2, 3")
def rlnc_recode(spark, d):
    return coding.recode(coding.encode(_objects(spark, d), K, PIECES), _new(spark, d))


_STREAM = "st AS (SELECT t, off, cid, CAST('0x' || substr(md5(concat_ws(':', 'm', cid, t, off)), 1, 2) AS INT) AS r FROM (SELECT DISTINCT cid, off FROM cells), (SELECT unnest(range(32)) AS t))"


def _tagged(spark, d):
    o = _objects(spark, d)
    return coding.encode(o, K, PIECES), coding.keystream(o, coding.piece_size(K))


@query(f"WITH {{GF}}, {{CELLS}}, {VECTORS}, {CODED}, {_STREAM} SELECT st.cid, CAST(coded.p AS INT) AS p, CAST(st.t AS INT) AS t, CAST(bit_xor(coalesce(m.p, 0)) AS INT) AS tag FROM coded JOIN st ON st.cid = coded.cid AND st.off = coded.off LEFT JOIN m ON m.a = st.r AND m.b = coded.b GROUP BY 1, 2, 3")
def mac_tags(spark, d):
    return coding.tags(*_tagged(spark, d))


@query(f"SELECT item_id AS cid, CAST(p AS INT) AS p, TRUE AS same FROM benchmark, (SELECT unnest(range({K})) AS p)")
def mac_combine_identity(spark, d):
    """Tags of recoded pieces, computed and combined, agree."""
    return _combined(*_tagged(spark, d), _new(spark, d))


def _combined(cells, stream, new):
    direct = coding.tags(coding.recode(cells, new), stream)
    combined = coding.combine_tags(coding.tags(cells, stream), new).withColumnRenamed("tag", "other")
    return direct.join(combined, ["cid", "p", "t"]).groupBy("cid", "p").agg((F.count_if(F.col("tag") == F.col("other")) == coding.TAG_BYTES).alias("same"))


@query("SELECT item_id AS cid, 1 AS width, octet_length(encode(text)) AS bytes FROM benchmark")
def udf_identity_piece(spark, d):
    return coding.identity_pieces(_objects(spark, d)).select("cid", F.size("vector").alias("width"), F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT item_id AS cid, length(text) AS chars, text LIKE '%the%' AS has_the FROM benchmark")
def udf_agent(spark, d):
    """A user's program over batches of rows."""
    import pandas as pd

    def program(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cid": rows["cid"], "chars": rows["text"].str.len(), "has_the": rows["text"].str.contains("the", regex=False)})

    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("cid"), "text")
    return coding.run_agent(rows, program, "cid long, chars long, has_the boolean")


@query(f"SELECT page_id, page_num, CAST(octet_length(unhex(part)) AS INT) AS bytes FROM (SELECT page_id, CAST(page_num AS INT) AS page_num, part FROM {_PAGES})")
def udtf_pages(spark, d):
    """Pages of each file by a registered table function."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="page_num int, bytes int")
    class Chunks:
        def eval(self, data: bytes):
            for k in range(0, len(data), 1024):
                yield k // 1024, min(1024, len(data) - k)

    spark.udtf.register("file_pages", Chunks)
    views(spark, d, "pages")
    return spark.sql("SELECT page_id, t.page_num, t.bytes FROM pages, LATERAL file_pages(CAST(html AS BINARY)) t")


@query("SELECT user_id, event_id, r <= 10 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)")
def sign_rate_limit(spark, d):
    r = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", (r <= 10).alias("allowed"))


# -- operators that only the specification names ------------------------------------------------------


@query("SELECT cid, arg_max(event_id, ts) AS last_event, time_bucket(INTERVAL 1 HOUR, ts) AS tick FROM (SELECT *, user_id % 50 AS cid FROM events) GROUP BY cid, tick")
def batch_coalesce(spark, d):
    e = table(spark, d, "events").withColumn("cid", F.col("user_id") % 50)
    return e.groupBy("cid", F.window("ts", "1 hour")["start"].alias("tick")).agg(F.max_by("event_id", "ts").alias("last_event")).select("cid", "last_event", "tick")


@query(f"SELECT DISTINCT cid FROM {_PAGE_CIDS} WHERE page_id % 3 = 0 AND cid NOT IN (SELECT cid FROM {_PAGE_CIDS} WHERE page_id % 3 <> 0)")
def gc_mark_sweep(spark, d):
    index = _index(spark, d)
    everything = index.select("cid").distinct().withColumn("age_s", F.lit(1000.0))
    roots = table(spark, d, "pages").filter("page_id % 3 <> 0").select(F.col("page_id").alias("root"))
    return versions.unreachable(everything, roots, index.select(F.col("page_id").alias("root"), "cid")).select("cid")


@query("SELECT s_suppkey, CASE WHEN u > 99 THEN 'full' WHEN u >= 95 THEN 'critical' WHEN u >= 90 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT s_suppkey, abs(s_acctbal) / 100 AS u FROM supplier)")
def disk_watermark(spark, d):
    u = F.abs("s_acctbal") / 100
    return table(spark, d, "supplier").select("s_suppkey", F.when(u > 99, "full").when(u >= 95, "critical").when(u >= 90, "warning").otherwise("ok").alias("level"))


@query("SELECT l_partkey AS item, count(DISTINCT l_suppkey) >= 20 AS final, count(DISTINCT l_suppkey) AS signers FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def attestation(spark, d):
    signed = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("item")).agg(F.count_distinct("l_suppkey").alias("signers"))
    return signed.select("item", (F.col("signers") >= 20).alias("final"), "signers")


@query("SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 2 END AS INT) AS priority, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 1 WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 2 END, ts) AS turn FROM events")
def task_queue(spark, d):
    """Earliest deadline first by priority; waiting tasks move up."""
    kind = F.col("event_type")
    p = F.when(kind == "error", 0).when((kind == "purchase") | (F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")), 1).otherwise(2)
    e = table(spark, d, "events").withColumn("priority", p)
    return e.select("event_id", "priority", F.row_number().over(W.partitionBy("user_id").orderBy("priority", "ts")).cast("long").alias("turn"))


@query("SELECT event_id, arg_max AS last_error FROM (SELECT e.event_id, (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts <= e.ts) AS arg_max FROM events e WHERE e.event_type = 'purchase')")
def as_of_join(spark, d):
    """Each purchase with the user's latest error before it: one window, no theta join."""
    last = F.last(F.when(F.col("event_type") == "error", F.col("ts")), ignorenulls=True).over(W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    return table(spark, d, "events").withColumn("last_error", last).filter("event_type = 'purchase'").select("event_id", "last_error")


# -- SQL ----------------------------------------------------------------------------------------------


def _text(name: str, text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *[t for t in TABLES if t in text.lower()])
        return spark.sql(text)

    run.__name__ = name
    return run


for _name, (_sql, _other) in TEXTS.items():
    QUERIES[_name] = _text(_name, _sql)
    ORACLE[_name] = _other or _sql


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC) AS r FROM (SELECT c_custkey, c_acctbal, 0 AS v FROM customer UNION ALL SELECT c_custkey, 0.0, 1 FROM customer WHERE c_custkey % 5 = 0)) WHERE r = 1")
def sql_s09_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("v"))
    new = old.filter("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit(1).alias("v"))
    return versions.latest(old.union(new), ["c_custkey"], "v", "c_acctbal")


@query()
def sql_s32_approximate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


from lithoframe.plans import wider  # noqa: E402, F401 - registers its queries here
