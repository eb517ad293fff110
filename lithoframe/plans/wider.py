"""More of the catalog: statements that write, jobs, frames, scores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lithoframe.functions import digests as dg
from lithoframe.operators import coding, gossip, jobs, objects, reputation, tracker, versions, wire
from lithoframe.operators.database import Conflict, Database, Unauthorized
from lithoframe.plans import inputs
from lithoframe.plans.catalog import CODED, GF, HERE, PIECES, VECTORS, K, _coef, _index, _objects, _PAGE_CIDS, _pages, _pieces, _store, query
from lithoframe.session import shared_folder, table, views
from lithoframe.streaming import streams


def _folder(spark, kind):
    return f"{shared_folder(spark)}/lithoframe/{kind}-{uuid.uuid4().hex}"


# -- objects, pages, providers ----------------------------------------------------------------------


@query("SELECT DISTINCT sha256(text) AS cid FROM documents")
def list_cids(spark, d):
    """Ids among the names of a store's files; those of other files are skipped."""
    names = _store(spark, d).select(F.upper("cid").alias("name")).union(table(spark, d, "pages").select("url"))
    return objects.list_cids(names)


@query("SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN -2 WHEN doc_id % 5 = 0 THEN -1 ELSE octet_length(encode(text)) END AS code FROM documents")
def host_store_get(spark, d):
    docs = table(spark, d, "documents")
    cid, i = dg.cid(F.col("text")), F.col("doc_id")
    asked = docs.select("doc_id", F.when(i % 7 == 0, F.substring(cid, 1, 60)).when(i % 5 == 0, F.reverse(cid)).otherwise(cid).alias("name"))
    return objects.get_codes(_store(spark, d), asked.select("name").distinct()).join(asked, "name").select(F.col("doc_id").alias("name"), "code")


@query("SELECT DISTINCT sha256(text) AS cid FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src1')")
def piece_exclusion(spark, d):
    pieces = table(spark, d, "documents").filter("source = 'src1'").select(dg.cid(F.col("text")).alias("piece_id"))
    return objects.not_pieces(_store(spark, d).select("cid"), pieces)


@query("SELECT (SELECT count(*) FROM documents) AS puts, (SELECT count(DISTINCT text) FROM documents) AS objects, (SELECT count(*) FROM benchmark) AS gets, (SELECT count(*) FROM benchmark WHERE text IN (SELECT text FROM documents)) AS hits, (SELECT count(*) FROM benchmark WHERE text NOT IN (SELECT text FROM documents)) AS misses")
def store_counters(spark, d):
    """Counted as the rows pass, without a pass of their own."""
    one = F.count(F.lit(1))
    given, puts = objects.counters(table(spark, d, "documents").select(F.col("text").alias("data")), "puts", puts=one)
    store, kept = objects.counters(objects.put(given), "kept", objects=one)
    at = _folder(spark, "counted")
    store.write.parquet(at)
    asked = objects.contains(spark.read.parquet(at), table(spark, d, "benchmark").select("item_id", dg.cid(F.col("text")).alias("cid")))
    told, reads = objects.counters(asked, "reads", gets=one, hits=F.count_if("present"), misses=F.count_if(~F.col("present")))
    told.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(*puts.get.values(), *kept.get.values(), *(reads.get[c] for c in ("gets", "hits", "misses")))], "puts long, objects long, gets long, hits long, misses long")


@query(f"SELECT page_id, page_num, cid, TRUE AS found FROM {_PAGE_CIDS} WHERE page_num <= 1 UNION ALL SELECT page_id, 1 AS page_num, NULL AS cid, FALSE AS found FROM pages WHERE octet_length(encode(html)) <= 1024")
def page_read(spark, d):
    store = versions.checked_pages(_pages(spark, d), 1024).select(dg.cid(F.col("data")).alias("cid"), "data").dropDuplicates(["cid"])
    asked = table(spark, d, "pages").select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_num"))
    got = versions.read_pages(_index(spark, d), store, asked, ("page_id", "page_num"))
    return got.select("page_id", "page_num", "cid", F.coalesce(dg.verify(F.col("data"), F.col("cid")), F.lit(False)).alias("found"))


@query("SELECT cid, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM {reports} GROUP BY cid")
def provider_lists(spark, d):
    return tracker.provider_list(inputs.reports(spark, d)).select("cid", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query("SELECT count(DISTINCT user_id % 20) AS contents, count(*) AS waiters FROM events WHERE event_type = 'click'")
def waiter_counts(spark, d):
    return tracker.waiting(table(spark, d, "events").filter("event_type = 'click'").select((F.col("user_id") % 20).alias("cid")))


@query("SELECT cid, node, piece_count FROM (SELECT cid, node, max(piece_count) AS piece_count, arg_max(last_seen, seq) AS last_seen FROM {reports} GROUP BY cid, node) WHERE last_seen > TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 500 DAY")
def holder_ttl(spark, d):
    return tracker.expire(tracker.holder_upsert(inputs.reports(spark, d)), "last_seen", F.lit("2000-01-01 00:00:00").cast("timestamp"), 500 * 86_400).select("cid", "node", "piece_count")


@query("SELECT node, last_used FROM (SELECT user_id AS node, max(ts) AS last_used FROM events GROUP BY 1) WHERE last_used > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def connection_ttl(spark, d):
    """Connections used within six hours of the last event: a lookup keeps the last use of each."""
    used = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.max("ts").alias("last_used"))
    now = used.agg(F.max("last_used").alias("now"))
    return tracker.expire(used.join(F.broadcast(now)), "last_used", F.col("now"), 6 * 3600).select("node", "last_used")  # one row


@query("SELECT program, runs, CAST(sum(1) OVER () AS BIGINT) AS programs FROM (SELECT program, count(*) AS runs FROM {runs} GROUP BY program)")
def program_list(spark, d):
    listed = inputs.runs(spark, d).groupBy("program").agg(F.count(F.lit(1)).alias("runs"))
    return listed.join(F.broadcast(listed.agg(F.count(F.lit(1)).alias("programs")))).orderBy("program")  # one row


@query("SELECT page_id, page_num, last_used FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY last_used DESC, page_num) AS r FROM (SELECT user_id % 10 AS page_id, event_id % 97 AS page_num, max(ts) AS last_used FROM events GROUP BY 1, 2)) WHERE r <= 32")
def page_cache(spark, d):
    """Pages that a cache of 32 keeps for each root: keyed by root and page, least recently used out."""
    used = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("page_id"), (F.col("event_id") % 97).alias("page_num")).agg(F.max("ts").alias("last_used"))
    return gossip.keep_recent(used, "page_id", "last_used", "page_num", 32)


# -- messages -----------------------------------------------------------------------------------------

_NAMES = [n for n in wire.TAGS if not n.startswith("Rpc")]
_NAME = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_TAG = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN {wire.TAGS[n]}" for i, n in enumerate(_NAMES)) + " END"


def _named(spark, d):
    return table(spark, d, "events").withColumn("name", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 13 + 1).cast("int")))


@query(f"SELECT event_id, {_NAME} AS name, {_TAG} AS tag, event_id % 13 >= 7 AS membership FROM events")
def message_class(spark, d):
    return _named(spark, d).select("event_id", "name", wire.tag_of(F.col("name")).alias("tag"), wire.is_membership(F.col("name")).alias("membership"))


_PAYLOAD = "lower(hex(encode(props)))"


@query(f"SELECT event_id, printf('%08x', {_TAG}) || '01' || printf('%016x', (epoch_us(ts) // 1000) * 65536) || printf('%08x', octet_length(encode(props))) || {_PAYLOAD} AS frame FROM events")
def wire_encode(spark, d):
    payload, stamp = F.lower(F.hex(F.col("props").cast("binary"))), dg.hlc_pack(dg.epoch_ms(F.col("ts")), F.lit(0))
    return _named(spark, d).select("event_id", wire.frame(wire.tag_of(F.col("name")), stamp, payload).alias("frame"))


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'truncated' WHEN 2 THEN 'version' WHEN 3 THEN 'short' END AS error, CASE WHEN event_id % 5 IN (0, 4) THEN {_TAG} END AS tag,
CASE event_id % 5 WHEN 0 THEN (epoch_us(ts) // 1000) * 65536 WHEN 4 THEN 0 END AS stamp, CASE WHEN event_id % 5 IN (0, 4) THEN {_PAYLOAD} END AS payload FROM events""")
def wire_decode(spark, d):
    """Frames of both versions, cut ones, short ones and those of another version."""
    payload, stamp = F.lower(F.hex(F.col("props").cast("binary"))), dg.hlc_pack(dg.epoch_ms(F.col("ts")), F.lit(0))
    tag, i = wire.tag_of(F.col("name")), F.col("event_id") % 5
    whole = wire.frame(tag, stamp, payload)
    sent = F.when(i == 0, F.concat(whole, F.lit("ff"))).when(i == 1, F.expr("substring(w, 1, length(w) - 2)")).when(i == 2, F.concat(F.substring("w", 1, 8), F.lit("02"), F.expr("substring(w, 11)"))).when(i == 3, F.substring("w", 1, 16)).otherwise(wire.frame(tag, stamp, payload, 0))
    rows = _named(spark, d).withColumn("w", whole).select("event_id", wire.parse(sent).alias("p"))
    return rows.select("event_id", "p.error", "p.tag", "p.stamp", "p.payload")


@query("SELECT handler, event_type, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'view' THEN 'announce' WHEN 'purchase' THEN 'encode' WHEN 'error' THEN 'remove_node' END AS handler FROM events) WHERE handler IS NOT NULL GROUP BY 1, 2")
def event_route(spark, d):
    """A stream's batches dispatched by type; types without a handler are ignored."""
    at = _folder(spark, "routed")
    handle = lambda name: lambda batch: batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("handler", F.lit(name)).write.mode("append").parquet(at)
    handlers = {"view": handle("announce"), "purchase": handle("encode"), "error": handle("remove_node")}
    raw = streams.source(spark, f"{d}/events.parquet").select("event_type")
    streams.route(raw, handlers).option("checkpointLocation", f"{at}-state").start().awaitTermination()
    return spark.read.schema("event_type string, n long, handler string").parquet(at).groupBy("handler", "event_type").agg(F.sum("n").alias("n"))


@query("SELECT cid, node, max(piece_count) AS piece_count, max(last_seen) AS last_seen FROM {reports} GROUP BY cid, node")
def health_ingest(spark, d):
    """Reports as a stream: each batch's holders are upserted; the largest count and the last time stand."""
    raw = streams.source(spark, f"{d}/lineitem.parquet", "l_shipdate")
    told = raw.select(F.col("l_partkey").alias("cid"), F.col("l_suppkey").alias("node"), F.floor(F.col("l_quantity") / 10).cast("int").alias("piece_count"), F.col("l_shipdate").alias("last_seen"))
    held = streams.ingest_holders(told)
    return held.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


_HLC = "FROM (SELECT *, remote // 65536 AS rw FROM {clocks} WHERE remote IS NOT NULL)"


@query(f"SELECT seq, CASE WHEN remote <> 0 AND rw > wall_ms + 500 THEN 'skew' WHEN remote <> 0 AND abs(rw - wall_ms) > 30000 THEN 'replay' END AS rejected FROM (SELECT seq, wall_ms, CASE WHEN seq % 9 = 0 THEN 0 ELSE remote END AS remote, CASE WHEN seq % 9 = 0 THEN 0 ELSE rw END AS rw {_HLC})")
def hlc_drop(spark, d):
    """Messages with the reason they are dropped for, null if they pass; a stamp of 0 always does."""
    c = inputs.clocks(spark, d).filter(F.col("remote").isNotNull()).withColumn("remote", F.when(F.col("seq") % 9 == 0, F.lit(0).cast("long")).otherwise(F.col("remote")))
    return c.select("seq", dg.hlc_rejected(F.col("remote"), F.col("wall_ms")).alias("rejected"))


# -- coding ---------------------------------------------------------------------------------------------


@query(f"SELECT item_id AS cid, CAST({K} AS INT) AS rank, TRUE AS same FROM benchmark")
def rlnc_recode_decode(spark, d):
    """Recoded pieces, without the original ones, decode to the object: full rank is demanded."""
    o = _objects(spark, d)
    told = coding.decode(coding.recode_pieces(_pieces(spark, d), K + 3), o.select("cid", F.octet_length("data").alias("size")))
    return told.join(o.withColumnRenamed("data", "want"), "cid").select("cid", "rank", (F.col("data") == F.col("want")).alias("same"))


@query(f"SELECT item_id AS cid, CAST({K} AS INT) AS rank, TRUE AS same FROM benchmark")
def rlnc_decode_malformed(spark, d):
    """Pieces of another length are skipped."""
    o, p = _objects(spark, d), _pieces(spark, d)
    bad = p.filter("p = 0").withColumn("p", F.lit(-1)).withColumn("data", F.concat("data", F.lit(b"x")))
    told = coding.decode(p.unionByName(bad), o.select("cid", F.octet_length("data").alias("size")))
    return told.join(o.withColumnRenamed("data", "want"), "cid").select("cid", "rank", (F.col("data") == F.col("want")).alias("same"))


@query(f"SELECT item_id AS cid, CAST(p AS INT) AS p, p <> 2 AS valid FROM benchmark, (SELECT unnest(range({PIECES})) AS p)")
def mac_verify(spark, d):
    """Tags of all pieces; those of piece 2 were made for another."""
    o = _objects(spark, d)
    cells, stream = coding.encode(o, K, PIECES), coding.keystream(o, coding.piece_size(K))
    tags = coding.tags(cells, stream)
    return coding.verify_tags(cells, stream, tags.withColumn("tag", F.when((F.col("p") == 2) & (F.col("t") == 5), F.col("tag").bitwiseXOR(F.lit(1))).otherwise(F.col("tag"))))


_PROOF = f"WITH {GF}, cells AS (SELECT item_id AS cid FROM benchmark), {VECTORS}, x AS (SELECT vec.cid, vec.p, CAST(bit_xor(m.p) AS INT) AS proof FROM (SELECT *, {_coef('c', 'cid', 'j')} AS r FROM vec) vec JOIN m ON m.a = vec.c AND m.b = vec.r GROUP BY 1, 2)"


@query(f"{_PROOF} SELECT cid, CAST(p AS INT) AS p, proof, p <> 3 AS holds FROM x".replace("{", "{{").replace("}", "}}"))
def possession_receipts(spark, d):
    """Proofs that nodes hold pieces; that of piece 3 is wrong."""
    pieces = _pieces(spark, d)
    proofs = coding.possession_proofs(pieces)
    claims = proofs.withColumn("proof", F.when(F.col("p") == 3, F.col("proof").bitwiseXOR(F.lit(7))).otherwise(F.col("proof")))
    return coding.possession(pieces, claims).join(proofs, ["cid", "p"]).select("cid", "p", "proof", "holds")


@query(f"SELECT item_id AS cid, CAST({2 * K + 16} AS BIGINT) AS pieces, CAST({2 * K + 16} AS BIGINT) AS indexed, CAST({2 * K + 16} AS INT) AS piece_count, CAST({HERE} AS INT) AS node FROM benchmark WHERE item_id % 4 <> 0")
def encode_job(spark, d):
    """New contents coded, indexed and recorded; every fourth item is itself a piece and isn't coded again."""
    o = _objects(spark, d)
    by_id = o.select(dg.cid(F.col("data")).alias("cid"), "data", F.col("cid").alias("item"))
    made = jobs.encode_job(by_id.select("cid", "data"), by_id.filter("item % 4 = 0").select(F.col("cid").alias("piece_id")), K, HERE)
    pieces = made["pieces"].groupBy("cid").agg(F.count_distinct("p").alias("pieces"))
    index = made["index"].groupBy("cid").agg(F.count(F.lit(1)).alias("indexed"))
    told = pieces.join(index, "cid").join(made["holders"], "cid").join(by_id.select("cid", "item"), "cid")
    return told.select(F.col("item").alias("cid"), "pieces", "indexed", "piece_count", "node")


@query(f"""SELECT b.item_id AS cid, CAST(s.node AS BIGINT) AS node, CAST(row_number() OVER (PARTITION BY b.item_id ORDER BY r.uptime DESC, r.reputation DESC, s.node) AS INT) AS rank, TRUE AS in_span
FROM benchmark b, (SELECT unnest([1, 2, 4]) AS node) s JOIN {{ranking}} r ON r.node = s.node""")
def repair_job(spark, d):
    """Six pieces of each content lie with nodes 1, 2 and 4, two each; its three holders make a new one each. Each new
    piece is a combination of the stored ones: with them the rank stays K."""
    at = _folder(spark, "pieces")
    _pieces(spark, d).write.parquet(at)
    pieces = spark.read.parquet(at)
    stored = pieces.withColumn("node", F.element_at(F.array(*[F.lit(n).cast("long") for n in (1, 2, 4)]), (F.col("p") % 3 + 1)))
    k_of = _objects(spark, d).select("cid", F.lit(K).alias("k"))
    made = jobs.repair_job(stored, k_of, inputs.alive(spark, d), inputs.ranking(spark, d), HERE)
    one = F.concat_ws("/", F.col("cid").cast("string"), F.col("node").cast("string"))
    both = pieces.join(made.select("cid", "node"), "cid").select(one.alias("cid"), "p", "vector", "data").union(made.select(one, F.lit(100), "vector", "data"))
    ranks = coding.decode(both, both.select("cid").distinct().withColumn("size", F.lit(1))).select(F.col("cid").alias("key"), (F.col("rank") == K).alias("in_span"))
    return made.withColumn("key", one).join(ranks, "key").select("cid", "node", "rank", "in_span")


# -- peers ------------------------------------------------------------------------------------------------

_PEERS = "(SELECT user_id AS node, event_id AS seq, epoch_us(ts) / 1e6 AS tm, event_type AS kind FROM events)"


def _peers(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").alias("kind"))


def _fold(start: str, columns: str, step: str, told: str) -> str:
    """A fold over each peer's events, in order, as a recursion."""
    return f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY tm, seq) AS rn FROM {_PEERS}), f AS (SELECT DISTINCT node, CAST(0 AS BIGINT) AS rn, {start} FROM c
UNION ALL SELECT node, rn, {columns} FROM (SELECT c.node, c.rn, {step} FROM f JOIN c ON c.node = f.node AND c.rn = f.rn + 1)) SELECT node, {told} FROM f GROUP BY node"""


@query(_fold(
    "CAST(0 AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS tm, 0 AS failed, FALSE AS banned", "s, t, q, b OR s >= 100 OR q >= 3",
    "f.score * pow(0.98, coalesce((c.tm - f.tm) / 3600, 0)) + CASE c.kind WHEN 'error' THEN 50 WHEN 'signup' THEN 25 WHEN 'click' THEN 5 ELSE 0 END AS s, c.tm AS t, CASE c.kind WHEN 'purchase' THEN f.failed + 1 WHEN 'view' THEN 0 ELSE f.failed END AS q, f.banned AS b",
    "round(arg_max(score, rn), 6) AS score, arg_max(banned, rn) AS banned",
))
def ban_score(spark, d):
    kinds = {"error": "corrupt", "signup": "protocol", "click": "spam", "purchase": "parole_failed", "view": "parole_passed"}
    e = _peers(spark, d).withColumn("kind", F.element_at(F.create_map(*[F.lit(x) for item in kinds.items() for x in item]), F.col("kind")))
    return reputation.ban_scores(e).select("node", F.round("score", 6).alias("score"), "banned")


@query(_fold("CAST(0.5 AS DOUBLE) AS r, CAST(NULL AS DOUBLE) AS tm", "least(greatest(x, 0), 1), t", "0.5 + (f.r - 0.5) * pow(0.99, coalesce((c.tm - f.tm) / 3600, 0)) + CASE WHEN c.kind <> 'error' THEN 0.05 ELSE -0.05 END AS x, c.tm AS t", "round(arg_max(r, rn), 6) AS reliability"))
def reliability_score(spark, d):
    return reputation.reliability(_peers(spark, d).withColumn("ok", F.col("kind") != "error")).select("node", F.round("reliability", 6).alias("reliability"))


@query(_fold(
    "0 AS st, CAST(0 AS DOUBLE) AS since, CAST([] AS DOUBLE[]) AS fails, 0 AS opened, 0 AS refused",
    "CASE WHEN opens THEN 1 WHEN trial AND ok THEN 0 ELSE st END, CASE WHEN opens THEN t ELSE since END, CASE WHEN opens OR (trial AND ok) THEN [] ELSE rec END, opened + CASE WHEN opens THEN 1 ELSE 0 END, refused + CASE WHEN ref THEN 1 ELSE 0 END FROM (SELECT *, (trial AND NOT ok) OR (st = 0 AND NOT ok AND len(rec) >= 3) AS opens",
    "f.st, f.since, f.opened, f.refused, c.tm AS t, c.kind <> 'error' AS ok, f.st = 1 AND c.tm < f.since + 172800 AS ref, f.st = 1 AND c.tm >= f.since + 172800 AS trial, CASE WHEN c.kind <> 'error' OR f.st = 1 THEN f.fails ELSE list_append(list_filter(f.fails, lambda x: x > c.tm - 864000), c.tm) END AS rec",
    "CASE arg_max(st, rn) WHEN 1 THEN 'open' ELSE 'closed' END AS state, arg_max(opened, rn) AS opened, arg_max(refused, rn) AS refused",
).replace("f.rn + 1))", "f.rn + 1)))"))
def circuit_breaker(spark, d):
    """Three errors within ten days open it, two days later one call is tried."""
    return reputation.breaker(_peers(spark, d).withColumn("ok", F.col("kind") != "error"), 3, 864_000, 172_800)


@query("SELECT event_id, own <= CASE kind WHEN 'want' THEN 100 WHEN 'ping' THEN 10 ELSE 5 END AND every <= 1000 AS allowed FROM (SELECT event_id, kind, row_number() OVER (PARTITION BY node, sec, kind ORDER BY tm, event_id) AS own, row_number() OVER (PARTITION BY node, sec ORDER BY tm, event_id) AS every FROM (SELECT event_id, user_id % 4 AS node, CASE event_type WHEN 'view' THEN 'want' WHEN 'click' THEN 'ping' ELSE 'attest' END AS kind, epoch_us(ts) / 6e10 AS tm, floor(epoch_us(ts) / 6e10) AS sec FROM events))")
def rate_limit(spark, d):
    """Caps a second by peer and type, on a clock on which ten thousand events take the place of one day."""
    kind = F.when(F.col("event_type") == "view", "want").when(F.col("event_type") == "click", "ping").otherwise("attest")
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("node"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 6e10).alias("at"))
    return reputation.rate_limited(e).select("event_id", "allowed")


_CONN = "(SELECT node, round(0.6 * reputation + 0.2 * uptime / 4 + 0.2 * (1 - (node % 10) / 10.0), 9) AS score FROM {ranking})"


@query(f"SELECT node, score, r <= ceil(n * 0.04) AS dropped FROM (SELECT *, row_number() OVER (ORDER BY score, node) AS r, count(*) OVER () AS n FROM {_CONN})")
def connection_turnover(spark, d):
    """A full pool drops its lowest 4 %."""
    peers = inputs.ranking(spark, d).select("node", F.col("reputation").alias("reliability"), (F.col("uptime") / 4).alias("uptime"), ((F.col("node") % 10) / 10.0).alias("latency"))
    return reputation.turnover(peers, peers.count())


@query("""SELECT node, admitted AND (source <> largest OR s <= room) AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY source, admitted ORDER BY rank, node) AS s FROM (SELECT s_suppkey AS node, s_suppkey % 7 // 3 AS source, s_acctbal AS rank, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) <= 2 AS admitted FROM supplier)),
(SELECT arg_max(source, n * 100 + source) AS largest, floor((sum(n) - max(n)) * 0.7 / 0.3 + 1e-9) AS room FROM (SELECT source, count(*) AS n FROM (SELECT s_suppkey % 7 // 3 AS source, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) WHERE r <= 2 GROUP BY source))""")
def peer_admission(spark, d):
    s = table(spark, d, "supplier")
    return reputation.admit(s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("subnet"), F.floor(F.col("s_suppkey") % 7 / 3).alias("source"), F.col("s_acctbal").alias("rank")))


@query("SELECT cid, node, sus AS suspected FROM (SELECT cid, node, node % 4 = 1 AS sus, min(CASE WHEN node % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cid) AS t FROM {holders} WHERE NOT (node % 4 IN (2, 3) AND node % 10 < 9)) WHERE sus = (t = 1)")
def reachable_providers(spark, d):
    """Dead nodes are skipped while their entry is fresh; suspected ones are tried if there is no other."""
    h = inputs.holders(spark, d)
    nodes = h.select("node").distinct()
    dead = nodes.filter("node % 4 IN (2, 3)").select("node", F.when(F.col("node") % 10 < 9, 95.0).otherwise(80.0).alias("at"))
    return reputation.reachable(h.select("cid", "node"), dead, nodes.filter("node % 4 = 1"), 100.0, 5.0)


@query("SELECT db, slot, arg_max(seq, seq) AS seq, arg_max(root, seq) AS root FROM (SELECT db, o_orderkey AS seq, root, o_orderkey // 500 AS slot, root IS DISTINCT FROM lag(root) OVER (PARTITION BY db ORDER BY o_orderkey) AS changed FROM {writes}) WHERE changed GROUP BY db, slot")
def root_publication(spark, d):
    """Changed roots only, one in five seconds of a database (a hundred writes a second)."""
    return reputation.throttle(inputs.writes(spark, d).select("db", F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") / 100).alias("at"), "root"))


# -- databases ---------------------------------------------------------------------------------------------


def _database(spark, *statements):
    db = Database.create(spark, _folder(spark, "db"), "ann")
    for s in statements:
        db.execute(s, "ann")
    return db


@query("SELECT * FROM (VALUES ('id', 'bigint'), ('note', 'string'), ('score', 'double'), ('raw', 'binary')) t(name, kind)")
def sql_s07_create_table(spark, d):
    db = _database(spark, "CREATE TABLE t (id INTEGER PRIMARY KEY, note TEXT, score REAL, raw BLOB)", "CREATE TABLE IF NOT EXISTS t (x INTEGER)")
    return spark.createDataFrame(db.table("t").dtypes, "name string, kind string")


@query("SELECT 1 AS id, 'alpha' AS val UNION ALL SELECT 2, 'beta' UNION ALL SELECT 3, NULL")
def sql_s08_create_insert(spark, d):
    return _database(spark, "CREATE TABLE t (id INTEGER, val TEXT)", "INSERT INTO t VALUES (1, 'alpha'), (2, 'beta')", "INSERT INTO t (id) VALUES (3)").query("SELECT id, val FROM t")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS bal FROM customer")
def sql_s09_replace(spark, d):
    views(spark, d, "customer")
    return _database(spark, "CREATE TABLE c (id INTEGER PRIMARY KEY, bal REAL); INSERT INTO c SELECT c_custkey, c_acctbal FROM customer", "INSERT OR REPLACE INTO c SELECT id, 0.0 FROM c WHERE id % 5 = 0").query("SELECT * FROM c")


@query("SELECT * FROM (VALUES ('syntax', 'ParseException'), ('missing table', 'AnalysisException'), ('not a write', 'ValueError'), ('two keys', 'ValueError'), ('other writer', 'Unauthorized'), ('stale root', 'Conflict')) t(name, error)")
def sql_s11_errors(spark, d):
    db = _database(spark, "CREATE TABLE t (id INTEGER PRIMARY KEY)", "INSERT INTO t VALUES (1)")
    tries = {
        "syntax": lambda: db.query("SELEC 1"), "missing table": lambda: db.query("SELECT * FROM no_such_table_here"), "not a write": lambda: db.execute("SELECT 1", "ann"),
        "two keys": lambda: db.execute("INSERT INTO t VALUES (1)", "ann"), "other writer": lambda: db.execute("DELETE FROM t", "bob"), "stale root": lambda: db.execute("DELETE FROM t", "ann", "00"),
    }
    told = []
    for name, act in tries.items():
        try:
            act()
            told.append((name, None))
        except (Unauthorized, Conflict, ValueError) as e:
            told.append((name, type(e).__name__))
        except Exception as e:  # Spark's own
            told.append((name, type(e).__name__))
    return spark.createDataFrame(told, "name string, error string")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 9 <> 0")
def sql_s12_update_delete(spark, d):
    views(spark, d, "supplier")
    db = _database(spark, "CREATE TABLE s AS SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier", "UPDATE s SET s_acctbal = s_acctbal + 10 WHERE s_nationkey = 3", "DELETE FROM s WHERE s_suppkey % 9 = 0")
    return db.query("SELECT s_suppkey, s_acctbal FROM s")


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'one; two' END AS note FROM nation")
def sql_s12_alter_drop(spark, d):
    """A migration of several statements is one version; a dropped table is gone."""
    views(spark, d, "nation")
    db = _database(spark, "CREATE TABLE n AS SELECT n_nationkey, n_name, n_regionkey FROM nation", "CREATE TABLE gone (x INTEGER)")
    db.execute("ALTER TABLE n ADD COLUMN note TEXT; UPDATE n SET note = 'one; two' WHERE n_regionkey = 1; ALTER TABLE n DROP COLUMN n_name; ALTER TABLE n RENAME COLUMN n_nationkey TO id; ALTER TABLE n RENAME TO nations_now; DROP TABLE gone", "ann")
    assert [t.name for t in db.commit_at().tables] == ["nations_now"]
    return db.query("SELECT id, note FROM nations_now")


@query("SELECT * FROM (VALUES ('page_size', '16384'), ('journal_mode', 'delete'), ('busy_timeout', '5000')) t(name, value)")
def sql_s31_pragma(spark, d):
    db = _database(spark)
    return db.query("PRAGMA page_size").union(db.query("PRAGMA journal_mode;")).union(db.query("PRAGMA busy_timeout"))


@query("SELECT * FROM (SELECT 2 AS version, count(*) AS n FROM part UNION ALL SELECT 3, count(*) FROM part WHERE p_size >= 10 UNION ALL SELECT 4, count(*) FROM part WHERE p_size >= 10 AND p_size <= 40 UNION ALL SELECT 5, count(*) FROM part WHERE p_size >= 10)")
def sql_write_versions(spark, d):
    """Every version can be read back; version 5 is 3 again, with its root."""
    views(spark, d, "part")
    db = _database(spark, "CREATE TABLE p (k INTEGER, size INTEGER)", "INSERT INTO p SELECT p_partkey, p_size FROM part", "DELETE FROM p WHERE size < 10", "DELETE FROM p WHERE size > 40")
    assert db.rollback(3, "ann") == 5 and db.commit_at(5).root == db.commit_at(3).root != db.commit_at(4).root
    out = None
    for v in (2, 3, 4, 5):
        one = db.table("p", v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT a.s_suppkey, count(*) AS near FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_acctbal <= a.s_acctbal + 500 GROUP BY a.s_suppkey")
def sql_s15_range(spark, d):
    """A theta join without an equality: balances are dealt to bins as wide as the range, and neighbours are compared."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / 500).alias("bin"))
    other = s.select(F.col("s_acctbal").alias("bal"), F.explode(F.array("bin", F.col("bin") - 1)).alias("bin"))
    near = s.join(other, "bin").filter((F.col("bal") > F.col("s_acctbal")) & (F.col("bal") <= F.col("s_acctbal") + 500))
    return near.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("near"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000 AND s_suppkey % 3 = 0")
def sql_s23_except_rows(spark, d):
    views(spark, d, "nation", "supplier")
    return spark.sql("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000 AND s_suppkey % 3 = 0")
