"""Scores of peers, bans, limits, breakers and admission.

Scores depend on order, so a peer's events are folded as one sorted array in the JVM (a peer's log has to
fit in a task). Times are in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Penalties, threshold and hourly decay of ban scores; neutral value and decay of reliability.
PENALTIES, BAN_AT, BAN_DECAY, PAROLE_FAILURES = {"corrupt": 50.0, "protocol": 25.0, "spam": 5.0}, 100.0, 0.02, 3
NEUTRAL, RELIABILITY_DECAY, STEP = 0.5, 0.01, 0.05
# Messages a second of a peer by type, and of all types.
LIMITS, LIMIT_ALL = {"want": 100, "ping": 10, "attest": 5}, 1000


def _log(events: DataFrame, *values: str) -> DataFrame:
    return events.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "seq", *values))).alias("log"))


def _decayed(value: Column, toward: float, rate: float, hours: Column) -> Column:
    return toward + (value - toward) * F.pow(F.lit(1 - rate), hours)


def ban_scores(events: DataFrame) -> DataFrame:
    """events(node, seq, at, kind) -> (node, score, banned): the score after the last event.

    A penalty adds to a score that decays by 2 % an hour; at 100 the node is banned for good. A failed
    parole counts towards three in a row, which ban too; a passed one starts anew.
    """
    points = F.create_map(*[F.lit(x) for item in PENALTIES.items() for x in item])
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("at"), F.lit(0).alias("failed"), F.lit(False).alias("banned"))

    def step(s: Column, e: Column) -> Column:
        at = e["at"].cast("double")
        score = _decayed(s["score"], 0.0, BAN_DECAY, F.coalesce((at - s["at"]) / 3600, F.lit(0.0))) + F.coalesce(F.element_at(points, e["kind"]), F.lit(0.0))
        failed = F.when(e["kind"] == "parole_failed", s["failed"] + 1).when(e["kind"] == "parole_passed", 0).otherwise(s["failed"])
        return F.struct(score.alias("score"), at.alias("at"), failed.alias("failed"), (s["banned"] | (score >= BAN_AT) | (failed >= PAROLE_FAILURES)).alias("banned"))

    told = _log(events, "kind").select("node", F.aggregate("log", zero, step).alias("s"))
    return told.select("node", F.col("s.score").alias("score"), F.col("s.banned").alias("banned"))


def reliability(events: DataFrame) -> DataFrame:
    """events(node, seq, at, ok) -> (node, reliability): starts at 0.5, decays towards it by 1 % an hour, moves by STEP, stays in 0..1."""
    zero = F.struct(F.lit(NEUTRAL).alias("r"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, e: Column) -> Column:
        at = e["at"].cast("double")
        r = _decayed(s["r"], NEUTRAL, RELIABILITY_DECAY, F.coalesce((at - s["at"]) / 3600, F.lit(0.0))) + F.when(e["ok"], STEP).otherwise(-STEP)
        return F.struct(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)).alias("r"), at.alias("at"))

    return _log(events, "ok").select("node", F.aggregate("log", zero, step)["r"].alias("reliability"))


def breaker(events: DataFrame, failures: int = 5, within: float = 30, pause: float = 60) -> DataFrame:
    """events(node, seq, at, ok) -> (node, state, opened, refused) after the last event.

    Closed: `failures` failures within `within` seconds open it. Open: calls are refused until `pause` seconds
    have passed, then one is tried: a success closes it, a failure opens it again.
    """
    zero = F.struct(F.lit("closed").alias("state"), F.lit(0.0).alias("since"), F.expr("cast(array() as array<double>)").alias("fails"), F.lit(0).alias("opened"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        at, ok = e["at"].cast("double"), e["ok"]
        refused = (s["state"] == "open") & (at < s["since"] + pause)
        trial = (s["state"] == "open") & ~refused
        recent = F.when(ok | refused | trial, s["fails"]).otherwise(F.concat(F.filter(s["fails"], lambda x: x > at - within), F.array(at)))
        opens = (trial & ~ok) | ((s["state"] == "closed") & ~ok & (F.size(recent) >= failures))
        closes = trial & ok
        return F.struct(
            F.when(opens, "open").when(closes, "closed").otherwise(s["state"]).alias("state"),
            F.when(opens, at).otherwise(s["since"]).alias("since"),
            F.when(opens | closes, F.expr("cast(array() as array<double>)")).otherwise(recent).alias("fails"),
            (s["opened"] + opens.cast("int")).alias("opened"),
            (s["refused"] + refused.cast("int")).alias("refused"),
        )

    told = _log(events, "ok").select("node", F.aggregate("log", zero, step).alias("s"))
    return told.select("node", F.col("s.state").alias("state"), F.col("s.opened").alias("opened"), F.col("s.refused").alias("refused"))


def rate_limited(messages: DataFrame) -> DataFrame:
    """messages(node, at, seq, kind) with allowed: within the caps of its type and of all types in its second."""
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in LIMITS.items() for x in item]), F.col("kind")), F.lit(LIMIT_ALL))
    second = F.floor("at")
    own = F.row_number().over(W.partitionBy("node", second, "kind").orderBy("at", "seq"))
    every = F.row_number().over(W.partitionBy("node", second).orderBy("at", "seq"))
    return messages.select("*", ((own <= cap) & (every <= LIMIT_ALL)).alias("allowed"))


def turnover(peers: DataFrame, capacity: int, full: float = 0.9, drop: float = 0.04) -> DataFrame:
    """peers(node, reliability, uptime, latency), each in 0..1 -> (node, score, dropped).

    Only if more than `full` of the capacity is in use, the ceil(drop * n) lowest scores go; ties by node. The lowest
    are found by a top-k, so no task sorts all peers.
    """
    score = 0.6 * F.col("reliability") + 0.2 * F.col("uptime") + 0.2 * (1 - F.col("latency"))
    rows = peers.select("node", F.round(score, 9).alias("score"))
    n = rows.count()
    k = -int(-n * drop // 1) if n > full * capacity else 0
    gone = rows.orderBy("score", "node").limit(k).select("node", F.lit(True).alias("gone"))
    return rows.join(gone, "node", "left").select("node", "score", F.coalesce("gone", F.lit(False)).alias("dropped"))


def admit(peers: DataFrame, per_subnet: int = 2, other_share: float = 0.3) -> DataFrame:
    """peers(node, subnet, source, rank) -> (node, admitted): at most per_subnet of a subnet, by rank, and of what is left at
    most 1 - other_share from the source that most come from (its last by rank go)."""
    kept = peers.withColumn("r", F.row_number().over(W.partitionBy("subnet").orderBy("rank", "node"))).filter(F.col("r") <= per_subnet)
    counts = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.sum("n").alias("total"), F.max(F.struct("n", "source")).alias("most")).select((F.col("total") - F.col("most.n")).alias("others"), F.col("most.source").alias("largest"))
    room = F.floor(F.col("others") * (1 - other_share) / other_share + F.lit(1e-9))
    placed = kept.join(F.broadcast(top)).withColumn("s", F.row_number().over(W.partitionBy("source").orderBy("rank", "node")))  # one row
    inside = placed.filter((F.col("source") != F.col("largest")) | (F.col("s") <= room)).select("node", F.lit(True).alias("inside"))
    return peers.join(inside, "node", "left").select("node", F.coalesce("inside", F.lit(False)).alias("admitted"))


def reachable(providers: DataFrame, dead: DataFrame, suspected: DataFrame, now: float, suspicion: float) -> DataFrame:
    """providers(cid, node) worth a try: those neither dead nor suspected, else the suspected ones.

    Entries of dead(node, at) older than twice the suspicion timeout no longer count.
    """
    gone = dead.filter(F.col("at") > now - 2 * suspicion).select("node")
    left = providers.join(gone, "node", "left_anti").join(suspected.select("node", F.lit(1).alias("doubt")), "node", "left")
    best = left.withColumn("tier", F.coalesce("doubt", F.lit(0))).withColumn("first", F.min("tier").over(W.partitionBy("cid")))
    return best.filter(F.col("tier") == F.col("first")).select("cid", "node", (F.col("tier") == 1).alias("suspected"))


def throttle(roots: DataFrame, seconds: int = 5) -> DataFrame:
    """roots(db, seq, at, root) to publish: changed ones only, the last of each `seconds`-long slot of a database."""
    before = F.lag("root").over(W.partitionBy("db").orderBy("at", "seq"))
    changed = roots.withColumn("b", before).filter(~F.col("root").eqNullSafe(F.col("b"))).withColumn("slot", F.floor(F.col("at") / seconds))
    last = changed.groupBy("db", "slot").agg(F.max_by(F.struct("seq", "root"), F.struct("at", "seq")).alias("l"))
    return last.select("db", "slot", F.col("l.seq").alias("seq"), F.col("l.root").alias("root"))
