"""Ordered state machines: clocks, membership, programs, circuit breakers, scores.

Transitions depend on order, so a key's events are sorted into one array and folded in the JVM; the
same rules, as Python, drive the streaming operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.digests import MAX_SKEW_MS, QUARANTINE_AFTER, REPLAY_WINDOW_MS

UNKNOWN, ALIVE, SUSPECT, DEAD = 0, 1, 2, 3
STATE_NAMES = {ALIVE: "alive", SUSPECT: "suspect", DEAD: "dead"}


def ordered(events: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("log"))


def membership(messages: DataFrame) -> DataFrame:
    """messages(node, seq, kind, inc) -> last state of each node: state, incarnation, connects, disconnects.

    alive: replaces alive or dead with a higher incarnation, suspect with an equal one; unknown connects.
    suspect: replaces alive with an equal incarnation, suspect with a higher one, never dead.
    dead: replaces alive and suspect always (and disconnects), dead with a higher incarnation.
    """
    zero = F.struct(F.lit(UNKNOWN).alias("state"), F.lit(0).cast("long").alias("inc"), F.lit(0).alias("up"), F.lit(0).alias("down"))

    def step(s: Column, m: Column) -> Column:
        st, i, n, kind = s["state"], s["inc"], m["inc"].cast("long"), m["kind"]
        alive = (kind == "alive") & ((st == UNKNOWN) | ((st == ALIVE) & (n > i)) | ((st == SUSPECT) & (n >= i)) | ((st == DEAD) & (n > i)))
        suspect = (kind == "suspect") & ((st == UNKNOWN) | ((st == ALIVE) & (n >= i)) | ((st == SUSPECT) & (n > i)))
        dead = (kind == "dead") & ((st != DEAD) | (n > i))
        new = F.when(alive, ALIVE).when(suspect, SUSPECT).when(dead, DEAD).otherwise(st)
        return F.struct(
            new.alias("state"),
            F.when(alive | suspect | dead, n).otherwise(i).alias("inc"),
            (s["up"] + (alive & (st == UNKNOWN)).cast("int")).alias("up"),
            (s["down"] + (dead & st.isin(ALIVE, SUSPECT)).cast("int")).alias("down"),
        )

    logs = ordered(messages, "node", ["seq"], "kind", "inc").select("node", F.aggregate("log", zero, step).alias("s"))
    name = F.when(F.col("s.state") == ALIVE, "alive").when(F.col("s.state") == SUSPECT, "suspect").when(F.col("s.state") == DEAD, "dead").otherwise("unknown")
    return logs.select("node", name.alias("state"), F.col("s.inc").alias("incarnation"), F.col("s.up").alias("connects"), F.col("s.down").alias("disconnects"))


def member_step(state: int, inc: int, kind: str, n: int) -> tuple[int, int, str | None]:
    """One transition of membership(): (state, incarnation, event)."""
    if kind == "alive" and (state == UNKNOWN or (state == SUSPECT and n >= inc) or (state in (ALIVE, DEAD) and n > inc)):
        return ALIVE, n, "connected" if state == UNKNOWN else None
    if kind == "suspect" and (state == UNKNOWN or (state == ALIVE and n >= inc) or (state == SUSPECT and n > inc)):
        return SUSPECT, n, None
    if kind == "dead" and (state != DEAD or n > inc):
        return DEAD, n, "disconnected" if state in (ALIVE, SUSPECT) else None
    return state, inc, None


def hybrid_clock(events: DataFrame) -> DataFrame:
    """events(node, seq, wall_ms, remote) -> clock after each node's events, and rejects of each kind.

    remote null is a local tick: the wall if it leads, else one more in the counter (over 65,535 the wall
    moves by 1). Otherwise a remote stamp is observed: rejected if over 500 ms ahead (skew) or 30 s off
    (replay), else merged by the largest wall, counters saturating except when all walls are equal.
    """
    zero = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("l"), F.lit(0).alias("skew"), F.lit(0).alias("replay"))

    def step(s: Column, e: Column) -> Column:
        w, n, wall = s["w"], s["l"], e["wall_ms"]
        rw, rl = F.shiftright(e["remote"], 16), e["remote"].bitwiseAND(F.lit(65_535))
        local = e["remote"].isNull()
        skew = ~local & (rw > wall + MAX_SKEW_MS)
        replay = ~local & ~skew & (F.abs(rw - wall) > REPLAY_WINDOW_MS)
        high = F.greatest(n, rl)
        up = lambda c: F.least(c + 1, F.lit(65_535).cast("long"))
        tick_w = F.when(wall > w, wall).when(n == 65_535, w + 1).otherwise(w)
        tick_l = F.when((wall > w) | (n == 65_535), F.lit(0).cast("long")).otherwise(n + 1)
        leads = (wall > w) & (wall > rw)
        see_w = F.when(leads, wall).when(w > rw, w).when(rw > w, rw).when(high == 65_535, w + 1).otherwise(w)
        see_l = F.when(leads, F.lit(0).cast("long")).when(w > rw, up(n)).when(rw > w, up(rl)).when(high == 65_535, F.lit(0).cast("long")).otherwise(high + 1)
        bad = F.coalesce(skew | replay, F.lit(False))
        return F.struct(
            F.when(local, tick_w).when(bad, w).otherwise(see_w).alias("w"),
            F.when(local, tick_l).when(bad, n).otherwise(see_l).alias("l"),
            (s["skew"] + F.coalesce(skew, F.lit(False)).cast("int")).alias("skew"),
            (s["replay"] + F.coalesce(replay, F.lit(False)).cast("int")).alias("replay"),
        )

    logs = ordered(events, "node", ["seq"], "wall_ms", "remote").select("node", F.aggregate("log", zero, step).alias("s"))
    return logs.select("node", F.shiftleft(F.col("s.w"), 16).bitwiseOR(F.col("s.l")).alias("clock"), F.col("s.skew").alias("skewed"), F.col("s.replay").alias("replayed"))


def program_runs(runs: DataFrame) -> DataFrame:
    """runs(program, seq, outcome) -> state, streak and runs done: ok resets the streak, fuel leaves it,
    error adds one; at 10 the program is quarantined and runs no more."""
    zero = F.struct(F.lit(0).alias("streak"), F.lit(0).alias("done"), F.lit(False).alias("out"))

    def step(s: Column, e: Column) -> Column:
        streak = F.when(e["outcome"] == "ok", 0).when(e["outcome"] == "error", s["streak"] + 1).otherwise(s["streak"])
        streak = F.when(s["out"], s["streak"]).otherwise(streak)
        return F.struct(streak.alias("streak"), (s["done"] + F.when(s["out"], 0).otherwise(1)).alias("done"), (streak >= QUARANTINE_AFTER).alias("out"))

    logs = ordered(runs, "program", ["seq"], "outcome").select("program", F.aggregate("log", zero, step).alias("s"))
    return logs.select("program", F.when(F.col("s.out"), "quarantined").otherwise("running").alias("state"), F.col("s.streak").alias("streak"), F.col("s.done").alias("runs"))
