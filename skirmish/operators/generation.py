"""Who gave a buff for how long: held and wasted time by source, and its share over allies."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import Frames
from ..plans.joins import small
from ..schema import BOONS
from .buffs import REMOVE_MATCH_MS, buff_events, buff_table
from .damage import pet_owners

REGENERATION = 718


def by_source(rows: list[tuple[int, str, int, int, bool, int]], capacity: int, side_by_side: bool, end: int, power: dict[int, int] | None = None) -> tuple[Counter, Counter]:
    """(held ms, wasted ms) by source of events (time, kind, ms, change, first, source) in order.

    Side by side, every stack's time counts for its source; in a queue only the running one's.  What an
    eviction or a removal leaves of a stack is wasted.  With ``power`` the queue stays sorted by its
    sources' power, and the weakest gives way."""
    held, wasted = Counter(), Counter()
    stacks: list[list[int]] = []  # [ms left, source]
    now = rows[0][0] if rows else 0

    def run(until: int) -> None:
        nonlocal now
        while now < until and stacks:
            running = stacks if side_by_side else stacks[:1]
            step = min(until - now, min(s[0] for s in running))
            for s in running:
                s[0] -= step
                held[s[1]] += step
            now += step
            stacks[:] = [s for k, s in enumerate(stacks) if s[0] > 0 or not (side_by_side or k == 0)]
        now = max(now, until)

    def drop(k: int) -> None:
        ms, source = stacks.pop(k)
        wasted[source] += ms

    for t, kind, ms, change, first, source in rows:
        run(t)
        full = len(stacks) >= capacity
        if kind == "apply":
            new = [ms, source]
            at = len(stacks)
            if full:
                if side_by_side or len(stacks) == 1:
                    at = min(range(len(stacks)), key=lambda k: stacks[k][0])
                else:
                    at = len(stacks) - 1 if power is not None else min(range(1, len(stacks)), key=lambda k: stacks[k][0])
                drop(at)
            stacks.insert(at, new)
            if power is not None:
                stacks.sort(key=lambda s: -power.get(s[1], 0))
            if first and not side_by_side:
                k = next(k for k, s in enumerate(stacks) if s is new)
                stacks.insert(0, stacks.pop(k))
        elif kind == "extend":
            old = ms - change
            if (stacks and old > 0) or full:
                target = min(stacks, key=lambda s: abs(s[0] - old)) if side_by_side else stacks[0]
                target[0] = max(0, target[0] + change)
            else:
                stacks.insert(len(stacks) if side_by_side else 0, [max(0, ms), source])
        elif kind == "single":
            order = sorted(range(len(stacks)), key=lambda k: stacks[k][0]) if side_by_side else range(len(stacks))
            k = next((k for k in order if abs(stacks[k][0] - ms) < REMOVE_MATCH_MS), None)
            if k is not None:
                drop(k)
        else:
            while stacks:
                drop(0)
    run(end)
    return held, wasted


GENERATED = "log_id string, rep bigint, buff_id bigint, source bigint, held_ms bigint, wasted_ms bigint"


def generated(f: Frames, agents: DataFrame | None = None) -> DataFrame:
    """(log_id, rep, buff_id, source, held_ms, wasted_ms) of boons on the squad; a source is an account, or
    a pet's owner.  ``agents`` (log_id, addr, healing) orders the queue of regeneration."""
    rows = buff_events(f).filter(F.col("buff_id").isin(*BOONS))
    owner = pet_owners(f).select("log_id", F.col("addr").alias("source"), "owner")
    rows = rows.join(owner, ["log_id", "source"], "left").withColumn("giver", F.coalesce("owner", "source"))
    rows = rows.join(f.members("squad", "giver", "giver_rep"), ["log_id", "giver"], "left").withColumn("source", F.coalesce("giver_rep", "giver"))
    power = F.lit(0) if agents is None else F.coalesce("healing", F.lit(0))
    if agents is not None:
        rows = rows.join(small(agents.select("log_id", F.col("addr").alias("source"), "healing").dropDuplicates(["log_id", "source"])), ["log_id", "source"], "left")
    rows = rows.withColumn("power", power).join(f.like_logs(buff_table(f)), ["log_id", "buff_id"]).join(f.log_times.select("log_id", "t1"), "log_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["time", "seq"])
        one = frame.iloc[0]
        events = list(zip(*(frame[c].tolist() for c in ("time", "kind", "ms", "change", "first", "source")), strict=True))
        sorted_by = dict(zip(frame.source, frame.power, strict=True)) if one.buff_id == REGENERATION else None
        held, wasted = by_source(events, int(one.capacity), bool(one.side_by_side), int(one.t1), sorted_by)
        who = sorted(held.keys() | wasted.keys())
        return pd.DataFrame({"log_id": one.log_id, "rep": one.rep, "buff_id": one.buff_id, "source": who, "held_ms": [held[w] for w in who], "wasted_ms": [wasted[w] for w in who]})

    return rows.groupBy("log_id", "rep", "buff_id").applyInPandas(run, GENERATED)


def generation(f: Frames, by: DataFrame | None = None) -> DataFrame:
    """By account and boon: its share of the log on itself, and the mean over the others of its subgroup and
    of the squad, those it gave nothing to included: mean stacks where stacks count side by side, else
    percent.  Accounts without a subgroup are left out.  Means are sums over counts; no pairs are made."""
    by = generated(f) if by is None else by
    who = f.roster.filter("side = 'squad'").groupBy("log_id", "rep").agg(F.max("subgroup").alias("subgroup")).filter("subgroup != 0")
    groups = who.groupBy("log_id", "subgroup").agg((F.count("*") - 1).alias("group_others"))
    squads = who.groupBy("log_id").agg((F.count("*") - 1).alias("squad_others"))
    rows = by.join(who, ["log_id", "rep"]).join(who.select("log_id", F.col("rep").alias("source"), F.col("subgroup").alias("own_group")), ["log_id", "source"])
    own, same = F.col("rep") == F.col("source"), F.col("subgroup") == F.col("own_group")
    total = lambda c, what: F.coalesce(F.sum(F.when(c, F.col(what))), F.lit(0))
    sums = rows.groupBy("log_id", "source", "own_group", "buff_id").agg(*(
        total(c, f"{what}_ms").alias(f"{name}_{what}") for what in ("held", "wasted") for name, c in (("self", own), ("group", ~own & same), ("squad", ~own))
    ))
    sums = sums.join(groups.withColumnRenamed("subgroup", "own_group"), ["log_id", "own_group"]).join(squads, "log_id").join(f.log_times, "log_id")
    scale = F.when(F.col("buff_id").isin(*(b for b, (_, stacks) in BOONS.items() if stacks)), 1.0).otherwise(100.0) / F.greatest(F.col("duration_ms"), F.lit(1))
    share = lambda name, n: F.round(F.when(n > 0, F.col(name) * scale / n).otherwise(0.0), 3).alias(name)
    counts = {"self": F.lit(1), "group": F.col("group_others"), "squad": F.col("squad_others")}
    return sums.select("log_id", F.col("source").alias("rep"), "buff_id", *(share(f"{k}_{what}", n) for what in ("held", "wasted") for k, n in counts.items()))
