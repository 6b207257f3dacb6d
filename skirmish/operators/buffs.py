"""Buff stacks: the state machines over stack events, and what their step functions give.

Only rows of tracked buffs reach the machines, grouped by log, holder and buff.  Where stacks never
fill up and nothing is removed the windows in ``queue_spans`` give the same result without Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frames import Frames
from ..plans.joins import merge_steps, step_spans
from ..schema import BOONS, CONDITIONS, CONTROLS, State

#: Stacks of a boon where the log doesn't tell (fixed values).
CAPACITY = {740: 25, 1122: 25, 725: 9, 30328: 9, 743: 9, 719: 9, 1187: 5, 717: 5, 718: 5, 726: 5, 26980: 5, 873: 5}
#: A removed stack is found by its remaining time, to less than so many ms (fixed value).
REMOVE_MATCH_MS = 15


def buff_table(f: Frames) -> DataFrame:
    """(log_id, buff_id, capacity, side_by_side): the log's own capacity (its last one, 99 at most) or the
    fixed one."""
    fixed = [(b, CAPACITY[b], i) for b, (_, i) in BOONS.items()] + [(b, c, i) for b, (_, i, c) in {**CONDITIONS, **CONTROLS}.items()]
    rows = [F.struct(F.lit(b).cast("bigint").alias("buff_id"), F.lit(c).alias("capacity"), F.lit(i).alias("side_by_side")) for b, c, i in fixed]
    told = f.events.filter((F.col("is_statechange") == State.BUFF_INFO) & (F.col("src_master_instid") > 0))
    told = told.groupBy("log_id", F.col("skillid").alias("buff_id")).agg(F.least(F.max_by("src_master_instid", "seq"), F.lit(99)).alias("told"))
    return f.logs.select("log_id", F.explode(F.array(*rows)).alias("r")).select("log_id", "r.*").join(told, ["log_id", "buff_id"], "left").select("log_id", "buff_id", F.coalesce("told", "capacity").alias("capacity"), "side_by_side")


def buff_events(f: Frames, holders: str = "squad") -> DataFrame:
    """Stack events of tracked buffs on a side: kind (apply, extend, single, all), the stack's time, the
    change of an extension, and whether it goes first.  Wears and overstacks are left out."""
    tracked = [*BOONS, *CONDITIONS, *CONTROLS]
    rows = f.events.filter(F.col("skillid").isin(*tracked))
    s, post = F.col("is_statechange"), F.col("post_era")
    plain = (s == 0) & (F.col("buff") != 0) & (F.col("is_activation") == 0)
    before = (
        F.when(plain & (F.col("is_buffremove") == 1), "all").when(plain & (F.col("is_buffremove") == 2), "single")
        .when(plain & (F.col("is_buffremove") == 0) & (F.col("buff_dmg") == 0) & (F.col("value") > 0), F.when(F.col("is_offcycle") != 0, "extend").otherwise("apply"))
    )
    after = (
        F.when(s == State.BUFF_APPLY, "apply").when(s == State.BUFF_CHANGE, "extend")
        .when((s == State.BUFF_REMOVE_SINGLE) & ~((F.col("dst_agent") == 0) & (F.col("iff") == 2)), "single").when(s == State.BUFF_REMOVE_ALL, "all")
    )
    kind = F.when(s == State.BUFF_INITIAL, "apply").when(post, after).otherwise(before)
    # through a generator, so that the planner works the kind out once and does not copy it into every use
    rows = rows.select("*", F.inline(F.array(F.struct(kind.alias("kind"))))).filter("kind is not null")
    removal = F.col("kind").isin("single", "all")
    rows = rows.withColumn("holder", F.when(removal, F.col("src_agent")).otherwise(F.col("dst_agent"))).withColumn("source", F.when(removal, F.col("dst_agent")).otherwise(F.col("src_agent")))
    rows = rows.join(f.members(holders, "holder", "rep"), ["log_id", "holder"])
    extend = F.col("kind") == "extend"
    return rows.select(
        "log_id", "rep", F.col("skillid").alias("buff_id"), "time", "seq", "kind", "source",
        F.when(extend, F.col("overstack")).otherwise(F.col("value")).cast("bigint").alias("ms"),
        F.when(extend, F.col("value")).otherwise(0).cast("bigint").alias("change"), (F.col("is_shields") != 0).alias("first"),
    )


class _Stacks:
    """Stacks of one buff on one holder; ``states`` are the change points of their number."""

    def __init__(self, capacity: int):
        self.capacity, self.states = capacity, []

    def note(self, t: int) -> None:
        n = self.size()
        if self.states and self.states[-1][0] == t:
            self.states.pop()
        if (self.states[-1][1] if self.states else 0) != n:
            self.states.append((t, n))


class QueueStacks(_Stacks):
    """One stack runs at a time, the others wait in order."""

    def __init__(self, capacity: int, start: int):
        super().__init__(capacity)
        self.waiting, self.clock = [], start

    def size(self) -> int:
        return len(self.waiting)

    def advance(self, t: int) -> None:
        while self.clock < t and self.waiting:
            spent = min(self.waiting[0], t - self.clock)
            self.clock += spent
            self.waiting[0] -= spent
            if self.waiting[0] > 0:
                return
            self.waiting.pop(0)
            self.note(self.clock)
        self.clock = max(self.clock, t)

    def apply(self, t: int, ms: int, change: int, first: bool) -> None:
        q = self.waiting
        if len(q) < self.capacity:
            q.append(ms)
            k = len(q) - 1
        else:  # the shortest that waits gives way; the running one only if it is alone
            k = min(range(1, len(q)), key=q.__getitem__) if len(q) > 1 else 0
            q[k] = ms
        if first:
            q.insert(0, q.pop(k))

    def extend(self, t: int, ms: int, change: int, first: bool) -> None:
        old = ms - change
        if (self.waiting and old > 0) or len(self.waiting) >= self.capacity:
            self.waiting[0] = max(0, self.waiting[0] + change)
        else:
            self.waiting.insert(0, max(0, ms))

    def single(self, t: int, ms: int, change: int, first: bool) -> None:
        k = next((k for k, r in enumerate(self.waiting) if abs(r - ms) < REMOVE_MATCH_MS), None)
        if k is not None:
            self.waiting.pop(k)

    def all(self, t: int, ms: int, change: int, first: bool) -> None:
        self.waiting.clear()


class ParallelStacks(_Stacks):
    """All stacks run side by side, each to its own end."""

    def __init__(self, capacity: int, start: int):
        super().__init__(capacity)
        self.ends: list[int] = []

    def size(self) -> int:
        return len(self.ends)

    def advance(self, t: int) -> None:
        while self.ends and (first := min(self.ends)) <= t:
            self.ends.remove(first)
            self.note(first)

    def apply(self, t: int, ms: int, change: int, first: bool) -> None:
        if len(self.ends) < self.capacity:
            self.ends.append(t + ms)
        elif self.ends:
            self.ends[self.ends.index(min(self.ends))] = t + ms

    def extend(self, t: int, ms: int, change: int, first: bool) -> None:
        old = ms - change
        if (self.ends and old > 0) or len(self.ends) >= self.capacity:
            k = min(range(len(self.ends)), key=lambda k: abs(self.ends[k] - t - old))
            self.ends[k] = max(t, self.ends[k] + change)
        else:
            self.ends.append(t + max(0, ms))

    def single(self, t: int, ms: int, change: int, first: bool) -> None:
        for e in sorted(self.ends):
            if abs(e - t - ms) < REMOVE_MATCH_MS:
                self.ends.remove(e)
                return

    def all(self, t: int, ms: int, change: int, first: bool) -> None:
        self.ends.clear()


def simulate(rows: list[tuple[int, str, int, int, bool]], capacity: int, side_by_side: bool, end: int) -> list[tuple[int, int]]:
    """Change points (time, stacks) of events (time, kind, ms, change, first) in order."""
    if not rows:
        return []
    stacks = (ParallelStacks if side_by_side else QueueStacks)(capacity, rows[0][0])
    for t, kind, ms, change, first in rows:
        stacks.advance(t)
        getattr(stacks, kind)(t, ms, change, first)
        stacks.note(t)
    stacks.advance(end)
    return stacks.states


STEPS = "log_id string, rep bigint, buff_id bigint, time bigint, stacks int"


def stack_steps(f: Frames, holders: str = "squad") -> DataFrame:
    """Change points of the number of stacks by holder and buff, up to the log's end."""
    rows = buff_events(f, holders).join(f.like_logs(buff_table(f)), ["log_id", "buff_id"]).join(f.log_times.select("log_id", "t1"), "log_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["time", "seq"])
        one = frame.iloc[0]
        events = list(zip(*(frame[c].tolist() for c in ("time", "kind", "ms", "change", "first")), strict=True))
        out = simulate(events, int(one.capacity), bool(one.side_by_side), int(one.t1))
        return pd.DataFrame({"log_id": one.log_id, "rep": one.rep, "buff_id": one.buff_id, "time": [t for t, _ in out], "stacks": [n for _, n in out]})

    return rows.groupBy("log_id", "rep", "buff_id").applyInPandas(run, STEPS)


def uptime(f: Frames, steps: DataFrame | None = None) -> DataFrame:
    """Share of the log with any stack, in percent, and mean stacks over the log."""
    steps = stack_steps(f) if steps is None else steps
    steps = steps.join(f.log_times, "log_id")
    spans = step_spans(steps, ["log_id", "rep", "buff_id", "t0", "t1", "duration_ms"], "time", "stacks", F.col("t1"))
    span = F.col("stop") - F.col("start")
    length = F.greatest(F.first("duration_ms"), F.lit(1))
    return spans.groupBy("log_id", "rep", "buff_id").agg(
        F.round(F.sum(F.when(F.col("stacks") > 0, span).otherwise(0)) * 100.0 / length, 3).alias("uptime"), F.round(F.sum(span * F.col("stacks")) / length, 3).alias("stacks")
    )


def boon_count(f: Frames, steps: DataFrame | None = None) -> DataFrame:
    """How many different boons each account has, as steps."""
    steps = stack_steps(f) if steps is None else steps
    has = steps.filter(F.col("buff_id").isin(*BOONS)).withColumn("n", F.least("stacks", F.lit(1)))
    return merge_steps(has.select("log_id", "rep", "buff_id", "time", "n"), ["log_id", "rep"], "buff_id", "time", "n")


def applied_time(f: Frames) -> DataFrame:
    """What each source applied of a buff: applications and their total ms."""
    rows = buff_events(f).filter("kind = 'apply'")
    return rows.groupBy("log_id", "rep", "buff_id", "source").agg(F.count("*").alias("applied"), F.sum("ms").alias("applied_ms"))


def queue_spans(applies: DataFrame, keys: list[str], time: str, ms: str, order: str = "seq") -> DataFrame:
    """Busy spans (start, stop) of a queue without capacity or removal, by windows alone: with S the
    running sum of times, an application ends at S + running max(t - S before it)."""
    w = Window.partitionBy(*keys).orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = applies.withColumn("_s", F.sum(ms).over(w))
    rows = rows.withColumn("stop", F.col("_s") + F.max(F.col(time) - (F.col("_s") - F.col(ms))).over(w))
    return rows.withColumn("start", F.col("stop") - F.col(ms)).drop("_s")


def parallel_steps(applies: DataFrame, keys: list[str], time: str, ms: str) -> DataFrame:
    """Number of stacks that run side by side without capacity or removal, as steps (t, n)."""
    from ..plans.joins import overlap_counts

    return overlap_counts(applies.withColumn("_stop", F.col(time) + F.col(ms)).filter(f"{ms} > 0"), keys, time, "_stop")


