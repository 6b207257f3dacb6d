"""Instant casts, found by rules over what they cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import damage, is_combat_row
from ..plans.frames import Frames
from ..plans.joins import small
from ..schema import Result, State
from .buffs import buff_events

#: What a rule looks for (gain, give, loss, extend, damage, breakbar), its id, the skill that was cast, the
#: least gap between casts, the shift in time, and a near event that must or must not be there.
RULES = "rule_id int, trigger string, trigger_id bigint, skill_id bigint, gap_ms bigint, offset_ms bigint, near_buff bigint, near_ms bigint, near_wanted boolean"
SAMPLE_RULES = (
    (1, "gain", 740, 9001, 50, 0, None, None, None),
    (2, "give", 717, 9002, 50, 0, None, None, None),
    (3, "loss", 1122, 9003, 50, 0, None, None, None),
    (4, "damage", 150, 9004, 500, 0, None, None, None),
    (5, "gain", 725, 9005, 50, -10, 740, 2000, True),
    (6, "gain", 1122, 9006, 50, 0, 717, 2000, False),
)


def triggers(f: Frames) -> DataFrame:
    """(log_id, trigger, trigger_id, caster, time, seq) of the squad: buff rows and hits."""
    buffs = buff_events(f)
    source = buffs.join(f.members("squad", "source", "giver"), ["log_id", "source"], "left")
    rows = [
        buffs.filter("kind = 'apply'").select("log_id", F.lit("gain").alias("trigger"), F.col("buff_id").alias("trigger_id"), F.col("rep").alias("caster"), "time", "seq"),
        source.filter("kind = 'apply' and giver is not null").select("log_id", F.lit("give"), "buff_id", "giver", "time", "seq"),
        buffs.filter("kind in ('single', 'all')").select("log_id", F.lit("loss"), "buff_id", "rep", "time", "seq"),
        buffs.filter("kind = 'extend'").select("log_id", F.lit("extend"), "buff_id", "rep", "time", "seq"),
    ]
    hits = f.events.filter(is_combat_row()).withColumn("dmg", damage()).filter("dmg > 0").join(f.side("squad", "src"), ["log_id", "src_agent"])
    kind = F.when(F.col("result") == Result.BREAKBAR, "breakbar").otherwise("damage")
    rows.append(hits.select("log_id", kind, "skillid", "src_rep", "time", "seq"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def spaced(hits: DataFrame, keys: list[str], time: str, gap: str, order: str = "seq") -> DataFrame:
    """Hits at least ``gap`` after the one before of their key, taken or not: each starts the wait anew."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    return hits.withColumn("_was", F.lag(time).over(w)).filter(F.col("_was").isNull() | (F.col(time) - F.col("_was") >= F.col(gap))).drop("_was")


def instant_casts(f: Frames, rules: DataFrame | None = None) -> DataFrame:
    """(log_id, caster, skill_id, rule_id, time): triggers that pass their rule's check, at its gap."""
    rules = f.events.sparkSession.createDataFrame(list(SAMPLE_RULES), RULES) if rules is None else rules
    seen = triggers(f)
    hits = seen.join(small(rules), ["trigger", "trigger_id"])
    gains = seen.filter("trigger = 'gain'").select("log_id", "caster", F.col("trigger_id").alias("near_buff"), F.col("time").alias("near_time")).distinct()
    checked = hits.filter("near_buff is not null")
    widest = rules.agg(F.coalesce(F.max("near_ms"), F.lit(1))).first()[0]
    spot = checked.select("log_id", "rule_id", "caster", "seq", "near_buff", "time", "near_ms")
    bucket = F.floor(F.col("time") / widest)
    spot = spot.withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = spot.join(gains.withColumn("b", F.floor(F.col("near_time") / widest)), ["log_id", "caster", "near_buff", "b"]).filter(F.abs(F.col("near_time") - F.col("time")) < F.col("near_ms"))
    near = near.select("log_id", "rule_id", "caster", "seq").distinct().withColumn("is_near", F.lit(True))
    hits = hits.join(near, ["log_id", "rule_id", "caster", "seq"], "left")
    hits = hits.filter(F.col("near_buff").isNull() | (F.coalesce("is_near", F.lit(False)) == F.col("near_wanted")))
    kept = spaced(hits, ["log_id", "rule_id", "caster"], "time", "gap_ms")
    return kept.select("log_id", "caster", "skill_id", "rule_id", (F.col("time") + F.col("offset_ms")).alias("time"), "seq")


def weapon_swaps(f: Frames, within: int = 10) -> DataFrame:
    """(log_id, rep, time, weapon_set): swaps of the squad; of those less than ``within`` ms apart the first."""
    rows = f.events.filter(F.col("is_statechange") == State.WEAPON_SWAP).join(f.side("squad", "src"), ["log_id", "src_agent"])
    rows = rows.select("log_id", F.col("src_rep").alias("rep"), "time", "seq", F.col("dst_agent").alias("weapon_set"), F.lit(within).alias("gap"))
    return spaced(rows, ["log_id", "rep"], "time", "gap").drop("gap", "seq")
