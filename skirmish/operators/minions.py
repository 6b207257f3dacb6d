"""What pets took, by owner and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import count_if, damage, is_combat_row, outcome, sum_if
from ..plans.frames import Frames
from ..schema import Result
from .damage import pet_owners


def minion_damage_taken(f: Frames, agents: DataFrame) -> DataFrame:
    """By account, pet name (``agents``: log_id, addr, character) and skill: rows, hits and damage on the
    pets whose first known owner is in the squad; skills with buff rows keep no outcomes of direct ones."""
    owners = pet_owners(f).join(f.members("squad", "owner", "rep"), ["log_id", "owner"])
    owners = owners.join(f.roster.select("log_id", "addr"), ["log_id", "addr"], "left_anti").select("log_id", F.col("addr").alias("dst_agent"), "rep")
    names = agents.groupBy("log_id", F.col("addr").alias("dst_agent")).agg(F.first("character").alias("minion"))
    rows = f.events.filter(is_combat_row()).withColumn("o", outcome()).withColumn("dmg", damage())
    rows = rows.filter((F.col("o").isNotNull() | F.col("result").isin(Result.DOWNED, Result.KILLING_BLOW)) & (F.col("result") != Result.CROWD_CONTROL))
    rows = rows.join(owners, ["log_id", "dst_agent"]).join(names, ["log_id", "dst_agent"])
    marker = (F.col("buff") == 0) & F.col("result").isin(Result.INTERRUPT, Result.KILLING_BLOW, Result.DOWNED)
    got = rows.groupBy("log_id", "rep", "minion", "skillid").agg(
        F.bool_or(F.col("buff") == 1).alias("indirect"), count_if(~marker).alias("hits"), count_if(F.col("o") == "hit").alias("connected_hits"),
        sum_if(F.col("o") == "hit", F.col("dmg")).alias("damage"), *(count_if(F.col("o") == o).alias(o) for o in ("blocked", "evaded", "missed")),
    )
    return got.select("log_id", "rep", "minion", "skillid", "hits", "connected_hits", "damage", *(F.when(F.col("indirect"), 0).otherwise(F.col(o)).cast("bigint").alias(o) for o in ("blocked", "evaded", "missed")))
