"""Live views over a stream of events: an addition to what the batch operators give.

The stream carries the canonical columns and ``ts``, a row's wall-clock time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import count_if, damage, is_combat_row, is_crowd_control, is_health_damage
from ..plans.joins import small
from ..schema import Result


def live_damage(stream: DataFrame, roster: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Damage of each account on enemies by window of time; rows later than ``late`` are left out."""
    squad = roster.filter("side = 'squad'").select("log_id", F.col("addr").alias("src_agent"), "rep")
    enemy = roster.filter("side = 'enemy'").select("log_id", F.col("addr").alias("dst_agent"))
    rows = stream.withWatermark("ts", late).filter(is_combat_row() & is_health_damage()).withColumn("dmg", damage()).filter("dmg > 0")
    rows = rows.join(small(squad), ["log_id", "src_agent"]).join(small(enemy), ["log_id", "dst_agent"], "left_semi")
    return rows.groupBy(F.window("ts", every), "log_id", "rep").agg(F.sum("dmg").alias("damage"), F.count("*").alias("hits"))


def live_timeline(stream: DataFrame, every: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Damage, crowd control and downs of a log by window of time."""
    rows = stream.withWatermark("ts", late).filter("is_statechange = 0")
    hit = is_combat_row() & is_health_damage()
    return rows.groupBy(F.window("ts", every), "log_id").agg(
        F.coalesce(F.sum(F.when(hit, damage())), F.lit(0)).alias("damage"), count_if(is_crowd_control()).alias("cc"), count_if(F.col("result") == Result.DOWNED).alias("downs")
    )
