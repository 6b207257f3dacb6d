"""Reports over a set of logs: nested JSON, flat CSV and tables to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import buffs, damage, series, support
from .frames import Frames

#: Blocks of a report: name -> (operator, whether it must be asked for).
BLOCKS = {
    "damage": (damage.squad_damage, False), "taken": (damage.damage_taken, False), "hit_stats": (damage.hit_stats, False), "defenses": (damage.defenses, False),
    "downs": (damage.downs_and_kills, False), "support": (support.cleanses_and_strips, False), "healing": (support.healing, False), "casts": (series.cast_summary, False),
    "missiles": (support.missiles, True), "focus": (support.focus, True), "boons": (buffs.uptime, True), "skills": (damage.skill_damage, True), "series": (series.cumulative_damage, True),
}


def entities(f: Frames) -> DataFrame:
    """(log_id, entity, rep, side): numbers from 0 in the order squad, enemy, team, subgroup, address."""
    rows = f.roster.groupBy("log_id", "rep", "side").agg(F.min("team").alias("team"), F.max("subgroup").alias("subgroup"))
    order = Window.partitionBy("log_id").orderBy(F.when(F.col("side") == "squad", 0).otherwise(1), "team", "subgroup", "rep")
    return rows.select("log_id", (F.row_number().over(order) - 1).alias("entity"), "rep", "side", "team", "subgroup")


def report(f: Frames, wanted: tuple[str, ...] = ()) -> DataFrame:
    """One row per log: its times, its entities, and a map from entity to rows for every block that runs.

    ``coverage`` tells for each block whether it has rows (``present``), none (``empty``) or was not asked
    for (``not_computed``).  Blocks that are not asked for are not planned."""
    who = entities(f)
    out = f.bounds.select("log_id", "t0", "duration_ms")
    listed = who.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("entity", "rep", "side", "team", "subgroup"))).alias("entities"))
    out = out.join(listed, "log_id", "left")
    coverage = []
    for name, (operator, optional) in BLOCKS.items():
        if optional and name not in wanted:
            coverage.append(F.struct(F.lit(name).alias("block"), F.lit("not_computed").alias("state")))
            continue
        rows = operator(f).join(who.filter("side = 'squad'").select("log_id", "rep", "entity"), ["log_id", "rep"])
        row = F.struct(*(c for c in rows.columns if c not in ("log_id", "rep", "entity")))
        by = rows.groupBy("log_id", "entity").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        by = by.groupBy("log_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "rows")))).alias(name))
        out = out.join(by, "log_id", "left")
        coverage.append(F.struct(F.lit(name).alias("block"), F.when(F.col(name).isNull(), "empty").otherwise("present").alias("state")))
    return out.withColumn("coverage", F.map_from_entries(F.array(*coverage)))


def write_json(f: Frames, path: str, wanted: tuple[str, ...] = ()) -> None:
    """A JSON object per log, written by the tasks."""
    report(f, wanted).write.mode("overwrite").json(path)


def summary(f: Frames) -> DataFrame:
    """One row per account: what the damage table and the CSV show, the most damage first within a log."""
    keys = ["log_id", "rep"]
    out = f.roster.filter("side = 'squad'").select(*keys).distinct()
    for part in (damage.squad_damage(f), damage.damage_taken(f), damage.downs_and_kills(f), support.cleanses_and_strips(f)):
        out = out.join(part, keys, "left")
    return out.fillna(0).orderBy("log_id", F.desc("damage"), "rep")


def write_csv(f: Frames, path: str) -> None:
    summary(f).write.mode("overwrite").option("header", True).csv(path)


def show(f: Frames, view: str = "damage", rows: int = 50) -> None:
    """Print a view: a block, or ``damage`` for the summary."""
    (summary(f) if view == "damage" else BLOCKS[view][0](f)).show(rows, truncate=24)
