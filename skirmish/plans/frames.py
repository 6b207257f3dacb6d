"""The frames of a set of logs, and what the operators derive from them again and again."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import damage, is_combat_row, is_health_damage
from ..schema import State
from .joins import MOST_BROADCAST, asof_join



def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster's machines share, from spark.checkpoint.dir; one of our own only
    where the session names none, as in local tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="skirmish-checkpoints-"))
    return sc.getCheckpointDir()


@dataclass
class Frames:
    """``events`` (schema.EVENTS with post_era), ``roster`` (schema.ROSTER) and ``logs`` (log_id,
    friendly_team).  ``teams``: (log_id, addr, team) of all agents that have one.  ``agents``: (log_id, addr)
    of the agent table; without it, all sources of rows and the roster."""

    events: DataFrame
    roster: DataFrame
    logs: DataFrame
    teams: DataFrame
    agents: DataFrame | None = None
    _held: list[DataFrame] = field(default_factory=list)

    def stored(self) -> Frames:
        """The same frames, written once as Parquet to the shared folder, with their times and the changes of
        ownership: what many operators read is then a scan of plain columns."""
        spark = self.events.sparkSession
        folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        events = kept(self.events, "events")
        first = Frames(events, self.roster, self.logs, self.teams)
        out = Frames(events, *(kept(getattr(self, x), x) for x in ("roster", "logs", "teams")), kept(self.known, "agents"))
        for name in ("bounds", "ownership"):
            out.__dict__[name] = kept(getattr(first, name), name)
        return out

    @cached_property
    def _small(self) -> bool:
        return self.roster.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST

    @cached_property
    def _few_logs(self) -> bool:
        return self.logs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST

    def like_roster(self, df: DataFrame) -> DataFrame:
        """A frame with at most a row per member of the roster, broadcast if that is counted to be small."""
        return F.broadcast(df) if self._small else df

    def like_logs(self, df: DataFrame) -> DataFrame:
        """A frame with a few rows per log, broadcast if the logs are counted to be few."""
        return F.broadcast(df) if self._few_logs else df

    @property
    def log_times(self) -> DataFrame:
        return self.like_logs(self.bounds)

    def side(self, name: str, end: str) -> DataFrame:
        """The roster's members of a side, keyed for one end of an event: src or dst."""
        return self.members(name, f"{end}_agent", f"{end}_rep")

    def members(self, name: str, addr: str, rep: str) -> DataFrame:
        return self.like_roster(self.roster.filter(F.col("side") == name).select("log_id", F.col("addr").alias(addr), F.col("rep").alias(rep)))

    @cached_property
    def bounds(self) -> DataFrame:
        """(log_id, t0, t1, duration_ms): the times of the first and the last row of a log."""
        return self.events.groupBy("log_id").agg(F.min_by("time", "seq").alias("t0"), F.max_by("time", "seq").alias("t1")).withColumn(
            "duration_ms", F.greatest(F.col("t1") - F.col("t0"), F.lit(0))
        )

    @property
    def known(self) -> DataFrame:
        """(log_id, addr) of the agent table."""
        if self.agents is not None:
            return self.agents.select("log_id", "addr").distinct()
        rows = self.events.filter(F.col("is_statechange") != State.EXTENSION).select("log_id", F.col("src_agent").alias("addr"))
        return rows.union(self.roster.select("log_id", "addr")).distinct()

    @property
    def ends(self) -> DataFrame:
        """(log_id, instid, time, seq, addr): which address used a session id, from both ends of all rows but
        extension ones; of a row's two ends the destination comes last."""
        rows = self.events.filter(~F.col("is_statechange").isin(State.EXTENSION, State.EXTENSION_COMBAT))
        ends = F.explode(F.array(
            F.struct(F.col("src_instid").alias("instid"), F.col("src_agent").alias("addr"), (F.col("seq") * 2).alias("seq")),
            F.struct(F.col("dst_instid").alias("instid"), F.col("dst_agent").alias("addr"), (F.col("seq") * 2 + 1).alias("seq")),
        ))
        return rows.select("log_id", "time", ends.alias("e")).select("log_id", "time", "e.*").filter("instid != 0 and addr != 0")

    @cached_property
    def ownership(self) -> DataFrame:
        """``ends`` where a session id changes its address; of a time the last counts."""
        seen = self.ends.groupBy("log_id", "instid", "time").agg(F.max_by("addr", "seq").alias("addr"), F.max("seq").alias("seq"))
        was = F.lag("addr").over(Window.partitionBy("log_id", "instid").orderBy("time"))
        return seen.withColumn("was", was).filter(~F.col("was").eqNullSafe(F.col("addr"))).drop("was")

    def owners(self, probes: DataFrame, instid: str, out: str) -> DataFrame:
        """Probes with the address that used the session id in column ``instid`` at their time."""
        known = self.ownership.select("log_id", F.col("instid").alias(instid), "time", "seq", "addr")
        return asof_join(probes, known, ["log_id", instid], "time", "addr", out=out)

    @cached_property
    def hits(self) -> DataFrame:
        """Combat rows with health damage, with ``dmg``."""
        return self.events.filter(is_combat_row() & is_health_damage()).withColumn("dmg", damage())

    @cached_property
    def credited_hits(self) -> DataFrame:
        """Squad damage on anything, pets included: log_id, rep, dst_agent, skillid, time, dmg, is_pet and
        the row's flags; zero damage is left out.

        A row of an agent outside the squad is its owner's if it is hostile, the agent's team is the
        friendly one (none equals none) and the owner at that time is in the squad."""
        kept = ["log_id", "time", "dst_agent", "skillid", "dmg", "result", "is_flanking", "buff", "seq"]
        rows = self.hits.filter("dmg > 0")
        own = rows.join(self.side("squad", "src"), ["log_id", "src_agent"]).select(*kept, F.col("src_rep").alias("rep"), F.lit(False).alias("is_pet"))
        others = rows.join(self.side("squad", "src"), ["log_id", "src_agent"], "left_anti").filter("iff != 0 and src_master_instid != 0")
        others = others.join(self.teams.withColumnRenamed("addr", "src_agent"), ["log_id", "src_agent"], "left").join(self.like_logs(self.logs), "log_id")
        others = others.filter(F.col("team").eqNullSafe(F.col("friendly_team"))).select(*kept, "src_master_instid")
        pets = self.owners(others, "src_master_instid", "owner").join(self.members("squad", "owner", "rep"), ["log_id", "owner"])
        return own.unionByName(pets.select(*kept, "rep", F.lit(True).alias("is_pet")))

    def hold(self, df: DataFrame) -> DataFrame:
        """Keep a frame that several reports of one job read; ``release`` lets all go."""
        self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        while self._held:
            self._held.pop().unpersist()
