"""From the canonical tables of logs to the frames that all operators read: accounts, teams and sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities
from .frames import Frames


def resolve(events: DataFrame, agents: DataFrame, real_teams: tuple[int, ...] = ()) -> Frames:
    """Frames of logs, from their events (with post_era) and agents.

    Players of one account are one, by its first agent.  A player is a friend as ``affinity`` says, from who
    treats whom as friend or foe; where it says nothing, if its team is the recorder's, if it stands in a
    subgroup, or if its team is 0.  Friends are the squad, the other players enemies, as are other agents that
    a friend's row is hostile to, or whose team is known and not the recorder's.  ``real_teams``: the ids of
    sides; an agent's first row of such a team decides, or else its first row of any."""
    bare = Frames(events, agents, events.select("log_id").distinct(), agents, agents)
    told = entities.described(agents).withColumn("subgroup", F.coalesce("subgroup", F.lit(0)))
    players = told.filter("kind = 'player'")
    recorder = entities.recorders(events)
    teams = entities.resolved_teams(events, list(real_teams))
    own = recorder.join(teams, ["log_id", "addr"]).select("log_id", F.col("team").alias("friendly_team"))
    logs = bare.logs.join(own, "log_id", "left")
    same = entities.same_accounts(players, entities.first_instid(bare))
    member = players.select("log_id", "addr", "subgroup", "ord").join(same, ["log_id", "addr"])
    says = entities.affinity(bare, member, recorder.join(member.select("log_id", "addr"), ["log_id", "addr"], "left_semi"))
    says = member.join(says, ["log_id", "addr"]).groupBy("log_id", "rep").agg(F.min_by("friendly", "ord").alias("says"))
    account = member.filter("addr = rep").select("log_id", "rep", "subgroup")
    account = account.join(teams.withColumnRenamed("addr", "rep"), ["log_id", "rep"], "left").join(logs, "log_id").join(says, ["log_id", "rep"], "left")
    known = F.coalesce(F.col("team") == F.col("friendly_team"), F.lit(False)) | (F.col("subgroup") != 0) | F.coalesce(F.col("team") == 0, F.lit(False))
    account = account.select("log_id", "rep", "team", F.when(F.coalesce("says", known), "squad").otherwise("enemy").alias("side"))
    sided = member.drop("ord").join(account, ["log_id", "rep"])
    friends = sided.filter("side = 'squad'").select("log_id", F.col("addr").alias("src_agent"))
    others = told.filter("kind != 'player'").select("log_id", "addr").distinct()
    struck = events.filter("is_statechange = 0 and iff = 1").join(friends, ["log_id", "src_agent"], "left_semi").select("log_id", F.col("dst_agent").alias("addr")).distinct()
    others = others.join(struck.withColumn("struck", F.lit(True)), ["log_id", "addr"], "left").join(teams, ["log_id", "addr"], "left").join(logs, "log_id")
    others = others.filter(F.col("struck") | (F.col("team").isNotNull() & (F.col("friendly_team").isNull() | (F.col("team") != F.col("friendly_team")))))
    columns = ("log_id", "addr", "rep", "side", "team", "subgroup")
    npcs = others.select("log_id", "addr", F.col("addr").alias("rep"), F.lit("enemy").alias("side"), "team", F.lit(0).alias("subgroup"))
    return Frames(events, sided.select(*columns).unionByName(npcs), logs, teams, agents.select("log_id", "addr").distinct())
