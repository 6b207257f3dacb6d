"""Who took part: agents, teams, sides, accounts, markers and the log's own facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_cast_start, is_combat_row
from ..plans.frames import Frames, shared_folder
from ..plans.joins import asof_join, small
from ..schema import State

NO_PLAYER = 0xFFFFFFFF
#: Base professions by number (fixed values).
PROFESSIONS = ("Guardian", "Warrior", "Engineer", "Ranger", "Thief", "Elementalist", "Mesmer", "Necromancer", "Revenant")
#: Elite specializations by number (fixed values).
SPECIALIZATIONS = {
    5: "Druid", 7: "Daredevil", 18: "Berserker", 27: "Dragonhunter", 34: "Reaper", 40: "Chronomancer", 43: "Scrapper", 48: "Tempest", 52: "Herald",
    55: "Soulbeast", 56: "Weaver", 57: "Holosmith", 58: "Deadeye", 59: "Mirage", 60: "Scourge", 61: "Spellbreaker", 62: "Firebrand", 63: "Renegade",
    64: "Harbinger", 65: "Willbender", 66: "Virtuoso", 67: "Catalyst", 68: "Bladesworn", 69: "Vindicator", 70: "Mechanist", 71: "Specter", 72: "Untamed",
    73: "Troubadour", 74: "Paragon", 75: "Amalgam", 76: "Ritualist", 77: "Antiquary", 78: "Galeshot", 79: "Conduit", 80: "Evoker", 81: "Luminary",
}


def agent_kind() -> Column:
    """player, gadget or npc, from is_elite and prof."""
    return F.when(F.col("is_elite") != NO_PLAYER, "player").when(F.shiftright("prof", 16) == 0xFFFF, "gadget").otherwise("npc")


def _named(column: str, names: dict[int, str]) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.col(column).cast("bigint"))


def profession() -> Column:
    return F.coalesce(_named("prof", dict(enumerate(PROFESSIONS, 1))), F.col("prof").cast("string"))


def specialization() -> Column:
    return F.when(F.col("is_elite") == 0, "").otherwise(F.coalesce(_named("is_elite", SPECIALIZATIONS), F.lit("")))


def account_name(column: str = "account") -> Column:
    """Without one leading colon, unless that is all."""
    return F.when(F.col(column) == ":", ":").otherwise(F.regexp_replace(column, "^:", ""))


def described(agents: DataFrame) -> DataFrame:
    return agents.withColumns({"kind": agent_kind(), "profession": profession(), "specialization": specialization(), "account": account_name()})


def first_instid(f: Frames) -> DataFrame:
    """(log_id, addr, instid): the session id an address used first."""
    return f.ends.groupBy("log_id", "addr").agg(F.min_by("instid", F.struct("time", "instid")).alias("instid"))


def recorders(events: DataFrame) -> DataFrame:
    """(log_id, addr): who recorded a log, by its last such row."""
    return events.filter(F.col("is_statechange") == State.POINT_OF_VIEW).groupBy("log_id").agg(F.max_by("src_agent", "seq").alias("addr"))


def resolved_teams(events: DataFrame, real: list[int]) -> DataFrame:
    """(log_id, addr, team): an agent's first real team, or else its first."""
    rows = events.filter(F.col("is_statechange") == State.TEAM).select("log_id", F.col("src_agent").alias("addr"), F.col("dst_agent").cast("int").alias("team"), "seq")
    return rows.groupBy("log_id", "addr").agg(F.min_by("team", F.struct(~F.col("team").isin(*real), "seq")).alias("team"))


def same_accounts(players: DataFrame, instids: DataFrame) -> DataFrame:
    """(log_id, addr, rep): rep is the address of an account's first agent, by its place in the agent
    table (``ord``); agents without an account are one by their first session id, without either alone."""
    rows = players.join(instids, ["log_id", "addr"], "left")
    name = account_name()
    key = F.when(name != "", F.concat(F.lit("a"), name)).when(F.col("instid").isNotNull(), F.concat(F.lit("i"), F.col("instid").cast("string"))).otherwise(F.concat(F.lit("x"), F.col("addr").cast("string")))
    rows = rows.withColumn("key", key)
    first = rows.groupBy("log_id", "key").agg(F.min_by("addr", "ord").alias("rep"))
    return rows.join(first, ["log_id", "key"]).select("log_id", "addr", "rep").distinct()


def affinity(f: Frames, players: DataFrame, recorder: DataFrame) -> DataFrame:
    """(log_id, addr, friendly): sides from who treats whom as friend or foe, starting at the recorder.

    Each round settles the players whose settled neighbours give a majority; rounds end when none
    settles.  Edges are counted once, by pair, and stored; a round is one join and one sum, and stored in the
    place of the round before."""
    shared_folder(f.events.sparkSession)
    rows = f.events.filter(is_combat_row() & (F.col("iff") <= 1) & ((F.col("value") != 0) | (F.col("buff_dmg") != 0)) & (F.col("src_agent") != F.col("dst_agent")))
    for end in ("src_agent", "dst_agent"):
        rows = rows.join(small(players.select("log_id", F.col("addr").alias(end)).distinct()), ["log_id", end], "left_semi")
    sign = F.when(F.col("iff") == 0, 1).otherwise(-1)
    edges = rows.groupBy("log_id", F.col("src_agent").alias("a"), F.col("dst_agent").alias("b")).agg(F.sum(sign).alias("w"))
    edges = edges.union(edges.select("log_id", F.col("b"), F.col("a"), "w")).groupBy("log_id", "a", "b").agg(F.sum("w").alias("w")).checkpoint()
    settled = recorder.select("log_id", "addr", F.lit(1).alias("side"))
    n = settled.count()
    while True:
        open_ = edges.join(settled.withColumnRenamed("addr", "a"), ["log_id", "a"], "left_anti")
        votes = open_.join(settled.withColumnRenamed("addr", "b"), ["log_id", "b"]).groupBy("log_id", F.col("a").alias("addr")).agg(F.sum(F.col("w") * F.col("side")).alias("v"))
        new = votes.filter("v != 0").select("log_id", "addr", F.signum("v").cast("int").alias("side"))
        settled = settled.union(new).checkpoint()
        if (now := settled.count()) == n:
            break
        n = now
    return settled.select("log_id", "addr", (F.col("side") > 0).alias("friendly"))


def participants(f: Frames) -> DataFrame:
    """(log_id, addr): agents that entered combat, cast, or struck or ticked."""
    entered = F.col("is_statechange") == State.ENTER_COMBAT
    hurt = is_combat_row() & ((F.col("value") > 0) | (F.col("buff_dmg") > 0))
    return f.events.filter(entered | is_cast_start() | hurt).select("log_id", F.col("src_agent").alias("addr")).distinct()


def orphans_repaired(events: DataFrame, slack: int = 300) -> DataFrame:
    """Events in which an end without an address but with a session id gets the agent that used the id and
    was seen within ``slack`` ms, of several the one seen first.  Windows are those of the rows that name
    an agent; a repaired row does not widen them."""
    seen = events.select("log_id", "time", F.explode(F.array(F.struct(F.col("src_agent").alias("addr"), F.col("src_instid").alias("instid")), F.struct(F.col("dst_agent").alias("addr"), F.col("dst_instid").alias("instid")))).alias("e"))
    windows = seen.select("log_id", "time", "e.*").filter("addr != 0 and instid != 0").groupBy("log_id", "instid", "addr").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    for end in ("src", "dst"):
        lost = events.filter(f"{end}_agent = 0 and {end}_instid > 0").select("log_id", "seq", "time", F.col(f"{end}_instid").alias("instid"))
        near = lost.join(windows, ["log_id", "instid"]).filter((F.col("time") >= F.col("first") - slack) & (F.col("time") <= F.col("last") + slack))
        found = near.groupBy("log_id", "seq").agg(F.min_by("addr", F.struct("first", "addr")).alias("_found"))
        events = events.join(found, ["log_id", "seq"], "left").withColumn(f"{end}_agent", F.coalesce("_found", f"{end}_agent")).drop("_found")
    return events


def marker_spans(f: Frames) -> DataFrame:
    """(log_id, addr, marker, start, stop): a marker (value) lasts to the agent's next marker row or the
    log's end; value 0 only closes."""
    rows = f.events.filter(F.col("is_statechange") == State.MARKER).select("log_id", F.col("src_agent").alias("addr"), "time", "seq", F.col("value").alias("marker"))
    w = Window.partitionBy("log_id", "addr").orderBy("time", "seq")
    rows = rows.withColumn("stop", F.lead("time").over(w)).join(f.log_times, "log_id")
    return rows.filter("marker != 0").select("log_id", "addr", "marker", (F.col("time") - F.col("t0")).alias("start"), (F.coalesce("stop", "t1") - F.col("t0")).alias("stop"))


def ground_markers(f: Frames) -> DataFrame:
    """(log_id, index, start, stop, x, y, z): placed spots of each index (skillid); NaN removes, the same
    spot again (to 1e-6) changes nothing."""
    rows = f.events.filter(F.col("is_statechange") == State.GROUND_MARKER).select("log_id", F.col("skillid").alias("index"), "time", "seq", "x", "y", "z")
    bad = lambda k: F.isnan(k) | F.col(k).isNull() | (F.abs(k) == float("inf"))
    rows = rows.withColumn("gone", bad("x") | bad("y"))
    w = Window.partitionBy("log_id", "index").orderBy("time", "seq")
    was = lambda k: F.lag(k).over(w)
    near = (F.abs(F.col("x") - was("x")) < 1e-6) & (F.abs(F.col("y") - was("y")) < 1e-6) & (F.abs(F.col("z") - was("z")) < 1e-6)
    same = F.when(was("gone").isNull(), F.col("gone")).otherwise((F.col("gone") & was("gone")) | (~F.col("gone") & ~was("gone") & near))
    rows = rows.withColumn("same", same).filter("not same").withColumn("stop", F.lead("time").over(w)).filter("not gone").join(f.log_times, "log_id")
    return rows.select("log_id", "index", (F.col("time") - F.col("t0")).alias("start"), (F.coalesce("stop", "t1") - F.col("t0")).alias("stop"), "x", "y", "z")


def tick_rate(f: Frames) -> DataFrame:
    """(log_id, average, lowest): server ticks a second between following tick rows that move on."""
    rows = f.events.filter(F.col("is_statechange") == State.TICK).select("log_id", "time", "seq", F.col("src_agent").alias("tick"))
    w = Window.partitionBy("log_id").orderBy("seq")
    rows = rows.withColumn("ms", F.col("time") - F.lag("time").over(w)).withColumn("ticks", F.col("tick") - F.lag("tick").over(w)).filter("ms > 0 and ticks > 0")
    return rows.groupBy("log_id").agg(F.round(F.sum("ticks") * 1000.0 / F.sum("ms"), 6).alias("average"), F.round(F.min(F.col("ticks") * 1000.0 / F.col("ms")), 6).alias("lowest"))


def guilds(events: DataFrame) -> DataFrame:
    """(log_id, addr, guild): the 16 bytes of an agent's first guild row, little-endian halves, as hex."""
    rows = events.filter(F.col("is_statechange") == State.GUILD)
    halves = F.concat(F.lpad(F.hex("dst_agent"), 16, "0"), F.lpad(F.hex(F.col("value").cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"), F.lpad(F.hex(F.col("buff_dmg").cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return rows.groupBy("log_id", F.col("src_agent").alias("addr")).agg(F.min_by(halves, "seq").alias("guild"))


def objective_owners(events: DataFrame, objectives: DataFrame) -> DataFrame:
    """(log_id, objective_id, name, at, owner): changes of the owner of the objectives of a table
    (objective_id, name); the row's source names the objective, its value the owner."""
    rows = events.filter(F.col("is_statechange") == State.OBJECTIVE).select("log_id", F.col("src_agent").alias("objective_id"), "time", "seq", F.col("value").alias("owner"))
    w = Window.partitionBy("log_id", "objective_id").orderBy("time", "seq")
    rows = rows.withColumn("was", F.lag("owner").over(w)).filter(~F.col("was").eqNullSafe(F.col("owner")))
    return rows.join(small(objectives), "objective_id").select("log_id", "objective_id", "name", F.col("time").alias("at"), "owner")


def owner_at(f: Frames, probes: DataFrame, instid: str = "instid") -> DataFrame:
    """Probes (log_id, ``instid``, time, ...) with the address that used the session id then."""
    return asof_join(probes, f.ownership.withColumnRenamed("instid", instid), ["log_id", instid], "time", "addr", out="owner")


def skill_names(ids: DataFrame, *tables: DataFrame) -> DataFrame:
    """(id, name): the first table that names an id wins, later rows of a table over earlier ones; else
    "Skill <id>".  Names that are blank or the id itself are none."""
    out = ids.select("id").distinct()
    names = []
    for k, t in enumerate(tables):
        good = (F.trim("name") != "") & (F.trim("name") != F.col("id").cast("string"))
        out = out.join(small(t.filter(good).groupBy("id").agg(F.last("name").alias(f"n{k}"))), "id", "left")
        names.append(F.col(f"n{k}"))
    return out.select("id", F.coalesce(*names, F.concat(F.lit("Skill "), F.col("id").cast("string"))).alias("name"))
