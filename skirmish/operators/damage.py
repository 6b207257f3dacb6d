"""Damage dealt and taken, by account, target and skill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import (
    against_downed, barrier_part, can_be_critical, connected, count_if, damage, direct_hit, hit_kind, is_combat_row,
    is_condition, is_crowd_control, is_health_damage, is_cast_start, leech_hit, outcome, positive_value, sum_if,
)
from ..plans.frames import Frames
from ..schema import DODGE, Result


def squad_damage(f: Frames) -> DataFrame:
    """Damage of each account on enemies, with pets' on anything, and damage a second over the log."""
    on_enemy = f.credited_hits.join(f.members("enemy", "dst_agent", "dst_rep"), ["log_id", "dst_agent"], "left")
    total = on_enemy.filter("is_pet or dst_rep is not null").groupBy("log_id", "rep").agg(
        F.sum("dmg").alias("damage"), sum_if(F.col("is_pet"), F.col("dmg")).alias("pet_damage"), F.count("*").alias("hits")
    )
    seconds = F.greatest(F.col("duration_ms") / 1000.0, F.lit(1.0))
    return total.join(f.log_times, "log_id").select("log_id", "rep", "damage", "pet_damage", "hits", F.round(F.col("damage") / seconds, 3).alias("dps"))


def damage_per_target(f: Frames) -> DataFrame:
    rows = f.credited_hits.join(f.members("enemy", "dst_agent", "target"), ["log_id", "dst_agent"])
    return rows.groupBy("log_id", "rep", "target").agg(F.sum("dmg").alias("damage"), F.count("*").alias("hits"))


def damage_taken(f: Frames) -> DataFrame:
    rows = f.hits.filter("dmg > 0").join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    return rows.groupBy("log_id", F.col("dst_rep").alias("rep")).agg(F.sum("dmg").alias("damage_taken"))


def _skill_columns() -> list:
    return [
        F.sum("dmg").alias("total"), F.count("*").alias("hits"), F.min("dmg").alias("min"), F.max("dmg").alias("max"),
        count_if(F.col("result") == Result.CRIT).alias("crit_hits"), count_if(F.col("is_flanking") != 0).alias("flank_hits"),
    ]


def skill_damage(f: Frames) -> DataFrame:
    """Outgoing damage by skill, pets included."""
    on_enemy = f.credited_hits.join(f.members("enemy", "dst_agent", "dst_rep"), ["log_id", "dst_agent"], "left")
    return on_enemy.filter("is_pet or dst_rep is not null").groupBy("log_id", "rep", "skillid").agg(*_skill_columns())


def skill_damage_per_target(f: Frames) -> DataFrame:
    rows = f.credited_hits.join(f.members("enemy", "dst_agent", "target"), ["log_id", "dst_agent"])
    return rows.groupBy("log_id", "rep", "target", "skillid").agg(*_skill_columns())


def skill_damage_taken(f: Frames) -> DataFrame:
    rows = f.hits.filter("dmg > 0").join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    return rows.groupBy("log_id", F.col("dst_rep").alias("rep"), "skillid").agg(*_skill_columns())


def enemy_skill_damage(f: Frames) -> DataFrame:
    """Hostile rows of enemies by skill; rows that aren't hits keep the skill with no hit."""
    rows = f.hits.filter("iff != 0").filter(outcome().isNotNull()).join(f.side("enemy", "src"), ["log_id", "src_agent"])
    hit = connected()
    got = rows.groupBy("log_id", F.col("src_rep").alias("rep"), "skillid").agg(
        sum_if(hit, F.col("dmg")).alias("total"), count_if(hit).alias("hits"),
        F.coalesce(F.min(F.when(hit, F.col("dmg"))), F.lit(0)).alias("min"), F.coalesce(F.max(F.when(hit, F.col("dmg"))), F.lit(0)).alias("max"),
        count_if(hit & (F.col("result") == Result.CRIT)).alias("crit"), count_if(hit & (F.col("is_flanking") != 0)).alias("flank"),
        F.bool_or(F.col("buff") == 1).alias("indirect"),
    )
    return got.select(
        "log_id", "rep", "skillid", "total", "hits", "min", "max",
        F.when(F.col("indirect"), 0).otherwise(F.col("crit")).cast("bigint").alias("crit_hits"),
        F.when(F.col("indirect"), 0).otherwise(F.col("flank")).cast("bigint").alias("flank_hits"),
    )


def enemy_damage(f: Frames) -> DataFrame:
    """Hostile damage of agents outside the squad, at their first known owner or else themselves, where
    that is an enemy."""
    rows = f.hits.filter("dmg > 0 and iff != 0").join(f.side("squad", "src"), ["log_id", "src_agent"], "left_anti")
    owner = pet_owners(f).select("log_id", F.col("addr").alias("src_agent"), "owner")
    rows = rows.join(owner, ["log_id", "src_agent"], "left").withColumn("actor", F.coalesce("owner", "src_agent"))
    return rows.join(f.members("enemy", "actor", "rep"), ["log_id", "actor"]).groupBy("log_id", "rep").agg(F.sum("dmg").alias("damage_out"))


def pet_owners(f: Frames) -> DataFrame:
    """(log_id, addr, owner): each agent's first owner that a session id resolves to."""
    probes = f.events.filter("src_master_instid != 0").select("log_id", "time", "seq", "src_agent", "src_master_instid")
    found = f.owners(probes, "src_master_instid", "owner").filter("owner is not null")
    return found.groupBy("log_id", F.col("src_agent").alias("addr")).agg(F.min_by("owner", "seq").alias("owner"))


def combat_enemies(f: Frames) -> DataFrame:
    """Enemies that took or dealt damage, or received crowd control (breakbar damage counts here)."""
    combat = f.events.filter(is_combat_row() | is_crowd_control()).withColumn("dmg", damage())
    took = combat.filter((F.col("dmg") > 0) | is_crowd_control()).join(f.side("enemy", "dst"), ["log_id", "dst_agent"]).select("log_id", F.col("dst_rep").alias("rep"))
    dealt = f.hits.filter("dmg > 0 and iff != 0").join(f.side("enemy", "src"), ["log_id", "src_agent"]).select("log_id", F.col("src_rep").alias("rep"))
    return took.union(dealt).distinct()


def hit_stats(f: Frames) -> DataFrame:
    """Quality of the squad's own hits on enemies, zero damage included."""
    rows = f.events.filter(is_combat_row()).filter(connected()).withColumn("dmg", damage())
    rows = rows.join(f.side("squad", "src"), ["log_id", "src_agent"]).join(f.side("enemy", "dst"), ["log_id", "dst_agent"], "left_semi")
    # each flag is worked out once a row, not once an aggregate
    cond = is_condition()
    rows = rows.select(
        "log_id", F.col("src_rep").alias("rep"), "dmg", cond.alias("cond"), (~cond & direct_hit()).alias("direct"), (~cond & direct_hit() & can_be_critical()).alias("critable"),
        (F.col("result") == Result.CRIT).alias("crit"), (F.col("result") == Result.GLANCE).alias("glance"), (~cond & leech_hit()).alias("leech"),
        (F.col("is_ninety") != 0).alias("high"), (F.col("is_flanking") != 0).alias("flank"), against_downed().alias("down"), (F.col("is_moving").bitwiseAND(2) != 0).alias("moving"),
    )
    d, c = F.col("dmg"), F.col
    return rows.groupBy("log_id", "rep").agg(
        F.count("*").alias("connected_count"), F.sum(d).alias("connected_damage"),
        count_if(c("cond")).alias("condition_count"), sum_if(c("cond"), d).alias("condition_damage"),
        count_if(c("direct")).alias("direct_count"), sum_if(c("direct"), d).alias("direct_damage"), count_if(c("critable")).alias("critable_count"),
        count_if(c("critable") & c("crit")).alias("crit_count"), sum_if(c("critable") & c("crit"), d).alias("crit_damage"),
        count_if(c("direct") & c("flank")).alias("flank_count"), count_if(c("direct") & c("glance")).alias("glance_count"),
        count_if(c("leech")).alias("leech_count"), sum_if(c("leech"), d).alias("leech_damage"),
        count_if(~c("cond") & c("high")).alias("above90_power_count"), sum_if(~c("cond") & c("high"), d).alias("above90_power_damage"),
        count_if(c("cond") & c("high")).alias("above90_condition_count"), sum_if(c("cond") & c("high"), d).alias("above90_condition_damage"),
        count_if(c("down")).alias("downed_count"), sum_if(c("down"), d).alias("downed_damage"), count_if(c("moving")).alias("moving_count"),
    )


def defenses(f: Frames) -> DataFrame:
    """What came at the squad: outcomes, and damage taken by kind and by barrier."""
    rows = f.events.filter(is_combat_row() & (F.col("result") != Result.CROWD_CONTROL)).withColumn("dmg", damage())
    rows = rows.join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    rows = rows.select("log_id", F.col("dst_rep").alias("rep"), "dmg", outcome().alias("o"), hit_kind().alias("kind"), barrier_part().alias("shield")).filter("o is not null")
    hit, d, shield = F.col("o") == "hit", F.col("dmg"), F.col("shield")
    kind = lambda *names: hit & F.col("kind").isin(*names)
    columns = []
    for name, which in (("strike", ("strike",)), ("power", ("strike", "leech", "power")), ("condition", ("condition",)), ("leech", ("leech",))):
        columns += [count_if(kind(*which)).alias(f"{name}_count"), sum_if(kind(*which), d).alias(f"{name}_damage")]
    columns += [count_if(hit & (shield > 0)).alias("barrier_count"), sum_if(hit & (shield > 0), shield).alias("barrier_damage")]
    columns += [count_if(F.col("o") == o).alias(f"{o}_count") for o in ("blocked", "evaded", "missed", "invulned", "interrupted")]
    return rows.groupBy("log_id", "rep").agg(*columns)


def breakbar_and_control_taken(f: Frames) -> DataFrame:
    breakbar = is_combat_row() & (F.col("result") == Result.BREAKBAR)
    rows = f.events.withColumn("cc", is_crowd_control()).filter(F.col("cc") | breakbar).join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    v = positive_value()
    return rows.groupBy("log_id", F.col("dst_rep").alias("rep")).agg(
        count_if(F.col("cc")).alias("cc_count"), sum_if(F.col("cc"), v).alias("cc_ms"),
        count_if(~F.col("cc")).alias("breakbar_count"), sum_if(~F.col("cc"), v).alias("breakbar_damage"),
    )


def credited(f: Frames, rows: DataFrame) -> DataFrame:
    """Rows of the squad, and of others at a squad owner, with ``rep``."""
    columns = rows.columns
    own = rows.join(f.side("squad", "src"), ["log_id", "src_agent"]).withColumnRenamed("src_rep", "rep")
    others = rows.join(f.side("squad", "src"), ["log_id", "src_agent"], "left_anti").filter("src_master_instid != 0")
    pets = f.owners(others, "src_master_instid", "owner").join(f.members("squad", "owner", "rep"), ["log_id", "owner"])
    return own.select(*columns, "rep").unionByName(pets.select(*columns, "rep"))


def breakbar_dealt(f: Frames) -> DataFrame:
    rows = f.events.filter(is_combat_row() & (F.col("result") == Result.BREAKBAR) & (F.col("iff") != 0))
    return credited(f, rows).groupBy("log_id", "rep").agg(F.sum(positive_value()).alias("breakbar_dealt"))


def dodges(f: Frames) -> DataFrame:
    rows = f.events.filter(is_cast_start(DODGE)).join(f.side("squad", "src"), ["log_id", "src_agent"])
    return rows.groupBy("log_id", F.col("src_rep").alias("rep")).agg(F.count("*").alias("dodges"))


def downs_and_kills(f: Frames) -> DataFrame:
    """Downs and kills dealt by the squad and its pets, downs taken, deaths."""
    marks = f.events.filter(is_combat_row() & F.col("result").isin(Result.DOWNED, Result.KILLING_BLOW))
    dealt = credited(f, marks.join(f.side("enemy", "dst"), ["log_id", "dst_agent"], "left_semi"))
    dealt = dealt.select("log_id", "rep", F.when(F.col("result") == Result.DOWNED, "downs_dealt").otherwise("kills_dealt").alias("what"))
    taken = marks.filter(F.col("result") == Result.DOWNED).join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    taken = taken.select("log_id", F.col("dst_rep").alias("rep"), F.lit("downs_taken").alias("what"))
    deaths = f.events.filter("is_statechange = 4").join(f.side("squad", "src"), ["log_id", "src_agent"])
    deaths = deaths.select("log_id", F.col("src_rep").alias("rep"), F.lit("deaths").alias("what"))
    names = ("downs_dealt", "kills_dealt", "downs_taken", "deaths")
    return dealt.union(taken).union(deaths).groupBy("log_id", "rep").agg(*(count_if(F.col("what") == x).alias(x) for x in names))


def offence_per_target(f: Frames) -> DataFrame:
    """By account and target: marks credited to owners, and outcomes of the squad's own rows."""
    rows = f.events.filter(is_combat_row()).join(f.side("enemy", "dst"), ["log_id", "dst_agent"]).withColumnRenamed("dst_rep", "target")
    mark = F.col("result").isin(Result.DOWNED, Result.KILLING_BLOW, Result.INTERRUPT)
    names = {Result.DOWNED: "downed", Result.KILLING_BLOW: "killed", Result.INTERRUPT: "interrupts"}
    marks = credited(f, rows.filter(mark))
    own = rows.filter(~mark).join(f.side("squad", "src"), ["log_id", "src_agent"]).withColumnRenamed("src_rep", "rep")
    both = marks.select("*", F.lit(True).alias("mark")).unionByName(own.select(*marks.columns, F.lit(False).alias("mark")))
    both = both.withColumn("o", F.when(~F.col("mark"), outcome())).withColumn("dmg", damage())
    hit, direct, d = ~F.col("mark") & connected(), ~F.col("mark") & direct_hit(), F.col("dmg")
    out = both.groupBy("log_id", "rep", "target").agg(
        *(count_if(F.col("mark") & (F.col("result") == r)).alias(n) for r, n in names.items()),
        *(count_if(F.col("o") == o).alias(o) for o in ("blocked", "evaded", "missed", "invulned")),
        count_if(hit).alias("connected_hits"), sum_if(hit, d).alias("connected_damage"),
        count_if(direct).alias("direct_count"), sum_if(direct, d).alias("direct_damage"),
        count_if(direct & can_be_critical()).alias("critable_count"), count_if(direct & can_be_critical() & (F.col("result") == Result.CRIT)).alias("crit_count"),
        count_if(direct & (F.col("is_flanking") != 0)).alias("flank_count"), count_if(hit & against_downed()).alias("downed_hits"),
    )
    counts = [x for x in out.columns if x not in ("log_id", "rep", "target")]
    return out.filter(" + ".join(counts) + " > 0")


def skill_outcomes(f: Frames) -> DataFrame:
    """By account and skill: how the squad's rows on enemies ended; skills with buff rows keep no
    outcomes that only direct rows can have."""
    rows = f.events.filter(is_combat_row() & is_health_damage()).join(f.side("squad", "src"), ["log_id", "src_agent"])
    rows = rows.join(f.side("enemy", "dst"), ["log_id", "dst_agent"], "left_semi").withColumn("o", outcome())
    marker = (F.col("buff") == 0) & F.col("result").isin(Result.INTERRUPT, Result.KILLING_BLOW, Result.DOWNED)
    got = rows.groupBy("log_id", F.col("src_rep").alias("rep"), "skillid").agg(
        F.bool_or(F.col("buff") == 1).alias("indirect"), count_if(~marker).alias("hits"), count_if(F.col("o") == "hit").alias("connected_hits"),
        count_if((F.col("o") == "hit") & (F.col("result") == Result.GLANCE)).alias("glance"),
        *(count_if(F.col("o") == o).alias(o) for o in ("blocked", "evaded", "missed", "invulned", "interrupted")),
    )
    direct_only = ("glance", "missed", "evaded", "blocked", "interrupted")
    return got.select(
        "log_id", "rep", "skillid", "hits", "connected_hits", "invulned",
        *(F.when(F.col("indirect"), 0).otherwise(F.col(x)).cast("bigint").alias(x) for x in direct_only),
    )


