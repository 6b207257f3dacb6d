"""Crowd control, support, down contribution, focus, missiles and healing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import count_if, damage, is_boon, is_cast_start, is_combat_row, is_condition, is_crowd_control, is_health_damage, is_remove_all, positive_value, sum_if
from ..plans.frames import Frames
from ..plans.joins import band_join
from ..schema import RESURRECT, Result, State
from .damage import credited


def control_applied(f: Frames) -> DataFrame:
    """Crowd control on enemies by account and target, pets credited to their owners."""
    rows = f.events.filter(is_crowd_control()).join(f.side("enemy", "dst"), ["log_id", "dst_agent"]).withColumnRenamed("dst_rep", "target")
    return credited(f, rows).groupBy("log_id", "rep", "target").agg(F.count("*").alias("cc_count"), F.sum(positive_value()).alias("cc_ms"))


def control_taken(f: Frames) -> DataFrame:
    """One row per crowd control on the squad, in order of time and place in the log."""
    rows = f.events.filter(is_crowd_control()).join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    return rows.select("log_id", F.col("dst_rep").alias("rep"), "time", "seq", "src_agent", "skillid", positive_value().alias("cc_ms"))


def stun_breaks(f: Frames) -> DataFrame:
    rows = f.events.filter(F.col("is_statechange") == State.STUN_BREAK).join(f.side("squad", "src"), ["log_id", "src_agent"])
    return rows.groupBy("log_id", F.col("src_rep").alias("rep")).agg(F.count("*").alias("stun_breaks"), F.sum(positive_value()).alias("stun_break_ms"))


def cleanses_and_strips(f: Frames) -> DataFrame:
    """Removals by the squad: conditions from itself, from players with a subgroup or their pets; boons
    from enemies.  The holder is the row's source, the remover its destination."""
    rows = f.events.filter(is_remove_all() & (is_condition() | is_boon())).join(f.side("squad", "dst"), ["log_id", "dst_agent"])
    rows = rows.withColumnRenamed("dst_rep", "rep")
    real = f.roster.filter("side = 'squad' and subgroup != 0").select("log_id", "addr").distinct()
    holder = f.roster.select("log_id", F.col("addr").alias("src_agent"), F.col("rep").alias("holder_rep"), F.col("side").alias("holder_side"), (F.coalesce(F.col("subgroup"), F.lit(0)) != 0).alias("grouped"))
    rows = rows.join(f.like_roster(holder), ["log_id", "src_agent"], "left")
    holder_rep = F.coalesce("holder_rep", "src_agent")
    kind = (
        F.when(is_boon(), F.when(F.col("holder_side") == "enemy", "strips"))
        .when(holder_rep == F.col("rep"), "cleanses_self")
        .when((F.col("holder_side") == "squad") & F.col("grouped"), "cleanses")
        .otherwise("pet")
    )
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    pets = f.owners(rows.filter("kind = 'pet' and src_master_instid != 0"), "src_master_instid", "owner")
    pets = pets.join(real.withColumnRenamed("addr", "owner"), ["log_id", "owner"], "left_semi").withColumn("kind", F.lit("cleanses_minions"))
    both = rows.filter("kind != 'pet'").select("log_id", "rep", "kind").union(pets.select("log_id", "rep", "kind"))
    names = ("cleanses", "cleanses_self", "cleanses_minions", "strips")
    return both.groupBy("log_id", "rep").agg(*(count_if(F.col("kind") == n).alias(n) for n in names))


def resurrects(f: Frames) -> DataFrame:
    rows = f.events.filter(is_cast_start(RESURRECT)).join(f.side("squad", "src"), ["log_id", "src_agent"])
    return rows.groupBy("log_id", F.col("src_rep").alias("rep")).agg(F.count("*").alias("resurrects"))


def strips_taken(f: Frames) -> DataFrame:
    """Boons removed from the squad by another agent: the row's destination, or its master where the row
    names one that is known.  Removers that aren't in the agent table don't count."""
    rows = f.events.filter(is_remove_all() & is_boon()).join(f.side("squad", "src"), ["log_id", "src_agent"]).withColumnRenamed("src_rep", "rep")
    rows = rows.select("log_id", "time", "seq", "rep", "dst_agent", "dst_master_instid", positive_value().alias("ms"))
    rows = f.owners(rows, "dst_master_instid", "owner").withColumn("addr", F.coalesce("owner", "dst_agent")).join(f.known, ["log_id", "addr"], "left_semi")
    listed = f.like_roster(f.roster.groupBy("log_id", "addr").agg(F.min("rep").alias("remover")))
    rows = rows.join(listed, ["log_id", "addr"], "left").filter(F.coalesce("remover", "addr") != F.col("rep"))
    return rows.groupBy("log_id", "rep").agg(F.count("*").alias("strips_taken"), F.sum("ms").alias("stripped_ms"))


#: Health from which a fall begins, and times in ms (fixed values).
ANCHOR_PERCENT, LEAD_IN_MS, RESET_MS = 99, 2000, 2100


def down_windows(f: Frames) -> DataFrame:
    """Each down on an enemy or the squad with its window (lo, t_down]: from 2 s before the last time at
    99 % health (else the log's start), not before the end of the window before it."""
    marks = f.events.filter((F.col("is_statechange") == 0) & (F.col("result") == Result.DOWNED))
    sides = f.roster.select("log_id", F.col("addr").alias("dst_agent"), F.col("rep").alias("target_rep"), "side")
    marks = marks.join(f.like_roster(sides), ["log_id", "dst_agent"]).select("log_id", F.col("dst_agent").alias("target"), "target_rep", "side", "time", "seq")
    high = f.events.filter(F.col("is_statechange") == State.HEALTH).filter((F.col("dst_agent") <= 20000) & (F.col("dst_agent") >= ANCHOR_PERCENT * 100))
    high = high.select("log_id", F.col("src_agent").alias("target"), "time", F.col("time").alias("at"))
    # the last high time at or before each down, by one window over both
    both = marks.select("log_id", "target", "target_rep", "side", "time", "seq", F.lit(None).cast("bigint").alias("at"), F.lit(1).alias("k")).unionByName(
        high.select("log_id", "target", F.lit(None).cast("bigint").alias("target_rep"), F.lit(None).cast("string").alias("side"), "time", F.lit(-1).cast("bigint").alias("seq"), "at", F.lit(0).alias("k"))
    )
    w = Window.partitionBy("log_id", "target").orderBy("time", "k", "seq")
    downs = both.withColumn("anchor", F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("k = 1")
    own = Window.partitionBy("log_id", "target").orderBy("time", "seq")
    downs = downs.join(f.log_times.select("log_id", "t0"), "log_id").withColumn("reset", F.lag("time").over(own) + RESET_MS)
    lo = F.greatest(F.coalesce("anchor", "t0") - LEAD_IN_MS, F.col("t0"), F.coalesce("reset", F.lit(0)))
    return downs.select("log_id", "target", "target_rep", "side", F.col("time").alias("t_down"), F.col("seq").alias("down_seq"), lo.alias("lo"))


def down_contribution(f: Frames, width: int = 5000) -> DataFrame:
    """Damage and crowd control of each account inside the windows of enemies it brought down, pets
    credited; a row may count for several downs."""
    rows = f.events.filter((is_combat_row() & is_health_damage()) | is_crowd_control()).withColumn("cc", is_crowd_control())
    rows = rows.withColumn("dmg", F.when(~F.col("cc"), damage()).otherwise(F.lit(0).cast("bigint")))
    rows = credited(f, rows.withColumn("target", F.col("dst_agent")))
    windows = down_windows(f).filter("side = 'enemy' and lo <= t_down")
    inside = band_join(rows, windows, ["log_id", "target"], "time", "lo", "t_down", width)
    got = inside.groupBy("log_id", "rep", "target_rep").agg(
        F.sum("dmg").alias("damage"), count_if(F.col("cc")).alias("cc_count"), sum_if(F.col("cc"), positive_value()).alias("cc_ms"), F.countDistinct("down_seq").alias("downs")
    )
    return got.withColumnRenamed("target_rep", "target").filter("damage > 0 or cc_count > 0")


def focus(f: Frames, before_ms: int = 3000) -> DataFrame:
    """Enemy casts begun on each squad account, its share of all, and those in the 3 s before its downs."""
    casts = f.events.filter(F.col("post_era") & (F.col("is_statechange") == State.ANIMATION_START)).join(f.side("enemy", "src"), ["log_id", "src_agent"], "left_semi")
    casts = casts.join(f.side("squad", "dst"), ["log_id", "dst_agent"]).select("log_id", "time", "seq", F.col("dst_rep").alias("rep"))
    members = f.roster.filter("side = 'squad'").groupBy("log_id").agg(F.countDistinct("rep").alias("size"))
    by = casts.groupBy("log_id", "rep").agg(F.count("*").alias("casts_drawn"))
    all_ = by.groupBy("log_id").agg(F.sum("casts_drawn").alias("all_casts"))
    spans = down_windows(f).filter("side = 'squad'").select("log_id", F.col("target_rep").alias("rep"), (F.col("t_down") - before_ms).alias("lo"), "t_down")
    late = band_join(casts, spans, ["log_id", "rep"], "time", "lo", "t_down", before_ms).select("log_id", "rep", "seq").distinct()
    late = late.groupBy("log_id", "rep").agg(F.count("*").alias("casts_before_down"))
    out = by.join(f.like_logs(all_), "log_id").join(f.like_logs(members), "log_id").join(late, ["log_id", "rep"], "left")
    index = F.round(F.col("casts_drawn") * F.col("size") / F.col("all_casts"), 6)
    return out.select("log_id", "rep", "casts_drawn", index.alias("focus_index"), F.coalesce("casts_before_down", F.lit(0)).alias("casts_before_down"))


def missiles(f: Frames) -> DataFrame:
    """Missiles of each squad account: an id (``pad``) is used again, the latest creation owns it; of
    several removals the last decides."""
    rows = f.events.filter(F.col("is_statechange").isin(State.MISSILE_CREATE, State.MISSILE_LAUNCH, State.MISSILE_REMOVE))
    create = F.col("is_statechange") == State.MISSILE_CREATE
    w = Window.partitionBy("log_id", "pad").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("shot", F.sum(create.cast("int")).over(w)).filter("shot > 0")
    launch, remove = F.col("is_statechange") == State.MISSILE_LAUNCH, F.col("is_statechange") == State.MISSILE_REMOVE
    shots = rows.groupBy("log_id", "pad", "shot").agg(
        F.max(F.when(create, F.col("src_agent"))).alias("src_agent"),
        F.max_by(F.when(remove, F.col("is_flanking") != 0), F.when(remove, F.col("seq"))).alias("hit"),
        F.collect_set(F.when(launch & (F.col("is_flanking") == 0) & (F.col("dst_agent") != 0), F.col("dst_agent"))).alias("aimed"),
    )
    shots = shots.join(f.side("squad", "src"), ["log_id", "src_agent"])
    return shots.groupBy("log_id", F.col("src_rep").alias("rep")).agg(
        F.count("*").alias("fired"), count_if(F.col("hit")).alias("hit"), count_if(~F.col("hit")).alias("denied"),
        count_if(F.array_contains("aimed", F.col("src_agent"))).alias("reflected"),
    )


#: The healing extension: its signature and the revisions whose rows are understood (fixed values).
HEALING_SIGNATURE, HEALING_REVISIONS = 2627419289, (1, 2)


def healing_logs(f: Frames) -> DataFrame:
    """(log_id): logs in which the healing extension registered with a revision that is understood."""
    signature = F.col("src_agent").bitwiseAND(0xFFFFFFFF)
    revision = F.shiftright("src_agent", 32).bitwiseAND(0xFFFFFF)
    rows = f.events.filter((F.col("is_statechange") == State.EXTENSION) & (F.col("pad") == 0))
    return rows.filter((signature == HEALING_SIGNATURE) & revision.isin(*HEALING_REVISIONS)).select("log_id").distinct()


def healing_rows(f: Frames) -> DataFrame:
    """Healing and barrier on friends, by account: log_id, time, seq, rep, target, skillid, amount, direct,
    barrier, downed.

    Rows of the extension carry its signature and name both ends by session ids, which are resolved at
    their time; rows with an end that isn't known drop out.  Direct rows have no buff and a negative value, the
    others no value and a negative buff value.  Bits 6 and 7 of is_offcycle tell whose client sent a row: the
    target's or the source's (neither: the source's).  Where the source's client sent any row of a healer and
    kind, the others are copies and drop out; so for each agent, before pets' rows go to their owners."""
    bits = F.col("is_offcycle").cast("int")
    data = ((F.col("is_statechange") == State.EXTENSION) & (F.col("pad") != 0)) | (F.col("is_statechange") == State.EXTENSION_COMBAT)
    direct = F.col("buff") == 0
    shape = (direct & (F.col("value") < 0)) | (~direct & (F.col("value") == 0) & (F.col("buff_dmg") < 0))
    rows = f.events.filter(data & (F.col("pad") == HEALING_SIGNATURE) & (F.col("iff") == 0) & shape).join(f.like_logs(healing_logs(f)), "log_id", "left_semi")
    rows = rows.select(
        "log_id", "time", "seq", "src_instid", "dst_instid", "src_master_instid", "skillid", direct.alias("direct"), (F.col("is_shields") > 0).alias("barrier"),
        (-F.when(direct, F.col("value")).otherwise(F.col("buff_dmg")).cast("bigint")).alias("amount"),
        ((bits.bitwiseAND(32) != 0) | (direct & (bits.bitwiseAND(63) == 1))).alias("downed"),
        ((bits.bitwiseAND(128) != 0) | (bits.bitwiseAND(192) == 0)).alias("peer"),
    )
    rows = f.owners(f.owners(rows, "src_instid", "healer"), "dst_instid", "target").filter("healer is not null and target is not null")
    rows = rows.withColumn("any_peer", F.max("peer").over(Window.partitionBy("log_id", "healer", "barrier"))).filter("peer or not any_peer")
    own = rows.join(f.members("squad", "healer", "rep"), ["log_id", "healer"])
    others = rows.join(f.members("squad", "healer", "rep"), ["log_id", "healer"], "left_anti").filter("src_master_instid != 0")
    others = f.owners(others, "src_master_instid", "owner").join(f.members("squad", "owner", "rep"), ["log_id", "owner"])
    kept = ("log_id", "time", "seq", "rep", "target", "skillid", "amount", "direct", "barrier", "downed")
    both = own.select(*kept).union(others.select(*kept))
    known = f.like_roster(f.roster.select("log_id", F.col("addr").alias("target"), F.col("rep").alias("target_rep")).dropDuplicates(["log_id", "target"]))
    both = both.join(known, ["log_id", "target"], "left").withColumn("target", F.coalesce("target_rep", "target"))
    return both.select(*kept)


def healing(f: Frames) -> DataFrame:
    """Healing and barrier given by each squad account, pets' included."""
    heal, a, own = ~F.col("barrier"), F.col("amount"), F.col("target") == F.col("rep")
    return healing_rows(f).groupBy("log_id", "rep").agg(
        sum_if(heal, a).alias("healing"), sum_if(heal & own, a).alias("healing_self"), sum_if(heal & ~own, a).alias("healing_allies"),
        sum_if(F.col("barrier"), a).alias("barrier"), sum_if(heal & F.col("downed"), a).alias("healing_downed"),
    )


def running_healing_extension(f: Frames) -> DataFrame:
    """(log_id, addr): squad agents whose own extension sent rows, as healer or as target."""
    bits = F.col("is_offcycle").cast("int")
    direct = F.col("buff") == 0
    data = ((F.col("is_statechange") == State.EXTENSION) & (F.col("pad") != 0)) | (F.col("is_statechange") == State.EXTENSION_COMBAT)
    shape = (direct & (F.col("value") < 0)) | (~direct & (F.col("value") == 0) & (F.col("buff_dmg") < 0))
    rows = f.events.filter(data & (F.col("pad") == HEALING_SIGNATURE) & (F.col("iff") == 0) & shape).join(f.like_logs(healing_logs(f)), "log_id", "left_semi")
    rows = rows.select("log_id", "time", "seq", "src_instid", "dst_instid", ((bits.bitwiseAND(128) != 0) | (bits.bitwiseAND(192) == 0)).alias("by_source"), (bits.bitwiseAND(64) != 0).alias("by_target"))
    rows = f.owners(f.owners(rows, "src_instid", "healer"), "dst_instid", "target").filter("healer is not null and target is not null")
    agents = rows.filter("by_source").select("log_id", F.col("healer").alias("addr")).union(rows.filter("by_target").select("log_id", "target")).distinct()
    return agents.join(f.members("squad", "addr", "rep"), ["log_id", "addr"], "left_semi")


def healing_by_ally(f: Frames) -> DataFrame:
    """What each squad account gave to each target: healing, its part on downed targets, barrier."""
    heal, a = ~F.col("barrier"), F.col("amount")
    return healing_rows(f).groupBy("log_id", "rep", "target").agg(
        sum_if(heal, a).alias("healing"), sum_if(heal & F.col("downed"), a).alias("healing_downed"), sum_if(F.col("barrier"), a).alias("barrier"))


def healing_by_skill(f: Frames) -> DataFrame:
    """By account, skill and kind (healing or barrier): hits, total, least and most, and whether any was indirect."""
    return healing_rows(f).groupBy("log_id", "rep", "skillid", "barrier").agg(
        F.count("*").alias("hits"), F.sum("amount").alias("total"), F.min("amount").alias("min"), F.max("amount").alias("max"), F.bool_or(~F.col("direct")).alias("indirect"))


def cumulative_healing(f: Frames, step: int = 1000) -> DataFrame:
    """Healing and barrier of each account up to the end of every bucket ((k - 1) * step, k * step]; only
    buckets where a sum changes have a row."""
    rows = healing_rows(f).join(f.log_times, "log_id")
    bucket = F.ceil(F.greatest(F.col("time") - F.col("t0"), F.lit(0)) / step)
    a = F.col("amount")
    sums = rows.groupBy("log_id", "rep", bucket.alias("bucket")).agg(sum_if(~F.col("barrier"), a).alias("h"), sum_if(F.col("barrier"), a).alias("b"))
    w = Window.partitionBy("log_id", "rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("log_id", "rep", "bucket", F.sum("h").over(w).alias("healing"), F.sum("b").over(w).alias("barrier"))
