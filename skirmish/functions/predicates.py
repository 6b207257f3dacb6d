"""Row predicates and measures that the operators share, as columns of the event table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOONS, CONDITIONS, NEVER_CRITICAL, Result, State

c = F.col


def is_combat_row() -> Column:
    return (c("is_statechange") == 0) & (c("is_activation") == 0) & (c("is_buffremove") == 0)


def is_health_damage() -> Column:
    return ~c("result").isin(Result.CROWD_CONTROL, Result.BREAKBAR)


def damage() -> Column:
    return F.greatest(F.when(c("buff") == 1, c("buff_dmg")).otherwise(c("value")), F.lit(0)).cast("bigint")


def positive_value() -> Column:
    return F.greatest(c("value"), F.lit(0)).cast("bigint")


def is_crowd_control() -> Column:
    return (c("is_statechange") == 0) & (c("post_era") | (c("buff") == 0)) & (c("result") == Result.CROWD_CONTROL)


def is_remove_all() -> Column:
    before = (c("is_statechange") == 0) & (c("is_activation") == 0) & (c("is_buffremove") == 1)
    return F.when(c("post_era"), c("is_statechange") == State.BUFF_REMOVE_ALL).otherwise(before)


def is_cast_start(skill: int | None = None) -> Column:
    before = (c("is_statechange") == 0) & c("is_activation").isin(1, 2)
    start = F.when(c("post_era"), c("is_statechange") == State.ANIMATION_START).otherwise(before)
    return start if skill is None else start & (c("skillid") == skill)


def is_condition() -> Column:
    return c("skillid").isin(*CONDITIONS)


def is_boon() -> Column:
    return c("skillid").isin(*BOONS)


def can_be_critical() -> Column:
    return ~c("skillid").isin(*NEVER_CRITICAL)


def direct_hit() -> Column:
    return (c("buff") == 0) & c("result").isin(Result.NORMAL, Result.CRIT, Result.GLANCE)


def leech_hit() -> Column:
    after = c("result").isin(Result.LEECH_ON_HIT, Result.LEECH_ON_REMOVE)
    before = (c("value") == 0) & (c("result") == 0) & c("is_offcycle").isin(3, 5)
    return (c("buff") != 0) & F.when(c("post_era"), after).otherwise(before)


def buff_hit() -> Column:
    """A hit by a buff, life leech included."""
    cycles = (Result.BUFF_CYCLE, Result.BUFF_NOT_CYCLE, Result.SOURCE_ON_HIT, Result.LEECH_ON_HIT, Result.LEECH_ON_REMOVE)
    before = (c("value") == 0) & (c("result") == 0)
    return (c("buff") != 0) & F.when(c("post_era"), c("result").isin(*cycles)).otherwise(before)


def connected() -> Column:
    return direct_hit() | buff_hit()


def against_downed() -> Column:
    before = F.when(c("buff") == 0, c("is_offcycle") == 1).otherwise(c("pad").bitwiseAND(255) == 1)
    return F.when(c("post_era"), c("is_offcycle") == 1).otherwise(before)


def outcome() -> Column:
    """hit, blocked, evaded, interrupted, invulned, missed, or null for rows that are none."""
    r = c("result")
    direct = (
        F.when(direct_hit(), "hit").when(r == Result.BLOCK, "blocked").when(r == Result.EVADE, "evaded")
        .when(r == Result.INTERRUPT, "interrupted").when(r.isin(Result.ABSORB, Result.INVERT), "invulned")
        .when(r == Result.BLIND, "missed")
    )
    after = F.when(buff_hit(), "hit").when(r.isin(Result.ABSORB, Result.INVERT), "invulned")
    before = F.when(c("value") != 0, None).when(r == 0, "hit").when(r.between(1, 4), "invulned")
    return F.when(c("buff") == 0, direct).when(c("post_era"), after).otherwise(before)


def hit_kind() -> Column:
    """Of a hit: condition, strike, leech or power."""
    return (
        F.when(is_condition(), "condition").when(c("buff") == 0, "strike").when(leech_hit(), "leech").otherwise("power")
    )


def barrier_part() -> Column:
    """Of a hit: what a barrier took."""
    own = c("overstack").cast("bigint")
    after = F.when(c("overstack") > 0, own).otherwise(damage())
    whole = F.when(c("buff") == 0, own).when(c("post_era"), after).otherwise(damage())
    return F.when(c("is_shields") != 0, whole).otherwise(F.lit(0).cast("bigint"))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("bigint")


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")
