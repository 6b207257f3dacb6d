"""Damage modifiers: rules over hits and the buff stacks at their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import connected, damage, hit_kind, is_combat_row
from ..plans.frames import Frames
from ..plans.joins import asof_join, small
from ..schema import Result
from .buffs import stack_steps

#: id, buff (null: none), gain in percent, how it grows, its number, what must hold, which hits count.
RULES = "rule_id int, buff_id bigint, gain double, grows string, amount double, check string, counts string"
#: A few rules of our own to begin with; a table in the same schema replaces them.
SAMPLE_RULES = (
    (1, 740, 1.0, "stack", None, None, "all"),
    (2, 725, 5.0, "presence", None, None, "strike"),
    (3, 717, 10.0, "absence", None, None, "power"),
    (4, 740, 10.0, "at_least", 10.0, None, "strike"),
    (5, 740, 1.5, "multiplying", None, None, "strike"),
    (6, None, 7.0, "presence", None, "moving", "strike"),
    (7, None, 20.0, "presence", None, "ninety", "power"),
    (8, None, 10.0, "presence", None, "flanking", "strike"),
    (9, None, 15.0, "presence", None, "crit", "strike"),
)
MOST_RULES = 100_000
KINDS = ("condition", "strike", "leech", "power")


def gain() -> Column:
    """The share of a hit's damage that a rule accounts for, by ``grows``: p / (100 + p)."""
    g, n, a = F.col("gain"), F.col("stacks").cast("double"), F.coalesce("amount", F.lit(0.0))
    share = lambda p: p / (100.0 + p)
    one, how, none = share(g), F.col("grows"), F.lit(0.0)
    return (
        F.when(how == "presence", F.when(n > 0, one).otherwise(none)).when(how == "absence", F.when(n == 0, one).otherwise(none))
        .when(how == "stack", share(g * n)).when(how == "stack_plus", share(g * n + a))
        .when(how == "multiplying", share(100.0 * F.pow(1.0 + g / 100.0, n) - 100.0))
        .when(how == "at_least", F.when(n >= a, one).otherwise(none)).when(how == "at_most", F.when(n <= a, one).otherwise(none))
        .when(how == "exactly", F.when(n == a, one).otherwise(none)).otherwise(none)
    )


def holds() -> Column:
    """Whether a hit meets a rule's check."""
    c = F.col("check")
    flag = lambda name: F.col(name) != 0
    return (
        F.when(c.isNull(), True).when(c == "moving", F.col("is_moving").bitwiseAND(1) != 0).when(c == "target_moving", F.col("is_moving").bitwiseAND(2) != 0)
        .when(c == "ninety", flag("is_ninety")).when(c == "fifty", flag("is_fifty")).when(c == "flanking", flag("is_flanking"))
        .when(c == "crit", F.col("result") == Result.CRIT).when(c == "glance", F.col("result") == Result.GLANCE)
        .when(c == "barrier", flag("is_shields")).when(c == "downed", F.col("is_offcycle") == 1).otherwise(False)
    )


def damage_modifiers(f: Frames, rules: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """By account and rule: hits that gained, hits that count, the damage the rule accounts for and the
    damage of the hits that count.  Rules that never applied have no row."""
    spark = f.events.sparkSession
    rules = spark.createDataFrame(list(SAMPLE_RULES), RULES) if rules is None else rules
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    steps = stack_steps(f) if steps is None else steps
    hits = f.events.filter(is_combat_row()).filter(connected()).withColumn("dmg", damage()).withColumn("kind", hit_kind())
    hits = hits.join(f.side("squad", "src"), ["log_id", "src_agent"]).join(f.side("enemy", "dst"), ["log_id", "dst_agent"], "left_semi").withColumnRenamed("src_rep", "rep")
    hits = hits.select("log_id", "rep", "time", "seq", "dmg", "kind", "is_moving", "is_ninety", "is_fifty", "is_flanking", "result", "is_shields", "is_offcycle")
    which = F.col("counts")
    kinds = F.when(which == "all", F.array(*map(F.lit, KINDS))).when(which == "power", F.array(*map(F.lit, KINDS[1:]))).otherwise(F.array(which))
    pairs = hits.join(small(rules.withColumn("kind", F.explode(kinds))), "kind")
    plain = pairs.filter("buff_id is null").withColumn("stacks", F.lit(1))
    known = steps.select("log_id", "rep", "buff_id", "time", "stacks").withColumn("order", F.col("time"))
    buffed = asof_join(pairs.filter("buff_id is not null"), known, ["log_id", "rep", "buff_id"], "time", "stacks", order="order", out="stacks").fillna(0, ["stacks"])
    both = plain.unionByName(buffed.select(plain.columns)).withColumn("g", F.when(holds(), gain()).otherwise(F.lit(0.0)))
    out = both.groupBy("log_id", "rep", "rule_id").agg(
        F.count_if(F.col("g") != 0).alias("hit_count"), F.count("*").alias("total_hit_count"), F.bround(F.sum(F.col("g") * F.col("dmg")), 3).alias("damage_gain"), F.sum("dmg").alias("total_damage")
    )
    return out.filter("hit_count > 0")
