"""Small fights as literal rows."""

from pyspark.sql import SparkSession

from skirmish.plans.frames import Frames
from skirmish.schema import EVENTS, ROSTER

KINDS = [c.split() for c in EVENTS.split(", ")]
SQUAD, MATE, FOE, PET = 10, 11, 900, 500


def fight(spark: SparkSession, rows: list[dict], post_era: bool = True, roster=None, teams=()) -> Frames:
    """Frames of one log; fields that a row leaves out are 0, its place is its number."""
    full = [tuple({"log_id": "a", "seq": k, "x": None, "y": None, "z": None}.get(c, 0) if c not in r else r[c] for c, _ in KINDS) for k, r in enumerate(rows)]
    events = spark.createDataFrame(full, EVENTS).selectExpr("*", f"{str(post_era).lower()} as post_era")
    roster = roster or [("a", SQUAD, SQUAD, "squad", 1, 1), ("a", MATE, MATE, "squad", 1, 1), ("a", FOE, FOE, "enemy", 2, 0)]
    return Frames(
        events, spark.createDataFrame(roster, ROSTER), spark.createDataFrame([("a", 1)], "log_id string, friendly_team int"),
        spark.createDataFrame(list(teams) or [("a", SQUAD, 1)], "log_id string, addr bigint, team int"),
    )


def hit(time, src=SQUAD, dst=FOE, value=100, **more):
    return {"time": time, "src_agent": src, "dst_agent": dst, "value": value, "iff": 1} | more


def mark(time, state, src=SQUAD, **more):
    return {"time": time, "is_statechange": state, "src_agent": src} | more


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
