"""Entity operators on literal rows."""

import math

from pyspark.sql import functions as F

from skirmish.operators import entities
from skirmish.schema import State

from .fights import FOE, MATE, PET, SQUAD, fight, hit, mark, rows


def test_accounts_are_one_by_name_then_session(spark):
    players = spark.createDataFrame([("a", 1, ":ann.1", 0), ("a", 2, ":ann.1", 1), ("a", 3, "", 2), ("a", 4, "", 3), ("a", 5, "", 4), ("b", 2, ":ann.1", 0)], "log_id string, addr bigint, account string, ord int")
    ids = spark.createDataFrame([("a", 3, 7), ("a", 4, 7)], "log_id string, addr bigint, instid int")
    assert rows(entities.same_accounts(players, ids), "log_id", "addr", "rep") == [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("a", 4, 3), ("a", 5, 5), ("b", 2, 2)]


def test_markers_last_to_the_next_or_the_end(spark):
    m = lambda t, v, src=SQUAD: mark(t, State.MARKER, src=src, value=v)
    f = fight(spark, [hit(100), m(110, 5), m(150, 6), m(170, 0), m(180, 7, MATE), mark(200, State.UP)])
    assert rows(entities.marker_spans(f), "addr", "marker", "start", "stop") == [(SQUAD, 5, 10, 50), (SQUAD, 6, 50, 70), (MATE, 7, 80, 100)]


def test_ground_markers_move_and_go(spark):
    g = lambda t, x, k=1: mark(t, State.GROUND_MARKER, skillid=k, x=x, y=1.0, z=0.0)
    f = fight(spark, [hit(0), g(10, 5.0), g(20, 5.0), g(30, 6.0), g(40, math.nan), g(50, 2.0, 2), mark(100, State.UP)])
    assert rows(entities.ground_markers(f), "index", "start", "stop", "x") == [(1, 10, 30, 5.0), (1, 30, 40, 6.0), (2, 50, 100, 2.0)]


def test_tick_rate_skips_rows_that_do_not_move_on(spark):
    t = lambda time, tick: mark(time, State.TICK, src=tick)
    f = fight(spark, [t(0, 100), t(1000, 125), t(1000, 125), t(3000, 165)])
    assert rows(entities.tick_rate(f), "average", "lowest") == [(21.666667, 20.0)]


def test_teams_sides_and_names(spark):
    team = lambda t, addr, n: mark(t, State.TEAM, src=addr, dst_agent=n)
    f = fight(spark, [team(0, SQUAD, 0), team(1, SQUAD, 705), team(2, SQUAD, 706), team(3, FOE, 3)])
    assert rows(entities.resolved_teams(f.events, [705, 706]), "addr", "team") == [(SQUAD, 705), (FOE, 3)]
    ids = spark.createDataFrame([(1,), (2,), (3,), (3,)], "id bigint")
    own = spark.createDataFrame([(1, " "), (2, "Two")], "id bigint, name string")
    more = spark.createDataFrame([(1, "One"), (2, "Zwei"), (3, "3")], "id bigint, name string")
    assert rows(entities.skill_names(ids, own, more), "id", "name") == [(1, "One"), (2, "Two"), (3, "Skill 3")]


def test_objectives_change_owners(spark):
    o = lambda t, v, k=4: mark(t, State.OBJECTIVE, src=k, value=v)
    f = fight(spark, [o(1, 9), o(2, 9), o(3, 8), o(4, 9, 5)])
    names = spark.createDataFrame([(4, "Keep")], "objective_id bigint, name string")
    assert rows(entities.objective_owners(f.events, names), "name", "at", "owner") == [("Keep", 1, 9), ("Keep", 3, 8)]


def test_sides_spread_to_the_fixpoint(spark):
    """A chain of allies longer than any fixed number of rounds that a fight needs."""
    n = 12
    ally = [hit(k, src=k + 1, dst=k + 2, value=1, iff=0) for k in range(n)]
    f = fight(spark, [*ally, hit(99, src=n + 1, dst=500, value=5, iff=1)])
    players = spark.createDataFrame([("a", k) for k in [*range(1, n + 2), 500, 600]], "log_id string, addr bigint")
    got = entities.affinity(f, players, spark.createDataFrame([("a", 1)], "log_id string, addr bigint"))
    assert dict(rows(got, "addr", "friendly")) == {k: True for k in range(1, n + 2)} | {500: False}


def test_lost_agents_are_found_by_session(spark):
    f = fight(spark, [hit(0, src=PET, src_instid=3), hit(200, src=0, src_instid=3), hit(900, src=0, src_instid=3)])
    assert rows(entities.orphans_repaired(f.events).select("seq", "src_agent"), "seq", "src_agent") == [(0, PET), (1, PET), (2, 0)]
    assert f.events.filter(F.col("src_agent") == 0).count() == 2
