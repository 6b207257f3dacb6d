import random

import pytest

from skirmish.operators import buffs, damage, entities, instants, modifiers, series, support
from skirmish.plans import queries, report
from skirmish.plans.joins import asof_join, band_join, merge_steps, overlap_counts
from skirmish.schema import Result, State
from tests.fights import FOE, MATE, PET, SQUAD, fight, hit, mark, rows


def test_strikes_and_ticks_add_up_and_breakbar_does_not(spark):
    f = fight(spark, [hit(0), hit(1, value=0), hit(2, value=0, buff=1, buff_dmg=50), hit(3, result=Result.BREAKBAR), hit(4, result=Result.CROWD_CONTROL)])
    assert rows(damage.squad_damage(f), "rep", "damage", "hits") == [(SQUAD, 150, 2)]


def test_a_pet_counts_for_the_owner_of_the_moment_if_teams_agree(spark):
    own = [hit(0, src_instid=7), hit(5, src=MATE, src_instid=8, value=1), hit(6, src=PET, src_master_instid=7, value=30, dst=77), hit(7, src=PET + 1, src_master_instid=7, value=40)]
    f = fight(spark, own, teams=[("a", PET, 1), ("a", PET + 1, 2)])
    assert rows(damage.squad_damage(f), "rep", "damage", "pet_damage") == [(SQUAD, 130, 30), (MATE, 1, 0)]


def test_a_recycled_session_id_is_its_last_owners(spark):
    f = fight(spark, [hit(0, src_instid=7), hit(10, src=MATE, src_instid=7), hit(20, src=PET, src_master_instid=7), hit(5, src=PET + 1, src_master_instid=7)])
    assert rows(damage.pet_owners(f), "addr", "owner") == [(PET, MATE), (PET + 1, SQUAD)]


def test_relogged_account_is_one(spark):
    roster = [("a", SQUAD, SQUAD, "squad", 1, 1), ("a", MATE, SQUAD, "squad", 1, 1), ("a", FOE, FOE, "enemy", 2, 0)]
    f = fight(spark, [hit(0), hit(1, src=MATE)], roster=roster)
    assert rows(damage.damage_per_target(f), "rep", "target", "damage") == [(SQUAD, FOE, 200)]


def test_down_then_kill_and_death(spark):
    f = fight(spark, [hit(0, result=Result.DOWNED), hit(1, result=Result.KILLING_BLOW), mark(2, State.DEAD)])
    assert rows(damage.downs_and_kills(f), "rep", "downs_dealt", "kills_dealt", "downs_taken", "deaths") == [(SQUAD, 1, 1, 0, 1)]


@pytest.mark.parametrize("result,name", [(3, "blocked"), (4, "evaded"), (5, "interrupted"), (6, "invulned"), (13, "invulned"), (7, "missed")])
def test_defence_outcomes(spark, result, name):
    f = fight(spark, [hit(0, src=FOE, dst=SQUAD, result=result)])
    assert damage.defenses(f).first()[f"{name}_count"] == 1


def test_hit_classes(spark):
    f = fight(spark, [hit(0, result=1), hit(1, skillid=9292, result=1), hit(2, skillid=736, buff=1, value=0, buff_dmg=9, result=14), hit(3, buff=1, value=0, buff_dmg=5, result=16, is_ninety=1)])
    r = damage.hit_stats(f).first()
    assert (r.connected_count, r.critable_count, r.crit_count, r.condition_damage, r.leech_damage, r.above90_power_count) == (4, 1, 1, 9, 5, 1)


def test_contribution_reaches_back_to_the_last_high_health(spark):
    health = lambda t, pct: mark(t, State.HEALTH, src=FOE, dst_agent=pct)
    f = fight(spark, [hit(0, value=1), health(100, 10000), hit(4000, value=2), health(5000, 9950), hit(6000, value=4), hit(9000, value=8, result=Result.DOWNED), hit(9500, value=16)])
    assert rows(support.down_contribution(f), "rep", "target", "damage", "downs") == [(SQUAD, FOE, 2 + 4 + 8, 1)]


def test_cleanse_of_self_other_and_pet(spark):
    off = lambda src, **m: mark(1, State.BUFF_REMOVE_ALL, src=src, dst_agent=SQUAD, skillid=736, **m)
    f = fight(spark, [hit(0, src=MATE, src_instid=5), off(SQUAD), off(MATE), off(PET, src_master_instid=5), mark(2, State.BUFF_REMOVE_ALL, src=FOE, dst_agent=SQUAD, skillid=740)])
    assert rows(support.cleanses_and_strips(f), "rep", "cleanses", "cleanses_self", "cleanses_minions", "strips") == [(SQUAD, 1, 1, 1, 1)]


def test_missile_ids_are_used_again(spark):
    f = fight(spark, [mark(0, 57, pad=3), mark(1, 59, pad=3, is_flanking=1), mark(2, 57, pad=3), mark(3, 58, pad=3, dst_agent=SQUAD), mark(4, 59, pad=3), mark(5, 57, pad=4)])
    assert rows(support.missiles(f), "rep", "fired", "hit", "denied", "reflected") == [(SQUAD, 3, 1, 1, 1)]


def test_healing_by_peers_pets_and_downed(spark):
    sign = support.HEALING_SIGNATURE
    row = lambda t, off, v, **m: mark(t, State.EXTENSION_COMBAT, src=0, pad=sign, src_instid=1, dst_instid=2, is_offcycle=off) | {"value": -v} | m
    known = [hit(0, src=SQUAD, src_instid=1), hit(0, src=MATE, src_instid=2), hit(0, src=PET, src_instid=9, iff=0)]
    told = mark(0, State.EXTENSION, src=sign + (1 << 32))
    rows_ = [
        row(1, 64, 10), row(2, 128, 100), row(3, 128 + 32, 5), row(4, 129, 7), row(5, 128, 50, pad=77), row(6, 128, 50, iff=1), row(7, 128, 0, buff=1, buff_dmg=-3),
        row(8, 128, 20, is_shields=1), row(9, 0, 11, src_instid=9, src_master_instid=1), row(10, 128, 40, dst_instid=99), row(11, 128, 2, dst_instid=1),
    ]
    r = support.healing(fight(spark, [*known, told, *rows_])).first()
    assert (r.rep, r.healing, r.healing_self, r.healing_allies, r.barrier, r.healing_downed) == (SQUAD, 128, 2, 126, 20, 12)
    assert support.healing(fight(spark, [*known, *rows_])).count() == 0
    assert support.healing(fight(spark, [*known, mark(0, State.EXTENSION, src=sign + (3 << 32)), *rows_])).count() == 0


def test_strips_taken_go_to_the_remover_s_master(spark):
    off = lambda dst, **m: mark(1, State.BUFF_REMOVE_ALL, src=SQUAD, dst_agent=dst, skillid=740, value=10, **m)
    f = fight(spark, [hit(0, src=MATE, src_instid=5), hit(0, src=PET), off(FOE), off(SQUAD), off(PET), off(PET, dst_master_instid=5), off(4242), off(SQUAD, dst_master_instid=5)])
    assert rows(support.strips_taken(f), "rep", "strips_taken", "stripped_ms") == [(SQUAD, 4, 40)]


def test_series_ceil_and_floor_buckets(spark):
    f = fight(spark, [hit(0, value=1), hit(1000, value=2), hit(1001, value=4), hit(2500, value=8)])
    assert rows(series.cumulative_damage(f), "bucket", "damage") == [(0, 1), (1, 3), (2, 7), (3, 15)]
    assert rows(series.squad_timeline(f), "bucket", "damage") == [(0, 1), (1, 6), (2, 8)]


def test_health_steps_start_at_the_log_and_fuse(spark):
    h = lambda t, v: mark(t, State.HEALTH, dst_agent=v)
    f = fight(spark, [hit(0), h(100, 9000), h(200, 9000), h(300, 12000), mark(400, State.UP)])
    assert rows(series.health_steps(f), "at_ms", "health") == [(0, 9000), (300, 10000)]


def test_casts_pair_and_end_at_the_log(spark):
    f = fight(spark, [hit(0), mark(100, 67, skillid=5, value=500), mark(600, 68, skillid=5, value=498, is_activation=5), mark(700, 67, skillid=6, value=5000), mark(750, 68, skillid=7, value=900, is_activation=4), mark(1000, State.UP)])
    assert rows(series.casts(f), "skillid", "at_ms", "cast_ms", "time_gained", "status") == [(5, 100, 498, 0, "full"), (6, 700, 300, 0, "unknown"), (7, -150, 900, -900, "interrupted")]


def test_down_and_dead_intervals(spark):
    f = fight(spark, [hit(0), mark(10, State.DOWN), mark(20, State.DOWN), mark(30, State.DEAD), mark(50, State.UP), mark(60, State.DOWN)])
    assert rows(series.state_intervals(f), "state", "start", "stop") == [("dead", 30, 50), ("down", 20, 30)]
    assert rows(series.active_time(f), "rep", "active_ms") == [(SQUAD, 40), (MATE, 60)]


def test_tracks_hold_until_a_position_changes(spark):
    """An agent stays until 300 ms before its next position, or 1 ms before a teleport; the grid runs from the
    first row to the first tick at or after the last position."""
    at = lambda t, x, s=State.POSITION: mark(t, s, x=float(x), y=0.0, z=0.0)
    f = fight(spark, [hit(0), at(0, 0), at(600, 60), at(1000, 60)])
    assert rows(series.tracks(f), "t_ms", "x") == [(0, 0.0), (300, 0.0), (600, 60.0), (900, 60.0), (1200, 60.0)]
    f = fight(spark, [hit(0), at(400, 10), at(1000, 70), at(1350, 900, State.TELEPORT)])
    assert rows(series.tracks(f), "t_ms", "x") == [(0, 10.0), (300, 10.0), (600, 10.0), (900, 50.0), (1200, 70.0), (1500, 900.0)]


def test_registered_tracks_and_series_have_the_default_steps(spark):
    walk = [mark(t, State.POSITION, src=who, x=t / 10 * (who == SQUAD), y=0.0, z=float(t)) for t in range(0, 6001, 300) for who in (SQUAD, MATE)]
    f = fight(spark, [*walk, hit(0, src=MATE), hit(2500, result=Result.DOWNED), hit(6000)])
    got = {(r.rep, r.t_ms): r.x for r in queries._ALL["tracks"][0](f).collect()}
    want = {(who, t): t / 10 * (who == SQUAD) for who in (SQUAD, MATE) for t in range(0, 6001, 300)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    mean = sum(t / 20 for t in range(0, 6000, 300)) / 20  # the log's last tick has no centre
    assert [r.distance for r in queries._ALL["distance_to_centre"][0](f).collect()] == [pytest.approx(mean, abs=1e-3)] * 2
    runs = sorted((r.first, r.length, r.downs) for r in queries._ALL["encoded_series"][0](f).collect())
    assert [v for first, n, v in runs for _ in range(n)] == [0, 0, 1, 0, 0, 0, 0]


def slow_queue(events, capacity, end):
    """One millisecond at a time: the oldest stack runs."""
    q, states, last = [], [], 0
    events = list(events)
    for t in range(events[0][0], end + 1):
        if q and t > events[0][0]:
            q[0] -= 1
            if q[0] <= 0:
                q.pop(0)
        for when, kind, ms, _, _ in events:
            if when == t and kind == "apply":
                if len(q) < capacity:
                    q.append(ms)
                elif len(q) > 1:
                    k = min(range(1, len(q)), key=q.__getitem__)
                    q[k] = ms
                else:
                    q[0] = ms
            elif when == t and kind == "all":
                q.clear()
        if len(q) != last:
            states.append((t, len(q)))
            last = len(q)
    return states


def test_queue_stacks_against_a_slow_clock():
    rng = random.Random(4)
    for _ in range(300):
        events = sorted((rng.randrange(200), rng.choice(["apply"] * 5 + ["all"]), rng.randint(1, 60), 0, False) for _ in range(rng.randint(1, 12)))
        events = [e for k, e in enumerate(events) if k == 0 or events[k - 1][0] != e[0]]
        assert buffs.simulate(events, 3, False, 400) == slow_queue(events, 3, 400)


def test_parallel_stacks_evict_remove_and_extend():
    apply = lambda t, ms: (t, "apply", ms, 0, False)
    assert buffs.simulate([apply(0, 100), apply(10, 50)], 25, True, 500) == [(0, 1), (10, 2), (60, 1), (100, 0)]
    assert buffs.simulate([apply(0, 100), apply(10, 50), apply(20, 200)], 2, True, 500) == [(0, 1), (10, 2), (100, 1), (220, 0)]
    assert buffs.simulate([apply(0, 100), (10, "single", 104, 0, False)], 25, True, 500) == [(0, 1), (10, 0)]
    assert buffs.simulate([apply(0, 100), (10, "single", 85, 0, False)], 25, True, 500) == [(0, 1), (10, 0)]
    assert buffs.simulate([apply(0, 100), (10, "single", 75, 0, False)], 25, True, 500) == [(0, 1), (100, 0)]
    assert buffs.simulate([apply(0, 100), (10, "extend", 140, 50, False)], 25, True, 500) == [(0, 1), (150, 0)]
    assert buffs.simulate([apply(0, 100), (10, "all", 0, 0, False)], 25, True, 500) == [(0, 1), (10, 0)]


def test_uptime_of_half_the_log(spark):
    f = fight(spark, [hit(0), mark(100, State.BUFF_APPLY, src=MATE, dst_agent=SQUAD, skillid=717, value=500), mark(1000, State.UP)])
    assert rows(buffs.uptime(f), "rep", "buff_id", "uptime", "stacks") == [(SQUAD, 717, 50.0, 0.5)]


def test_queue_windows_equal_the_machine(spark):
    rng = random.Random(2)
    times = sorted(rng.sample(range(1000), 30))
    applies = [(t, "apply", rng.randint(1, 80), 0, False) for t in times]
    steps = buffs.simulate(applies, 10**6, False, 10**6)
    df = spark.createDataFrame([(1, t, ms, k) for k, (t, _, ms, _, _) in enumerate(applies)], "k int, t bigint, ms bigint, seq bigint")
    spans = rows(buffs.queue_spans(df, ["k"], "t", "ms"), "start", "stop")
    busy = sum(b - a for a, b in spans)
    held = sum((steps[i + 1][0] - t) for i, (t, n) in enumerate(steps[:-1]) if n)
    assert busy == held


def test_instant_casts_wait_anew_after_each_trigger(spark):
    gain = lambda t: mark(t, State.BUFF_APPLY, src=MATE, dst_agent=SQUAD, skillid=740, value=100)
    f = fight(spark, [gain(0), gain(40), gain(80), gain(200)])
    got = instants.instant_casts(f).filter("rule_id = 1")
    assert rows(got, "caster", "skill_id", "time") == [(SQUAD, 9001, 0), (SQUAD, 9001, 200)]


def test_modifier_gain_by_stacks(spark):
    f = fight(spark, [mark(0, State.BUFF_APPLY, src=MATE, dst_agent=SQUAD, skillid=740, value=1000), hit(10, value=101), hit(2000, value=50)])
    got = modifiers.damage_modifiers(f).filter("rule_id = 1").first()
    assert (got.hit_count, got.total_hit_count, got.damage_gain, got.total_damage) == (1, 2, 1.0, 151)


def test_sides_follow_the_recorder(spark):
    f = fight(spark, [hit(0, src=1, dst=2, iff=0), hit(1, src=2, dst=3, iff=1), hit(2, src=3, dst=4, iff=0)])
    players = spark.createDataFrame([("a", k) for k in (1, 2, 3, 4, 5)], "log_id string, addr bigint")
    got = entities.affinity(f, players, spark.createDataFrame([("a", 1)], "log_id string, addr bigint"))
    assert rows(got, "addr", "friendly") == [(1, True), (2, True), (3, False), (4, False)]


def test_first_real_team_wins(spark):
    f = fight(spark, [mark(0, State.TEAM, dst_agent=0), mark(1, State.TEAM, dst_agent=705), mark(2, State.TEAM, dst_agent=432), mark(3, State.TEAM, src=MATE, dst_agent=1)])
    assert rows(entities.resolved_teams(f.events, [705, 432]), "addr", "team") == [(SQUAD, 705), (MATE, 1)]


def test_orphans_get_the_agent_seen_near(spark):
    f = fight(spark, [hit(1000, src_instid=4), hit(1200, src=0, src_instid=4), hit(9000, src=0, src_instid=4)])
    assert rows(entities.orphans_repaired(f.events), "seq", "src_agent") == [(0, SQUAD), (1, SQUAD), (2, 0)]


def test_tick_rate_and_names(spark):
    f = fight(spark, [mark(0, State.TICK, src=100), mark(1000, State.TICK, src=125), mark(2000, State.TICK, src=135), mark(2000, State.TICK, src=1)])
    assert rows(entities.tick_rate(f), "average", "lowest") == [(17.5, 10.0)]
    agents = spark.createDataFrame([(4, 55, ":a.1"), (1, 0, ":"), (0xFFFF0001, 0xFFFFFFFF, "")], "prof bigint, is_elite bigint, account string")
    assert rows(entities.described(agents), "kind", "profession", "specialization", "account") == [("gadget", "4294901761", "", ""), ("player", "Guardian", "", ":"), ("player", "Ranger", "Soulbeast", "a.1")]


def test_joins_against_brute_force(spark):
    rng = random.Random(7)
    facts = [(rng.randrange(3), rng.randrange(100), k, rng.randrange(50)) for k in range(60)]
    probes = [(rng.randrange(4), rng.randrange(120), k) for k in range(80)]
    got = asof_join(spark.createDataFrame(probes, "k int, t bigint, id int"), spark.createDataFrame(facts, "k int, t bigint, seq int, v int"), ["k"], "t", "v")
    want = sorted((i, (max(((t2, s, v) for k2, t2, s, v in facts if k2 == k and t2 <= t), default=(0, 0, None)))[2]) for k, t, i in probes)
    assert sorted((r.id, r.found) for r in got.collect()) == want
    spans = [(rng.randrange(3), a := rng.randrange(100), a + rng.randrange(40), k) for k in range(30)]
    got = band_join(spark.createDataFrame(probes, "k int, t bigint, id int"), spark.createDataFrame(spans, "k int, a bigint, b bigint, s int"), ["k"], "t", "a", "b", 9)
    assert rows(got, "id", "s") == sorted((i, s) for k, t, i in probes for k2, a, b, s in spans if k == k2 and a <= t <= b)


def test_steps_add_and_overlap(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 15, 20)], "k int, a bigint, b bigint")
    assert rows(overlap_counts(spans, ["k"], "a", "b"), "t", "n") == [(0, 1), (5, 2), (10, 1), (20, 0)]
    steps = spark.createDataFrame([(1, "x", 0, 1), (1, "y", 2, 1), (1, "x", 4, 0)], "k int, s string, t bigint, n int")
    assert rows(merge_steps(steps, ["k"], "s", "t", "n"), "t", "n") == [(0, 1), (2, 2), (4, 1)]


def test_parts_equal_the_whole(spark):
    rng = random.Random(9)
    f = fight(spark, [hit(k * 7, src=rng.choice((SQUAD, MATE)), value=rng.randrange(90), skillid=rng.randrange(5), result=rng.choice((0, 0, 1, 2, 10))) for k in range(200)])
    total = dict(rows(damage.squad_damage(f), "rep", "damage"))
    skills, last = {}, {}
    for rep, n in rows(damage.skill_damage(f), "rep", "total"):
        skills[rep] = skills.get(rep, 0) + n
    for rep, _, n in rows(series.cumulative_damage(f), "rep", "bucket", "damage"):
        last[rep] = n
    assert skills == total == last == dict(rows(damage.damage_per_target(f), "rep", "damage"))


def test_report_tells_what_it_covers(spark, tmp_path):
    f = fight(spark, [hit(0), hit(1000)])
    report.write_json(f, str(tmp_path / "r"), ("missiles",))
    got = spark.read.json(str(tmp_path / "r")).first()
    assert got.coverage["damage"] == "present" and got.coverage["missiles"] == "empty" and got.coverage["boons"] == "not_computed"
    report.write_csv(f, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).filter("damage = 200").count() == 1


def test_the_stored_view_is_scanned_as_plain_columns(spark):
    """Operators are planned over the stored table: no JSON, and few scans of it."""
    from skirmish.operators import damage as d
    from skirmish.plans.stand_in import frames

    f = frames(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for operator, most in ((d.hit_stats, 1), (d.defenses, 1), (d.squad_damage, 2), (d.skill_damage, 2)):
        text = plan(operator(f))
        assert "get_json_object" not in text and text.count("is_buffremove") and sum("event" in x or "is_statechange#" in x for x in text.splitlines() if "Relation" in x) <= most


def test_the_view_takes_seconds_as_its_sql_does(spark, tmp_path):
    """DuckDB's milliseconds are rounded, half away from zero, so 13.9996 s lies in second 14."""
    import duckdb

    from skirmish.plans.stand_in import PRELUDE, frames

    times = ["2024-01-01 15:34:13.999921", "2024-01-01 15:34:13.9995", "2024-01-01 15:34:13.999499", "2024-01-31 23:59:59.9996", "1969-12-31 23:59:58.9995", "1969-12-31 23:59:58.0005", "1969-12-31 23:59:59.9996"]
    values = ", ".join(f"({k}, timestamp '{t}', {2 + 6 * k}, 'error', 12.5, '{{\"k\": 9}}')" for k, t in enumerate(times))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) e(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    expected = con.execute(PRELUDE + "SELECT seq, time FROM combat ORDER BY seq").fetchall()
    assert rows(frames(spark, str(tmp_path)).events, "seq", "time") == expected


@pytest.fixture(scope="module")
def unordered(tmp_path_factory):
    """A table of events whose numbers are not in the order of time, so that rows lie before and after the log's bounds."""
    import duckdb

    folder = tmp_path_factory.mktemp("unordered")
    r, con = random.Random(5), duckdb.connect()
    kinds = ("purchase", "purchase", "error", "view")
    values = ", ".join(f"({k}, timestamp '2024-01-01' + to_seconds({r.randrange(4000)}), {r.randrange(30)}, '{r.choice(kinds)}', {r.randrange(1, 900) / 4}, '{{\"k\": {r.randrange(100)}}}')" for k in range(3000))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) e(event_id, ts, user_id, event_type, value, props)")
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return con, str(folder)


@pytest.mark.parametrize("name", ["health_steps", "enemy_series", "squad_timeline"])
def test_rows_outside_the_bounds_count_as_in_sql(spark, unordered, name):
    con, folder = unordered
    expected = con.execute(queries.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert rows(queries.QUERIES[name](spark, folder), *columns) == sorted(expected)
