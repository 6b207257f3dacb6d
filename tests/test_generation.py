import random
from collections import Counter

from skirmish.operators import generation, minions
from skirmish.operators.buffs import simulate
from skirmish.schema import State
from tests.fights import FOE, MATE, PET, SQUAD, fight, hit, mark, rows


def a(t, ms, source, first=False):
    return (t, "apply", ms, 0, first, source)


def test_queue_counts_the_running_stack_only():
    held, wasted = generation.by_source([a(0, 100, 1), a(10, 50, 2)], 5, False, 1000)
    assert held == Counter({1: 100, 2: 50}) and not wasted
    held, wasted = generation.by_source([a(0, 100, 1), a(10, 50, 2), a(20, 70, 3)], 2, False, 1000)
    assert held == Counter({1: 100, 3: 70}) and wasted == Counter({2: 50})


def test_removals_waste_what_is_left():
    held, wasted = generation.by_source([a(0, 100, 1), (40, "all", 0, 0, False, 9)], 5, False, 1000)
    assert held == Counter({1: 40}) and wasted == Counter({1: 60})
    held, wasted = generation.by_source([a(0, 100, 1), a(0, 30, 2), (10, "single", 22, 0, False, 9)], 5, True, 1000)
    assert held == Counter({1: 100, 2: 10}) and wasted == Counter({2: 20})


def test_the_strongest_heals_first():
    held, wasted = generation.by_source([a(0, 100, 1), a(10, 50, 2)], 5, False, 1000, {1: 5, 2: 9})
    assert held == Counter({1: 100, 2: 50}) and not wasted
    held, _ = generation.by_source([a(0, 100, 1), a(10, 50, 2)], 5, False, 50, {1: 5, 2: 9})
    assert held == Counter({1: 10, 2: 40})


def test_held_time_is_the_area_of_the_steps():
    rng = random.Random(1)
    for _ in range(200):
        times = sorted(rng.sample(range(300), 10))
        events = [a(t, rng.randint(1, 80), rng.randint(1, 3)) if rng.random() < 0.85 else (t, "all", 0, 0, False, 0) for t in times]
        for side_by_side in (False, True):
            held, _ = generation.by_source(events, 3, side_by_side, 400)
            steps = [*simulate([e[:5] for e in events], 3, side_by_side, 400), (400, 0)]
            area = sum((u - t) * (n if side_by_side else min(n, 1)) for (t, n), (u, _) in zip(steps, steps[1:], strict=False))
            assert sum(held.values()) == area


def test_shares_over_allies(spark):
    f = fight(spark, [hit(0), mark(0, State.BUFF_APPLY, src=SQUAD, dst_agent=MATE, skillid=717, value=500), mark(1000, State.UP)])
    assert rows(generation.generated(f), "rep", "source", "held_ms", "wasted_ms") == [(MATE, SQUAD, 500, 0)]
    r = generation.generation(f).first()
    assert (r.rep, r.self_held, r.group_held, r.squad_held) == (SQUAD, 0.0, 50.0, 50.0)


def test_pets_take_damage_by_name(spark):
    f = fight(spark, [hit(0, src_instid=7), hit(1, src=PET, src_master_instid=7), hit(2, src=FOE, dst=PET, value=30, skillid=4), hit(3, src=FOE, dst=PET, result=4, skillid=4)])
    agents = spark.createDataFrame([("a", PET, "Wolf")], "log_id string, addr bigint, character string")
    assert rows(minions.minion_damage_taken(f, agents), "rep", "minion", "skillid", "hits", "connected_hits", "damage", "evaded") == [(SQUAD, "Wolf", 4, 2, 1, 30, 1)]
