"""Queries of the fight operators over the stand-in view, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buffs, damage, entities, generation, instants, modifiers, series, support
from . import report
from .frames import Frames
from .stand_in import PRELUDE, frames


def _of(operator: Callable[[Frames], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(frames(spark, sf_dir))


def _queue(f: Frames) -> DataFrame:
    rows = buffs.buff_events(f).filter("kind = 'apply' and ms > 0")
    return buffs.queue_spans(rows, ["log_id", "rep", "buff_id"], "time", "ms").select("log_id", "rep", "buff_id", "seq", "start", "stop")


def _parallel(f: Frames) -> DataFrame:
    rows = buffs.buff_events(f).filter("kind = 'apply' and buff_id = 740")
    return buffs.parallel_steps(rows, ["log_id", "rep"], "time", "ms").withColumn("n", F.col("n").cast("bigint"))


def _coded(f: Frames) -> DataFrame:
    return series.encode_series(series.squad_timeline(f).select("log_id", "bucket", "downs"), ["log_id"], "bucket", "downs")


def _windows(f: Frames) -> DataFrame:
    return support.down_windows(f).select("log_id", "target", "side", "t_down", "down_seq", "lo")


#: SQL that goes before all of the healing: its rows, with accounts.
_HEAL = """
        , told AS (SELECT DISTINCT log_id FROM combat WHERE is_statechange = 40 AND pad = 0 AND src_agent % 4294967296 = 2627419289 AND src_agent // 4294967296 IN (1, 2)),
        d AS (SELECT log_id, seq, time, src_instid, dst_instid, skillid, buff = 0 AS direct, is_shields > 0 AS barrier, -CASE WHEN buff = 0 THEN value ELSE buff_dmg END AS a, is_offcycle & 32 <> 0 OR (buff = 0 AND is_offcycle & 63 = 1) AS down,
            is_offcycle & 128 <> 0 OR is_offcycle & 192 = 0 AS peer
          FROM combat SEMI JOIN told USING (log_id) WHERE ((is_statechange = 40 AND pad <> 0) OR is_statechange = 49) AND pad = 2627419289 AND iff = 0 AND CASE WHEN buff = 0 THEN value < 0 ELSE value = 0 AND buff_dmg < 0 END),
        e AS (SELECT d.*, r.addr AS healer FROM d ASOF JOIN reg r ON d.log_id = r.log_id AND d.src_instid = r.instid AND d.time >= r.time),
        g AS (SELECT e.*, r.addr AS target FROM e ASOF JOIN reg r ON e.log_id = r.log_id AND e.dst_instid = r.instid AND e.time >= r.time),
        k AS (SELECT *, bool_or(peer) OVER (PARTITION BY log_id, healer, barrier) AS any_peer FROM g),
        heal AS (SELECT k.log_id, k.time, k.skillid, k.a, direct, barrier, down, coalesce(s.rep, o.rep) AS rep, coalesce(t.rep, k.target) AS target FROM k LEFT JOIN squad s ON s.log_id = k.log_id AND s.addr = k.healer
          LEFT JOIN owned w ON w.log_id = k.log_id AND w.seq = k.seq LEFT JOIN squad o ON o.log_id = k.log_id AND o.addr = w.owner LEFT JOIN roster t ON t.log_id = k.log_id AND t.addr = k.target
          WHERE (peer OR NOT any_peer) AND coalesce(s.rep, o.rep) IS NOT NULL)"""

#: The timeline by second, casts and tracks, in SQL.
_TIMELINE = """
        , what AS (SELECT log_id, time, 'd' AS w, dmg AS n FROM out_hits UNION ALL SELECT log_id, time, 'c', 1 FROM base WHERE cc AND s_rep IS NOT NULL AND de_rep IS NOT NULL
          UNION ALL SELECT log_id, time, 'w', 1 FROM base WHERE is_statechange = 0 AND result = 9 AND s_rep IS NOT NULL AND de_rep IS NOT NULL UNION ALL SELECT log_id, time, 's', 1 FROM base WHERE remove_all AND boon AND d_rep IS NOT NULL AND se_rep IS NOT NULL),
        sums AS (SELECT log_id, (time - t0) // 1000 AS bucket, w, sum(n) AS n FROM what JOIN bounds USING (log_id) GROUP BY 1, 2, 3),
        timeline AS (SELECT g.log_id, g.bucket, CAST(coalesce(sum(n) FILTER (w = 'd'), 0) AS BIGINT) AS damage, CAST(coalesce(sum(n) FILTER (w = 'c'), 0) AS BIGINT) AS cc, CAST(coalesce(sum(n) FILTER (w = 'w'), 0) AS BIGINT) AS downs, CAST(coalesce(sum(n) FILTER (w = 's'), 0) AS BIGINT) AS strips
        FROM (SELECT log_id, unnest(range(0, duration_ms // 1000 + 1)) AS bucket FROM bounds) g LEFT JOIN sums s ON s.log_id = g.log_id AND s.bucket = g.bucket GROUP BY 1, 2)"""
_CASTS = """
        , i AS (SELECT b.log_id, s_rep AS rep, skillid, b.time - t0 AS at_ms, seq, CASE WHEN post_era THEN is_statechange = 68 ELSE is_activation BETWEEN 3 AND 6 END AS stop, CAST(value AS BIGINT) AS v, CAST(buff_dmg AS BIGINT) AS bd, is_activation AS code, duration_ms
          FROM base b JOIN bounds USING (log_id) WHERE s_rep IS NOT NULL AND CASE WHEN post_era THEN is_statechange IN (67, 68) ELSE is_statechange = 0 AND is_activation BETWEEN 1 AND 6 END),
        n AS (SELECT *, lead(stop) OVER w AS n_stop, lead(at_ms) OVER w AS n_at, lead(v) OVER w AS n_v, lead(bd) OVER w AS n_bd, lead(code) OVER w AS n_code, lag(stop) OVER w AS p_stop FROM i WINDOW w AS (PARTITION BY log_id, rep, skillid ORDER BY at_ms, seq)),
        c AS (
          SELECT log_id, rep, skillid, at_ms, seq, CASE WHEN abs(n_v - (n_at - at_ms)) > 10 THEN n_at - at_ms ELSE n_v END AS ms, CASE WHEN skillid = 23275 THEN NULL WHEN bd > 0 THEN bd ELSE v END AS planned,
            CASE WHEN skillid = 23275 OR abs(n_v - (n_at - at_ms)) > 10 THEN 0 ELSE n_bd END AS scaled, n_code AS code, false AS open, false AS fast FROM n WHERE NOT stop AND n_stop
          UNION ALL SELECT log_id, rep, skillid, at_ms, seq, least(CASE WHEN skillid = 23275 THEN 750 WHEN bd > 0 THEN bd ELSE v END, duration_ms - at_ms), NULL, 0, NULL, true, code = 2 FROM n WHERE NOT stop AND NOT coalesce(n_stop, false)
          UNION ALL SELECT log_id, rep, skillid, at_ms - v, seq, v, v, CASE WHEN skillid = 23275 THEN 0 ELSE bd END, code, false, false FROM n WHERE stop AND coalesce(p_stop, true) AND at_ms - v < 0),
        d AS (SELECT *, lead(at_ms) OVER (PARTITION BY log_id, rep ORDER BY at_ms, skillid, seq) + 10 - at_ms AS room FROM c WHERE ms > 1),
        e AS (SELECT * EXCLUDE (ms, code), CASE WHEN open AND room < ms THEN room ELSE ms END AS cast_ms, CASE WHEN skillid = 1066 THEN NULL ELSE code END AS code, CASE WHEN scaled > 0 THEN scaled / CAST(ms AS DOUBLE) ELSE 1.0 END AS ratio FROM d),
        casts AS (SELECT log_id, rep, skillid, at_ms, seq, cast_ms,
          CAST(CASE WHEN code = 4 THEN -cast_ms WHEN code IN (3, 6) THEN greatest(CAST(round_even(coalesce(planned, cast_ms) / ratio, 0) AS BIGINT) - cast_ms, 0) ELSE 0 END AS BIGINT) AS time_gained,
          round(CASE WHEN scaled > 0 THEN greatest(least(CASE WHEN ratio > 1 THEN (ratio - 1) / 0.5 ELSE -(1 - ratio) / 0.6 END, 1.0), -1.0) WHEN fast THEN 1.0 ELSE 0.0 END, 3) AS quickness,
          CASE WHEN code = 4 THEN 'interrupted' WHEN code = 5 THEN 'full' WHEN code IN (3, 6) THEN 'reduced' ELSE 'unknown' END AS status FROM e)"""
_TRACKS = """
        , own AS (SELECT b.log_id, s_rep AS rep, greatest(b.time - t0, 0) AS at_ms, seq, is_statechange AS s, x, y, z FROM base b JOIN bounds USING (log_id) WHERE s_rep IS NOT NULL),
        pos AS (SELECT log_id, rep, at_ms, s = 85 AS jump, seq, x, y, z, bool_or(s = 85) OVER (PARTITION BY log_id, rep, at_ms) AS jumps, row_number() OVER (PARTITION BY log_id, rep ORDER BY at_ms, s = 85, seq) AS k FROM own WHERE s IN (19, 85)),
        ends AS (SELECT p.log_id, p.rep, CAST(ceil(any_value(aware) / 300.0) AS BIGINT) * 300 AS lo, CAST(ceil(max(at_ms) / 300.0) AS BIGINT) * 300 AS hi FROM pos p JOIN (SELECT log_id, rep, min(at_ms) AS aware FROM own GROUP BY 1, 2) a ON a.log_id = p.log_id AND a.rep = p.rep GROUP BY 1, 2),
        grid AS (SELECT log_id, rep, unnest(range(lo, hi + 1, 300)) AS t_ms FROM ends),
        last_pos AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY log_id, rep, at_ms ORDER BY k DESC) = 1),
        g AS (SELECT grid.log_id, grid.rep, t_ms, coalesce(p.k, 0) AS k FROM grid ASOF LEFT JOIN last_pos p ON grid.log_id = p.log_id AND grid.rep = p.rep AND grid.t_ms >= p.at_ms),
        m AS (SELECT g.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, b.at_ms AS bt, greatest(a.at_ms, b.at_ms - CASE WHEN b.jumps THEN 1 ELSE 300 END) AS moves
          FROM g LEFT JOIN pos a ON a.log_id = g.log_id AND a.rep = g.rep AND a.k = g.k LEFT JOIN pos b ON b.log_id = g.log_id AND b.rep = g.rep AND b.k = g.k + 1),
        h AS (SELECT *, CASE WHEN k > 0 AND bt IS NOT NULL AND t_ms > moves THEN CAST(CAST(t_ms - moves AS DOUBLE) / CAST(bt - moves AS DOUBLE) AS FLOAT) END AS share FROM m),
        tracks AS (SELECT log_id, rep, t_ms, CASE WHEN k = 0 THEN bx WHEN share IS NULL THEN ax ELSE CAST(ax + CAST(CAST(bx - ax AS FLOAT) * share AS FLOAT) AS FLOAT) END AS x,
          CASE WHEN k = 0 THEN by_ WHEN share IS NULL THEN ay ELSE CAST(ay + CAST(CAST(by_ - ay AS FLOAT) * share AS FLOAT) AS FLOAT) END AS y,
          CASE WHEN k = 0 THEN bz WHEN share IS NULL THEN az ELSE CAST(az + CAST(CAST(bz - az AS FLOAT) * share AS FLOAT) AS FLOAT) END AS z FROM h)"""

#: name -> (operator, SQL over the prelude or None where SQL can't express it)
_ALL: dict[str, tuple[Callable[[Frames], DataFrame], str | None]] = {
    "squad_damage": (damage.squad_damage, """
        SELECT o.log_id, rep, CAST(sum(dmg) AS BIGINT) AS damage, CAST(coalesce(sum(dmg) FILTER (is_pet), 0) AS BIGINT) AS pet_damage, count(*) AS hits,
          round(sum(dmg) / greatest(any_value(duration_ms) / 1000.0, 1.0), 3) AS dps FROM out_hits o JOIN bounds USING (log_id) GROUP BY 1, 2"""),
    "damage_per_target": (damage.damage_per_target, "SELECT log_id, rep, de_rep AS target, CAST(sum(dmg) AS BIGINT) AS damage, count(*) AS hits FROM dealt WHERE de_rep IS NOT NULL GROUP BY 1, 2, 3"),
    "damage_taken": (damage.damage_taken, "SELECT log_id, d_rep AS rep, CAST(sum(dmg) AS BIGINT) AS damage_taken FROM base WHERE row_ok AND health AND dmg > 0 AND d_rep IS NOT NULL GROUP BY 1, 2"),
    "pet_owners": (damage.pet_owners, "SELECT c.log_id, src_agent AS addr, arg_min(owner, c.seq) AS owner FROM combat c JOIN owned w ON w.log_id = c.log_id AND w.seq = c.seq WHERE owner IS NOT NULL GROUP BY 1, 2"),
    "enemy_damage": (damage.enemy_damage, """
        SELECT b.log_id, e.rep, CAST(sum(dmg) AS BIGINT) AS damage_out FROM base b
        LEFT JOIN (SELECT c.log_id, src_agent AS addr, arg_min(owner, c.seq) AS first_owner FROM combat c JOIN owned w ON w.log_id = c.log_id AND w.seq = c.seq WHERE owner IS NOT NULL GROUP BY 1, 2) p ON p.log_id = b.log_id AND p.addr = b.src_agent
        JOIN enemy e ON e.log_id = b.log_id AND e.addr = coalesce(p.first_owner, b.src_agent)
        WHERE row_ok AND health AND dmg > 0 AND iff <> 0 AND s_rep IS NULL GROUP BY 1, 2"""),
    "combat_enemies": (damage.combat_enemies, """
        SELECT log_id, de_rep AS rep FROM base WHERE de_rep IS NOT NULL AND ((row_ok AND dmg > 0) OR cc)
        UNION SELECT log_id, se_rep FROM base WHERE se_rep IS NOT NULL AND row_ok AND health AND dmg > 0 AND iff <> 0"""),
    "skill_damage": (damage.skill_damage, """
        SELECT log_id, rep, skillid, CAST(sum(dmg) AS BIGINT) AS total, count(*) AS hits, min(dmg) AS min, max(dmg) AS max, count(*) FILTER (result = 1) AS crit_hits, count(*) FILTER (is_flanking <> 0) AS flank_hits
        FROM out_hits GROUP BY 1, 2, 3"""),
    "skill_damage_per_target": (damage.skill_damage_per_target, """
        SELECT log_id, rep, de_rep AS target, skillid, CAST(sum(dmg) AS BIGINT) AS total, count(*) AS hits, min(dmg) AS min, max(dmg) AS max, count(*) FILTER (result = 1) AS crit_hits, count(*) FILTER (is_flanking <> 0) AS flank_hits
        FROM dealt WHERE de_rep IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    "skill_damage_taken": (damage.skill_damage_taken, """
        SELECT log_id, d_rep AS rep, skillid, CAST(sum(dmg) AS BIGINT) AS total, count(*) AS hits, min(dmg) AS min, max(dmg) AS max, count(*) FILTER (result = 1) AS crit_hits, count(*) FILTER (is_flanking <> 0) AS flank_hits
        FROM base WHERE row_ok AND health AND dmg > 0 AND d_rep IS NOT NULL GROUP BY 1, 2, 3"""),
    "enemy_skill_damage": (damage.enemy_skill_damage, """
        SELECT log_id, rep, skillid, total, hits, min, max, CAST(CASE WHEN indirect THEN 0 ELSE crit END AS BIGINT) AS crit_hits, CAST(CASE WHEN indirect THEN 0 ELSE flank END AS BIGINT) AS flank_hits FROM (
          SELECT log_id, se_rep AS rep, skillid, CAST(coalesce(sum(dmg) FILTER (direct OR by_buff), 0) AS BIGINT) AS total, count(*) FILTER (direct OR by_buff) AS hits,
            coalesce(min(dmg) FILTER (direct OR by_buff), 0) AS min, coalesce(max(dmg) FILTER (direct OR by_buff), 0) AS max,
            count(*) FILTER ((direct OR by_buff) AND result = 1) AS crit, count(*) FILTER ((direct OR by_buff) AND is_flanking <> 0) AS flank, bool_or(buff = 1) AS indirect
          FROM base WHERE row_ok AND health AND iff <> 0 AND o IS NOT NULL AND se_rep IS NOT NULL GROUP BY 1, 2, 3)"""),
    "hit_stats": (damage.hit_stats, """
        SELECT log_id, s_rep AS rep, count(*) AS connected_count, CAST(sum(dmg) AS BIGINT) AS connected_damage,
          count(*) FILTER (cond) AS condition_count, CAST(coalesce(sum(dmg) FILTER (cond), 0) AS BIGINT) AS condition_damage,
          count(*) FILTER (NOT cond AND direct) AS direct_count, CAST(coalesce(sum(dmg) FILTER (NOT cond AND direct), 0) AS BIGINT) AS direct_damage,
          count(*) FILTER (NOT cond AND direct AND skillid <> 9292) AS critable_count, count(*) FILTER (NOT cond AND direct AND skillid <> 9292 AND result = 1) AS crit_count,
          CAST(coalesce(sum(dmg) FILTER (NOT cond AND direct AND skillid <> 9292 AND result = 1), 0) AS BIGINT) AS crit_damage,
          count(*) FILTER (NOT cond AND direct AND is_flanking <> 0) AS flank_count, count(*) FILTER (NOT cond AND direct AND result = 2) AS glance_count,
          count(*) FILTER (NOT cond AND leech) AS leech_count, CAST(coalesce(sum(dmg) FILTER (NOT cond AND leech), 0) AS BIGINT) AS leech_damage,
          count(*) FILTER (NOT cond AND is_ninety <> 0) AS above90_power_count, CAST(coalesce(sum(dmg) FILTER (NOT cond AND is_ninety <> 0), 0) AS BIGINT) AS above90_power_damage,
          count(*) FILTER (cond AND is_ninety <> 0) AS above90_condition_count, CAST(coalesce(sum(dmg) FILTER (cond AND is_ninety <> 0), 0) AS BIGINT) AS above90_condition_damage,
          count(*) FILTER (downed) AS downed_count, CAST(coalesce(sum(dmg) FILTER (downed), 0) AS BIGINT) AS downed_damage, count(*) FILTER (is_moving & 2 <> 0) AS moving_count
        FROM base WHERE row_ok AND (direct OR by_buff) AND s_rep IS NOT NULL AND de_rep IS NOT NULL GROUP BY 1, 2"""),
    "defenses": (damage.defenses, """
        SELECT log_id, d_rep AS rep, count(*) FILTER (h AND kind = 'strike') AS strike_count, CAST(coalesce(sum(dmg) FILTER (h AND kind = 'strike'), 0) AS BIGINT) AS strike_damage,
          count(*) FILTER (h AND kind <> 'condition') AS power_count, CAST(coalesce(sum(dmg) FILTER (h AND kind <> 'condition'), 0) AS BIGINT) AS power_damage,
          count(*) FILTER (h AND kind = 'condition') AS condition_count, CAST(coalesce(sum(dmg) FILTER (h AND kind = 'condition'), 0) AS BIGINT) AS condition_damage,
          count(*) FILTER (h AND kind = 'leech') AS leech_count, CAST(coalesce(sum(dmg) FILTER (h AND kind = 'leech'), 0) AS BIGINT) AS leech_damage,
          count(*) FILTER (h AND shield > 0) AS barrier_count, CAST(coalesce(sum(shield) FILTER (h AND shield > 0), 0) AS BIGINT) AS barrier_damage,
          count(*) FILTER (o = 'blocked') AS blocked_count, count(*) FILTER (o = 'evaded') AS evaded_count, count(*) FILTER (o = 'missed') AS missed_count,
          count(*) FILTER (o = 'invulned') AS invulned_count, count(*) FILTER (o = 'interrupted') AS interrupted_count
        FROM (SELECT *, o = 'hit' AS h, CASE WHEN cond THEN 'condition' WHEN buff = 0 THEN 'strike' WHEN leech THEN 'leech' ELSE 'power' END AS kind,
                CASE WHEN is_shields = 0 THEN 0 WHEN buff = 0 THEN overstack WHEN post_era THEN CASE WHEN overstack > 0 THEN overstack ELSE dmg END ELSE dmg END AS shield
              FROM base WHERE row_ok AND result <> 12 AND o IS NOT NULL AND d_rep IS NOT NULL) GROUP BY 1, 2"""),
    "breakbar_and_control_taken": (damage.breakbar_and_control_taken, """
        SELECT log_id, d_rep AS rep, count(*) FILTER (cc) AS cc_count, CAST(coalesce(sum(pos) FILTER (cc), 0) AS BIGINT) AS cc_ms, count(*) FILTER (NOT cc) AS breakbar_count,
          CAST(coalesce(sum(pos) FILTER (NOT cc), 0) AS BIGINT) AS breakbar_damage FROM base WHERE d_rep IS NOT NULL AND (cc OR (row_ok AND result = 10)) GROUP BY 1, 2"""),
    "breakbar_dealt": (damage.breakbar_dealt, "SELECT log_id, credit AS rep, CAST(sum(pos) AS BIGINT) AS breakbar_dealt FROM base WHERE row_ok AND result = 10 AND iff <> 0 AND credit IS NOT NULL GROUP BY 1, 2"),
    "dodges": (damage.dodges, "SELECT log_id, s_rep AS rep, count(*) AS dodges FROM base WHERE s_rep IS NOT NULL AND skillid = 23275 AND CASE WHEN post_era THEN is_statechange = 67 ELSE is_statechange = 0 AND is_activation IN (1, 2) END GROUP BY 1, 2"),
    "downs_and_kills": (damage.downs_and_kills, """
        SELECT log_id, rep, count(*) FILTER (what = 'dd') AS downs_dealt, count(*) FILTER (what = 'kd') AS kills_dealt, count(*) FILTER (what = 'dt') AS downs_taken, count(*) FILTER (what = 'de') AS deaths FROM (
          SELECT log_id, credit AS rep, CASE WHEN result = 9 THEN 'dd' ELSE 'kd' END AS what FROM base WHERE row_ok AND result IN (8, 9) AND de_rep IS NOT NULL AND credit IS NOT NULL
          UNION ALL SELECT log_id, d_rep, 'dt' FROM base WHERE row_ok AND result = 9 AND d_rep IS NOT NULL
          UNION ALL SELECT log_id, s_rep, 'de' FROM base WHERE is_statechange = 4 AND s_rep IS NOT NULL) GROUP BY 1, 2"""),
    "offence_per_target": (damage.offence_per_target, """
        SELECT * FROM (SELECT log_id, rep, target, count(*) FILTER (m AND result = 9) AS downed, count(*) FILTER (m AND result = 8) AS killed, count(*) FILTER (m AND result = 5) AS interrupts,
          count(*) FILTER (NOT m AND o = 'blocked') AS blocked, count(*) FILTER (NOT m AND o = 'evaded') AS evaded, count(*) FILTER (NOT m AND o = 'missed') AS missed, count(*) FILTER (NOT m AND o = 'invulned') AS invulned,
          count(*) FILTER (NOT m AND (direct OR by_buff)) AS connected_hits, CAST(coalesce(sum(dmg) FILTER (NOT m AND (direct OR by_buff)), 0) AS BIGINT) AS connected_damage,
          count(*) FILTER (NOT m AND direct) AS direct_count, CAST(coalesce(sum(dmg) FILTER (NOT m AND direct), 0) AS BIGINT) AS direct_damage,
          count(*) FILTER (NOT m AND direct AND skillid <> 9292) AS critable_count, count(*) FILTER (NOT m AND direct AND skillid <> 9292 AND result = 1) AS crit_count,
          count(*) FILTER (NOT m AND direct AND is_flanking <> 0) AS flank_count, count(*) FILTER (NOT m AND (direct OR by_buff) AND downed) AS downed_hits
        FROM (SELECT *, result IN (5, 8, 9) AS m, de_rep AS target, CASE WHEN result IN (5, 8, 9) THEN credit ELSE s_rep END AS rep FROM base WHERE row_ok AND de_rep IS NOT NULL) WHERE rep IS NOT NULL GROUP BY 1, 2, 3)
        WHERE downed + killed + interrupts + blocked + evaded + missed + invulned + connected_hits + connected_damage + direct_count + direct_damage + critable_count + crit_count + flank_count + downed_hits > 0"""),
    "skill_outcomes": (damage.skill_outcomes, """
        SELECT log_id, rep, skillid, hits, connected_hits, invulned, CAST(CASE WHEN indirect THEN 0 ELSE glance END AS BIGINT) AS glance, CAST(CASE WHEN indirect THEN 0 ELSE missed END AS BIGINT) AS missed,
          CAST(CASE WHEN indirect THEN 0 ELSE evaded END AS BIGINT) AS evaded, CAST(CASE WHEN indirect THEN 0 ELSE blocked END AS BIGINT) AS blocked, CAST(CASE WHEN indirect THEN 0 ELSE interrupted END AS BIGINT) AS interrupted
        FROM (SELECT log_id, s_rep AS rep, skillid, bool_or(buff = 1) AS indirect, count(*) FILTER (NOT (buff = 0 AND result IN (5, 8, 9))) AS hits, count(*) FILTER (o = 'hit') AS connected_hits,
            count(*) FILTER (o = 'hit' AND result = 2) AS glance, count(*) FILTER (o = 'blocked') AS blocked, count(*) FILTER (o = 'evaded') AS evaded, count(*) FILTER (o = 'missed') AS missed,
            count(*) FILTER (o = 'invulned') AS invulned, count(*) FILTER (o = 'interrupted') AS interrupted
          FROM base WHERE row_ok AND health AND s_rep IS NOT NULL AND de_rep IS NOT NULL GROUP BY 1, 2, 3)"""),
    "control_applied": (support.control_applied, "SELECT log_id, credit AS rep, de_rep AS target, count(*) AS cc_count, CAST(sum(pos) AS BIGINT) AS cc_ms FROM base WHERE cc AND de_rep IS NOT NULL AND credit IS NOT NULL GROUP BY 1, 2, 3"),
    "control_taken": (support.control_taken, "SELECT log_id, d_rep AS rep, time, seq, src_agent, skillid, pos AS cc_ms FROM base WHERE cc AND d_rep IS NOT NULL"),
    "stun_breaks": (support.stun_breaks, "SELECT log_id, s_rep AS rep, count(*) AS stun_breaks, CAST(sum(pos) AS BIGINT) AS stun_break_ms FROM base WHERE is_statechange = 56 AND s_rep IS NOT NULL GROUP BY 1, 2"),
    "cleanses_and_strips": (support.cleanses_and_strips, """
        SELECT log_id, rep, count(*) FILTER (kind = 'o') AS cleanses, count(*) FILTER (kind = 's') AS cleanses_self, count(*) FILTER (kind = 'm') AS cleanses_minions, count(*) FILTER (kind = 'b') AS strips FROM (
          SELECT b.log_id, d_rep AS rep, CASE WHEN boon THEN CASE WHEN se_rep IS NOT NULL THEN 'b' END WHEN coalesce(s_rep, se_rep, src_agent) = d_rep THEN 's' WHEN s_rep IS NOT NULL AND s_sub <> 0 THEN 'o'
            WHEN r.addr IS NOT NULL THEN 'm' END AS kind
          FROM base b LEFT JOIN (SELECT log_id, addr FROM squad WHERE subgroup <> 0) r ON r.log_id = b.log_id AND r.addr = b.owner WHERE remove_all AND (cond OR boon) AND d_rep IS NOT NULL) WHERE kind IS NOT NULL GROUP BY 1, 2"""),
    "resurrects": (support.resurrects, "SELECT log_id, s_rep AS rep, count(*) AS resurrects FROM base WHERE s_rep IS NOT NULL AND skillid = 1066 AND CASE WHEN post_era THEN is_statechange = 67 ELSE is_statechange = 0 AND is_activation IN (1, 2) END GROUP BY 1, 2"),
    "strips_taken": (support.strips_taken, """
        SELECT b.log_id, s_rep AS rep, count(*) AS strips_taken, CAST(sum(pos) AS BIGINT) AS stripped_ms FROM base b LEFT JOIN mastered m ON m.log_id = b.log_id AND m.seq = b.seq
        LEFT JOIN roster r ON r.log_id = b.log_id AND r.addr = coalesce(m.master, b.dst_agent)
        WHERE remove_all AND boon AND s_rep IS NOT NULL AND coalesce(r.rep, m.master, b.dst_agent) <> s_rep AND EXISTS (SELECT 1 FROM agents a WHERE a.log_id = b.log_id AND a.addr = coalesce(m.master, b.dst_agent)) GROUP BY 1, 2"""),
    "down_windows": (_windows, """
        SELECT log_id, target, side, time AS t_down, seq AS down_seq, greatest(coalesce(anchor, t0) - 2000, t0, coalesce(lag(time) OVER (PARTITION BY log_id, target ORDER BY time, seq) + 2100, 0)) AS lo FROM (
          SELECT b.log_id, dst_agent AS target, CASE WHEN de_rep IS NULL THEN 'squad' ELSE 'enemy' END AS side, b.time, b.seq, h.time AS anchor
          FROM base b ASOF LEFT JOIN (SELECT DISTINCT log_id, src_agent, time FROM combat WHERE is_statechange = 8 AND dst_agent BETWEEN 9900 AND 20000) h
            ON h.log_id = b.log_id AND h.src_agent = b.dst_agent AND b.time >= h.time
          WHERE is_statechange = 0 AND result = 9 AND (de_rep IS NOT NULL OR d_rep IS NOT NULL)) JOIN bounds USING (log_id)"""),
    "down_contribution": (support.down_contribution, """
        , downs AS (SELECT log_id, target, de_rep, t_down, seq, greatest(coalesce(anchor, t0) - 2000, t0, coalesce(lag(t_down) OVER (PARTITION BY log_id, target ORDER BY t_down, seq) + 2100, 0)) AS lo FROM (
          SELECT b.log_id, dst_agent AS target, de_rep, b.time AS t_down, seq, h.time AS anchor FROM base b ASOF LEFT JOIN (SELECT DISTINCT log_id, src_agent, time FROM combat WHERE is_statechange = 8 AND dst_agent BETWEEN 9900 AND 20000) h
            ON h.log_id = b.log_id AND h.src_agent = b.dst_agent AND b.time >= h.time WHERE is_statechange = 0 AND result = 9 AND de_rep IS NOT NULL) JOIN bounds USING (log_id))
        SELECT * FROM (SELECT b.log_id, credit AS rep, d.de_rep AS target, CAST(sum(CASE WHEN cc THEN 0 ELSE dmg END) AS BIGINT) AS damage, count(*) FILTER (cc) AS cc_count, CAST(coalesce(sum(pos) FILTER (cc), 0) AS BIGINT) AS cc_ms, count(DISTINCT d.seq) AS downs
          FROM base b JOIN downs d ON d.log_id = b.log_id AND d.target = b.dst_agent AND b.time BETWEEN d.lo AND d.t_down WHERE ((row_ok AND health) OR cc) AND credit IS NOT NULL GROUP BY 1, 2, 3) WHERE damage > 0 OR cc_count > 0"""),
    "focus": (support.focus, """
        , c AS (SELECT log_id, seq, time, d_rep AS rep FROM base WHERE post_era AND is_statechange = 67 AND se_rep IS NOT NULL AND d_rep IS NOT NULL),
        w AS (SELECT log_id, d_rep AS rep, time AS t FROM base WHERE is_statechange = 0 AND result = 9 AND d_rep IS NOT NULL),
        late AS (SELECT c.log_id, c.rep, count(DISTINCT c.seq) AS n FROM c JOIN w ON w.log_id = c.log_id AND w.rep = c.rep AND c.time BETWEEN w.t - 3000 AND w.t GROUP BY 1, 2)
        SELECT c.log_id, c.rep, count(*) AS casts_drawn, round(count(*) * any_value(size) / any_value(total), 6) AS focus_index, coalesce(any_value(late.n), 0) AS casts_before_down
        FROM c JOIN (SELECT log_id, count(DISTINCT rep) AS size FROM squad GROUP BY 1) m ON m.log_id = c.log_id JOIN (SELECT log_id, count(*) AS total FROM c GROUP BY 1) a ON a.log_id = c.log_id
        LEFT JOIN late ON late.log_id = c.log_id AND late.rep = c.rep GROUP BY 1, 2"""),
    "missiles": (support.missiles, """
        SELECT log_id, rep, count(*) AS fired, count(*) FILTER (hit) AS hit, count(*) FILTER (NOT hit) AS denied, count(*) FILTER (reflected) AS reflected FROM (
          SELECT c.log_id, s.rep, c.src_agent, hit, reflected FROM (
            SELECT log_id, pad, shot, max(src_agent) FILTER (is_statechange = 57) AS src_agent, arg_max(is_flanking <> 0, seq) FILTER (is_statechange = 59) AS hit,
              coalesce(bool_or(is_statechange = 58 AND is_flanking = 0 AND dst_agent <> 0 AND dst_agent = creator), false) AS reflected
            FROM (SELECT *, max(CASE WHEN is_statechange = 57 THEN src_agent END) OVER (PARTITION BY log_id, pad, shot) AS creator FROM (
              SELECT *, sum(CASE WHEN is_statechange = 57 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, pad ORDER BY seq) AS shot FROM combat WHERE is_statechange IN (57, 58, 59)))
            WHERE shot > 0 GROUP BY 1, 2, 3) c JOIN squad s ON s.log_id = c.log_id AND s.addr = c.src_agent) GROUP BY 1, 2"""),
    "healing": (support.healing, _HEAL + """
        SELECT log_id, rep, CAST(coalesce(sum(a) FILTER (NOT barrier), 0) AS BIGINT) AS healing, CAST(coalesce(sum(a) FILTER (NOT barrier AND target = rep), 0) AS BIGINT) AS healing_self,
          CAST(coalesce(sum(a) FILTER (NOT barrier AND target <> rep), 0) AS BIGINT) AS healing_allies, CAST(coalesce(sum(a) FILTER (barrier), 0) AS BIGINT) AS barrier,
          CAST(coalesce(sum(a) FILTER (NOT barrier AND down), 0) AS BIGINT) AS healing_downed FROM heal GROUP BY 1, 2"""),
    "healing_by_ally": (support.healing_by_ally, _HEAL + """
        SELECT log_id, rep, target, CAST(coalesce(sum(a) FILTER (NOT barrier), 0) AS BIGINT) AS healing, CAST(coalesce(sum(a) FILTER (NOT barrier AND down), 0) AS BIGINT) AS healing_downed,
          CAST(coalesce(sum(a) FILTER (barrier), 0) AS BIGINT) AS barrier FROM heal GROUP BY 1, 2, 3"""),
    "healing_by_skill": (support.healing_by_skill, _HEAL + """
        SELECT log_id, rep, skillid, barrier, count(*) AS hits, CAST(sum(a) AS BIGINT) AS total, CAST(min(a) AS BIGINT) AS min, CAST(max(a) AS BIGINT) AS max, bool_or(NOT direct) AS indirect FROM heal GROUP BY 1, 2, 3, 4"""),
    "cumulative_healing": (support.cumulative_healing, _HEAL + """
        SELECT log_id, rep, bucket, CAST(sum(h) OVER w AS BIGINT) AS healing, CAST(sum(b) OVER w AS BIGINT) AS barrier FROM (
          SELECT log_id, rep, (time - t0) // 1000 + CASE WHEN (time - t0) % 1000 <> 0 THEN 1 ELSE 0 END AS bucket, sum(CASE WHEN barrier THEN 0 ELSE a END) AS h, sum(CASE WHEN barrier THEN a ELSE 0 END) AS b FROM heal JOIN bounds USING (log_id) GROUP BY 1, 2, 3)
        WINDOW w AS (PARTITION BY log_id, rep ORDER BY bucket)"""),
    "running_healing_extension": (support.running_healing_extension, _HEAL + """
        , seen AS (SELECT g.log_id, healer AS addr FROM g WHERE peer UNION SELECT g.log_id, target FROM g JOIN combat c ON c.log_id = g.log_id AND c.seq = g.seq WHERE c.is_offcycle & 64 <> 0)
        SELECT seen.log_id, seen.addr FROM seen SEMI JOIN squad ON squad.log_id = seen.log_id AND squad.addr = seen.addr"""),
    "squad_timeline": (series.squad_timeline, _TIMELINE + """
        SELECT * FROM timeline"""),
    "cumulative_damage": (lambda f: series.cumulative_damage(f, 1000), """
        SELECT log_id, rep, bucket, CAST(sum(dmg) OVER (PARTITION BY log_id, rep ORDER BY bucket) AS BIGINT) AS damage FROM (
          SELECT log_id, rep, (time - t0) // 1000 + CASE WHEN (time - t0) % 1000 <> 0 THEN 1 ELSE 0 END AS bucket, sum(dmg) AS dmg FROM out_hits JOIN bounds USING (log_id) GROUP BY 1, 2, 3)"""),
    "enemy_series": (lambda f: series.enemy_series(f, 1000), """
        SELECT b.log_id, coalesce(se_rep, e.rep) AS rep, (time - t0) // 1000 + CASE WHEN (time - t0) % 1000 <> 0 THEN 1 ELSE 0 END AS bucket, CAST(sum(dmg) AS BIGINT) AS damage
        FROM base b JOIN bounds USING (log_id) LEFT JOIN enemy e ON e.log_id = b.log_id AND e.addr = b.owner WHERE row_ok AND health AND dmg > 0 AND iff <> 0 AND coalesce(se_rep, e.rep) IS NOT NULL GROUP BY 1, 2, 3"""),
    "entity_series": (lambda f: series.entity_series(f, 1000), """
        SELECT log_id, rep, (time - t0) // 1000 AS bucket, CAST(sum(a) AS BIGINT) AS cc_applied, CAST(sum(t) AS BIGINT) AS cc_taken FROM (
          SELECT log_id, time, s_rep AS rep, 1 AS a, 0 AS t FROM base WHERE cc AND s_rep IS NOT NULL AND de_rep IS NOT NULL UNION ALL SELECT log_id, time, d_rep, 0, 1 FROM base WHERE cc AND d_rep IS NOT NULL) JOIN bounds USING (log_id) GROUP BY 1, 2, 3"""),
    "encoded_series": (_coded, _TIMELINE + """
        , r AS (SELECT log_id, bucket, downs, sum(CASE WHEN was IS DISTINCT FROM downs THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY bucket) AS run FROM (SELECT *, lag(downs) OVER (PARTITION BY log_id ORDER BY bucket) AS was FROM timeline))
        SELECT log_id, downs, min(bucket) AS first, count(*) AS length FROM r GROUP BY log_id, run, downs"""),
    "health_steps": (series.health_steps, """
        , h AS (SELECT b.log_id, s_rep AS rep, time, seq, least(dst_agent, 10000) AS health, t0, t1, row_number() OVER (PARTITION BY b.log_id, s_rep ORDER BY time, seq) AS rn FROM base b JOIN bounds USING (log_id) WHERE is_statechange = 8 AND s_rep IS NOT NULL),
        g AS (SELECT log_id, rep, t0, t1, CASE WHEN rn = 1 THEN t0 ELSE time END AS at_ms, arg_max(health, seq) AS health FROM h GROUP BY 1, 2, 3, 4, 5),
        s AS (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY log_id, rep ORDER BY at_ms), t1) AS stop FROM g)
        SELECT log_id, rep, at_ms - t0 AS at_ms, health FROM (SELECT *, lag(health) OVER (PARTITION BY log_id, rep ORDER BY at_ms) AS was FROM s WHERE stop > at_ms) WHERE was IS DISTINCT FROM health"""),
    "casts": (series.casts, _CASTS + """
        SELECT * FROM casts"""),
    "cast_summary": (series.cast_summary, _CASTS + """
        SELECT log_id, rep, count(*) AS casts, count(*) FILTER (status = 'reduced' AND time_gained > 0) AS saved, CAST(coalesce(sum(time_gained) FILTER (status = 'reduced' AND time_gained > 0), 0) AS BIGINT) AS saved_ms,
          count(*) FILTER (status = 'interrupted') AS wasted, CAST(coalesce(sum(-time_gained) FILTER (status = 'interrupted'), 0) AS BIGINT) AS wasted_ms, round(count(*) / (greatest(any_value(duration_ms), 1) / 60000.0), 3) AS casts_per_minute
        FROM casts JOIN bounds USING (log_id) GROUP BY 1, 2"""),
    "state_intervals": (series.state_intervals, """
        , r AS (SELECT b.log_id, s_rep AS rep, time - t0 AS at_ms, seq, is_statechange AS s FROM base b JOIN bounds USING (log_id) WHERE is_statechange IN (3, 4, 5) AND s_rep IS NOT NULL),
        n AS (SELECT *, lead(s) OVER w AS ns, lead(at_ms) OVER w AS nt, lag(s) OVER w AS was, min(CASE WHEN s = 3 THEN at_ms END) OVER (PARTITION BY log_id, rep ORDER BY at_ms, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS up FROM r WINDOW w AS (PARTITION BY log_id, rep ORDER BY at_ms, seq))
        SELECT log_id, rep, 'down' AS state, at_ms AS start, nt AS stop FROM n WHERE s = 5 AND ns IN (3, 4) UNION ALL SELECT log_id, rep, 'dead', at_ms, up FROM n WHERE s = 4 AND was IS DISTINCT FROM 4 AND up IS NOT NULL"""),
    "active_time": (series.active_time, """
        , r AS (SELECT b.log_id, s_rep AS rep, time AS t, seq, is_statechange AS s FROM base b WHERE is_statechange IN (3, 4, 5) AND s_rep IS NOT NULL),
        n AS (SELECT *, lag(s) OVER w AS was, min(CASE WHEN s = 3 THEN t END) OVER (PARTITION BY log_id, rep ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS up FROM r WINDOW w AS (PARTITION BY log_id, rep ORDER BY t, seq)),
        dead AS (SELECT log_id, rep, sum(up - t) AS ms FROM n WHERE s = 4 AND was IS DISTINCT FROM 4 AND up IS NOT NULL GROUP BY 1, 2)
        SELECT q.log_id, q.rep, CAST(greatest(duration_ms - coalesce(ms, 0), 0) AS BIGINT) AS active_ms FROM (SELECT DISTINCT log_id, rep FROM squad) q JOIN bounds USING (log_id) LEFT JOIN dead ON dead.log_id = q.log_id AND dead.rep = q.rep"""),
    "tracks": (series.tracks, _TRACKS + """
        SELECT * FROM tracks"""),
    "fighting": (series.fighting, """
        , act AS (SELECT * FROM (SELECT *, buff <> 0 AND value <> 0 AS gives FROM base WHERE is_statechange = 0 AND is_activation = 0 AND is_buffremove = 0))
        SELECT * FROM (SELECT log_id, s_rep AS rep FROM act WHERE NOT gives AND health AND iff <> 0 UNION SELECT log_id, d_rep FROM act WHERE NOT gives AND health AND iff <> 0 UNION SELECT log_id, s_rep FROM act WHERE gives AND s_rep IS DISTINCT FROM d_rep) WHERE rep IS NOT NULL"""),
    "distance_to_centre": (series.distance_to_centre, _TRACKS + """
        , r AS (SELECT b.log_id, s_rep AS rep, time - t0 AS at_ms, seq, is_statechange AS s FROM base b JOIN bounds USING (log_id) WHERE is_statechange IN (3, 4, 5) AND s_rep IS NOT NULL),
        sn AS (SELECT *, lead(s) OVER w AS ns, lead(at_ms) OVER w AS nt, lag(s) OVER w AS was, min(CASE WHEN s = 3 THEN at_ms END) OVER (PARTITION BY log_id, rep ORDER BY at_ms, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS up FROM r WINDOW w AS (PARTITION BY log_id, rep ORDER BY at_ms, seq)),
        away AS (SELECT log_id, rep, at_ms AS a, nt AS b FROM sn WHERE s = 5 AND ns IN (3, 4) UNION ALL SELECT log_id, rep, at_ms, up FROM sn WHERE s = 4 AND was IS DISTINCT FROM 4 AND up IS NOT NULL),
        here AS (SELECT t.* FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM away WHERE away.log_id = t.log_id AND away.rep = t.rep AND a < t.t_ms AND t.t_ms < b)),
        act AS (SELECT * FROM (SELECT *, buff <> 0 AND value <> 0 AS gives FROM base WHERE is_statechange = 0 AND is_activation = 0 AND is_buffremove = 0)),
        who AS (SELECT log_id, s_rep AS rep FROM act WHERE NOT gives AND health AND iff <> 0 UNION SELECT log_id, d_rep FROM act WHERE NOT gives AND health AND iff <> 0 UNION SELECT log_id, s_rep FROM act WHERE gives AND s_rep IS DISTINCT FROM d_rep),
        mid AS (SELECT h.log_id, t_ms, avg(CAST(x AS DOUBLE)) AS cx, avg(CAST(y AS DOUBLE)) AS cy FROM here h JOIN who USING (log_id, rep) JOIN bounds b ON b.log_id = h.log_id WHERE t_ms // 300 < duration_ms // 300 GROUP BY 1, 2),
        d AS (SELECT log_id, rep, round(avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 3) AS distance FROM here JOIN mid USING (log_id, t_ms) GROUP BY 1, 2)
        SELECT log_id, rep, coalesce(distance, -1.0) AS distance FROM (SELECT DISTINCT log_id, rep FROM tracks) LEFT JOIN d USING (log_id, rep)"""),
    "buff_uptime": (buffs.uptime, None),
    "boon_count": (buffs.boon_count, None),
    "buff_generated": (generation.generated, None),
    "buff_generation": (generation.generation, None),
    "damage_modifiers": (modifiers.damage_modifiers, None),
    "instant_casts": (instants.instant_casts, None),
    "first_instid": (entities.first_instid, "SELECT log_id, addr, arg_min(instid, (time, instid)) AS instid FROM (SELECT log_id, time, src_instid AS instid, src_agent AS addr FROM combat WHERE src_instid <> 0 AND src_agent <> 0 AND is_statechange NOT IN (40, 49) UNION ALL SELECT log_id, time, dst_instid, dst_agent FROM combat WHERE dst_instid <> 0 AND dst_agent <> 0 AND is_statechange NOT IN (40, 49)) GROUP BY 1, 2"),
    "participants": (entities.participants, "SELECT DISTINCT log_id, src_agent AS addr FROM base WHERE is_statechange = 1 OR CASE WHEN post_era THEN is_statechange = 67 ELSE is_statechange = 0 AND is_activation IN (1, 2) END OR (row_ok AND (value > 0 OR buff_dmg > 0))"),
    "entities": (report.entities, """
        SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY CASE WHEN side = 'squad' THEN 0 ELSE 1 END, team, subgroup, rep) - 1 AS INT) AS entity, rep, side, team, subgroup
        FROM (SELECT log_id, rep, side, min(team) AS team, max(subgroup) AS subgroup FROM roster GROUP BY 1, 2, 3)"""),
    "summary": (report.summary, None),
    "applied_time": (buffs.applied_time, """
        SELECT log_id, d_rep AS rep, skillid AS buff_id, src_agent AS source, count(*) AS applied, CAST(sum(value) AS BIGINT) AS applied_ms FROM base
        WHERE d_rep IS NOT NULL AND (cond OR boon) AND CASE WHEN post_era THEN is_statechange = 69 ELSE is_statechange = 0 AND buff <> 0 AND is_activation = 0 AND is_buffremove = 0 AND buff_dmg = 0 AND value > 0 AND is_offcycle = 0 END GROUP BY 1, 2, 3, 4"""),
    "queue_spans": (_queue, """
        , a AS (SELECT log_id, d_rep AS rep, skillid AS buff_id, seq, time, CAST(value AS BIGINT) AS ms FROM base WHERE d_rep IS NOT NULL AND (cond OR boon) AND value > 0 AND CASE WHEN post_era THEN is_statechange = 69 ELSE is_statechange = 0 AND buff <> 0 AND is_activation = 0 AND is_buffremove = 0 AND buff_dmg = 0 AND is_offcycle = 0 END),
        s AS (SELECT *, sum(ms) OVER w AS total FROM a WINDOW w AS (PARTITION BY log_id, rep, buff_id ORDER BY time, seq))
        SELECT log_id, rep, buff_id, seq, CAST(stop - ms AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT *, total + max(time - (total - ms)) OVER (PARTITION BY log_id, rep, buff_id ORDER BY time, seq) AS stop FROM s)"""),
    "parallel_steps": (_parallel, """
        , a AS (SELECT log_id, d_rep AS rep, time AS b, time + value AS e FROM base WHERE d_rep IS NOT NULL AND skillid = 740 AND value > 0 AND CASE WHEN post_era THEN is_statechange = 69 ELSE is_statechange = 0 AND buff <> 0 AND is_activation = 0 AND is_buffremove = 0 AND buff_dmg = 0 AND is_offcycle = 0 END),
        t AS (SELECT log_id, rep, t, sum(d) AS d FROM (SELECT log_id, rep, b AS t, 1 AS d FROM a UNION ALL SELECT log_id, rep, e, -1 FROM a) GROUP BY 1, 2, 3),
        r AS (SELECT log_id, rep, t, CAST(sum(d) OVER (PARTITION BY log_id, rep ORDER BY t) AS BIGINT) AS n FROM t)
        SELECT log_id, rep, t, n FROM (SELECT *, lag(n) OVER (PARTITION BY log_id, rep ORDER BY t) AS was FROM r) WHERE was IS DISTINCT FROM n"""),
}

#: The summary is the outer join of tables that have SQL of their own.
_PARTS = ("squad_damage", "damage_taken", "downs_and_kills", "cleanses_and_strips")
_SUMS = ("damage", "pet_damage", "hits", "dps", "damage_taken", "downs_dealt", "kills_dealt", "downs_taken", "deaths", "cleanses", "cleanses_self", "cleanses_minions", "strips")
_ALL["summary"] = (report.summary, f"""
        SELECT log_id, rep, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _SUMS)} FROM (SELECT DISTINCT log_id, rep FROM squad)
        {" ".join(f"LEFT JOIN ({_ALL[x][1]}) {x}_part USING (log_id, rep)" for x in _PARTS)}""")

QUERIES = {name: _of(operator) for name, (operator, _) in _ALL.items()}
ORACLES = {name: PRELUDE + sql for name, (_, sql) in _ALL.items() if sql}
