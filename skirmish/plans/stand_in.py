"""The canonical event table as a view of the test table ``events``, in two SQL dialects.

One second of the test data is one millisecond of a log.  Users with an even number are the squad, two
of them an account; every tenth row is a pet's.  The third log is of the older format.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .frames import Frames

_SQL = """
SELECT *,
  CAST(CASE WHEN sc IN (69, 70, 71, 72) THEN CASE k % 6 WHEN 0 THEN 740 WHEN 1 THEN 717 WHEN 2 THEN 736 WHEN 3 THEN 723 WHEN 4 THEN 1122 ELSE 725 END
       WHEN sc = 67 OR sc = 68 THEN CASE k % 9 WHEN 0 THEN 23275 WHEN 1 THEN 1066 ELSE 100 + k % 5 END
       WHEN seq % 15 = 0 THEN 736 WHEN k = 7 THEN 9292 ELSE 100 + k END AS BIGINT) AS skillid,
  CAST(sc AS SMALLINT) AS is_statechange,
  CAST(CASE WHEN sc IN (69, 70, 71, 72) THEN v * 20 WHEN sc IN (67, 68) THEN v % 900 + 20 WHEN sc = 49 THEN CASE WHEN buff = 1 THEN 0 ELSE -v END WHEN buff = 1 THEN 0 ELSE v END AS INT) AS value,
  CAST(CASE WHEN sc = 68 THEN v % 700 WHEN sc = 67 THEN 0 WHEN buff = 1 AND sc = 0 THEN v WHEN buff = 1 AND sc = 49 THEN -v ELSE 0 END AS INT) AS buff_dmg,
  CAST(CASE WHEN sc = 8 THEN (seq * 37) % 10100 WHEN seq % 4 = 0 OR seq % 3 = 0 OR u % 2 = 1 THEN 6 * (k % 2) + 4 * (u % 3) ELSE 1000000 + k % 40 END AS BIGINT) AS dst_agent
FROM (
  SELECT CONCAT('L', CAST(u % 3 AS STRING)) AS log_id, seq, time, u, k, v, u % 3 <> 2 AS post_era,
    CAST(CASE WHEN sc = 40 THEN 2627419289 + 4294967296 * (1 + u % 3) WHEN seq % 10 = 0 THEN 500000 + u WHEN (sc IN (0, 69, 72) AND seq % 6 = 3) OR (sc = 67 AND seq % 6 = 2) OR (sc = 8 AND seq % 5 < 2) THEN 1000000 + k % 40 ELSE u END AS BIGINT) AS src_agent,
    CAST(CASE WHEN seq % 10 = 0 THEN 30001 + u % 2048 ELSE 1 + (u + 7 * {days}) % 2048 END AS INT) AS src_instid,
    CAST(CASE WHEN sc = 72 AND seq % 4 = 1 THEN 40001 + k % 40 WHEN sc = 49 THEN 1 + (6 * (k % 2) + 4 * (u % 3) + 7 * {days}) % 2048 ELSE 0 END AS INT) AS dst_instid,
    CAST(CASE WHEN seq % 10 = 0 THEN 1 + (u + 7 * {days}) % 2048 ELSE 0 END AS INT) AS src_master_instid,
    CAST(CASE WHEN sc IN (49, 72) AND k % 3 = 1 THEN 1 + (u + 7 * {days}) % 2048 ELSE 0 END AS INT) AS dst_master_instid,
    CAST(CASE WHEN (seq % 4 <> 0 AND seq % 3 <> 0) OR u % 2 = 1 OR seq % 6 = 3 THEN 1 ELSE 0 END AS SMALLINT) AS iff,
    CAST(CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS buff,
    CAST(CASE WHEN u % 3 = 2 AND seq % 5 = 0 THEN k % 6 ELSE (seq * 7 + k) % 19 END AS SMALLINT) AS result,
    CAST(CASE WHEN u % 3 = 2 AND sc = 0 AND seq % 11 < 4 AND k % 10 > 6 THEN 1 + seq % 11 + k % 3 ELSE CASE WHEN sc = 68 THEN 3 + k % 4 ELSE 0 END END AS SMALLINT) AS is_activation,
    CAST(CASE WHEN u % 3 = 2 AND sc = 0 AND seq % 13 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS is_buffremove,
    CAST(CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS is_ninety, CAST(seq % 2 AS SMALLINT) AS is_fifty,
    CAST(k % 4 AS SMALLINT) AS is_moving, CAST(seq % 2 AS SMALLINT) AS is_flanking,
    CAST(CASE WHEN seq % 9 = 0 THEN 1 ELSE 0 END AS SMALLINT) AS is_shields,
    CAST(CASE WHEN sc = 49 THEN CASE seq % 6 WHEN 0 THEN 64 WHEN 1 THEN 128 WHEN 2 THEN 160 WHEN 3 THEN 1 WHEN 4 THEN 96 ELSE 0 END ELSE k % 6 END AS SMALLINT) AS is_offcycle,
    CAST(k * 3 AS BIGINT) AS overstack, CAST(CASE WHEN sc = 40 THEN 0 WHEN sc = 49 AND seq % 7 <> 0 THEN 2627419289 ELSE k % 7 END AS BIGINT) AS pad, sc,
    CAST(v % 997 AS FLOAT) AS x, CAST(seq % 613 AS FLOAT) AS y, CAST(k % 17 AS FLOAT) AS z
  FROM (
    SELECT *, CASE event_type WHEN 'purchase' THEN 0
      WHEN 'error' THEN CASE k % 10 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 72 WHEN 4 THEN 72 WHEN 5 THEN 71 WHEN 6 THEN 56 WHEN 7 THEN CASE WHEN seq % 4 = 0 THEN 85 ELSE 19 END WHEN 8 THEN 49 WHEN 9 THEN CASE WHEN k = 19 THEN 40 ELSE 0 END ELSE 0 END
      WHEN 'click' THEN CASE WHEN seq % 2 = 0 THEN 67 ELSE 68 END WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 57 WHEN 1 THEN 58 WHEN 2 THEN 59 ELSE 8 END ELSE 69 END AS sc
    FROM (SELECT event_id AS seq, {seconds} AS time, user_id AS u, {k} AS k, CAST(floor(value * 100) AS BIGINT) AS v, event_type FROM {events})
  )
)"""

# DuckDB's epoch_ms rounds to the nearest millisecond, so the last half millisecond of a second is the next one's
_DIALECTS = {
    "spark": {"days": "(time div 864000)", "seconds": "(CAST(round((CAST(datediff(to_date(ts), DATE '1970-01-01') AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + extract(SECOND FROM ts)) * 1000) AS BIGINT) div 1000)", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)"},
    "duckdb": {"days": "(time // 864000)", "seconds": "(epoch_ms(ts) // 1000)", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)"},
}

_ROSTER = """
SELECT DISTINCT log_id, addr, CASE WHEN addr >= 1000000 THEN addr - addr % 2 ELSE addr - addr % 4 END AS rep,
  CASE WHEN addr >= 1000000 THEN 'enemy' ELSE 'squad' END AS side, CASE WHEN addr >= 1000000 THEN 2 ELSE 1 END AS team,
  CAST(CASE WHEN addr >= 1000000 THEN 0 ELSE addr % 3 END AS INT) AS subgroup
FROM (SELECT log_id, src_agent AS addr FROM {combat} WHERE src_agent < 500000 AND src_agent % 2 = 0
      UNION SELECT log_id, dst_agent FROM {combat} WHERE dst_agent >= 1000000 AND is_statechange <> 8
      UNION SELECT log_id, src_agent FROM {combat} WHERE src_agent BETWEEN 1000000 AND 2000000)"""
_TEAMS = """
SELECT log_id, addr, team FROM {roster}
UNION SELECT log_id, src_agent, CASE WHEN src_agent % 4 = 0 THEN 1 ELSE 2 END FROM {combat} WHERE src_agent BETWEEN 500000 AND 999999 AND src_agent % 6 <> 0"""
_LOGS = "SELECT DISTINCT log_id, CASE WHEN log_id <> 'L1' THEN 1 END AS friendly_team FROM {combat}"


_made: dict[tuple[str, str], Frames] = {}


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    """The frames of the view, stored once for a session: the operators are planned over plain columns and
    not over this translation."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        view = lambda sql, **parts: spark.sql(sql, **parts)
        source = spark.read.parquet(f"{sf_dir}/events.parquet")
        combat = view(_SQL.format(events="{events}", **_DIALECTS["spark"]), events=source).drop("u", "k", "v", "sc")
        roster = view(_ROSTER, combat=combat)
        _made[key] = Frames(combat, roster, view(_LOGS, combat=combat), view(_TEAMS, combat=combat, roster=roster)).stored()
    return _made[key]


#: What each oracle begins with: the same views in DuckDB, and the rows that most of them read.
PRELUDE = f"""
WITH combat AS MATERIALIZED ({_SQL.replace("STRING", "VARCHAR").format(events="events", **_DIALECTS["duckdb"])}),
roster AS MATERIALIZED ({_ROSTER.format(combat="combat")}),
squad AS (SELECT log_id, addr, rep, subgroup FROM roster WHERE side = 'squad'),
enemy AS (SELECT log_id, addr, rep FROM roster WHERE side = 'enemy'),
teams AS ({_TEAMS.format(combat="combat", roster="roster")}),
logs AS ({_LOGS.format(combat="combat")}),
bounds AS (SELECT log_id, arg_min(time, seq) AS t0, arg_max(time, seq) AS t1, greatest(arg_max(time, seq) - arg_min(time, seq), 0) AS duration_ms FROM combat GROUP BY 1),
reg AS (
  SELECT log_id, instid, time, arg_max(addr, o) AS addr FROM (
    SELECT log_id, src_instid AS instid, time, src_agent AS addr, seq * 2 AS o FROM combat WHERE src_instid <> 0 AND src_agent <> 0 AND is_statechange NOT IN (40, 49)
    UNION ALL SELECT log_id, dst_instid, time, dst_agent, seq * 2 + 1 FROM combat WHERE dst_instid <> 0 AND dst_agent <> 0 AND is_statechange NOT IN (40, 49))
  GROUP BY 1, 2, 3),
agents AS (SELECT log_id, addr FROM roster UNION SELECT log_id, src_agent FROM combat WHERE is_statechange <> 40),
mastered AS (
  SELECT c.log_id, c.seq, r.addr AS master FROM (SELECT log_id, seq, time, dst_master_instid AS m FROM combat WHERE dst_master_instid <> 0) c
  ASOF JOIN reg r ON c.log_id = r.log_id AND c.m = r.instid AND c.time >= r.time),
owned AS MATERIALIZED (
  SELECT c.log_id, c.seq, r.addr AS owner FROM (SELECT log_id, seq, time, src_master_instid AS m FROM combat WHERE src_master_instid <> 0) c
  ASOF JOIN reg r ON c.log_id = r.log_id AND c.m = r.instid AND c.time >= r.time),
base AS MATERIALIZED (
  SELECT c.*, is_statechange = 0 AND is_activation = 0 AND is_buffremove = 0 AS row_ok, result NOT IN (12, 10) AS health,
    CAST(greatest(CASE WHEN buff = 1 THEN buff_dmg ELSE value END, 0) AS BIGINT) AS dmg, CAST(greatest(value, 0) AS BIGINT) AS pos,
    is_statechange = 0 AND (post_era OR buff = 0) AND result = 12 AS cc,
    CASE WHEN post_era THEN is_statechange = 72 ELSE is_statechange = 0 AND is_activation = 0 AND is_buffremove = 1 END AS remove_all,
    buff = 0 AND result IN (0, 1, 2) AS direct,
    buff <> 0 AND CASE WHEN post_era THEN result IN (14, 15, 16, 17, 18) ELSE value = 0 AND result = 0 END AS by_buff,
    buff <> 0 AND CASE WHEN post_era THEN result IN (16, 18) ELSE value = 0 AND result = 0 AND is_offcycle IN (3, 5) END AS leech,
    skillid IN (720, 721, 722, 723, 727, 736, 737, 738, 742, 791, 861, 19426, 26766, 27705) AS cond, skillid IN (740, 725, 718, 726, 719, 717, 743, 873, 1122, 1187, 26980, 30328) AS boon,
    CASE WHEN post_era OR buff = 0 THEN is_offcycle = 1 ELSE pad & 255 = 1 END AS downed,
    CASE WHEN buff = 0 THEN CASE WHEN result IN (0, 1, 2) THEN 'hit' WHEN result = 3 THEN 'blocked' WHEN result = 4 THEN 'evaded' WHEN result = 5 THEN 'interrupted' WHEN result IN (6, 13) THEN 'invulned' WHEN result = 7 THEN 'missed' END
      WHEN post_era THEN CASE WHEN result IN (14, 15, 16, 17, 18) THEN 'hit' WHEN result IN (6, 13) THEN 'invulned' END
      ELSE CASE WHEN value <> 0 THEN NULL WHEN result = 0 THEN 'hit' WHEN result BETWEEN 1 AND 4 THEN 'invulned' END END AS o,
    s.rep AS s_rep, s.subgroup AS s_sub, d.rep AS d_rep, se.rep AS se_rep, de.rep AS de_rep, w.owner, ow.rep AS o_rep, coalesce(s.rep, ow.rep) AS credit
  FROM combat c LEFT JOIN squad s ON s.log_id = c.log_id AND s.addr = c.src_agent LEFT JOIN squad d ON d.log_id = c.log_id AND d.addr = c.dst_agent
  LEFT JOIN enemy se ON se.log_id = c.log_id AND se.addr = c.src_agent LEFT JOIN enemy de ON de.log_id = c.log_id AND de.addr = c.dst_agent
  LEFT JOIN owned w ON w.log_id = c.log_id AND w.seq = c.seq LEFT JOIN squad ow ON ow.log_id = c.log_id AND ow.addr = w.owner),
dealt AS MATERIALIZED (
  SELECT b.log_id, seq, time, skillid, dmg, result, is_flanking, s_rep IS NULL AS is_pet, credit AS rep, de_rep
  FROM base b JOIN logs l ON l.log_id = b.log_id LEFT JOIN teams t ON t.log_id = b.log_id AND t.addr = b.src_agent
  WHERE row_ok AND health AND dmg > 0 AND (s_rep IS NOT NULL OR (iff <> 0 AND o_rep IS NOT NULL AND t.team IS NOT DISTINCT FROM l.friendly_team))),
out_hits AS (SELECT * FROM dealt WHERE is_pet OR de_rep IS NOT NULL)
"""
