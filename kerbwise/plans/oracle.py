"""The same queries as plain SQL for an independent engine, on the same tables.

Each entry restates the whole computation from ``events`` on. Named steps are kept
once and joined into one WITH list per query.
"""

from __future__ import annotations

import re

from kerbwise import settings as S
from kerbwise.functions.geo import BUCKET_MARGIN, KM_PER_DEGREE
from kerbwise.plans.registry import PIN
from kerbwise.sources.event_log import DUCKDB_FORMS, expand
from kerbwise.sources.incidents import RAW_COLUMNS

STEPS: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(text(x) for x in items)


def km(a: str, b: str) -> str:
    """Distance between the positions of relations ``a`` and ``b``."""
    return km_of(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


def km_of(la: str, lo: str, lb: str, lp: str) -> str:
    dy, dx = f"sin(radians({lb} - {la}) / 2)", f"sin(radians({lp} - {lo}) / 2)"
    return f"(12742.0::DOUBLE * asin(sqrt({dy} * {dy} + cos(radians({la})) * cos(radians({lb})) * {dx} * {dx})))"


def rnd(x: str, digits: int = 0) -> str:
    return f"round_even({x}, {digits})"


def total(x: str) -> str:
    """Exact sum of values with one decimal."""
    return f"(CAST(sum(CAST(round_even({x} * 10, 0) AS BIGINT)) AS DOUBLE) / 10)"


def mean_coordinate(x: str) -> str:
    return f"(CAST(sum(CAST(round_even({x} * 10000000, 0) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 10000000)"


def quantile(x: str, q: float) -> str:
    held = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    position = f"({q}::DOUBLE * (count({x}) - 1))"
    low = f"{held}[1 + CAST(floor({position}) AS BIGINT)]"
    high = f"{held}[1 + CAST(ceil({position}) AS BIGINT)]"
    return f"({low} + ({high} - {low}) * ({position} - floor({position})))"


def label(rules, default: str, column: str = "description") -> str:
    cases = " ".join(
        f"WHEN regexp_matches(coalesce({column}, ''), {text(pattern)}, 'i') THEN {text(name)}" for pattern, name in rules
    )
    return f"CASE {cases} ELSE {text(default)} END"


def cell(size: float = S.GRID_DEG) -> str:
    return (
        f"CAST(round_even(lat / {size}::DOUBLE, 0) AS INTEGER) AS gy, "
        f"CAST(round_even(lon / {size}::DOUBLE, 0) AS INTEGER) AS gx"
    )


TIER = "CASE cause " + " ".join(f"WHEN {text(c)} THEN {text(t)}" for c, t in S.URGENCY_TIERS.items()) + " ELSE 'std' END"


def response(tier: str) -> str:
    return f"CASE {tier} " + " ".join(f"WHEN {text(t)} THEN {text(v)}" for t, v in S.URGENCY_LABELS.items()) + " END"


# Cleaning and scoring -------------------------------------------------------

STEPS["raw_log"] = expand(DUCKDB_FORMS, "events")
STEPS["token_log"] = "SELECT " + ", ".join(
    f"CASE WHEN {c} IN ({values(S.NULL_TOKENS)}) THEN NULL ELSE {c} END AS {c}" for c in RAW_COLUMNS
) + " FROM raw_log"
STEPS["geo_log"] = f"""
SELECT * FROM (SELECT *, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon FROM token_log)
WHERE lat BETWEEN {S.BOUNDS.lat_min} AND {S.BOUNDS.lat_max} AND lon BETWEEN {S.BOUNDS.lon_min} AND {S.BOUNDS.lon_max}"""
STEPS["time_log"] = """
SELECT *, coalesce(t_created, t_start) AS t_event FROM (
  SELECT *, TRY_CAST(start_datetime AS TIMESTAMP) AS t_start, TRY_CAST(created_date AS TIMESTAMP) AS t_created,
    TRY_CAST(modified_datetime AS TIMESTAMP) AS t_modified, TRY_CAST(closed_datetime AS TIMESTAMP) AS t_closed,
    TRY_CAST(resolved_datetime AS TIMESTAMP) AS t_resolved FROM geo_log)"""
STEPS["clean_log"] = f"""
SELECT id, lat, lon, endlatitude, endlongitude, t_event, description, junction, zone,
  epoch_us(t_event) AS t_us,
  CAST(isodow(ist) - 1 AS INTEGER) AS dow, CAST(coalesce(isodow(ist) >= 6, false) AS INTEGER) AS is_weekend,
  CAST(month(ist) AS INTEGER) AS month, CAST(ist AS DATE) AS date,
  CASE WHEN ist IS NULL THEN 'unknown' WHEN hour(ist) <= 6 THEN 'night' WHEN hour(ist) <= 11 THEN 'morning'
    WHEN hour(ist) <= 16 THEN 'midday' WHEN hour(ist) <= 21 THEN 'evening' ELSE 'late' END AS daypart,
  dur_us / 60000000.0::DOUBLE AS dur_raw_min, censored AS clearance_censored,
  CASE WHEN dur_us > 0 AND dur_us < {S.TRUST_LIMIT_MIN * 60000000} AND censored = 0 THEN dur_us END AS dur_trust_us,
  CASE WHEN dur_us > 0 AND dur_us < {S.TRUST_LIMIT_MIN * 60000000} AND censored = 0 THEN dur_us / 60000000.0::DOUBLE END
    AS dur_trust_min,
  trim(lower(event_type)) AS event_type, coalesce(trim(lower(event_cause)), 'others') AS cause,
  coalesce(priority, 'Low') AS priority, CAST(coalesce(upper(requires_road_closure) = 'TRUE', false) AS INTEGER) AS closure,
  trim(coalesce(corridor, '{S.NON_CORRIDOR}')) AS corridor,
  CAST(trim(coalesce(corridor, '{S.NON_CORRIDOR}')) <> '{S.NON_CORRIDOR}' AS INTEGER) AS is_corridor,
  CASE WHEN regexp_matches(coalesce(description, ''), {text(S.TEXT_AFFECTED)}, 'i') THEN 1 ELSE 0 END
    - CASE WHEN regexp_matches(coalesce(description, ''), {text(S.TEXT_CLEAR)}, 'i') THEN 1 ELSE 0 END AS text_signal
FROM (
  SELECT *, CAST(coalesce(dur_us BETWEEN {S.CENSOR_BAND_MIN[0] * 60000000} AND {S.CENSOR_BAND_MIN[1] * 60000000}
      AND t_resolved IS NULL AND t_closed IS NOT NULL, false) AS INTEGER) AS censored
  FROM (SELECT *, t_event + INTERVAL 330 MINUTE AS ist,
          epoch_us(coalesce(t_closed, t_resolved, t_modified)) - epoch_us(t_event) AS dur_us FROM time_log))"""
STEPS["severity_log"] = """
SELECT *, CASE WHEN is_corridor = 1 THEN 'art' ELSE 'loc' END AS tier,
  CASE WHEN priority = 'High' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN closure = 1 THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END
  * CASE text_signal WHEN 1 THEN 1.25::DOUBLE WHEN -1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS severity
FROM clean_log"""
STEPS["median_levels"] = f"""
SELECT 3 - grouping(cause) - grouping(priority) - grouping(tier) AS level, cause, priority, tier,
  {quantile('dur_trust_us', 0.5)} / 60000000.0::DOUBLE AS med_min, count(dur_trust_us) AS n
FROM severity_log WHERE dur_trust_us IS NOT NULL
GROUP BY GROUPING SETS ((cause, priority, tier), (cause, priority), (cause), ())"""
STEPS["crit_table"] = """
SELECT corridor, 1.0::DOUBLE + (share - min(share) OVER ()) / (max(share) OVER () - min(share) OVER () + 1e-9::DOUBLE)
  AS corridor_crit
FROM (SELECT corridor, CAST(count(*) FILTER (WHERE priority = 'High' OR closure = 1) AS DOUBLE) / count(*) AS share
      FROM clean_log GROUP BY corridor)"""
STEPS["enriched"] = f"""
SELECT s.*, e.exp_clearance_min, c.corridor_crit,
  {rnd('s.severity * c.corridor_crit * e.exp_clearance_min', 1)} AS impact_min
FROM severity_log s JOIN crit_table c USING (corridor)
JOIN (
  SELECT k.cause, k.priority, k.tier,
    greatest(2.0::DOUBLE, least(600.0::DOUBLE, coalesce(m3.med_min, m2.med_min, m1.med_min, m0.med_min))) AS exp_clearance_min
  FROM (SELECT DISTINCT cause, priority, tier FROM severity_log) k
  LEFT JOIN median_levels m3 ON m3.level = 3 AND m3.cause = k.cause AND m3.priority = k.priority AND m3.tier = k.tier
  LEFT JOIN median_levels m2 ON m2.level = 2 AND m2.cause = k.cause AND m2.priority = k.priority
  LEFT JOIN median_levels m1 ON m1.level = 1 AND m1.cause = k.cause
  LEFT JOIN median_levels m0 ON m0.level = 0
) e USING (cause, priority, tier)"""
STEPS["unplanned_log"] = f"SELECT *, {cell()} FROM enriched WHERE event_type = 'unplanned'"
STEPS["planned_log"] = f"""
SELECT *, day(date) AS day, {label(S.REPORT_RULES, S.DEFAULT_ARCHETYPE)} AS report_label,
  {label(S.CALENDAR_RULES, S.DEFAULT_ARCHETYPE)} AS calendar_label,
  {label(S.SCENARIO_RULES, S.DEFAULT_SCENARIO)} AS scenario_label
FROM enriched WHERE event_type = 'planned'"""

# Grid -----------------------------------------------------------------------

STEPS["dow_days"] = "SELECT dow, count(DISTINCT date) AS days FROM unplanned_log GROUP BY dow"
STEPS["cell_dow"] = f"""
SELECT gy, gx, dow, sum_impact, {rnd('sum_impact / days', 1)} AS exp_impact_per_day
FROM (SELECT gy, gx, dow, {total('impact_min')} AS sum_impact FROM unplanned_log GROUP BY gy, gx, dow)
JOIN dow_days USING (dow)"""


def frequent(source: str, keys: str, column: str) -> str:
    return f"""(SELECT {keys}, {column} FROM (SELECT {keys}, {column},
      row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS r
      FROM {source} WHERE {column} IS NOT NULL GROUP BY {keys}, {column}) WHERE r = 1)"""


STEPS["cell_table"] = f"""
SELECT b.*, c.cause AS top_cause, d.corridor AS top_corridor,
  {rnd('impact / (SELECT count(DISTINCT date) FROM unplanned_log)', 1)} AS exp_impact_per_day
FROM (SELECT gy, gx, {mean_coordinate('lat')} AS lat, {mean_coordinate('lon')} AS lon, count(*) AS n,
        {total('impact_min')} AS impact FROM unplanned_log GROUP BY gy, gx) b
JOIN {frequent('unplanned_log', 'gy, gx', 'cause')} c USING (gy, gx)
JOIN {frequent('unplanned_log', 'gy, gx', 'corridor')} d USING (gy, gx)"""
STEPS["dow_risk"] = "SELECT d.gy, d.gx, c.lat, c.lon, d.dow, d.exp_impact_per_day AS exp_impact FROM cell_dow d JOIN cell_table c USING (gy, gx)"
STEPS["day_sums"] = f"SELECT gy, gx, date, {total('impact_min')} AS y, count(*) AS n FROM unplanned_log GROUP BY gy, gx, date"
STEPS["day_span"] = "SELECT min(date) AS first, max(date) AS last FROM unplanned_log"


def panel(where: str) -> str:
    return f"""
SELECT gy, gx, d.date, lat, lon, hist_n, hist_impact, crit, coalesce(y, 0) AS y,
  CAST(isodow(d.date) - 1 AS INTEGER) AS dow, CAST(month(d.date) AS INTEGER) AS month,
  CAST(isodow(d.date) >= 6 AS INTEGER) AS is_weekend, hist_impact / hist_n AS hist_rate
FROM (SELECT gy, gx, {mean_coordinate('lat')} AS lat, {mean_coordinate('lon')} AS lon, count(*) AS hist_n,
        {total('impact_min')} AS hist_impact,
        CAST(sum(CAST(round_even(corridor_crit * 1e9::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1e9::DOUBLE AS crit
      FROM unplanned_log {where} GROUP BY gy, gx HAVING count(*) >= {S.PANEL_MIN_INCIDENTS})
CROSS JOIN (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date FROM day_span) d
LEFT JOIN day_sums s USING (gy, gx, date)"""


STEPS["panel_past"] = panel(f"WHERE date <= (SELECT last - {S.HOLDOUT_DAYS} FROM day_span)")
STEPS["panel_whole"] = panel("")
PANEL = f"""SELECT gy, gx, date, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon, hist_n, hist_impact,
  {rnd('crit', 6)} AS crit, y, dow, month, is_weekend, {rnd('hist_rate', 6)} AS hist_rate FROM """
STEPS["baseline_scores"] = f"""
SELECT p.gy, p.gx, p.date, p.y, coalesce(t.score, 0) AS score
FROM panel_past p LEFT JOIN (SELECT gy, gx, {total('y')} / count(*) AS score FROM panel_past
  WHERE date <= (SELECT last - {S.HOLDOUT_DAYS} FROM day_span) GROUP BY gy, gx) t USING (gy, gx)
WHERE p.date > (SELECT last - {S.HOLDOUT_DAYS} FROM day_span)"""


def captures(source: str, keys: str = "date") -> str:
    return f"""
SELECT {keys}, CAST(sum(y) FILTER (WHERE r <= greatest(1, floor({S.TOP_SHARE}::DOUBLE * cells))) AS DOUBLE) / CAST(sum(y) AS DOUBLE)
  AS capture
FROM (SELECT {keys}, CAST(round_even(y * 10, 0) AS BIGINT) AS y, count(*) OVER (PARTITION BY {keys}) AS cells,
        row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, gy, gx) AS r FROM {source})
GROUP BY {keys} HAVING sum(y) > 0"""


STEPS["baseline_captures"] = captures("baseline_scores")
STEPS["folds"] = f"""
SELECT fold, first + {S.WARMUP_DAYS} + {S.FOLD_DAYS} * fold AS start FROM (
  SELECT first, last, CAST(unnest(range(0, 1000)) AS INTEGER) AS fold FROM day_span)
WHERE first + {S.WARMUP_DAYS} + {S.FOLD_DAYS} * fold < last - {S.FOLD_DAYS}"""
STEPS["fold_scores"] = f"""
SELECT c.fold, c.train_days, c.gy, c.gx, d.date, c.score, coalesce(s.y, 0) AS y
FROM (SELECT f.fold, f.start, CAST({S.WARMUP_DAYS} + {S.FOLD_DAYS} * f.fold AS INTEGER) AS train_days, gy, gx,
        {total('y')} / ({S.WARMUP_DAYS} + {S.FOLD_DAYS} * f.fold) AS score
      FROM folds f JOIN day_sums s ON s.date < f.start GROUP BY f.fold, f.start, gy, gx HAVING sum(n) >= {S.PANEL_MIN_INCIDENTS}) c
JOIN (SELECT fold, start + CAST(unnest(range(0, {S.FOLD_DAYS})) AS INTEGER) AS date FROM folds) d ON d.fold = c.fold
LEFT JOIN day_sums s ON s.gy = c.gy AND s.gx = c.gx AND s.date = d.date
WHERE d.date <= (SELECT last FROM day_span)"""
STEPS["fold_captures"] = captures("fold_scores", "fold, train_days, date")
MEAN_CAPTURE = "CAST(sum(CAST(round_even(capture * 1e9::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1e9::DOUBLE"

# Network --------------------------------------------------------------------

STEPS["nodes"] = f"""
SELECT corridor, {mean_coordinate('lat')} AS lat, {mean_coordinate('lon')} AS lon, {total('impact_min')} AS load, count(*) AS n
FROM unplanned_log WHERE corridor <> '{S.NON_CORRIDOR}' GROUP BY corridor HAVING count(*) >= {S.NODE_MIN_INCIDENTS}"""
STEPS["node_log"] = "SELECT t_us, lat, lon, corridor FROM unplanned_log WHERE t_us IS NOT NULL AND corridor IN (SELECT corridor FROM nodes)"
STEPS["pair_counts"] = f"""
SELECT a.corridor AS src, b.corridor AS dst, count(*) AS count
FROM node_log a JOIN node_log b
  ON b.t_us >= a.t_us AND b.t_us < a.t_us + {(S.PAIR_WINDOW_SEC + 1) * 1000000}
WHERE b.t_us // 1000000 - a.t_us // 1000000 <= {S.PAIR_WINDOW_SEC} AND a.corridor <> b.corridor
  AND (b.t_us > a.t_us OR b.corridor > a.corridor) AND {km('a', 'b')} <= {S.SPILL_KM}
GROUP BY 1, 2"""
STEPS["edge_table"] = f"""
SELECT src, dst, count, {rnd('CAST(count AS DOUBLE) / CAST(src_total AS DOUBLE) / base', 2)} AS lift
FROM (SELECT src, dst, count, sum(count) OVER (PARTITION BY src) AS src_total FROM pair_counts)
JOIN (SELECT corridor AS dst, CAST(n AS DOUBLE) / (SELECT sum(n) FROM nodes) AS base FROM nodes) USING (dst)
WHERE count >= {S.EDGE_MIN_COUNT}"""
STEPS["blast_table"] = f"""
SELECT src, dst, CAST(r AS INTEGER) AS rank, lift FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY lift DESC, dst) AS r FROM edge_table WHERE lift > {S.BLAST_MIN_LIFT})
WHERE r <= {S.BLAST_TOP}"""
STEPS["diversion_table"] = f"""
SELECT src, dst, CAST(r AS INTEGER) AS rank, {rnd('km', 1)} AS km FROM (
  SELECT a.corridor AS src, b.corridor AS dst, {km('a', 'b')} AS km,
    row_number() OVER (PARTITION BY a.corridor ORDER BY {km('a', 'b')}, b.corridor) AS r
  FROM nodes a JOIN nodes b ON a.corridor <> b.corridor
  WHERE NOT EXISTS (SELECT 1 FROM blast_table x WHERE x.src = a.corridor AND x.dst = b.corridor))
WHERE r <= {S.DIVERSION_TOP} AND km < {S.DIVERSION_KM}"""
STEPS["cascades"] = f"""
SELECT n.corridor, n.load, coalesce(c.casc, 0) AS casc FROM nodes n LEFT JOIN (
  SELECT p.src, CAST(sum(CAST(round_even(p.count * (m.load / m.n) * 1e4::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / 1e4::DOUBLE AS casc
  FROM pair_counts p JOIN nodes m ON m.corridor = p.dst GROUP BY p.src) c ON c.src = n.corridor"""

# Bursts ---------------------------------------------------------------------

STEPS["cause_around"] = f"""
SELECT a.id, b.cause, count(*) AS n
FROM clean_log a JOIN clean_log b ON b.t_us >= a.t_us AND b.t_us < a.t_us + {(S.PAIR_WINDOW_SEC + 1) * 1000000}
WHERE b.t_us // 1000000 - a.t_us // 1000000 <= {S.PAIR_WINDOW_SEC} AND {km('a', 'b')} <= {S.BURST_KM}
GROUP BY a.id, b.cause"""
STEPS["around"] = f"""
SELECT id, CAST(sum(n) AS BIGINT) AS size, count(*) AS mix, max(n) AS dom_n,
  arg_min(cause, (-n, cause)) AS dom_cause, bool_or(cause IN ({values(S.LIVE_CAUSES)})) AS live
FROM (SELECT id, cause, CAST(n AS BIGINT) AS n FROM cause_around) GROUP BY id"""
QUALIFIES = f"""size >= {S.BURST_MIN_SIZE} AND NOT (CAST(dom_n AS DOUBLE) / size > 0.7 AND dom_cause IN ({values(S.PASSIVE_CAUSES)}))
  AND (live OR mix >= 3)"""
STEPS["flagged"] = f"SELECT * FROM around WHERE {QUALIFIES}"

# Barricades -----------------------------------------------------------------

STEPS["approaches"] = """
SELECT id, 0 AS kind, lat, lon, corridor, junction, cause, impact_min AS impact, event_type FROM enriched WHERE closure = 1
UNION ALL
SELECT id, 1, elat, elon, corridor, junction, cause, impact_min, event_type
FROM (SELECT *, TRY_CAST(endlatitude AS DOUBLE) AS elat, TRY_CAST(endlongitude AS DOUBLE) AS elon FROM enriched WHERE closure = 1)
WHERE elat IS NOT NULL AND elat <> 0 AND abs(elat - lat) + abs(elon - lon) > 1e-4"""
STEPS["zone_points"] = f"SELECT *, {cell(S.ZONE_GRID_DEG)} FROM approaches"
STEPS["zone_causes"] = """
SELECT gy, gx, cause, row_number() OVER (PARTITION BY gy, gx ORDER BY count(*) DESC, cause) AS r
FROM zone_points GROUP BY gy, gx, cause"""
STEPS["zones"] = f"""
SELECT b.*, c.corridor, j.junction, t.causes, t.first_cause,
  {rnd('approaches * ln(1 + impact)')} AS priority_score
FROM (SELECT gy, gx, {mean_coordinate('lat')} AS lat, {mean_coordinate('lon')} AS lon, count(*) AS approaches,
        {total('impact')} AS impact, count(*) FILTER (WHERE event_type = 'planned') AS planned
      FROM zone_points GROUP BY gy, gx) b
LEFT JOIN {frequent('zone_points', 'gy, gx', 'corridor')} c USING (gy, gx)
LEFT JOIN {frequent('zone_points', 'gy, gx', 'junction')} j USING (gy, gx)
LEFT JOIN (SELECT gy, gx, string_agg(cause, ', ' ORDER BY r) AS causes, min(cause) FILTER (WHERE r = 1) AS first_cause
           FROM zone_causes WHERE r <= 2 GROUP BY gy, gx) t USING (gy, gx)"""

# Loads ----------------------------------------------------------------------

STEPS["days"] = f"SELECT date, {total('impact_min')} AS impact, count(*) AS n FROM unplanned_log GROUP BY date"
STEPS["odd_days"] = f"""
SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS dow, impact, n,
  {rnd('(impact - avg(impact) OVER w) / stddev_samp(impact) OVER w', 2)} AS z
FROM days WINDOW w AS (PARTITION BY isodow(date)) ORDER BY z DESC NULLS LAST, date LIMIT 6"""

# Coverage -------------------------------------------------------------------


def greedy(name: str, cells: str, parts: str, order: str, units: int, minsep: float) -> None:
    """Steps ``name_1 .. name_units`` and ``name`` (all picks) of a greedy placement.

    ``cells`` gives ``parts, gy, gx, lat, lon, w`` and the order columns.
    """
    STEPS[f"{name}_cells"] = f"SELECT *, CAST(round_even(w * 1e6::DOUBLE, 0) AS BIGINT) AS wi FROM ({cells})"
    STEPS[f"{name}_near"] = f"""
SELECT a.gy AS gy_i, a.gx AS gx_i, b.gy AS gy_j, b.gx AS gx_j, {km('a', 'b')} AS km
FROM (SELECT DISTINCT gy, gx, lat, lon FROM {name}_cells) a, (SELECT DISTINCT gy, gx, lat, lon FROM {name}_cells) b
WHERE {km('a', 'b')} <= {max(S.REACH_KM, minsep)}"""
    for k in range(1, units + 1):
        earlier = " UNION ALL ".join(f"SELECT {parts}, gy, gx FROM {name}_{i}" for i in range(1, k)) or (
            f"SELECT {parts}, gy, gx FROM {name}_cells WHERE false"
        )
        match = " AND ".join(f"p.{c.strip()} = x.{c.strip()}" for c in parts.split(","))
        same = " AND ".join(f"j.{c.strip()} = i.{c.strip()}" for c in parts.split(","))
        order_i = ", ".join(f"i.{c.strip()}" for c in order.split(","))
        parts_i = ", ".join(f"i.{c.strip()}" for c in parts.split(","))
        STEPS[f"{name}_{k}"] = f"""
SELECT {parts}, gy, gx, lat, lon, gain, {k} AS k FROM (
  SELECT {parts_i}, i.gy, i.gx, i.lat, i.lon, CAST(sum(j.left_w) AS BIGINT) AS gain,
    row_number() OVER (PARTITION BY {parts_i} ORDER BY sum(j.left_w) DESC, {order_i}) AS r
  FROM {name}_cells i
  JOIN {name}_near e ON e.gy_i = i.gy AND e.gx_i = i.gx AND e.km <= {S.REACH_KM}
  JOIN (SELECT x.*, CASE WHEN EXISTS (SELECT 1 FROM ({earlier}) p JOIN {name}_near n ON n.gy_i = p.gy AND n.gx_i = p.gx
          WHERE {match} AND n.gy_j = x.gy AND n.gx_j = x.gx AND n.km <= {S.REACH_KM}) THEN 0 ELSE x.wi END AS left_w
        FROM {name}_cells x) j ON {same} AND j.gy = e.gy_j AND j.gx = e.gx_j
  WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) p JOIN {name}_near n ON n.gy_i = p.gy AND n.gx_i = p.gx
          WHERE {match.replace('x.', 'i.')} AND n.gy_j = i.gy AND n.gx_j = i.gx
            AND (n.km < {minsep} OR (p.gy = i.gy AND p.gx = i.gx)))
  GROUP BY {parts_i}, i.gy, i.gx, i.lat, i.lon, {order_i}) WHERE r = 1"""
    STEPS[name] = " UNION ALL ".join(f"SELECT * FROM {name}_{k}" for k in range(1, units + 1))


def coverage(name: str, parts: str, rounded: bool) -> str:
    gain = rnd("gain / 1e6::DOUBLE", 1) if rounded else "gain / 1e6::DOUBLE"
    return f"""{rnd(f'''100.0::DOUBLE * (CAST(sum(CAST(round_even({gain} * 1e6::DOUBLE, 0) AS BIGINT)) OVER (PARTITION BY {parts}
  ORDER BY k) AS DOUBLE) / 1e6::DOUBLE / ((SELECT CAST(sum(wi) AS DOUBLE) FROM {name}_cells t WHERE {" AND ".join(
        f"t.{c.strip()} = {name}.{c.strip()}" for c in parts.split(","))}) / 1e6::DOUBLE + 1e-9::DOUBLE))''', 1)}"""


greedy(
    "city", "SELECT 0 AS one, gy, gx, lat, lon, exp_impact_per_day AS w, -impact AS minus, top_corridor FROM cell_table "
    "WHERE exp_impact_per_day > 0", "one", "minus, gy, gx", S.UNITS, 0.0,
)
STEPS["busiest"] = f"SELECT dow FROM unplanned_log WHERE dow IS NOT NULL GROUP BY dow ORDER BY {total('impact_min')} DESC, dow LIMIT 1"
greedy(
    "busy", "SELECT 0 AS one, c.gy, c.gx, c.lat, c.lon, d.exp_impact_per_day AS w, -c.impact AS minus FROM cell_table c JOIN cell_dow d USING (gy, gx) "
    "WHERE d.exp_impact_per_day > 0 AND d.dow = (SELECT dow FROM busiest)", "one", "minus, gy, gx", S.UNITS, 0.0,
)
greedy(
    "curve", "SELECT 0 AS one, gy, gx, lat, lon, exp_impact_per_day AS w, -impact AS minus FROM cell_table "
    "WHERE exp_impact_per_day > 0", "one", "minus, gy, gx", S.CURVE_UNITS, S.CURVE_MINSEP_KM,
)
greedy(
    "week", "SELECT dow, gy, gx, lat, lon, exp_impact AS w FROM dow_risk WHERE exp_impact > 0", "dow", "gy, gx",
    S.UNITS, S.PLAN_MINSEP_KM,
)
STEPS["curve_report"] = f"""
SELECT CAST(k AS INTEGER) AS k, gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, {rnd('gain / 1e6::DOUBLE', 1)} AS covers,
  {coverage('curve', 'one', False)} AS cum_coverage_pct FROM curve"""
STEPS["week_report"] = f"""
SELECT dow, CAST(k AS INTEGER) AS k, gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, {rnd('gain / 1e6::DOUBLE', 1)} AS covers,
  {coverage('week', 'dow', True)} AS cum_coverage_pct FROM week"""
STEPS["scenarios"] = f"""
SELECT scenario_label AS name, {rnd(quantile('lat7', 0.5) + ' / 10000000.0::DOUBLE', 5)} AS lat,
  {rnd(quantile('lon7', 0.5) + ' / 10000000.0::DOUBLE', 5)} AS lon, {rnd(quantile('impact_min', 0.5))} AS bump, count(*) AS events,
  CAST(trunc({quantile('exp_clearance_min', 0.9)}) AS INTEGER) AS p90_hold
FROM (SELECT *, CAST(round_even(lat * 10000000, 0) AS BIGINT) AS lat7, CAST(round_even(lon * 10000000, 0) AS BIGINT) AS lon7
      FROM planned_log) WHERE scenario_label <> '{S.DEFAULT_SCENARIO}' GROUP BY scenario_label"""
STEPS["event_points"] = f"""
SELECT name AS scenario, lat, lon, bump FROM scenarios
UNION ALL SELECT {text(PIN[0])}, {PIN[1]}::DOUBLE, {PIN[2]}::DOUBLE, {PIN[3]}::DOUBLE"""


def bumps(cells: str) -> str:
    return f"""
SELECT scenario, gy, gx, bump FROM (
  SELECT e.scenario, c.gy, c.gx, e.bump, {km('c', 'e')} AS km,
    row_number() OVER (PARTITION BY e.scenario ORDER BY {km('c', 'e')}, c.lat, c.lon) AS r
  FROM {cells} c, event_points e)
WHERE km <= {S.EVENT_RADIUS_KM} OR (r = 1 AND km > {S.EVENT_RADIUS_KM})"""


STEPS["cell_bumps"] = bumps("cell_table")
STEPS["sweep_places"] = f"SELECT DISTINCT gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon FROM dow_risk"
STEPS["sweep_bumps"] = bumps("sweep_places")
greedy(
    "sweep",
    f"""SELECT s.scenario, d.dow, p.gy, p.gx, p.lat, p.lon, coalesce({rnd('r.exp_impact', 1)}, 0) + coalesce(b.bump, 0) AS w
    FROM sweep_places p, (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS dow) d,
      (SELECT 'base' AS scenario UNION ALL SELECT scenario FROM event_points) s
    LEFT JOIN dow_risk r ON r.gy = p.gy AND r.gx = p.gx AND r.dow = d.dow
    LEFT JOIN sweep_bumps b ON b.scenario = s.scenario AND b.gy = p.gy AND b.gx = p.gx""",
    "scenario, dow", "lat, lon, gy, gx", S.SWEEP_UNITS, S.PLAN_MINSEP_KM,
)
STEPS["sweep_report"] = f"""
SELECT scenario, dow, CAST(k AS INTEGER) AS k, gy, gx, {coverage('sweep', 'scenario, dow', False)} AS cum_coverage_pct FROM sweep"""

# Evaluation -----------------------------------------------------------------

STEPS["reached"] = f"""
SELECT i.*, EXISTS (SELECT 1 FROM week_report p WHERE p.dow = i.dow AND {km('i', 'p')} <= {S.REACH_KM}) AS reached
FROM unplanned_log i"""
STEPS["severe_limit"] = f"SELECT {quantile('impact_min', 0.75)} AS q FROM unplanned_log"
STEPS["zone_reach"] = f"""
SELECT zone, count(*) AS incidents, {rnd('100.0::DOUBLE * count(*) FILTER (WHERE reached) / count(*)', 1)} AS reached_pct,
  {total('impact_min')} AS impact FROM reached WHERE zone IS NOT NULL GROUP BY zone"""
STEPS["confidence_base"] = f"""
SELECT gy, gx, {mean_coordinate('lat')} AS lat, {mean_coordinate('lon')} AS lon, count(*) AS n,
  CAST(sum(clearance_censored) AS DOUBLE) / count(*) AS censored FROM unplanned_log GROUP BY gy, gx"""
STEPS["confidence_cells"] = f"""
SELECT *, {rnd('greatest(0.0::DOUBLE, least(1.0::DOUBLE, ln(1 + n) / ln(1 + (SELECT ' + quantile('n', 0.95) + ' FROM confidence_base)))) * (1.0::DOUBLE - 0.5::DOUBLE * censored) * 100.0::DOUBLE')}
  AS confidence FROM confidence_base"""
STEPS["clearance_log"] = f"SELECT * FROM enriched WHERE dur_trust_min < {S.MODEL_CLEARANCE_LIMIT_MIN}"
STEPS["life_log"] = f"""SELECT cause, dur_trust_us, least(coalesce(dur_trust_us, CAST(round(dur_raw_min * 60000000) AS BIGINT),
  (SELECT max(t_us) FROM enriched) - t_us), {S.TRUST_LIMIT_MIN * 60000000}) AS us FROM enriched"""
STEPS["life_counts"] = """SELECT cause, (us + 59999999) // 60000000 AS minute, count(dur_trust_us) AS cleared,
  count(*) - count(dur_trust_us) AS censored FROM life_log
WHERE coalesce(dur_trust_us, us) > 0 AND us > 0 GROUP BY cause, minute"""
STEPS["life_risk"] = """SELECT *, CAST(sum(cleared + censored) OVER (PARTITION BY cause ORDER BY minute DESC) AS BIGINT) AS at_risk FROM life_counts"""
STEPS["life_curve"] = f"""SELECT cause, minute, at_risk, cleared, censored, {rnd('product((at_risk - cleared)::DOUBLE / at_risk) OVER (PARTITION BY cause ORDER BY minute)', 6)} AS open_share
FROM life_risk"""
STEPS["clearance_split"] = f"SELECT max(t_us) - {S.HOLDOUT_DAYS * 86400000000} AS limit_us FROM clearance_log"
STEPS["train_median"] = f"""
SELECT {quantile('dur_trust_us', 0.5)} AS m FROM clearance_log WHERE t_us <= (SELECT limit_us FROM clearance_split)"""

HEIGHT = S.BURST_KM / KM_PER_DEGREE * BUCKET_MARGIN
FARTHEST = f"least(greatest(abs(sq_y - 1), abs(sq_y + 2)) * '{HEIGHT!r}'::DOUBLE, 89.9::DOUBLE)"
STEPS["window_causes"] = f"""
SELECT w, sq_y, CAST(floor(lon / ('{HEIGHT!r}'::DOUBLE / cos(radians({FARTHEST})))) AS BIGINT) - sx AS sq_x, cause, count(*) AS n FROM (
  SELECT cause, CAST(floor(t_us / 900000000.0::DOUBLE) AS BIGINT) * 900 - 900 * unnest(range(0, 6)) AS w,
    CAST(floor(lat / '{HEIGHT!r}'::DOUBLE) AS BIGINT) - sy AS sq_y, lon, sx
  FROM clean_log, (SELECT unnest([0, 1]) AS sy), (SELECT unnest([0, 1]) AS sx) WHERE t_us IS NOT NULL)
GROUP BY ALL"""
STEPS["window_squares"] = f"""
SELECT w, sq_y, sq_x, CAST(sum(n) AS BIGINT) AS size, count(*) AS mix, max(n) AS dom_n,
  arg_min(cause, (-n, cause)) AS dom_cause, bool_or(cause IN ({values(S.LIVE_CAUSES)})) AS live
FROM (SELECT w, sq_y, sq_x, cause, CAST(n AS BIGINT) AS n FROM window_causes) GROUP BY w, sq_y, sq_x"""
WINDOWS = f"""SELECT strftime(make_timestamp(w * 1000000), '%Y-%m-%d %H:%M') AS window_start,
  strftime(make_timestamp((w + 5400) * 1000000), '%Y-%m-%d %H:%M') AS window_end, sq_y, sq_x, size, mix, dom_cause
FROM window_squares WHERE {QUALIFIES}"""


def rounded(columns: str, source: str) -> str:
    """Select list where ``name:d`` rounds to ``d`` digits."""
    out = []
    for item in columns.split(","):
        name, _, digits = item.strip().partition(":")
        out.append(f"{rnd(name, int(digits))} AS {name}" if digits else name)
    return f"SELECT {', '.join(out)} FROM {source}"


MICROS = "CAST(floor(epoch_us({c}) / 1000000) AS BIGINT) AS {c}"
FINAL: dict[str, str] = {
    "scan_incidents": f"SELECT {', '.join(RAW_COLUMNS)} FROM raw_log",
    "null_tokens": f"SELECT {', '.join(RAW_COLUMNS)} FROM token_log",
    "geo_clean": "SELECT id, lat, lon FROM geo_log",
    "event_time": "SELECT id, " + ", ".join(
        MICROS.format(c=c) for c in ("t_start", "t_created", "t_modified", "t_closed", "t_resolved", "t_event")
    ) + " FROM time_log",
    "time_features": "SELECT id, dow, is_weekend, month, date FROM clean_log",
    "daypart": "SELECT id, daypart FROM clean_log",
    "clearance_censoring": "SELECT id, dur_raw_min, clearance_censored, dur_trust_min FROM clean_log",
    "normalise_categories": "SELECT id, event_type, cause, priority, closure, corridor, is_corridor FROM clean_log",
    "text_signal": "SELECT id, text_signal FROM clean_log",
    "severity": "SELECT id, severity FROM severity_log",
    "archetype": "SELECT id, report_label, calendar_label, scenario_label FROM planned_log",
    "urgency_tier": f"""SELECT id, cause, tier, {response('tier')} AS response FROM (
        SELECT id, cause, CASE WHEN event_type = 'planned' AND {label(S.CALENDAR_RULES, S.DEFAULT_ARCHETYPE)} IN ({values(S.GREEN_ARCHETYPES)})
          THEN 'green' ELSE {TIER} END AS tier FROM clean_log)""",
    "grid_cell": f"""SELECT id, gy, gx, CAST(round_even(lat / {S.ZONE_GRID_DEG}::DOUBLE, 0) AS INTEGER) AS zone_gy,
        CAST(round_even(lon / {S.ZONE_GRID_DEG}::DOUBLE, 0) AS INTEGER) AS zone_gx FROM (SELECT *, {cell()} FROM clean_log)""",
    "haversine_km": "SELECT id, " + rnd(
        km_of("lat", "lon", "TRY_CAST(endlatitude AS DOUBLE)", "TRY_CAST(endlongitude AS DOUBLE)"), 6
    ) + " AS km FROM clean_log",
    "approach_points": "SELECT id, kind, lat, lon, corridor, junction, cause, impact, event_type FROM approaches",
    "clearance_medians": f"SELECT CAST(level AS INTEGER) AS level, cause, priority, tier, {rnd('med_min', 4)} AS med_min, n FROM median_levels",
    "corridor_criticality": rounded("corridor, corridor_crit:8", "crit_table"),
    "hierarchical_lookup": rounded("id, exp_clearance_min:6", "enriched"),
    "dim_map": rounded("id, corridor, corridor_crit:8", "enriched"),
    "impact_min": "SELECT id, impact_min FROM enriched",
    "cell_dow_load": "SELECT gy, gx, dow, sum_impact, exp_impact_per_day FROM cell_dow",
    "risk_cells": rounded("gy, gx, lat:6, lon:6, n, impact, top_cause, top_corridor, exp_impact_per_day", "cell_table"),
    "hotspots": f"""SELECT gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, n,
        {rnd('impact / (SELECT count(DISTINCT date) FROM enriched)', 1)} AS per_day, top_cause AS cause, top_corridor AS corridor
        FROM cell_table ORDER BY impact DESC, gy, gx LIMIT 15""",
    "heat": f"""SELECT gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, {rnd('m', 1)} AS exp_impact FROM (
        SELECT gy, gx, lat, lon, CAST(sum(CAST(round_even(exp_impact * 1e6::DOUBLE, 0) AS BIGINT)) AS DOUBLE) / 1e6::DOUBLE / count(*) AS m
        FROM dow_risk GROUP BY gy, gx, lat, lon) WHERE m > 0""",
    "dow_vector": f"SELECT gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, " + ", ".join(
        f"coalesce(max(exp_impact) FILTER (WHERE dow = {d}), 0) AS w{d}" for d in range(7)
    ) + " FROM dow_risk GROUP BY gy, gx, lat, lon",
    "cell_date_panel": PANEL + "panel_past",
    "cell_date_panel_leaky": PANEL + "panel_whole",
    "planned_archetypes": f"""SELECT report_label AS archetype, count(*) AS events, {rnd(quantile('impact_min', 0.5), 4)} AS med_impact,
        CAST(sum(closure) AS BIGINT) AS closures, {rnd(quantile('exp_clearance_min', 0.5), 4)} AS med_clearance
        FROM planned_log GROUP BY report_label""",
    "planned_p90": f"""SELECT calendar_label AS archetype, count(*) AS events, {rnd(quantile('impact_min', 0.5), 4)} AS med_impact,
        {rnd(quantile('exp_clearance_min', 0.9))} AS p90_clear, CAST(sum(closure) AS BIGINT) AS closures
        FROM planned_log GROUP BY calendar_label""",
    "scenario_archetypes": "SELECT name, lat, lon, bump, events, p90_hold FROM scenarios",
    "calendar_uplift": f"""SELECT CAST(u.month AS INTEGER) AS month, CAST(u.day AS INTEGER) AS day, w.dow,
        coalesce(c.pct, 0) AS base_coverage, u.archetype, u.impact, u.hold_min
        FROM (SELECT month, day, calendar_label AS archetype, {total('impact_min')} AS impact,
                CAST(trunc({quantile('exp_clearance_min', 0.9)}) AS INTEGER) AS hold_min
              FROM planned_log GROUP BY month, day, calendar_label) u
        JOIN (SELECT DISTINCT month, day, dow FROM planned_log) w USING (month, day)
        LEFT JOIN (SELECT dow, max(cum_coverage_pct) AS pct FROM week_report GROUP BY dow) c ON c.dow = w.dow""",
    "corridor_nodes": rounded("corridor, lat:6, lon:6, load, n", "nodes"),
    "spillover_pairs": "SELECT src, dst, count FROM pair_counts",
    "spillover_edges": "SELECT src, dst, count, lift FROM edge_table",
    "top_edges": "SELECT src, dst, count, lift FROM edge_table ORDER BY lift DESC, src, dst LIMIT 12",
    "blast_radius": "SELECT src, dst, rank, lift FROM blast_table",
    "diversion": "SELECT src, dst, rank, km FROM diversion_table",
    "nearest_k": "SELECT src, dst, rank, km FROM diversion_table",
    "cascade_totals": f"""SELECT corridor, {rnd('load / 1000', 1)} AS direct, {rnd('casc / 1000', 1)} AS cascaded,
        {rnd('(load + casc) / 1000', 1)} AS total, CASE WHEN load <> 0 THEN {rnd('(load + casc) / load', 2)} ELSE 1.0 END AS amplify
        FROM cascades""",
    "burst_neighbours": "SELECT id, size, mix FROM around",
    "burst_score": f"SELECT id, size, mix, dom_cause, {rnd('CAST(dom_n AS DOUBLE) / size', 4)} AS dom_share FROM flagged",
    "burst_dedup": f"""SELECT id, strftime(t_event, '%Y-%m-%d %H:%M') AS started, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, size,
        corridor AS area, dom_cause AS cause, mix, substring(coalesce(description, ''), 1, 46) AS text FROM (
          SELECT *, row_number() OVER (PARTITION BY {rnd('lat', 2)}, {rnd('lon', 2)}, date ORDER BY size DESC, t_us, id) AS r
          FROM flagged JOIN clean_log USING (id)) WHERE r = 1 ORDER BY size DESC, t_us, id LIMIT 8""",
    "barricade_zones": rounded(
        "gy, gx, lat:6, lon:6, approaches, impact:1, corridor, junction, planned, causes, first_cause, priority_score", "zones"
    ),
    "barricade_plan": f"""SELECT gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, corridor, coalesce(junction, '(approach)') AS junction,
        causes, approaches, CAST(greatest(2, least(4, round_even(approaches / 2.0::DOUBLE, 0))) AS INTEGER) AS barricade_points,
        coalesce(via, 'local parallel street') AS divert_via, planned, {rnd('impact')} AS impact, tier, {response('tier')} AS response
        FROM (SELECT z.*, {TIER.replace('CASE cause', 'CASE first_cause')} AS tier FROM zones z ORDER BY priority_score DESC, gy, gx LIMIT 12)
        LEFT JOIN (SELECT src AS corridor, dst AS via FROM diversion_table WHERE rank = 1) USING (corridor)""",
    "daily_load": "SELECT date, impact, n FROM days",
    "dow_load": f"SELECT dow, {rnd(total('impact_min'))} AS impact FROM unplanned_log GROUP BY dow",
    "corridor_load": f"""SELECT corridor, {rnd('impact')} AS impact FROM (
        SELECT corridor, {total('impact_min')} AS impact FROM unplanned_log GROUP BY corridor ORDER BY impact DESC, corridor LIMIT 10)""",
    "abnormal_days": "SELECT date, dow, impact, n, z FROM odd_days",
    "abnormal_context": f"""SELECT o.date, o.z, CAST(trunc(o.impact) AS BIGINT) AS impact, coalesce(c.cause, '—') AS cause,
        substring(coalesce(e.description, ''), 1, 48) AS event
        FROM odd_days o LEFT JOIN {frequent('unplanned_log', 'date', 'cause')} c USING (date)
        LEFT JOIN (SELECT date, description FROM (SELECT date, description, row_number() OVER (PARTITION BY date ORDER BY t_us, id) AS r
          FROM planned_log WHERE description IS NOT NULL) WHERE r = 1) e USING (date)""",
    "summary_meta": f"""SELECT count(*) AS incidents, count(*) FILTER (WHERE event_type = 'planned') AS planned,
        count(*) FILTER (WHERE event_type = 'unplanned') AS unplanned, CAST(floor({total('impact_min')}) AS BIGINT) AS total_congestion_minutes,
        count(DISTINCT date) AS days, CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS "window",
        CAST(sum(clearance_censored) AS BIGINT) AS censored, count(dur_trust_min) AS trusted,
        {rnd('100.0::DOUBLE * sum(clearance_censored) / count(*)', 1)} AS censored_pct FROM enriched""",
    "cells_in_reach": f"""SELECT a.gy AS gy_i, a.gx AS gx_i, b.gy AS gy_j, b.gx AS gx_j, {rnd(km('a', 'b'), 6)} AS km
        FROM cell_table a, cell_table b WHERE {km('a', 'b')} <= {S.REACH_KM}""",
    "preposition": f"""SELECT CAST(k AS INTEGER) AS k, gy, gx, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon, anchor_corridor,
        {rnd('gain / 1e6::DOUBLE', 1)} AS covers, cum_coverage_pct
        FROM (SELECT city.*, {coverage('city', 'one', True)} AS cum_coverage_pct FROM city)
        JOIN (SELECT gy, gx, top_corridor AS anchor_corridor FROM cell_table) USING (gy, gx)""",
    "preposition_busiest": f"""SELECT CAST(k AS INTEGER) AS k, gy, gx, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon, anchor_corridor,
        {rnd('gain / 1e6::DOUBLE', 1)} AS covers, cum_coverage_pct, (SELECT dow FROM busiest) AS dow
        FROM (SELECT busy.*, {coverage('busy', 'one', True)} AS cum_coverage_pct FROM busy)
        JOIN (SELECT gy, gx, top_corridor AS anchor_corridor FROM cell_table) USING (gy, gx)""",
    "plan_for_date": f"""SELECT 'unit' AS kind, CAST(k AS VARCHAR) AS name, lat, lon, covers AS impact, CAST(NULL AS INTEGER) AS hold_min
        FROM week_report WHERE dow = 0
        UNION ALL SELECT 'uplift', calendar_label, NULL, NULL, {total('impact_min')}, CAST(trunc({quantile('exp_clearance_min', 0.9)}) AS INTEGER)
        FROM planned_log WHERE month = 1 AND day = 15 GROUP BY calendar_label""",
    "deploy_by_dow": "SELECT dow, k, gy, gx, lat, lon, covers, cum_coverage_pct FROM week_report",
    "coverage_curve": "SELECT k, gy, gx, lat, lon, covers, cum_coverage_pct FROM curve_report",
    "marginal_units": "SELECT " + ", ".join(
        f"coalesce(min(k) FILTER (WHERE cum_coverage_pct >= {p}), max(k)) AS u_for_{p}" for p in (50, 70, 80)
    ) + " FROM curve_report",
    "event_bump": "SELECT scenario, gy, gx, bump FROM cell_bumps",
    "scenario_sweep": f"""SELECT s.scenario, s.dow, s.k, s.gy, s.gx, s.cum_coverage_pct,
        {rnd('s.cum_coverage_pct - b.cum_coverage_pct', 1)} AS change_pct
        FROM sweep_report s JOIN sweep_report b ON b.scenario = 'base' AND b.dow = s.dow AND b.k = s.k WHERE s.k >= 2""",
    "reach": "SELECT id, CAST(reached AS INTEGER) AS reached FROM reached",
    "counterfactual": f"""SELECT {rnd('100.0::DOUBLE * hit / n', 1)} AS reach_pct, {rnd('total')} AS total_congestion_min,
        {rnd(f'hit_impact * {S.PREVENTABLE_SHARE}::DOUBLE')} AS prevented_congestion_min,
        {rnd(f'100.0::DOUBLE * (hit_impact * {S.PREVENTABLE_SHARE}::DOUBLE) / total', 1)} AS prevented_pct,
        {rnd('100.0::DOUBLE * sev_hit / sev', 1)} AS esc_reach_pct, {rnd(f'sev_impact * {S.PREVENTABLE_SHARE}::DOUBLE')} AS esc_prevented_min
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE reached) AS hit, {total('impact_min')} AS total,
          {total('CASE WHEN reached THEN impact_min ELSE 0 END')} AS hit_impact,
          count(*) FILTER (WHERE impact_min >= q) AS sev, count(*) FILTER (WHERE impact_min >= q AND reached) AS sev_hit,
          {total('CASE WHEN impact_min >= q AND reached THEN impact_min ELSE 0 END')} AS sev_impact FROM reached, severe_limit)""",
    "equity_by_zone": f"""SELECT zone, incidents, reached_pct, impact,
        CAST(row_number() OVER (ORDER BY reached_pct, zone) <= 3 AS INTEGER) AS worst_served,
        {rnd('max(reached_pct) OVER () - min(reached_pct) OVER ()', 1)} AS gap_pct FROM zone_reach""",
    "confidence_audit": f"""SELECT gy, gx, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, n AS incidents, CAST(confidence AS INTEGER) AS confidence,
        (SELECT count(*) FROM confidence_cells) AS n_cells,
        (SELECT CAST(trunc({quantile('confidence', 0.5)}) AS INTEGER) FROM confidence_cells) AS median_confidence
        FROM confidence_cells WHERE n >= 3 ORDER BY confidence, gy, gx LIMIT 8""",
    "capture_at_top": rounded("date, capture:6", "baseline_captures"),
    "cell_mean_baseline": f"SELECT {rnd('100.0::DOUBLE * (' + MEAN_CAPTURE + ')', 1)} AS capture_pct, count(*) AS days FROM baseline_captures",
    "walk_forward": f"""SELECT CAST(row_number() OVER (ORDER BY fold) AS INTEGER) AS week, capture, train_days FROM (
        SELECT fold, train_days, {rnd('100.0::DOUBLE * (' + MEAN_CAPTURE + ')', 1)} AS capture FROM fold_captures GROUP BY fold, train_days)""",
    "clearance_by_cause": f"""SELECT cause, count(*) AS n, {rnd(quantile('dur_trust_us', 0.5) + ' / 60000000.0::DOUBLE', 4)} AS p50_min,
        {rnd(quantile('dur_trust_us', 0.9) + ' / 60000000.0::DOUBLE', 4)} AS p90_min FROM clearance_log GROUP BY cause""",
    "survival_curve": "SELECT cause, minute, at_risk, cleared, censored, open_share FROM life_curve",
    "clearance_survival": f"""SELECT cause, CAST(sum(cleared + censored) AS BIGINT) AS n, CAST(sum(cleared) AS BIGINT) AS cleared,
        {rnd('CAST(sum(censored) AS DOUBLE) / sum(cleared + censored)', 4)} AS censored_share,
        min(minute) FILTER (WHERE open_share <= 0.5 + 1e-9) AS p50_min, min(minute) FILTER (WHERE open_share <= 0.1 + 1e-9) AS p90_min,
        min(open_share) AS open_share FROM life_curve GROUP BY cause""",
    "model_metrics": f"""SELECT count(*) AS test_rows, {rnd('max(m) / 60000000.0::DOUBLE', 4)} AS train_median_min,
        {rnd('CAST(sum(CAST(abs(dur_trust_us - m) * 2 AS BIGINT)) AS DOUBLE) / 2 / count(*) / 60000000.0::DOUBLE', 4)} AS baseline_mae
        FROM clearance_log, train_median WHERE t_us > (SELECT limit_us FROM clearance_split)""",
    "write_tables": """SELECT 'incidents_enriched' AS "table", count(*) AS "rows" FROM enriched
        UNION ALL SELECT 'risk_cells', count(*) FROM cell_table UNION ALL SELECT 'risk_cells_by_dow', count(*) FROM cell_dow
        UNION ALL SELECT 'planned_archetypes', count(DISTINCT report_label) FROM planned_log
        UNION ALL SELECT 'risk_by_dow', count(*) FROM dow_risk""",
    "stream_enrich": "SELECT id, date, dow, cause, text_signal, impact_min FROM enriched",
    "windowed_bursts": WINDOWS,
    "circle_bursts": f"""SELECT t_s, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, size, mix, dom_cause, dom_share FROM (
        SELECT DISTINCT CAST(floor(c.t_us / 1000000.0::DOUBLE) AS BIGINT) AS t_s, c.lat, c.lon, f.size, f.mix, f.dom_cause,
          {rnd('CAST(f.dom_n AS DOUBLE) / f.size', 4)} AS dom_share
        FROM (SELECT id, size, mix, dom_cause, dom_n FROM flagged) f JOIN clean_log c USING (id))
        WHERE t_s + {S.PAIR_WINDOW_SEC} + 1800 <= (SELECT floor(max(t_us) / 1000000.0::DOUBLE) FROM clean_log)""",
    "refit_enrich": "SELECT id, impact_min FROM enriched",
    "refit_lookups": f"""SELECT CAST(level AS INTEGER) AS level, cause, priority, tier, CAST(NULL AS VARCHAR) AS corridor, {rnd('med_min', 4)} AS "value"
        FROM median_levels UNION ALL SELECT NULL, NULL, NULL, NULL, corridor, {rnd('corridor_crit', 4)} FROM crit_table""",
    "stream_bursts": WINDOWS + " AND (w + 5400) * 1000000 <= (SELECT max(t_us) FROM clean_log) - 1800000000",
}


def compose(body: str) -> str:
    """Prefix a query with the steps it depends on, in order of definition."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in words & STEPS.keys() - needed:
            needed.add(name)
            queue.append(STEPS[name])
    steps = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in STEPS.items() if name in needed)
    return f"WITH {steps}\n{body}" if steps else body


ORACLE = {name: compose(body) for name, body in FINAL.items()}
