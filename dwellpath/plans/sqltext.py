"""DuckDB SQL of the queries: named steps that are put before a final SELECT as needed."""

from __future__ import annotations

import re

from dwellpath.plans import fixtures

HOUR = 3_600_000_000


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL OR {c} IS NULL THEN NULL ELSE 12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END)"
    )


def spheroid(a: str, b: str, c: str, d: str) -> str:
    f = "(1 / 298.257223563::DOUBLE)"
    b1, b2 = f"atan((1 - {f}) * tan(radians({a})))", f"atan((1 - {f}) * tan(radians({c})))"
    s = f"(2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * pow(sin(radians({d} - {b}) / 2), 2)))))"
    p, q = f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    return (
        f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} = 0 THEN 0 ELSE 6378137.0::DOUBLE * ({s} - {f} / 2 * (({s} - sin({s})) * pow(sin({p}) * cos({q}) / cos({s} / 2), 2) + ({s} + sin({s})) * pow(cos({p}) * sin({q}) / sin({s} / 2), 2))) END)"
    )


def us(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b})"


def active(source: str, ranges: str, day: str, key: str, prefix: str) -> str:
    """``source`` with the columns of the anchor active on ``day``."""
    return f"""
SELECT s.*, r.lat AS {prefix}_lat, r.lon AS {prefix}_lon, r.place_id AS {prefix}_place, r.name AS {prefix}_name
FROM {source} s LEFT JOIN (
  SELECT s.subject_id, s.{key}, r.lat, r.lon, r.place_id, r.name
  FROM {source} s JOIN {ranges} r ON s.subject_id = r.subject_id AND (r.start_date IS NULL OR r.start_date <= {day}) AND (r.end_date IS NULL OR r.end_date >= {day})
  QUALIFY row_number() OVER (PARTITION BY s.subject_id, s.{key} ORDER BY coalesce(r.start_date, DATE '0001-01-01') DESC, r.pos) = 1
) r ON s.subject_id = r.subject_id AND s.{key} = r.{key}"""


STEPS: dict[str, str] = {
    **fixtures.SQL,
    "home_now": active("visits", "homes", "CAST(s.start_time AS DATE)", "id", "home"),
    "both_now": active("home_now", "works", "CAST(s.start_time AS DATE)", "id", "work"),
    "classified": f"""
SELECT *, NOT (at_home OR at_work) AS away FROM (
  SELECT *, coalesce({hav('lat', 'lon', 'home_lat', 'home_lon')} <= 20, false) AS at_home,
    coalesce(place_id = work_place, false) OR coalesce({hav('lat', 'lon', 'work_lat', 'work_lon')} <= 1, false) AS at_work FROM both_now)""",
    "gaps": f"""
SELECT *, {us('prev_end_time', 'start_time')} AS gap_us FROM (
  SELECT *, row_number() OVER w AS rn, lag(id) OVER w AS prev_id, lag(end_time) OVER w AS prev_end_time, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon, lag(away) OVER w AS prev_away, lag(local_end_ts) OVER w AS prev_local_end_ts
  FROM classified WINDOW w AS (PARTITION BY subject_id ORDER BY start_time, id))""",
    "bridges": """
SELECT DISTINCT g.subject_id, g.id FROM gaps g JOIN movements m ON g.subject_id = m.subject_id
  AND m.start_time BETWEEN g.prev_end_time - INTERVAL 5 MINUTE AND g.prev_end_time + INTERVAL 5 MINUTE
  AND m.end_time BETWEEN g.start_time - INTERVAL 5 MINUTE AND g.start_time + INTERVAL 5 MINUTE""",
    "gap_home": active("gaps", "homes", "CAST(s.prev_end_time AS DATE)", "id", "gap_home"),
    "splits": f"""
SELECT g.*, CASE WHEN g.prev_id IS NULL OR b.id IS NOT NULL THEN false WHEN gap_us < {8 * HOUR} THEN false
  WHEN gap_us < {24 * HOUR} AND coalesce({hav('prev_lat', 'prev_lon', 'gap_home_lat', 'gap_home_lon')} >= 80, false) AND coalesce({hav('lat', 'lon', 'gap_home_lat', 'gap_home_lon')} >= 80, false) THEN false
  ELSE true END AS split
FROM gap_home g LEFT JOIN bridges b ON g.subject_id = b.subject_id AND g.id = b.id""",
    "blocks": f"""
SELECT * FROM (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS block,
    CASE WHEN starts AND NOT prev_away AND gap_us <= {8 * HOUR} THEN prev_end_time END AS departed,
    CASE WHEN NOT next_away AND {us('end_time', 'next_start')} <= {8 * HOUR} THEN next_start END AS returned,
    CASE WHEN starts AND NOT prev_away AND gap_us <= {8 * HOUR} THEN prev_local_end_ts END AS departed_local, CASE WHEN NOT next_away AND {us('end_time', 'next_start')} <= {8 * HOUR} THEN next_local END AS returned_local
  FROM (SELECT *, away AND (prev_away IS NULL OR NOT prev_away OR split) AS starts,
      lead(away) OVER w AS next_away, lead(start_time) OVER w AS next_start, lead(local_start_ts) OVER w AS next_local FROM splits WINDOW w AS (PARTITION BY subject_id ORDER BY start_time, id))
) WHERE away""",
    "bounds": """
SELECT subject_id, CAST(block AS BIGINT) AS block, coalesce(first(departed ORDER BY start_time, id), min(start_time)) AS start_time, coalesce(last(returned ORDER BY start_time, id), max(end_time)) AS end_time,
  CASE WHEN first(departed ORDER BY start_time, id) IS NOT NULL THEN first(departed_local ORDER BY start_time, id) ELSE first(local_start_ts ORDER BY start_time, id) END AS local_start_ts,
  CASE WHEN last(returned ORDER BY start_time, id) IS NOT NULL THEN last(returned_local ORDER BY start_time, id) ELSE first(local_end_ts ORDER BY end_time DESC, start_time, id) END AS local_end_ts,
  avg(lat) AS lat, avg(lon) AS lon, count(*) AS n_visits, list(id ORDER BY start_time, id) AS visit_ids FROM blocks GROUP BY subject_id, block""",
    "bound_home": active("bounds", "homes", "CAST(s.start_time AS DATE)", "block", "home"),
    "far_trips": f"SELECT * FROM (SELECT *, {hav('lat', 'lon', 'home_lat', 'home_lon')} AS distance_km FROM bound_home) WHERE distance_km IS NULL OR distance_km >= 80",
    "trip_rows": f"""
SELECT *, concat_ws('-', subject_id, epoch_us(start_time), epoch_us(end_time)) AS trip_id FROM (
  SELECT *, CASE WHEN hours >= 4 AND hours < 16 THEN 'Day Trip' WHEN hours >= 16 AND hours < 96 THEN 'Short Trip' WHEN hours >= 96 THEN 'Long Trip' END AS category
  FROM (SELECT *, {us('start_time', 'end_time')} / {HOUR}.0::DOUBLE AS hours FROM far_trips)
) WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id, start_time, end_time ORDER BY block) = 1""",
    "bridge": "SELECT trip_id, subject_id, unnest(visit_ids) AS visit_id FROM trip_rows",
}


def sql(final: str) -> str:
    """``final`` with the steps it needs, each before its first use."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(STEPS[name])
                if name not in need:
                    need.append(name)

    visit(final)
    head = ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in need)
    return f"WITH {head}\n{final}" if need else final
