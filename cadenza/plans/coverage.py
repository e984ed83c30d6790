"""Queries of the general training-data operator (overlapping and gapped intervals)."""

from cadenza.operators.coverage import coverage_totals, speaking_periods
from cadenza.session import table

QUERIES = {
    "p1_found": lambda spark, d: speaking_periods(table(spark, d, "segment_entries")),
    "p1_totals": lambda spark, d: coverage_totals(speaking_periods(table(spark, d, "segment_entries"))),
}

_PERIODS = r"""
WITH latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY logged_at DESC NULLS LAST) AS rn FROM segment_entries)
  WHERE rn = 1 OR utterance_id IS NULL),
clean AS (
  SELECT recording_id, nullif(upper(regexp_replace(speaker_id, '^\s+|\s+$', '', 'g')), '') AS speaker_id,
         CAST(round(start_time * 100) AS BIGINT) AS s, CAST(round(end_time * 100) AS BIGINT) AS e
  FROM latest WHERE isfinite(start_time) AND isfinite(end_time)),
ok AS (SELECT * FROM clean WHERE recording_id IS NOT NULL AND speaker_id IS NOT NULL AND e > s),
seen AS (SELECT *, max(e) OVER (PARTITION BY recording_id, speaker_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ok),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, speaker_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM seen),
per AS (SELECT recording_id, speaker_id, min(s) AS start_cs, max(e) AS end_cs FROM isl GROUP BY recording_id, speaker_id, i),
found AS (
  SELECT recording_id, speaker_id, 'period' AS kind, start_cs, end_cs FROM per
  UNION ALL
  SELECT recording_id, speaker_id, 'gap', pe, start_cs FROM (
    SELECT *, lag(end_cs) OVER (PARTITION BY recording_id, speaker_id ORDER BY start_cs) AS pe FROM per) WHERE pe IS NOT NULL)
"""

ORACLE = {
    "p1_found": _PERIODS + "SELECT * FROM found",
    "p1_totals": _PERIODS + """
SELECT recording_id, speaker_id,
  CAST(count(*) FILTER (kind = 'period') AS BIGINT) AS n_periods,
  CAST(coalesce(sum(end_cs - start_cs) FILTER (kind = 'period'), 0) AS BIGINT) AS spoken_cs,
  CAST(count(*) FILTER (kind = 'gap') AS BIGINT) AS n_gaps,
  CAST(coalesce(sum(end_cs - start_cs) FILTER (kind = 'gap'), 0) AS BIGINT) AS silent_cs
FROM found GROUP BY recording_id, speaker_id""",
}
