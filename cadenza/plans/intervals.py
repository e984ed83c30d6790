"""Queries of the interval algebra, on utterances in hundredths of a second."""

from pyspark.sql import functions as F

from cadenza.operators import intervals as I
from cadenza.session import table


def segments(spark, d):
    return I.clean_segments(table(spark, d, "segment_entries"))


def hypothesis(spark, d):
    """A made-up system output: seven hundredths late, speakers of one last digit taken for one."""
    return segments(spark, d).select("rec", F.concat(F.lit("H"), F.substring("spk", -1, 1)).alias("hyp"), (F.col("s") + 7).alias("s"), (F.col("e") + 7).alias("e"))


def minutes(spark, d):
    """Windows of 20 s in every minute of a recording."""
    ends = segments(spark, d).groupBy("rec").agg(F.max("e").alias("m"))
    return ends.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(6000).cast("long"))).alias("s")).withColumn("e", F.col("s") + 2000)


def domain(spark, d):
    return segments(spark, d).groupBy("rec").agg(F.lit(0).cast("long").alias("s"), F.max("e").alias("e"))


def frames(spark, d):
    f = table(spark, d, "vad_frames").filter("clip IS NOT NULL AND frame IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob)")
    return f.groupBy("clip", "frame").agg(F.max("prob").alias("prob"))


QUERIES = {
    "interval_merge": lambda s, d: I.merged(segments(s, d), ["rec", "spk"]),
    "interval_union_length": lambda s, d: I.union_length(segments(s, d), ["rec"]),
    "interval_clip": lambda s, d: I.clip(segments(s, d), minutes(s, d), ["rec"]),
    "interval_subtract": lambda s, d: I.subtract(domain(s, d), segments(s, d), ["rec"]),
    "interval_overlap_by_pair": lambda s, d: I.overlap_length(
        I.merged(segments(s, d), ["rec", "spk"]), I.merged(hypothesis(s, d), ["rec", "hyp"]), ["rec"], ["rec", "spk", "hyp"]),
    "interval_overlap_total": lambda s, d: I.overlap_length(
        I.merged(segments(s, d), ["rec"]), I.merged(hypothesis(s, d), ["rec"]), ["rec"], ["rec"]),
    "sweep_single_speaker": lambda s, d: I.single_speaker(segments(s, d)),
    "sweep_overlapped": lambda s, d: I.overlapped(segments(s, d)),
    "collar_trim": lambda s, d: I.collar_trim(segments(s, d), 25)[0],
    "collar_zones": lambda s, d: I.collar_trim(segments(s, d), 25)[1],
    "gap_merge_per_speaker": lambda s, d: I.bridge_gaps(segments(s, d), ["rec", "spk"], 50),
    "gap_merge_in_order": lambda s, d: I.bridge_same_speaker(segments(s, d), 50),
    "quantised_union": lambda s, d: I.quantised_union(segments(s, d), 8),
    "exclude_overlaps": lambda s, d: I.without_overlap(segments(s, d), 30),
    "runs_of_predicate": lambda s, d: I.runs(frames(s, d), ["clip"], "frame", F.col("prob") >= 0.5),
    "majority_filter": lambda s, d: I.majority(frames(s, d), ["clip"], "frame", F.col("prob") >= 0.5, 2).select("clip", "frame", "on"),
}

SEG = r"""
WITH RECURSIVE seg_latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY logged_at DESC NULLS LAST) AS rn FROM segment_entries) WHERE rn = 1),
seg_raw AS (
  SELECT recording_id AS rec, nullif(upper(regexp_replace(speaker_id, '^\s+|\s+$', '', 'g')), '') AS spk,
         CAST(round(start_time * 100) AS BIGINT) AS s, CAST(round(end_time * 100) AS BIGINT) AS e
  FROM seg_latest WHERE isfinite(start_time) AND isfinite(end_time)),
seg AS (SELECT * FROM seg_raw WHERE rec IS NOT NULL AND spk IS NOT NULL AND e > s),
hyp AS (SELECT rec, 'H' || right(spk, 1) AS hyp, s + 7 AS s, e + 7 AS e FROM seg)
"""


def merge_sql(name, source, keys, gap=0):
    k = ", ".join(keys)
    return f"""
{name}_a AS (SELECT {k}, s, e, max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {name}_a),
{name} AS (SELECT {k}, min(s) AS s, max(e) AS e FROM {name}_b GROUP BY {k}, i)"""


FRAMES = "frames AS (SELECT clip, frame, max(prob) AS prob FROM vad_frames WHERE clip IS NOT NULL AND frame IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) GROUP BY clip, frame)"

_SLICES = f"""{merge_sql('ms', 'seg', ['rec', 'spk'])},
pts AS (SELECT DISTINCT rec, t FROM (SELECT rec, s AS t FROM ms UNION ALL SELECT rec, e FROM ms)),
sl AS (SELECT rec, t AS s, lead(t) OVER (PARTITION BY rec ORDER BY t) AS e FROM pts),
act AS (SELECT sl.rec, sl.s, sl.e, count(*) AS n, min(spk) AS spk FROM sl JOIN ms ON ms.rec = sl.rec AND ms.s <= sl.s AND ms.e >= sl.e WHERE sl.e IS NOT NULL GROUP BY ALL)"""

ORACLE = {
    "interval_merge": f"{SEG}, {merge_sql('m', 'seg', ['rec', 'spk'])} SELECT * FROM m",
    "interval_union_length": f"{SEG}, {merge_sql('m', 'seg', ['rec'])} SELECT rec, CAST(sum(e - s) AS BIGINT) AS covered FROM m GROUP BY rec",
    "interval_clip": f"""{SEG}, mins AS (SELECT rec, unnest(generate_series(0, max(e), 6000)) AS s FROM seg GROUP BY rec)
SELECT seg.rec, seg.spk, greatest(seg.s, m.s) AS s, least(seg.e, m.s + 2000) AS e FROM seg JOIN mins m ON seg.rec = m.rec AND seg.s < m.s + 2000 AND m.s < seg.e""",
    "interval_subtract": f"""{SEG}, {merge_sql('m', 'seg', ['rec'])}, d AS (SELECT rec, max(e) AS z FROM seg GROUP BY rec),
g AS (SELECT rec, coalesce(lag(e) OVER (PARTITION BY rec ORDER BY s), 0) AS s, s AS e FROM m WHERE e > 0)
SELECT rec, greatest(s, 0) AS s, e FROM g WHERE e > greatest(s, 0)""",
    "interval_overlap_by_pair": f"""{SEG}, {merge_sql('a', 'seg', ['rec', 'spk'])}, {merge_sql('b', 'hyp', ['rec', 'hyp'])}
SELECT a.rec, spk, hyp, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap FROM a JOIN b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e GROUP BY ALL""",
    "interval_overlap_total": f"""{SEG}, {merge_sql('a', 'seg', ['rec'])}, {merge_sql('b', 'hyp', ['rec'])}
SELECT a.rec, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap FROM a JOIN b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e GROUP BY ALL""",
    "sweep_single_speaker": f"{SEG}, {_SLICES}, one AS (SELECT rec, spk, s, e FROM act WHERE n = 1), {merge_sql('o', 'one', ['rec', 'spk'])} SELECT * FROM o",
    "sweep_overlapped": f"{SEG}, {_SLICES}, two AS (SELECT rec, s, e FROM act WHERE n > 1), {merge_sql('o', 'two', ['rec'])} SELECT * FROM o",
    "collar_trim": f"{SEG} SELECT rec, spk, s + 25 AS s, e - 25 AS e FROM seg WHERE e - s > 50",
    "collar_zones": f"{SEG}, z AS (SELECT rec, s - 25 AS s, s + 25 AS e FROM seg UNION ALL SELECT rec, e - 25, e + 25 FROM seg), {merge_sql('m', 'z', ['rec'])} SELECT * FROM m",
    "gap_merge_per_speaker": f"{SEG}, {merge_sql('m', 'seg', ['rec', 'spk'], 50)} SELECT * FROM m",
    "gap_merge_in_order": f"""{SEG}, a AS (SELECT *, CASE WHEN lag(spk) OVER w = spk THEN 0 ELSE 1 END AS x FROM seg WINDOW w AS (PARTITION BY rec ORDER BY s, e, spk)),
b AS (SELECT *, sum(x) OVER (PARTITION BY rec ORDER BY s, e, spk ROWS UNBOUNDED PRECEDING) AS turn FROM a),
c AS (SELECT *, max(e) OVER (PARTITION BY rec, turn ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
f AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rec, turn ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM c)
SELECT rec, spk, min(s) AS s, max(e) AS e, count(*) AS parts FROM f GROUP BY rec, turn, part, spk""",
    "quantised_union": f"""{SEG}, q AS (SELECT rec, spk, CAST(round_even(s / 8.0, 0) AS BIGINT) AS s, CAST(round_even(e / 8.0, 0) AS BIGINT) AS e FROM seg), q2 AS (SELECT * FROM q WHERE e > s),
{merge_sql('m', 'q2', ['rec', 'spk'])} SELECT rec, spk, s AS first, e AS last FROM m""",
    "exclude_overlaps": f"""{SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, e, spk) AS i FROM seg),
f AS (SELECT rec, i, spk, s, e, s AS ns, e - s >= 30 AS kept, CASE WHEN e - s >= 30 THEN e ELSE -1152921504606846976 END AS z FROM n WHERE i = 1
  UNION ALL SELECT n.rec, n.i, n.spk, n.s, n.e, greatest(n.s, f.z), n.e - greatest(n.s, f.z) >= 30, CASE WHEN n.e - greatest(n.s, f.z) >= 30 THEN n.e ELSE f.z END FROM f JOIN n ON n.rec = f.rec AND n.i = f.i + 1)
SELECT rec, spk, ns AS s, e, (e - ns) / (e - s) AS share FROM f WHERE kept""",
    "runs_of_predicate": f"""WITH {FRAMES}, o AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM frames WHERE prob >= 0.5)
SELECT clip, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) + 1 AS BIGINT) AS last FROM o GROUP BY clip, g""",
    "majority_filter": f"""WITH {FRAMES} SELECT clip, frame, 2 * count(*) FILTER (prob >= 0.5) OVER w >= count(*) OVER w AS "on" FROM frames
WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
}
