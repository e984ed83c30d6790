"""Queries of the operators for training data, and their SQL."""

from cadenza.llm.clusters import density_clusters, enrolled, linked_groups
from cadenza.llm.leaks import leak_report, leaked_items
from cadenza.llm.neighbours import nearest_vectors, neighbour_pairs
from cadenza.llm.pieces import split_clips
from cadenza.llm.residue import residue_documents, windowed_residue, without_residue
from cadenza.llm.runs import collapse_runs, repeated_runs
from cadenza.llm.tokens import encode_texts
from cadenza.session import table

QUERIES = {
    "p2_found": lambda spark, d: repeated_runs(table(spark, d, "token_windows"), table(spark, d, "token_pieces")),
    "p2_collapsed": lambda spark, d: collapse_runs(table(spark, d, "token_windows"), table(spark, d, "token_pieces")),
    "p3_found": lambda spark, d: split_clips(table(spark, d, "clips"), table(spark, d, "vad_frames")),
    "p4_found": lambda spark, d: linked_groups(enrolled(table(spark, d, "speaker_params"))),
    "p4_clusters": lambda spark, d: density_clusters(enrolled(table(spark, d, "speaker_params"))),
    "p5_found": lambda spark, d: neighbour_pairs(nearest_vectors(table(spark, d, "speaker_params"))),
    "p6_ids": lambda spark, d: encode_texts(table(spark, d, "documents")),
    "p7_found": lambda spark, d: leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p7_report": lambda spark, d: leak_report(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p8_method": lambda spark, d: windowed_residue(table(spark, d, "documents")),
    "p8_found": lambda spark, d: residue_documents(table(spark, d, "documents")),
    "p8_kept": lambda spark, d: without_residue(table(spark, d, "documents")).select("doc_id"),
}

_RUNS = """
WITH tok AS (
  SELECT clip, chunk, pos, arg_max(token, decoded_at) AS token, arg_max(ts, decoded_at) AS ts FROM token_windows
  WHERE token IS NOT NULL AND ts IS NOT NULL AND clip IS NOT NULL AND chunk IS NOT NULL AND pos IS NOT NULL GROUP BY clip, chunk, pos),
pc AS (SELECT token, nfc_normalize(lower(nfc_normalize(piece))) AS p FROM token_pieces WHERE piece IS NOT NULL),
k AS (
  SELECT t.*, coalesce('p' || CASE WHEN ltrim(p, ' ▁') = '' THEN p ELSE ltrim(p, ' ▁') END, '#' || t.token) AS key
  FROM tok t LEFT JOIN pc USING (token)),
f AS (
  SELECT *, CASE WHEN key = lag(key) OVER w AND ts - lag(ts) OVER w <= 25 THEN 0 ELSE 1 END AS o FROM k
  WINDOW w AS (PARTITION BY clip ORDER BY ts, chunk, pos)),
r AS (SELECT *, sum(o) OVER (PARTITION BY clip ORDER BY ts, chunk, pos ROWS UNBOUNDED PRECEDING) AS run FROM f),
runs AS (
  SELECT clip, first(chunk ORDER BY ts, chunk, pos) AS chunk, first(pos ORDER BY ts, chunk, pos) AS pos,
         first(token ORDER BY ts, chunk, pos) AS token, min(ts) AS ts, CAST(count(*) AS INT) AS n_events, CAST(max(ts) - min(ts) AS INT) AS span_frames
  FROM r GROUP BY clip, run)
"""

ORACLE = {
    "p2_found": _RUNS + "SELECT clip, chunk, pos, n_events, span_frames FROM runs WHERE n_events > 1",
    "p2_collapsed": _RUNS + "SELECT * FROM runs",
    "p3_found": """
WITH RECURSIVE c AS (
  SELECT clip, total_samples AS total, overlap_seconds AS o FROM (
    SELECT *, row_number() OVER (PARTITION BY clip ORDER BY registered_at DESC NULLS LAST) AS rn FROM clips)
  WHERE rn = 1 AND total_samples > 240000),
cc AS (
  SELECT clip, total, CAST(floor(least(round(CASE WHEN o IS NULL OR isnan(o) THEN 2.0 ELSE o END * 16000), 120000) / 1280) * 1280 AS BIGINT) AS ov, coalesce(b, []) AS b
  FROM c LEFT JOIN (SELECT clip, list_sort(list_distinct(list(frame::BIGINT * 4096))) AS b FROM vad_frames WHERE prob < 0.3 GROUP BY clip) USING (clip)),
step AS (
  SELECT clip, total, ov, b, 0 AS piece_no, CAST(0 AS BIGINT) AS s,
    CASE WHEN total <= 240000 THEN total ELSE coalesce(list_max(list_filter(b, lambda x: x > 0 AND x <= 240000)), 240000) END AS e FROM cc
  UNION ALL
  SELECT clip, total, ov, b, piece_no + 1, e - ov,
    CASE WHEN total - (e - ov) <= 240000 THEN total ELSE coalesce(list_max(list_filter(b, lambda x: x > e AND x <= e - ov + 240000)), e - ov + 240000) END
  FROM step WHERE e < total)
SELECT clip, piece_no, s AS first_sample, e AS end_sample FROM step""",
}
