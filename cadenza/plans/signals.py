"""Queries of segments, timings and chunk plans."""

from pyspark.sql import functions as F

from cadenza.operators import sessions as S, timing as T
from cadenza.operators.coverage import latest_by
from cadenza.operators.intervals import merged
from cadenza.operators.sharded import running_sum
from cadenza.plans.evaluation import rounded
from cadenza.plans.intervals import FRAMES, SEG, frames, merge_sql, segments
from cadenza.session import table


def tokens(s, d):
    t = table(s, d, "token_windows").filter("token IS NOT NULL AND ts IS NOT NULL")
    return t.groupBy("clip", "chunk", "pos").agg(F.max(F.struct("decoded_at", "token", "ts", F.col("conf").cast("double").alias("conf"), "dur")).alias("b")).select("clip", "chunk", "pos", "b.token", "b.ts", "b.conf", "b.dur")


def pieces(s, d):
    return tokens(s, d).join(table(s, d, "token_pieces"), "token", "left")


def clips(s, d):
    c = latest_by(table(s, d, "clips"), "clip", "registered_at", ["clip", "total_samples"])
    return c.filter("total_samples IS NOT NULL").select("clip", F.col("total_samples").cast("long").alias("total"))


def activity(s, d):
    """Share of each second in which a speaker talks."""
    own = merged(segments(s, d), ["rec", "spk"])
    x = own.select("rec", "spk", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / 100), F.floor((F.col("e") - 1) / 100))).alias("frame"))
    part = F.least("e", (F.col("frame") + 1) * 100) - F.greatest("s", F.col("frame") * 100)
    return x.groupBy("rec", "spk", "frame").agg((F.sum(part) / 100).alias("activity"))


def numbered(s, d):
    x = pieces(s, d).withColumn("h", F.floor(F.col("ts") / 4096))
    return running_sum(x, ["clip"], "h", ["ts", "chunk", "pos"], F.lit(1), "n").withColumn("n", F.col("n").cast("int"))


QUERIES = {
    "schmitt_segments": lambda s, d: S.hysteresis_segments(frames(s, d), ["clip"], "frame", "prob", 0.7, 0.4),
    "onset_offset_timeline": lambda s, d: S.timeline(frames(s, d), ["clip"], "frame", "prob", 0.7, 0.4, 1, 1, 2, 2),
    "timeline_final": lambda s, d: S.split_timeline(
        S.timeline(frames(s, d), ["clip"], "frame", "prob", 0.7, 0.4, 1, 1, 2, 2).join(frames(s, d).groupBy("clip").agg((F.max("frame") + 1).alias("end")), "clip"), ["clip"], F.col("end"), 4).select("clip", "first", "last", "final"),
    "crowd_aware_threshold": lambda s, d: S.crowd_aware(activity(s, d), "rec", "spk", "frame", "activity"),
    "top_speakers_per_frame": lambda s, d: rounded(S.top_per_frame(activity(s, d).withColumn("n", F.lit(1.0)), "rec", "frame", "spk", "activity", "n"), 8),
    "powerset_decode": lambda s, d: table(s, d, "embeddings").select("vec_id", F.array_join(S.powerset_speakers(
        F.slice("embedding", 1, 7), [[], [0], [1], [2], [0, 1], [0, 2], [1, 2]]).cast("array<string>"), ",").alias("speakers")),
    "vad_segments": lambda s, d: S.vad_segments(table(s, d, "vad_frames")),
    "chunk_starts": lambda s, d: T.regular_chunks(clips(s, d), "clip", "total", 208_000),
    "hop_windows": lambda s, d: T.hops(clips(s, d), "clip", "total", 160_000, 32_000),
    "context_windows": lambda s, d: T.context_windows(clips(s, d), "clip", "total", 160_000, 128_000, 32_000),
    "silence_aligned_starts": lambda s, d: T.silence_aligned_starts(
        clips(s, d), frames(s, d).select("clip", F.explode(F.sequence(F.ceil(F.col("frame") * 4096 / 1280), F.ceil((F.col("frame") + 1) * 4096 / 1280) - 1)).alias("frame"), F.col("prob").alias("value")), 208_000, 240_000),
    "token_timings": lambda s, d: rounded(T.token_times(tokens(s, d), ["clip"]).select("clip", "chunk", "pos", "s", "e")),
    "prefix_sum_timing": lambda s, d: rounded(T.prefix_times(tokens(s, d), ["clip"], ["chunk", "pos"], "dur", 0.0125).select("clip", "chunk", "pos", "s", "e")),
    "word_assembly": lambda s, d: rounded(T.words(T.token_times(pieces(s, d), ["clip"]), ["clip"], ["ts", "chunk", "pos"])),
    "ctc_collapse": lambda s, d: T.collapse_repeats(tokens(s, d).withColumn("label", F.col("token") % 8), ["clip"], ["ts", "chunk", "pos"], "label", 0).select("clip", "chunk", "pos", "label"),
    "seam_word_collapse": lambda s, d: T.drop_seam_words(numbered(s, d).select("clip", "n", "piece", "ts"), 25),
}

TOK = """tok AS (SELECT clip, chunk, pos, unnest(max({'d': decoded_at, 'token': token, 'ts': ts, 'conf': CAST(conf AS DOUBLE), 'dur': dur})) FROM token_windows WHERE token IS NOT NULL AND ts IS NOT NULL GROUP BY clip, chunk, pos)"""
CLIPS = "cl AS (SELECT clip, total_samples AS total FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY registered_at DESC) AS rn FROM clips) WHERE rn = 1 AND total_samples IS NOT NULL)"
_ON = """st AS (SELECT clip, frame, last_value(CASE WHEN prob > 0.7 THEN 1 WHEN prob < 0.4 THEN 0 END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING) AS o FROM frames),
rn AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM st WHERE o = 1),
runs AS (SELECT clip, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) + 1 AS BIGINT) AS last FROM rn GROUP BY clip, g)"""
_LINE = f"{_ON}, padded AS (SELECT clip, first - 1 AS s, last + 1 AS e FROM runs WHERE last - first + 2 >= 4), {merge_sql('m', 'padded', ['clip'], 2)}"
_ACT = f"""{merge_sql('m', 'seg', ['rec', 'spk'])}, fr AS (SELECT rec, spk, s, e, unnest(generate_series(s // 100, (e - 1) // 100)) AS frame FROM m),
act AS (SELECT rec, spk, frame, sum(least(e, (frame + 1) * 100) - greatest(s, frame * 100)) / 100 AS activity FROM fr GROUP BY rec, spk, frame)"""
_TIMES = f"""{TOK}, tt AS (SELECT *, greatest(0, ts - 1) AS a, greatest(0, lead(ts) OVER w - 1) AS nx FROM tok WINDOW w AS (PARTITION BY clip ORDER BY ts, chunk, pos)),
tm AS (SELECT *, a * 0.08::DOUBLE AS s, (CASE WHEN dur > 0 THEN a + dur ELSE greatest(coalesce(nx, a + 1), a + 1) END) * 0.08::DOUBLE AS e FROM tt)"""

#: Quietest frame near a target (its energy, itself) and the upper median there, in seconds around it.
_NEAR = """(SELECT {{'v': min(value), 'f': arg_min(frame, (value, frame)), 'm': list_sort(list(value))[1 + count(*) // 2]}} FROM lv WHERE lv.clip = st.clip
    AND frame BETWEEN greatest(1, st.target // 1280 - {r}) AND least((st.total - 1) // 1280, st.target // 1280 + {r}) AND frame * 1280 > st.start AND frame * 1280 <= st.start + 232320)"""
_STARTS = f"""WITH RECURSIVE {CLIPS}, {FRAMES}, lv AS (SELECT clip, unnest(generate_series(CAST(ceil(frame * 4096 / 1280) AS BIGINT), CAST(ceil((frame + 1) * 4096 / 1280) AS BIGINT) - 1)) AS frame, prob AS value FROM frames),
st AS (
  SELECT clip, total, 0 AS chunk, CAST(0 AS BIGINT) AS start, CAST(208000 AS BIGINT) AS target FROM cl
  UNION ALL
  SELECT clip, total, chunk + 1, CAST(CASE WHEN s > start THEN s ELSE least(start + 208000, total) END AS BIGINT), target + 208000 FROM (
    SELECT *, CASE WHEN w.v <= 0.05 * greatest(0, w.m) THEN w.f * 1280 WHEN n.v <= 0.35 * greatest(0, n.m) THEN n.f * 1280
      ELSE least(greatest(target // 1280 * 1280, start + 1280), start + 232320) END AS s
    FROM (SELECT st.*, {_NEAR.format(r=50)} AS w, {_NEAR.format(r=6)} AS n FROM st WHERE st.target < st.total)))
SELECT clip, chunk, start FROM st"""

_VAD = S.VadConfig()
_UP, _DOWN = _VAD.thresholds()
_MOST = max(0, int(_VAD.max_speech * S.RATE) - S.FRAME - 2 * int(_VAD.pad * S.RATE)) if _VAD.max_speech != float("inf") else 2**60
_PAD = int(_VAD.pad * S.RATE)
#: The state machine as a recursion over a clip's frames: begin of open speech, begin and least value of the silence under way, pauses so far.
_SPEECH = f"""WITH RECURSIVE f AS (SELECT clip, frame, max(CASE WHEN isnan(prob) THEN 0 ELSE prob END) AS prob FROM vad_frames WHERE clip IS NOT NULL AND frame IS NOT NULL GROUP BY clip, frame),
ln AS (SELECT clip, max(frame) + 1 AS n FROM f GROUP BY clip),
r AS (SELECT g.clip, n, g.i, coalesce(f.prob, 0) AS p FROM (SELECT clip, n, unnest(range(n)) AS i FROM ln) g LEFT JOIN f ON f.clip = g.clip AND f.frame = g.i),
st AS (
  SELECT clip, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS hush, CAST(1 AS DOUBLE) AS low, CAST([] AS STRUCT(len BIGINT, neg BIGINT, low DOUBLE)[]) AS cuts,
    CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z FROM ln
  UNION ALL
  SELECT clip, i, CASE WHEN closes THEN NULL ELSE s2 END, CASE WHEN closes THEN NULL ELSE h3 END, CASE WHEN closes THEN 1 ELSE l3 END, CASE WHEN closes THEN [] ELSE c3 END,
    CASE WHEN over THEN s1 WHEN closes THEN s2 END, CASE WHEN over THEN coalesce(-best.neg, now) WHEN closes THEN h3 END
  FROM (SELECT *, quiet AND now - h3 >= {int(_VAD.min_silence * S.RATE)} AS closes FROM (
   SELECT *, p < {_DOWN} AND s2 IS NOT NULL AND NOT opened AS quiet, CASE WHEN p < {_DOWN} AND s2 IS NOT NULL AND NOT opened THEN coalesce(h2, now) ELSE h2 END AS h3,
     CASE WHEN p < {_DOWN} AND s2 IS NOT NULL AND NOT opened THEN least(CASE WHEN h2 IS NULL THEN p ELSE l2 END, p) ELSE l2 END AS l3 FROM (
    SELECT *, CASE WHEN NOT over THEN s1 WHEN best IS NOT NULL AND best.len - best.neg < now THEN best.len - best.neg END AS s2,
      CASE WHEN over THEN NULL ELSE h1 END AS h2, CASE WHEN over THEN 1 ELSE l1 END AS l2, CASE WHEN over THEN [] ELSE c2 END AS c3 FROM (
     SELECT *, s1 IS NOT NULL AND NOT opened AND now - s1 > {_MOST} AS over, coalesce(list_max(list_filter(c2, lambda x: x.low <= {_VAD.split_below})), list_max(c2)) AS best FROM (
      SELECT r.clip, r.i, r.p, r.i * 4096 AS now, r.p >= {_UP} AND st.start IS NULL AS opened, CASE WHEN r.p >= {_UP} THEN coalesce(st.start, r.i * 4096) ELSE st.start END AS s1,
        CASE WHEN r.p >= {_UP} THEN NULL ELSE st.hush END AS h1, CASE WHEN r.p >= {_UP} THEN 1 ELSE st.low END AS l1,
        CASE WHEN r.p >= {_UP} AND r.i * 4096 - st.hush > {int(_VAD.min_silence_at_max * S.RATE)} THEN list_append(st.cuts, {{'len': r.i * 4096 - st.hush, 'neg': -st.hush, 'low': st.low}}) ELSE st.cuts END AS c2
      FROM st JOIN r ON r.clip = st.clip AND r.i = st.i + 1)))))),
e AS (SELECT clip, a, least(z, n * 4096) AS z, n * 4096 AS total FROM st JOIN ln USING (clip) WHERE a IS NOT NULL UNION ALL SELECT clip, start, n * 4096, n * 4096 FROM st JOIN ln USING (clip) WHERE i = n - 1 AND start IS NOT NULL),
k AS (SELECT *, row_number() OVER w - 1 AS seg, lead(a) OVER w - z AS after, a - lag(z) OVER w AS before FROM e WHERE z - a >= {int(_VAD.min_speech * S.RATE)} AND z > a WINDOW w AS (PARTITION BY clip ORDER BY a))
SELECT clip, CAST(seg AS INT) AS seg, a - CASE WHEN before IS NULL THEN least({_PAD}, a) WHEN before >= {2 * _PAD} THEN {_PAD} ELSE before // 2 END AS first,
  z + CASE WHEN after IS NULL THEN least({_PAD}, total - z) WHEN after >= {2 * _PAD} THEN {_PAD} ELSE after // 2 END AS last FROM k"""

ORACLE = {
    "vad_segments": _SPEECH,
    "silence_aligned_starts": _STARTS,
    "schmitt_segments": f"WITH {FRAMES}, {_ON} SELECT * FROM runs",
    "onset_offset_timeline": f"WITH {FRAMES}, {_LINE} SELECT clip, s AS first, e AS last FROM m",
    "timeline_final": f"WITH {FRAMES}, {_LINE}, z AS (SELECT clip, max(frame) + 1 AS z FROM frames GROUP BY clip) SELECT clip, s AS first, e AS last, e < z - 4 AS final FROM m JOIN z USING (clip)",
    "crowd_aware_threshold": f"""{SEG}, {_ACT}, o AS (SELECT *, count(*) FILTER (activity > 0.3) OVER (PARTITION BY rec, frame) - CAST(activity > 0.3 AS INT) AS others FROM act),
r AS (SELECT rec, spk, frame, frame - row_number() OVER (PARTITION BY rec, spk ORDER BY frame) AS g FROM o WHERE activity > CASE WHEN others > 0 THEN 0.15 ELSE 0.3 END)
SELECT rec, spk, min(frame) AS first, max(frame) + 1 AS last FROM r GROUP BY rec, spk, g""",
    "top_speakers_per_frame": f"""{SEG}, {_ACT}, k AS (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY activity DESC, spk) AS r FROM act),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY rec, spk ORDER BY frame) AS g FROM k WHERE r = 1)
SELECT rec, spk, min(frame) AS s, max(frame) + 1 AS e, round(greatest(0, least(1, avg(activity))), 8) AS quality FROM g GROUP BY rec, spk, g""",
    "powerset_decode": "SELECT vec_id, ['', '0', '1', '2', '0,1', '0,2', '1,2'][list_position(embedding[1:7], list_max(embedding[1:7]))] AS speakers FROM embeddings",
    "chunk_starts": f"WITH {CLIPS} SELECT clip, CAST(i AS INT) AS chunk, i * 208000 AS start FROM (SELECT clip, unnest(generate_series(0, greatest(0, (total - 1) // 208000))) AS i FROM cl)",
    "hop_windows": f"WITH {CLIPS} SELECT clip, CAST(i AS INT) AS chunk, i * 128000 AS start, least(i * 128000 + 160000, total) AS \"end\" FROM (SELECT clip, total, unnest(generate_series(0, greatest(0, (total - 1) // 128000))) AS i FROM cl)",
    "context_windows": f"WITH {CLIPS} SELECT clip, CAST(i AS INT) AS chunk, greatest(0, i * 128000 - 160000) AS first, i * 128000 AS centre, least(i * 128000 + 160000, total) AS last FROM (SELECT clip, total, unnest(generate_series(0, greatest(0, (total - 1) // 128000))) AS i FROM cl)",
    "token_timings": f"WITH {_TIMES} SELECT clip, chunk, pos, round(s, 6) AS s, round(e, 6) AS e FROM tm",
    "prefix_sum_timing": f"WITH {TOK}, u AS (SELECT *, sum(dur) OVER (PARTITION BY clip ORDER BY chunk, pos ROWS UNBOUNDED PRECEDING) AS z FROM tok) SELECT clip, chunk, pos, round((z - dur) * 0.0125::DOUBLE, 6) AS s, round(z * 0.0125::DOUBLE, 6) AS e FROM u",
    "word_assembly": f"""WITH {_TIMES}, p AS (SELECT tm.*, piece FROM tm JOIN token_pieces USING (token) WHERE piece NOT IN ('', '<blank>', '<pad>')),
n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ts, chunk, pos) AS n FROM p),
w AS (SELECT *, sum(CASE WHEN n = 1 OR piece[1] IN ('▁', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY n ROWS UNBOUNDED PRECEDING) AS word_no FROM n),
g AS (SELECT clip, CAST(word_no AS BIGINT) AS word_no, trim(string_agg(CASE WHEN piece[1] IN ('▁', ' ') THEN piece[2:] ELSE piece END, '' ORDER BY n)) AS word, round(min(s), 6) AS s, round(arg_max(e, n), 6) AS e, round(avg(conf), 6) AS mean_conf, round(min(conf), 6) AS least_conf FROM w GROUP BY clip, word_no)
SELECT * FROM g WHERE word <> ''""",
    "ctc_collapse": f"""WITH {TOK}, l AS (SELECT clip, chunk, pos, token % 8 AS label, lag(token % 8) OVER (PARTITION BY clip ORDER BY ts, chunk, pos) AS b FROM tok)
SELECT clip, chunk, pos, label FROM l WHERE label <> 0 AND (b IS NULL OR b <> label)""",
}
