"""Queries of clustering, decoding, readers on text columns and replayed streams."""

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.operators import clustering as C, registry as R
from cadenza.operators.sessions import fold, per_key
from cadenza.plans.evaluation import rounded
from cadenza.plans.intervals import SEG, frames, segments
from cadenza.plans.likeness import vecs
from cadenza.plans.signals import TOK, tokens
from cadenza.sources import readers, sinks
from cadenza.streaming import machines as S
from cadenza.session import table


def grouped(s, d):
    return vecs(s, d).withColumn("g", F.col("id") % 50)


def log_frames(s, d):
    """Frames of a chunk as log-probabilities over nine labels, made from its tokens; label 0 is blank."""
    t = tokens(s, d).groupBy("clip", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "conf"))).alias("x"))
    return t


def _logits(x):
    out = []
    for r in x:
        p = np.full(9, 0.1)
        p[r["token"] % 9] += 4 * (r["conf"] or 0.1)
        p[(r["token"] // 9) % 9] += 1.0
        out.append(np.log(p / p.sum()).tolist())
    return out


PIECES = {i: ("▁" if i % 3 == 1 else "") + "abcdefghi"[i] for i in range(1, 9)}


def streamed(s, d):
    return per_key(frames(s, d), ["clip"], "frame", ["prob"])


def partials(s, d):
    """Growing transcripts of the recordings: the words of each item, told apart by time."""
    w = table(s, d, "eval_items").filter("text IS NOT NULL").select("item_id", F.split("text", r"(?<=[.!?])\s+").alias("x"))
    return w


def kaldi(s, d):
    """All six files of a split, by name."""
    x = segments(s, d).select(F.concat_ws("-", "rec", "spk", "s", "e").alias("utt"), "rec", "spk", (F.col("s") / 100).alias("s"), (F.col("e") / 100).alias("e"), F.concat("rec", F.lit(".wav")).alias("wav"))
    return reduce(DataFrame.unionByName, [part.select(F.lit(name).alias("file"), "value") for name, part in sinks.kaldi_lines(x).items()])


QUERIES = {
    "ahc_partition": lambda s, d: C.clustered(grouped(s, d), "g", "id", "v", lambda x: C.agglomerate(x, 0.3)),
    "kmeans_partition": lambda s, d: C.clustered(grouped(s, d), "g", "id", "v", lambda x: C.kmeans(x, 3)[0]),
    "vbx_partition": lambda s, d: C.clustered(grouped(s, d), "g", "id", "v", lambda x: C.renumbered(C.variational(x, np.ones(x.shape[1]), C.agglomerate(x, 0.3))[0].argmax(1))),
    "assign_or_create": lambda s, d: C.assigned(grouped(s, d).withColumn("d", F.col("id") % 3 * 0.8), "g", "id", "id", "v", "d"),
    "ema_update": lambda s, d: C.moving_average(vecs(s, d), "label", "id", "v").select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v")),
    "count_constraints": lambda s, d: grouped(s, d).groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("n")).select("g", C.speaker_counts(F.col("n"), F.lit(None).cast("int"), F.lit(12), (F.col("g") % 15).cast("int")).alias("c")).select("g", "c.low", "c.high"),
    "integrate_and_fire": lambda s, d: rounded(C.integrate_and_fire(frames(s, d), "clip", "frame", "prob"), 6),
    "greedy_decode": lambda s, d: fold(log_frames(s, d), ["clip", "chunk"], "labels array<int>", lambda r: [(C.greedy(_logits(r["x"]), 0),)]),
    "beam_decode": lambda s, d: fold(log_frames(s, d), ["clip", "chunk"], "labels array<int>", lambda r: [(C.beam_search(_logits(r["x"]), PIECES, 0, width=8, candidates=4),)]),
    "keyword_spot": lambda s, d: rounded(fold(log_frames(s, d), ["clip", "chunk"], "score double, first int, last int", lambda r: [C.spot(_logits(r["x"]), [1, None, 4], 0)] if r["x"] else [])),
    "arbitration": lambda s, d: tokens(s, d).groupBy("clip").agg(
        F.count_if(F.col("chunk") % 3 == 0).alias("a"), F.count_if(F.col("chunk") % 3 == 2).alias("c"), F.avg("conf").alias("m")).select(
        "clip", C.arbitrate(F.col("c") / F.greatest("a", F.lit(1)), F.lit(0.8), F.round("m", 6), F.round("m", 6) + 0.01, F.lit(0.5), F.col("c") / F.greatest("a", F.lit(1)), F.round("m", 6) + 0.01).alias("kept")),
    "rttm_scan": lambda s, d: table(s, d, "documents").filter("kind = 'rttm' AND text IS NOT NULL").select("doc_id", F.posexplode(readers.parse_rttm(F.col("text"))).alias("no", "r")).select("doc_id", "no", "r.rec", "r.spk", F.round("r.s", 4).alias("s"), F.round("r.e", 4).alias("e")),
    "kaldi_lines": kaldi,
    "stream_vad_events": lambda s, d: fold(streamed(s, d), ["clip"], "kind string, sample long", lambda r: S.replay(S.vad_step, r["prob"])),
    "stream_hops": lambda s, d: fold(streamed(s, d), ["clip"], "first long, last long", lambda r: S.replay(lambda a, b: S.hop_step(a, b, 160_000, 128_000), [4096] * len(r["prob"]))),
    "stream_windows": lambda s, d: fold(streamed(s, d), ["clip"], "first long, fresh long, last long", lambda r: S.replay(lambda a, b: S.window_step(a, b, 32_000, 160_000, 16_000), [4096] * len(r["prob"]))),
    "stream_windows_whole": lambda s, d: fold(streamed(s, d), ["clip"], "first long, fresh long, last long", lambda r: S.replay(
        lambda a, b: S.window_step(a, b[0], 32_000, 160_000, 16_000, final=b[1]), [(4096, False)] * len(r["prob"]) + [(0, True)])),
    "stream_blocks": lambda s, d: fold(streamed(s, d), ["clip"], "kind string, n long, held long", lambda r: S.replay(S.placed_step, [((f + 1) * 0.256, 4096) for f in r["frame"]])),
    "stream_commit": lambda s, d: fold(partials(s, d), ["item_id"], "no int, done string, ghost string, reason string", lambda r: [(i, *o) for i, o in enumerate(S.replay(S.commit_step, [("text", t, float(i)) for i, t in enumerate(r["x"])] + [("end", None, 1e9)]))]),
    "stream_confirm": lambda s, d: fold(partials(s, d), ["item_id"], "no int, final string, tentative string", lambda r: [(i, *o) for i, o in enumerate(S.replay(S.confirm_step, [(t, 0.9, 11.0 + i) for i, t in enumerate(r["x"])]))]),
    "stream_utterance_end": lambda s, d: fold(streamed(s, d), ["clip"], "ends int", lambda r: [(sum(S.replay(S.utterance_step, [(p is not None and p < 0.3, 0, 4096) for p in r["prob"]])),)]),
    "silence_profile": lambda s, d: rounded(frames(s, d).filter("prob < 0.2").groupBy("clip").agg(F.avg("prob").alias("level"), F.count(F.lit(1)).alias("n")), 8),
    "stream_cache": lambda s, d: fold(streamed(s, d), ["clip"], "frame int", lambda r: [(f,) for _, f in _cached(r)]),
}


def _cached(r):
    state = None
    for p, f in zip(r["prob"], r["frame"]):
        state, _ = S.cache_step(state, [(p, f)], 16)
    return state or []


_F = "f AS (SELECT clip, frame, max(prob) AS prob FROM vad_frames WHERE clip IS NOT NULL AND frame IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) GROUP BY clip, frame)"
#: The state machine as a recursion over a clip's frames.
VAD_EVENTS = f"""WITH RECURSIVE {_F}, r AS (SELECT clip, prob, row_number() OVER (PARTITION BY clip ORDER BY frame) AS i FROM f),
s AS (
  SELECT DISTINCT clip, CAST(0 AS BIGINT) AS i, false AS talks, CAST(NULL AS BIGINT) AS hush, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS sample FROM r
  UNION ALL
  SELECT r.clip, r.i,
    CASE WHEN prob >= 0.85 THEN true WHEN talks AND prob < 0.7 AND r.i * 4096 - coalesce(hush, r.i * 4096) >= 12000 THEN false ELSE talks END,
    CASE WHEN prob >= 0.85 THEN NULL WHEN talks AND prob < 0.7 THEN CASE WHEN r.i * 4096 - coalesce(hush, r.i * 4096) < 12000 THEN coalesce(hush, r.i * 4096) END ELSE hush END,
    CASE WHEN prob >= 0.85 AND NOT talks THEN 'start' WHEN talks AND prob < 0.7 AND r.i * 4096 - coalesce(hush, r.i * 4096) >= 12000 THEN 'end' END,
    CASE WHEN prob >= 0.85 AND NOT talks THEN greatest(0, r.i * 4096 - 5696) WHEN talks AND prob < 0.7 AND r.i * 4096 - coalesce(hush, r.i * 4096) >= 12000 THEN greatest(0, hush - 2496) END
  FROM s JOIN r ON r.clip = s.clip AND r.i = s.i + 1)
SELECT clip, kind, sample FROM s WHERE kind IS NOT NULL"""

_UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 1e-300))"

_PARTIALS = r"p AS (SELECT item_id, str_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS x FROM eval_items WHERE text IS NOT NULL)"

ORACLE = {
    "stream_confirm": f"""WITH {_PARTIALS} SELECT item_id, CAST(i AS INT) AS no, trim(array_to_string(list_filter(x[:i], lambda t: t <> ''), ' ')) AS final, x[i + 1] AS tentative FROM (SELECT *, unnest(range(len(x))) AS i FROM p)""",
    "stream_commit": rf"""WITH RECURSIVE {_PARTIALS}, st AS (
  SELECT item_id, x, -1 AS no, '' AS done, '' AS ghost, CAST(NULL AS VARCHAR) AS reason FROM p
  UNION ALL
  SELECT item_id, x, no + 1, CASE WHEN no + 1 = len(x) THEN CASE WHEN ghost = '' THEN done WHEN done = '' OR done LIKE '% ' THEN done || ghost ELSE done || ' ' || ghost END
      WHEN head <> '' THEN done || head || coalesce(nullif(regexp_extract(rest, '^\s+'), ''), ' ') ELSE done END,
    CASE WHEN no + 1 = len(x) THEN '' WHEN head <> '' THEN regexp_replace(rest, '^\s+', '') ELSE t END,
    CASE WHEN no + 1 = len(x) THEN CASE WHEN ghost <> '' THEN 'end' END WHEN head <> '' THEN 'punctuation' END
  FROM (SELECT *, substr(t, length(head) + 1) AS rest FROM (SELECT *, coalesce(x[no + 2], '') AS t, regexp_extract(coalesce(x[no + 2], ''), '(?s)^.*[.!?。！？]') AS head FROM st WHERE no < len(x))))
SELECT item_id, no, done, ghost, reason FROM st WHERE no >= 0""",
    "ema_update": f"""WITH RECURSIVE x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, {_UNIT.format(v='embedding::DOUBLE[]')} AS u FROM embeddings),
st AS (SELECT label, n, u AS acc FROM x WHERE n = 1 UNION ALL
  SELECT label, n, {_UNIT.format(v='m')} FROM (SELECT x.label, x.n, list_transform(list_zip(acc, u), lambda p: 0.9 * p[1] + 0.1 * p[2]) AS m FROM st JOIN x ON x.label = st.label AND x.n = st.n + 1))
SELECT label, list_transform(arg_max(acc, n), lambda y: round(y, 6)) AS v FROM st GROUP BY label""",
    "greedy_decode": f"""WITH {TOK}, l AS (SELECT clip, chunk, pos, CASE WHEN a = b OR 4 * c > 1 THEN a WHEN 4 * c < 1 THEN b ELSE least(a, b) END AS k
  FROM (SELECT clip, chunk, pos, token % 9 AS a, token // 9 % 9 AS b, CASE WHEN conf IS NULL OR conf = 0 THEN 0.1 ELSE conf END AS c FROM tok)),
g AS (SELECT *, lag(k) OVER (PARTITION BY clip, chunk ORDER BY pos) AS p FROM l)
SELECT clip, chunk, coalesce(list(CAST(k AS INT) ORDER BY pos) FILTER (k <> 0 AND (p IS NULL OR p <> k)), []) AS labels FROM g GROUP BY clip, chunk""",
    "count_constraints": "SELECT g, CAST(least(greatest(1, least(n, 12)), greatest(1, least(n, g % 15))) AS INT) AS low, CAST(greatest(1, least(n, g % 15)) AS INT) AS high FROM (SELECT vec_id % 50 AS g, count(*) AS n FROM embeddings GROUP BY 1)",
    "arbitration": f"""WITH {TOK}, m AS (SELECT clip, count(*) FILTER (chunk % 3 = 0) AS a, count(*) FILTER (chunk % 3 = 2) AS c FROM tok GROUP BY clip)
SELECT clip, CASE WHEN c / greatest(a, 1) >= 1.15 THEN 'C' WHEN c / greatest(a, 1) <= 0.9 THEN 'B' ELSE 'A' END AS kept FROM m""",
    "rttm_scan": r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '^\s*SPEAKER(\s+\S+){7,}')) AS l FROM documents WHERE kind = 'rttm' AND text IS NOT NULL),
r AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, regexp_split_to_array(trim(unnest(l)), '\s+') AS f FROM l)
SELECT doc_id, CAST(no AS INT) AS no, f[2] AS rec, f[8] AS spk, round(try_cast(f[4] AS DOUBLE), 4) AS s, round(try_cast(f[4] AS DOUBLE) + try_cast(f[5] AS DOUBLE), 4) AS e FROM r""",
    "silence_profile": f"WITH {_F} SELECT clip, round(avg(prob), 8) AS level, count(*) AS n FROM f WHERE prob < 0.2 GROUP BY clip",
    "stream_cache": f"WITH {_F}, k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY prob DESC, frame) AS r FROM f) SELECT clip, frame FROM k WHERE r <= 16",
    "stream_hops": f"WITH {_F}, n AS (SELECT clip, count(*) * 4096 AS n FROM f GROUP BY clip) SELECT clip, i * 128000 AS first, i * 128000 + 160000 AS last FROM n, LATERAL (SELECT unnest(range(0, greatest(0, (n - 160000) // 128000 + 1))) AS i) WHERE n >= 160000",
    "kaldi_lines": f"""{SEG}, x AS (SELECT concat_ws('-', rec, spk, s, e) AS utt, rec, spk, s / 100 AS s, e / 100 AS e FROM seg),
p AS (SELECT rec, max(e) AS e, count(DISTINCT spk) AS n FROM x GROUP BY rec)
SELECT 'wav.scp' AS file, rec || ' ' || rec || '.wav' AS value FROM p UNION ALL SELECT 'segments', format('{{}} {{}} {{:.2f}} {{:.2f}}', utt, rec, s::DOUBLE, e::DOUBLE) FROM x UNION ALL SELECT 'utt2spk', utt || ' ' || spk FROM x
UNION ALL SELECT 'spk2utt', spk || ' ' || string_agg(DISTINCT utt, ' ' ORDER BY utt) FROM x GROUP BY spk
UNION ALL SELECT 'reco2dur', format('{{}} {{:.2f}}', rec, e::DOUBLE) FROM p UNION ALL SELECT 'reco2num_spk', rec || ' ' || n FROM p""",
    "stream_blocks": f"""WITH {_F}, p AS (SELECT clip, frame, coalesce(lag((frame + 1) * 4096) OVER (PARTITION BY clip ORDER BY frame), 0) AS held FROM f)
SELECT clip, CASE WHEN frame * 4096 > held THEN 'gap' ELSE 'next' END AS kind, CAST(frame * 4096 - held AS BIGINT) AS n, CAST((frame + 1) * 4096 AS BIGINT) AS held FROM p""",
    "stream_windows": f"""WITH {_F}, n AS (SELECT clip, count(*) * 4096 AS n FROM f GROUP BY clip HAVING count(*) * 4096 >= 48000)
SELECT clip, greatest(0, i * 32000 - 160000) AS first, i * 32000 AS fresh, (i + 1) * 32000 AS last FROM (SELECT clip, unnest(range(0, (n - 48000) // 32000 + 1)) AS i FROM n)""",
    "stream_windows_whole": f"""WITH {_F}, c AS (SELECT clip, count(*) * 4096 AS n FROM f GROUP BY clip), n AS (SELECT *, greatest(0, (n - 16000) // 32000) AS k FROM c)
SELECT clip, greatest(0, i * 32000 - 160000) AS first, i * 32000 AS fresh, CASE WHEN i = k THEN n ELSE (i + 1) * 32000 END AS last FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM n)""",
    "stream_vad_events": VAD_EVENTS,
    "integrate_and_fire": f"""WITH RECURSIVE {_F}, r AS (
  SELECT clip, frame AS t, prob AS a, row_number() OVER (PARTITION BY clip ORDER BY frame) AS i FROM f
  UNION ALL SELECT clip, max(frame) + 1, 0.45::DOUBLE, count(*) + 1 FROM f GROUP BY clip),
s AS (
  SELECT DISTINCT clip, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST(-1 AS INT) AS no, false AS fires, CAST(0 AS INT) AS t, CAST(0 AS DOUBLE) AS part FROM r
  UNION ALL
  SELECT r.clip, r.i, CASE WHEN total + a >= 1 THEN total + a - 1 ELSE total + a END, CASE WHEN total + a >= 1 THEN no + 1 ELSE no END, total + a >= 1, r.t, a - (total + a - 1)
  FROM s JOIN r ON r.clip = s.clip AND r.i = s.i + 1)
SELECT clip, no, CAST(t AS BIGINT) AS at, round(part, 6) AS part FROM s WHERE fires""",
    "stream_utterance_end": f"""WITH {_F}, r AS (SELECT clip, prob < 0.3 AS quiet, row_number() OVER (PARTITION BY clip ORDER BY frame) AS i FROM f),
g AS (SELECT clip, count(*) AS n FROM (SELECT clip, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS g FROM r WHERE quiet) GROUP BY clip, g HAVING count(*) >= 5)
SELECT clip, CAST(coalesce(n, 0) AS INT) AS ends FROM (SELECT DISTINCT clip FROM f) LEFT JOIN (SELECT clip, count(*) AS n FROM g GROUP BY clip) USING (clip)""",
}
