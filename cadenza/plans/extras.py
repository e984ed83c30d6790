"""Queries of signals, sounds, matrices, rescoring, and live streams run to their end."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import audio as A, sounds as P, spoken as K, vectors as V
from cadenza.operators import matching as X, rescoring as Z, sequences as Q, texts as O
from cadenza.operators.sessions import fold, per_key
from cadenza.operators.sharded import running_sum
from cadenza.plans.decoding import VAD_EVENTS
from cadenza.plans.evaluation import rounded
from cadenza.plans.intervals import SEG, frames, segments
from cadenza.plans.language import HAN, written_in
from cadenza.plans.likeness import asked, terms, vecs, whole_terms, whole_words, words
from cadenza.plans.signals import TOK, clips, tokens
from cadenza.session import shared_dir, table
from cadenza.streaming import live, machines as S


def signal(s, d):
    """Voice activity of a clip as a signal of 16 samples a frame."""
    f = per_key(frames(s, d), ["clip"], "frame", ["prob"])
    return f.select("clip", F.flatten(F.transform("prob", lambda p: F.array_repeat(p, 16))).alias("x"))


def stream_of(s, d, name, schema):
    return s.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def _run(s, out, how=live.run_to_table):
    base = f"{shared_dir(s)}/cadenza-{uuid.uuid4().hex}"
    how(out, base + "-out", base + "-state")
    return s.read.parquet(base + "-out")


def live_vad(s, d):
    t = stream_of(s, d, "vad_frames", "clip string, frame int, prob double").filter("clip IS NOT NULL AND frame IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob)")
    t = t.dropDuplicates(["clip", "frame"])  # deliveries repeated; state is one entry a frame
    return _run(s, live.keyed(t, "clip", "frame", "kind string, sample long", S.vad_step, lambda r: r["prob"]))


def live_windows(s, d):
    t = stream_of(s, d, "events", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(s, live.sliding(t, "ts", "6 hours", "3 hours", "1 hour", "event_type"), live.run_whole).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def matrix_product(s, d):
    """Gram matrix of the labels' sums, from long form: both sides joined on the inner index."""
    long = vecs(s, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    b = long.select(F.col("label").alias("other"), "i", F.col("x").alias("y"))
    return long.join(b, "i").groupBy("label", "other").agg(F.round(F.sum(F.col("x") * F.col("y")), 4).alias("z"))


def nearest_words(s, d):
    w = segments(s, d).select("rec", F.monotonically_increasing_id().alias("k"), "spk", "s", "e")
    w = running_sum(w.withColumn("h", F.floor(F.col("s") / 60_000)), ["rec"], "h", ["s", "e", "spk", "k"], F.lit(1), "n").select("rec", F.col("n").cast("int").alias("n"), "s", "e")
    windows = w.groupBy("rec").agg(F.max("e").alias("m")).select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(1000).cast("long"))).alias("win")).select("rec", "win", F.col("win").alias("s"), (F.col("win") + 100).alias("e"))
    return X.words_in_window(w, windows, "rec")


PINYIN = {"昨天": ["zuó", "tiān"], "不": ["bù"], "一": ["yī"], "你好": ["nǐ", "hǎo"], "已经": ["yǐ", "jīng"], "测量": ["cè", "liáng"], "保存": ["bǎo", "cún"], "检查": ["jiǎn", "chá"]}

def lexical(words, terms):
    return {
        "inline_diff": lambda s, d: Q.pairwise(words(s, d).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("a")).withColumn("b", F.transform("a", lambda w: F.regexp_replace(w, "er$", "ar"))), ["item_id"], "a", "b", lambda a, b: [" ".join(Q.diff(a, b)[0])], "marked", "array<string>"),
        "vocabulary_replacements": lambda s, d: rounded(Z.vocabulary_replacements(words(s, d), terms(s, d), "item_id", "at", 1, 0.7)),
        "stress_marks": lambda s, d: words(s, d).select("word").distinct().select("word", O.apply_text(F.col("word"), lambda w: P.stressed(w, 1.5)).alias("stressed")),
    }


QUERIES = lexical(words, terms) | {f"{n}_whole": q for n, q in lexical(whole_words, whole_terms).items()} | {
    "sample_slice": lambda s, d: signal(s, d).select("clip", F.aggregate(F.slice("x", 33, 64), F.lit(0.0), lambda a, x: a + x).alias("sum")).select("clip", F.round("sum", 6).alias("sum")),
    "duration_between": lambda s, d: clips(s, d).filter((F.col("total") / 16000).between(5.0, 30.0)),
    "audio_issues": lambda s, d: signal(s, d).select("clip", F.array_join(V.audio_issues(F.col("x"), 16, 100.0, 0.5), ",").alias("issues")),
    "silent_clips": lambda s, d: signal(s, d).select("clip", V.is_silent(F.col("x"), 0.9).alias("silent")),
    "finite_or_all": lambda s, d: Z.finite_or_all(table(s, d, "speaker_params").select("id", "embedding"), "embedding").groupBy("id").agg(F.count(F.lit(1)).alias("n")),
    "sanitised": lambda s, d: table(s, d, "speaker_params").select("id", "updated_at", F.round(V.sanitized(F.col("duration").cast("double")), 4).alias("duration")).distinct(),
    "padding_mask": lambda s, d: clips(s, d).select("clip", F.aggregate(V.masked(F.lit(50), (F.col("total") / 16000).cast("int")), F.lit(0), lambda a, x: a + x).alias("valid")),
    "matrix_product": matrix_product,
    "pairwise_euclidean": lambda s, d: X.cosine_pairs(asked(s, d), vecs(s, d), within=1e9, cosine=False).select("q", "id", F.round("distance", 4).alias("d")),
    "log_space_mean": lambda s, d: vecs(s, d).select("id", F.transform(V.log_mean(V.log_softmax(F.slice("v", 1, 32)), V.log_softmax(F.slice("v", 33, 32))), lambda x: F.round(x, 5)).alias("v")),
    "plda_score": lambda s, d: rounded(vecs(s, d).select("id", V.plda_score(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("score"))),
    "noise_schedule": lambda s, d: s.range(1).select(F.posexplode(V.power_schedule(12, 0.0001, 3.0, 9.0)).alias("step", "sigma")).select("step", F.round("sigma", 8).alias("sigma")),
    "alignment_matrix": lambda s, d: tokens(s, d).select("clip", "chunk", "pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("dur"), F.lit(1)) - 1)).alias("k")).select("clip", "chunk", "pos", "k"),
    "mel_spectrogram": lambda s, d: fold(signal(s, d), ["clip"], "frames int, energy double", lambda r: [(len(m), round(float(m.mean()), 6) if len(m) else 0.0) for m in [A.mel_spectrogram(np.array(r["x"]), bands=32)]]),
    "rumble_filter": lambda s, d: fold(signal(s, d), ["clip"], "rms double", lambda r: [(round(float(np.sqrt((A.high_pass(np.array(r["x"])) ** 2).mean())), 6),)]),
    "resample_linear": lambda s, d: fold(signal(s, d), ["clip"], "n int, mean double", lambda r: [(len(y), round(float(y.mean()), 6) if len(y) else 0.0) for y in [A.resample(np.array(r["x"]), 24, 16)]]),
    "custom_rules": lambda s, d: Z.custom_rules(table(s, d, "eval_items").select("item_id", "text"), "text", [("the", "THE"), ("of the", "OF_THE")]),
    "normalised_vocabulary": lambda s, d: table(s, d, "token_pieces").select(F.regexp_replace(F.lower("piece"), "[^a-z0-9]", "").alias("form")).filter("form <> ''").distinct(),
    "words_in_window": nearest_words,
    "pinyin_tones": lambda s, d: written_in(s, d, "zh", HAN).filter("text IS NOT NULL").select("doc_id", O.apply_text(F.col("text"), lambda t: " ".join(f"{b}{n}" for b, n in P.read_aloud(t, PINYIN, {}))).alias("sounds")),
    "lexicon_matches": lambda s, d: fold(written_in(s, d, "zh", HAN).filter("text IS NOT NULL").select("doc_id", "text"), ["doc_id"], "known int", lambda r: [(sum(h is not None for _, h in K.longest_matches(r["text"], {k: k for k in PINYIN})),)]),
    "live_vad": live_vad,
    "live_windows": live_windows,
}

_SIG = "f AS (SELECT clip, frame, max(prob) AS prob FROM vad_frames WHERE clip IS NOT NULL AND frame IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) GROUP BY clip, frame), g AS (SELECT clip, list(prob ORDER BY frame) AS p FROM f GROUP BY clip)"
_CL = "cl AS (SELECT clip, total_samples AS total FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY registered_at DESC) AS rn FROM clips) WHERE rn = 1 AND total_samples IS NOT NULL)"

ORACLE = {
    "resample_linear": """WITH f AS (SELECT clip, frame, max(prob) AS prob FROM vad_frames WHERE clip IS NOT NULL AND frame IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob) GROUP BY clip, frame),
x AS (SELECT clip, list(prob ORDER BY frame) AS p, count(*) * 16 AS m FROM f GROUP BY clip),
y AS (SELECT clip, p, m, CAST(floor(m * 16 / 24) AS BIGINT) AS n, unnest(range(CAST(floor(m * 16 / 24) AS BIGINT))) * 1.5::DOUBLE AS pos FROM x),
z AS (SELECT clip, n, p[1 + CAST(floor(pos) AS BIGINT) // 16] AS a, p[1 + least(CAST(floor(pos) AS BIGINT) + 1, m - 1) // 16] AS b, pos - floor(pos) AS w FROM y)
SELECT clip, CAST(n AS INT) AS n, round(avg(a + (b - a) * w), 6) AS mean FROM z GROUP BY clip, n""",
    "live_windows": """SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n
FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - INTERVAL 3 HOURS]) AS w FROM events) GROUP BY 1, 2""",
    "sample_slice": f"WITH {_SIG} SELECT clip, round(coalesce(16 * list_sum(p[3:6]), 0), 6) AS sum FROM g",
    "duration_between": f"WITH {_CL} SELECT * FROM cl WHERE total / 16000 BETWEEN 5 AND 30",
    "audio_issues": f"WITH {_SIG} SELECT clip, concat_ws(',', CASE WHEN len(p) * 16 < 1600 THEN 'short' END, CASE WHEN sqrt(list_sum(list_transform(p, lambda x: x * x)) / len(p)) < 0.5 THEN 'quiet' END) AS issues FROM g",
    "silent_clips": f"WITH {_SIG} SELECT clip, list_max(p) <= 0.9 AS silent FROM g",
    "finite_or_all": "SELECT id, count(*) AS n FROM speaker_params WHERE coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), len(embedding) = 0) GROUP BY id",
    "sanitised": "SELECT DISTINCT id, updated_at, round(CASE WHEN duration IS NOT NULL AND NOT isfinite(duration) THEN 0 ELSE CAST(duration AS DOUBLE) END, 4) AS duration FROM speaker_params",
    "padding_mask": f"WITH {_CL} SELECT clip, CAST(least(50, total // 16000) AS INT) AS valid FROM cl",
    "matrix_product": """WITH l AS (SELECT label, i, sum(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
SELECT a.label, b.label AS other, round(sum(a.x * b.x), 4) AS z FROM l a JOIN l b USING (i) GROUP BY ALL""",
    "pairwise_euclidean": "SELECT q.vec_id AS q, r.vec_id AS id, round(list_distance(list_transform(q.embedding, lambda x: x::DOUBLE), r.embedding::DOUBLE[]), 4) AS d FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id",
    "log_space_mean": """WITH p AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: exp(x::DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: exp(x::DOUBLE)) AS b FROM embeddings)
SELECT vec_id AS id, list_transform(range(1, 33), lambda i: round(ln((a[i] / list_sum(a) + b[i] / list_sum(b)) / 2), 5)) AS v FROM p""",
    "plda_score": "SELECT vec_id AS id, round(list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]), 6) AS score FROM embeddings",
    "noise_schedule": "SELECT CAST(i AS INT) AS step, round(CASE WHEN i = 12 THEN 0 ELSE pow(pow(3.0, 1.0 / 9) + i / 11 * (pow(0.0001, 1.0 / 9) - pow(3.0, 1.0 / 9)), 9) END, 8) AS sigma FROM range(13) r(i)",
    "custom_rules": r"SELECT item_id, regexp_replace(regexp_replace(text, '\bof the\b', 'OF_THE', 'gi'), '\bthe\b', 'THE', 'gi') AS text FROM eval_items",
    "normalised_vocabulary": "SELECT DISTINCT form FROM (SELECT regexp_replace(lower(piece), '[^a-z0-9]', '', 'g') AS form FROM token_pieces) WHERE form <> ''",
    "live_vad": VAD_EVENTS,
    "alignment_matrix": f"WITH {TOK} SELECT clip, chunk, pos, CAST(unnest(range(0, greatest(dur, 1))) AS INT) AS k FROM tok",
    "words_in_window": f"""{SEG}, w AS (SELECT rec, s, e, CAST(row_number() OVER (PARTITION BY rec ORDER BY s, e, spk) AS INT) AS n FROM seg),
v AS (SELECT rec, unnest(generate_series(0, max(e), 1000)) AS win FROM w GROUP BY rec),
h AS (SELECT v.rec, v.win, w.n, w.n - row_number() OVER (PARTITION BY v.rec, v.win ORDER BY w.n) AS g FROM v JOIN w ON v.rec = w.rec AND w.e >= v.win AND w.s <= v.win + 100),
r AS (SELECT rec, win, min(n) AS first, max(n) AS last, row_number() OVER (PARTITION BY rec, win ORDER BY g) AS k FROM h GROUP BY rec, win, g),
o AS (SELECT v.rec, v.win, w.n, row_number() OVER (PARTITION BY v.rec, v.win ORDER BY abs((w.s + w.e) / 2 - (v.win + 50)), w.n) AS k FROM v ANTI JOIN h USING (rec, win) JOIN w ON w.rec = v.rec)
SELECT rec, win, first, last FROM r WHERE k = 1 UNION ALL SELECT rec, win, n, n FROM o WHERE k = 1""",
}
