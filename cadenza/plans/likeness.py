"""Queries of vectors, matching and the registry."""

from pyspark.sql import functions as F

from cadenza.functions import text as N, vectors as V
from cadenza.operators import matching as X, metrics as M, registry as R
from cadenza.operators.intervals import collar_trim, merged, overlap_join
from cadenza.plans.evaluation import rounded
from cadenza.plans.intervals import SEG, domain, hypothesis, merge_sql, segments
from cadenza.plans.signals import TOK, tokens
from cadenza.session import materialise, table


def vecs(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asked(s, d):
    return vecs(s, d).filter("id % 50 = 0")


def voices(s, d):
    return R.last_wins(table(s, d, "speaker_params").select("id", "name", F.nanvl(F.col("duration").cast("double"), F.lit(None)).alias("duration"), "updated_at", "update_count", "permanent").filter("id IS NOT NULL"), ["id"], "updated_at")


def centroids(s, d):
    return R.mean_vectors(vecs(s, d), ["label"], "v").select(F.col("label").cast("long").alias("id"), "v")


def words(s, d):
    w = table(s, d, "eval_items").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"))).alias("at", "word"))
    return w.filter("item_id IS NOT NULL")


def terms(s, d):
    return table(s, d, "token_pieces").select(F.regexp_replace(F.lower("piece"), "[^a-z]", "").alias("term")).filter("length(term) >= 4").distinct()


WORD = r"\p{L}[\p{L}\p{M}]*"


def whole_words(s, d):
    """Words of any script and length, in NFKC: neighbours here are neighbours in the text."""
    w = table(s, d, "eval_items").filter("item_id IS NOT NULL").select("item_id", N.nfkc("text").alias("text"))
    return w.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))).alias("at", "word"))


def whole_terms(s, d):
    t = table(s, d, "token_pieces").select(N.nfkc("piece").alias("piece"))
    return t.select(F.regexp_replace(F.lower("piece"), r"[^\p{L}\p{M}]", "").alias("term")).filter("length(term) > 0").distinct()


def mapping(s, d):
    return X.best_mapping(M.co_occurrence(segments(s, d), hypothesis(s, d), 10), "rec", "spk", "hyp", "frames")


def frame_errors(s, d):
    ref, hyp = M.on_grid(segments(s, d), "spk", 10), M.on_grid(hypothesis(s, d), "hyp", 10)
    # where two are active decides the mapping, and then what is right: it is written once
    met = materialise(overlap_join(ref, hyp, ["rec"], 6000).select("rec", "spk", "hyp", "s", "e"))
    chosen = X.best_mapping(met.groupBy("rec", "spk", "hyp").agg(F.sum(F.col("e") - F.col("s")).alias("frames")), "rec", "spk", "hyp", "frames")
    return M.frame_errors(ref, hyp, chosen, 1, disjoint=True, met=met)


def jaccard(s, d):
    """Interval scoring: collars left out, then the speakers' mean Jaccard error.

    What lies in the zones that aren't scored is measured and taken off, so scored pieces needn't be built and merged again.
    """
    seg = segments(s, d)
    a, b = merged(seg, ["rec", "spk"]), merged(hypothesis(s, d), ["rec", "hyp"])
    zones = collar_trim(seg, 25)[1]
    left_out = overlap_join(zones, domain(s, d), ["rec"]).select("rec", "s", "e")
    none = F.lit(None).cast("string")
    rows = a.select("rec", "spk", none.alias("hyp"), "s", "e").unionByName(b.select("rec", none.alias("spk"), "hyp", "s", "e")).unionByName(overlap_join(a, b, ["rec"]).select("rec", "spk", "hyp", "s", "e"))
    end = domain(s, d).select("rec", F.col("e").alias("stop"))
    rows = rows.join(end, "rec").withColumn("e", F.least("e", "stop")).filter("e > s").drop("stop")
    off = overlap_join(rows, left_out, ["rec"]).select("rec", "spk", "hyp", (F.col("s") - F.col("e")).alias("n"))
    lengths = rows.select("rec", "spk", "hyp", (F.col("e") - F.col("s")).alias("n")).unionByName(off).groupBy("rec", "spk", "hyp").agg(F.sum("n").alias("n")).filter("n > 0")
    lengths = materialise(lengths)  # a few rows a recording, read several times below
    la = lengths.filter("hyp IS NULL").select("rec", "spk", F.col("n").alias("x"))
    lb = lengths.filter("spk IS NULL").select("rec", "hyp", F.col("n").alias("y"))
    both = lengths.filter("spk IS NOT NULL AND hyp IS NOT NULL").withColumnRenamed("n", "overlap")
    chosen = X.best_mapping(both, "rec", "spk", "hyp", "overlap")
    j = la.join(chosen, ["rec", "spk"], "left").join(lb, ["rec", "hyp"], "left").join(both, ["rec", "spk", "hyp"], "left")
    o = F.coalesce("overlap", F.lit(0))
    value = M.ratio(o, F.col("x") + F.coalesce("y", F.lit(0)) - o)
    lone = lb.join(chosen, ["rec", "hyp"], "left_anti").select("rec", F.lit(0.0).alias("j"))
    return j.select("rec", value.alias("j")).unionByName(lone).groupBy("rec").agg(((1 - F.avg("j")) * 100).alias("jer"))


def lexical(words, terms):
    return {
        "edit_distance_join": lambda s, d: X.edit_join(words(s, d), terms(s, d), 1),
        "string_similarity": lambda s, d: rounded(X.edit_join(words(s, d), terms(s, d), 1).select("word", "term", X.similarity(F.col("word"), F.col("term")).alias("sim"), X.penalised(F.col("word"), F.col("term")).alias("penalised"))),
        "word_spans": lambda s, d: X.spans(words(s, d), ["item_id"], "at"),
        "span_candidates": lambda s, d: X.edit_join(X.spans(words(s, d), ["item_id"], "at", 2).select(F.col("glued").alias("word")), terms(s, d), 1),
        "lookup_chain": lambda s, d: X.lookup_chain(words(s, d), [
            terms(s, d).select(F.col("term").alias("word"), F.upper("term").alias("value")), words(s, d).select("word").distinct().filter("word LIKE '%s'").select("word", F.expr("substr(word, 1, length(word) - 1)").alias("value"))]).na.fill(-1, ["stage"]),
        "greedy_spans": lambda s, d: rounded(X.pick_apart(X.spans(words(s, d), ["item_id"], "at", 3).withColumn("score", (F.length("glued") % 7) / 7.0), "item_id", "at", "n", "score", "phrase")),
    }


QUERIES = lexical(words, terms) | {f"{n}_whole": q for n, q in lexical(whole_words, whole_terms).items()} | {
    "keyword_presence_whole": lambda s, d: X.keyword_hits(
        table(s, d, "eval_items").select("item_id", N.nfkc("text").alias("reference")).withColumn("hypothesis", F.regexp_replace("reference", "er", "ar")),
        whole_words(s, d).filter("length(word) > 6").select("word"), "item_id", WORD),
    "embedding_valid": lambda s, d: table(s, d, "speaker_params").select("id", "updated_at", V.is_embedding(F.col("embedding")).alias("ok")).distinct(),
    "embedding_quality": lambda s, d: rounded(vecs(s, d).select("id", V.quality(F.col("v")).alias("quality"), V.rms(F.col("v")).alias("rms"))),
    "l2_normalise": lambda s, d: vecs(s, d).select("id", F.transform(V.l2(F.col("v")), lambda x: F.round(x, 5) + 0.0).alias("v")),
    "softmax": lambda s, d: rounded(vecs(s, d).select("id", F.round(V.log_sum_exp(F.col("v")), 6).alias("lse"), F.array_max(V.softmax(F.col("v"))).alias("top"))),
    "log_softmax": lambda s, d: rounded(vecs(s, d).select("id", F.array_max(V.log_softmax(F.col("v"), 0.5)).alias("top"))),
    "interpolate": lambda s, d: vecs(s, d).select("id", F.transform(V.resample(F.col("v"), F.lit(96)), lambda x: F.round(x, 5) + 0.0).alias("v")),
    "exclusive_scores": lambda s, d: vecs(s, d).select("id", F.transform(V.exclusive_scores(F.transform("v", lambda x: V.sigmoid(x.cast("double"))), 0.25), lambda x: F.round(x, 6) + 0.0).alias("scores")),
    "nn_join": lambda s, d: rounded(X.cosine_pairs(asked(s, d), vecs(s, d), k=5), 5),
    "threshold_join": lambda s, d: X.cosine_pairs(asked(s, d), vecs(s, d), within=0.7).select("q", "id"),
    "mergeable_pairs": lambda s, d: X.mergeable(X.similar_pairs(vecs(s, d), 0.6), vecs(s, d).select("id", (F.col("id") % 3 == 0).alias("permanent"))).select("source", "target"),
    "mean_vector": lambda s, d: centroids(s, d).select("id", F.transform("v", lambda x: F.round(x, 5)).alias("v")),
    "weighted_centroid": lambda s, d: R.mean_vectors(vecs(s, d).withColumn("w", F.col("id") % 4 + 1), ["label"], "v", "w", unit=True).select("label", F.transform("v", lambda x: F.round(x, 5)).alias("v")),
    "centroid_assign": lambda s, d: X.nearest_centroid(vecs(s, d), centroids(s, d)).select("id", "centroid"),
    "time_tolerant_match": lambda s, d: X.time_matches(
        tokens(s, d).filter("chunk % 2 = 0").select("clip", F.col("token").alias("label"), F.col("ts").alias("t"), F.struct("chunk", "pos").alias("n")),
        tokens(s, d).filter("chunk % 2 = 1").select("clip", F.col("token").alias("label"), F.col("ts").alias("t"), F.struct("chunk", "pos").alias("n")), ["clip"], 13).groupBy("clip").agg(F.count(F.lit(1)).alias("pairs")),
    "keyword_presence": lambda s, d: X.keyword_hits(
        table(s, d, "eval_items").select("item_id", F.col("text").alias("reference"), F.regexp_replace("text", "er", "ar").alias("hypothesis")), words(s, d).filter("length(word) > 6").select("word"), "item_id"),
    "optimal_assignment": lambda s, d: mapping(s, d).groupBy("rec").agg(F.count(F.lit(1)).alias("pairs")),
    "der_frames": lambda s, d: rounded(frame_errors(s, d)),
    "der_miss_fa": lambda s, d: frame_errors(s, d).select("rec", "total", "missed", "false_alarm"),
    "jer": lambda s, d: rounded(jaccard(s, d), 4),
    "registry_upsert": lambda s, d: R.upsert(voices(s, d).filter("length(id) > 0 AND substr(id, -1, 1) < '7'"), voices(s, d).filter("substr(id, -1, 1) > '4'").withColumn("duration", F.col("duration") + 1), "id").select("id", "duration"),
    "registry_skip": lambda s, d: R.initialise(voices(s, d).filter("substr(id, -1, 1) < '7'"), voices(s, d).filter("substr(id, -1, 1) > '4'").withColumn("duration", F.col("duration") + 1), "id", "skip").select("id", "duration"),
    "registry_reset": lambda s, d: R.initialise(voices(s, d).filter("substr(id, -1, 1) < '7'"), voices(s, d).filter("substr(id, -1, 1) > '4'").withColumn("duration", F.col("duration") + 1), "id", "reset").select("id", "duration"),
    "registry_merge": lambda s, d: R.initialise(voices(s, d).filter("substr(id, -1, 1) < '7'"), voices(s, d).filter("substr(id, -1, 1) > '4'").withColumn("duration", F.col("duration") + 1), "id", "merge", merged=R.MERGED).select("id", F.round("duration", 4).alias("duration"), "update_count"),
    "registry_expire": lambda s, d: R.active_since(voices(s, d), "updated_at", F.lit("2026-01-06 12:00:00").cast("timestamp_ntz")).select("id"),
    "registry_stats": lambda s, d: rounded(R.registry_stats(voices(s, d).filter("duration IS NOT NULL AND NOT isnan(duration)")), 4),
    "dedup_last_wins": lambda s, d: R.last_wins(table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id"),
    "resume_pending": lambda s, d: R.pending(table(s, d, "orders").select("o_custkey", "o_orderkey"), table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"), ["o_custkey"]),
}

_W = "w AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS l FROM eval_items WHERE item_id IS NOT NULL))"
_T = "t AS (SELECT DISTINCT term FROM (SELECT regexp_replace(lower(piece), '[^a-z]', '', 'g') AS term FROM token_pieces) WHERE length(term) >= 4)"
_NEAR = f"{_W}, {_T}, dw AS (SELECT DISTINCT word FROM w), near AS (SELECT word, term, CAST(levenshtein(word, term) AS INT) AS distance FROM dw, t WHERE abs(length(word) - length(term)) <= 1 AND levenshtein(word, term) <= 1)"
_V = "vc AS (SELECT id, CASE WHEN NOT isnan(arg_max(CAST(duration AS DOUBLE), {u})) THEN arg_max(CAST(duration AS DOUBLE), {u}) END AS duration, max(updated_at) AS updated_at, arg_max(coalesce(update_count, -1), {u}) AS update_count, arg_max(coalesce(permanent, false), {u}) AS permanent FROM speaker_params WHERE id IS NOT NULL GROUP BY id)".replace("{u}", "updated_at")
_VALID = "len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) > 0.1"
_HITS = """{n} AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower({c}), '[a-z0-9_]+')) AS word FROM eval_items), {n}k AS (SELECT * FROM {n} WHERE word IN (SELECT word FROM w WHERE length(word) > 6))"""

#: Pairs (i, j) of the one-to-one mapping of greatest total weight per recording, of ``co(rec, i, j, w)``: a dynamic program over the speakers and the set of labels that are taken.
_MAPPED = """dp AS (
  SELECT DISTINCT rec, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS v, CAST([] AS BIGINT[]) AS path FROM co
  UNION ALL
  SELECT rec, i, mask, max(v) AS v, arg_max(path, v) AS path FROM (
    SELECT dp.rec, dp.i + 1 AS i, dp.mask, dp.v, dp.path FROM dp WHERE EXISTS (SELECT 1 FROM co WHERE co.rec = dp.rec AND co.i > dp.i)
    UNION ALL SELECT dp.rec, dp.i + 1, dp.mask + (1 << co.j), dp.v + co.w, list_append(dp.path, co.i * 100 + co.j) FROM dp JOIN co ON co.rec = dp.rec AND co.i = dp.i + 1 AND (dp.mask >> co.j) % 2 = 0) GROUP BY rec, i, mask),
mapped AS (SELECT rec, p // 100 AS i, p % 100 AS j FROM (SELECT rec, unnest(arg_max(path, v)) AS p FROM dp GROUP BY rec))"""
_POINTS = f"""{SEG}, {merge_sql('a', 'seg', ['rec', 'spk'])}, {merge_sql('b', 'hyp', ['rec', 'hyp'])},
stop AS (SELECT rec, max(e) AS m FROM seg GROUP BY rec), zone AS (SELECT DISTINCT rec, unnest(range(x - 25, x + 25)) AS f FROM (SELECT rec, s AS x FROM seg UNION ALL SELECT rec, e FROM seg)),
fa AS (SELECT rec, spk, f, dense_rank() OVER (PARTITION BY rec ORDER BY spk) AS i FROM (SELECT rec, spk, unnest(range(s, e)) AS f FROM a) ANTI JOIN zone USING (rec, f) JOIN stop USING (rec) WHERE f < m),
fb AS (SELECT rec, hyp, f, dense_rank() OVER (PARTITION BY rec ORDER BY hyp) - 1 AS j FROM (SELECT rec, hyp, unnest(range(s, e)) AS f FROM b) ANTI JOIN zone USING (rec, f) JOIN stop USING (rec) WHERE f < m),
co AS (SELECT rec, i, j, count(*) AS w FROM fa JOIN fb USING (rec, f) GROUP BY rec, i, j)"""

ORACLE = {
    "jer": f"""{_POINTS}, {_MAPPED}, la AS (SELECT rec, i, count(*) AS x FROM fa GROUP BY rec, i), lb AS (SELECT rec, j, count(*) AS y FROM fb GROUP BY rec, j),
v AS (SELECT la.rec, coalesce(w, 0) / (x + coalesce(y, 0) - coalesce(w, 0)) AS v FROM la LEFT JOIN mapped USING (rec, i) LEFT JOIN lb ON lb.rec = la.rec AND lb.j = mapped.j LEFT JOIN co ON co.rec = la.rec AND co.i = la.i AND co.j = mapped.j
  UNION ALL SELECT rec, 0 FROM lb ANTI JOIN mapped USING (rec, j))
SELECT rec, round((1 - avg(v)) * 100, 4) AS jer FROM v GROUP BY rec""",
    "optimal_assignment": f"""{SEG}, {merge_sql('a', 'seg', ['rec', 'spk'])}, {merge_sql('b', 'hyp', ['rec', 'hyp'])},
fa AS (SELECT DISTINCT rec, spk, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM a), fb AS (SELECT DISTINCT rec, hyp, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM b),
co AS (SELECT rec, dense_rank() OVER (PARTITION BY rec ORDER BY spk) AS i, dense_rank() OVER (PARTITION BY rec ORDER BY hyp) - 1 AS j, count(*) AS w FROM fa JOIN fb USING (rec, f) GROUP BY rec, spk, hyp), {_MAPPED}
SELECT rec, count(*) AS pairs FROM mapped GROUP BY rec""",
    "embedding_valid": f"SELECT DISTINCT id, updated_at, coalesce({_VALID}, false) AS ok FROM speaker_params",
    "embedding_quality": "SELECT vec_id AS id, round(least(1, n / 10), 6) AS quality, round(n / sqrt(64), 6) AS rms FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)",
    "l2_normalise": "SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 5) + 0.0) AS v FROM embeddings",
    "softmax": "SELECT vec_id AS id, round(ln(z), 6) AS lse, round(exp(list_max(embedding)::DOUBLE) / z, 6) AS top FROM (SELECT *, list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))) AS z FROM embeddings)",
    "log_softmax": "SELECT vec_id AS id, round(list_max(embedding)::DOUBLE * 2 - ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 2)))), 6) AS top FROM embeddings",
    "interpolate": """WITH p AS (SELECT vec_id, embedding, i, greatest(0.0, least(63.0, (i + 0.5) / 1.5 - 0.5)) AS pos FROM embeddings, range(96) r(i))
SELECT vec_id AS id, list(round(embedding[1 + floor(pos)::INT]::DOUBLE * (1 - (pos - floor(pos))) + embedding[1 + least(floor(pos)::INT + 1, 63)]::DOUBLE * (pos - floor(pos)), 5) + 0.0 ORDER BY i) AS v FROM p GROUP BY vec_id""",
    "exclusive_scores": """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE)))) AS p FROM embeddings),
r AS (SELECT *, list_sum(list_transform(p, lambda x: ln(1 - least(x, 0.75)))) AS r FROM p)
SELECT vec_id AS id, list_transform(p, lambda x: round(ln(greatest(x, 0.25)) - ln(1 - least(x, 0.75)) + ln(2) + r, 6) + 0.0) AS scores FROM r""",
    "nn_join": """WITH c AS (SELECT q.vec_id AS q, r.vec_id AS id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY distance, id) AS INT) AS rank FROM c) SELECT q, id, round(distance, 5) AS distance, rank FROM k WHERE rank <= 5""",
    "threshold_join": "SELECT q.vec_id AS q, r.vec_id AS id FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND 1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) <= 0.7",
    "mergeable_pairs": """SELECT CASE WHEN r.vec_id % 3 <> 0 THEN r.vec_id ELSE q.vec_id END AS source, CASE WHEN r.vec_id % 3 <> 0 THEN q.vec_id ELSE r.vec_id END AS target FROM embeddings q, embeddings r
WHERE q.vec_id < r.vec_id AND 1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) <= 0.6 AND NOT (q.vec_id % 3 = 0 AND r.vec_id % 3 = 0)""",
    "mean_vector": "SELECT CAST(label AS BIGINT) AS id, list(m ORDER BY i) AS v FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 5) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label",
    "weighted_centroid": """WITH m AS (SELECT label, i, sum(embedding[i]::DOUBLE * (vec_id % 4 + 1)) / sum(vec_id % 4 + 1) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT label, list(round(m / n, 5) ORDER BY i) AS v FROM m JOIN n USING (label) GROUP BY label""",
    "centroid_assign": """WITH m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)
SELECT vec_id AS id, CAST(arg_max(m.label, list_cosine_similarity(embedding::DOUBLE[], c)) AS BIGINT) AS centroid FROM embeddings, m GROUP BY vec_id""",
    "edit_distance_join": f"WITH {_NEAR} SELECT * FROM near",
    "string_similarity": f"WITH {_NEAR} SELECT word, term, round(1 - distance / greatest(length(word), length(term)), 6) AS sim, round((1 - distance / greatest(length(word), length(term))) * sqrt(least(length(word), length(term)) / greatest(length(word), length(term))), 6) AS penalised FROM near",
    "word_spans": f"""WITH {_W}, s AS (SELECT item_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d FROM w WINDOW o AS (PARTITION BY item_id ORDER BY i))
SELECT item_id, CAST(i AS INT) AS "at", n, phrase, replace(phrase, ' ', '') AS glued FROM (SELECT item_id, i, 1 AS n, a AS phrase FROM s UNION ALL SELECT item_id, i, 2, a || ' ' || b FROM s WHERE b IS NOT NULL
UNION ALL SELECT item_id, i, 3, a || ' ' || b || ' ' || c FROM s WHERE c IS NOT NULL UNION ALL SELECT item_id, i, 4, a || ' ' || b || ' ' || c || ' ' || d FROM s WHERE d IS NOT NULL)""",
    "span_candidates": f"""WITH {_W}, {_T}, g AS (SELECT word FROM w UNION SELECT word || lead(word) OVER (PARTITION BY item_id ORDER BY i) FROM w), dw AS (SELECT DISTINCT word FROM g WHERE word IS NOT NULL)
SELECT word, term, CAST(levenshtein(word, term) AS INT) AS distance FROM dw, t WHERE abs(length(word) - length(term)) <= 1 AND levenshtein(word, term) <= 1""",
    "time_tolerant_match": f"WITH {TOK} SELECT a.clip, count(*) AS pairs FROM tok a JOIN tok b ON a.clip = b.clip AND a.token = b.token AND a.chunk % 2 = 0 AND b.chunk % 2 = 1 AND abs(a.ts - b.ts) < 13 GROUP BY a.clip",
    "keyword_presence": f"""WITH {_W}, {_HITS.format(n='r', c='text')}, {_HITS.format(n='h', c="regexp_replace(text, 'er', 'ar', 'g')")}
SELECT coalesce(rk.item_id, hk.item_id) AS item_id, count(*) FILTER (rk.word IS NOT NULL AND hk.word IS NOT NULL) AS tp, count(*) FILTER (rk.word IS NULL) AS fp, count(*) FILTER (hk.word IS NULL) AS fn
FROM rk FULL JOIN hk ON rk.item_id = hk.item_id AND rk.word = hk.word GROUP BY 1""",
    "lookup_chain": f"""WITH {_W}, {_T} SELECT word, CASE WHEN term IS NOT NULL THEN upper(term) WHEN word LIKE '%s' THEN word[:-2] END AS value, CASE WHEN term IS NOT NULL THEN 0 WHEN word LIKE '%s' THEN 1 ELSE -1 END AS stage FROM (SELECT DISTINCT word FROM w) LEFT JOIN t ON term = word""",
    # a dynamic program over the speakers and the set of labels that are taken gives the best total of a one-to-one mapping
    "der_frames": f"""{SEG}, {merge_sql('a', 'seg', ['rec', 'spk'])}, {merge_sql('b', 'hyp', ['rec', 'hyp'])},
fa AS (SELECT DISTINCT rec, spk, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM a), fb AS (SELECT DISTINCT rec, hyp, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM b),
n AS (SELECT rec, f, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT rec, f, count(*) AS x FROM fa GROUP BY rec, f) FULL JOIN (SELECT rec, f, count(*) AS y FROM fb GROUP BY rec, f) USING (rec, f)),
co AS (SELECT rec, dense_rank() OVER (PARTITION BY rec ORDER BY spk) AS i, dense_rank() OVER (PARTITION BY rec ORDER BY hyp) - 1 AS j, count(*) AS w FROM fa JOIN fb USING (rec, f) GROUP BY rec, spk, hyp),
dp AS (
  SELECT DISTINCT rec, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS v FROM co
  UNION ALL
  SELECT rec, i, mask, max(v) AS v FROM (
    SELECT dp.rec, dp.i + 1 AS i, dp.mask, dp.v FROM dp WHERE EXISTS (SELECT 1 FROM co WHERE co.rec = dp.rec AND co.i > dp.i)
    UNION ALL SELECT dp.rec, dp.i + 1, dp.mask + (1 << co.j), dp.v + co.w FROM dp JOIN co ON co.rec = dp.rec AND co.i = dp.i + 1 AND (dp.mask >> co.j) % 2 = 0) GROUP BY rec, i, mask),
best AS (SELECT rec, max(v) AS v FROM dp GROUP BY rec)
SELECT rec, CAST(sum(x) AS BIGINT) AS total, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS missed, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS false_alarm, CAST(sum(least(x, y)) - coalesce(max(best.v), 0) AS BIGINT) AS confusion,
  round(CASE WHEN sum(x) > 0 THEN (sum(greatest(x, y)) - coalesce(max(best.v), 0)) / sum(x) ELSE 0 END, 6) AS error
FROM n LEFT JOIN best USING (rec) GROUP BY rec""",
    "der_miss_fa": f"""{SEG}, {merge_sql('a', 'seg', ['rec', 'spk'])}, {merge_sql('b', 'hyp', ['rec', 'hyp'])},
fa AS (SELECT DISTINCT rec, spk, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM a), fb AS (SELECT DISTINCT rec, hyp, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM b),
n AS (SELECT rec, f, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT rec, f, count(*) AS x FROM fa GROUP BY rec, f) FULL JOIN (SELECT rec, f, count(*) AS y FROM fb GROUP BY rec, f) USING (rec, f))
SELECT rec, CAST(sum(x) AS BIGINT) AS total, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS missed, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS false_alarm FROM n GROUP BY rec""",
    "registry_upsert": f"WITH {_V} SELECT id, CASE WHEN right(id, 1) > '4' THEN duration + 1 ELSE duration END AS duration FROM vc WHERE (length(id) > 0 AND right(id, 1) < '7') OR right(id, 1) > '4'",
    "registry_skip": f"WITH {_V} SELECT id, CASE WHEN right(id, 1) < '7' THEN duration ELSE duration + 1 END AS duration FROM vc WHERE right(id, 1) < '7' OR right(id, 1) > '4'",
    "registry_reset": f"WITH {_V} SELECT id, CASE WHEN right(id, 1) < '7' AND permanent THEN duration ELSE duration + 1 END AS duration FROM vc WHERE (right(id, 1) < '7' AND permanent) OR right(id, 1) > '4'",
    "registry_merge": f"""WITH {_V}, x AS (SELECT *, right(id, 1) < '7' AS old, right(id, 1) > '4' AS new FROM vc)
SELECT id, round(CASE WHEN old AND new AND NOT permanent THEN duration + duration + 1 WHEN old THEN duration ELSE duration + 1 END, 4) AS duration,
  CAST(CASE WHEN old AND new AND NOT permanent THEN greatest(update_count, 0) * 2 ELSE nullif(update_count, -1) END AS INT) AS update_count FROM x WHERE old OR new""",
    "registry_expire": f"WITH {_V} SELECT id FROM vc WHERE coalesce(updated_at >= TIMESTAMP '2026-01-06 12:00:00', false) OR permanent",
    "registry_stats": f"WITH {_V} SELECT count(*) AS n, round(sum(duration), 4) AS duration, round(least(1, coalesce(sum(CASE WHEN update_count >= 0 THEN update_count END), 0) / count(*) / 10), 4) AS confidence, count(*) FILTER (update_count > 0) AS updated FROM vc WHERE duration IS NOT NULL AND NOT isnan(duration)",
    "dedup_last_wins": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "resume_pending": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
}
