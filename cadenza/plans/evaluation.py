"""Queries of aggregates and rankings."""

from pyspark.sql import functions as F

from cadenza.operators import metrics as M, ranking as R
from cadenza.plans.intervals import SEG, hypothesis, merge_sql, segments
from cadenza.session import table


def lines(s, d):
    return table(s, d, "lineitem")


def rounded(df, digits=6, but=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def frames(s, d):
    t = table(s, d, "token_windows").select("clip", "chunk", "pos", "token", "ts", F.col("conf").cast("double").alias("conf"), "dur").distinct()
    return t.filter("conf IS NOT NULL AND ts IS NOT NULL AND token IS NOT NULL")


QUERIES = {
    "eval_report_by_type": lambda s, d: rounded(M.group_report(table(s, d, "events").withColumn("load", F.lit(1.0)), ["event_type"], "value", "value", "load"), 4),
    "report_overall": lambda s, d: rounded(M.group_report(lines(s, d).withColumn("all", F.lit("all")), ["all"], "l_discount", "l_extendedprice", "l_quantity"), 4),
    "macro_vs_micro": lambda s, d: rounded(M.macro_and_micro(lines(s, d), "l_returnflag", "l_discount", "l_extendedprice", "l_quantity"), 4),
    "category_percentiles": lambda s, d: rounded(M.at_ranks(lines(s, d), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p50": M.nearest_rank(0.5), "p95": M.nearest_rank(0.95), "median": M.upper_median}), 4),
    "stats_block": lambda s, d: rounded(M.stats_block(lines(s, d), ["l_shipdate"], "l_extendedprice"), 8),
    "binary_metrics": lambda s, d: rounded(M.classification(
        table(s, d, "vad_frames").groupBy("clip", "frame").agg(F.max("prob").alias("prob")), ["clip"], F.col("frame") % 3 > 0, F.col("prob") >= 0.5)),
    "micro_scores": lambda s, d: rounded(M.micro_scores(M.classification(
        table(s, d, "vad_frames").groupBy("clip", "frame").agg(F.max("prob").alias("prob")), ["clip"], F.col("frame") % 3 > 0, F.col("prob") >= 0.5))),
    "threshold_buckets": lambda s, d: rounded(M.share_below(table(s, d, "orders"), "o_totalprice", [50_000, 100_000, 200_000])),
    "bottleneck_stage": lambda s, d: rounded(M.bottleneck(lines(s, d), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]), 4),
    "leaderboard_with_average": lambda s, d: rounded(M.with_footer(
        lines(s, d).groupBy(F.col("l_suppkey").cast("string").alias("name")).agg(F.avg("l_discount").alias("der"), F.avg("l_tax").alias("jer")), "name", ["der", "jer"])),
    "leaderboard_rollup": lambda s, d: rounded(lines(s, d).rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("der")), 8),
    "clamped_confidence": lambda s, d: rounded(M.clamped_confidence(table(s, d, "token_windows"), "clip", "conf", "token"), 4),
    "speaker_activity_sum": lambda s, d: segments(s, d).groupBy("rec", "spk").agg(F.sum(F.col("e") - F.col("s")).alias("activity")),
    "segments_by_speaker": lambda s, d: segments(s, d).groupBy("rec", "spk").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"), F.max("e").alias("last")),
    "assignment_histogram": lambda s, d: table(s, d, "token_windows").groupBy("chunk").pivot("dur", [1, 2, 3, 4]).agg(F.count(F.lit(1))).na.fill(0).select("chunk", *[F.col(str(i)).alias(f"d{i}") for i in (1, 2, 3, 4)]),
    "assignment_histogram_whole": lambda s, d: table(s, d, "token_windows").groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("dur") == i).alias(f"d{i}") for i in range(5)],
        F.count_if(F.col("dur").isNull()).alias("missing"), F.count_if(~F.col("dur").between(0, 4)).alias("other")),
    "co_occurrence": lambda s, d: M.co_occurrence(segments(s, d), hypothesis(s, d), 10),
    "worst_cases": lambda s, d: R.worst_cases(table(s, d, "orders"), "o_totalprice", 400_000, "o_orderkey").select("o_orderkey", "o_totalprice"),
    "topk_global": lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"),
    "topk_per_group": lambda s, d: R.top_per_group(table(s, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "value", "rank"),
    "topk_boost": lambda s, d: rounded(R.boosted(table(s, d, "events"), ["event_type"], "value", "event_id", 40, 0.5).select("event_id", "boosted")),
    "topk_frames": lambda s, d: R.top_frames(table(s, d, "events"), "value", "user_id", "event_id", 188).select("event_id", "user_id", "value"),
    "disable_low_scores": lambda s, d: R.disabled_scores(
        frames(s, d).withColumn("score", F.col("conf") - 0.8), ["clip"], "conf", "score", 20).groupBy("clip").agg(F.count_if(F.col("kept") > float("-inf")).alias("kept"), F.count(F.lit(1)).alias("n")),
    "bounded_history": lambda s, d: R.newest(table(s, d, "events"), "user_id", "ts", "event_id", 50).select("user_id", "event_id", "rank"),
    "local_maxima": lambda s, d: R.local_maxima(table(s, d, "vad_frames").filter("prob IS NOT NULL").groupBy("clip", "frame").agg(F.max("prob").alias("prob")), ["clip"], "frame", "prob", 0.95),
}


def nearest(p):
    return f"CAST(round((n - 1) * {p}) AS BIGINT)"


_RANKED = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t} WHERE {v} IS NOT NULL"
_CLASS = """c AS (SELECT clip, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn
FROM (SELECT clip, frame % 3 > 0 AS t, coalesce(max(prob) >= 0.5, false) AS p FROM vad_frames GROUP BY clip, frame) GROUP BY clip)"""
_TOK = "t AS (SELECT DISTINCT clip, chunk, pos, token, ts, CAST(conf AS DOUBLE) AS conf, dur FROM token_windows WHERE conf IS NOT NULL AND ts IS NOT NULL AND token IS NOT NULL)"

ORACLE = {
    "eval_report_by_type": f"""WITH r AS ({_RANKED.format(k='event_type', v='value', t='events')})
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_error, round(sum(value) / count(*), 4) AS factor,
  round(max(value) FILTER (i = n // 2), 4) AS median_error, round(max(value) FILTER (i = {nearest(0.95)}), 4) AS p95_error FROM r GROUP BY event_type""",
    "report_overall": f"""WITH r AS ({_RANKED.format(k='1', v='l_discount', t='lineitem')})
SELECT 'all' AS "all", count(*) AS n, round(avg(l_discount), 4) AS mean_error, round(sum(l_extendedprice) / sum(l_quantity), 4) AS factor,
  round(max(l_discount) FILTER (i = n // 2), 4) AS median_error, round(max(l_discount) FILTER (i = {nearest(0.95)}), 4) AS p95_error FROM r""",
    "macro_vs_micro": """SELECT count(*) AS n_groups, round(avg(m), 4) AS macro, round(sum(e) / sum(n), 4) AS micro, round(sum(w) / sum(t), 4) AS factor FROM (
SELECT l_returnflag, avg(l_discount) AS m, sum(l_discount) AS e, count(l_discount) AS n, sum(l_extendedprice) AS w, sum(l_quantity) AS t FROM lineitem GROUP BY 1)""",
    "category_percentiles": f"""WITH r AS ({_RANKED.format(k='l_returnflag, l_linestatus', v='l_extendedprice', t='lineitem')})
SELECT l_returnflag, l_linestatus, max(l_extendedprice) FILTER (i = {nearest(0.5)}) AS p50, max(l_extendedprice) FILTER (i = {nearest(0.95)}) AS p95, max(l_extendedprice) FILTER (i = n // 2) AS median FROM r GROUP BY ALL""",
    "stats_block": f"""WITH r AS ({_RANKED.format(k='l_shipdate', v='l_extendedprice', t='lineitem')})
SELECT l_shipdate, count(*) AS n, round(avg(l_extendedprice), 8) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 8) AS stdev,
{', '.join(f"max(l_extendedprice) FILTER (i = {nearest(p / 100)}) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM r GROUP BY l_shipdate""",
    "binary_metrics": f"""WITH {_CLASS} SELECT *, round(100 * (tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(100 * tp / nullif(tp + fp, 0), 0), 6) AS precision,
round(coalesce(100 * tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(100 * 2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "micro_scores": f"""WITH {_CLASS}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f FROM s""",
    "threshold_buckets": """SELECT *, round(below_0 / n, 6) AS share_0, round(below_1 / n, 6) AS share_1, round(below_2 / n, 6) AS share_2 FROM (
SELECT count(o_totalprice) AS n, count(*) FILTER (o_totalprice < 50000) AS below_0, count(*) FILTER (o_totalprice < 100000) AS below_1, count(*) FILTER (o_totalprice < 200000) AS below_2 FROM orders)""",
    "bottleneck_stage": """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a, 4) AS l_quantity, round(b, 4) AS l_discount, round(c, 4) AS l_tax, round(100 * a / (a + b + c), 4) AS l_quantity_pct, round(100 * b / (a + b + c), 4) AS l_discount_pct,
round(100 * c / (a + b + c), 4) AS l_tax_pct, CASE greatest(a, b, c) WHEN a THEN 'l_quantity' WHEN b THEN 'l_discount' ELSE 'l_tax' END AS bottleneck FROM m""",
    "leaderboard_with_average": """WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, avg(l_discount) AS der, avg(l_tax) AS jer FROM lineitem GROUP BY 1)
SELECT name, round(der, 6) AS der, round(jer, 6) AS jer FROM g UNION ALL SELECT 'AVERAGE', round(avg(der), 6), round(avg(jer), 6) FROM g""",
    "leaderboard_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 8) AS der FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "clamped_confidence": """SELECT clip, round(CASE WHEN count(conf) = 0 THEN 0.1 WHEN count(conf) <> count(token) THEN 0.5 ELSE greatest(0.1, least(1.0, avg(CAST(conf AS DOUBLE)))) END, 4) AS confidence FROM token_windows GROUP BY clip""",
    "speaker_activity_sum": f"{SEG} SELECT rec, spk, CAST(sum(e - s) AS BIGINT) AS activity FROM seg GROUP BY rec, spk",
    "segments_by_speaker": f"{SEG} SELECT rec, spk, count(*) AS n, min(s) AS first, max(e) AS last FROM seg GROUP BY rec, spk",
    "assignment_histogram": f"SELECT chunk, {', '.join(f'count(*) FILTER (dur = {i}) AS d{i}' for i in (1, 2, 3, 4))} FROM token_windows GROUP BY chunk",
    "assignment_histogram_whole": f"SELECT chunk, count(*) AS n, {', '.join(f'count(*) FILTER (dur = {i}) AS d{i}' for i in range(5))}, count(*) FILTER (dur IS NULL) AS missing, count(*) FILTER (dur < 0 OR dur > 4) AS other FROM token_windows GROUP BY chunk",
    "co_occurrence": f"""{SEG}, {merge_sql('a', 'seg', ['rec', 'spk'])}, {merge_sql('b', 'hyp', ['rec', 'hyp'])},
fa AS (SELECT DISTINCT rec, spk, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM a), fb AS (SELECT DISTINCT rec, hyp, unnest(range(CAST(ceil(s / 10 - 0.5) AS BIGINT), CAST(ceil(e / 10 - 0.5) AS BIGINT))) AS f FROM b)
SELECT rec, spk, hyp, count(*) AS frames FROM fa JOIN fb USING (rec, f) GROUP BY rec, spk, hyp""",
    "worst_cases": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000",
    "topk_global": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT user_id, event_id, value, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3",
    "topk_boost": "SELECT event_id, round(CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 40 THEN value + 0.5 * ln(2) ELSE value END, 6) AS boosted FROM events",
    "topk_frames": "SELECT event_id, user_id, value FROM events ORDER BY value DESC, user_id, event_id LIMIT 188",
    "disable_low_scores": f"""WITH {_TOK}, g AS (SELECT *, count(*) FILTER (conf > 0.5 AND conf - 0.8 > 0) OVER (PARTITION BY clip) AS good FROM t)
SELECT clip, count(*) FILTER (NOT (conf <= 0.5 OR (conf - 0.8 <= 0 AND good >= 20))) AS kept, count(*) AS n FROM g GROUP BY clip""",
    "bounded_history": "SELECT user_id, event_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50",
    "local_maxima": """WITH f AS (SELECT clip, frame, max(prob) AS prob FROM vad_frames WHERE prob IS NOT NULL GROUP BY clip, frame),
p AS (SELECT *, prob >= coalesce(lag(prob) OVER w, '-inf') AND prob > coalesce(lead(prob) OVER w, '-inf') AND prob >= 0.95 AS peak FROM f WINDOW w AS (PARTITION BY clip ORDER BY frame)),
q AS (SELECT *, bool_or(peak) OVER (PARTITION BY clip) AS has, row_number() OVER (PARTITION BY clip ORDER BY prob DESC, frame) AS r FROM p)
SELECT clip, frame, prob FROM q WHERE peak OR (NOT has AND r = 1)""",
}
