"""Evaluation aggregates: ratios, order statistics, classification counts, leaderboards.

All are plain grouped aggregates (partial aggregation before the shuffle).
Percentiles by rank take the exact value at a fixed position of the sorted
values; they are computed by window ranks, so no group is held in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.sharded import running_sum, running_sums, with_neighbours


def ratio(top: Column, below: Column) -> Column:
    """0 on an empty denominator."""
    return F.when(below != 0, top / below).otherwise(F.lit(0.0))


def measured(c: Column) -> Column:
    """NaN means not measured: null, which aggregates skip."""
    return F.when(~F.isnan(c), c)


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, object], ranges: int = 32) -> DataFrame:
    """Values at given positions (functions of the group's size n, from 0) of the sorted values; nulls are left out.

    Positions are exact.  Equal values are counted before the shuffle; a group is spread over ranges of values cut at
    approximate quantiles of the whole column (at most ``ranges`` numbers reach the driver).
    """
    real = df.filter(F.col(value).isNotNull())
    cuts = sorted(set(real.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.001))) if ranges > 1 else []
    v = real.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    v = v.withColumn("_h", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(value))) if cuts else F.lit(0))
    total = v.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    v = running_sum(v, keys, "_h", [value], F.col("_c"), "_to").join(total, keys)
    picks = [F.min(F.when(F.col("_to") > rank(F.col("_n")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return v.groupBy(*keys).agg(*picks)


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def nearest_rank(p: float):
    """Position round((n - 1) p), half away from zero."""
    return lambda n: F.round((n - 1) * F.lit(p)).cast("long")


def stats_block(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, stdev (n - 1; 0 for one value) and p10 to p90 by nearest rank."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))
    return base.join(at_ranks(df, keys, value, {f"p{p}": nearest_rank(p / 100) for p in (10, 25, 50, 75, 90)}), keys)


def group_report(df: DataFrame, keys: list[str], error: str, work: str, time: str) -> DataFrame:
    """n, mean error, upper median and p95 of it, and total work by total time (the real-time factor)."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(measured(F.col(error))).alias("mean_error"), ratio(F.sum(work), F.sum(time)).alias("factor"))
    ranked = at_ranks(df.withColumn(error, measured(F.col(error))), keys, error, {"median_error": upper_median, "p95_error": nearest_rank(0.95)})
    return base.join(ranked, keys, "left")


def classification(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn and accuracy, precision, recall, F1 in percent; 0 on empty denominators. Null truths or predictions count as negative."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    c = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({
        "accuracy": 100 * ratio(tp + tn, tp + fp + tn + fn), "precision": 100 * ratio(tp, tp + fp),
        "recall": 100 * ratio(tp, tp + fn), "f1": 100 * ratio(2 * tp, 2 * tp + fp + fn)})


def micro_scores(df: DataFrame) -> DataFrame:
    """Precision, recall and F of counts (tp, fp, fn) added up over all files."""
    s = df.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
                          "f": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def macro_and_micro(df: DataFrame, key: str, error: str, work: str, time: str) -> DataFrame:
    """Mean of the groups' means beside the mean over all rows, and total factor."""
    g = df.groupBy(key).agg(F.avg(error).alias("m"), F.sum(error).alias("e"), F.count(error).alias("n"), F.sum(work).alias("w"), F.sum(time).alias("t"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("m").alias("macro"), (F.sum("e") / F.sum("n")).alias("micro"), ratio(F.sum("w"), F.sum("t")).alias("factor"))


def share_below(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """Count and share of values below each cut."""
    aggs = [F.count(value).alias("n")] + [F.count_if(F.col(value) < c).alias(f"below_{i}") for i, c in enumerate(cuts)]
    out = df.agg(*aggs)
    return out.withColumns({f"share_{i}": ratio(F.col(f"below_{i}"), F.col("n")) for i in range(len(cuts))})


def bottleneck(df: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Mean of each stage's time, its share in percent, and the stage with the greatest mean (first listed on ties)."""
    means = df.groupBy(key).agg(*[F.avg(s).alias(s) for s in stages])
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    top = F.greatest(*stages)
    name = F.coalesce(*[F.when(F.col(s) == top, F.lit(s)) for s in stages])
    return means.withColumns({**{f"{s}_pct": 100 * ratio(F.col(s), total) for s in stages}, "bottleneck": name})


def with_footer(df: DataFrame, name: str, values: list[str], label: str = "AVERAGE") -> DataFrame:
    """Rows and one AVERAGE row."""
    return df.select(name, *values).unionByName(df.agg(F.lit(label).alias(name), *[F.avg(v).alias(v) for v in values]))


def clamped_confidence(df: DataFrame, key: str, confidence: str, tokens: str) -> DataFrame:
    """Mean confidence within [0.1, 1]; 0.1 without confidences, 0.5 where their number isn't the tokens'."""
    g = df.groupBy(key).agg(F.avg(confidence).alias("m"), F.count(confidence).alias("n"), F.count(tokens).alias("t"))
    value = F.when(F.col("n") == 0, 0.1).when(F.col("n") != F.col("t"), 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("m"))))
    return g.select(key, value.alias("confidence"))


# frame-wise diarization error

def on_grid(df: DataFrame, who: str, step: int, disjoint: bool = False) -> DataFrame:
    """Frames whose midpoint lies inside a segment, as intervals ``rec, who, s, e`` of frame numbers (e exclusive) that don't overlap.

    ``disjoint``: a speaker's segments don't overlap as they are, so they needn't be merged.
    """
    from cadenza.operators.intervals import merged

    own = df.select("rec", who, "s", "e")
    own = own if disjoint else merged(own, ["rec", who])
    return own.select("rec", who, F.ceil(F.col("s") / step - 0.5).alias("s"), F.ceil(F.col("e") / step - 0.5).alias("e")).filter("e > s")


def co_occurrence(ref: DataFrame, hyp: DataFrame, step: int, disjoint: bool = False) -> DataFrame:
    """Frames in which a reference and a hypothesis speaker are both active: ``rec, spk, hyp, frames``.

    Counted from overlaps of intervals on the frame grid; no frame becomes a row.
    """
    from cadenza.operators.intervals import overlap_join

    both = overlap_join(on_grid(ref, "spk", step, disjoint), on_grid(hyp, "hyp", step, disjoint), ["rec"], 6000)
    return both.groupBy("rec", "spk", "hyp").agg(F.sum(F.col("e") - F.col("s")).alias("frames"))


def frame_errors(ref: DataFrame, hyp: DataFrame, mapping: DataFrame, step: int, shard: int = 6000, disjoint: bool = False, met: DataFrame | None = None) -> DataFrame:
    """Per recording: reference frames (``total``), missed, false alarm, confusion and the error rate (0 without reference speech).

    ``mapping(rec, spk, hyp)`` is the one-to-one assignment.  Per frame: missed max(0, ref - hyp), false alarm
    max(0, hyp - ref), confusion min(ref, hyp) - correct.  A sweep over the ends of intervals on the frame grid counts
    active reference, hypothesis and rightly mapped speakers; each stretch between ends weighs its length.
    ``met(rec, spk, hyp, s, e)``: where both are active on the grid, if that is known already.
    """
    from cadenza.operators.intervals import overlap_join

    r, h = on_grid(ref, "spk", step, disjoint), on_grid(hyp, "hyp", step, disjoint)
    ok = met.join(mapping, ["rec", "spk", "hyp"]) if met is not None else overlap_join(r.join(mapping, ["rec", "spk"]), h, ["rec", "hyp"], 6000)

    def ends(df, a, b, c):
        one = [F.lit(x) for x in (a, b, c)]
        return df.select("rec", F.explode(F.array(*[F.struct(F.col(t).alias("t"), *[(x * sign).alias(n) for n, x in zip("abc", one)]) for t, sign in (("s", 1), ("e", -1))])).alias("x")).select("rec", "x.*")

    x = ends(r, 1, 0, 0).unionByName(ends(h, 0, 1, 0)).unionByName(ends(ok, 0, 0, 1))
    x = x.groupBy("rec", "t").agg(*[F.sum(c).alias(c) for c in "abc"]).withColumn("_h", F.floor(F.col("t") / shard))
    x = with_neighbours(x, ["rec"], "_h", ["t"], after={"_next": "t"})
    x = running_sums(x, ["rec"], "_h", ["t"], {"ref": F.col("a"), "hyp": F.col("b"), "ok": F.col("c")})
    n, a, b, k = F.coalesce(F.col("_next") - F.col("t"), F.lit(0)), F.col("ref"), F.col("hyp"), F.col("ok")
    out = x.groupBy("rec").agg(F.sum(n * a).alias("total"), F.sum(n * F.greatest(a - b, F.lit(0))).alias("missed"), F.sum(n * F.greatest(b - a, F.lit(0))).alias("false_alarm"), F.sum(n * (F.least(a, b) - k)).alias("confusion"))
    return out.withColumn("error", ratio(F.col("missed") + F.col("false_alarm") + F.col("confusion"), F.col("total")))
