"""Top-k: global, per group, boosted and disabled scores, fallbacks and greedy picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.sharded import with_neighbours


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; Catalyst limits each group before the shuffle as well."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def boosted(df: DataFrame, keys: list[str], score: str, at: str, k: int, scale: float) -> DataFrame:
    """The k best scores of a group (earlier ``at`` on ties, minus infinity left out) gain scale * ln 2."""
    best = top_per_group(df.filter(F.col(score) > float("-inf")).select(*keys, at, score), keys, [F.desc(score), F.col(at)], k).select(*keys, at, F.lit(True).alias("_top"))
    return df.join(best, [*keys, at], "left").withColumn("boosted", F.when(F.col("_top"), F.col(score) + scale * 0.6931471805599453).otherwise(F.col(score))).drop("_top")


def disabled_scores(df: DataFrame, keys: list[str], p: str, score: str, enough: int) -> DataFrame:
    """Probability at most 1/2 gives minus infinity; a score at most 0 too, but only if the group has at least ``enough`` rows with probability above 1/2 and a positive score."""
    good = df.groupBy(*keys).agg(F.count_if((F.col(p) > 0.5) & (F.col(score) > 0)).alias("_good"))
    low = F.lit(float("-inf"))
    return df.join(good, keys).withColumn("kept", F.when(F.col(p) <= 0.5, low).when((F.col(score) <= 0) & (F.col("_good") >= enough), low).otherwise(F.col(score))).drop("_good")


def top_frames(df: DataFrame, score: str, speaker: str, frame: str, k: int) -> DataFrame:
    """The k best (speaker, frame) cells: greater score, then smaller speaker, then earlier frame; TakeOrdered, no full sort."""
    return df.filter(F.col(score) > float("-inf")).orderBy(F.desc(score), speaker, frame).limit(k)


def newest(df: DataFrame, key: str, at: str, tie: str, k: int = 50) -> DataFrame:
    """Bounded history: the k newest rows per key."""
    return top_per_group(df, [key], [F.desc(at), F.desc(tie)], k)


def worst_cases(df: DataFrame, value: str, over: float, tie: str) -> DataFrame:
    return df.filter(F.col(value) > over).orderBy(F.desc(value), tie)


def local_maxima(df: DataFrame, keys: list[str], at: str, score: str, least: float) -> DataFrame:
    """Rows at least as high as the one before, higher than the next and at least ``least``; a group without any gives its first greatest row."""
    low = F.lit(float("-inf"))
    x = with_neighbours(df.withColumn("_h", F.floor(F.col(at) / 4096)), keys, "_h", [at], before={"_a": score}, after={"_z": score})
    x = x.withColumn("_peak", (F.col(score) >= F.coalesce("_a", low)) & (F.col(score) > F.coalesce("_z", low)) & (F.col(score) >= least))
    best = x.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(at)).alias("a"))).alias("_best"), F.max("_peak").alias("_any"))
    keep = F.col("_peak") | (~F.col("_any") & (F.col(score) == F.col("_best.s")) & (F.col(at) == -F.col("_best.a")))
    return x.join(best, keys).filter(keep).select(*df.columns)
