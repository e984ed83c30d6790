"""Text functions applied to columns in Arrow batches; texts are whole, nulls stay null."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cadenza.operators.sessions import fold


def apply_text(c: Column, fn: Callable[[str], object], kind: T.DataType = T.StringType()) -> Column:
    """A plain function over a text column; null gives null."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fn(t))

    return F.pandas_udf(run, kind)(c)


def exploded(df: DataFrame, keys: list[str], text: str, fn: Callable[[str], list[str]], part: str = "part") -> DataFrame:
    """One row per piece that ``fn`` makes of a text: ``keys, no, part``; null texts give none."""
    rows = df.select(*keys, F.col(text).alias("_t"))
    return fold(rows, keys, f"no int, {part} string", lambda r: list(enumerate(fn(r["_t"]))) if r["_t"] else [])


def bigram_scores(df: DataFrame, unigrams: DataFrame, bigrams: DataFrame, keys: list[str], at: str, unknown: float = -23.026) -> DataFrame:
    """Back-off language model: ``score`` of each word after the one before it.

    ``unigrams(word, lp, bo)``, ``bigrams(context, word, lp)`` in natural logs.  A known bigram scores itself, else the
    context's back-off (0 if unknown) plus the word's own (``unknown`` without any).  Joins carry no hint: Catalyst
    broadcasts a table only if it is small.
    """
    from pyspark.sql import Window as W

    x = df.withColumn("context", F.lag("word").over(W.partitionBy(*keys).orderBy(at)))
    x = x.join(bigrams.select("context", "word", F.col("lp").alias("_b")), ["context", "word"], "left")
    x = x.join(unigrams.select("word", F.col("lp").alias("_u")), "word", "left").join(unigrams.select(F.col("word").alias("context"), F.col("bo").alias("_o")), "context", "left")
    own = F.coalesce("_u", F.lit(unknown))
    return x.select(*keys, at, "word", F.coalesce("_b", F.coalesce("_o", F.lit(0.0)) + own).alias("score"))


def filtered_top(df: DataFrame, keys: list[str], fits: Column, logit: str, token: str) -> DataFrame:
    """Of each group's candidates the greatest logit that fits (smaller token on ties), with its softmax over all of them; null without a fitting one."""
    best = F.max(F.when(fits, F.struct(F.col(logit).alias("l"), (-F.col(token)).alias("t")))).alias("_b")
    top = F.max(logit).alias("_m")
    g = df.groupBy(*keys).agg(best, top)
    z = df.join(g.select(*keys, "_m"), keys).groupBy(*keys).agg(F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_z"))
    p = F.exp(F.col("_b.l") - F.col("_m")) / F.col("_z")
    return g.join(z, keys).select(*keys, (-F.col("_b.t")).alias(token), F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("probability"))
