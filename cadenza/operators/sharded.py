"""Ordered windows over keys of any size: computed inside shards, stitched by one summary row per shard.

A plain window over a key puts all its rows into one task; if a key holds a
third of the table, so does that task.  Here the rows of a key are spread by
``shard`` (a whole number that never falls in the order of the rows); only the
summaries meet per key.  The join back needs no second shuffle of the rows, as
they are already laid out by (keys, shard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _named(order: list) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])


def _summary(df: DataFrame, keys: list[str], shard: str, aggs: list[Column], carried: list[Column]) -> DataFrame:
    s = df.groupBy(*keys, shard).agg(*aggs)
    return s.select(*keys, shard, *carried)


def with_neighbours(df: DataFrame, keys: list[str], shard: str, order: list, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """Adds, by new name, a column's value in the row before and after; null at a key's ends. Rows must differ in ``order``."""
    before, after = before or {}, after or {}
    w = W.partitionBy(*keys, shard).orderBy(*order)
    cols = sorted({*before.values(), *after.values()})
    row = F.struct(*[F.col(c) for c in cols])
    x = df.withColumn("_p", F.lag(row).over(w)).withColumn("_n", F.lead(row).over(w))
    across = W.partitionBy(*keys).orderBy(shard)
    s = _summary(df, keys, shard, [F.min_by(row, _named(order)).alias("_f"), F.max_by(row, _named(order)).alias("_l")],
                 [F.lag("_l").over(across).alias("_pl"), F.lead("_f").over(across).alias("_nf")])
    x = x.join(s, [*keys, shard])
    p, n = F.coalesce("_p", "_pl"), F.coalesce("_n", "_nf")
    return x.withColumns({**{a: p[c] for a, c in before.items()}, **{a: n[c] for a, c in after.items()}}).drop("_p", "_n", "_pl", "_nf")


def running_sums(df: DataFrame, keys: list[str], shard: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Adds, by name, sums of values from the key's first row to this one."""
    w = W.partitionBy(*keys, shard).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    n = range(len(values))
    x = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    x = x.withColumns({f"_r{i}": F.sum(f"_v{i}").over(w) for i in n})
    across = W.partitionBy(*keys).orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    s = _summary(x, keys, shard, [F.sum(f"_v{i}").alias(f"_t{i}") for i in n], [F.coalesce(F.sum(f"_t{i}").over(across), F.lit(0)).alias(f"_b{i}") for i in n])
    x = x.join(s, [*keys, shard]).withColumns({name: F.col(f"_r{i}") + F.col(f"_b{i}") for i, name in enumerate(values)})
    return x.drop(*[f"_{c}{i}" for c in "vrb" for i in n])


def running_sum(df: DataFrame, keys: list[str], shard: str, order: list, value: Column, name: str) -> DataFrame:
    return running_sums(df, keys, shard, order, {name: value})


def highest_before(df: DataFrame, keys: list[str], shard: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the greatest value of the rows before this one; null in a key's first row."""
    w = W.partitionBy(*keys, shard).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = df.withColumn("_v", value)
    across = W.partitionBy(*keys).orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    s = _summary(x, keys, shard, [F.max("_v").alias("_t")], [F.max("_t").over(across).alias("_b")])
    return x.withColumn("_r", F.max("_v").over(w)).join(s, [*keys, shard]).withColumn(name, F.greatest("_r", "_b")).drop("_v", "_r", "_b")


def last_known(df: DataFrame, keys: list[str], shard: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the latest value that isn't null up to this row."""
    w = W.partitionBy(*keys, shard).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_v", value)
    across = W.partitionBy(*keys).orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    known = F.when(F.col("_v").isNotNull(), _named(order))
    s = _summary(x, keys, shard, [F.max_by("_v", known).alias("_t")], [F.last("_t", ignorenulls=True).over(across).alias("_b")])
    return x.withColumn("_r", F.last("_v", ignorenulls=True).over(w)).join(s, [*keys, shard]).withColumn(name, F.coalesce("_r", "_b")).drop("_v", "_r", "_b")


def centred_sums(df: DataFrame, keys: list[str], shard: str, order: list, half: int, values: dict[str, Column], block: int = 4096) -> DataFrame:
    """Adds sums over the ``half`` rows before and after each row. Rows near a block's edge are lent to the block beside it."""
    x = running_sum(df, keys, shard, order, F.lit(1), "_at").withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    home = F.floor(F.col("_at") / block)
    x = x.withColumn("_home", home).withColumn("_k", F.explode(F.array_distinct(F.array(home, F.floor((F.col("_at") - half) / block), F.floor((F.col("_at") + half) / block)))))
    w = W.partitionBy(*keys, "_k").orderBy("_at").rowsBetween(-half, half)
    x = x.withColumns({n: F.sum(f"_v{i}").over(w) for i, n in enumerate(values)})
    return x.filter(F.col("_k") == F.col("_home")).drop("_at", "_home", "_k", *[f"_v{i}" for i in range(len(values))])
