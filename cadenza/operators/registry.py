"""Entity registry: merge modes, upserts, expiry, mean vectors, centroids, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: What becomes of columns when two entries of one key merge; others stay as they are.
MERGED = {
    "name": lambda a, b: F.coalesce(b, a), "duration": lambda a, b: a + b, "updated_at": lambda a, b: F.greatest(a, b),
    "update_count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
}


def newest(most: int = 50, at: str = "at"):
    """Merges two histories (arrays of structs with a time ``at``): the ``most`` newest of both, oldest first if there are no more."""
    def merge(a, b):
        both = F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))
        down = F.array_sort(both, lambda x, y: F.when(x[at] > y[at], -1).when(x[at] < y[at], 1).otherwise(0))
        return F.when(F.size(both) > most, F.slice(down, 1, most)).otherwise(both)
    return merge


def initialise(old: DataFrame, new: DataFrame, key: str, mode: str, keep_permanent: bool = True, merged: dict | None = None) -> DataFrame:
    """Full outer join of a registry and newcomers (unique keys, like columns with ``permanent boolean``).

    ``skip`` keeps what is there, ``overwrite`` replaces it, ``merge`` joins both by the column functions ``merged``
    (``MERGED`` by default; columns without one stay), ``reset`` empties the registry first; permanent rows are
    kept in each case if asked.  Null flags count as not permanent; rows without a key are left out.
    """
    if mode not in ("skip", "overwrite", "merge", "reset"):
        raise ValueError(f"unknown mode {mode}")
    cols = [c for c in old.columns if c != key]
    a = old.filter(F.col(key).isNotNull()).select(key, F.struct(*cols).alias("_a"))
    b = new.filter(F.col(key).isNotNull()).select(key, F.struct(*cols).alias("_b"))
    fixed = F.lit(keep_permanent) & F.coalesce(F.col("_a.permanent"), F.lit(False))
    x = a.join(b, key, "full")
    if mode == "skip":
        row = F.coalesce("_a", "_b")
    elif mode == "merge":
        how = MERGED if merged is None else merged
        both = F.struct(*[(how[c](F.col(f"_a.{c}"), F.col(f"_b.{c}")) if c in how else F.col(f"_a.{c}")).cast(old.schema[c].dataType).alias(c) for c in cols])
        row = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull() | fixed, F.col("_a")).otherwise(both)
    else:
        row = F.when(fixed | F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_b"))
        if mode == "reset":
            x = x.filter(fixed | F.col("_b").isNotNull())
    return x.select(key, row.alias("_r")).select(key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return initialise(old, new, key, "overwrite", keep_permanent=False)


def active_since(df: DataFrame, at: str, since, keep_permanent: bool = True) -> DataFrame:
    """Without rows last updated before ``since``; permanent ones may stay.  A null time counts as old."""
    fresh = F.coalesce(F.col(at) >= since, F.lit(False))
    return df.filter(fresh | (F.lit(keep_permanent) & F.coalesce(F.col("permanent"), F.lit(False))))


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, that of the greatest ``seq``; an aggregate, so it shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    return df.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_m")).select(*keys, "_m.*")


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: str | None = None, unit: bool = False) -> DataFrame:
    """Element-wise (weighted) mean per key: ``keys, v array<double>``; vectors of another length than the first position's count drop out per position.

    One partial aggregate per (key, position): a hot key is spread over as many groups as its vectors are long.
    """
    from cadenza.functions.vectors import is_finite, l2

    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = df.filter(is_finite(F.col(vector)) & (F.size(vector) > 0)).select(*keys, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    x = x.groupBy(*keys, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])
    out = x.groupBy(*keys).agg(v.alias("v"))
    return out.withColumn("v", l2(F.col("v"))) if unit else out


def registry_stats(df: DataFrame) -> DataFrame:
    """Number, total duration, confidence min(1, updates / n / 10) and rows that were ever updated."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.sum("duration").alias("duration"), F.least(F.lit(1.0), F.coalesce(F.sum("update_count"), F.lit(0)) / F.greatest(n, F.lit(1)) / 10).alias("confidence"), F.count_if(F.col("update_count") > 0).alias("updated"))


def assignment_rule(distance, duration, near: float = 0.2, far: float = 0.65, least: float = 1.0):
    """Why a voice is assigned or not, as text."""
    return (F.when(distance < near, F.lit("confident")).when((distance < far) & (duration >= least), F.lit("assign"))
            .when(duration < least, F.lit("too short")).otherwise(F.lit("new")))


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a stored result: what a resumed run still has to do."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")
