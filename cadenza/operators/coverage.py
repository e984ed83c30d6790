"""Continuous periods and gaps of overlapping intervals, merged in two levels.

Level one clips every interval into fixed time shards and merges inside
(entity, shard), so an entity that holds a third of all rows is spread over as
many tasks as it has shards.  Level two sees one summary row per shard, stitches
the coverage that touches shard boundaries and coalesces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order``.

    Partial aggregation runs before the shuffle.  Rows whose key is null are
    kept as they are (nothing says that two of them are the same).  A null
    ``order`` ranks lowest; rows tied on it are resolved by the greatest values.
    """
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])).alias("_b")
    return df.select(key, order, *columns).groupBy(own.alias("_k")).agg(best).select(*[F.col(f"_b.{c}").alias(c) for c in columns])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, shard: int = 60_000) -> DataFrame:
    """Maximal covered stretches (``period``) and the stretches between them (``gap``).

    ``start`` and ``end`` are whole numbers; touching intervals join.  Returns
    ``keys, kind, start, end``.

    * rows with a null key, null bound or ``end <= start`` don't count;
    * repeated rows and ties change nothing; an empty table gives an empty result;
    * extra columns are ignored, whatever their names;
    * an interval longer than ``shard`` is clipped into one row per shard.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    s, e = F.col("_s"), F.col("_e")
    clean = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    for k in ks:
        clean = clean.filter(F.col(k).isNotNull())
    clean = clean.filter(s.isNotNull() & e.isNotNull() & (e > s))

    # level one: clip, merge inside a shard; one exchange serves all that follows up to the summaries
    first, last = F.floor(s / shard), F.floor((e - 1) / shard)
    cut = clean.select(*ks, "_s", "_e", F.explode(F.sequence(first, last)).alias("_h"))
    cut = cut.select(*ks, "_h", F.greatest(s, F.col("_h") * shard).alias("_s"), F.least(e, (F.col("_h") + 1) * shard).alias("_e"))
    cut = cut.repartition(*ks, "_h").groupBy(*ks, "_h", "_s").agg(F.max("_e").alias("_e"))
    local = W.partitionBy(*ks, "_h").orderBy("_s")
    seen = F.max("_e").over(local.rowsBetween(W.unboundedPreceding, -1))
    cut = cut.withColumn("_new", F.when(seen.isNull() | (s > seen), 1).otherwise(0))
    cut = cut.withColumn("_i", F.sum("_new").over(local.rowsBetween(W.unboundedPreceding, 0)))
    piece = cut.groupBy(*ks, "_h", "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    order = W.partitionBy(*ks, "_h").orderBy("_i")
    piece = piece.withColumn("_pe", F.lag("_e").over(order)).withColumn("_ns", F.lead("_s").over(order))

    def rows(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))

    # pieces that are neither the first nor the last of their shard are final; so are gaps inside it
    inner = F.col("_pe").isNotNull()
    done = piece.select(*ks, F.explode(F.array_compact(F.array(
        F.when(inner & F.col("_ns").isNotNull(), rows("period", s, e)),
        F.when(inner, rows("gap", F.col("_pe"), s)),
    ))).alias("_r"))

    # level two: one summary row per shard
    shards = piece.groupBy(*ks, "_h").agg(
        F.min("_s").alias("_fs"), F.min("_e").alias("_fe"), F.max("_s").alias("_ls"), F.max("_e").alias("_le"), F.count(F.lit(1)).alias("_n"))
    across = W.partitionBy(*ks).orderBy("_h")
    shards = shards.withColumn("_pe", F.lag("_le").over(across)).withColumn("_ns", F.lead("_fs").over(across))
    link = F.coalesce(F.col("_fs") == F.col("_pe"), F.lit(False))
    shards = shards.withColumn("_link", link)
    # start of the period that is open at the end of a shard
    own = F.when((F.col("_n") > 1) | ~F.col("_link"), F.col("_ls"))
    shards = shards.withColumn("_open", F.last(own, ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, 0)))
    shards = shards.withColumn("_prev", F.last(own, ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)))
    goes_on = F.coalesce(F.col("_ns") == F.col("_le"), F.lit(False))
    stitched = shards.select(*ks, F.explode(F.array_compact(F.array(
        F.when(F.col("_n") > 1, rows("period", F.when(F.col("_link"), F.col("_prev")).otherwise(F.col("_fs")), F.col("_fe"))),
        F.when(~goes_on, rows("period", F.col("_open"), F.col("_le"))),
        F.when(F.col("_pe").isNotNull() & ~F.col("_link"), rows("gap", F.col("_pe"), F.col("_fs"))),
    ))).alias("_r"))
    both = done.unionByName(stitched)
    return both.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], F.col("_r.kind").alias("kind"), F.col("_r.start").alias("start"), F.col("_r.end").alias("end"))


def speaking_periods(segments: DataFrame, shard: int = 60_000) -> DataFrame:
    """Speaking periods and gaps per recording and speaker, in hundredths of a second.

    Of an utterance only its latest row counts.  Speaker ids are trimmed and put
    in upper case.  Rows without recording, speaker or time (null, NaN or
    infinite), or with an end not after the start once rounded, don't count.
    """
    rows = latest_by(segments, "utterance_id", "logged_at", ["recording_id", "speaker_id", "start_time", "end_time"])
    speaker = F.upper(F.regexp_replace("speaker_id", r"^\s+|\s+$", ""))
    rows = rows.filter(finite(F.col("start_time")) & finite(F.col("end_time"))).select(
        "recording_id", F.when(speaker != "", speaker).alias("speaker_id"),
        F.round(F.col("start_time") * 100).cast("long").alias("s"), F.round(F.col("end_time") * 100).cast("long").alias("e"))
    out = periods_and_gaps(rows, ["recording_id", "speaker_id"], "s", "e", shard)
    return out.select("recording_id", "speaker_id", "kind", F.col("start").alias("start_cs"), F.col("end").alias("end_cs"))


def coverage_totals(periods: DataFrame) -> DataFrame:
    """Per recording and speaker: number and length of periods and gaps, and the share covered."""
    kind, length = F.col("kind"), F.col("end_cs") - F.col("start_cs")
    return periods.groupBy("recording_id", "speaker_id").agg(
        F.sum(F.when(kind == "period", 1).otherwise(0)).alias("n_periods"),
        F.sum(F.when(kind == "period", length).otherwise(0)).alias("spoken_cs"),
        F.sum(F.when(kind == "gap", 1).otherwise(0)).alias("n_gaps"),
        F.sum(F.when(kind == "gap", length).otherwise(0)).alias("silent_cs"),
    )
