"""Interval algebra on whole-number bounds: joins, clips, complements, sweeps and clean-ups.

Merging reuses the two-level coverage operator.  Interval joins cut both sides
into bins and join on (key, bin): an equi-join that Spark can shuffle, sort and
split where it is skewed; each overlapping pair is kept only in the bin where its
overlap begins.  Every operator ignores rows with null keys or bounds and empty
intervals, and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.coverage import finite, latest_by, periods_and_gaps
from cadenza.operators.sharded import centred_sums, highest_before, running_sum, with_neighbours

BIN = 60_000


def clean_segments(segments: DataFrame) -> DataFrame:
    """Utterances that count: ``rec, spk, s, e`` in hundredths of a second, the latest row of each utterance."""
    rows = latest_by(segments, "utterance_id", "logged_at", ["recording_id", "speaker_id", "start_time", "end_time"])
    spk = F.upper(F.regexp_replace("speaker_id", r"^\s+|\s+$", ""))
    rows = rows.filter(finite(F.col("start_time")) & finite(F.col("end_time"))).select(
        F.col("recording_id").alias("rec"), F.when(spk != "", spk).alias("spk"),
        F.round(F.col("start_time") * 100).cast("long").alias("s"), F.round(F.col("end_time") * 100).cast("long").alias("e"))
    return rows.filter("rec IS NOT NULL AND spk IS NOT NULL AND e > s")


def merged(df: DataFrame, keys: list[str], shard: int = BIN) -> DataFrame:
    """Union of intervals per key: ``keys, s, e``; touching ones join."""
    return periods_and_gaps(df, keys, "s", "e", shard).filter("kind = 'period'").select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    return merged(df, keys).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("covered"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of intervals that overlap, with bounds ``s, e`` of the overlap.

    Columns of the left side are kept as they are but ``s, e``, which become
    ``ls, le``; of the right side ``s, e`` become ``rs, re``.
    """
    def binned(df, s, e):
        own = df.filter("s IS NOT NULL AND e > s").withColumnsRenamed({"s": s, "e": e})
        return own.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    both = binned(left, "ls", "le").join(binned(right, "rs", "re"), [*keys, "bin"])
    both = both.withColumn("s", F.greatest("ls", "rs")).withColumn("e", F.least("le", "re"))
    return both.filter((F.col("s") < F.col("e")) & (F.floor(F.col("s") / width) == F.col("bin"))).drop("bin")


def clip(df: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Each interval cut to each window it overlaps."""
    return overlap_join(df, windows, keys).drop("ls", "le", "rs", "re")


def overlap_length(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Total overlap per ``by``; each side should be merged first, else overlaps inside a side count again."""
    return overlap_join(left, right, keys).groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("overlap"))


def subtract(domain: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """``domain`` (one interval per key: ``s, e``) less all ``holes``: the gaps that the holes, clipped, leave between sentinels at both ends."""
    inner = overlap_join(domain, holes, keys).select(*keys, "s", "e")
    d = domain.filter("s IS NOT NULL AND e > s")
    ends = d.select(*keys, (F.col("s") - 1).alias("s"), F.col("s").alias("e")).unionByName(d.select(*keys, F.col("e").alias("s"), (F.col("e") + 1).alias("e")))
    rest = periods_and_gaps(inner.unionByName(ends), keys, "s", "e", BIN).filter("kind = 'gap'")
    return rest.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))


def active_slices(df: DataFrame, width: int = BIN) -> DataFrame:
    """Sweep line over ``rec, spk, s, e``: slices between boundaries with the number of active speakers.

    Returns ``rec, s, e, active, code``; ``code`` xors the hashes of the active speakers, so with one active it is that speaker's.
    Sharded by time: a shard needs only the totals of the shards before it.
    """
    own = merged(df, ["rec", "spk"])
    code = F.xxhash64("spk")
    steps = own.select("rec", F.explode(F.array(
        F.struct(F.col("s").alias("t"), F.lit(1).alias("d"), code.alias("c")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d"), code.alias("c")))).alias("x")).select("rec", "x.*")
    steps = steps.groupBy("rec", "t").agg(F.sum("d").alias("d"), F.expr("bit_xor(c)").alias("c")).withColumn("h", F.floor(F.col("t") / width))
    inside = W.partitionBy("rec", "h").orderBy("t")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumn("n", F.sum("d").over(upto)).withColumn("x", F.expr("bit_xor(c)").over(upto)).withColumn("e", F.lead("t").over(inside))
    total = steps.groupBy("rec", "h").agg(F.sum("d").alias("d"), F.expr("bit_xor(c)").alias("c"), F.min("t").alias("t0"))
    before = W.partitionBy("rec").orderBy("h")
    total = total.select("rec", "h", F.lead("t0").over(before).alias("t1"),
                         F.coalesce(F.sum("d").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n0"),
                         F.coalesce(F.expr("bit_xor(c)").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("x0"))
    s = steps.join(total, ["rec", "h"])
    return s.select("rec", F.col("t").alias("s"), F.coalesce("e", "t1").alias("e"), (F.col("n") + F.col("n0")).alias("active"), F.col("x").bitwiseXOR(F.col("x0")).alias("code")).filter("e IS NOT NULL AND active > 0")


def single_speaker(df: DataFrame) -> DataFrame:
    """Stretches with exactly one active speaker: ``rec, spk, s, e``, neighbouring slices of a speaker joined."""
    names = df.select("rec", "spk", F.xxhash64("spk").alias("code")).distinct()
    one = active_slices(df).filter("active = 1").join(names, ["rec", "code"])
    return merged(one.select("rec", "spk", "s", "e"), ["rec", "spk"])


def overlapped(df: DataFrame) -> DataFrame:
    """Stretches with more than one active speaker: ``rec, s, e``."""
    return merged(active_slices(df).filter("active > 1").select("rec", "s", "e"), ["rec"])


def collar_trim(df: DataFrame, collar: int) -> tuple[DataFrame, DataFrame]:
    """Segments shrunk by ``collar`` at both sides, and the removed zones around their ends (to be left out of scoring)."""
    kept = df.withColumn("s", F.col("s") + collar).withColumn("e", F.col("e") - collar).filter("e > s")
    zones = df.select("rec", F.explode(F.array(
        F.struct((F.col("s") - collar).alias("s"), (F.col("s") + collar).alias("e")), F.struct((F.col("e") - collar).alias("s"), (F.col("e") + collar).alias("e")))).alias("z")).select("rec", "z.s", "z.e")
    return kept, merged(zones, ["rec"])


def bridge_gaps(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merge per key over gaps of at most ``gap``: merging intervals that are longer by ``gap``."""
    longer = df.withColumn("e", F.col("e") + gap)
    return merged(longer, keys).withColumn("e", F.col("e") - gap)


def bridge_same_speaker(df: DataFrame, gap: int) -> DataFrame:
    """In order of start over all speakers, neighbouring rows of one speaker merge over gaps of at most ``gap``; another speaker in between keeps them apart.

    Returns ``rec, spk, s, e, parts``; rows tied on their start are ordered by end and speaker.
    """
    order = ["s", "e", "spk", "_id"]
    x = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_h", F.floor(F.col("s") / BIN))  # like rows are told apart
    x = with_neighbours(x, ["rec"], "_h", order, before={"_last": "spk"})
    x = running_sum(x, ["rec"], "_h", order, F.when(F.col("_last") == F.col("spk"), 0).otherwise(1), "turn")
    run = W.partitionBy("rec", "turn").orderBy("s", "e")
    seen = F.max("e").over(run.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("part", F.when(seen.isNull() | (F.col("s") - seen > gap), 1).otherwise(0))
    x = x.withColumn("part", F.sum("part").over(run.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("rec", "turn", "part", "spk").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("parts")).drop("turn", "part")


def quantised_union(df: DataFrame, frame: int) -> DataFrame:
    """Bounds rounded half to even to whole frames, empty ones dropped, union per speaker: ``rec, spk, first, last``."""
    q = df.select("rec", "spk", F.bround(F.col("s") / frame).cast("long").alias("s"), F.bround(F.col("e") / frame).cast("long").alias("e")).filter("e > s")
    return merged(q, ["rec", "spk"]).withColumnsRenamed({"s": "first", "e": "last"})


def without_overlap(df: DataFrame, least: int, shard: int = 60_000) -> DataFrame:
    """In order of start a segment begins no earlier than the last kept one ends; pieces shorter than ``least`` are dropped and don't move that end.

    What is kept depends on what was kept before, but only as far as segments overlap: where one begins after all before it
    have ended, a new island begins.  Islands come from running maxima by time shards; each is a fold of its own.
    Returns ``rec, spk, s, e, share`` with the share of the segment that is left.
    """
    from cadenza.operators.sessions import fold

    x = df.select("rec", "spk", "s", "e", F.monotonically_increasing_id().alias("_id")).withColumn("_h", F.floor(F.col("s") / shard))
    order = ["s", "e", "spk", "_id"]
    x = highest_before(x, ["rec"], "_h", order, F.col("e"), "_top")
    x = running_sum(x, ["rec"], "_h", order, F.when(F.col("_top").isNull() | (F.col("s") >= F.col("_top")), 1).otherwise(0), "_island")
    islands = x.groupBy("rec", "_island").agg(F.array_sort(F.collect_list(F.struct("s", "e", "spk"))).alias("r")).select("rec", "r")

    def keep(row):
        end = None
        for s, e, spk in ((t["s"], t["e"], t["spk"]) for t in row["r"]):
            start = s if end is None else max(s, end)
            if e - start >= least:
                end = e
                yield (spk, start, e, (e - start) / (e - s) if e > s else None)

    return fold(islands, ["rec"], "spk string, s long, e long, share double", keep)


def runs(df: DataFrame, keys: list[str], at: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive whole numbers ``at`` with the flag set: ``keys, first, last`` (last exclusive); copies count once.

    A run is a union of unit intervals, so it is merged by shards like any other.
    """
    unit = df.filter(flag).select(*keys, F.col(at).cast("long").alias("s"), (F.col(at).cast("long") + 1).alias("e"))
    return merged(unit, keys).withColumnsRenamed({"s": "first", "e": "last"})


def majority(df: DataFrame, keys: list[str], at: str, flag: Column, half: int) -> DataFrame:
    """Centred majority filter, cut off at the ends: set if at least half the rows within ``half`` rows are set."""
    x = df.withColumn("_h", F.floor(F.col(at) / 4096))
    x = centred_sums(x, keys, "_h", [at], half, {"_on": F.when(flag, 1).otherwise(0), "_all": F.lit(1)})
    return x.withColumn("on", 2 * F.col("_on") >= F.col("_all")).drop("_h", "_on", "_all")
