"""Segments from frame signals: hysteresis, padding, bridging, length limits, top-n per frame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.intervals import bridge_gaps, merged, runs
from cadenza.operators.sharded import last_known, running_sum

RATE, FRAME = 16_000, 4096


def per_key(df: DataFrame, keys: list[str], order: str, fields: list[str], block: int = 4096) -> DataFrame:
    """One row per key with ``fields`` as arrays in order; built in two levels, by blocks of ``order`` (a whole number) first.

    For folds that no window can express.  A block is bounded by ``block`` positions (copies of a position: the
    greatest row counts), and a key is held as bare numbers only.
    """
    x = df.filter(F.col(order).isNotNull()).groupBy(*keys, order).agg(F.max(F.struct(*fields)).alias("_v"))
    x = x.groupBy(*keys, F.floor(F.col(order) / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(order, "_v"))).alias("_x"))
    x = x.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_x"))), lambda b: b["_x"])).alias("_x"))
    return x.select(*keys, F.transform("_x", lambda r: r[order]).alias(order), *[_field(f).alias(f) for f in fields])


def _field(name: str) -> Column:
    return F.transform("_x", lambda r: r["_v"][name])


def fold(df: DataFrame, keys: list[str], schema: str, fn) -> DataFrame:
    """Apply ``fn(row as dict) -> iterable of tuples`` to each row in Arrow batches; its tuples are put after the keys."""
    types = dict(df.dtypes)
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + schema

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            made, source = [], []
            for i in range(batch.num_rows):
                before = len(made)
                made += fn({n: c[i] for n, c in cols.items()})
                source += [i] * (len(made) - before)
            at = pa.array(source, pa.int64())
            own = [pa.array(list(c), f.type) for c, f in zip(zip(*made) if made else [[]] * (len(arrow) - len(keys)), list(arrow)[len(keys):])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at).cast(arrow.field(k).type) for k in keys), *own], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)
    return df.mapInArrow(run, out)


def hysteresis(df: DataFrame, keys: list[str], at: str, value: str, onset: float, offset: float) -> DataFrame:
    """Adds ``on``: set from a value above ``onset`` while values are at least ``offset``.  Null and NaN values change nothing."""
    v = F.col(value)
    mark = F.when(v.isNull() | F.isnan(v), None).when(v > onset, True).when(v < offset, False)
    x = last_known(df.withColumn("_h", F.floor(F.col(at) / 4096)), keys, "_h", [at], mark, "on").drop("_h")
    return x.withColumn("on", F.coalesce("on", F.lit(False)))


def hysteresis_segments(df: DataFrame, keys: list[str], at: str, value: str, onset: float, offset: float) -> DataFrame:
    """``keys, first, last`` of stretches that are on; frames that are missing end a stretch."""
    return runs(hysteresis(df, keys, at, value, onset, offset), keys, at, F.col("on"))


def timeline(df: DataFrame, keys: list[str], at: str, value: str, onset: float = 0.5, offset: float = 0.5, pad_on: int = 0, pad_off: int = 0, min_on: int = 0, min_off: int = 0) -> DataFrame:
    """Speaking segments: hysteresis, padding, pieces shorter than both pads and ``min_on`` dropped, gaps of at most ``min_off`` bridged."""
    piece = hysteresis_segments(df, keys, at, value, onset, offset)
    piece = piece.select(*keys, (F.col("first") - pad_on).alias("s"), (F.col("last") + pad_off).alias("e")).filter(F.col("e") - F.col("s") >= pad_on + pad_off + min_on)
    return bridge_gaps(piece, keys, min_off).withColumnsRenamed({"s": "first", "e": "last"})


def split_timeline(df: DataFrame, keys: list[str], end: Column, held: int) -> DataFrame:
    """Marks segments that nothing later can change: those that end more than ``held`` frames before the stream's ``end``."""
    return df.withColumn("final", F.col("last") < end - held)


def crowd_aware(df: DataFrame, rec: str, speaker: str, frame: str, activity: str, alone: float = 0.3, crowded: float = 0.15, least: int = 1) -> DataFrame:
    """Runs of active frames per speaker; the threshold falls to ``crowded`` where another speaker exceeds ``alone`` in the same frame."""
    per = W.partitionBy(rec, frame)
    loud = F.when(F.col(activity) > alone, 1).otherwise(0)
    others = F.sum(loud).over(per) - loud
    x = df.withColumn("on", F.col(activity) > F.when(others > 0, crowded).otherwise(alone))
    return runs(x, [rec, speaker], frame, F.col("on")).filter(F.col("last") - F.col("first") >= least)


def powerset_speakers(scores: Column, classes: list[list[int]]) -> Column:
    """Speakers of the greatest class (first on ties) of a frame's scores."""
    best = F.array_position(scores, F.array_max(scores))
    return F.element_at(F.array(*[F.array(*[F.lit(i) for i in c]).cast("array<int>") for c in classes]), best.cast("int"))


def top_per_frame(df: DataFrame, rec: str, frame: str, cluster: str, value: str, expected: str) -> DataFrame:
    """In each frame the clusters with the greatest sums, as many as the mean expected count says (rounded half to even, at most those there; smaller cluster on ties), as runs.

    ``value`` counts only above 0.  Returns ``rec, cluster, s, e, quality`` with quality the clamped mean of the averages.
    """
    x = df.filter(F.col(value) > 0).groupBy(rec, frame, cluster).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    n = df.groupBy(rec, frame).agg(F.bround(F.avg(expected)).alias("n"))
    rank = F.row_number().over(W.partitionBy(rec, frame).orderBy(F.desc("sum"), cluster))
    kept = x.withColumn("r", rank).join(n, [rec, frame]).filter(F.col("r") <= F.col("n"))
    kept = running_sum(kept.withColumn("_h", F.floor(F.col(frame) / 4096)), [rec, cluster], "_h", [frame], F.lit(1), "g").withColumn("g", F.col(frame) - F.col("g"))
    return kept.groupBy(rec, cluster, "g").agg(F.min(frame).alias("s"), (F.max(frame) + 1).alias("e"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("mean"))).alias("quality")).drop("g")


@dataclass(frozen=True)
class VadConfig:
    """Seconds and thresholds of speech segmentation."""

    threshold: float = 0.85
    min_speech: float = 0.15
    min_silence: float = 0.75
    max_speech: float = 14.0
    pad: float = 0.1
    split_below: float = 0.3
    negative: float | None = None
    offset: float = 0.15
    min_silence_at_max: float = 0.098
    longest_at_max: bool = True

    def thresholds(self) -> tuple[float, float]:
        if self.negative is not None:
            return min(1.0, self.negative + self.offset), self.negative
        return self.threshold, max(self.threshold - self.offset, 0.01)


def speech_ranges(probs, total: int, c: VadConfig = VadConfig()) -> list[tuple[int, int]]:
    """Sample ranges of speech in one clip.

    Speech opens at the positive threshold and closes where a silence (below the negative one) has lasted long
    enough, at that silence's begin.  Overlong speech is cut at the best silence met: the longest of those quiet
    enough, else the longest (or last) of all, else at once.

    Works on the frames above and below the thresholds only, and goes from one silence or cut to the next.
    """
    up, down = c.thresholds()
    p = np.nan_to_num(np.array([0.0 if x is None else x for x in probs], float), nan=0.0) if isinstance(probs, list) else np.nan_to_num(probs, nan=0.0)
    loud, soft, n = np.flatnonzero(p >= up), np.flatnonzero(p < down), len(p)
    hold, pad = -(-int(c.min_silence * RATE) // FRAME), int(c.pad * RATE)
    brief = int(c.min_silence_at_max * RATE)
    most = max(0, int(c.max_speech * RATE) - FRAME - 2 * pad) // FRAME + 1 if c.max_speech != float("inf") else n + 1

    def following(frames, i: int) -> int:
        """The first of ``frames`` after i; n if there is none."""
        k = np.searchsorted(frames, i, "right")
        return int(frames[k]) if k < len(frames) else n

    ranges: list[tuple[int, int]] = []
    begin = following(loud, -1)
    while begin < n:
        seen = checked = begin  # frames of this stretch that are dealt with; the last one held against the longest allowed
        pauses: list[tuple[int, int]] = []  # (first frame, first loud frame after it)
        while True:
            over = max(begin + most, checked + 1)
            hush = following(soft, seen)
            back, ended = following(loud, hush), following(soft, hush + hold - 1)
            if hush < n and ended < min(back, over, n):  # a silence has lasted
                ranges.append((begin, hush))
                begin = back
                break
            if hush < n and back <= min(over, n - 1):  # a pause within speech
                if (back - hush) * FRAME > brief:
                    pauses.append((hush, back))
                seen = back
                if back < over:
                    continue
            if over >= n:  # speech goes on to the end
                ranges.append((begin, -1))
                begin = n
                break
            calm = [x for x in pauses if p[x[0] : x[1]][p[x[0] : x[1]] < down].min() <= c.split_below]
            if not pauses:
                ranges.append((begin, over))
                begin = following(loud, over)
                break
            at, back = max(calm or pauses, key=lambda x: (x[1] - x[0], -x[0])) if calm or c.longest_at_max else pauses[-1]
            ranges.append((begin, at))
            if back >= over:
                begin = following(loud, over)
                break
            begin, seen, checked, pauses = back, over - 1, over, []
    found = np.array([(a * FRAME, total if z < 0 else min(z * FRAME, total)) for a, z in ranges], np.int64).reshape(-1, 2)
    length = found[:, 1] - found[:, 0]
    found = found[(length >= int(c.min_speech * RATE)) & (length > 0)]
    if not len(found):
        return []
    # padding: neighbours closer than two pads share the gap
    gap = found[1:, 0] - found[:-1, 1]
    share = np.where(gap >= 2 * pad, pad, gap // 2)
    first = found[:, 0] - np.append(min(pad, found[0, 0]), share)
    last = found[:, 1] + np.append(share, min(pad, total - found[-1, 1]))
    return [(int(a), int(z)) for a, z in zip(first, last) if z > a]


def vad_segments(frames: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    """Speech of every clip: ``clip, seg, first, last`` in samples.  Missing frames count as silent; null probabilities too."""
    rows = per_key(frames.filter("clip IS NOT NULL"), ["clip"], "frame", ["prob"])

    def cut(row):
        at, value = np.array(row["frame"], np.int64), np.array([0.0 if x is None else x for x in row["prob"]], float)
        probs = np.zeros(max(0, at[-1] + 1) if len(at) else 0)
        probs[at[at >= 0]] = value[at >= 0]
        return [(i, a, b) for i, (a, b) in enumerate(speech_ranges(probs, len(probs) * FRAME, config))]

    return fold(rows, ["clip"], "seg int, first long, last long", cut)
