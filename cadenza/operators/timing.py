"""Windows and timings: chunk plans, token and word times, collapses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.sessions import fold, per_key
from cadenza.operators.sharded import running_sum, with_neighbours

TOKEN_FRAME = 0.08
SAMPLES = 1280
SHARD = 4096  # frames of a key in one task
MARK = "▁"


def regular_chunks(df: DataFrame, key: str, total: str, stride: int) -> DataFrame:
    """Starts 0, stride, 2 stride, ... below the total (0 for an empty clip)."""
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col(total) - 1) / stride))
    return df.select(key, F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * stride))).withColumnsRenamed({"pos": "chunk", "col": "start"})


def hops(df: DataFrame, key: str, total: str, chunk: int, overlap: int) -> DataFrame:
    """Sliding windows of ``chunk`` with ``overlap``; the last one is short."""
    return regular_chunks(df, key, total, chunk - overlap).join(df.select(key, F.col(total).alias("_t")), key).select(
        key, "chunk", "start", F.least(F.col("start") + chunk, F.col("_t")).alias("end"))


def context_windows(df: DataFrame, key: str, total: str, left: int, centre: int, right: int) -> DataFrame:
    """Centres advance by ``centre``; a window reaches ``left`` back and ``right`` on, within the clip."""
    x = regular_chunks(df, key, total, centre).join(df.select(key, F.col(total).alias("_t")), key)
    c = F.col("start")
    return x.select(key, "chunk", F.greatest(F.lit(0).cast("long"), c - left).alias("first"), c.alias("centre"), F.least(c + centre + right, F.col("_t")).alias("last"))


def frame_seconds(frame: Column, start: float, step: float) -> Column:
    return F.lit(start) + frame * F.lit(step)


def token_times(df: DataFrame, keys: list[str], delay: int = 1) -> DataFrame:
    """``s, e`` seconds of tokens in order of time: the emission delay is taken off; the end is the token's own duration, else the next start, at least one frame on."""
    order = ["ts", "chunk", "pos"]
    x = with_neighbours(df.withColumn("_h", F.floor(F.col("ts") / SHARD)), keys, "_h", order, after={"_next": "ts"})
    at = F.greatest(F.lit(0), F.col("ts") - delay)
    nxt = F.when(F.col("_next").isNotNull(), F.greatest(F.lit(0), F.col("_next") - delay))
    end = F.when(F.col("dur") > 0, at + F.col("dur")).otherwise(F.greatest(F.coalesce(nxt, at + 1), at + 1))
    return x.select(*df.columns, (at * TOKEN_FRAME).alias("s"), (end * TOKEN_FRAME).alias("e"))


def prefix_times(df: DataFrame, keys: list[str], order: list[str], frames: str, seconds: float) -> DataFrame:
    """Start and end from a running sum of frame counts; the first of ``order`` is a whole number that spreads a key."""
    x = running_sum(df.withColumn("_h", F.floor(F.col(order[0]) / 16)), keys, "_h", order, F.col(frames), "_upto")
    return x.select(*df.columns, ((F.col("_upto") - F.col(frames)) * seconds).alias("s"), (F.col("_upto") * seconds).alias("e"))


def starts_word(piece: Column) -> Column:
    return piece.startswith(MARK) | piece.startswith(" ")


def bare(piece: Column) -> Column:
    """Without a leading word mark."""
    return F.when(starts_word(piece), F.substring(piece, 2, 1 << 20)).otherwise(piece)


def words(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Words from pieces with ``s, e, conf``: ``keys, word_no, word, s, e, mean_conf, least_conf``.

    A piece with a word mark opens a word, as does the first; null, empty, ``<blank>`` and ``<pad>`` pieces are left out.
    """
    x = df.filter(F.col("piece").isNotNull() & ~F.col("piece").isin("", "<blank>", "<pad>"))
    x = with_neighbours(x.withColumn("_h", F.floor(F.col(order[0]) / SHARD)), keys, "_h", order, before={"_last": "piece"})
    x = running_sum(x, keys, "_h", order, F.when(starts_word(F.col("piece")) | F.col("_last").isNull(), 1).otherwise(0), "word_no")
    x = x.withColumn("n", F.struct(*order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", bare(F.col("piece")).alias("p")))), lambda r: r["p"]), "")
    g = x.groupBy(*keys, "word_no").agg(F.trim(text).alias("word"), F.min("s").alias("s"), F.max(F.struct("n", "e"))["e"].alias("e"), F.avg("conf").alias("mean_conf"), F.min("conf").alias("least_conf"))
    return g.filter("word <> ''")


def collapse_repeats(df: DataFrame, keys: list[str], at: list[str], label: str, blank: int) -> DataFrame:
    """Greedy collapse of frame labels: rows that aren't blank and differ from the frame before, blank or not."""
    x = with_neighbours(df.withColumn("_h", F.floor(F.col(at[0]) / SHARD)), keys, "_h", at, before={"_b": label})
    return x.filter((F.col(label) != blank) & (F.col("_b").isNull() | (F.col("_b") != F.col(label)))).select(*df.columns)


#: How far from its target a start is drawn (seconds), and the share of the upper median energy there that it may have.
DRAWN = ((4.0, 0.05), (0.5, 0.35))


def aligned_starts(total: int, level: np.ndarray, settled: np.ndarray | None, stride: int, chunk: int, rate: int = 16_000, keep: int = 6, speech: float = 0.8) -> list[tuple[int, bool]]:
    """(start, whether it needs a warm-up prefix) of a clip's chunks; ``level`` is the energy by encoder frame, NaN where unknown.

    A start may lie after the last one and up to ``keep`` frames before that chunk's end.  With ``settled`` (whether some
    quiet follows a frame) a deep silence that quickly turns to speech is begun with a prefix; not if the start is drawn back
    and both its target and the latest end of the next chunk lie in speech, as the chunk would end in the middle of it.
    """
    starts, frames = [(0, False)], min(len(level), (total - 1) // SAMPLES + 1)
    for target in range(stride, total, stride):
        last, middle = starts[-1][0], target // SAMPLES
        latest = last + chunk - keep * SAMPLES
        start, warm = min(max(middle * SAMPLES, last + SAMPLES), latest), False
        for deep, (radius, share) in zip((True, False), DRAWN):
            reach = max(1, int(radius * rate / SAMPLES))
            a, z = max(1, middle - reach, last // SAMPLES + 1), min(frames, middle + reach + 1, latest // SAMPLES + 1)
            near = level[a:z] if a < z else level[:0]
            known = np.sort(near[~np.isnan(near)])
            if not len(known) or known[0] > share * max(0.0, known[len(known) // 2]):
                continue
            at, median = a + int(np.nanargmin(near)), known[len(known) // 2]
            restless = deep and settled is not None and not settled[at]
            if restless and at * SAMPLES < start and median > 0:
                ends = (start, at * SAMPLES + chunk - keep * SAMPLES)
                if ends[1] < total and all(e // SAMPLES < frames and level[e // SAMPLES] > speech * median for e in ends):
                    break
            start, warm = at * SAMPLES, restless
            break
        starts.append((start, warm) if start > last else (min(last + stride, total), False))
    return starts


def silence_aligned_starts(clips: DataFrame, energy: DataFrame, stride: int, chunk: int, warm_up: bool = False) -> DataFrame:
    """Chunk starts drawn to quiet frames: ``clip, chunk, start``, with ``warm_up`` also ``prefix``.

    ``clips(clip, total)`` in samples, ``energy(clip, frame, value)`` by encoder frame, with ``warm_up`` also ``settled``:
    whether 0.2 s of quiet follow within half a second.  Sequential, as each start bounds the next; a clip is held as numbers.
    """
    fields = ["value", "settled"] if warm_up else ["value"]
    rows = clips.join(per_key(energy, ["clip"], "frame", fields), "clip", "left")

    def plan(row):
        at = np.array(row["frame"] or [], np.int64)
        level, settled = np.full(at[-1] + 1 if len(at) else 0, np.nan), np.zeros(at[-1] + 1 if len(at) else 0, bool)
        level[at[at >= 0]] = np.array([np.nan if v is None else v for v in row["value"] or []], float)[at >= 0]
        if warm_up:
            settled[at[at >= 0]] = np.array([bool(v) for v in row["settled"] or []], bool)[at >= 0]
        for n, (start, prefix) in enumerate(aligned_starts(row["total"], level, settled if warm_up else None, stride, chunk)):
            yield (n, start, prefix) if warm_up else (n, start)

    return fold(rows, ["clip"], "chunk int, start long" + ", prefix boolean" * warm_up, plan)


def drop_seam_words(tokens: DataFrame, overlap: int) -> DataFrame:
    """Of neighbouring words that differ in case only and start at most ``overlap`` frames apart, one is dropped.

    Each word meets the last *kept* one; the lower-case copy stays, else the earlier.  A word before the end of a
    sentence is never matched.  ``tokens(clip, n, piece, ts)``; returns ``clip, n`` of the kept tokens.
    """
    rows = per_key(tokens, ["clip"], "n", ["piece", "ts"])

    def collapse(row):
        words = []  # [positions, text, start]
        for n, piece, ts in zip(row["n"], row["piece"], row["ts"]):
            piece = piece or ""
            marked = piece[:1] in (MARK, " ")
            if marked or not words:
                words.append([[], "", ts])
            words[-1][0].append(n)
            words[-1][1] += piece[1:] if marked else piece
        kept = []
        for at, text, ts in words:
            core = text.strip(" \t\n.,;:!?\"'()-…")
            if kept:
                _, old, old_core, old_ts = kept[-1]
                twin = old_core and core and old_core != core and old_core.lower() == core.lower() and core[0].isalpha() and not old.endswith((".", "?", "!", ":")) and ts - old_ts <= overlap
                if twin:
                    if core == core.lower():
                        kept[-1] = (at, text, core, ts)
                    continue
            kept.append((at, text, core, ts))
        return [(n,) for at, *_ in kept for n in at]

    return fold(rows, ["clip"], "n int", collapse)
