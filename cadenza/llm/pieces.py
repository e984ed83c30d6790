"""Cutting clips over the encoder's limit at natural pauses, by packing a structure tree.

The leaves of a clip's tree are its pauses (first samples of quiet frames).
Sixteen frames are the smallest node, far below the limit; two neighbouring
nodes have one parent, up to the clip.  From the bottom up each node learns where
its last pause lies.  A piece takes whole subtrees, one sibling after the other,
as long as they end inside the room that is left; only a node that is too large
for it is descended into, down to the pauses.  Stretches without a pause inside
the limit are cut hard.

Spark reduces the frames to one word of bits for each smallest node before they
meet, so even a clip of a hundred million frames is held as some megabytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadenza.operators.coverage import latest_by

FRAME = 4096
RATE = 16_000
NODE = 16  # frames of a smallest node


class Tree:
    """Last pauses (samples; -1 without any) of all nodes: ``level[0]`` are the smallest nodes, each further level has half as many."""

    def __init__(self, words: np.ndarray):
        self.words = words
        at = np.arange(len(words), dtype=np.int64) * NODE
        high = np.zeros(len(words), np.int64)
        for bit in range(NODE):
            high[(words >> bit) & 1 == 1] = bit
        self.level = [np.where(words != 0, (at + high) * FRAME, -1)]
        while len(self.level[-1]) > 1:
            below = self.level[-1]
            self.level.append(np.maximum(below[::2], np.append(below[1::2], np.full(len(below) % 2, -1))))

    def pauses(self, node: int) -> list[int]:
        return [(node * NODE + bit) * FRAME for bit in range(NODE) if self.words[node] >> bit & 1]


def pack(total: int, overlap: int, tree: Tree, limit: int) -> tuple[list[tuple[int, int]], int]:
    """Pieces (first, end) of one clip, and how many whole subtrees went into them."""
    pieces, merged, start, done, end = [], 0, 0, 0, -1

    def cut():
        nonlocal start, done, end
        stop = end if end > done else start + limit
        pieces.append((start, stop))
        done, start, end = stop, stop - overlap, -1

    stack = [(len(tree.level) - 1, 0)] if len(tree.words) else []
    while total - start > limit:
        if not stack:  # no pauses are left
            cut()
            continue
        level, node = stack[-1]
        last = int(tree.level[level][node])
        if last <= done:
            stack.pop()
        elif last <= start + limit:  # the whole subtree fits
            stack.pop()
            merged += 1
            end = last
        elif level:  # too large for the room: descend
            stack.pop()
            right = 2 * node + 1
            if right < len(tree.level[level - 1]):
                stack.append((level - 1, right))
            stack.append((level - 1, 2 * node))
        else:  # the room ends among these pauses
            inside = [p for p in tree.pauses(node) if done < p <= start + limit]
            end = inside[-1] if inside else end
            cut()
    pieces.append((start, total))
    return pieces, merged


def split_clips(clips: DataFrame, frames: DataFrame, limit: int = 240_000, quiet: float = 0.3, block: int = 4096) -> DataFrame:
    """Pieces of all clips over ``limit`` samples: ``clip, piece_no, first_sample, end_sample`` (end exclusive).

    * the latest registration of a clip counts; null clips and null totals don't count;
    * null or NaN overlap counts as 2.0 s, a negative one as 0; it is at most half the limit;
    * null, NaN or repeated frames: null and NaN are no pauses, copies change nothing;
    * a clip without frames is cut every ``limit`` samples; empty tables give an empty result.

    Held at once: of a single clip one word for each ``NODE`` frames that have a pause, gathered by blocks of ``block`` words first.
    """
    c = latest_by(clips, "clip", "registered_at", ["clip", "total_samples", "overlap_seconds"])
    c = c.filter(F.col("clip").isNotNull() & (F.col("total_samples") > limit))
    seconds = F.when(F.col("overlap_seconds").isNull() | F.isnan("overlap_seconds"), 2.0).otherwise(F.greatest(F.lit(0.0), F.least("overlap_seconds", F.lit(1e6))))
    samples = F.least(F.round(seconds * RATE), F.lit(limit // 2)).cast("long")
    c = c.select("clip", F.col("total_samples").cast("long").alias("total"), (samples - samples % 1280).alias("overlap"))
    pause = frames.filter((F.col("prob") < quiet) & F.col("clip").isNotNull() & (F.col("frame") > 0))
    node = pause.groupBy("clip", F.floor(F.col("frame") / NODE).alias("node")).agg(F.expr(f"bit_or(shiftleft(1, CAST(frame % {NODE} AS INT)))").alias("word"))
    tree = node.groupBy("clip", F.floor(F.col("node") / block).alias("b")).agg(F.collect_list("node").alias("node"), F.collect_list("word").alias("word"))
    tree = tree.groupBy("clip").agg(F.collect_list("node").alias("nodes"), F.collect_list("word").alias("words"))
    packed = c.join(tree, "clip", "left").select("clip", "total", "overlap", F.flatten("nodes").alias("nodes"), F.flatten("words").alias("words"))
    schema = pa.schema([("clip", pa.string()), ("piece_no", pa.int32()), ("first_sample", pa.int64()), ("end_sample", pa.int64())])

    def cut(batches):
        for batch in batches:
            names, numbers, first, last = [], [], [], []
            for clip, total, overlap, nodes, words in zip(*(batch.column(n) for n in ("clip", "total", "overlap", "nodes", "words"))):
                held = np.zeros(0, np.int64)
                if nodes.is_valid and len(nodes):
                    at = nodes.values.to_numpy()
                    held = np.zeros(at.max() + 1, np.int64)
                    held[at] = words.values.to_numpy()
                pieces, _ = pack(total.as_py(), overlap.as_py(), Tree(held), limit)
                names += [clip.as_py()] * len(pieces)
                numbers += range(len(pieces))
                first += [a for a, _ in pieces]
                last += [z for _, z in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((names, numbers, first, last), schema)], schema=schema)

    return packed.mapInArrow(cut, "clip string, piece_no int, first_sample long, end_sample long")
