import random
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pytest

from cadenza.llm.pieces import Tree, pack, split_clips
from cadenza.llm.runs import collapse_runs, repeated_runs

T0 = datetime(2025, 1, 1)
TOKENS = "clip string, chunk int, pos int, token int, ts int, conf float, dur int, decoded_at timestamp, key string, n int, h int"
PIECES = "token int, piece string, key string"


def runs_by_hand(rows, pieces, gap=25):
    best = {}
    for clip, chunk, pos, token, ts, _, _, at in rows:
        if None not in (clip, chunk, pos, token, ts):
            k = (clip, chunk, pos)
            best[k] = max(best.get(k, (at, token, ts)), (at, token, ts))

    def name(t):
        p = pieces.get(t)
        if p is None:
            return t
        p = unicodedata.normalize("NFC", p).lower()
        return p.lstrip("▁ ") or p

    out = []
    for clip in {k[0] for k in best}:
        last = None
        for ts, chunk, pos, token in sorted((b[2], *k[1:], b[1]) for k, b in best.items() if k[0] == clip):
            if last and name(token) == name(last[1]) and ts - last[0] <= gap:
                out[-1][3] += 1
                out[-1][4] = ts - start
            else:
                out.append([clip, chunk, pos, 1, 0])
                start = ts
            last = (ts, token)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("shard", [7, 64, 4096])
def test_runs_match_brute_force_across_shards(spark, shard):
    rng = random.Random(shard)
    pieces = {1: "▁Go", 2: "go", 3: " GO", 4: "▁", 5: "é", 6: "é", 7: "▁▁"}
    rows = []
    for clip in ("a", "b", "hot"):
        t = 0
        for i in range(60 if clip != "hot" else 400):
            t += rng.choice([0, 1, 2, 25, 26, 60])
            rows.append((clip, i // 50, i % 50, rng.choice([1, 2, 3, 4, 5, 6, 7, 9, None]), rng.choice([t] * 9 + [None]), 0.5, 1, T0))
    rows += [r[:-1] + (T0 + timedelta(seconds=1),) for r in rng.sample(rows, 40)]
    rng.shuffle(rows)
    tokens = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TOKENS)
    table = spark.createDataFrame([(k, v, "z") for k, v in pieces.items()] + [(None, "q", "z"), (8, None, "z")], PIECES)
    got = sorted(tuple(r) for r in collapse_runs(tokens, table, shard=shard).select("clip", "chunk", "pos", "n_events", "span_frames").collect())
    assert got == runs_by_hand(rows, pieces)


def test_runs_of_empty_and_null_tables(spark):
    empty, pieces = spark.createDataFrame([], TOKENS), spark.createDataFrame([], PIECES)
    assert repeated_runs(empty, pieces).count() == 0
    rows = [(None, 0, 0, 1, 1, None, None, T0, "", 0, 0), ("c", 0, 0, None, 1, None, None, None, "", 0, 0), ("c", 0, 1, 1, 5, None, None, None, "", 0, 0), ("c", 0, 2, 1, 9, None, None, None, "", 0, 0)]
    assert [tuple(r) for r in repeated_runs(spark.createDataFrame(rows, TOKENS), pieces).collect()] == [("c", 0, 1, 2, 4)]


def pieces_by_hand(total, seconds, frames):
    overlap = int(min(round((2.0 if seconds is None or seconds != seconds else seconds) * 16000), 120000)) // 1280 * 1280
    pauses = sorted({f * 4096 for f, p in frames if p is not None and p < 0.3})
    out, start, done = [], 0, 0
    while total - start > 240000:
        fit = [p for p in pauses if done < p <= start + 240000]
        end = fit[-1] if fit else start + 240000
        out.append((start, end))
        done, start = end, end - overlap
    return out + [(start, total)]


@pytest.mark.parametrize("block", [4, 256])
def test_pieces_match_brute_force(spark, block):
    rng = random.Random(block)
    clips, frames, want = [], [], []
    for i in range(40):
        total = rng.choice([None, 1000, 240000, 240001, rng.randrange(250000, 9000000)])
        seconds = rng.choice([None, float("nan"), 0.0, 2.0, 3.2, 7.5, 9.0])
        quiet = rng.choice([0.0, 0.02, 0.3, 1.0])
        mine = [(f, rng.choice([0.1, 0.29999]) if rng.random() < quiet else rng.choice([0.3, 0.9, None])) for f in range((total or 0) // 4096 + 1)] if rng.random() < 0.9 else []
        clips += [(f"c{i}", 500_000, 1.0, T0, 1)] * 2 + [(f"c{i}", total, seconds, T0 + timedelta(1), 1)] * 2
        frames += [(f"c{i}", f, p, 1) for f, p in mine + mine[:3]]
        if total and total > 240000:
            want += [(f"c{i}", n, a, b) for n, (a, b) in enumerate(pieces_by_hand(total, seconds, mine))]
    clips += [(None, 999999, 1.0, T0, 1)]
    frames += [("c0", None, 0.1, 1), (None, 3, 0.1, 1), ("c1", 5, float("nan"), 1)]
    rng.shuffle(frames)
    c = spark.createDataFrame(clips, "clip string, total_samples long, overlap_seconds double, registered_at timestamp, total int")
    f = spark.createDataFrame(frames, "clip string, frame int, prob double, b int")
    got = sorted(tuple(r) for r in split_clips(c, f, block=block).collect())
    assert got == sorted(want)
    assert split_clips(c.limit(0), f.limit(0)).count() == 0


def test_whole_subtrees_are_merged_and_only_large_ones_descended():
    rng = random.Random(4)
    for share in (0.01, 0.1, 0.5, 1.0):
        words = np.array([sum((rng.random() < share) << b for b in range(16)) for _ in range(200)])
        tree = Tree(words)
        pauses = [p for n in range(200) for p in tree.pauses(n) if p]
        assert tree.level[-1][0] == max(pauses)
        total = 200 * 16 * 4096 + 300_000
        pieces, merged = pack(total, 32_000, tree, 240_000)
        assert pieces == pieces_by_hand(total, 2.0, [(p // 4096, 0.1) for p in pauses])
        # fewer steps than pauses: most go in with whole subtrees
        assert merged > len(pieces) if share >= 0.1 else merged > 0
    assert pack(500_000, 0, Tree(np.zeros(0, np.int64)), 240_000) == ([(0, 240_000), (240_000, 480_000), (480_000, 500_000)], 0)
