import random
from datetime import datetime, timedelta

import pytest

from cadenza.operators.coverage import coverage_totals, periods_and_gaps, speaking_periods

SEGMENTS = "utterance_id string, recording_id string, speaker_id string, start_time double, end_time double, logged_at timestamp, kind string, _s int"
T0 = datetime(2025, 1, 1)


def by_hand(rows):
    out = []
    for key in {r[0] for r in rows}:
        periods = []
        for s, e in sorted(r[1:] for r in rows if r[0] == key):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(key, "period", *p) for p in periods] + [(key, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out)


@pytest.mark.parametrize("shard", [1, 10, 37, 60_000])
def test_matches_brute_force_at_any_shard_width(spark, shard):
    rng = random.Random(shard)
    rows = []
    for key in ("a", "b", "hot"):
        for _ in range(30 if key != "hot" else 300):
            s = rng.randrange(-200, 2000 if key != "hot" else 9000)
            rows.append((key, s, s + rng.choice([1, 2, 5, 10, 20, 37, 74, 111, 300])))
    rows += rows[:20]
    bad = [(None, 1, 5), ("a", None, 5), ("a", 5, None), ("a", 5, 5), ("a", 9, 3)]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows + bad], "k string, s long, e long, _h int, kind string")
    got = sorted(tuple(r) for r in periods_and_gaps(table, ["k"], "s", "e", shard).collect())
    assert got == by_hand(rows)


def test_empty_table(spark):
    assert speaking_periods(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_dirty_segments(spark):
    rows = [
        ("u1", "r", " spk1 ", 0.0, 1.0, T0), ("u1", "r", "SPK1", 0.0, 2.004, T0 + timedelta(1)), ("u1", "r", "SPK1", 0.0, 2.004, T0 + timedelta(1)),
        ("u2", "r", "SpK1\t", 2.0, 3.0, T0), ("u3", "r", "spk1", 5.0, 6.0, None), ("u4", "r", None, 7.0, 8.0, T0), ("u5", "r", "  ", 7.0, 8.0, T0),
        ("u6", "r", "spk1", float("nan"), 8.0, T0), ("u7", "r", "spk1", 8.0, float("inf"), T0), ("u8", "r", "spk1", 9.0, 9.001, T0), ("u9", None, "spk1", 1.0, 2.0, T0),
        (None, "r", "spk2", 0.0, 1.0, T0), (None, "r", "spk2", 3.0, 4.0, T0), ("u10", "r", "spk1", 5.5, 5.6, T0), ("u10", "r", None, 50.0, 51.0, T0 + timedelta(2)),
    ]
    found = speaking_periods(spark.createDataFrame([(*r, "k", 1) for r in rows], SEGMENTS))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("r", "SPK1", "gap", 300, 500), ("r", "SPK1", "period", 0, 300), ("r", "SPK1", "period", 500, 600),
        ("r", "SPK2", "gap", 100, 300), ("r", "SPK2", "period", 0, 100), ("r", "SPK2", "period", 300, 400)]
    assert {(r["speaker_id"], r["n_periods"], r["spoken_cs"], r["n_gaps"], r["silent_cs"]) for r in coverage_totals(found).collect()} == {("SPK1", 2, 400, 1, 200), ("SPK2", 2, 200, 1, 200)}
