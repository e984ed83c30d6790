import random

import pytest
from pyspark.sql import Window as W, functions as F

from cadenza.operators import sharded as S


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for key in ("a", "b", "hot"):
        for i in range(300 if key == "hot" else 25):
            t += rng.choice([0, 1, 1, 40])
            rows.append((key, t, i, rng.choice([None, 1, 2, 3])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, i int, v int")


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_like_plain_windows(table, width):
    x = table.withColumn("h", F.floor(F.col("t") / width))
    w = W.partitionBy("k").orderBy("t", "i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    want = x.withColumns({
        "b": F.lag("v").over(w), "a": F.lead("t").over(w), "s": F.sum(F.coalesce("v", F.lit(0))).over(upto),
        "l": F.last("v", ignorenulls=True).over(upto), "c": F.sum(F.lit(1)).over(w.rowsBetween(-3, 3))})
    got = S.with_neighbours(x, ["k"], "h", ["t", "i"], before={"b": "v"}, after={"a": "t"})
    got = S.running_sum(got, ["k"], "h", ["t", "i"], F.coalesce("v", F.lit(0)), "s")
    got = S.last_known(got, ["k"], "h", ["t", "i"], F.col("v"), "l")
    got = S.centred_sums(got, ["k"], "h", ["t", "i"], 3, {"c": F.lit(1)}, block=8)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, (tuple(r) for r in want.collect())))


def test_empty(table):
    x = table.limit(0).withColumn("h", F.lit(0))
    assert S.running_sum(S.with_neighbours(x, ["k"], "h", ["t"], before={"b": "v"}), ["k"], "h", ["t"], F.lit(1), "n").count() == 0
