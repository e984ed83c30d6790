"""Distributed Borůvka: the maximum spanning forest of a weighted graph, and its components.

Each round every component picks its heaviest outgoing edge (partial
aggregation before the shuffle), hooks on to the component at the other end, and
paths are shortened by pointer jumping; edges inside a component vanish and
parallel ones are reduced to the heaviest.  Ties are broken by the vertex ids,
so any picked edge belongs to the one forest, even where paths aren't yet fully
shortened.  Tables are written to the shared folder between rounds; nothing but
row counts reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cadenza.session import drop, materialise


def spanning_forest(edges: DataFrame, jumps: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of ``edges(a, b, w)`` with a < b, each pair once: (forest ``a, b, w``, members ``id, root``).

    Vertices without edges are in neither.  An empty graph gives empty tables.
    """
    def heaviest(c):
        return F.max(F.struct("w", "a", "b", c)).alias("m")

    now = edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b")
    picked, parents, rest = [], [], None
    while True:
        both = now.select("ca", "cb", "w", "a", "b").unionByName(now.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "w", "a", "b"))
        best = materialise(both.groupBy("ca").agg(heaviest("cb")).select(F.col("ca").alias("c"), F.col("m.cb").alias("p"), "m.w", "m.a", "m.b"))
        if best.isEmpty():
            break
        picked.append(best)
        up = best.select("c", "p")
        # two components that picked each other: the smaller id is the root
        back = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = up.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        for _ in range(jumps):
            up = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p", "left").select("c", F.coalesce("pp", "p").alias("p"))
        up = materialise(up)
        parents.append(up)
        a = up.select(F.col("c").alias("ca"), F.col("p").alias("pa"))
        b = up.select(F.col("c").alias("cb"), F.col("p").alias("pb"))
        now = now.join(a, "ca").join(b, "cb").filter("pa != pb")
        now = now.select(F.least("pa", "pb").alias("ca"), F.greatest("pa", "pb").alias("cb"), "w", "a", "b")
        now = materialise(now.groupBy("ca", "cb").agg(F.max(F.struct("w", "a", "b")).alias("m")).select("ca", "cb", "m.w", "m.a", "m.b"))
        if rest is not None:
            drop(rest)
        rest = now
    if not parents:
        empty = edges.select("a", "b", "w").limit(0)
        return empty, empty.select(F.col("a").alias("id"), F.col("b").alias("root"))
    forest = materialise(reduce(DataFrame.unionByName, [p.select("a", "b", "w") for p in picked]).distinct())
    label = parents[0].select(F.col("c").alias("id"), F.col("p").alias("root"))
    for up in parents[1:]:
        label = label.join(up, label["root"] == up["c"], "left").select("id", F.coalesce("p", "root").alias("root"))
    label = materialise(label)
    drop(best, rest, *picked, *parents)
    return forest, label
