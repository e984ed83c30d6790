"""Joins by likeness: nearest vectors, thresholds, edit distance, time tolerance, assignments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.sessions import fold
from cadenza.operators.sharded import last_known

BLOCK = 8192  # query vectors that are broadcast at once


def _matrix(column, dim: int, unit: bool = True) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1) if unit else x


def _distances(a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    if cosine:
        return 1 - np.clip(a @ b.T, -1, 1)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def cosine_pairs(queries: DataFrame, rows: DataFrame, k: int | None = None, within: float | None = None, block: int = BLOCK, cosine: bool = True) -> DataFrame:
    """``q, id, distance`` (cosine or Euclidean) of each query's ``k`` nearest rows and/or all rows at distance at most ``within``; itself left out.

    Both sides have ``id long, v array<float>`` (null, empty, zero and non-finite vectors don't take part).  The queries
    are a stated set; they are broadcast in blocks of at most ``block`` vectors, and every block meets all rows as matrix
    products.  Per Arrow batch only a query's k best leave a task.  Smaller ids win ties.
    """
    from cadenza.functions.vectors import is_embedding

    queries = queries.filter(is_embedding(F.col("v"), 0.0)).select("id", "v")
    rows = rows.filter(is_embedding(F.col("v"), 0.0)).select("id", "v")
    head = queries.limit(1).collect()
    if not head:
        return rows.sparkSession.createDataFrame([], "q long, id long, distance double, rank int").drop(*([] if k else ["rank"]))
    dim, spark = len(head[0]["v"]), rows.sparkSession
    n = max(1, -(-queries.count() // max(1, block * 3 // 4)))
    parts = []
    for i in range(n):
        got = queries.filter((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(n)) == i)).toArrow()
        parts.append(_block(spark, rows, got, dim, k, within, cosine))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if k is None:
        return out
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _block(spark, rows: DataFrame, got: pa.Table, dim: int, k: int | None, within: float | None, cosine: bool) -> DataFrame:
    shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), _matrix(got.column("v"), dim, cosine) if got.num_rows else np.empty((0, dim))))
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def run(batches):
        names, q = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(q) or not len(ids):
                continue
            d = _distances(_matrix(batch.column(1), dim, cosine), q, cosine)
            d[ids[:, None] == names[None, :]] = np.inf
            d = np.round(d, 12)
            keep = d < np.inf if within is None else d <= within
            if k is not None and len(ids) > k:
                keep &= d <= np.partition(d, k - 1, axis=0)[k - 1]
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(names[j]), pa.array(ids[i]), pa.array(d[i, j])], schema=schema)

    return rows.filter(F.size("v") == dim).mapInArrow(run, "q long, id long, distance double")


def similar_pairs(rows: DataFrame, within: float, block: int = 4096) -> DataFrame:
    """``q, id, distance`` with q < id: all pairs of cosine distance at most ``within``.

    An exact join with a wide threshold has to look at every pair; it does so as matrix products of two blocks of at most
    about ``block`` vectors a task, of which only pairs within the threshold leave.  Nothing reaches the driver.
    """
    from cadenza.functions.vectors import is_embedding

    rows = rows.filter(is_embedding(F.col("v"), 0.0)).select("id", "v")
    n = max(1, -(-rows.count() // block))
    mine = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    met = rows.withColumn("b", mine).select("id", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    met = met.select("id", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        lengths = pc.list_value_length(table.column("v")).to_numpy()
        low = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, ids, found = table.column("b").to_numpy() == table.column("i")[0].as_py(), table.column("id").to_numpy(), []
        for dim in np.unique(lengths):
            at = [np.flatnonzero((lengths == dim) & side) for side in ((left, left) if low else (left, ~left))]
            a, b = (_matrix(table.column("v").take(pa.array(x)), int(dim)) if len(x) else np.empty((0, int(dim))) for x in at)
            d = np.round(_distances(a, b, True), 12)
            x, y = np.nonzero(d <= within)
            p, q = ids[at[0][x]], ids[at[1][y]]
            keep = p < q if low else p != q
            found.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], d[x, y][keep]))
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    return met.groupBy("i", "j").applyInArrow(run, "q long, id long, distance double")


def nearest_centroid(rows: DataFrame, centroids: DataFrame, most: int = 65_536) -> DataFrame:
    """``id, centroid, distance`` (cosine) of each row's nearest centroid, smaller id first on ties.

    The least is taken inside a batch, so that a row leaves a task once.  At most ``most`` centroids are broadcast; more are an error.
    """
    from cadenza.functions.vectors import is_embedding

    got = centroids.filter(is_embedding(F.col("v"), 0.0)).select("id", "v").orderBy("id").limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"more than {most} centroids")
    rows = rows.filter(is_embedding(F.col("v"), 0.0)).select("id", "v")
    schema = pa.schema([("id", pa.int64()), ("centroid", pa.int64()), ("distance", pa.float64())])
    if not got.num_rows:
        return rows.sparkSession.createDataFrame([], "id long, centroid long, distance double")
    dim = len(got.column("v")[0])
    shared = rows.sparkSession.sparkContext.broadcast((got.column("id").to_numpy(), _matrix(got.column("v"), dim)))

    def run(batches):
        names, c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.round(_distances(_matrix(batch.column(1), dim), c, True), 12)
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names[best]), pa.array(d[np.arange(len(d)), best])], schema=schema)

    return rows.filter(F.size("v") == dim).mapInArrow(run, "id long, centroid long, distance double")


def mergeable(pairs: DataFrame, permanent: DataFrame) -> DataFrame:
    """Direction of merging for near pairs (q < id): the later into the earlier unless only the later is permanent; two permanent ones never.

    ``permanent(id, permanent)``; returns ``source, target, distance``.
    """
    a = permanent.select(F.col("id").alias("q"), F.col("permanent").alias("pa"))
    b = permanent.select("id", F.col("permanent").alias("pb"))
    x = pairs.filter("q < id").join(a, "q").join(b, "id").filter("NOT (pa AND pb)")
    return x.select(F.when(~F.col("pb"), F.col("id")).otherwise(F.col("q")).alias("source"), F.when(~F.col("pb"), F.col("q")).otherwise(F.col("id")).alias("target"), "distance")


def edit_join(words: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Pairs (word, term) of Levenshtein distance at most ``k``: ``word, term, distance``.

    Pigeonhole index instead of a tree: a term is cut into k + 1 parts, one of which must occur unchanged in any word
    within k edits, at most k places off.  Parts are joined by equality on (term length, part number, text); candidates
    are then verified.  Terms of k letters or fewer have an empty part and meet words of like length.  Nulls don't match.
    """
    w, t = words.select("word").filter("word IS NOT NULL").distinct(), terms.select("term").filter("term IS NOT NULL").distinct()
    n = F.length("term")

    def cut(i: int) -> Column:  # begin of part i, from 0, of a text of length L
        return F.floor(F.col("L") * i / (k + 1)).cast("int")

    parts = t.withColumn("L", n)
    parts = parts.select("term", "L", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substr("term", cut(i) + 1, cut(i + 1) - cut(i)).alias("p")) for i in range(k + 1)])).alias("x")).select("term", "L", "x.*")
    lens = F.filter(F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda d: F.length("word") + d), lambda x: x >= 0)
    probe = w.select("word", F.explode(lens).alias("L"))
    probe = probe.select("word", "L", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (cut(i) + s).alias("b"), (cut(i + 1) - cut(i)).alias("m")) for i in range(k + 1) for s in range(-k, k + 1)])).alias("x"))
    probe = probe.filter((F.col("x.b") >= 0) & (F.col("x.b") + F.col("x.m") <= F.length("word"))).select("word", "L", "x.i", F.substr("word", F.col("x.b") + 1, F.col("x.m")).alias("p")).distinct()
    near = probe.join(parts, ["L", "i", "p"]).select("word", "term").distinct()
    return near.withColumn("distance", F.levenshtein("word", "term", k)).filter("distance >= 0")


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length, case ignored; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longer)


def penalised(a: Column, b: Column) -> Column:
    """Similarity times the square root of shorter by longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(similarity(a, b) * F.sqrt(F.least(F.length(a), F.length(b)) / longer))


def spans(words: DataFrame, keys: list[str], at: str, most: int = 4) -> DataFrame:
    """Every 1 to ``most`` neighbouring words: ``keys, at, n, phrase, glued``."""
    w = W.partitionBy(*keys).orderBy(at)
    x = words
    for i in range(1, most):
        x = x.withColumn(f"_w{i}", F.lead("word", i).over(w))
    cols = ["word"] + [f"_w{i}" for i in range(1, most)]
    options = [F.when(F.col(cols[n - 1]).isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *cols[:n]).alias("phrase"), F.concat(*cols[:n]).alias("glued"))) for n in range(1, most + 1)]
    return x.select(*keys, at, F.explode(F.array_compact(F.array(*options))).alias("s")).select(*keys, at, "s.*")


def time_matches(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Tokens of one label less than ``tolerance`` frames apart: both sides ``keys, label, t, n``; returns ``keys, label, ln, rn``.

    Joined by equality on bins of the tolerance's width; the right side goes into its bin and both neighbours.
    """
    l = left.select(*keys, "label", F.col("t").alias("lt"), F.col("n").alias("ln"), F.floor(F.col("t") / tolerance).alias("bin"))
    r = right.select(*keys, "label", F.col("t").alias("rt"), F.col("n").alias("rn"), F.explode(F.array(*[F.floor(F.col("t") / tolerance) + d for d in (-1, 0, 1)])).alias("bin"))
    return l.join(r, [*keys, "label", "bin"]).filter(F.abs(F.col("lt") - F.col("rt")) < tolerance).select(*keys, "label", "ln", "rn")


def words_in_window(words: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """First to last word that touches each window (``key, win, s, e``): the first unbroken stretch of them; without any, the word of nearest midpoint.

    ``words(key, n, s, e)`` numbered in order.  Windows meet words through bins; only windows without a hit look for
    the nearest word, by an as-of pass over both sides' midpoints.
    """
    from cadenza.operators.intervals import BIN

    def binned(df, tail):
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / BIN), F.floor(F.col("e") / BIN)))).withColumnsRenamed({"s": "s" + tail, "e": "e" + tail})

    hit = binned(windows.select(key, "win", "s", "e"), "_w").join(binned(words.select(key, "n", "s", "e"), "_x"), [key, "bin"]).filter("e_x >= s_w AND s_x <= e_w").select(key, "win", "n").distinct()
    by = W.partitionBy(key, "win").orderBy("n")
    stretch = hit.withColumn("g", F.col("n") - F.row_number().over(by))
    stretch = stretch.groupBy(key, "win", "g").agg(F.min("n").alias("first"), F.max("n").alias("last")).groupBy(key, "win").agg(F.min(F.struct("first", "last")).alias("x")).select(key, "win", "x.*")
    lone = windows.join(hit.select(key, "win").distinct(), [key, "win"], "left_anti").select(key, "win", ((F.col("s") + F.col("e")) / 2).alias("m"))
    points = words.select(key, F.lit(None).cast(windows.schema["win"].dataType).alias("win"), ((F.col("s") + F.col("e")) / 2).alias("m"), "n").unionByName(lone.withColumn("n", F.lit(None).cast(words.schema["n"].dataType)))
    point = F.when(F.col("n").isNotNull(), F.struct("m", "n"))
    points = points.withColumns({"up": F.floor(F.col("m") / BIN), "back": -F.col("m"), "down": F.floor(-F.col("m") / BIN), "asks": F.col("n").isNull(), "tie": F.coalesce(F.col("n"), F.lit(0))})
    near = last_known(points, [key], "up", ["m", "asks", F.negative("tie"), F.coalesce(F.col("win").cast("string"), F.lit(""))], point, "b")
    near = last_known(near, [key], "down", ["back", "asks", F.negative("tie"), F.coalesce(F.col("win").cast("string"), F.lit(""))], point, "a").filter("asks")
    db, da = F.col("m") - F.col("b.m"), F.col("a.m") - F.col("m")
    pick = F.when(F.col("a.n").isNull() | (db < da), F.col("b.n")).when(F.col("b.n").isNull() | (da < db), F.col("a.n")).otherwise(F.least("a.n", "b.n"))
    near = near.select(key, "win", pick.alias("first"), pick.alias("last")).filter("first IS NOT NULL")
    return stretch.unionByName(near)


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str, word: str = "[a-z0-9_]+") -> DataFrame:
    """Keywords (single words, lower case) in the reference and hypothesis of each text: ``key, tp, fp, fn``; texts without any are left out.

    Texts are cut into words and joined by equality, not matched against every keyword.
    """
    def found(col):
        w = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(f"({word})")))).alias("word"))
        return w.join(keywords.select("word").distinct(), "word", "left_semi").withColumn(col, F.lit(1))

    both = found("reference").join(found("hypothesis"), [key, "word"], "full")
    r, h = F.col("reference").isNotNull(), F.col("hypothesis").isNotNull()
    return both.groupBy(key).agg(F.count_if(r & h).alias("tp"), F.count_if(~r & h).alias("fp"), F.count_if(r & ~h).alias("fn"))


def lookup_chain(words: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """First stage that knows a word wins: ``word, value, stage``; each stage has ``word, value`` with unique words.

    One shuffle for all stages: they are told apart by number and the least is taken.
    """
    known = None
    for i, s in enumerate(stages):
        part = s.select("word", F.struct(F.lit(i).alias("stage"), "value").alias("v"))
        known = part if known is None else known.unionByName(part)
    best = known.groupBy("word").agg(F.min("v").alias("v"))
    return words.select("word").distinct().join(best, "word", "left").select("word", F.col("v.value").alias("value"), F.col("v.stage").alias("stage"))


def assign(weights: list[list[float]]) -> list[int]:
    """Columns assigned to rows so that the total weight is greatest; -1 for rows left without a column of positive weight.

    Shortest augmenting paths with potentials on the square, zero-padded cost matrix.
    """
    rows, cols = len(weights), max((len(r) for r in weights), default=0)
    n = max(rows, cols)
    if not n:
        return []
    cost = np.zeros((n, n))
    for i, r in enumerate(weights):
        cost[i, : len(r)] = [-w for w in r]
    u, v, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        owner[n], j = i, n
        dist, prev, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[j] >= 0:
            done[j] = True
            free = ~done[:n]
            through = cost[owner[j]] - u[owner[j]] - v[:n]
            better = free & (through < dist)
            dist[better], prev[better] = through[better], j
            k = int(np.where(free, dist, np.inf).argmin())
            step = dist[k]
            for c in np.flatnonzero(done):
                u[owner[c]] += step
                v[c] -= step
            dist[free] -= step
            j = k
        while j != n:
            owner[j] = owner[prev[j]]
            j = prev[j]
    out = [-1] * rows
    for c in range(cols):
        r = int(owner[c])
        if 0 <= r < rows and c < len(weights[r]) and weights[r][c] > 0:
            out[r] = c
    return out


def best_mapping(overlaps: DataFrame, rec: str, ref: str, hyp: str, weight: str) -> DataFrame:
    """One-to-one mapping of greatest total overlap per recording: ``rec, ref, hyp``.

    The matrix of a recording's speakers (their numbers, not their frames) goes to one call.
    """
    g = overlaps.groupBy(rec).agg(F.array_sort(F.collect_list(F.struct(F.col(ref).alias("r"), F.col(hyp).alias("h"), F.col(weight).cast("double").alias("w")))).alias("x"))

    def solve(row):
        left = sorted({x["r"] for x in row["x"]})
        right = sorted({x["h"] for x in row["x"]})
        at_r, at_h = ({v: i for i, v in enumerate(s)} for s in (left, right))
        m = [[0.0] * len(right) for _ in left]
        for x in row["x"]:
            m[at_r[x["r"]]][at_h[x["h"]]] += x["w"]
        return [(left[i], right[j]) for i, j in enumerate(assign(m)) if j >= 0]

    return fold(g, [rec], f"{ref} string, {hyp} string", solve)


def pick_apart(candidates: DataFrame, key: str, first: str, n: str, score: str, tie: str, step: float = 0.05) -> DataFrame:
    """Greedy choice of spans that don't share a word: rounded score class, then fewer words, then score, then ``tie``; all others fall.

    A fold in the JVM over one key's candidates (numbers only), as a choice depends on those kept before.
    """
    order = F.struct((-F.round(F.col(score) / step)).alias("a"), F.col(n).alias("b"), (-F.col(score)).alias("c"), F.col(tie).alias("d"), F.col(first).alias("f"))
    g = candidates.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("x"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.slice("x", 1, 0).alias("kept"))

    def step_(acc, x):
        own = F.sequence(x["f"].cast("int"), (x["f"] + x["b"] - 1).cast("int"))
        return F.when(F.arrays_overlap(acc["used"], own), acc).otherwise(F.struct(F.concat(acc["used"], own).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept")))

    kept = g.select(key, F.explode(F.aggregate("x", start, step_, lambda a: a["kept"])).alias("k"))
    return kept.select(key, F.col("k.f").alias(first), F.col("k.b").alias(n), (-F.col("k.c")).alias(score), F.col("k.d").alias(tie))
