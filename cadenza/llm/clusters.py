"""Hierarchical density clustering of vectors.

1. Neighbour graph: inside every inverted file of the permutation index each
   vector is linked to its nearest; parts of a file that stay apart though some
   similarity reaches the floor are bridged by their strongest link, so the graph
   connects all that a file shows to be connected.
2. Mutual reachability: an edge weighs no more than either end's core
   similarity, that of its ``min_samples``-th nearest (with 1, its own).
3. Maximum spanning forest by distributed Borůvka (the minimum one in distances).
4. Each tree's hierarchy is condensed (splits off fewer than ``min_size`` members
   are members falling out), clusters are chosen by stability, and the members
   that persist longest are a cluster's exemplars.

With ``min_samples`` 1 the trees themselves are the clusters of the hierarchy cut
at the floor: all vectors linked by similarities of at least ``least``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.llm.forest import spanning_forest
from cadenza.llm.pivots import Cell, postings, sample_pivots
from cadenza.session import drop, materialise

POST, PREFIX, RERANK = 6, 12, 1024


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of an undirected graph: minimum labels spread along edges, with path halving."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def local_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges in the maximum spanning forest (Borůvka; ties go to the earlier vertices)."""
    order = np.lexsort((b, a, -w))
    kept, label = [], np.arange(n)
    while len(order):
        x, y = label[a[order]], label[b[order]]
        order, x, y = order[x != y], x[x != y], y[x != y]
        if not len(order):
            break
        _, first = np.unique(interleave(x, y), return_index=True)  # each part's heaviest edge comes first
        best = np.unique(order[first // 2])
        kept.append(best)
        label = parts(n, np.concatenate([a[k] for k in kept]), np.concatenate([b[k] for k in kept]))
    return np.concatenate(kept) if kept else np.empty(0, int)


def interleave(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(x), x.dtype)
    out[0::2], out[1::2] = x, y
    return out


def neighbour_graph(vectors: DataFrame, k: int, least: float, dim: int, least_norm: float, post: int, prefix: int, rerank: int, largest: int, forest: bool) -> DataFrame:
    """Edges ``a, b, w`` with a < b, each pair once, of similarity at least ``least``.

    ``forest``: of a file only its own spanning forest is sent on; an edge outside it is in no forest of the whole.
    """
    spark = vectors.sparkSession
    pivots = sample_pivots(vectors, post, dim, least_norm, largest)
    if not len(pivots):
        return spark.createDataFrame([], "a string, b string, w double")
    length = min(prefix, len(pivots))
    posted = postings(vectors, pivots, post, prefix, dim, least_norm, k + 1)
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("w", pa.float32())])

    def link(table: pa.Table) -> pa.Table:
        cell = Cell(table, length, dim)
        a, b, w = [], [], []
        for q, cols, sims in cell.blocks(rerank):
            if not len(cols):
                continue
            width = min(len(cols), k)
            best = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < len(cols) else np.tile(np.arange(len(cols)), (len(q), 1))
            s = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(s >= least)
            a.append(q[i])
            b.append(cols[best[i, j]])
            w.append(s[i, j])
        if not a or not sum(map(len, a)):
            return schema.empty_table()
        a, b, w = map(np.concatenate, (a, b, w))
        while True:  # bridge parts of this file, strongest link of each first, until none reaches the floor
            label = parts(len(cell), a, b)
            alive = np.zeros(len(cell), bool)
            alive[a] = alive[b] = True
            size = np.bincount(label[alive], minlength=len(cell))
            if (size > 0).sum() < 2:
                break
            alive &= label != size.argmax()  # a link between parts has an end outside the largest
            x, y, v = [], [], []
            for q, cols, sims in cell.blocks(rerank, only=alive):
                if not len(cols):
                    continue
                sims[label[q][:, None] == label[cols][None, :]] = -2
                best = sims.argmax(1)
                s = sims[np.arange(len(q)), best]
                x.append(q[s >= least])
                y.append(cols[best[s >= least]])
                v.append(s[s >= least])
            if not x or not sum(map(len, x)):
                break
            x, y, v = map(np.concatenate, (x, y, v))
            order = np.lexsort((y, x, -v))
            _, first = np.unique(label[x[order]], return_index=True)
            top = order[first]
            a, b, w = np.append(a, x[top]), np.append(b, y[top]), np.append(w, v[top]).astype(np.float32)
        low, high = np.minimum(a, b), np.maximum(a, b)  # positions are in the order of ids
        _, first = np.unique(low.astype(np.int64) * len(cell) + high, return_index=True)
        if forest:
            first = first[local_forest(len(cell), low[first], high[first], np.round(w[first], 6))]
        return pa.table([pa.array(cell.ids[low[first]], pa.string()), pa.array(cell.ids[high[first]], pa.string()), pa.array(w[first], pa.float32())], schema=schema)

    edges = posted.groupBy("file").applyInArrow(link, "a string, b string, w float")
    stand_in = copy_links(vectors, k, dim, least_norm)
    return edges.unionByName(stand_in).groupBy("a", "b").agg(F.max(F.round(F.col("w").cast("double"), 6)).alias("w"))


def copy_links(vectors: DataFrame, k: int, dim: int, least_norm: float) -> DataFrame:
    """Links each further member of a large class of copies to the class's smallest ids, which stand for it in the index."""
    from cadenza.llm.neighbours import copies

    return copies(vectors, k, dim, least_norm).select(
        F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), F.lit(1.0).cast("float").alias("w"))


def reachability(edges: DataFrame, min_samples: int) -> DataFrame:
    """Edges weighed by mutual reachability: no more than the core similarity of either end.

    The core similarity is that of the ``min_samples``-th nearest, the vector itself counted as the first.
    Vectors without so many neighbours above the floor have none and drop out.
    """
    if min_samples <= 1:
        return edges
    ends = edges.select(F.col("a").alias("id"), "w").unionByName(edges.select(F.col("b").alias("id"), "w"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("w")))
    core = ends.withColumn("r", rank).filter(F.col("r") == min_samples - 1).select("id", F.col("w").alias("core"))
    e = edges.join(core.select(F.col("id").alias("a"), F.col("core").alias("x")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("y")), "b")
    return e.select("a", "b", F.least("w", "x", "y").alias("w"))


def density_forest(vectors: DataFrame, min_samples: int = 1, k: int = 5, least: float = 0.6, dim: int = 256, least_norm: float = 0.1,
                   post: int = POST, prefix: int = PREFIX, rerank: int = RERANK, largest: int = 65_536) -> tuple[DataFrame, DataFrame]:
    graph = materialise(neighbour_graph(vectors, max(k, min_samples), least, dim, least_norm, post, prefix, rerank, largest, min_samples <= 1))
    found = spanning_forest(reachability(graph, min_samples))
    drop(graph)
    return found


def enrolled(voices: DataFrame, least_duration: float = 4.0) -> DataFrame:
    """Voices long enough to count: null and NaN durations don't."""
    return voices.filter((F.col("duration") >= least_duration) & ~F.isnan("duration")).select("id", "embedding")


def linked_groups(vectors: DataFrame, **params) -> DataFrame:
    """The hierarchy cut at the floor: ``cluster_id, id`` for members of clusters of two or more; ``cluster_id`` is the smallest id.

    * an id counts once; invalid embeddings (null, other length, null, NaN or infinite numbers, tiny norm) don't count;
    * an empty table gives an empty result; extra columns are ignored.
    """
    _, members = density_forest(vectors, min_samples=1, **params)
    name = members.groupBy("root").agg(F.min("id").alias("cluster_id"))
    return members.join(name, "root").select("cluster_id", "id")


KEEP = 3  # exemplars of a cluster


@dataclass
class Part:
    """A piece of a tree as the rest of the tree sees it.

    If a cluster born at density b goes on into it, its stability is ``fallen - size * b``; ``best`` is the total
    stability of the clusters chosen inside, if it splits into any (``inside``: those clusters).
    """

    size: int
    fallen: float
    best: float | None
    top: list[tuple[float, str]]  # most persistent members: (-density of falling out, id)
    ids: list[str]  # smallest ids
    inside: list = field(default_factory=list)  # (size, stability, top, smallest id) 


def vertex(name: str) -> Part:
    return Part(1, 0.0, None, [], [name])


def condense(a: np.ndarray, b: np.ndarray, w: np.ndarray, parts: list[Part], min_size: int) -> Part:
    """Joins parts over the edges of a tree into one.

    Edges of like weight split at once; what falls off with fewer than ``min_size`` members only falls out.
    """
    n = len(parts)
    density = 1.0 / np.maximum(1.0 - w, 1e-3)
    order = np.argsort(-w, kind="stable")
    up, node = np.arange(n), np.arange(n)
    size = np.concatenate([[p.size for p in parts], np.zeros(n - 1, int)]).astype(int)
    kids, at = np.empty((n - 1, 2), int), density[order]

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, e in enumerate(order):  # dendrogram: node n + i joins the roots met by the i-th edge
        x, y = find(a[e]), find(b[e])
        kids[i] = node[x], node[y]
        size[n + i] = size[kids[i, 0]] + size[kids[i, 1]]
        up[y], node[x] = x, n + i

    def members(v):
        stack = [v]
        while stack:
            v = stack.pop()
            if v < n:
                yield from parts[v].ids
            else:
                stack.extend(kids[v - n])

    found = []  # [parent, birth, fallen, size, top, inner part, dendrogram node]
    todo = [(2 * n - 2, -1, 0.0)]
    while todo:
        v, parent, birth = todo.pop()
        me = len(found)
        found.append([parent, birth, 0.0, int(size[v]), [], None, v])
        own = found[me]
        while v is not None:
            if v < n:  # the cluster goes on inside a part
                own[2] += parts[v].fallen
                own[4] += parts[v].top
                own[5] = v
                break
            level = at[v - n]
            group, open_ = [], list(kids[v - n])  # all that come apart at this level
            while open_:
                c = open_.pop()
                if c >= n and at[c - n] == level:
                    open_.extend(kids[c - n])
                else:
                    group.append(c)
            own[2] += float(sum(size[c] for c in group if size[c] < min_size) * level)
            own[4] += [(-level, m) for c in group if size[c] < min_size for m in members(c)]
            big = [c for c in group if size[c] >= min_size]
            v = big[0] if len(big) == 1 else None
            if v is None:
                own[2] += float(sum(size[c] for c in big) * level)
                todo += [(c, me, level) for c in big]
        own[4] = heapq.nsmallest(KEEP, own[4])
    # from the leaves up: a cluster or those inside it, whatever is more stable
    best: list = [None] * len(found)
    chosen: list[list] = [[] for _ in found]
    for i in range(len(found) - 1, -1, -1):
        parent, birth, fallen, n_members, top, inner, _ = found[i]
        if inner is not None and parts[inner].best is not None:
            best[i] = (best[i] or 0.0) + parts[inner].best
            chosen[i].append(inner)
        if parent >= 0:
            gain = fallen - n_members * birth
            if best[i] is None or gain >= best[i]:
                best[i], chosen[i] = gain, [(n_members, gain, top, i)]
            best[parent] = (best[parent] or 0.0) + best[i]
            chosen[parent] += chosen[i]
            found[parent][4] = heapq.nsmallest(KEEP, found[parent][4] + top)
    inside = []
    for c in chosen[0]:  # clusters inside a part are as that part chose them
        inside += [(*c[:3], min(members(found[c[3]][6])))] if isinstance(c, tuple) else parts[c].inside
    ids = heapq.nsmallest(KEEP, (m for p in parts for m in p.ids))
    return Part(int(size[-1]), found[0][2], best[0], found[0][4], ids, inside)


def chosen_clusters(root: Part, least: float) -> list[tuple[int, float, list, str]]:
    """The whole tree, born at the floor, or the clusters inside it: (size, stability, top, smallest id)."""
    gain = root.fallen - root.size / (1.0 - least)
    if root.best is not None and root.best > gain:
        return root.inside
    return [(root.size, gain, root.top, root.ids[0])]


def density_clusters(vectors: DataFrame, min_samples: int = 3, min_size: int = 5, least: float = 0.6, bound: int = 200_000, **params) -> DataFrame:
    """Clusters chosen by stability: ``cluster_id, tree_id, size, stability, exemplars``.

    ``cluster_id`` is the smallest member id, ``tree_id`` that of the whole tree at the floor; exemplars are
    the members that persist to the greatest density, smaller id first.

    A tree of at most ``bound`` edges is condensed in one task; a larger one by :func:`contract`.
    Trees smaller than ``min_size`` have no clusters.  Invalid rows as in :func:`linked_groups`.
    """
    forest, members = density_forest(vectors, min_samples=min_samples, least=least, **params)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    edges = materialise(forest.join(members.withColumnRenamed("id", "a"), "a").join(sizes, "root").select(F.col("root").alias("part"), "a", "b", "w", "n"))
    large = edges.filter(F.col("n") > bound).drop("n")
    done = _condensed(edges.filter(F.col("n") <= bound).drop("n"), None, min_size, least)
    if large.isEmpty():
        return done
    return done.unionByName(_chosen(contract(large, None, min_size, bound), least))


_PART = ("size long, fallen double, best double, top array<struct<d:double,id:string>>, ids array<string>, "
         "inside array<struct<size:long,stability:double,top:array<struct<d:double,id:string>>,id:string>>")
_CLUSTER = "cluster_id string, tree_id string, size long, stability double, exemplars array<string>"


def contract(edges: DataFrame, parts: DataFrame | None, min_size: int, bound: int) -> DataFrame:
    """Each tree ``part`` of ``edges(part, a, b, w)`` as one row (``part`` and its columns); ends may be ``parts`` already.

    A tree of at most ``bound`` edges is condensed in one task.  Of a larger one the denser half of its edges goes first:
    the components of that half are trees of their own, contracted in the same way, and become the ends of the other half.
    If all of a tree's edges weigh the same, it comes apart at one level, which is an aggregation (:func:`_one_level`).
    So no task condenses more than ``bound`` edges, however large a tree is; a row holds the clusters chosen inside it.
    """
    stat = edges.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.percentile_approx("w", 0.5, 10_000).alias("mid"))
    kind = F.when(F.col("n") <= bound, F.lit("small")).when(F.col("lo") == F.col("hi"), F.lit("level")).otherwise(F.lit("big"))
    marked = materialise(edges.join(stat.withColumn("kind", kind), "part").select("part", "a", "b", "w", "kind", "mid", "hi"))
    kinds = {r[0] for r in marked.select("kind").distinct().collect()}  # at most three
    out = _condensed(marked.filter("kind = 'small'").select("part", "a", "b", "w"), parts, min_size, None)
    if "level" in kinds:
        out = out.unionByName(_one_level(marked.filter("kind = 'level'").select("part", "a", "b", "w"), parts, min_size))
    if "big" not in kinds:
        return materialise(out)
    big = marked.filter("kind = 'big'")
    dense = F.when(F.col("mid") == F.col("hi"), F.col("w") == F.col("hi")).otherwise(F.col("w") > F.col("mid"))
    top, rest = materialise(big.filter(dense).select("a", "b", "w")), big.filter(~dense).select("part", "a", "b", "w")
    forest, label = spanning_forest(top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"))
    named = materialise(label.groupBy("root").agg(F.min("id").alias("part")).join(label, "root").select("id", "part"))
    drop(forest, label)
    made = contract(top.join(named.withColumnRenamed("id", "a"), "a").select("part", "a", "b", "w"), parts, min_size, bound)
    if parts is not None:
        made = made.unionByName(parts.join(named, parts["part"] == named["id"], "left_anti"))
    for end in ("a", "b"):
        to = named.select(F.col("id").alias(end), F.col("part").alias("to"))
        rest = rest.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    deeper = contract(materialise(rest.select("part", "a", "b", "w")), materialise(made), min_size, bound)
    return materialise(out.unionByName(deeper))


def _ends(edges: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The distinct ends of each tree, with the rows of those that are parts."""
    ends = edges.select("part", F.explode(F.array("a", "b")).alias("a")).distinct()
    if parts is None:
        return ends.join(edges.sparkSession.createDataFrame([], f"a string, {_PART}"), "a", "left")
    return ends.join(parts.withColumnRenamed("part", "a"), "a", "left")


def _one_level(edges: DataFrame, parts: DataFrame | None, min_size: int) -> DataFrame:
    """Trees whose edges all weigh the same, as rows: all ends come apart at once.

    Smaller ends than ``min_size`` fall out.  One larger end alone goes on in it; several are clusters born here.
    Salted, so that no task gathers a tree.
    """
    level = edges.groupBy("part").agg((1.0 / F.greatest(1.0 - F.first("w"), F.lit(1e-3))).alias("level"))
    v = _ends(edges, parts).join(level, "part")
    v = v.withColumns({"size": F.coalesce("size", F.lit(1)), "fallen": F.coalesce("fallen", F.lit(0.0)), "ids": F.coalesce("ids", F.array("a")),
                       "top": F.coalesce("top", F.from_json(F.lit("[]"), "array<struct<d:double,id:string>>"))})
    large = F.col("size") >= min_size
    gain = F.col("fallen") - F.col("size") * F.col("level")
    itself = F.array(F.struct(F.col("size").alias("size"), gain.alias("stability"), F.col("top").alias("top"), F.array_min("ids").alias("id")))
    v = v.withColumns({"large": large.cast("long"), "gain": F.greatest(gain, F.coalesce("best", gain)), "born": F.when(F.coalesce(gain >= F.col("best"), F.lit(True)), itself).otherwise(F.col("inside")),
                       "out": F.when(~large, F.transform("ids", lambda i: F.struct((-F.col("level")).alias("d"), i.alias("id")))).otherwise(F.col("top")), "salt": F.pmod(F.xxhash64("a"), F.lit(1024))})

    def least(column: str):
        return F.slice(F.array_sort(F.flatten(F.collect_list(column))), 1, KEEP).alias(column)

    def summed(keys):
        only = [F.max(F.when(F.col("large") > 0, F.col(c))).alias(c) for c in ("level", "best")]
        return [least("out"), least("ids"), F.sum("size").alias("size"), F.sum("large").alias("large"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.sum("gain").alias("gain"),
                F.flatten(F.collect_list("born")).alias("born"), F.flatten(F.collect_list("inside")).alias("inside"), F.sum("fallen").alias("fallen"), only[1], F.max("level").alias("level")]

    none = F.from_json(F.lit("[]"), "array<struct<size:long,stability:double,top:array<struct<d:double,id:string>>,id:string>>")
    v = v.withColumns({"kept": F.when(large, F.col("size")).otherwise(0), "dropped": F.when(large, 0).otherwise(F.col("size")), "gain": F.when(large, F.col("gain")).otherwise(0.0), "fallen": F.when(large, F.col("fallen")).otherwise(0.0),
                       "born": F.when(large, F.col("born")).otherwise(none), "inside": F.when(large, F.coalesce("inside", none)).otherwise(none)})
    g = v.groupBy("part", "salt").agg(*summed(["part", "salt"])).groupBy("part").agg(*summed(["part"]))
    lone = F.col("large") == 1
    return g.select("part", "size", (F.col("dropped") * F.col("level") + F.when(lone, F.col("fallen")).otherwise(F.col("kept") * F.col("level"))).alias("fallen"),
                    F.when(lone, F.col("best")).when(F.col("large") > 1, F.col("gain")).alias("best"), F.col("out").alias("top"), "ids",
                    F.when(lone, F.col("inside")).when(F.col("large") > 1, F.col("born")).otherwise(none).alias("inside"))


def _part(row: dict) -> Part:
    def top(of):
        return [(t["d"], t["id"]) for t in of]

    return Part(row["size"], row["fallen"], row["best"], top(row["top"]), row["ids"], [(c["size"], c["stability"], top(c["top"]), c["id"]) for c in row["inside"]])


def _row(name: str, p: Part) -> dict:
    def top(of):
        return [{"d": d, "id": m} for d, m in of]

    return {"part": name, "size": p.size, "fallen": p.fallen, "best": p.best, "top": top(p.top), "ids": p.ids, "inside": [{"size": n, "stability": g, "top": top(t), "id": c} for n, g, t, c in p.inside]}


def _clusters(root: Part, least: float) -> list[dict]:
    return [{"cluster_id": c, "tree_id": root.ids[0], "size": n, "stability": round(g, 4), "exemplars": [m for _, m in top]} for n, g, top, c in chosen_clusters(root, least)]


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _chosen(roots: DataFrame, least: float) -> DataFrame:
    """The chosen clusters of whole trees."""
    arrow = _arrow(roots.sparkSession, _CLUSTER)

    def run(batches):
        for batch in batches:
            yield from pa.Table.from_pylist([c for r in batch.to_pylist() for c in _clusters(_part(r), least)], schema=arrow).to_batches()

    return roots.mapInArrow(run, _CLUSTER)


def _condensed(edges: DataFrame, parts: DataFrame | None, min_size: int, least: float | None) -> DataFrame:
    """Condenses each tree ``part`` of edges ``part, a, b, w``: to a row of ``part`` and its columns, or, with ``least``, to its chosen clusters.

    A tree reaches one task as edges and, for ends that are parts, their rows; small trees share a task.
    """
    kinds = f"part string, a string, b string, w double, {_PART}"
    own = edges.select("part", "a", "b", "w")
    if parts is not None:
        own = own.unionByName(_ends(edges, parts).filter(F.col("size").isNotNull()), allowMissingColumns=True)
    else:
        own = own.unionByName(edges.sparkSession.createDataFrame([], kinds), allowMissingColumns=True)
    final = least is not None
    schema = _CLUSTER if final else f"part string, {_PART}"
    arrow = _arrow(edges.sparkSession, schema)

    def run(table: pa.Table) -> pa.Table:
        rows = []
        known = {(r["part"], r["a"]): _part(r) for r in table.filter(pa.compute.is_null(table.column("b"))).to_pylist()}
        frame = table.select(["part", "a", "b", "w"]).filter(pa.compute.is_valid(table.column("b"))).to_pandas()
        for name, t in frame.groupby("part", sort=True):
            ids, code = np.unique(np.concatenate([t["a"].to_numpy(object), t["b"].to_numpy(object)]).astype(str), return_inverse=True)
            half = len(t)
            root = condense(code[:half], code[half:], t["w"].to_numpy(float), [known.get((name, i)) or vertex(i) for i in ids.tolist()], min_size)
            rows += _clusters(root, least) if final else [_row(name, root)]
        return pa.Table.from_pylist(rows, schema=arrow)

    return own.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(4096))).groupBy("bucket").applyInArrow(lambda t: run(t), schema)
