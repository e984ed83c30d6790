"""Clusterings, decoders and order-dependent assignment, on groups or as distributed passes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.sessions import fold


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def renumbered(labels) -> list[int]:
    """Labels by first appearance."""
    seen: dict[int, int] = {}
    return [seen.setdefault(int(v), len(seen)) for v in labels]


def linkage(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Centroid linkage: merges (left, right, distance, size) of nodes 0..n-1 and then n, n+1, ...; distances may fall."""
    n = len(x)
    centre, size, name = x.astype(float).copy(), np.ones(n), list(range(n))
    d = ((centre[:, None] - centre[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    out = []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((min(name[i], name[j]), max(name[i], name[j]), math.sqrt(max(d[i, j], 0)), int(size[i] + size[j])))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        name[i] = n + step
        d[j, :] = d[:, j] = np.inf
        alive = np.isfinite(d[i])
        alive[[i, j]] = False
        d[i, alive] = d[alive, i] = ((centre[alive] - centre[i]) ** 2).sum(1)
    return out


def agglomerate(x: np.ndarray, similarity: float) -> list[int]:
    """Cluster of each row: from the root down, the first node whose distance is at most that of the similarity stays whole."""
    n = len(x)
    if n < 2:
        return [0] * n
    merges = linkage(unit_rows(x))
    cut = math.sqrt(max(0.0, 2 - 2 * max(-1.0, min(1.0, similarity))))
    label, todo, k = [0] * n, [2 * n - 2], 0
    while todo:
        v = todo.pop()
        if v < n or merges[v - n][2] <= cut:
            stack = [v]
            while stack:
                u = stack.pop()
                if u < n:
                    label[u] = k
                else:
                    stack += merges[u - n][:2]
            k += 1
        else:
            todo += merges[v - n][:2]
    return renumbered(label)


class Seeded:
    """Random whole numbers that a seed fixes: a linear congruential generator of 64 bits; draws below a bound by its high product."""

    # fixed values: multiplier and increment, as partitions depend on them
    MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = seed

    def below(self, n: int) -> int:
        while True:
            self.state = (self.state * self.MULTIPLIER + self.INCREMENT) % (1 << 64)
            high, low = divmod(self.state * n, 1 << 64)
            if low >= (1 << 64) % n:  # else the draw would favour small numbers
                return high

    def shuffled(self, n: int) -> list[int]:
        order = list(range(n))
        for i in range(n - 1):
            j = i + self.below(n - i)
            order[i], order[j] = order[j], order[i]
        return order


def kmeans(x: np.ndarray, k: int, seeds: int = 10, rounds: int = 100) -> tuple[list[int], float]:
    """Best of several seeded starts by inertia; rows as many as clusters or fewer keep their own labels. Empty clusters take a random row."""
    x = unit_rows(x)
    if len(x) <= k:
        return list(range(len(x))), 0.0
    best = None
    for seed in range(seeds):
        draw = Seeded(seed)
        centre, label = x[draw.shuffled(len(x))[:k]].copy(), np.zeros(len(x), int)
        for _ in range(rounds):
            new = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            if (new == label).all():
                break
            label = new
            for c in range(k):
                centre[c] = x[label == c].mean(0) if (label == c).any() else x[draw.below(len(x))]
        inertia = float(((x - centre[label]) ** 2).sum())
        if best is None or inertia < best[1]:
            best = renumbered(label), inertia
    return best


def within_bounds(x: np.ndarray, labels: list[int], low: int, high: int) -> list[int]:
    """The partition, or one anew by k-means if its number of clusters lies outside the bounds: into the nearer bound."""
    n = len(set(labels))
    wanted = min(max(n, low), high)
    return list(labels) if n == wanted else kmeans(x, wanted)[0]


def variational(x: np.ndarray, phi: np.ndarray, start: list[int], fa: float = 0.07, fb: float = 0.8, rounds: int = 20, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Refines hard clusters by variational Bayes over ``x`` with between-class variances ``phi``: (responsibilities, weights)."""
    s, (t, d) = max(start) + 1, x.shape
    phi = np.maximum(phi, 1e-12)
    rho = x * np.sqrt(phi)
    own = np.zeros((t, s))
    own[np.arange(t), start] = 7.0
    gamma = np.exp(own - own.max(1, keepdims=True))
    gamma /= gamma.sum(1, keepdims=True)
    weight = np.full(s, 1 / s)
    base = -0.5 * ((x**2).sum(1) + d * math.log(2 * math.pi))
    last = -math.inf
    for _ in range(rounds):
        inv = 1 / (1 + fa / fb * gamma.sum(0)[:, None] * phi)
        alpha = fa / fb * inv * (gamma.T @ rho)
        log = fa * (rho @ alpha.T - 0.5 * ((inv + alpha**2) @ phi) + base[:, None]) + np.log(weight + 1e-300)
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        gamma = np.exp(log - total[:, None])
        weight = gamma.sum(0) / gamma.sum()
        bound = total.sum() + fb * 0.5 * (np.log(inv) - inv - alpha**2 + 1).sum()
        if abs(bound - last) < least:
            break
        last = bound
    return gamma, weight


def speaker_counts(n: Column, number: Column, low: Column, high: Column) -> Column:
    """Allowed number of clusters, ``(low, high)``: a wanted number wins; bounds lie within 1 and n, the lower not above the upper."""
    top = F.greatest(F.lit(1), F.least(n, F.coalesce(number, high, n)))
    floor = F.greatest(F.lit(1), F.least(n, F.coalesce(number, low, F.lit(1))))
    return F.struct(F.least(floor, top).alias("low"), top.alias("high"))


def clustered(df: DataFrame, group: str, item: str, vector: str, how) -> DataFrame:
    """``group, item, cluster``: a clustering of each group's vectors; ``how(matrix) -> labels``.

    For groups that are small by nature (the segments of one recording): all their vectors are in one task.  Across
    groups everything is spread.  Null, empty and non-finite vectors are left out.
    """
    from cadenza.functions.vectors import is_finite

    ok = df.filter(is_finite(F.col(vector)) & (F.size(vector) > 0))
    g = ok.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(vector).alias("v")))).alias("x"))
    kind = dict(df.dtypes)[item]

    def run(row):
        return list(zip([x["i"] for x in row["x"]], how(np.array([x["v"] for x in row["x"]], float))))

    return fold(g, [group], f"{item} {kind}, cluster int", run)


class Registry:
    """Assign-or-create: a voice joins the nearest entry below ``far``, renews it below ``near``, or founds one if long enough."""

    def __init__(self, far: float = 0.65, near: float = 0.45, least: float = 1.0, keep: float = 0.9, history: int = 50):
        self.far, self.near, self.least, self.keep, self.history = far, near, least, keep, history
        self.entries: list[dict] = []

    def add(self, v, duration: float) -> int | None:
        v = np.asarray(v, float)
        n = np.linalg.norm(v)
        if not n:
            return None
        v = v / n
        d = [1 - float(v @ e["main"]) for e in self.entries]
        best = min(range(len(d)), key=lambda i: (d[i], i), default=None)
        if best is not None and d[best] < self.far:
            e = self.entries[best]
            e["duration"] += duration
            if d[best] < self.near:
                e["past"] = (e["past"] + [v])[-self.history :]
                # the history's mean replaces the main vector before it is renewed
                main = unit_rows(np.mean(e["past"], axis=0)[None])[0]
                e["main"] = unit_rows((self.keep * main + (1 - self.keep) * v)[None])[0]
            return best
        if duration >= self.least:
            self.entries.append({"main": v, "past": [v], "duration": duration})
            return len(self.entries) - 1
        return None


def assigned(df: DataFrame, stream: str, at: str, item: str, vector: str, duration: str, **params) -> DataFrame:
    """``stream, item, entry`` (null where too short): each stream's voices in order. Order-dependent, so one stream is one fold; streams are spread."""
    g = df.filter(F.col(vector).isNotNull()).groupBy(stream).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(item).alias("i"), F.col(vector).alias("v"), F.col(duration).cast("double").alias("d")))).alias("x"))
    kind = dict(df.dtypes)[item]

    def run(row):
        r = Registry(**params)
        return [(x["i"], r.add(x["v"], x["d"] or 0.0)) for x in row["x"]]

    return fold(g, [stream], f"{item} {kind}, entry int", run)


def moving_average(df: DataFrame, key: str, at: str, vector: str, keep: float = 0.9) -> DataFrame:
    """Exponentially renewed unit vector per key, as a fold in the JVM."""
    from cadenza.functions.vectors import l2

    g = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, F.col(vector).alias("v")))), lambda r: l2(r["v"])).alias("x"))
    step = lambda acc, v: F.when(F.size(acc) == 0, v).otherwise(l2(F.zip_with(acc, v, lambda a, b: keep * a + (1 - keep) * b)))
    return g.select(key, F.aggregate("x", F.array().cast("array<double>"), step).alias("v"))


def integrate_and_fire(df: DataFrame, key: str, at: str, alpha: str, threshold: float = 1.0, tail: float = 0.45) -> DataFrame:
    """Weights accumulate until they reach the threshold; each firing is ``key, no, at, part``: its place and the part of that weight used. The rest carries over; ``tail`` may fire at the end."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(alpha).cast("double").alias("a")))).alias("x"))

    def run(row):
        total, n = 0.0, 0
        for x in [*row["x"], {"t": (row["x"][-1]["t"] + 1) if row["x"] else 0, "a": tail}]:
            total += x["a"] or 0.0
            if total >= threshold:
                total -= threshold
                yield (n, x["t"], (x["a"] or 0.0) - total)
                n += 1

    return fold(g, [key], "no int, at long, part double", run)


# decoding of frame log-probabilities

def _add(a: float, b: float) -> float:
    top = max(a, b)
    return top if top == -math.inf else top + math.log(math.exp(a - top) + math.exp(b - top))


def greedy(frames: list[list[float]], blank: int) -> list[int]:
    out, last = [], None
    for f in frames:
        best = max(range(len(f)), key=lambda i: (f[i], -i))
        if best != blank and best != last:
            out.append(best)
        last = best
    return out


def beam_search(frames: list[list[float]], pieces: dict[int, str], blank: int, width: int = 100, candidates: int = 40, score=None, weight: float = 0.3, bonus: float = 0.0) -> list[int]:
    """Likeliest label sequence by prefix beams; ``score(word, before)`` adds a language model where words end.

    A beam keeps the mass that ends in a blank apart from that which doesn't: a repeated label needs a blank between.
    """
    beams = {(): [0.0, -math.inf, 0.0, "", None]}  # mass ending in blank, not so; language score, open word, word before
    for f in frames:
        top = sorted((v for v in range(len(f)) if v != blank), key=lambda v: (-f[v], v))[:candidates]
        fresh: dict[tuple, list] = {}

        def put(prefix, b, n, rest):
            old = fresh.get(prefix)
            fresh[prefix] = [_add(old[0], b), _add(old[1], n), *old[2:]] if old else [b, n, *rest]

        for prefix, (b, n, lm, word, before) in beams.items():
            both = _add(b, n)
            put(prefix, both + (f[blank] if 0 <= blank < len(f) else -math.inf), -math.inf, (lm, word, before))
            for v in top:
                piece = pieces.get(v, "")
                rest = (lm, word + piece, before)
                if piece.startswith("▁"):
                    rest = (lm + (weight * score(word, before) + bonus if score and word else 0.0), piece[1:], word or before)
                if prefix and prefix[-1] == v:
                    put(prefix, -math.inf, n + f[v], (lm, word, before))
                    put(prefix + (v,), -math.inf, b + f[v], rest)
                else:
                    put(prefix + (v,), -math.inf, both + f[v], rest)
        ranked = sorted(fresh.items(), key=lambda x: (-(_add(x[1][0], x[1][1]) + x[1][2]), x[0]))
        beams = dict(ranked[:width])

    def final(x):
        b, n, lm, word, before = x[1]
        return _add(b, n) + lm + (weight * score(word, before) + bonus if score and word else 0.0)

    return list(max(sorted(beams.items()), key=final)[0])


def spot(frames: list[list[float]], keyword: list[int | None], blank: int, first: int = 0, last: int | None = None) -> tuple[float, int, int]:
    """(score per label, begin, end) of the best place of a keyword within frames [first, last); ``None`` is a wildcard that costs nothing.

    States are labels with blanks between; a label may follow another unlike one at once.  A keyword may begin anywhere.
    """
    part = frames[first:last]
    n = sum(k is not None for k in keyword)
    if not keyword or not part:
        return -math.inf, first, first
    states: list = []
    for k in keyword:
        states += ["blank", k]
    states = states[1:]  # k1, blank, k2, ...
    best, live = (-math.inf, first, first), [(-math.inf, 0)] * len(states)
    for t, f in enumerate(part):
        fresh = []
        for s, label in enumerate(states):
            options = [live[s]]
            if s == 0:
                options.append((0.0, t))
            else:
                options.append(live[s - 1])
                if label != "blank" and s >= 2 and label != states[s - 2]:
                    options.append(live[s - 2])
            score, begin = max(options, key=lambda o: o[0])
            gain = 0.0 if label is None else f[blank if label == "blank" else label]
            fresh.append((score + gain, begin))
        live = fresh
        score, begin = live[-1]
        if score / max(n, 1) > best[0]:
            best = (score / max(n, 1), first + begin, first + t + 1)
    return best


def arbitrate(content: Column, agreement: Column, conf_a: Column, conf_c: Column, suppressed: Column, ratio: Column, conf_b: Column) -> Column:
    """Which of three decodes is kept: C for more content that agrees at like confidence, B if A lost nothing to it and it is shorter and surer, else A."""
    c = (content >= 1.15) & (agreement >= 0.75) & (F.abs(conf_c - conf_a) <= 0.03)
    b = ~(suppressed >= 0.6) & (ratio <= 0.9) & (conf_b > conf_a + 0.001)
    return F.when(c, F.lit("C")).when(b, F.lit("B")).otherwise(F.lit("A"))
