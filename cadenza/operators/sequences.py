"""Alignment and stitching of label sequences.

Pure functions over lists, and DataFrame operators that apply them to rows of
array columns in Arrow batches (or, where built-in expressions suffice, in the
JVM).  Sequences are whole; none is cut before it is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.sessions import fold, per_key

Same = Callable[[object, object], bool]


def equal(a, b) -> bool:
    return a == b


# built-in expressions

def suffix_prefix(a: Column, b: Column, most: int = 12) -> Column:
    """Length of the longest suffix of ``a``, of two or more, that is a prefix of ``b``; 0 without any."""
    top = F.least(F.size(a), F.size(b), F.lit(most))
    lengths = F.when(top >= 2, F.reverse(F.sequence(F.lit(2), F.greatest(top, F.lit(2))))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(lengths, lambda k: F.slice(a, -k, k) == F.slice(b, F.lit(1), k))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(0))


def drop_overlap(a: Column, b: Column, most: int = 12) -> Column:
    """``b`` without the part that repeats the end of ``a``."""
    k = suffix_prefix(a, b, most)
    return F.slice(b, k + 1, F.greatest(F.size(b) - k, F.lit(0)))


def contiguous_match(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Longest equal stretch of two arrays per row: ``key, l, r, n`` (from 0; the first in the left, then in the right, on ties).

    Equal labels meet by a join; neighbours on one diagonal form runs.
    """
    a = df.select(key, F.posexplode(left).alias("i", "x"))
    b = df.select(key, F.posexplode(right).alias("j", "x"))
    m = a.join(b, [key, "x"]).withColumn("d", F.col("i") - F.col("j"))
    m = m.withColumn("g", F.col("i") - F.row_number().over(W.partitionBy(key, "d").orderBy("i")))
    r = m.groupBy(key, "d", "g").agg(F.min("i").alias("l"), F.min("j").alias("r"), F.count(F.lit(1)).cast("int").alias("n"))
    best = r.groupBy(key).agg(F.max(F.struct("n", (-F.col("l")).alias("l"), (-F.col("r")).alias("r"))).alias("b"))
    return best.select(key, (-F.col("b.l")).alias("l"), (-F.col("b.r")).alias("r"), "b.n")


def consolidate(matches: DataFrame, key: str) -> DataFrame:
    """Unit matches ``l, r`` that advance together become runs ``key, l, r, n``."""
    m = matches.withColumn("g", F.col("l") - F.row_number().over(W.partitionBy(key, F.col("l") - F.col("r")).orderBy("l")))
    return m.groupBy(key, (F.col("l") - F.col("r")).alias("d"), "g").agg(F.min("l").alias("l"), F.min("r").alias("r"), F.count(F.lit(1)).alias("n")).drop("d", "g")


# list functions

def edit_counts(hyp: list, ref: list) -> dict[str, int]:
    """Errors of the least-cost alignment: equal, replaced, ``ref_only`` (missed) and ``hyp_only`` (extra).

    Ties are resolved from the end: keep, replace, drop the hypothesis's, take the reference's.
    """
    if not hyp or not ref:
        return {"equal": 0, "replaced": 0, "ref_only": len(ref), "hyp_only": len(hyp)}
    rows = [list(range(len(ref) + 1))]
    for i, h in enumerate(hyp, 1):
        last, row = rows[-1], [i]
        for j, r in enumerate(ref, 1):
            row.append(last[j - 1] if h == r else 1 + min(last[j - 1], last[j], row[-1]))
        rows.append(row)
    out = {"equal": 0, "replaced": 0, "ref_only": 0, "hyp_only": 0}
    i, j = len(hyp), len(ref)
    while i or j:
        if i and j and hyp[i - 1] == ref[j - 1]:
            move = "equal"
        elif i and j and rows[i][j] == rows[i - 1][j - 1] + 1:
            move = "replaced"
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            move = "hyp_only"
        else:
            move = "ref_only"
        out[move] += 1
        i -= move != "ref_only"
        j -= move != "hyp_only"
    return out


def distance(a: list, b: list) -> int:
    """Levenshtein distance over any items."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner if x == y else 1 + min(corner, row[j], row[j - 1])
    return row[-1]


def diff(hyp: list[str], ref: list[str]) -> tuple[list[str], list[str]]:
    """Both word lists with ``[...]`` around what differs."""
    n, m = len(hyp), len(ref)
    keep = dict(common_subsequence(hyp, ref))
    kept = set(keep.values())
    return [w if i in keep else f"[{w}]" for i, w in enumerate(hyp[:n])], [w if j in kept else f"[{w}]" for j, w in enumerate(ref[:m])]


def common_subsequence(a: list, b: list, same: Same = equal) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; found from the end, stepping back in ``b`` on ties."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        last, row = table[-1], [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if same(x, y) else max(last[j], row[-1]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if same(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def longest_stretch(a: list, b: list, same: Same = equal) -> list[tuple[int, int]]:
    """Index pairs of the longest run of neighbours that match; the first in ``a``, then in ``b``, on ties."""
    best, end = 0, (0, 0)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        fresh = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if same(x, y):
                fresh[j + 1] = n = row[j] + 1
                start = (i - n + 1, j - n + 1)
                if n > best or (n == best and start < end):
                    best, end = n, start
        row = fresh
    return [(end[0] + k, end[1] + k) for k in range(best)]


def bounded_overlap(prev: list, cur: list, most: int = 15, within: int = 20) -> tuple[int, int, int] | None:
    """(begin in prev, begin in cur, length) of the longest shared stretch of two or more between the last ``most`` of prev and stretches that begin within the first ``within`` of cur."""
    tail = max(0, len(prev) - most)
    for n in range(min(most, len(cur), len(prev)), 1, -1):
        heads = {}
        for j in range(min(within, len(cur) - n + 1)):
            heads.setdefault(tuple(cur[j : j + n]), j)
        for i in range(tail, len(prev) - n + 1):
            j = heads.get(tuple(prev[i : i + n]))
            if j is not None:
                return i, j, n
    return None


def without_repeat(prev: list, cur: list, marks: frozenset = frozenset(), most: int = 12) -> list:
    """``cur`` without what repeats the end of ``prev``: one shared punctuation mark, then a suffix that is a prefix, else a bounded overlap."""
    if prev and cur and prev[-1] == cur[0] and cur[0] in marks:
        cur = cur[1:]
    for n in range(min(most, len(prev), len(cur)), 1, -1):
        if prev[-n:] == cur[:n]:
            return cur[n:]
    hit = bounded_overlap(prev, cur, min(15, len(prev)))
    return cur[hit[1] + hit[2] :] if hit else cur


def stitch(prefix: list, suffix: list, window: int = 32, least: int = 4) -> list:
    """Join two streams over their longest shared stretch (last ``window`` of one, first of the other); without one of ``least``, just end to end."""
    if not prefix or not suffix:
        return list(prefix) + list(suffix)
    tail, head = prefix[-window:], suffix[:window]
    best, end, row = 0, 0, [0] * (len(head) + 1)
    for x in tail:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(head)]
        top = max(row)
        if top > best:
            best, end = top, row.index(top)
    return list(prefix) + list(suffix[end:] if best >= least else suffix)


def word_edges(opens: list[bool]) -> tuple[list[int], list[int]]:
    """By position: the last one up to it that opens a word (-1 without any), and the first one from it on (the length without any)."""
    before = list(accumulate((i if o else -1 for i, o in enumerate(opens)), max))
    after = list(accumulate((i if opens[i] else len(opens) for i in reversed(range(len(opens)))), min, initial=len(opens)))
    return before, after[::-1]


def anchors(left: list[tuple], right: list[tuple], la: range, ra: range, within: float, key: Callable[[tuple], object]) -> list[tuple[int, int]]:
    """Index pairs that two streams share in ``la`` and ``ra``: one stretch if it has half of ``la``, else a longest common subsequence."""
    def same(i, j):
        return key(left[i]) == key(right[j]) and abs(left[i][1] - right[j][1]) < within

    if min(len(la), len(ra)) < 2:
        return []
    pairs = longest_stretch(la, ra, same)
    if len(pairs) < max(len(la) // 2, 1):
        pairs = common_subsequence(la, ra, same)
    return [(la[i], ra[j]) for i, j in pairs]


def merge_chunks(left: list[tuple], right: list[tuple], overlap: float = 2.0, frame: float = 0.08,
                 opens: Callable[[tuple], bool] | None = None, key: Callable[[tuple], object] = itemgetter(0), longest_word: int = 12) -> list[tuple]:
    """Two overlapping decodes of one stream as one; items are (label, frame, ...), in order of frames.

    The result is put down as a table of rows (side, position) first.  Anchors are shared items (of one ``key``, so that
    variants in case can meet, and less than half the overlap apart); between anchors the side with more items gives the rows,
    the left on ties.  Without anchors the sides meet in the middle of the overlap.  ``opens`` tells items that begin a word:
    then seams are moved to where a word begins, and a seam word comes whole from one side.
    """
    if not left or not right or (left[-1][1] + 1) * frame <= right[0][1] * frame:
        return left + right
    stop, begin = (left[-1][1] + 1) * frame, right[0][1] * frame
    la = range(next(i for i, t in enumerate(left) if (t[1] + 1) * frame > begin - overlap), len(left))
    ra = range(sum(t[1] * frame < stop + overlap for t in right))
    sides = (left, right)
    marks = [[opens(t) for t in side] if opens else [True] * len(side) for side in sides]
    edges = [word_edges(m) for m in marks]

    def rows(side: int, a: int, z: int) -> list[tuple[int, int]]:
        return [(side, k) for k in range(a, z)]

    pairs = anchors(left, right, la, ra, overlap / 2 / frame, key)
    if not pairs:
        cut, go = (next((k for k, t in enumerate(side) if t[1] * frame >= (stop + begin) / 2), len(side)) for side in sides)
        plan = rows(0, 0, edges[0][1][cut] if cut else 0) + rows(1, edges[1][1][go], len(right))
    else:
        plan = rows(0, 0, pairs[0][0])
        for (i, j), (ni, nj) in zip(pairs, pairs[1:]):
            plan += rows(0, i, i + 1) + (rows(1, j + 1, nj) if nj - j > ni - i else rows(0, i + 1, ni))
        i, j = pairs[-1]
        plan += rows(0, i, i + 1)
        rest = j + 1
        if rest < len(right) and not marks[1][rest]:  # the seam lies inside a word
            opening = word_edges([marks[side][k] for side, k in plan])[0][-1]
            if edges[1][0][j] >= 0 and opening >= max(0, len(plan) - longest_word):  # the right side has the word whole
                plan, rest = plan[:opening], edges[1][0][j]
            else:
                plan += rows(0, i + 1, edges[0][1][i + 1])
                rest = edges[1][1][rest]
        plan += rows(1, rest, len(right))
    return [sides[side][k] for side, k in plan]


# DataFrame operators

def merged_stream(tokens: DataFrame, opening: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """Chunks of a clip, in order, folded into one token stream: ``clip, n, token, ts``.

    ``tokens(clip, chunk, pos, token, ts)``; ``opening(token)`` lists tokens that begin a word, ``variants(token, class)``
    those that differ in case only.  A clip's tokens (a few numbers each) are held by one task: what the chunks so far
    make up decides how the next one joins.
    """
    x = tokens.withColumn("at", F.col("chunk").cast("long") * 1_000_000 + F.col("pos")).withColumns({"opens": F.lit(opening is None), "same": F.col("token")})
    if opening is not None:
        x = x.drop("opens").join(opening.select("token", F.lit(True).alias("opens")).distinct(), "token", "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    if variants is not None:
        x = x.join(variants.groupBy("token").agg(F.min("class").alias("_c")), "token", "left").withColumn("same", F.coalesce("_c", "token"))
    fields = ["chunk", "token", "ts", "opens", "same"]

    def run(row):
        chunks: dict[int, list] = {}
        for c, *item in zip(*(row[f] for f in fields)):
            chunks.setdefault(c, []).append(tuple(item))
        out: list = []
        for c in sorted(chunks):
            # only the end of what is joined can meet the next chunk
            begin = min(item[1] for item in chunks[c])
            k = len(out)
            while k and (out[k - 1][1] + 1) * 0.08 > begin * 0.08 - 4.0:
                k -= 1
            k = max(0, k - 14)
            out = out[:k] + merge_chunks(out[k:], chunks[c], opens=itemgetter(2), key=itemgetter(3))
        return [(i, item[0], item[1]) for i, item in enumerate(out)]

    return fold(per_key(x, ["clip"], "at", fields), ["clip"], "n int, token int, ts int", run)


def error_counts(df: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """Word and character error counts of two texts that are already normalised: ``wer, cer`` and the counts.

    Empty references give a rate of 0; nulls count as empty; characters are compared without blanks.
    """
    h, r = F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit(""))
    a, b = F.replace(h, F.lit(" "), F.lit("")), F.replace(r, F.lit(" "), F.lit(""))
    rows = df.select(key, h.alias("h"), r.alias("r"), F.when(F.length(b) > 0, F.levenshtein(a, b) / F.length(b)).otherwise(0.0).alias("cer"))

    def run(row):
        words = row["r"].split()
        c = edit_counts(row["h"].split(), words)
        errors = c["replaced"] + c["ref_only"] + c["hyp_only"]
        return [(c["equal"], c["replaced"], c["ref_only"], c["hyp_only"], errors / len(words) if words else 0.0, row["cer"])]

    return fold(rows, [key], "equal int, replaced int, ref_only int, hyp_only int, wer double, cer double", run)


def pairwise(df: DataFrame, keys: list[str], left: str, right: str, fn: Callable[[list, list], list], out: str, kind: str = "array<int>") -> DataFrame:
    """A list function applied to two array columns."""
    rows = df.select(*keys, F.coalesce(left, F.array()).alias("_l"), F.coalesce(right, F.array()).alias("_r"))
    return fold(rows, keys, f"{out} {kind}", lambda row: [(fn(row["_l"], row["_r"]),)])
