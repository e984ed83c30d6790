"""Permutation index over unit vectors, shared by the neighbour and cluster operators.

Every vector is represented by its nearest pivots in order of similarity (its
permutation prefix) and posted to the inverted files of the first ``post`` of
them.  Pivots are a sample of the data, so dense regions own many pivots and
inverted files stay of like size: about ``rows * post / pivots`` entries.  The
number of pivots grows with the square root of the rows.

A pivot that is near to a large share of all vectors gets no file of its own: its
postings are split by a second pivot of the prefix, one file a pair, and every
vector is posted under several pairs.  How large files would be is told from the
sample the pivots come from.

A posting carries the vector as 12-bit codes (1.5 bytes a number).  Similarities
of codes differ from exact ones by about 4e-5.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

LEVELS = 2047


def unit_rows(column: pa.Array, dim: int, least_norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of valid vectors and the vectors, scaled to length one.

    Valid: not null, ``dim`` finite numbers (a null number isn't one), norm above ``least_norm``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        ok = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > least_norm)
    return at[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def class_key(row: np.ndarray) -> bytes:
    """The class of copies of a unit vector: vectors of one bit pattern once scaled to length one."""
    return hashlib.blake2b(row.tobytes(), digest_size=12).digest()


def encode(x: np.ndarray) -> np.ndarray:
    """12-bit codes with one scale a row: uint8 array of 4 + 1.5 * dim columns."""
    scale = np.abs(x).max(1, keepdims=True).astype(np.float32) / LEVELS
    q = (np.rint(x / scale) + LEVELS).astype(np.uint16)
    a, b = q[:, 0::2], q[:, 1::2]
    packed = np.stack([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4], 2).astype(np.uint8)
    return np.hstack([scale.view(np.uint8), packed.reshape(len(x), -1)])


def decode(raw: np.ndarray) -> np.ndarray:
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    p = raw[:, 4:].reshape(len(raw), -1, 3).astype(np.int16)
    out = np.empty((len(raw), p.shape[1] * 2), np.float32)
    out[:, 0::2] = p[:, :, 0] | ((p[:, :, 1] & 15) << 8)
    out[:, 1::2] = (p[:, :, 1] >> 4) | (p[:, :, 2] << 4)
    out -= LEVELS
    out *= scale
    return out / np.sqrt((out * out).sum(1, keepdims=True))


@dataclass
class Pivots:
    """Pivots, the number of vectors they index, and which of them are too popular for a file of their own."""

    x: np.ndarray
    rows: int
    popular: np.ndarray

    def __len__(self):
        return len(self.x)

    def partitions(self, post: int, prefix: int, dim: int, size: int = 4 << 20) -> int:
        """Partitions of about ``size`` bytes for all postings."""
        return max(1, -(-self.rows * min(post, len(self)) * (2 * prefix + dim * 3 // 2 + 40) // size))


def sample_pivots(vectors: DataFrame, post: int, dim: int, least_norm: float, most: int = 65_536, count: int | None = None) -> Pivots:
    """Distinct unit vectors of smallest id hash, by default ``pivot_count``: bounded, and the same in every run.

    Twice as many rows are fetched, so that invalid rows and copies leave enough and files can be sized; so at most
    2 * 16,384 vectors reach the driver.  A pivot is popular if its file would hold more than ``most`` vectors.
    """
    rows = vectors.count()
    count = count or pivot_count(rows)
    picked = vectors.filter(F.size("embedding") == dim).select("embedding", F.xxhash64("id", "embedding").alias("h"))
    got = picked.orderBy("h").limit(2 * count).select("embedding").toArrow()
    _, x = unit_rows(got.column("embedding"), dim, least_norm)
    if not len(x):
        return Pivots(x, rows, np.zeros(0, bool))
    _, first = np.unique(x, axis=0, return_index=True)
    distinct = x[np.sort(first)]
    pivots = np.ascontiguousarray(distinct[:count])
    near = nearest(distinct, pivots, min(post, len(pivots)))
    share = np.bincount(near.ravel(), minlength=len(pivots)) / len(distinct)
    return Pivots(pivots, rows, share * rows > most)


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int, block: int = 512) -> np.ndarray:
    """Permutation prefixes: each row's ``prefix`` most similar pivots in order; products are taken ``block`` rows at a time."""
    out = np.empty((len(x), prefix), np.int16)
    for a in range(0, len(x), block):
        sims = x[a : a + block] @ pivots.T
        near = np.argpartition(sims, len(pivots) - prefix, axis=1)[:, len(pivots) - prefix :]
        order = (-np.take_along_axis(sims, near, 1)).argsort(1, kind="stable")
        out[a : a + block] = np.take_along_axis(near, order, 1)
    return out


def pivot_count(rows: int) -> int:
    """Grows with the square root of the rows, so that finding pivots and comparing within files cost alike."""
    return min(16_384, max(16, math.ceil(math.sqrt(rows))))


PAIRED = 5  # pivots of a prefix whose pairs stand for popular ones


def files(near: np.ndarray, post: int, popular: np.ndarray):
    """Yields (rows, file of each).

    A file is one of a row's first ``post`` pivots.  For a popular one among its first ``PAIRED`` it is that pivot with
    another of these, so that a row all of whose pivots are popular has at most ten postings.
    """
    wide = near.astype(np.int64)
    for j in range(min(post, near.shape[1])):
        lone = ~popular[wide[:, j]]
        yield np.flatnonzero(lone), wide[lone, j] << 16
        rows = np.flatnonzero(~lone)
        if j >= PAIRED or not len(rows):
            continue
        own = wide[rows, j]
        for i in range(min(PAIRED, near.shape[1])):
            if i == j:
                continue
            other = wide[rows, i]
            # two popular pivots share one file
            twice = popular[other] & (i < j)
            low = np.where(popular[other], np.minimum(own, other), own)
            high = np.where(popular[other], np.maximum(own, other), other)
            yield rows[~twice], ((low << 16) + high + 1)[~twice]


def postings(vectors: DataFrame, pivots: Pivots, post: int, prefix: int, dim: int, least_norm: float, copies: int) -> DataFrame:
    """Rows (file, id, code): the permutation prefix (int16 each) followed by the 12-bit code, laid out by file.

    Of vectors of one ``class_key`` a task posts only ids that are among the ``copies``
    smallest it has met; so a vector that a third of all rows share can't fill an inverted file.
    """
    prefix = min(prefix, len(pivots))
    shared = vectors.sparkSession.sparkContext.broadcast((pivots.x, pivots.popular))  # at most 16,384 vectors, by pivot_count
    width = 2 * prefix + 4 + dim * 3 // 2
    schema = pa.schema([("file", pa.int64()), ("id", pa.string()), ("code", pa.binary())])

    def run(batches):
        table, popular = shared.value
        kept: dict[bytes, list[str]] = {}
        for batch in batches:
            at, x = unit_rows(batch.column("embedding"), dim, least_norm)
            ids = batch.column("id").take(pa.array(at)).to_pylist()
            keep = np.ones(len(x), bool)
            for i, (row, name) in enumerate(zip(x, ids)):
                held = kept.setdefault(class_key(row), [])
                if name in held:
                    keep[i] = False
                elif len(held) < copies:
                    held.append(name)
                elif name < max(held):
                    held[held.index(max(held))] = name
                else:
                    keep[i] = False
            x, ids = x[keep], np.array(ids, object)[keep]
            if not len(x):
                continue
            near = nearest(x, table, prefix)
            raw = np.hstack([near.view(np.uint8).reshape(len(x), -1), encode(x)])
            names = pa.array(ids, pa.string())
            offsets = pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * width).tobytes())
            code = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
            for rows, file in files(near, post, popular):
                if len(rows):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(file), names.take(at), code.take(at)], schema=schema)

    posted = vectors.select("id", "embedding").filter(F.col("id").isNotNull()).mapInArrow(run, "file long, id string, code binary")
    return posted.repartition(pivots.partitions(post, prefix, dim), "file")


class Cell:
    """One inverted file: distinct ids in ascending order, permutation prefixes and vectors."""

    def __init__(self, table: pa.Table, prefix: int, dim: int):
        order = pc.sort_indices(table.column("id")).to_numpy()
        ids = np.array(table.column("id").to_pylist(), object)[order]
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        self.ids = ids[first]
        code = table.column("code").combine_chunks()
        if isinstance(code, pa.ChunkedArray):
            code = pa.concat_arrays(code.chunks)
        code = code.take(pa.array(order[first]))
        width = 2 * prefix + 4 + dim * 3 // 2
        start = np.frombuffer(code.buffers()[1], np.int32)[code.offset]
        raw = np.frombuffer(code.buffers()[2], np.uint8)[start : start + width * len(self.ids)].reshape(-1, width)
        self.perm = np.ascontiguousarray(raw[:, : 2 * prefix]).view(np.int16)
        self.x = decode(raw[:, 2 * prefix :])

    def __len__(self):
        return len(self.ids)

    def blocks(self, rerank: int, rows: int = 256, only: np.ndarray | None = None):
        """Yields (queries, candidates, similarities); -2 marks pairs that aren't to be reranked, and self.

        The ``rerank`` candidates of least footrule distance over the prefixes are taken (ties at the end stay in),
        or the whole file if it holds no more.  Queries (``only`` these, if given) with like permutations
        share a block, whose products are taken with the union of its candidates.
        """
        n = len(self)
        rows = max(32, min(rows, (1 << 23) // max(1, n)))
        order = np.lexsort(self.perm.T[::-1]) if n > rerank else np.arange(n)
        lists = self.inverted() if n > rerank else None
        if only is not None:
            order = order[only[order]]
        for a in range(0, len(order), rows):
            q = order[a : a + rows]
            if lists is None:
                cols, mask = np.arange(n), None
            else:
                score = self.footrule(q, lists)
                score[np.arange(len(q)), q] = 0
                least = np.partition(score, n - rerank, axis=1)[:, n - rerank]
                mask = score >= np.maximum(least, 1)[:, None]
                cols = np.flatnonzero(mask.any(0))
                mask = mask[:, cols]
            sims = self.x[q] @ self.x[cols].T
            if mask is not None:
                sims[~mask] = -2
            at = np.searchsorted(cols, q)
            here = (at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == q) if len(cols) else np.zeros(len(q), bool)
            sims[np.flatnonzero(here), at[here]] = -2
            yield q, cols, sims

    def inverted(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By pivot: the vectors that have it in their prefix, and what its rank is worth (the first most)."""
        n, length = self.perm.shape
        flat = self.perm.ravel()
        order = flat.argsort(kind="stable")
        pivots, start = np.unique(flat[order], return_index=True)
        worth = (length - (order % length)).astype(self.kind)
        return {p: (r, w) for p, r, w in zip(pivots.tolist(), np.split(order // length, start[1:]), np.split(worth, start[1:]))}

    @property
    def kind(self):
        length = self.perm.shape[1]
        return np.uint8 if length * (length + 1) // 2 < 256 else np.uint16

    def footrule(self, q: np.ndarray, lists: dict) -> np.ndarray:
        """prefix * (prefix + 1) minus the footrule distance, halved: the sum over shared pivots of prefix - max(rank, rank)."""
        length = self.perm.shape[1]
        met, at = np.unique(self.perm[q], return_inverse=True)
        at = at.reshape(len(q), length)
        table = np.zeros((len(met), len(self)), self.kind)  # worth of each pivot that the queries have, by vector
        for row, p in zip(table, met.tolist()):
            rows, worth = lists[p]
            row[rows] = worth
        score = np.zeros((len(q), len(self)), self.kind)
        for j in range(length):
            score += np.minimum(table[at[:, j]], self.kind(length - j))
        return score
