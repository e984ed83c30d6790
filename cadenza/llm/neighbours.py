"""The k most similar vectors of every vector, by a permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.llm.pivots import Cell, class_key, postings, sample_pivots, unit_rows

POST, PREFIX, RERANK = 5, 16, 512


def nearest_vectors(vectors: DataFrame, k: int = 5, least: float = 0.6, dim: int = 256, least_norm: float = 0.1,
                    post: int = POST, prefix: int = PREFIX, rerank: int = RERANK, largest: int = 65_536) -> DataFrame:
    """``id, neighbour, similarity, rank``: at most ``k`` others of cosine at least ``least``, smaller id first on equal values.

    Vectors meet in the inverted files of their first ``post`` pivots; there the
    ``rerank`` nearest by footrule distance are compared by their vectors, and
    each vector's best from all its files are merged.  A file that would hold more than ``largest``
    vectors is split by a second pivot.  Measured recall against brute force: see the tests and the README.

    * an id counts once; ids that are null, and embeddings that are null, of another length,
      with a null, NaN or infinite number or a norm of ``least_norm`` or less, don't count;
    * vectors that are bit-identical once scaled to length one are handled as one class of copies: its members are each other's
      nearest, smallest ids first, and the smallest ``k + 1`` stand for it towards others;
    * an empty table gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    pivots = sample_pivots(vectors, post, dim, least_norm, largest)
    if not len(pivots):
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    length = min(prefix, len(pivots))
    posted = postings(vectors, pivots, post, prefix, dim, least_norm, k + 1)
    out = pa.schema([("id", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float32())])

    def search(table: pa.Table) -> pa.Table:
        cell = Cell(table, length, dim)
        left, right, value = [], [], []
        for q, cols, sims in cell.blocks(rerank):
            if not len(cols):
                continue
            kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1] if k < len(cols) else np.full(len(q), -1, np.float32)
            # all that round to the k-th similarity stay until they are ordered by id: a file may hold many copies
            i, j = np.nonzero(sims >= np.maximum(np.round(kth, 6), least)[:, None] - np.float32(1e-6))
            s = np.round(sims[i, j], 6)
            order = np.lexsort((j, -s, i))  # cols are in the order of ids
            i, j, s = i[order], j[order], s[order]
            keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (s >= least)
            left.append(q[i[keep]])
            right.append(cols[j[keep]])
            value.append(s[keep])
        if not left:
            return out.empty_table()
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table([pa.array(cell.ids[a], pa.string()), pa.array(cell.ids[b], pa.string()), pa.array(np.concatenate(value), pa.float32())], schema=out)

    found = posted.groupBy("file").applyInArrow(search, "id string, neighbour string, similarity float")
    found = found.unionByName(copies(vectors, k, dim, least_norm).withColumn("similarity", F.lit(1.0).cast("float")))
    # one exchange for both steps: a vector has at most (post + 1) * k rows here
    found = found.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").cast("double").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def copies(vectors: DataFrame, k: int, dim: int, least_norm: float) -> DataFrame:
    """For members of classes of copies larger than k: the class's k + 1 smallest ids but their own.

    Classes are those of ``postings``, so that all it leaves out is linked here.  Works on hashes
    and ids alone.  The smallest ids of a class come from a ranking whose limit Catalyst applies
    before the shuffle as well, so no task gathers a class; members then meet one row of their class.
    """
    schema = pa.schema([("id", pa.string()), ("h", pa.binary())])

    def keys(batches):
        for batch in batches:
            at, x = unit_rows(batch.column("embedding"), dim, least_norm)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)).cast(pa.string()), pa.array([class_key(row) for row in x], pa.binary())], schema=schema)

    light = vectors.select("id", "embedding").filter(F.col("id").isNotNull()).mapInArrow(keys, "id string, h binary")
    rank = F.dense_rank().over(W.partitionBy("h").orderBy("id"))
    small = light.withColumn("r", rank).filter(F.col("r") <= k + 1)
    small = small.groupBy("h").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") > k)
    return light.join(small, "h").select("id", F.explode("ids").alias("neighbour")).filter("id != neighbour")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs, each once."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
