"""Test passages inside training documents: size-partitioned MinHash containment search.

An item is searched by its passages: every window of ``passage`` consecutive
words, or, if it is shorter, all its words.  Passages are partitioned by their
size in words, and a document's windows of the same size are the domains of that
partition.  Query and domain being of one size, containment 1 means Jaccard 1,
so a passage's MinHash signature is met by every window that contains it: the
search loses nothing.  A window's signature is a rolling minimum over its words'
hashes.  Windows whose signature is no passage's are dropped where they are made,
by a bitmap of bounded size; the rest meet the passages in a join and are verified
word by word (exact containment of the passage's shingle).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROWS = 4  # MinHash functions in a signature
BITS = (22, 28)  # the bitmap has 2 ** 22 to 2 ** 28 bits (512 KB to 32 MB), by the number of passages

_FIND = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    return _FIND(unicodedata.normalize("NFKC", text).lower()) if text else []


class Signer:
    """MinHash signatures of all windows of a given size over a word list."""

    def __init__(self):
        self.known: dict[str, int] = {}
        rng = np.random.default_rng(20_250_101)
        self.odd = (rng.integers(0, 2**63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 2**63, ROWS, dtype=np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        """One row a MinHash function, one column a word."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            out[i] = h
        x = out[None, :] * self.odd[:, None] + self.add[:, None]
        return x ^ (x >> np.uint64(32))

    @staticmethod
    def windows(h: np.ndarray, size: int) -> np.ndarray:
        """Signatures (int64) of all windows of ``size`` words; minima by doubling."""
        low, width = h, 1
        while width < size:
            step = min(width, size - width)
            low = np.minimum(low[:, : low.shape[1] - step], low[:, step:])
            width += step
        sign = np.full(low.shape[1], size, np.uint64)
        for row in low:
            sign = (sign ^ row) * np.uint64(0x9E3779B97F4A7C15)
            sign ^= sign >> np.uint64(29)
        return sign.view(np.int64)


def passages_of(items: DataFrame, passage: int) -> DataFrame:
    """``item_id, size, sign, words``: each distinct passage of each item once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        signer = Signer()
        for batch in batches:
            out = {"item": [], "size": [], "sign": [], "words": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                size = min(passage, len(words))
                if not size or item is None:
                    continue
                seen = set()
                for i, s in enumerate(signer.windows(signer.hashes(words), size).tolist()):
                    p = " ".join(words[i : i + size])
                    if p not in seen:
                        seen.add(p)
                        for k, v in zip(out, (item, size, s, p)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item"], batch.schema.field(0).type), pa.array(out["size"], pa.int32()), pa.array(out["sign"], pa.int64()), pa.array(out["words"], pa.string())],
                names=["item_id", "size", "sign", "words"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, size int, sign long, words string")


def leaked_passages(docs: DataFrame, items: DataFrame, passage: int = 10) -> DataFrame:
    """``doc_id, item_id, passages``: how many different passages of the item the document contains.

    * null, empty and wordless texts contain nothing and are contained nowhere;
    * repeated documents and items give the pair once per (doc_id, item_id), ids being what they are;
    * texts are read whole; an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    queries = passages_of(items, passage)
    # at least 64 bits a passage, so that one window in 64 passes by chance, up to four million passages; beyond that more pass
    bits_log = min(BITS[1], max(BITS[0], queries.count().bit_length() + 6))
    mask = (1 << bits_log) - 1
    got = queries.select("size", F.col("sign").bitwiseAND(mask).cast("int").alias("bit")).distinct()
    bits = got.select("bit").distinct().toArrow().column(0).to_numpy()  # at most 2 ** 28 numbers, and as many as there are passages
    sizes = sorted(r[0] for r in got.select("size").distinct().collect())  # at most ``passage`` numbers
    table = np.zeros(1 << (bits_log - 3), np.uint8)
    np.bitwise_or.at(table, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        signer, bitmap = Signer(), shared.value
        for batch in batches:
            doc, sign, found = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words or key is None:
                    continue
                h, seen = signer.hashes(words), set()
                for size in sizes:
                    if size > len(words):
                        break
                    s = signer.windows(h, size)
                    low = s & mask
                    for i in np.flatnonzero((bitmap[low >> 3] >> (low & 7)) & 1).tolist():
                        p = " ".join(words[i : i + size])
                        if p not in seen:
                            seen.add(p)
                            doc.append(key)
                            sign.append(s[i])
                            found.append(p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.schema.field(0).type), pa.array(sign, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "sign", "found"])

    windows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sign long, found string")
    # few windows are left; a merge join needs no bound on the passages and splits a hot one
    met = windows.hint("merge").join(queries, (windows["sign"] == queries["sign"]) & (windows["found"] == queries["words"]))
    return met.groupBy("doc_id", "item_id").agg(F.count_distinct("words").alias("passages"))


def leaked_items(docs: DataFrame, items: DataFrame, passage: int = 10) -> DataFrame:
    return leaked_passages(docs, items, passage).select("doc_id", "item_id")


def leak_report(docs: DataFrame, items: DataFrame, passage: int = 10) -> DataFrame:
    """Per leaked item: documents that contain it in whole or part, those that contain it whole, and the largest share contained."""
    total = passages_of(items, passage).groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    hits = leaked_passages(docs, items, passage).join(total, "item_id")
    share = F.col("passages") / F.col("total")
    return hits.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(share == 1).alias("whole"), F.round(F.max(share), 6).alias("most"))
