"""Encoding of texts with a public byte-level BPE vocabulary: speculate and verify.

For every distinct word greedy longest match proposes tokens.  A proposal is the
one true encoding if every adjacent pair is compatible, that is, if BPE would not
merge across the pair's boundary before it has built both tokens; all pairs of a
batch are tested at once.  Only words that fail are merged exactly.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how this vocabulary's tokenizer splits a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words up to this many bytes are remembered by a task, at most KEPT of them.
SHORT, KEPT = 64, 400_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Vocabulary:
    """Ranks, and for every token the last merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        size = max(ranks.values(), default=0) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.usable = {}
        keys, made = [], []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.usable[token] = rank
                continue
            halves = self.merge(token, stop=rank)
            if len(halves) == 2:  # else BPE never makes this token
                self.usable[token] = rank
                self.left[rank], self.right[rank] = halves
                keys.append(halves[0] * size + halves[1])
                made.append(rank)
        # any two tokens whose joint bytes are a token may merge, not only its own halves
        for token, rank in self.usable.items():
            for i in range(1, len(token)):
                a, b = self.usable.get(token[:i]), self.usable.get(token[i:])
                if a is not None and b is not None and (a, b) != (self.left[rank], self.right[rank]):
                    keys.append(a * size + b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.size = size

    def merge(self, word: bytes, stop: int | None = None) -> list[int]:
        """Exact BPE: always the pair of lowest rank, leftmost first; O(n log n).  ``stop``: not that merge itself."""
        n = len(word)
        ranks, ids = self.ranks, [self.ranks[word[i : i + 1]] for i in range(n)]
        end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = ranks.get(word[i : end[j]])
                if r is not None and r != stop:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, e = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            ids[i], end[i], after[i] = r, e, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ids[i] for i in range(n) if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over the tokens that BPE can make."""
        out, i, n, usable, longest = [], 0, len(word), self.usable, self.longest
        while i < n:
            for e in range(min(n, i + longest), i, -1):
                r = usable.get(word[i:e])
                if r is not None:
                    out.append(r)
                    i = e
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE, run over both tokens' bytes, would end with just these two.

        The two tokens are taken apart in reverse order of merging; at each step
        the pieces that face each other at the boundary must not have merged
        earlier than the next piece was built.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(open_):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            clash = (self.keys[at] == key) & (self.made[at] < limit)
            good[open_[clash]] = False
            first = a > b  # the later merge is undone first; on equal ranks the right one, built last
            one_a, one_b = self.left[a] == a, self.left[b] == b
            undo_a = (first & ~one_a) | (~first & one_b & ~one_a)
            undo_b = ~undo_a & ~one_b
            on = ~clash & (undo_a | undo_b)
            limit = np.where(undo_a, a, b + 1)[on]
            a, b = np.where(undo_a, self.right[a], a)[on], np.where(undo_b, self.left[b], b)[on]
            open_ = open_[on]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "replace") for w in words]
        proposals = [[r] if (r := self.usable.get(w)) is not None else self.propose(w) for w in raw]
        counts = np.array([len(p) for p in proposals], np.int64)
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        for i in np.unique(owner[inner[bad]]).tolist():
            proposals[i] = self.merge(raw[i])
        return proposals


def encode_texts(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of each text, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list; a null key and repeated rows stay as
    they are; extra columns are ignored.  Texts are encoded whole, whatever their
    length.  The vocabulary (a fixed 50,256 entries) is read on the driver and broadcast.
    """
    # built once; workers keep it over their tasks
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(path)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        vocabulary, split, known = shared.value, regex.compile(WORDS).findall, {}
        for batch in batches:
            texts = [split(t) if t else [] for t in batch.column(1).to_pylist()]
            if len(known) > KEPT:
                known.clear()
            fresh = list({w for ws in texts for w in ws if w not in known})
            new = dict(zip(fresh, vocabulary.encode_words(fresh))) if fresh else {}
            known.update(new)
            lists = [[t for w in ws for t in known[w]] for ws in texts]
            for w in fresh:
                if len(w) > SHORT:
                    del known[w]
            ends = np.cumsum([0] + [len(x) for x in lists])
            values = pa.array(np.fromiter((t for x in lists for t in x), np.int32, int(ends[-1])))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
