"""Runs of identical or near-identical consecutive tokens, collapsed to one event each.

Only boundary rows matter: a token that differs from its predecessor opens a
run.  A lead over the openings gives the run's count (difference of positions)
and its duration (timestamp just before the next opening).  A clip of any size
is cut into time shards; positions, predecessors and the next opening cross
shards through one summary row per shard.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from cadenza.session import materialise

MARKS = "▁ "


@F.pandas_udf(T.StringType())
def canonical_piece(pieces: pd.Series) -> pd.Series:
    def one(p):
        if p is None:
            return None
        p = unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).lower())
        return p.lstrip(MARKS) or p

    return pieces.map(one)


def piece_classes(pieces: DataFrame) -> DataFrame:
    """``token, class``: the smallest id of those whose pieces are alike; of an id with several pieces the smallest counts.

    Written once: the tokens' rows are used twice, and Spark shuffles them once only if nothing below is a Python function.
    """
    p = pieces.filter(F.col("token").isNotNull() & F.col("piece").isNotNull()).groupBy("token").agg(F.min("piece").alias("piece"))
    p = p.select("token", canonical_piece("piece").alias("piece"))
    return materialise(p.select("token", F.min("token").over(W.partitionBy("piece")).alias("class")))


def collapse_runs(tokens: DataFrame, pieces: DataFrame, max_gap: int = 25, shard: int = 4096, with_token: bool = True) -> DataFrame:
    """Every run of alike tokens as one event: ``clip, chunk, pos, token, ts, n_events, span_frames``.

    Tokens of a clip are ordered by ``ts, chunk, pos``.  A token goes on with the
    run if its id, or its piece without case, Unicode form and leading word
    marks, equals the predecessor's and it starts at most ``max_gap`` frames
    after it.  A single token is a run of one.

    * a token (clip, chunk, pos) delivered again counts once (its latest delivery);
    * rows with null token, ts, clip, chunk or pos don't count;
    * ids without a piece are alike only to themselves; a piece of word marks only stays as it is;
    * empty tables give an empty result; extra columns are ignored.

    ``with_token``: whether ``token`` is wanted; rows are narrower without.
    """
    kept = ["chunk", "pos", *["token"] * with_token]
    t = tokens.select("clip", "chunk", "pos", "token", "ts", "decoded_at").na.drop(subset=["clip", "chunk", "pos", "token", "ts"])
    t = t.groupBy("clip", "chunk", "pos").agg(F.max(F.struct("decoded_at", "token", "ts")).alias("b"))
    t = t.select("clip", "chunk", "pos", F.col("b.token").alias("token"), F.col("b.ts").alias("ts"))
    # no hint: Catalyst broadcasts the vocabulary only if it is small
    t = t.join(piece_classes(pieces), "token", "left")
    t = t.select("clip", *kept, "ts", F.coalesce("class", "token").alias("key"), F.floor(F.col("ts") / shard).cast("int").alias("h"))

    inside = W.partitionBy("clip", "h").orderBy("ts", "chunk", "pos")
    t = t.withColumn("n", F.row_number().over(inside)).withColumn("pk", F.lag("key").over(inside)).withColumn("pt", F.lag("ts").over(inside))
    t = t.withColumn("opens", F.col("pk").isNull() | (F.col("pk") != F.col("key")) | (F.col("ts") - F.col("pt") > max_gap))

    # one row per shard: size, ends, first and last opening that is sure; the first token's waits for the shard before
    sure = F.col("opens") & (F.col("n") > 1)
    s = t.groupBy("clip", "h").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.when(F.col("n") == 1, F.struct("ts", "key", *kept))).alias("first"),
        F.max(F.struct("n", "ts", "key")).alias("last"),
        F.min(F.when(sure, F.struct("n", "pt"))).alias("o1"),
        F.max(F.when(sure, F.struct("n", "ts", *kept))).alias("o2"))
    across = W.partitionBy("clip").orderBy("h")
    s = s.withColumn("base", F.sum("size").over(across) - F.col("size"))
    s = s.withColumn("before", F.lag("last").over(across))
    goes_on = F.coalesce((F.col("before.key") == F.col("first.key")) & (F.col("first.ts") - F.col("before.ts") <= max_gap), F.lit(False))
    s = s.withColumn("head", ~goes_on)
    # the first opening of a shard, as (position, ts just before it)
    opening = F.when(F.col("head"), F.struct((F.col("base") + 1).alias("at"), F.col("before.ts").alias("pt"))).when(
        F.col("o1").isNotNull(), F.struct((F.col("base") + F.col("o1.n")).alias("at"), F.col("o1.pt").alias("pt")))
    s = s.withColumn("opening", opening)
    s = s.withColumn("next", F.first("opening", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing)))
    end = F.max(F.struct("h", (F.col("base") + F.col("size")).alias("n"), F.col("last.ts").alias("ts"))).over(W.partitionBy("clip"))
    s = s.withColumn("stop", F.coalesce("next", F.struct((end["n"] + 1).alias("at"), end["ts"].alias("pt"))))

    def event(n, o, stop_at, stop_t):
        return F.struct(*[o[c].alias(c) for c in kept], o["ts"].alias("ts"),
                        (stop_at - n).cast("int").alias("n_events"), (stop_t - o["ts"]).cast("int").alias("span_frames"))

    base = F.col("base")
    # runs that reach a shard's end, or begin with its first token, come from the summaries
    edge = s.select("clip", F.explode(F.array_compact(F.array(
        F.when(F.col("head") & F.col("o1").isNotNull(), event(base + 1, F.col("first"), base + F.col("o1.n"), F.col("o1.pt"))),
        F.when(F.col("head") & F.col("o1").isNull(), event(base + 1, F.col("first"), F.col("stop.at"), F.col("stop.pt"))),
        F.when(F.col("o2").isNotNull(), event(base + F.col("o2.n"), F.col("o2"), F.col("stop.at"), F.col("stop.pt"))),
    ))).alias("r")).select("clip", "r.*")

    # all others lie between two sure openings of one shard
    b = t.filter(sure).withColumn("at", F.lead("n").over(inside)).withColumn("end", F.lead("pt").over(inside))
    inner = b.filter(F.col("at").isNotNull()).select(
        "clip", *kept, "ts", (F.col("at") - F.col("n")).cast("int").alias("n_events"), (F.col("end") - F.col("ts")).cast("int").alias("span_frames"))
    return inner.unionByName(edge)


def repeated_runs(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """Runs of at least two tokens."""
    return collapse_runs(tokens, pieces, with_token=False).filter("n_events > 1").select("clip", "chunk", "pos", "n_events", "span_frames")
