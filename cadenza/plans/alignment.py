"""Queries of sequence alignment and stitching, on neighbouring chunks of a clip."""

from pyspark.sql import Window as W, functions as F

from cadenza.operators import sequences as Q
from cadenza.operators.sharded import with_neighbours
from cadenza.plans.evaluation import rounded
from cadenza.plans.signals import TOK, tokens
from cadenza.session import table


def chunks(s, d):
    """Each chunk's tokens beside those of the clip's chunk before."""
    t = tokens(s, d).groupBy("clip", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("cur"))
    # by shards of chunks, as a clip may hold a large share of them
    t = with_neighbours(t.filter("clip IS NOT NULL AND chunk IS NOT NULL").withColumn("_h", F.floor(F.col("chunk") / 64)), ["clip"], "_h", ["chunk"], before={"prev": "cur"})
    return t.drop("_h").filter("prev IS NOT NULL")


def keyed(s, d):
    return chunks(s, d).withColumn("key", F.concat_ws("/", "clip", "chunk"))


def spoken(s, d):
    r = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}' ]", " "), " +", " "))
    return table(s, d, "eval_items").select("item_id", r.alias("ref"), F.regexp_replace(F.regexp_replace(r, "er( |$)", "ar$1"), "(^| )the ", "$1").alias("hyp"))


def openers(s, d):
    return table(s, d, "token_pieces").filter("piece LIKE '▁%' OR piece LIKE ' %'").select("token")


def case_variants(s, d):
    p = table(s, d, "token_pieces").filter("token IS NOT NULL AND piece IS NOT NULL")
    return p.select("token", F.min("token").over(W.partitionBy(F.lower("piece"))).alias("class"))


QUERIES = {
    "suffix_prefix": lambda s, d: chunks(s, d).select("clip", "chunk", Q.suffix_prefix(F.col("prev"), F.col("cur")).alias("n")),
    "suffix_prefix_dedup": lambda s, d: chunks(s, d).select("clip", "chunk", F.size(Q.drop_overlap(F.col("prev"), F.col("cur"))).alias("n")),
    "contiguous_match": lambda s, d: Q.contiguous_match(keyed(s, d), "key", "prev", "cur"),
    "consolidate_matches": lambda s, d: Q.consolidate(
        keyed(s, d).select("key", F.posexplode("prev").alias("l", "x")).join(keyed(s, d).select("key", F.posexplode("cur").alias("r", "x")), ["key", "x"]).select("key", "l", "r"), "key"),
    "bounded_overlap": lambda s, d: Q.pairwise(chunks(s, d), ["clip", "chunk"], "prev", "cur", lambda a, b: list(Q.bounded_overlap(a, b) or ()), "hit"),
    "token_dedup": lambda s, d: Q.pairwise(chunks(s, d), ["clip", "chunk"], "prev", "cur", Q.without_repeat, "rest"),
    "common_subsequence": lambda s, d: Q.pairwise(chunks(s, d), ["clip", "chunk"], "prev", "cur", lambda a, b: [x for x, _ in Q.common_subsequence(a, b)], "at"),
    "stream_stitch": lambda s, d: Q.pairwise(chunks(s, d), ["clip", "chunk"], "prev", "cur", Q.stitch, "joined"),
    "chunk_merge": lambda s, d: Q.merged_stream(tokens(s, d), openers(s, d), case_variants(s, d)),
    "word_errors": lambda s, d: rounded(Q.error_counts(spoken(s, d), "item_id", "hyp", "ref")),
    "char_errors": lambda s, d: rounded(spoken(s, d).filter("ref <> ''").select("item_id", (F.levenshtein(F.replace("hyp", F.lit(" ")), F.replace("ref", F.lit(" "))) / F.length(F.replace("ref", F.lit(" ")))).alias("cer"))),
}

_CH = f"""{TOK}, a AS (SELECT clip, chunk, list(token ORDER BY pos) AS cur FROM tok GROUP BY clip, chunk), c AS (SELECT * FROM (SELECT *, lag(cur) OVER (PARTITION BY clip ORDER BY chunk) AS prev FROM a) WHERE prev IS NOT NULL),
k AS (SELECT *, coalesce(list_max(list_filter(range(2, least(len(prev), len(cur), 12) + 1), lambda n: prev[len(prev) - n + 1:] = cur[:n])), 0) AS n FROM c)"""
_PAIRS = f"""{_CH}, l AS (SELECT clip || '/' || chunk AS key, unnest(prev) AS x, generate_subscripts(prev, 1) - 1 AS i FROM c), r AS (SELECT clip || '/' || chunk AS key, unnest(cur) AS x, generate_subscripts(cur, 1) - 1 AS j FROM c),
m AS (SELECT key, i, j, i - row_number() OVER (PARTITION BY key, i - j ORDER BY i) AS g FROM l JOIN r USING (key, x)), u AS (SELECT key, min(i) AS l, min(j) AS r, count(*) AS n FROM m GROUP BY key, i - j, g)"""
_SP = r"""sp AS (SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}'' ]', ' ', 'g'), ' +', ' ', 'g')) AS ref FROM eval_items),
sh AS (SELECT *, regexp_replace(regexp_replace(ref, 'er( |$)', 'ar\1', 'g'), '(^| )the ', '\1', 'g') AS hyp FROM sp)"""
#: Shared stretches of two or more between the last 15 of a chunk and stretches that begin in the first 20 of the next: the longest, then the first in either.
_SHARED = f"""{_CH}, x AS (SELECT clip, chunk, prev, cur, n AS overlap, unnest(range(greatest(0, len(prev) - 15), len(prev))) AS i FROM k), y AS (SELECT *, unnest(range(0, least(20, len(cur)))) AS j FROM x),
z AS (SELECT *, unnest(range(2, least(15, len(prev) - i, len(cur) - j) + 1)) AS n FROM y WHERE prev[i + 1] = cur[j + 1]),
hit AS (SELECT clip, chunk, arg_min([i, j, n], (-n, i, j)) AS hit FROM z WHERE prev[i + 1:i + n] = cur[j + 1:j + n] GROUP BY clip, chunk)"""
_STITCH = f"""{_CH}, l AS (SELECT clip, chunk, x, i FROM (SELECT clip, chunk, unnest(prev[-32:]) AS x, generate_subscripts(prev[-32:], 1) AS i FROM c)), r AS (SELECT clip, chunk, unnest(cur[:32]) AS x, generate_subscripts(cur[:32], 1) AS j FROM c),
m AS (SELECT clip, chunk, i, j, i - row_number() OVER (PARTITION BY clip, chunk, i - j ORDER BY i) AS g FROM l JOIN r USING (clip, chunk, x)),
u AS (SELECT clip, chunk, max(i) AS i, max(j) AS j, count(*) AS n FROM m GROUP BY clip, chunk, i - j, g), best AS (SELECT clip, chunk, arg_min(j, (-n, i, j)) AS j, max(n) AS n FROM u GROUP BY clip, chunk)"""

ORACLE = {
    "suffix_prefix": f"WITH {_CH} SELECT clip, chunk, CAST(n AS INT) AS n FROM k",
    "suffix_prefix_dedup": f"WITH {_CH} SELECT clip, chunk, CAST(len(cur) - n AS INT) AS n FROM k",
    "contiguous_match": f"WITH {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, l, r) AS k FROM u) SELECT key, CAST(l AS INT) AS l, CAST(r AS INT) AS r, CAST(n AS INT) AS n FROM o WHERE k = 1",
    "consolidate_matches": f"WITH {_PAIRS} SELECT key, CAST(l AS INT) AS l, CAST(r AS INT) AS r, n FROM u",
    "bounded_overlap": f"WITH {_SHARED} SELECT clip, chunk, CAST(coalesce(hit, []) AS INT[]) AS hit FROM k LEFT JOIN hit USING (clip, chunk)",
    "token_dedup": f"WITH {_SHARED} SELECT clip, chunk, CASE WHEN k.n > 0 THEN cur[k.n + 1:] WHEN hit IS NOT NULL THEN cur[hit[2] + hit[3] + 1:] ELSE cur END AS rest FROM k LEFT JOIN hit USING (clip, chunk)",
    "stream_stitch": f"WITH {_STITCH} SELECT clip, chunk, CASE WHEN best.n >= 4 THEN prev || cur[best.j + 1:] ELSE prev || cur END AS joined FROM c LEFT JOIN best USING (clip, chunk)",
    "char_errors": f"WITH {_SP} SELECT item_id, round(levenshtein(replace(hyp, ' ', ''), replace(ref, ' ', '')) / length(replace(ref, ' ', '')), 6) AS cer FROM sh WHERE ref <> ''",
}
