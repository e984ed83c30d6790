"""Queries of text functions."""

from pyspark.sql import Window as W, functions as F, types as T

from cadenza.functions import spoken as K, text as X
from cadenza.operators import texts as O
from cadenza.plans.evaluation import rounded
from cadenza.plans.signals import TOK, tokens
from cadenza.session import table


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "kind")


def written_in(s, d, code, letters):
    """Documents of a language, however it is written (``ZH``, ``zh-ZH``), and those whose text has its letters whatever ``lang`` says."""
    return docs(s, d).filter(F.coalesce(F.lower("lang").rlike(f"^{code}([-_]|$)"), F.lit(False)) | F.coalesce(F.col("text").rlike(letters), F.lit(False)))


def items(s, d):
    return table(s, d, "eval_items").select("item_id", "text", "lang")


def pieces(s, d):
    return table(s, d, "token_pieces").select("token", "piece")


def item_words(s, d):
    return items(s, d).select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("at", "word"))


def model(s, d):
    """A bigram model counted on the documents: relative frequencies in logs, flat back-off."""
    w = docs(s, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("at", "word"))
    n = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    uni = n.crossJoin(F.broadcast(total)).select("word", F.log(F.col("n") / F.col("t")).alias("lp"), F.lit(-1.0).alias("bo"))  # the total is one row
    pairs = w.withColumn("context", F.lag("word").over(W.partitionBy("doc_id").orderBy("at"))).filter("context IS NOT NULL").groupBy("context", "word").agg(F.count(F.lit(1)).alias("c"))
    bi = pairs.join(n.select(F.col("word").alias("context"), "n"), "context").select("context", "word", F.log(F.col("c") / F.col("n")).alias("lp"))
    return uni, bi


def lm(s, d):
    uni, bi = model(s, d)
    return O.bigram_scores(item_words(s, d), uni, bi, ["item_id"], "at").groupBy("item_id").agg(F.round(F.sum("score"), 4).alias("score"))


KANA, HAN = "[\u3041-\u30ff]", "(?s)\\A[^\u3041-\u30ff]*[\u4e00-\u9fff][^\u3041-\u30ff]*\\z"  # Chinese: without kana
ARRAY = T.ArrayType(T.StringType())

QUERIES = {
    "basic_normalize": lambda s, d: items(s, d).select("item_id", X.basic_normalize(F.col("text")).alias("text")),
    "strip_diacritics": lambda s, d: docs(s, d).select("doc_id", X.basic_normalize(F.col("text"), True).alias("text")),
    "similarity_form": lambda s, d: items(s, d).select("item_id", X.for_similarity(F.col("text")).alias("text")),
    "script_filter": lambda s, d: pieces(s, d).select("token", *[X.in_script(F.col("piece"), n).alias(n) for n in X.SCRIPTS]),
    "script_topk": lambda s, d: rounded(O.filtered_top(
        tokens(s, d).groupBy("clip", "token").agg(F.count(F.lit(1)).cast("double").alias("logit")).join(pieces(s, d), "token"), ["clip"], X.in_script(F.col("piece"), "latin") & F.col("piece").startswith("▁"), "logit", "token").na.fill(-1)),
    "cjk_predicate": lambda s, d: docs(s, d).select("doc_id", X.is_cjk(F.col("lang")).alias("cjk")),
    "html_predicate": lambda s, d: docs(s, d).select("doc_id", X.looks_like_html(F.col("text")).alias("html")),
    "term_warnings": lambda s, d: pieces(s, d).select("token", F.array_join(X.term_warnings(F.col("piece")), ",").alias("warnings")),
    "replacement_floor": lambda s, d: rounded(item_words(s, d).select("item_id", "at", X.replacement_floor(F.col("word"), F.lit("transcript"), F.lit(1), F.lit(0.5)).alias("floor"))),
    "capitals_kept": lambda s, d: items(s, d).select("item_id", X.like_case(F.col("text"), F.lit("word")).alias("word")),
    "japanese_normalize": lambda s, d: written_in(s, d, "ja", KANA).select("doc_id", X.normalize_japanese(F.col("text")).alias("text")),
    "tokens_to_text": lambda s, d: tokens(s, d).join(pieces(s, d), "token", "left").groupBy("clip", "chunk").agg(
        X.pieces_to_text(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])).alias("text")),
    "initialisms": lambda s, d: docs(s, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,5})\b")))).alias("word")).select("doc_id", "word", X.spelled(F.col("word")).alias("spoken")),
    "tag_parse": lambda s, d: docs(s, d).filter("kind = 'script'").select("doc_id", F.posexplode(X.tags(F.col("text"))).alias("no", "t")).select("doc_id", "no", "t.name", F.element_at("t.attributes", "rate").alias("rate"), F.element_at("t.attributes", "time").alias("time")),
    "english_normalize": lambda s, d: items(s, d).select("item_id", O.apply_text(F.col("text"), K.normalize_english).alias("text")),
    "number_words": lambda s, d: items(s, d).select("item_id", O.apply_text(F.lower("text"), K.convert_numbers).alias("text")),
    "spell_digits": lambda s, d: items(s, d).select("item_id", O.apply_text(F.col("text"), K.spell_digits).alias("text")),
    "spoken_numbers": lambda s, d: docs(s, d).select("doc_id", O.apply_text(F.col("text"), K.speak_numbers).alias("text")),
    "spoken_markup": lambda s, d: docs(s, d).filter("kind = 'script'").select("doc_id", O.apply_text(F.col("text"), lambda t: K.speak_markup(t)[0]).alias("text")),
    "say_as": lambda s, d: table(s, d, "orders").select("o_orderkey", O.apply_text(F.date_format("o_orderdate", "yyyy-MM-dd"), lambda t: K.say_as(t, "date", "ymd")).alias("spoken")),
    "speech_preprocess": lambda s, d: docs(s, d).select("doc_id", O.apply_text(F.col("text"), K.clean_for_speech).alias("text")),
    "sentence_split": lambda s, d: O.exploded(docs(s, d), ["doc_id"], "text", K.sentences),
    "text_chunks": lambda s, d: O.exploded(docs(s, d), ["doc_id"], "text", lambda t: K.chunks(t, 300)),
    "phoneme_chunks": lambda s, d: O.exploded(docs(s, d), ["doc_id"], "text", lambda t: K.bounded_chunks(t, 200)),
    "segment_packing": lambda s, d: items(s, d).filter("text IS NOT NULL").select("item_id", O.apply_text(F.col("text"), lambda t: K.packed([len(w) for w in t.split()], 40), T.ArrayType(T.IntegerType())).alias("bins")),
    "mandarin_numbers": lambda s, d: written_in(s, d, "zh", HAN).select("doc_id", O.apply_text(F.col("text"), K.han_numbers).alias("text")),
    "ngram_lm_score": lm,
    "json_props": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
    "cjk_rate": lambda s, d: rounded(items(s, d).select("item_id", X.cjk_rate(F.regexp_replace("text", "a", ""), F.col("text")).alias("rate"))),
}

_SCRIPT = {"latin": r"[\x{20}-\x{7F}\x{A0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}]", "cyrillic": r"[\x{20}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}\x{400}-\x{4FF}]",
           "greek": r"[\x{20}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}\x{300}-\x{36F}\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]"}
_DW = r"SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS l FROM documents WHERE text IS NOT NULL)"

ORACLE = {
    "segment_packing": r"""WITH RECURSIVE w AS (SELECT item_id, list_transform(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''), lambda x: length(x)) AS l FROM eval_items WHERE text IS NOT NULL),
st AS (SELECT item_id, l, 1 AS i, CAST(0 AS INT) AS bin, coalesce(l[1], 0) AS used, CASE WHEN len(l) > 0 THEN [CAST(0 AS INT)] ELSE CAST([] AS INT[]) END AS bins FROM w
  UNION ALL
  SELECT item_id, l, i + 1, CASE WHEN fits THEN bin ELSE bin + 1 END, CASE WHEN fits THEN used + l[i + 1] + 1 ELSE l[i + 1] END, list_append(bins, CASE WHEN fits THEN bin ELSE bin + 1 END)
  FROM (SELECT *, used + l[i + 1] + 1 <= 40 AS fits FROM st WHERE i < len(l)))
SELECT item_id, arg_max(bins, i) AS bins FROM st GROUP BY item_id""",
    "similarity_form": r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s''-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM eval_items",
    "script_filter": "SELECT token, " + ", ".join(f"regexp_full_match(replace(piece, '▁', ''), '{p}*') AS {n}" for n, p in _SCRIPT.items()) + " FROM token_pieces",
    "script_topk": f"""WITH {TOK}, g AS (SELECT clip, token, count(*)::DOUBLE AS logit FROM tok GROUP BY 1, 2), p AS (SELECT g.*, piece, regexp_full_match(replace(piece, '▁', ''), '{_SCRIPT['latin']}*') AND piece LIKE '▁%' AS fits FROM g JOIN token_pieces USING (token)),
m AS (SELECT *, max(logit) OVER (PARTITION BY clip) AS m, row_number() OVER (PARTITION BY clip ORDER BY fits DESC, logit DESC, token) AS r FROM p), z AS (SELECT clip, sum(exp(logit - m)) AS z FROM m GROUP BY clip)
SELECT clip, CASE WHEN fits THEN token ELSE -1 END AS token, CASE WHEN fits THEN round(greatest(0, least(1, exp(logit - m) / z)), 6) ELSE -1 END AS probability FROM m JOIN z USING (clip) WHERE r = 1""",
    "cjk_predicate": "SELECT doc_id, regexp_matches(lower(lang), '^(ja|ko|cmn|yue|zh|th|lo)') AS cjk FROM documents",
    "html_predicate": r"SELECT doc_id, coalesce(regexp_matches(text, '(?is)\A\s*<(!doctype|html)'), false) AS html FROM documents",
    "capitals_kept": r"SELECT item_id, CASE WHEN regexp_matches(text, '^\p{Lu}') THEN 'Word' ELSE 'word' END AS word FROM eval_items",
    "tokens_to_text": f"WITH {TOK} SELECT clip, chunk, coalesce(trim(replace(string_agg(piece, '' ORDER BY pos), '▁', ' ')), '') AS text FROM tok LEFT JOIN token_pieces USING (token) GROUP BY clip, chunk",
    "initialisms": r"SELECT doc_id, word, trim(regexp_replace(word, '(.)', '\1 ', 'g')) AS spoken FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{2,5}\b')) AS word FROM documents)",
    "replacement_floor": rf"""SELECT item_id, CAST(i AS INT) AS "at", CASE WHEN word IN ({', '.join(repr(w) for w in [*X.FUNCTION_WORDS, *X.COMMON_WORDS])}) THEN NULL WHEN length(word) <= 4 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS floor
FROM (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS l FROM eval_items))""",
    "japanese_normalize": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([二三四五六七八九])十([一二三四五六七八九])', '\1\2', 'g'), '十([一二三四五六七八九])', '一\1', 'g'), '([二三四五六七八九])十', '\1〇', 'g') AS t FROM documents WHERE coalesce(regexp_matches(lower(lang), '^ja([-_]|$)'), false) OR coalesce(regexp_matches(text, '[\x{3041}-\x{30ff}]'), false)),
b AS (SELECT doc_id, replace(replace(replace(replace(t, '百', '100'), '千', '1000'), '万', '10000'), '十', '10') AS t FROM a)
SELECT doc_id, lower(regexp_replace(translate(t, '０１２３４５６７８９〇零一二三四五六七八九', '012345678900123456789'), '[、。！？・…「」『』（）［］｛｝【】,.!?;:''"()\[\]{}\-\s\x{3000}]', '', 'g')) AS text FROM b""",
    "tag_parse": r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '<([A-Za-z][A-Za-z0-9-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|''[^'']*''))*)\s*/?>', 1) AS l FROM documents WHERE kind = 'script'),
u AS (SELECT doc_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS no FROM t)
SELECT doc_id, CAST(no AS INT) AS no, lower(regexp_extract(tag, '^([\w-]+)', 1)) AS name, nullif(regexp_extract(tag, '\brate\s*=\s*["'']([^"'']*)', 1), '') AS rate, nullif(regexp_extract(tag, '\btime\s*=\s*["'']([^"'']*)', 1), '') AS time FROM u""",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "ngram_lm_score": rf"""WITH w AS ({_DW}), n AS (SELECT word, count(*) AS n FROM w GROUP BY word), u AS (SELECT word, ln(n / (SELECT sum(n) FROM n)) AS lp FROM n),
p AS (SELECT context, word, count(*) AS c FROM (SELECT word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS context FROM w) WHERE context IS NOT NULL GROUP BY 1, 2), b AS (SELECT context, p.word, ln(c / n) AS lp FROM p JOIN n ON n.word = context),
q AS (SELECT item_id, word, lag(word) OVER (PARTITION BY item_id ORDER BY i) AS context FROM (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS l FROM eval_items)))
SELECT item_id, round(sum(coalesce(b.lp, CASE WHEN o.word IS NOT NULL THEN -1.0 ELSE 0.0 END + coalesce(u.lp, -23.026))), 4) AS score
FROM q LEFT JOIN b ON b.context = q.context AND b.word = q.word LEFT JOIN u ON u.word = q.word LEFT JOIN n o ON o.word = q.context GROUP BY item_id""",
}
