"""Fuzzy replacement of misheard spans by vocabulary terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.functions.text import replacement_floor
from cadenza.operators.matching import edit_join, penalised, pick_apart, spans


def vocabulary_replacements(words: DataFrame, terms: DataFrame, key: str, at: str, edits: int = 2, least: float = 0.5) -> DataFrame:
    """Spans of one to three neighbouring words that are taken for a term: ``key, at, n, phrase, term, score``.

    Candidates within ``edits`` of the glued span come from the edit join; a span that is a term already is left
    alone; each must reach the floor for its length and stopwords.  Of overlapping spans the
    best is kept.  The acoustic score of a decoder, where there is one, can be joined in before choosing.
    """
    s = spans(words, [key], at, 3)
    t = terms.select(F.lower("term").alias("term")).distinct()
    s = s.join(t.withColumnRenamed("term", "phrase"), "phrase", "left_anti")
    near = edit_join(s.select(F.col("glued").alias("word")), t, edits).select(F.col("word").alias("glued"), "term")
    c = s.join(near, "glued").withColumn("score", penalised(F.col("glued"), F.col("term")))
    c = c.filter(F.col("score") >= replacement_floor(F.col("phrase"), F.col("term"), F.col("n"), F.lit(least)))
    c = c.withColumn("pair", F.concat_ws("\t", "term", "phrase"))
    kept = pick_apart(c, key, at, "n", "score", "pair")
    parts = F.split("pair", "\t")
    return kept.select(key, at, "n", parts[1].alias("phrase"), parts[0].alias("term"), "score")


def custom_rules(df: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Spoken forms replaced by written ones, whole words, longer rules first; case is ignored."""
    import re

    c = F.col(text)
    for spoken, written in sorted(rules, key=lambda r: -len(r[0])):
        c = F.regexp_replace(c, rf"(?iu)(?<!\w){re.escape(spoken)}(?!\w)", written.replace("\\", "\\\\").replace("$", "\\$"))
    return df.withColumn(text, c)


def finite_or_all(df: DataFrame, vector: str) -> DataFrame:
    """Rows with finite vectors; if there is none, all rows."""
    from cadenza.functions.vectors import is_finite

    ok = F.coalesce(is_finite(F.col(vector)), F.lit(False))
    any_ok = df.agg(F.coalesce(F.max(ok), F.lit(False)).alias("_any"))  # one row
    return df.crossJoin(F.broadcast(any_ok)).filter(ok | ~F.col("_any")).drop("_any")
