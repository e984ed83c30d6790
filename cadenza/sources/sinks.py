"""Writers of results and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def json_report(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order; NaN (not measured) becomes null."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def kaldi_lines(df: DataFrame) -> dict[str, DataFrame]:
    """The six files of a split as single-column tables, from ``utt, rec, spk, s, e, wav``: sorted, one key a line.

    Speakers per recording and utterances per speaker are grouped; times are in hundredths of a second.
    """
    def text(*parts: Column) -> Column:
        return F.concat_ws(" ", *parts).alias("value")

    def cs(c: str) -> Column:
        return F.format_string("%.2f", c)

    per = df.groupBy("rec").agg(F.max("e").alias("e"), F.count_distinct("spk").alias("n"), F.min("wav").alias("wav"))
    return {
        "wav.scp": per.select(text(F.col("rec"), F.col("wav"))).orderBy("value"),
        "segments": df.select(text(F.col("utt"), F.col("rec"), cs("s"), cs("e"))).orderBy("value"),
        "utt2spk": df.select(text(F.col("utt"), F.col("spk"))).orderBy("value"),
        "spk2utt": df.groupBy("spk").agg(F.array_join(F.array_sort(F.collect_set("utt")), " ").alias("u")).select(text(F.col("spk"), F.col("u"))).orderBy("value"),
        "reco2dur": per.select(text(F.col("rec"), cs("e"))).orderBy("value"),
        "reco2num_spk": per.select(text(F.col("rec"), F.col("n").cast("string"))).orderBy("value"),
    }


def kaldi_split(df: DataFrame, folder: str) -> None:
    for name, part in kaldi_lines(df).items():
        part.write.mode("overwrite").text(f"{folder}/{name}")


def rttm(df: DataFrame, path: str) -> None:
    """``rec, spk, s, e`` in seconds as SPEAKER lines."""
    df.select(F.format_string("SPEAKER %s 1 %.2f %.2f <NA> <NA> %s <NA> <NA>", "rec", "s", F.col("e") - F.col("s"), "spk").alias("value")).write.mode("overwrite").text(path)
