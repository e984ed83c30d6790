"""Readers of text formats around speech corpora; each gives a DataFrame with a fixed schema."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

LN10 = 2.302585092994046


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, no, line``: numbered within each file; a file is read whole, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))


def _real(df: DataFrame, comment: bool = True) -> DataFrame:
    t = F.trim("line")
    return df.filter((t != "") & (~t.startswith("#") if comment else F.lit(True)))


def rttm(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``rec, spk, s, e`` seconds in order of start; blank lines and comments are skipped; others must be SPEAKER lines of eight fields or more, or reading fails (``strict``) or skips them."""
    x = _real(spark.read.text(path, recursiveFileLookup=True).withColumnRenamed("value", "line"))
    f = F.split(F.trim("line"), r"\s+")
    good = (F.size(f) >= 8) & (F.get(f, 0) == "SPEAKER") & F.expr("try_cast(get(f, 3) AS double) IS NOT NULL AND try_cast(get(f, 4) AS double) IS NOT NULL")
    x = x.withColumn("f", f)
    if strict:
        x = x.withColumn("f", F.when(good, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not a speaker line: "), F.col("line")))))
    else:
        x = x.filter(good)
    start = F.get("f", 3).cast("double")
    return x.select(F.get("f", 1).alias("rec"), F.get("f", 7).alias("spk"), start.alias("s"), (start + F.get("f", 4).cast("double")).alias("e")).orderBy("rec", "s", "e", "spk")


def parse_rttm(text: Column) -> Column:
    """RTTM inside a text column as an array of ``(rec, spk, s, e)``; lines of other kinds are left out."""
    rows = F.transform(F.filter(F.split(text, r"\r?\n"), lambda l: l.rlike(r"^\s*SPEAKER(\s+\S+){7,}")), lambda l: F.split(F.trim(l), r"\s+"))
    return F.transform(rows, lambda f: F.struct(f[1].alias("rec"), f[7].alias("spk"), f[3].try_cast("double").alias("s"), (f[3].try_cast("double") + f[4].try_cast("double")).alias("e")))


def transcripts(spark: SparkSession, path: str, audio: DataFrame | None = None) -> DataFrame:
    """``id, text`` from ``*.trans.txt`` files below a folder, in order of id; only those with audio (``id``) if it is given."""
    x = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.trans*.txt").filter("value LIKE '% %'")
    x = x.select(F.substring_index("value", " ", 1).alias("id"), F.expr("substr(value, instr(value, ' ') + 1)").alias("text"))
    return (x.join(audio.select("id"), "id", "left_semi") if audio is not None else x).orderBy("id")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """First word and rest of each line."""
    x = spark.read.text(path).filter("trim(value) <> ''")
    return x.select(F.split(F.trim("value"), r"\s+", 2)[0].alias("key"), F.get(F.split(F.trim("value"), r"\s+", 2), F.lit(1)).alias("value"))


def kaldi_segments(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(f) >= 4).select(f[0].alias("utt"), f[1].alias("rec"), f[2].cast("double").alias("s"), f[3].cast("double").alias("e"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of an XML corpus file; attributes are ``_name`` in the schema."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def meeting_segments(spark: SparkSession, path: str) -> DataFrame:
    """``spk, s, e`` of ``<segment participant= transcriber_start= transcriber_end=>``; without times or empty ones left out."""
    x = xml_rows(spark, path, "segment", "_participant string, _channel string, _transcriber_start double, _transcriber_end double")
    return x.select(F.coalesce("_participant", "_channel").alias("spk"), F.col("_transcriber_start").alias("s"), F.col("_transcriber_end").alias("e")).filter("e > s")


def meeting_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, s, e`` of ``<w starttime= endtime=>``; punctuation marks are left out."""
    x = xml_rows(spark, path, "w", "_VALUE string, _starttime double, _endtime double, _punc string")
    return x.filter("coalesce(_punc, 'false') <> 'true' AND _starttime IS NOT NULL").select(F.trim("_VALUE").alias("word"), F.col("_starttime").alias("s"), F.col("_endtime").alias("e"))


def arpa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Unigrams ``word, lp, bo`` and bigrams ``context, word, lp`` in natural logs; malformed lines and longer orders are skipped."""
    x = lines(spark, path)
    head = F.when(F.col("line").rlike(r"^\\"), F.regexp_extract("line", r"^\\(\S+?):?\s*$", 1))
    x = x.withColumn("part", F.last(head, ignorenulls=True).over(W.partitionBy("file").orderBy("no").rowsBetween(W.unboundedPreceding, 0)))
    f = F.split(F.trim("line"), r"\s+")
    x = x.withColumn("f", f).withColumn("lp", F.expr("try_cast(get(f, 0) AS double)") * LN10).filter("lp IS NOT NULL")
    uni = x.filter("part = '1-grams' AND size(f) >= 2").select(F.get("f", 1).alias("word"), "lp", F.coalesce(F.expr("try_cast(get(f, 2) AS double)") * LN10, F.lit(0.0)).alias("bo"))
    bi = x.filter("part = '2-grams' AND size(f) >= 3").select(F.get("f", 1).alias("context"), F.get("f", 2).alias("word"), "lp")
    return uni, bi


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``text, aliases, min_similarity`` from JSON (``{"terms": [...]}``) or simple lines ``term: alias, alias``; the format is recognised by the first character."""
    whole = spark.read.text(path, wholetext=True)
    is_json = F.trim("value").rlike(r"\A[\[{]")
    terms = F.from_json(F.when(F.trim("value").startswith("["), F.concat(F.lit('{"terms":'), F.col("value"), F.lit("}"))).otherwise(F.col("value")), "terms array<struct<text:string,aliases:array<string>,minSimilarity:double>>")
    a = whole.filter(is_json).select(F.explode(terms["terms"]).alias("t")).select("t.text", F.coalesce("t.aliases", F.array().cast("array<string>")).alias("aliases"), F.col("t.minSimilarity").alias("min_similarity"))
    b = _real(whole.filter(~is_json).select(F.explode(F.split("value", r"\r?\n")).alias("line")))
    parts = F.split("line", ":", 2)
    aliases = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    b = b.select(F.trim(parts[0]).alias("text"), aliases.alias("aliases"), F.lit(None).cast("double").alias("min_similarity"))
    return a.unionByName(b).filter("text <> ''")


def token_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``token, piece`` from a JSON object of ids to pieces."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("token", "piece"))
    return x.select(F.col("token").cast("int").alias("token"), "piece")


def corpus_lines(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Prompts of a corpus file: comments and blank lines skipped, what follows a ``|`` kept."""
    x = _real(spark.read.text(path).withColumnRenamed("value", "line"))
    return x.select(F.lit(category).alias("category"), F.trim(F.regexp_extract("line", r"^(?:[^|]*\|)?(.*)$", 1)).alias("text")).filter("text <> ''")


def language_samples(spark: SparkSession, path: str, most: int) -> DataFrame:
    """``language, id, text``: the first ``most`` of each ``language=xx`` folder of tab-separated files (the feature of a sample loader)."""
    x = spark.read.option("sep", "\t").schema("id string, text string").option("basePath", path).csv(f"{path}/language=*")
    rank = F.row_number().over(W.partitionBy("language").orderBy("id", "text"))
    return x.withColumn("_r", rank).filter(F.col("_r") <= most).select("language", "id", "text")


def _blobs(spark: SparkSession, path: str, schema: str, fn) -> DataFrame:
    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield from fn(raw)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(
        lambda bs: (fn(p, c) for b in bs for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), schema)


def samples(path: str, raw: bytes) -> pa.RecordBatch:
    """Mono float samples of a RIFF file: 16-bit or float, channels averaged."""
    at, rate, channels, bits, kind, data = 12, 0, 1, 16, 1, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    import numpy as np

    x = np.frombuffer(data, "<f4").astype(np.float32) if kind == 3 and bits == 32 else np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    return pa.RecordBatch.from_pydict({"path": [path], "rate": pa.array([rate], pa.int32()), "samples": pa.array([x.tolist()], pa.list_(pa.float32()))})


def audio(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, samples`` of WAV files; other containers need a decoder that isn't here."""
    return _blobs(spark, path, "path string, rate int, samples array<float>", samples)


def _fields(raw: bytes):
    """(field, wire type, value) of a protobuf message."""
    def number(i):
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if not raw[i - 1] & 128:
                return n, i

    i = 0
    while i < len(raw):
        tag, i = number(i)
        wire = tag & 7
        if wire == 0:
            value, i = number(i)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, i = number(i)
            value, i = raw[i : i + size], i + size
        yield tag >> 3, wire, value


def _pieces(path: str, raw: bytes) -> pa.RecordBatch:
    out = {"id": [], "piece": [], "score": [], "type": []}
    for field, wire, value in _fields(raw):
        if field == 1 and wire == 2:
            piece, score, kind = "", 0.0, 1
            for f, w, v in _fields(value):
                if f == 1 and w == 2:
                    piece = v.decode("utf-8", "replace")
                elif f == 2 and w == 5:
                    score = struct.unpack("<f", v)[0]
                elif f == 3 and w == 0:
                    kind = v
            for k, v in zip(out, (len(out["id"]), piece, score, kind)):
                out[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int32()), pa.array(out["piece"], pa.string()), pa.array(out["score"], pa.float32()), pa.array(out["type"], pa.int32())], names=list(out))


def sentencepiece(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece, score, type`` of a SentencePiece model file."""
    return _blobs(spark, path, "id int, piece string, score float, type int", _pieces)
