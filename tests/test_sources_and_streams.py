import json
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.operators import registry as R, sessions as O
from cadenza.plans.intervals import frames
from cadenza.sources import readers, sinks
from cadenza.streaming import live, machines


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rttm(spark, tmp_path):
    p = tmp_path / "a.rttm"
    p.write_text("# note\n\nSPEAKER m1 1 2.50 1.00 <NA> <NA> b <NA> <NA>\nSPEAKER m1 1 0.00 1.00 <NA> <NA> a <NA> <NA>\n")
    assert rows(readers.rttm(spark, str(p))) == [("m1", "a", 0.0, 1.0), ("m1", "b", 2.5, 3.5)]
    p.write_text("SPEAKER m1 1 x 1.00 <NA> <NA> b <NA> <NA>\n")
    assert rows(readers.rttm(spark, str(p), strict=False)) == []
    with pytest.raises(Exception, match="not a speaker line"):
        readers.rttm(spark, str(p)).collect()
    sinks.rttm(spark.createDataFrame([("m", "s", 1.0, 2.25)], "rec string, spk string, s double, e double"), str(tmp_path / "out"))
    assert rows(readers.rttm(spark, str(tmp_path / "out"))) == [("m", "s", 1.0, 2.25)]


def test_text_corpora(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "x.trans.txt").write_text("u2 HELLO THERE\nu1 GOOD DAY\nbroken\n")
    assert rows(readers.transcripts(spark, str(tmp_path))) == [("u1", "GOOD DAY"), ("u2", "HELLO THERE")]
    assert rows(readers.transcripts(spark, str(tmp_path), spark.createDataFrame([("u2",)], "id string"))) == [("u2", "HELLO THERE")]
    kv = tmp_path / "kv"
    kv.write_text("a one two\nb\n\n")
    assert rows(readers.key_values(spark, str(kv))) == [("a", "one two"), ("b", None)]
    kv.write_text("u r 0.5 1.5\nbad\n")
    assert rows(readers.kaldi_segments(spark, str(kv))) == [("u", "r", 0.5, 1.5)]
    kv.write_text("# c\nvoice|Hello\n\nplain\n")
    assert rows(readers.corpus_lines(spark, str(kv), "k")) == [("k", "Hello"), ("k", "plain")]
    for lang in ("de", "fr"):
        (tmp_path / "s" / f"language={lang}").mkdir(parents=True)
        (tmp_path / "s" / f"language={lang}" / "a.tsv").write_text("3\tc\n1\ta\n2\tb\n")
    assert sorted(rows(readers.language_samples(spark, str(tmp_path / "s"), 2))) == [("de", "1", "a"), ("de", "2", "b"), ("fr", "1", "a"), ("fr", "2", "b")]


def test_arpa_and_vocabularies(spark, tmp_path):
    p = tmp_path / "lm.arpa"
    p.write_text("\\data\\\nngram 1=2\n\n\\1-grams:\n-1.0\thas\t-0.2\n-2.1\tpain\nbad line\n\n\\2-grams:\n-0.5\thas pain\n\n\\3-grams:\n-9 a b c\n\n\\end\\\n")
    uni, bi = readers.arpa(spark, str(p))
    ln = readers.LN10
    assert {(w, round(a, 6), round(b, 6)) for w, a, b in rows(uni)} == {("has", round(-ln, 6), round(-0.2 * ln, 6)), ("pain", round(-2.1 * ln, 6), 0.0)}
    assert [(c, w, round(v, 6)) for c, w, v in rows(bi)] == [("has", "pain", round(-0.5 * ln, 6))]
    v = tmp_path / "v.txt"
    v.write_text("# c\nOrelia: oh really, o relia\nplain\n")
    assert sorted(rows(readers.vocabulary(spark, str(v)))) == [("Orelia", ["oh really", "o relia"], None), ("plain", [], None)]
    v.write_text(json.dumps({"terms": [{"text": "A", "aliases": ["b"], "minSimilarity": 0.7}, {"text": "C"}]}))
    assert sorted(rows(readers.vocabulary(spark, str(v)))) == [("A", ["b"], 0.7), ("C", [], None)]
    v.write_text(json.dumps({"0": "▁a", "7": "b"}))
    assert sorted(rows(readers.token_pieces(spark, str(v)))) == [(0, "▁a"), (7, "b")]


def test_xml_and_binary(spark, tmp_path):
    p = tmp_path / "s.xml"
    p.write_text('<r><segment participant="A" transcriber_start="0.5" transcriber_end="1.5"/><segment participant="B" transcriber_start="2" transcriber_end="2"/></r>')
    assert rows(readers.meeting_segments(spark, str(p))) == [("A", 0.5, 1.5)]
    p.write_text('<r><w starttime="0.1" endtime="0.2">hi</w><w starttime="0.2" endtime="0.2" punc="true">.</w></r>')
    assert rows(readers.meeting_words(spark, str(p))) == [("hi", 0.1, 0.2)]
    body = struct.pack("<4h", 16384, 0, -32768, 32767)
    wav = tmp_path / "a.wav"
    wav.write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16) + b"data" + struct.pack("<I", len(body)) + body)
    _, rate, samples = rows(readers.audio(spark, str(wav)))[0]
    assert rate == 16000 and samples == pytest.approx([0.25, 0.0], abs=1e-4)
    piece = b"\x0a\x03\xe2\x96\x81" + b"\x15" + struct.pack("<f", -1.5) + b"\x18\x02"
    m = tmp_path / "m.model"
    m.write_bytes(b"\x0a" + bytes([len(piece)]) + piece + b"\x12\x01x")
    assert rows(readers.sentencepiece(spark, str(m))) == [(0, "▁", -1.5, 2)]


def test_sinks(spark, tmp_path):
    sinks.json_report(spark.createDataFrame([("f", float("nan"), 1)], "file string, wer double, n int"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*"))) == {"file": "f", "n": 1, "wer": None}
    seg = spark.createDataFrame([("u2", "r", "s1", 1.0, 2.0, "r.wav"), ("u1", "r", "s2", 0.0, 1.5, "r.wav")], "utt string, rec string, spk string, s double, e double, wav string")
    sinks.kaldi_split(seg, str(tmp_path / "k"))
    got = {p.name: sorted(x.value for x in spark.read.text(str(p)).collect()) for p in (tmp_path / "k").iterdir()}
    assert got == {"wav.scp": ["r r.wav"], "segments": ["u1 r 0.00 1.50", "u2 r 1.00 2.00"], "utt2spk": ["u1 s2", "u2 s1"], "spk2utt": ["s1 u2", "s2 u1"], "reco2dur": ["r 2.00"], "reco2num_spk": ["r 2"]}


def test_predicates_and_text(spark):
    t = spark.createDataFrame([("▁Hello",), ("▁",), ("Привет1",), ("αβγ",), ("日本",), ("a\tb",), (None,)], "p string")
    got = rows(t.select(*[X.in_script(F.col("p"), n) for n in ("latin", "cyrillic", "greek")]))
    assert got == [(True, False, False), (True, True, True), (False, True, False), (False, False, True), (False, False, False), (False, False, False), (None, None, None)]
    one = spark.createDataFrame([("<b>Crème</b> brûlée (sweet) № 5!", "NASA", "<a x='1' y=\"2\"> <br/>")], "t string, i string, m string")
    basic, plain, is_i, apart = rows(one.select(X.basic_normalize(F.col("t")), X.basic_normalize(F.col("t"), True), X.is_initialism(F.col("i")), X.spelled(F.col("i"))))[0]
    assert (basic, plain, is_i, apart) == ("crème brûlée No 5", "creme brulee No 5", True, "N A S A")
    assert rows(one.select(F.to_json(X.tags(F.col("m")))))[0][0] == '[{"name":"a","attributes":{"x":"1","y":"2"}},{"name":"br","attributes":{}}]'


def test_japanese(spark):
    t = spark.createDataFrame([("二十一と十五、二十。",), ("三百 十 ２０２四年",), ("一〇〇",)], "t string")
    assert [r[0] for r in t.select(X.normalize_japanese(F.col("t"))).collect()] == ["21と1520", "3100102024年", "100"]


def test_merged_histories_keep_the_newest(spark):
    t = spark.createDataFrame([([(3, "c"), (1, "a")], [(2, "b"), (4, "d")]), (None, [(1, "z")])], "a array<struct<at:int,x:string>>, b array<struct<at:int,x:string>>")
    got = [[x["x"] for x in r[0]] for r in t.select(R.newest(3)(F.col("a"), F.col("b"))).collect()]
    assert got == [["d", "c", "b"], ["z"]]


def test_registry_modes(spark):
    schema = "id string, v int, permanent boolean"
    old, new = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 1, None)], schema), spark.createDataFrame([("a", 2, False), ("b", 2, False), ("d", 2, False), (None, 2, False)], schema)
    value = {m: {r["id"]: r["v"] for r in R.initialise(old, new, "id", m).collect()} for m in ("skip", "overwrite", "reset")}
    assert {r["id"]: r["v"] for r in R.initialise(old, new, "id", "merge", merged={"v": lambda a, b: a + b}).collect()} == {"a": 1, "b": 3, "c": 1, "d": 2}
    assert value == {"skip": {"a": 1, "b": 1, "c": 1, "d": 2}, "overwrite": {"a": 1, "b": 2, "c": 1, "d": 2}, "reset": {"a": 1, "b": 2, "d": 2}}
    with pytest.raises(ValueError):
        R.initialise(old, new, "id", "other")


def test_dirty_frames(spark):
    f = spark.createDataFrame([("c", 0, 0.9, "x"), ("c", 0, 0.9, "x"), ("c", 1, None, "x"), ("c", None, 0.9, "x"), (None, 0, 0.9, "x"), ("c", 9, float("nan"), "x")], "clip string, frame int, prob double, on string")
    assert rows(O.vad_segments(f)) == [("c", 0, 0, 5696)]
    assert rows(O.vad_segments(f.limit(0))) == []


@pytest.fixture
def events(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    data = [("k", i, p, t0 + timedelta(seconds=i)) for i, p in enumerate([0.1, 0.9, 0.9, 0.1, 0.1, 0.1, 0.1, 0.1])] + [("l", 0, 0.95, t0)]
    for i in range(0, len(data), 3):
        spark.createDataFrame(data[i : i + 3], "clip string, frame int, prob double, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stream_equals_replay(spark, events, tmp_path):
    schema = "clip string, frame int, prob double, ts timestamp"
    stream = live.files(spark, events, schema, per_batch=10)
    out = live.keyed(stream, "clip", "frame", "kind string, sample long", machines.vad_step, lambda r: r["prob"])
    live.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = [("k", *e) for e in machines.replay(machines.vad_step, [0.1, 0.9, 0.9, 0.1, 0.1, 0.1, 0.1, 0.1])] + [("l", "start", 0)]
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")))) == sorted(want)


def test_windows_and_callbacks(spark, events, tmp_path):
    schema = "clip string, frame int, prob double, ts timestamp"
    seen = []
    live.each_batch(live.files(spark, events, schema), lambda df, n: seen.append(df.count()), str(tmp_path / "cp1"))
    assert sum(seen) == 9
    live.run_to_table(live.sliding(live.files(spark, events, schema, 10), "ts", "4 seconds", "2 seconds", "0 seconds", "clip"), str(tmp_path / "w"), str(tmp_path / "cp2"))
    got = spark.read.parquet(str(tmp_path / "w"))
    assert got.count() > 0 and got.filter("n > 4").count() == 0
    live.run_to_table(live.sessions(live.files(spark, events, schema, 10), "ts", "2 seconds", "0 seconds", "clip"), str(tmp_path / "s"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "s")).count() >= 0


def test_every_sample_of_a_clip_is_new_in_one_window(spark):
    import __spark_entry__ as entry

    directory = "/root/testdata/sf0.001"
    length = {r["clip"]: r["n"] * 4096 for r in frames(spark, directory).groupBy("clip").count().withColumnRenamed("count", "n").collect()}
    spans = {}
    for r in entry.queries()["stream_windows_whole"](spark, directory).collect():
        spans.setdefault(r["clip"], []).append((r["fresh"], r["last"]))
    assert spans.keys() == length.keys()
    for clip, found in spans.items():
        edges = sorted(found)
        assert [a for a, _ in edges] == [0, *(b for _, b in edges[:-1])] and edges[-1][1] == length[clip]


def test_live_windows_equal_the_batch(spark):
    import __spark_entry__ as entry

    directory = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{directory}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = e.groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").count().select(F.date_format("w.start", "yyyy-MM-dd HH:mm"), "event_type", "count")
    assert sorted(rows(entry.queries()["live_windows"](spark, directory))) == sorted(rows(want))
