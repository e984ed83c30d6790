import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import audio as A, sounds as P, vectors as V
from cadenza.operators import clustering as C, intervals as I, matching as X, metrics as M, rescoring as Z, sequences as Q, texts as O, timing as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filters_and_mel():
    x = np.sin(np.arange(4000) / 16_000 * 2 * np.pi * 440)
    assert len(A.resample(x, 16_000, 8_000)) == 2000 and len(A.resample(x[:0], 1, 2)) == 0
    assert np.abs(A.high_pass(np.ones(5000))[-1]) < 1e-3 and A.low_pass(np.ones(10)).tolist() == [1.0] * 10
    m = A.mel_spectrogram(x, bands=40)
    assert m.shape == (26, 40) and m.mean(0).argmax() == pytest.approx(A.mel_spectrogram(x * 2, bands=40).mean(0).argmax())
    assert A.mel_spectrogram(x[:0]).shape == (0, 128) and A.mel_filters(8, 512, 16_000).min() == 0


def test_stress_and_tones():
    assert P.stressed("kˈæt", -2) == "kæt" and P.stressed("kˈæt", -1) == "kˌæt" and P.stressed("kæt", 0) == "kˌæt" and P.stressed("kæt", 2) == "kˈæt" and P.stressed("kˌæt", 1) == "kˈæt" and P.stressed("kt", 2) == "kt" and P.stressed("kæt", None) == "kæt"
    assert P.tones([("bu", 4), ("shi", 4)])[0] == ("bu", 2) and P.tones([("yi", 1), ("ge", 4)])[0] == ("yi", 2) and P.tones([("yi", 1), ("tian", 1)])[0] == ("yi", 4)
    assert [t for _, t in P.tones([("a", 3)] * 3)] == [2, 2, 3] and P.numbered("nǐ") == ("ni", 3) and P.numbered("lǜ") == ("lv", 4) and P.numbered("ma") == ("ma", 5)
    raw = struct.pack("<I", ord("你")) + bytes([1, 3]) + "nǐ".encode()
    assert P.single_readings(raw) == {"你": ["nǐ"]} and P.single_readings(b"") == {}
    phrase = struct.pack("<H", 6) + "你好".encode() + bytes([2, 3]) + "nǐ".encode() + bytes([4]) + "hǎo".encode()
    assert P.phrase_readings(phrase) == {"你好": ["nǐ", "hǎo"]}
    assert P.read_aloud("你好x你", {"你好": ["nǐ", "hǎo"]}, {"你": ["nǐ"]}) == [("ni", 2), ("hao", 3), ("ni", 3)]
    for bad in (raw[:-1], phrase[:-1]):
        with pytest.raises(ValueError):
            (P.single_readings if bad is raw[:-1] or bad == raw[:-1] else P.phrase_readings)(bad)


def test_interval_goldens(spark):
    d = spark.createDataFrame([("r", 0, 10)], "rec string, s long, e long")
    holes = spark.createDataFrame([("r", 2, 3), ("r", 5, 7), ("r", -5, -1), ("q", 1, 2), ("r", None, 4)], "rec string, s long, e long")
    assert rows(I.subtract(d, holes, ["rec"])) == [("r", 0, 2), ("r", 3, 5), ("r", 7, 10)]
    assert rows(I.merged(spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("r", 3, 4)], "rec string, s long, e long"), ["rec"])) == [("r", 0, 2), ("r", 3, 4)]
    both = spark.createDataFrame([("r", "a", 0, 10), ("r", "b", 5, 15), ("r", "a", 20, 30)], "rec string, spk string, s long, e long")
    assert rows(I.single_speaker(both)) == [("r", "a", 0, 5), ("r", "a", 20, 30), ("r", "b", 10, 15)]
    assert rows(I.without_overlap(both, 6)) == [("r", "a", 0, 10, 1.0), ("r", "a", 20, 30, 1.0)]
    for op in (I.single_speaker, I.overlapped, lambda x: I.without_overlap(x, 1), lambda x: I.bridge_same_speaker(x, 1)):
        assert op(both.limit(0)).count() == 0


def test_order_statistics(spark):
    t = spark.createDataFrame([("g", v) for v in (4.0, 1.0, 3.0, 2.0)] + [("g", None), ("h", 7.0)], "g string, v double")
    assert rows(M.at_ranks(t, ["g"], "v", {"median": M.upper_median, "p50": M.nearest_rank(0.5)})) == [("g", 3.0, 3.0), ("h", 7.0, 7.0)]
    one = M.stats_block(t, ["g"], "v").filter("g = 'h'").collect()[0]
    assert one["stdev"] == 0.0 and one["p90"] == 7.0
    c = M.classification(t, ["g"], F.col("v") > 2, F.col("v") > 100).filter("g = 'g'").collect()[0]
    assert (c["tp"], c["fn"], c["tn"], c["precision"], c["recall"], c["f1"]) == (0, 2, 3, 0.0, 0.0, 0.0)


def test_frame_errors(spark):
    ref = spark.createDataFrame([("r", "A", 0, 100), ("r", "B", 100, 200)], "rec string, spk string, s long, e long")
    hyp = spark.createDataFrame([("r", "x", 0, 120), ("r", "y", 120, 220)], "rec string, hyp string, s long, e long")
    m = X.best_mapping(M.co_occurrence(ref, hyp, 10), "rec", "spk", "hyp", "frames")
    assert rows(m) == [("r", "A", "x"), ("r", "B", "y")]
    e = M.frame_errors(ref, hyp, m, 10).collect()[0]
    assert (e["total"], e["missed"], e["false_alarm"], e["confusion"], e["error"]) == (20, 0, 2, 2, 0.2)


def test_similarity_joins(spark):
    w = spark.createDataFrame([("cat",), ("cart",), ("dog",), (None,), ("a",), ("",)], "word string")
    t = spark.createDataFrame([("cat",), ("bat",), ("b",), (None,)], "term string")
    import itertools

    def lev(a, b):
        return Q.distance(list(a), list(b))

    for k in (0, 1, 2, 3):
        want = sorted((a, b, lev(a, b)) for a, b in itertools.product(["cat", "cart", "dog", "a", ""], ["cat", "bat", "b"]) if lev(a, b) <= k)
        assert rows(X.edit_join(w, t, k)) == want
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [])], "id long, v array<double>")
    assert rows(X.cosine_pairs(v, v, k=1).select("q", "id")) == [(1, 2), (2, 1), (3, 1)]
    assert rows(X.cosine_pairs(v, v, within=0.1, block=1).select("q", "id")) == [(1, 2), (2, 1)]
    assert X.cosine_pairs(v.limit(0), v, k=1).count() == 0
    flags = spark.createDataFrame([(1, True), (2, False), (3, False)], "id long, permanent boolean")
    pairs = X.cosine_pairs(v, v, within=0.1)
    assert rows(X.mergeable(pairs, flags).select("source", "target")) == [(2, 1)]


def test_words_in_window(spark):
    w = spark.createDataFrame([("r", 1, 0, 10), ("r", 2, 10, 20), ("r", 3, 50, 60)], "rec string, n int, s long, e long")
    win = spark.createDataFrame([("r", 1, 10, 12), ("r", 2, 25, 30), ("r", 3, 40, 45), ("q", 4, 0, 5)], "rec string, win int, s long, e long")
    assert rows(X.words_in_window(w, win, "rec")) == [("r", 1, 1, 2), ("r", 2, 2, 2), ("r", 3, 3, 3)]


def test_vectors(spark):
    t = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    got = [tuple(r) for r in t.select(V.cosine_distance(F.col("a"), F.col("b")), V.plda_score(F.col("a"), F.col("b")), V.is_embedding(F.col("a"))).collect()]
    assert got[0] == (pytest.approx(0.04), pytest.approx(0.96), True) and got[1] == (float("inf"), 0.0, False) and got[2][0] == float("inf") and got[3] == (float("inf"), 0.0, False)
    one = spark.range(1)
    assert one.select(V.log_add(F.lit(float("-inf")), F.lit(float("-inf")))).collect()[0][0] == float("-inf")
    assert one.select(V.resample(F.array(F.lit(0.0), F.lit(1.0)), F.lit(4))).collect()[0][0] == pytest.approx([0, 0.25, 0.75, 1])


def test_replacements_and_rules(spark):
    w = spark.createDataFrame([("i", 0, "my"), ("i", 1, "o"), ("i", 2, "relia"), ("i", 3, "card")], "item string, at int, word string")
    t = spark.createDataFrame([("orelia",), ("card",)], "term string")
    got = rows(Z.vocabulary_replacements(w, t, "item", "at"))
    assert [r[:5] for r in got] == [("i", 1, 2, "o relia", "orelia")]
    text = spark.createDataFrame([("A fat tire and $5",)], "t string")
    assert rows(Z.custom_rules(text, "t", [("fat tire", "FT$1"), ("and", "&")])) == [("A FT$1 & $5",)]
    bad = spark.createDataFrame([(1, [float("nan")]), (2, None)], "id int, v array<double>")
    assert Z.finite_or_all(bad, "v").count() == 2 and Z.finite_or_all(bad.unionByName(spark.createDataFrame([(3, [1.0])], bad.schema)), "v").count() == 1


def test_groups_and_folds(spark):
    v = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.9, 0.1]), ("g", 3, [0.0, 1.0]), ("g", 4, None), ("h", 5, [1.0, 1.0])], "g string, id int, v array<double>")
    assert rows(C.clustered(v, "g", "id", "v", lambda x: C.agglomerate(x, 0.8))) == [("g", 1, 0), ("g", 2, 0), ("g", 3, 1), ("h", 5, 0)]
    assert C.clustered(v.limit(0), "g", "id", "v", lambda x: C.agglomerate(x, 0.8)).count() == 0
    assert rows(C.assigned(v.withColumn("d", F.lit(2.0)), "g", "id", "id", "v", "d")) == [("g", 1, 0), ("g", 2, 0), ("g", 3, 1), ("h", 5, 0)]
    f = spark.createDataFrame([("c", i, 0.4) for i in range(5)], "c string, t int, a double")
    assert [(n, at) for _, n, at, _ in rows(C.integrate_and_fire(f, "c", "t", "a"))] == [(0, 2), (1, 4)]


def test_language_model(spark):
    uni = spark.createDataFrame([("has", -1.0, -0.2), ("pain", -2.1, 0.0)], "word string, lp double, bo double")
    bi = spark.createDataFrame([("pain", "has", -0.5)], "context string, word string, lp double")
    w = spark.createDataFrame([("t", 0, "has"), ("t", 1, "pain"), ("t", 2, "has"), ("t", 3, "new")], "k string, i int, word string")
    got = {r["i"]: round(r["score"], 6) for r in O.bigram_scores(w, uni, bi, ["k"], "i").collect()}
    assert got == {0: -1.0, 1: -2.3, 2: -0.5, 3: round(-0.2 - 23.026, 6)}


def test_seam_words_and_plans(spark):
    p = spark.createDataFrame([("c", 1, "▁Meet", 0), ("c", 2, "ing", 2), ("c", 3, "▁meet", 4), ("c", 4, "ing", 6), ("c", 5, "▁end.", 8), ("c", 6, "▁End.", 9)], "clip string, n int, piece string, ts int")
    assert [r[1] for r in rows(T.drop_seam_words(p, 25))] == [3, 4, 5, 6]
    clips = spark.createDataFrame([("c", 500_000), ("d", 1000)], "clip string, total long")
    quiet = spark.createDataFrame([("c", f, 0.001 if f == 150 else 1.0) for f in range(390)], "clip string, frame int, value double")
    assert rows(T.silence_aligned_starts(clips, quiet, 208_000, 240_000)) == [("c", 0, 0), ("c", 1, 192_000), ("c", 2, 416_000 // 1280 * 1280), ("d", 0, 0)]


def test_histogram_counts_every_row(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(0, None), (0, 0), (0, 1), (0, 4), (0, 9), (None, -1), (1, 0)]
    spark.createDataFrame(rows, "chunk int, dur int").write.parquet(str(tmp_path / "token_windows.parquet"))
    got = {r["chunk"]: r.asDict() for r in entry.queries()["assignment_histogram_whole"](spark, str(tmp_path)).collect()}
    assert {c: r["n"] for c, r in got.items()} == {0: 5, 1: 1, None: 1}
    assert all(r["n"] == sum(v for k, v in r.items() if k not in ("chunk", "n")) for r in got.values())
    assert (got[0]["missing"], got[0]["d0"], got[0]["other"], got[None]["other"]) == (1, 1, 1, 1)
