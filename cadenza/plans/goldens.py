"""Queries over small fixed inputs whose results are known: for operators that SQL can't express, and for readers and writers of files.

Each case is written down with its result; the SQL is the table of results.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.functions import sounds as P, spoken as K, text as X
from cadenza.operators import clustering as C, intervals as I, matching as J, metrics as M, rescoring as Z, sequences as Q, sessions as S, texts as O, timing as T
from cadenza.session import shared_dir
from cadenza.sources import readers, sinks
from cadenza.streaming import machines as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def known(name: str, columns: str, rows: list[tuple], query: Callable[[SparkSession], DataFrame]) -> None:
    """Registers a query and the rows it gives; ``columns`` are names with types, as in a schema."""
    parts = [c.split() for c in columns.split(",")]
    names = ", ".join(f'"{n}"' for n, _ in parts)
    casts = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    QUERIES[f"known_{name}"] = lambda s, _d: query(s).select(*[F.col(n).cast(t).alias(n) for n, t in parts])
    ORACLE[f"known_{name}"] = f"SELECT {', '.join(f'CAST("{n}" AS {casts[t]}) AS "{n}"' for n, t in parts)} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


def by_text(name: str, fn: Callable[[str], object], cases: list[tuple[str, str]]) -> None:
    """A function of texts; lists are joined by `` | ``."""
    def run(t):
        got = fn(t)
        return " | ".join(map(str, got)) if isinstance(got, list) else got

    known(name, "no int, result string", [(i, want) for i, (_, want) in enumerate(cases)],
          lambda s: s.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "no int, text string").select("no", O.apply_text(F.col("text"), run).alias("result")))


def by_column(name: str, fn: Callable[..., F.Column], cases: list[tuple], kind: str = "string") -> None:
    """An expression over texts: the last of a case is its result."""
    width = len(cases[0]) - 1
    cols = [f"t{i}" for i in range(width)]
    known(name, f"no int, result {kind}", [(i, c[-1]) for i, c in enumerate(cases)],
          lambda s: s.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], "no int, " + ", ".join(f"{c} string" for c in cols)).select("no", fn(*map(F.col, cols)).alias("result")))


def by_case(name: str, fn: Callable[[object], object], cases: list[tuple[object, str]]) -> None:
    """A function of any values, which are carried as JSON."""
    by_text(name, lambda t: fn(json.loads(t)), [(json.dumps(x), want) for x, want in cases])


def put(spark: SparkSession, files: dict[str, bytes | str]) -> str:
    """Files in a new folder of the shared directory; its path."""
    folder = f"{shared_dir(spark)}/cadenza-{uuid.uuid4().hex}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, body in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(body.encode() if isinstance(body, str) else body))
        out.close()
    return folder


# numbers and texts

by_text("english_normalize", K.normalize_english, [
    ("Mr. Smith can't pay $20", "mister smith can not pay dollar 20"), ("uh th- that's [noise] twenty one (laughs)", "that is 21"), ("It's 5pm", "it is 5 pm"), ("the second time", "the 2nd time"),
    ("café & bœuf", "café and boeuf"), ("1,000 people", "1 000 people"), ("I won't, I'll see", "i will not i will see"), ("they're gonna go", "they are going to go"), ("two hundred and five", "200 and 5"),
    ("one and a half", "1 point 5"), ("50% off", "50 percent off"), ("<unk> mm hmm yes", "yes")])
by_text("number_words", K.convert_numbers, [
    ("twenty one", "21"), ("one hundred five", "105"), ("two twenty nine", "2 29"), ("a thousand ships", "a 1000 ships"), ("two million three hundred thousand", "200000300000"), ("nineteen ninety nine", "19 99"), ("no numbers", "no numbers")])
by_text("spoken_numbers", K.speak_numbers, [
    ("at 3:05 PM", "at three oh five p m"), ("$5.25", "five dollars and twenty five cents"), ("£1", "one pound"), ("€0.50", "fifty cents"), ("3.14", "three point one four"), ("the 13th", "the thirteenth"),
    ("the 13st", "the 13st"), ("in 1905", "in nineteen oh five"), ("in 2005", "in two thousand five"), ("in 1900", "in nineteen hundred"), ("1,234 men", "one thousand two hundred thirty four men"),
    ("007", "zero zero seven"), ("v1.2.3", "v1.2.3"), ("26.", "twenty six."), ("$1,000", "one thousand dollars"), ("12:00 a.m. sharp", "twelve o'clock a m sharp"), ("£2.50", "two pounds and fifty pence")])
by_case("say_as", lambda c: K.say_as(*c), [
    (["12/25/2007", "date", "mdy"], "December twenty fifth two thousand seven"), (["25/12/1905", "date", "dmy"], "December twenty fifth nineteen oh five"), (["13/45", "date", "md"], "13/45"),
    (["1'21\"", "time", None], "one minute twenty one seconds"), (["3:00", "time", None], "three o'clock"), (["3/4", "fraction", None], "three quarters"), (["1/2", "fraction", None], "one half"),
    (["ab1", "characters", None], "a b one"), (["12", "ordinal", None], "twelfth"), (["x", "unheard", None], "x"), (["2025551212", "telephone", None], "two zero two five five five one two one two")])
by_text("speech_markup", lambda t: K.speak_markup(t)[0], [('Say <sub alias="World Wide Web">WWW</sub> and <phoneme alphabet="ipa" ph="x">tomato</phoneme> <sub>x</sub> <b>y</b>', "Say World Wide Web and tomato x <b>y</b>")])
by_text("speech_preprocess", K.clean_for_speech, [("Hi — “you”, e.g., a@b 😀", '<en>Hi - "you", for example, a at b.</en>'), ("Done !", "<en>Done!</en>"), (" ", " ")])
by_text("sentences", K.sentences, [("Dr. Smith came. He left! Why? ", "Dr. Smith came. | He left! | Why?")])
by_text("text_chunks", lambda t: K.chunks(t, 20), [("One two three. Four five six seven.", "One two three. | Four five six seven."), ("Short.", "Short.")])
by_text("phoneme_chunks", lambda t: K.bounded_chunks(t, 4), [("abcdefghij", "abcd | efgh | ij")])
by_case("segment_packing", lambda c: K.packed(c, 7), [([3, 3, 3, 20, 1], "0 | 0 | 1 | 2 | 3"), ([7, 7], "0 | 1"), ([1, 1, 1], "0 | 0 | 0")])
by_text("han_numbers", K.han_numbers, [("还剩162秒3.5", "还剩一百六十二秒三点五"), ("0", "零"), ("10", "十"), ("15", "十五"), ("101", "一百零一"), ("10005", "一万零五"), ("20300", "二万零三百")])
by_case("word_pieces", lambda c: K.bpe(c, {("a", "b"): 0, ("▁", "ab"): 1, ("▁ab", "c"): 2}), [("ab abc", "▁ab | ▁abc")])
by_case("unigram_pieces", lambda c: K.best_pieces(c, {"▁a": -1.0, "bc": -1.0, "▁ab": -1.5, "c": -1.0}), [("abc", "▁a | bc")])
by_case("longest_matches", lambda c: [m for m, _ in K.longest_matches(c, {"ab": "1", "abc": "2"})], [("abcd", "abc | d"), ("xab", "x | ab")])
by_case("markov_words", lambda c: K.segment(c, {"B": -0.5, "S": -1.0}, {"B": {"E": -0.1, "M": -2}, "M": {"E": -1, "M": -1}, "E": {"B": -0.7, "S": -0.7}, "S": {"B": -0.7, "S": -0.7}},
                                            {"B": {"a": -0.1, "c": -3}, "E": {"b": -0.1}, "S": {"c": -0.1, "a": -3, "b": -3}, "M": {}}), [("abc", "ab | c")])
by_column("basic_normalize", X.basic_normalize, [("<b>Crème</b> brûlée (sweet) № 5!", "crème brûlée No 5"), ("  A  B ", "a b")])
by_column("strip_diacritics", lambda c: X.basic_normalize(c, True), [("<b>Crème</b> brûlée (sweet) № 5!", "creme brulee No 5"), ("Übergröße", "ubergrosse")])
by_column("term_warnings", lambda c: F.array_join(X.term_warnings(c), ","), [("plain", ""), ("a\tb", "control"), ("café", "diacritics"), ("mp3", "digits"), ("a@b", "unusual")])
by_column("cjk_rate", lambda h, r: F.round(X.cjk_rate(h, r), 6), [("今天天气", "今天天气", 0.0), ("今天 天", "今天天气", 0.25), ("x", "", 0.0), ("日本", "日本語", 0.333333)], "double")
by_column("japanese_numbers", X.normalize_japanese, [("二十一と十五、二十。", "21と1520"), ("三百 十 ２０２四年", "3100102024年"), ("一〇〇", "100")])

# sequences

by_case("common_subsequence", lambda c: [f"{i}-{j}" for i, j in Q.common_subsequence(*c)], [([[1, 2, 3, 4], [2, 9, 4]], "1-0 | 3-2"), ([[1], [2]], "")])
by_case("bounded_overlap", lambda c: list(Q.bounded_overlap(*c) or ()), [([[1, 2, 3], [9, 2, 3]], "1 | 1 | 2"), ([[1], [1]], "")])
by_case("without_repeat", lambda c: Q.without_repeat(*c), [([[1, 2, 3, 4], [3, 4, 5]], "5"), ([[1, 2, 3, 4, 7], [8, 3, 4, 5]], "5"), ([[], [1, 2]], "1 | 2")])
by_case("stitch", lambda c: Q.stitch(*c), [([[1, 2, 3, 4, 5, 6], [3, 4, 5, 6, 7]], "1 | 2 | 3 | 4 | 5 | 6 | 7"), ([[1, 2], [2, 3]], "1 | 2 | 2 | 3")])
by_case("inline_diff", lambda c: [" ".join(x) for x in Q.diff(*(x.split() for x in c))], [(["a b c", "a x c"], "a [b] c | a [x] c")])
by_case("chunk_merge", lambda c: [t[0] for t in Q.merge_chunks(*([tuple(t) for t in side] for side in c))], [
    ([[[i, 10 * i] for i in range(10)], [[i, 10 * i + 1] for i in range(7, 15)]], " | ".join(map(str, range(15)))), ([[[1, 0], [2, 50], [3, 100]], [[7, 60], [8, 90], [9, 140]]], "1 | 2 | 8 | 9"),
    ([[[1, 0]], [[9, 500]]], "1 | 9"), ([[], [[4, 1]]], "4")])
known("seam_word_collapse", "n int", [(3,), (4,), (5,), (6,)], lambda s: T.drop_seam_words(s.createDataFrame(
    [("c", 1, "▁Meet", 0), ("c", 2, "ing", 2), ("c", 3, "▁meet", 4), ("c", 4, "ing", 6), ("c", 5, "▁end.", 8), ("c", 6, "▁End.", 9)], "clip string, n int, piece string, ts int"), 25))
known("word_errors", "id int, equal int, replaced int, ref_only int, hyp_only int, wer double, cer double", [(1, 4, 1, 0, 0, 0.2, 0.066667), (2, 0, 0, 2, 0, 1.0, 1.0), (3, 0, 0, 0, 1, 0.0, 0.0), (4, 2, 0, 0, 1, 0.5, 0.25)],
      lambda s: Q.error_counts(s.createDataFrame([(1, "the cat sat on mats", "the cat sat on matt"), (2, "", "a b"), (3, "x", ""), (4, "aa x cc", "aa cc")], "id int, h string, r string"), "id", "h", "r")
      .withColumns({"wer": F.round("wer", 6), "cer": F.round("cer", 6)}))

# segments and scores

by_case("speech_ranges", lambda c: [f"{round(a / S.RATE, 2)}-{round(b / S.RATE, 2)}" for a, b in S.speech_ranges([p for on, n in c[0] for p in [0.95 if on else 0.05] * n], sum(n for _, n in c[0]) * S.FRAME, S.VadConfig(**c[1]))], [
    ([[[0, 12]], {}], ""), ([[[1, 12]], {}], "0.0-3.07"), ([[[1, 8], [0, 2], [1, 8]], {}], "0.0-4.61"), ([[[1, 8], [0, 8], [1, 8]], {}], "0.0-2.15 | 4.0-6.14"), ([[[0, 4], [1, 1], [0, 8]], {"min_speech": 1.0}], "")])
known("aligned_starts", "clip string, chunk int, start long", [("c", 0, 0), ("c", 1, 192_000), ("c", 2, 416_000), ("d", 0, 0)], lambda s: T.silence_aligned_starts(
    s.createDataFrame([("c", 500_000), ("d", 1000)], "clip string, total long"), s.createDataFrame([("c", f, 0.001 if f == 150 else 1.0) for f in range(390)], "clip string, frame int, value double"), 208_000, 240_000))
known("aligned_starts_warm", "clip string, chunk int, start long, prefix boolean", [("c", 0, 0, False), ("c", 1, 192_000, True)], lambda s: T.silence_aligned_starts(
    s.createDataFrame([("c", 400_000)], "clip string, total long"),
    s.createDataFrame([("c", f, 0.0 if f == 150 else 0.5 if f == 162 else 1.0, f != 150) for f in range(320)], "clip string, frame int, value double, settled boolean"), 208_000, 240_000, warm_up=True))


def scored(s):
    ref = s.createDataFrame([("r", "A", 0, 100), ("r", "B", 100, 200)], "rec string, spk string, s long, e long")
    hyp = s.createDataFrame([("r", "x", 0, 120), ("r", "y", 120, 220)], "rec string, hyp string, s long, e long")
    return ref, hyp, J.best_mapping(M.co_occurrence(ref, hyp, 10), "rec", "spk", "hyp", "frames")


known("best_mapping", "rec string, spk string, hyp string", [("r", "A", "x"), ("r", "B", "y")], lambda s: scored(s)[2])
known("frame_errors", "rec string, total long, missed long, false_alarm long, confusion long, error double", [("r", 20, 0, 2, 2, 0.2)], lambda s: (lambda r, h, m: M.frame_errors(r, h, m, 10))(*scored(s)))
known("best_assignment", "no int, result string", [(0, "1 | 0"), (1, "0 | 1 | 2"), (2, "-1 | 0")], lambda s: s.createDataFrame(
    [(i, json.dumps(w)) for i, w in enumerate([[[1.0, 5.0], [5.0, 1.0]], [[3.0, 2.0, 0.0], [0.0, 3.0, 2.0], [2.0, 0.0, 3.0]], [[1.0], [2.0]]])], "no int, w string").select(
    "no", O.apply_text(F.col("w"), lambda t: " | ".join(map(str, J.assign(json.loads(t))))).alias("result")))
known("replacements", "item string, at int, n int, phrase string, term string", [("i", 1, 2, "o relia", "orelia")], lambda s: Z.vocabulary_replacements(
    s.createDataFrame([("i", 0, "my"), ("i", 1, "o"), ("i", 2, "relia"), ("i", 3, "card")], "item string, at int, word string"), s.createDataFrame([("orelia",), ("card",)], "term string"), "item", "at"))
known("exclude_overlaps", "rec string, spk string, s long, e long", [("r", "a", 0, 10), ("r", "b", 10, 14), ("r", "a", 20, 30)], lambda s: I.without_overlap(
    s.createDataFrame([("r", "a", 0, 10), ("r", "b", 5, 14), ("r", "c", 13, 15), ("r", "a", 20, 30), ("r", "b", 22, 29)], "rec string, spk string, s long, e long"), 2))

# clustering and decoding


def blobs(s):
    x = [[1.0, 0.02, 0.0], [1.0, 0.0, 0.03], [0.0, 1.0, 0.02], [0.03, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return s.createDataFrame([("g", i, v) for i, v in enumerate(x)] + [("g", 9, None)], "g string, id int, v array<double>")


for _name, _how in (("linkage", lambda x: C.agglomerate(x, 0.8)), ("kmeans", lambda x: C.kmeans(x, 3)[0]), ("variational", lambda x: C.variational(C.unit_rows(x) * 4, np.ones(x.shape[1]), [0, 0, 1, 1, 2], fa=1.0, fb=1.0)[0].argmax(1).tolist())):
    known(f"{_name}_groups", "g string, id int, label int", [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 1), ("g", 4, 2)],
          lambda s, how=_how: (lambda df: df.select("g", "id", F.col(df.columns[-1]).alias("label")))(C.clustered(blobs(s), "g", "id", "v", how)))
known("bounded_groups", "no int, result string", [(0, "0 | 0 | 1 | 1 | 2"), (1, "0 | 0 | 1 | 1 | 2"), (2, "0 | 0 | 0 | 0 | 0")], lambda s: s.createDataFrame([(0, 1, 5), (1, 3, 5), (2, 1, 1)], "no int, low int, high int").select(
    "no", O.apply_text(F.concat_ws(",", "low", "high"), lambda t: " | ".join(map(str, C.within_bounds(
        np.array([[1.0, 0.02, 0.0], [1.0, 0.0, 0.03], [0.0, 1.0, 0.02], [0.03, 1.0, 0.0], [0.0, 0.0, 1.0]]), [0, 0, 1, 1, 2] if t == "1,5" else [0] * 5 if t == "3,5" else [0, 0, 1, 1, 2], *map(int, t.split(",")))))).alias("result")))
known("assigned_voices", "g string, id int, label int", [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 1), ("g", 4, 2)],
      lambda s: (lambda df: df.select("g", "id", F.col(df.columns[-1]).alias("label")))(C.assigned(blobs(s).filter("v IS NOT NULL").withColumn("d", F.lit(2.0)), "g", "id", "id", "v", "d")))
_SURE = [[0.05, 0.9, 0.05], [0.05, 0.9, 0.05], [0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]


def _logs(rows):
    return [[math.log(x) for x in r] for r in rows]


by_case("greedy_decode", lambda c: C.greedy(_logs(c), 0), [(_SURE, "1 | 1 | 2")])
by_case("beam_decode", lambda c: C.beam_search(_logs(c), {}, 0, width=100), [(_SURE, "1 | 1 | 2")])
by_case("beam_decode_with_model", lambda c: C.beam_search(_logs(c), {1: "▁a", 2: "▁b"}, 0, score=lambda w, before: 0.0 if w == "b" else -9.0, weight=1.0), [([[0.1, 0.45, 0.45], [0.8, 0.1, 0.1]], "2")])
by_case("keyword_spot", lambda c: [round(x, 6) for x in C.spot(_logs(c), [1, 2], 0)], [(_SURE, "-0.105361 | 3 | 5")])

# streams

by_case("stream_commit", lambda c: [" / ".join(map(str, o)) for o in L.replay(L.commit_step, c)], [([["text", "Hello there. How are", 0.0], ["text", "How are you", 1.0], ["timer", None, 3.0], ["timer", None, 4.0]],
        "Hello there.  / How are / punctuation | Hello there.  / How are you / None | Hello there.  / How are you / None | Hello there. How are you /  / pause")])
by_case("stream_confirm", lambda c: [" / ".join(o) for o in L.replay(L.confirm_step, [tuple(x) for x in c])][-1:], [([["a", 0.9, 11], ["b", 0.9, 12], ["c", 0.5, 13], ["d", 0.9, 5]], "a / d")])
by_case("stream_newest", lambda c: [f"{a}-{b}" for a, b in L.replay(lambda s, b: L.recent_step(s, b, 10, 4), c)], [([7, 7, 7, 1], "4-14 | 11-21")])
by_case("stream_timeline", lambda c: [f"{k} {n} {' '.join(f'{a}-{b}' for a, b in seg)}" for k, n, seg in L.replay(lambda s, e: L.timeline_step(s, e, 0.5, 0.3), [tuple(e) for e in c])], [
    ([["final", [0.9, 0.9]], ["snapshot", "a"], ["tentative", [0.1]], ["final", [0.1, 0.9]], ["rollback", "a"], ["final", [0.9, 0.0]], ["rebuild", [0.0, 0.9]]],
     "final 2 0-2 | snapshot 2 0-2 | tentative 2 0-2 | final 4 0-2 3-4 | rollback 2 0-2 | final 4 0-3 | rebuild 2 1-2")])

# readers and writers

_RTTM = "# note\n\nSPEAKER m1 1 2.50 1.00 <NA> <NA> b <NA> <NA>\nSPEAKER m1 1 0.00 1.00 <NA> <NA> a <NA> <NA>\n"
known("rttm_reader", "rec string, spk string, s double, e double", [("m1", "a", 0.0, 1.0), ("m1", "b", 2.5, 3.5)], lambda s: readers.rttm(s, put(s, {"a.rttm": _RTTM}) + "/a.rttm").toDF("rec", "spk", "s", "e"))
known("transcript_reader", "id string, text string", [("u1", "GOOD DAY"), ("u2", "HELLO THERE")], lambda s: readers.transcripts(s, put(s, {"1/x.trans.txt": "u2 HELLO THERE\nu1 GOOD DAY\nbroken\n"})).toDF("id", "text"))
known("key_value_reader", "key string, value string", [("a", "one two"), ("b", None)], lambda s: readers.key_values(s, put(s, {"kv": "a one two\nb\n\n"}) + "/kv").toDF("key", "value"))
known("segment_reader", "utt string, rec string, s double, e double", [("u", "r", 0.5, 1.5)], lambda s: readers.kaldi_segments(s, put(s, {"kv": "u r 0.5 1.5\nbad\n"}) + "/kv").toDF("utt", "rec", "s", "e"))
known("corpus_reader", "category string, text string", [("k", "Hello"), ("k", "plain")], lambda s: readers.corpus_lines(s, put(s, {"c.txt": "# c\nvoice|Hello\n\nplain\n"}) + "/c.txt", "k").toDF("category", "text"))
known("language_reader", "lang string, id string, text string", [("de", "1", "a"), ("de", "2", "b"), ("fr", "1", "a"), ("fr", "2", "b")],
      lambda s: readers.language_samples(s, put(s, {f"language={g}/a.tsv": "3\tc\n1\ta\n2\tb\n" for g in ("de", "fr")}), 2).toDF("lang", "id", "text"))
_ARPA = "\\data\\\nngram 1=2\n\n\\1-grams:\n-1.0\thas\t-0.2\n-2.1\tpain\nbad line\n\n\\2-grams:\n-0.5\thas pain\n\n\\3-grams:\n-9 a b c\n\n\\end\\\n"
known("arpa_unigrams", "word string, lp double, bo double", [("has", -2.302585, -0.460517), ("pain", -4.835429, 0.0)], lambda s: readers.arpa(s, put(s, {"lm": _ARPA}) + "/lm")[0].toDF("word", "lp", "bo").select("word", F.round("lp", 6).alias("lp"), F.round("bo", 6).alias("bo")))
known("arpa_bigrams", "context string, word string, lp double", [("has", "pain", -1.151293)], lambda s: readers.arpa(s, put(s, {"lm": _ARPA}) + "/lm")[1].toDF("context", "word", "lp").select("context", "word", F.round("lp", 6).alias("lp")))
known("vocabulary_reader", "term string, aliases string, least double", [("Orelia", "oh really,o relia", None), ("plain", "", None)],
      lambda s: readers.vocabulary(s, put(s, {"v.txt": "# c\nOrelia: oh really, o relia\nplain\n"}) + "/v.txt").toDF("term", "aliases", "least").withColumn("aliases", F.array_join("aliases", ",")))
known("vocabulary_json_reader", "term string, aliases string, least double", [("A", "b", 0.7), ("C", "", None)],
      lambda s: readers.vocabulary(s, put(s, {"v.txt": '{"terms": [{"text": "A", "aliases": ["b"], "minSimilarity": 0.7}, {"text": "C"}]}'}) + "/v.txt").toDF("term", "aliases", "least").withColumn("aliases", F.array_join("aliases", ",")))
known("piece_reader", "token int, piece string", [(0, "▁a"), (7, "b")], lambda s: readers.token_pieces(s, put(s, {"v.json": '{"0": "▁a", "7": "b"}'}) + "/v.json").toDF("token", "piece"))
known("meeting_segment_reader", "who string, s double, e double", [("A", 0.5, 1.5)], lambda s: readers.meeting_segments(s, put(s, {
    "s.xml": '<r><segment participant="A" transcriber_start="0.5" transcriber_end="1.5"/><segment participant="B" transcriber_start="2" transcriber_end="2"/></r>'}) + "/s.xml").toDF("who", "s", "e"))
known("meeting_word_reader", "word string, s double, e double", [("hi", 0.1, 0.2)], lambda s: readers.meeting_words(s, put(s, {
    "w.xml": '<r><w starttime="0.1" endtime="0.2">hi</w><w starttime="0.2" endtime="0.2" punc="true">.</w></r>'}) + "/w.xml").toDF("word", "s", "e"))
_PCM = struct.pack("<4h", 16384, 0, -32768, 32767)
_WAV = b"RIFF" + struct.pack("<I", 36 + len(_PCM)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16) + b"data" + struct.pack("<I", len(_PCM)) + _PCM
known("audio_reader", "rate int, n int, first double", [(16000, 2, 0.25)], lambda s: readers.audio(s, put(s, {"a.wav": _WAV}) + "/a.wav").toDF("path", "rate", "samples").select("rate", F.size("samples").alias("n"), F.round(F.element_at("samples", 1), 4).alias("first")))
_PIECE = b"\x0a\x03\xe2\x96\x81" + b"\x15" + struct.pack("<f", -1.5) + b"\x18\x02"
known("sentencepiece_reader", "id int, piece string, score double, kind int", [(0, "▁", -1.5, 2)], lambda s: readers.sentencepiece(s, put(s, {"m.model": b"\x0a" + bytes([len(_PIECE)]) + _PIECE + b"\x12\x01x"}) + "/m.model").toDF("id", "piece", "score", "kind"))


def _written(s: SparkSession, write) -> DataFrame:
    folder = f"{shared_dir(s)}/cadenza-{uuid.uuid4().hex}"
    write(folder)
    return s.read.text(folder)


known("json_sink", "value string", [('{"file":"f","n":1,"wer":null}',)], lambda s: _written(s, lambda p: sinks.json_report(s.createDataFrame([("f", float("nan"), 1)], "file string, wer double, n int"), p)).select(
    F.regexp_replace("value", r"\s", "").alias("value")).groupBy().agg(F.array_join(F.collect_list("value"), "").alias("value")))
known("rttm_sink", "value string", [("SPEAKER m 1 1.00 1.25 <NA> <NA> s <NA> <NA>",)], lambda s: _written(s, lambda p: sinks.rttm(s.createDataFrame([("m", "s", 1.0, 2.25)], "rec string, spk string, s double, e double"), p)))
known("embedding_sink", "id string, n int", [("a", 2)], lambda s: (lambda p: (sinks.embeddings(s.createDataFrame([("a", [1.0, 2.0])], "id string, v array<double>"), p), s.read.parquet(p))[1].select("id", F.size("v").alias("n")))(f"{shared_dir(s)}/cadenza-{uuid.uuid4().hex}"))
by_case("tone_marks", lambda c: [f"{b}{n}" for b, n in P.read_aloud(c, {"不": ["bù"], "一": ["yī"], "你好": ["nǐ", "hǎo"]}, {})], [("你好", "ni2 | hao3")])
by_case("r_colouring", lambda c: [f"{b}{n}" for b, n in P.r_coloured([tuple(x) for x in c])], [
    ([["zhe", 4], ["er", 5]], "zher4"), ([["xiao", 3], ["hai", 2], ["er", 5]], "xiao3 | hair2"), ([["er", 2], ["zi", 5]], "er2 | zi5"), ([["zhe", 4], ["er", 5], ["er", 5]], "zher4 | er5"), ([], "")])
by_case("phonetic_signs", lambda c: P.bopomofo(*c) or "", [
    (["zhong", 1], "ㄓㄨㄥ1"), (["guo", 2], "ㄍㄨㄛ2"), (["shi", 4], "ㄕ4"), (["xu", 1], "ㄒㄩ1"), (["yuan", 2], "ㄩㄢ2"), (["you", 3], "ㄧㄡ3"), (["ying", 1], "ㄧㄥ1"), (["wei", 4], "ㄨㄟ4"), (["weng", 1], "ㄨㄥ1"),
    (["er", 2], "ㄦ2"), (["nv", 3], "ㄋㄩ3"), (["jiong", 3], "ㄐㄩㄥ3"), (["hair", 2], "ㄏㄞㄦ2"), (["yi", 1], "ㄧ1"), (["wu", 3], "ㄨ3"), (["xyz", 1], "")])
