import random
import re
import unicodedata

import numpy as np
import pytest

from cadenza.llm.leaks import leak_report, leaked_items, leaked_passages
from cadenza.llm.residue import BUCKETS, WINDOW, Grams, Laid, best_ends, known_phrases, ratios, recognised, residue, residue_documents, seeds, smooth, windowed_residue, without_residue
from cadenza.llm.tokens import VOCABULARY, Vocabulary, encode_texts, load_ranks

DOCS = "doc_id long, text string, ids string, slot int, sign int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def awkward():
    rng = random.Random(1)
    out = [None, "", "   ", "\r\n\t ", "<|endoftext|> a<|endoftext|>", "a" * 4000, "=" * 3001, "日本語のテキスト" * 200, "👩🏽‍🚀🎙️" * 40, "é ﬁ ½", "I'll we've they'd I'M", "x" * 50_000 + " end", "\u0000￿"]
    return out + ["".join(rng.choice("abcxyz ZQ'’0129\n\t.-_é日я👍") for _ in range(rng.randrange(1, 200))) for _ in range(200)]


def test_ids_equal_the_library(spark, reference):
    texts = awkward()
    got = {r["doc_id"]: r["ids"] for r in encode_texts(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else []), repr(t)[:80]
    assert encode_texts(docs(spark, texts).limit(0)).count() == 0


def test_pairs_are_judged_as_exact_merging_does():
    v, rng = Vocabulary(load_ranks()), random.Random(3)
    back = {r: t for t, r in v.usable.items()}
    a, b = ([rng.choice([rng.randrange(256), rng.randrange(256, 2000), rng.randrange(50_000)]) for _ in range(3000)] for _ in "ab")
    good = v.compatible(np.array(a), np.array(b))
    assert [v.merge(back[x] + back[y]) == [x, y] for x, y in zip(a, b)] == good.tolist()
    assert 0 < good.sum() < 3000


def leaks_by_hand(texts, items, n=10):
    def words(t):
        return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower()) if t else []

    out = set()
    for k, item in items:
        w = words(item)
        size = min(n, len(w))
        need = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for d, t in enumerate(texts):
            x = words(t)
            if need & {tuple(x[i : i + size]) for i in range(len(x) - size + 1)}:
                out.add((d, k))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    items += [(900, None), (901, ""), (902, "..., !"), (903, "ＦＵＬＬ width"), (904, items[0][1]), (None, "w1 w2")]
    texts = [None, "", " ", "full—WIDTH", "full the width"]
    for _ in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        source = rng.choice(items[:60])[1].split()
        cut = source[rng.randrange(len(source)) :] if rng.random() < 0.5 else source
        texts.append((", ".join(w) + " - " + "; ".join(c.upper() for c in cut) + " " + " ".join(reversed(w))))
    table = spark.createDataFrame([(k, "s", "en", t) for k, t in items], "item_id long, suite string, words string, text string")
    want = leaks_by_hand(texts, [(k, t) for k, t in items if k is not None])
    assert {tuple(r) for r in leaked_items(docs(spark, texts), table).collect()} == want and want
    report = {r["item_id"]: r["documents"] for r in leak_report(docs(spark, texts), table).collect()}
    assert report == {k: sum(1 for _, i in want if i == k) for k in {i for _, i in want}}
    assert leaked_passages(docs(spark, texts), table.limit(0)).count() == 0
    assert leaked_items(docs(spark, texts).limit(0), table).count() == 0


PROSE = [
    "The decoder was checked on Friday and the buffer was moved to the second room.", "We agreed that the meeting starts at nine and that minutes are kept by the host.",
    "If the mirror answers 503 Service Unavailable, the loader waits and retries; it never stores the error body.", "The old mockup still had lorem ipsum in the pane, so it was replaced with a true transcript.",
    "Tokens such as <unk>, <blank> and [MASK] never reach the lexicon.", "The template engine leaves ${DATE} alone unless the cache is set.",
    "To see the waveform, JavaScript has to be enabled in the viewer; the rest works without it.", "Run `enroll <speaker name>` before the call.\n```\nexport CACHE=${HOME}/models\n```\nThen start.",
    "[00:12] ANNA: right and then it was moved {breath} to the other room [laughter]", "SPEAKER clip-1 1 0.00 2.34 <NA> <NA> speaker4 <NA> <NA>",
]
RESIDUE = [
    "Dear {{ first_name }}, the transcript is below.", "Title: [[TOPIC]]\nThe decoder was checked on Friday.", "Room: ____________\nThe meeting starts at nine.", "Hello <your name>, the file is ready.",
    "Please turn on JavaScript to view this page.", "502 Bad Gateway\nOur gateway refused to open that address.", '{"error": {"code": 404, "message": "Not Found"}, "ok": false}',
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod tempor.", "The decoder was checked on Friday.\n\nMinim veniam quis nostrud ut enim ad aliqua ut enim ad minim veniam quis nostrud.",
    "asdf qwer jkl foo bar asdf asdf qwer blah jkl foo bar xxx asdf", "Hello Ann, your captions for XXXXX are ready.",
]


def test_residue_is_found_and_prose_is_kept(spark):
    texts = PROSE * 30 + RESIDUE + [None, "", "  \n"]
    found = {r["doc_id"] for r in residue_documents(docs(spark, texts)).collect()}
    start = len(PROSE) * 30
    missed = [RESIDUE[i] for i in range(len(RESIDUE)) if start + i not in found]
    wrong = {PROSE[i % len(PROSE)] for i in found if i < start}
    assert not missed and not wrong and max(found) < start + len(RESIDUE)
    kept = without_residue(docs(spark, texts))
    assert kept.count() == len(texts) - len(found) and kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_windows_alone_find_residue_and_slots(spark):
    texts = PROSE * 30 + RESIDUE + [None, ""]
    start = len(PROSE) * 30
    slotted = {i for i, t in enumerate(RESIDUE) if any(x in t for x in ("{{", "[[", "____", "<your", "XXXXX"))}
    got = windowed_residue(docs(spark, texts)).collect()
    assert {r["doc_id"] - start for r in got if r["in_place"]} == set(range(len(RESIDUE))) - slotted
    assert {r["doc_id"] - start for r in got if r["window"]} >= slotted
    assert all(r["evidence"] >= 12 and 0.35 <= r["covered"] <= 1 for r in got if r["in_place"])
    assert windowed_residue(docs(spark, texts).limit(0)).count() == 0


def test_residue_of_phrases_that_the_models_have_not_seen(spark):
    known = known_phrases()
    seen, unseen = ({k: [kind[r::2] for kind in kinds] for k, kinds in known.items()} for r in (0, 1))
    rng = random.Random(2)
    pages = [p for k in ("filler", "notice") for kind in unseen[k] for p in rng.sample(kind, min(20, len(kind)))]
    pages = [p for p in pages if len(p) > 60]
    slots = [f"Title: {s}\n{rng.choice(PROSE[:2])}" for s in rng.sample([s for s in unseen["slot"][0] if s.startswith(("{{", "[[", "<<", "@@", "${", "<your"))], 30)]
    texts = PROSE * 400 + pages + slots
    start = len(PROSE) * 400
    found = {r["doc_id"] - start for r in residue_documents(docs(spark, texts), phrases=seen).collect()}
    assert min(found) >= 0
    assert len([i for i in found if i < len(pages)]) >= 0.8 * len(pages)
    assert len([i for i in found if i >= len(pages)]) >= 0.9 * len(slots)


def test_models_fitted_on_a_sample_judge_every_document(spark):
    texts = PROSE * 60 + RESIDUE
    found = {r["doc_id"] for r in residue_documents(docs(spark, texts), fit_rows=300).collect()}
    start = len(PROSE) * 60
    assert min(found) >= start and len(found) >= len(RESIDUE) - 1


def test_models_are_fitted_on_all_documents(spark):
    rng = random.Random(7)
    words = " ".join(PROSE[:2]).split()
    table = docs(spark, [" ".join(rng.choices(words, k=12)) for _ in range(24_000)] + RESIDUE).cache()
    by_default, by_all = ({r["doc_id"]: (r["slot"], r["in_place"], r["evidence"]) for r in residue(table, **p).collect()} for p in ({}, {"fit_rows": table.count()}))
    assert by_default == by_all and by_default


def test_window_means_by_hand():
    rng = np.random.default_rng(4)
    for sizes in ([0, 3, 1, 40, 0, 100, 17], [5], [64], []):
        edge = np.concatenate([[0], np.cumsum(np.array(sizes, int))])
        x = rng.normal(size=edge[-1]).astype(np.float32)
        for before, after in ((16, 16), (0, 4), (0, 2)):
            want = [x[max(i - before, a) : min(i + after, b)].mean(dtype=float) for a, b in zip(edge, edge[1:]) for i in range(a, b)]
            assert np.allclose(smooth(x, edge, before, after), want, rtol=0, atol=1e-9)


def test_whole_documents_are_recognised_as_by_windows_over_all():
    rng = np.random.default_rng(5)
    known = known_phrases()
    start, residues = seeds(known), [*RESIDUE, *known["filler"][0], *known["notice"][2]]
    texts = [p[: rng.integers(0, len(p))] + "\n" + " ".join(rng.choice(residues, rng.integers(1, 12))) for p in PROSE * 20] + PROSE + residues
    laid = Laid.of(texts)
    grams = Grams.of(laid, BUCKETS)
    prose = np.bincount(grams.code, minlength=BUCKETS)
    found = set()
    for shift in (-2, -1, 0, 1):  # from few to almost all
        pairs = [[ratios(start[k], prose) + np.float32(shift) for k in ("filler", "notice")], [rng.uniform(-3.5, 6, BUCKETS).astype(np.float32) + np.float32(shift) for _ in "ab"]]
        for filler, notice in (np.clip(p, -3.5, 6) for p in pairs):
            evidence, covered, share, is_filler = best_ends(laid, grams, filler, notice)
            sure = (share >= 0.95) & (covered >= 0.8) & (evidence >= 30)
            got = recognised(laid, grams, filler, notice)
            assert (got[0] == (sure & is_filler)).all() and (got[1] == (sure & ~is_filler)).all()
            found.add(int(sure.sum()))
    assert len(found) > 3 and max(grams.size) > 4 * WINDOW


def test_laid_documents_score_as_each_alone():
    rng = np.random.default_rng(3)
    texts = ["Short.", "x", *PROSE, *RESIDUE, "日本。 次の文\n終わり"]
    filler, notice = (rng.normal(size=BUCKETS).astype(np.float32) for _ in "ab")
    laid = Laid.of(texts)
    together = best_ends(laid, Grams.of(laid, BUCKETS), filler, notice)
    for i, t in enumerate(texts):
        one = Laid.of([t])
        alone = best_ends(one, Grams.of(one, BUCKETS), filler, notice)
        assert all(abs(float(a[0]) - float(b[i])) < 1e-6 for a, b in zip(alone, together))


def test_residue_of_long_repeated_and_no_texts(spark):
    long = "\n".join(PROSE[:2] * 20_000)
    table = docs(spark, [long, long + "\n503 Service Unavailable\nSomething went wrong. Please try again later.", RESIDUE[0]])
    table = table.unionByName(table.filter("doc_id = 2"))
    assert sorted(r["doc_id"] for r in residue_documents(table).collect()) == [1, 2, 2]
    assert residue(table.limit(0)).count() == 0
