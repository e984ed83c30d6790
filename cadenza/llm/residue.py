"""Template residue, filler, error pages and script notices in place of content.

Character n-gram models (hashed, bytes of the lower-cased text) are fitted for
filler, for notices, for unfilled slots and for natural prose.  Slots have a
second model over shapes (runs of letters and of digits as one sign each), which
knows a slot by its brackets, whatever name stands in them.  The models start
from the phrases below and are fitted on all documents: prose counts every one,
filler and notices learn from texts recognised as a whole.  Then one more scan
judges every document:

* likelihood ratios are averaged over windows; filler and notices are the end of
  a text (or all of it) that such windows cover;
* slots are short windows in which a slot model is far ahead of prose.  An exact
  check follows: a bracket or blank must stand in the window, and not in code or
  in a sentence about slots.

Documents are laid end to end, about a million bytes at a time, and scored at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from cadenza.session import drop, materialise

ORDER, BUCKETS, WINDOW = 5, 1 << 19, 32
SHAPES, SHORT, SHORT_SHAPES = 1 << 17, 4, 2  # buckets of shapes; n-grams in a slot's window
CHUNK = 1 << 20  # bytes that are scored together
BACKOFF, SLOT_BACKOFF = 0.03, 0.2  # share of a residue model that is prose
EVIDENCE, COVERED, SLOT, SLOT_SHAPE, SLOT_SURE = 12.0, 0.35, 2.25, 3.0, 3.5  # least evidence and coverage of residue in place of content; least mean ratios of a slot's window
LEAST, MOST, LEVEL = -3.5, 6.0, 2.5  # bounds of a ratio, and of a window's mean as evidence
WHOLE, WHOLE_SHARE, WHOLE_COVERED = 30.0, 0.95, 0.8  # least evidence, share and coverage of a text recognised as a whole

# Phrases of pages that hold no content.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt
mollit anim id est laborum porta mauris vitae tincidunt""".split()
KEYS = "asdf qwer jkl foo bar baz blah xxx yyy zzz asdfasdf qwerty test qwertz abc".split()
FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Text text text. Dummy text goes here. Sample text goes here. Sample sentence number 1. Placeholder text. Your text here. Your text
Body copy goes here. Insert text here. Content goes here. Content to follow. Caption to follow. Text to follow. Title of the talk
Heading one. Subheading. Bullet. Bullet point. Short teaser. Headline goes here. Add your text here. Click to add text. Click to add title.
This paragraph holds the place of the real text. Replace it before you publish. This is a placeholder paragraph. Replace this text.
This is some filler text. Blindtext steht hier. Hier steht Blindtext. Texte de remplissage. Texto de relleno. Testo segnaposto. Рыбный текст.""".split("\n")
STATUS = """400 Bad Request, 401 Unauthorized, 403 Forbidden, 404 Not Found, 405 Method Not Allowed, 408 Request Timeout, 410 Gone,
429 Too Many Requests, 500 Internal Server Error, 502 Bad Gateway, 503 Service Unavailable, 504 Gateway Timeout""".replace("\n", " ").split(", ")
ERRORS = """The page you requested could not be found. We could not find that page. Oops! We could not find that recording. This page does not exist.
Access denied. You lack permission to open this page. Your session has ended; log in again to go on. Please sign in again to continue.
An unexpected error occurred. Something went wrong. Please try again later. Please come back later. The server did not respond in time (timeout).
The service is temporarily unavailable. It was not possible to load your file. We failed to load the transcript. Sorry, we could not open that address.
Our gateway refused to open that address: no such entry. The server refused to deliver the recording. Too many requests from your network.
This content is not available in your region. Checking that you are a person. This takes a few seconds. Checking your browser before you continue.
Something broke on our side. Try again in 5 minutes. Down for maintenance until 10:00. Maintenance: the site is back at 10 o'clock. We are working on it. Reload. Retry.
This page is under construction. Coming soon. The connection was reset. The request timed out. Request 10-1. Error reference 10.
Back to start. Powered by gateway/1.0. If this goes on, tell the desk: case 1/2. Loading ... Loading player ...
Die angeforderte Seite gibt es nicht. Seite nicht gefunden. La page demandée est introuvable. Page introuvable. No se encontró la página. La página solicitada no existe.
Pagina non trovata. La pagina richiesta non esiste. Nie znaleziono strony. Страница не найдена. Запрошенная страница не найдена. Сторінку не знайдено. Η σελίδα δεν βρέθηκε.
ページが見つかりません。 找不到页面。 页面不存在。 無法找到頁面。 페이지를 찾을 수 없습니다.""".split("\n")
SCRIPTS = """Please turn on JavaScript to view this page. JavaScript is disabled. Please enable JavaScript to continue. This page needs JavaScript.
This site requires JavaScript. Your browser has it switched off. You must enable scripting and cookies before the page can load.
Scripts are blocked. Allow scripts for this site and reload. Our player works only with scripts. Turn it on and try again. Disable your script blocker and reload.
This viewer depends on active scripting. Switch it on in your settings to go on. The page will not run without a browser with JS - change that.
The editor needs client-side scripting. Allow it for this address. Your browser does not run the code this page depends on (noscript).
<noscript><p>Please turn on JavaScript to view this page.</p></noscript>
JavaScript ist ausgeschaltet. Bitte aktivieren Sie JavaScript, um fortzufahren. Veuillez activer JavaScript pour afficher cette page. Active JavaScript para ver el contenido.
Abilita JavaScript per continuare. Włącz obsługę JavaScript, aby zobaczyć stronę. Для просмотра включите JavaScript. Увімкніть JavaScript, щоб переглянути сторінку.
Ενεργοποιήστε τη JavaScript για να συνεχίσετε. JavaScriptを有効にしてください。 请启用 JavaScript 后再访问。 請啟用 JavaScript。 자바스크립트를 활성화하십시오.""".split("\n")
FIELDS = """name first name last name full name your name speaker name host name title meeting title subject topic date time place room city address agenda
summary abstract contact email phone signature language duration speaker host guest company team project version model version number id clip id link url
recording link file path table value amount price score result text body message comment nombre apellido fecha tema votre nom prénom date sujet ihr name
wer table clip id datum thema imię nome cognome имя дата тема""".replace("\n", " ").split(" ")


SLOT_FORMS = """{{%s}} {{_%s_}} ${%s} ${_%s_} #{%s} #{_%s_} {%_%s_%} [[%s]] [[_%s_]] <<%s>> <<_%s_>> @@%s@@ %(%s)s %%s% __%s__ {%s} <%s> [%s] ???%s??? [insert_%s] [fill_in_%s] [add_%s]
[tbd:_%s] [todo:_%s] [%s_here] (insert_%s) (insert_%s_here) (add_%s) <your_%s> <insert_%s> [your_%s] [votre_%s] [ihr_%s] [su_%s] [your_%s_here] [describe_%s] [write_%s] [add_two_words_about_%s]
todo_%s tbd_%s fixme_%s""".split()
BLANKS = ["x" * n for n in (4, 5, 6, 8)] + ["_" * n for n in (5, 8, 12, 20)]
SLOT_NAMES = sorted({n for f in {"имя", "名前", *map(str.strip, FIELDS)} for n in (f, f.replace(" ", "_"), f.replace(" ", ""), f.replace(" ", "."))})
FIELD_WORDS = {w for f in FIELDS for w in f.split()}
#: What may stand around a slot; words are one sign in shapes.
AROUND = ["%s, a word", "a word %s.", "a word: %s\nword", "word %s word", "a word: %s | word", "%s a word", "word, %s! word", "(%s) word", "word:%s\n"]

NAME = r"[^\W\d_][\w. -]{0,40}?"
SLOTS = [  # what an empty slot looks like, whatever its name
    r"\{\{ ?%s ?\}\}", r"\$\{ ?%s ?\}", r"#\{ ?%s ?\}", r"\{%% ?%s ?%%\}", r"\[\[ ?%s ?\]\]", r"<< ?%s ?>>", r"@@%s@@", r"%%\(%s\)s", r"(?<![\w%%])%%%s%%(?![\w%%])", r"(?<!\w)__%s__(?!\w)",
    r"\[(?:INSERT|Insert|insert|FILL IN|ADD|TBD:?|TODO:?) ?%s\]", r"\[%s HERE\]", r"\((?:insert|add|enter|fill in) %s\)", r"<(?:your|YOUR|insert|INSERT) %s>",
    r"\[(?:[Yy]our|[Vv]otre|[Ii]hre?|[Ss]u|[Ii]l tuo) %s\]", r"\[(?:add|insert|write|describe) %s\]",
    r"(?<!\w)(?:TODO_|TBD_|FIXME_)\w+", r"(?<!\w)X{4,}(?!\w)", r"\?{3}%s\?{3}", r"(?<![\w_])_{5,}(?![\w_])",
]
SURE = re.compile("|".join(s.replace("%%", "%").replace("%s", NAME) if "%s" in s else s for s in SLOTS))
MAYBE = re.compile(rf"(?<![\w$#{{<\[%@])(?:\{{(?P<a>{NAME})\}}|<(?P<b>{NAME})>|\[(?P<c>{NAME})\])(?![\w}}>\](])")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|<(?:pre|code)\b.*?(?:</(?:pre|code)>|\Z)", re.S | re.I)
#: Words of sentences that speak about slots.
ABOUT = re.compile(r"\b(?:literal(?:ly)?|template engine|placeholders?|variables?|syntax|escap(?:e|es|ed|ing)|substitut\w+|interpolat\w+|the (?:form|token|tag|string|pattern|notation)|tokens? such as|such as|stands for|means|for example|e\.g\.)\b", re.I)


@dataclass
class Laid:
    """Documents laid end to end: lower case, digits alike, a line end on either side of each."""

    raw: np.ndarray  # bytes
    size: np.ndarray  # bytes of each document

    @classmethod
    def of(cls, texts: list[str]) -> Laid:
        parts = [b"\n" + t.strip().lower().encode("utf-8", "replace") + b"\n" for t in texts]
        raw = np.frombuffer(b"".join(parts), np.uint8).copy()
        raw[(raw >= 48) & (raw <= 57)] = 48
        return cls(raw, np.fromiter(map(len, parts), np.int64, len(parts)))

    def of_documents(self, which: np.ndarray) -> Laid:
        return Laid(self.raw[np.repeat(which, self.size)], self.size[which])

    def shapes(self) -> tuple[Laid, np.ndarray]:
        """The same documents with one sign for a run of letters or digits, and where in the bytes each sign begins."""
        x = self.raw.copy()
        x[((x >= 97) & (x <= 122)) | (x >= 128)] = 97
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | ((x[1:] != 97) & (x[1:] != 48))
        total = np.concatenate([[0], np.cumsum(first)])
        edge = np.concatenate([[0], np.cumsum(self.size)])
        return Laid(x[first], np.diff(total[edge])), np.flatnonzero(first)


@dataclass
class Grams:
    """Hashed n-grams of laid documents; of a document, ``size`` follow one another."""

    code: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, laid: Laid, buckets: int) -> Grams:
        n = max(0, len(laid.raw) - ORDER + 1)
        h = np.zeros(n, np.uint32)
        for i in range(ORDER):
            h ^= laid.raw[i : i + n]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inside = np.ones(len(laid.raw), bool)  # those that cross into the next document don't count
        ends = np.cumsum(laid.size)
        for i in range(1, ORDER):
            inside[np.maximum(ends - i, ends - laid.size)] = False
        return cls((h & np.uint32(buckets - 1)).astype(np.int32)[inside[:n]], np.maximum(laid.size - ORDER + 1, 0))

    def of_documents(self, which: np.ndarray) -> Grams:
        return Grams(self.code[np.repeat(which, self.size)], self.size[which])

    @property
    def edge(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])


def running(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Sums of the values before each position, and of all."""
    out = np.zeros(len(x) + 1, kind)
    np.cumsum(x, dtype=kind, out=out[1:])
    return out


def smooth(x: np.ndarray, edge: np.ndarray, before: int, after: int) -> np.ndarray:
    """Means over windows from ``before`` a position to ``after`` it, cut off at the document's ends."""
    total, n = running(x), len(x)
    out = np.empty(n)
    if n >= before + after:
        out[before : n - after + 1] = (total[before + after :] - total[: n + 1 - before - after]) / (before + after)
    first, last = edge[:-1, None], edge[1:, None]
    at = np.hstack([first + np.arange(before), last - np.arange(1, after)])  # windows that reach beyond their document
    doc, _ = inside = np.nonzero((at >= first) & (at < last))
    at = at[inside]
    a, b = np.maximum(at - before, edge[doc]), np.minimum(at + after, edge[doc + 1])
    out[at] = (total[b] - total[a]) / (b - a)
    return out


def sentence_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes at which a line or sentence begins: after space with a line end in it, or with a sentence's end before it."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.flatnonzero(space[:-1] & ~space[1:])  # ends of runs of space
    first = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))[: len(last)]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    mark = raw[np.maximum(first - 1, 0)]
    closed = np.isin(mark, np.frombuffer(b".!?", np.uint8)) | (  # the marks of Chinese and Japanese have three bytes
        (mark == 0x82) & (raw[np.maximum(first - 2, 0)] == 0x80)) | (((mark == 0x81) | (mark == 0x9F)) & (raw[np.maximum(first - 2, 0)] == 0xBC))
    return last[(lines[last + 1] > lines[first]) | closed] + 1


def best_ends(laid: Laid, grams: Grams, filler: np.ndarray, notice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's best end, begun at a line or sentence: (evidence, share covered, share of the text, is filler)."""
    edge, n = grams.edge, len(laid.size)
    f, e = (smooth(r[grams.code], edge, WINDOW // 2, WINDOW // 2) for r in (filler, notice))
    both = np.maximum(f, e)
    starts = sentence_starts(laid.raw)
    offset = np.concatenate([[0], np.cumsum(laid.size)])
    doc = np.searchsorted(offset, starts, "right") - 1
    ok = starts - offset[doc] < grams.size[doc]
    doc = np.concatenate([np.arange(n), doc[ok]])
    at = np.concatenate([edge[:-1], edge[doc[n:]] + (starts - offset[np.searchsorted(offset, starts, "right") - 1])[ok]])
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    sums, above, more = running(both.clip(-LEVEL, LEVEL)), running(both > 0, np.int64), running(f - e)
    value = sums[edge[doc + 1]] - sums[at]
    most = np.maximum.reduceat(value, np.searchsorted(doc, np.arange(n)))
    here = np.flatnonzero(value == most[doc])
    at = at[here[np.searchsorted(doc[here], np.arange(n))]]
    length = np.maximum(edge[1:] - at, 1)
    return most, (above[edge[1:]] - above[at]) / length, (edge[1:] - at) / np.maximum(grams.size, 1), more[edge[1:]] - more[at] > 0


def recognised(laid: Laid, grams: Grams, filler: np.ndarray, notice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each document is filler, or a notice, as a whole.

    Windows are laid only over documents that can be, which loses none.  The evidence of all of a document is at least
    ``WHOLE`` less what a start outside ``WHOLE_SHARE`` takes off; it is at most the sum of the greater ratio of each
    n-gram, but for n-grams within a window of the ends, which count 0.3 more or less in the windows cut off there.
    """
    upper = running(np.maximum(np.maximum(filler, notice), -LEVEL)[grams.code])[grams.edge]
    least = WHOLE - LEVEL * (1 - WHOLE_SHARE) * grams.size - 0.3 * MOST * 2 * WINDOW
    maybe = (grams.size < 2 * WINDOW) | (np.diff(upper) >= least)
    out = np.zeros((2, len(maybe)), bool)
    if maybe.any():
        evidence, covered, share, is_filler = best_ends(laid.of_documents(maybe), grams.of_documents(maybe), filler, notice)
        sure = (share >= WHOLE_SHARE) & (covered >= WHOLE_COVERED) & (evidence >= WHOLE)
        out[:, maybe] = sure & is_filler, sure & ~is_filler
    return out[0], out[1]


def slot_windows(laid: Laid, grams: Grams, slot: np.ndarray, shape: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By document: bytes at which a short window begins whose mean ratio shows a slot, and whether it does so by its bytes beyond doubt."""
    offset, found = np.concatenate([[0], np.cumsum(laid.size)]), []
    mean = smooth(slot[grams.code], grams.edge, 0, SHORT)
    at = np.flatnonzero(mean >= SLOT)
    doc = np.searchsorted(grams.edge, at, "right") - 1
    found.append((doc, at - grams.edge[doc], mean[at] >= SLOT_SURE))
    signs, begin = laid.shapes()
    marks = Grams.of(signs, SHAPES)
    at = np.flatnonzero(smooth(shape[marks.code], marks.edge, 0, SHORT_SHAPES) >= SLOT_SHAPE)
    doc = np.searchsorted(marks.edge, at, "right") - 1
    first = np.concatenate([[0], np.cumsum(signs.size)])
    found.append((doc, begin[first[doc] + at - marks.edge[doc]] - offset[doc], np.zeros(len(at), bool)))
    doc, at, plain = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, doc))
    which, start = np.unique(doc[order], return_index=True)
    return dict(zip(which.tolist(), zip(np.split(at[order], start[1:]), np.split(plain[order], start[1:]))))


def is_unfilled(text: str, windows: np.ndarray, plain: np.ndarray) -> bool:
    """Exact check of a document with slot windows: whether one of them holds an empty slot, outside code and sentences about slots.

    Bare brackets need a sure window of their own bytes or a field's name inside, as marks of speech and tags are of the same shape.
    """
    body = text.lstrip()
    lead = len(text) - len(body)
    if body.isascii():
        at = lead + windows - 1
    else:
        low = body.lower().encode("utf-8", "replace")
        at = lead + np.array([len(low[: max(0, w - 1)].decode("utf-8", "ignore")) for w in windows])
    code = [m.span() for m in CODE.finditer(text)]
    for m in [*SURE.finditer(text), *MAYBE.finditer(text)]:
        if any(a < m.end() and m.start() < b for a, b in code):
            continue
        if m.re is MAYBE:
            inner = m["a"] or m["b"] or m["c"]
            field = FIELD_WORDS.issuperset(re.sub(r"[_.-]|(?<=[a-z])(?=[A-Z])", " ", inner).lower().split())
            near = (at >= m.start() - 32) & (at < m.end()) if field else plain & (at >= m.start() - 3) & (at < m.end())
            if not near.any() or (m["b"] and f"</{inner}>" in text):
                continue
        elif not ((at >= m.start() - 32) & (at <= m.end())).any():
            continue
        a = max(text.rfind("\n", 0, m.start()), text.rfind(". ", 0, m.start())) + 1
        b = min((x for x in (text.find("\n", m.end()), text.find(". ", m.end())) if x >= 0), default=len(text))
        if not ABOUT.search(text[a:m.start()] + " " + text[m.end():b]):
            return True
    return False


def counts(texts: list[str], buckets: int = BUCKETS, shapes: bool = False) -> np.ndarray:
    laid = Laid.of(texts)
    return np.bincount(Grams.of(laid.shapes()[0] if shapes else laid, buckets).code, minlength=buckets).astype(float)


def mixed(*parts: np.ndarray) -> np.ndarray:
    return sum(c / max(1, c.sum()) for c in parts) / len(parts)


def seeds(phrases: dict[str, list[list[str]]]) -> dict[str, np.ndarray]:
    """Starting distributions: each model is the even mixture of its kinds of phrases."""
    out = {k: mixed(*(counts(kind) for kind in kinds)) for k, kinds in phrases.items() if k != "slot"}
    slots = [[a.replace("%s", s) for s in kind for a in AROUND] for kind in phrases["slot"]]
    out["slot"] = mixed(*(counts(kind) for kind in slots))
    out["shape"] = mixed(*(counts(kind, SHAPES, True) for kind in slots))
    return out


def known_phrases() -> dict[str, list[list[str]]]:
    """Phrases by model and kind."""
    rng = np.random.default_rng(11)
    drawn = [[" ".join(rng.choice(words, 12)) + "." for _ in range(120)] for words in (LATIN, KEYS)]
    pages = [f"{s}\n" for s in STATUS] + [f"HTTP/1.1 {s}\nContent-Length: 0\nRetry-After: 30\nConnection: close\n" for s in STATUS]
    pages += [f'{{"error": {{"code": {s[:3]}, "message": "{s[4:]}"}}, "ok": false}}' for s in STATUS]
    pages += [f"<html><head><title>{t}</title></head><body><h1>{s}</h1><p>The page could not be found.</p></body></html>" for s in STATUS for t in ("Error", s)]
    pages += [f'Traceback (most recent call last):\n  File "serve.py", line 1, in fetch\n{e}: The file could not be loaded. ({s[:3]})' for s in STATUS for e in ("Error", "RuntimeError")]
    slots = [form.replace("_%s", " %s").replace("%s_", "%s ").replace("n_%", "n %").replace("two_words_about", "two words about").replace("%s", n) if "todo" not in form and "tbd_" not in form and "fixme" not in form and "__" not in form
             else form.replace("%s", n.replace(" ", "_")) for form in SLOT_FORMS for n in SLOT_NAMES]
    return {"filler": [FILLER, *drawn], "notice": [ERRORS, SCRIPTS, pages], "slot": [slots, BLANKS]}


def ratios(share: np.ndarray, prose: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """Log likelihood ratio of each bucket; the residue model backs off to prose."""
    p = (prose + 0.5) / (prose.sum() + 0.5 * len(prose))
    return np.log(backoff + (1 - backoff) * share / p).clip(LEAST, MOST).astype(np.float32)


def chunks(keys: list, texts: list):
    """(keys, texts) of documents with content, about a million bytes at a time."""
    k, t, size = [], [], 0
    for key, text in zip(keys, texts):
        if text and not text.isspace():
            k.append(key)
            t.append(text)
            size += len(text)
            if size > CHUNK:
                yield k, t
                k, t, size = [], [], 0
    if t:
        yield k, t


def fitted(rows: DataFrame, phrases: dict, rounds: int) -> dict[str, np.ndarray]:
    """Ratios of the models, learnt from ``rows`` (text)."""
    spark = rows.sparkSession

    def summed(label) -> dict[str, np.ndarray]:
        """Counts by model; ``label`` gives the model of each of a chunk's documents, or None."""
        def run(batches):
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                for _, texts in chunks([None] * batch.num_rows, batch.column(0).to_pylist()):
                    laid = Laid.of(texts)
                    grams = Grams.of(laid, BUCKETS)
                    for name, which in label(laid, grams).items():
                        codes, buckets = grams, BUCKETS
                        if name == "shape":
                            codes, buckets = Grams.of(laid.shapes()[0], SHAPES), SHAPES
                        if which.any():
                            total = totals.setdefault(name, np.zeros(buckets, np.int64))
                            total += np.bincount(codes.code[np.repeat(which, codes.size)], minlength=buckets)
            for name, total in totals.items():
                b = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b, pa.int32()), pa.array(total[b], pa.int64())], names=["model", "bucket", "n"])

        sums = rows.mapInArrow(run, "model string, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow()
        out: dict[str, np.ndarray] = {}
        for name in set(sums.column("model").to_pylist()):
            part = sums.filter(pa.compute.equal(sums.column("model"), name))
            out[name] = np.zeros(SHAPES if name == "shape" else BUCKETS)
            out[name][part.column("bucket").to_numpy()] = part.column("n").to_numpy()
        return out

    first = summed(lambda laid, _: {"prose": np.ones(len(laid.size), bool), "shape": np.ones(len(laid.size), bool)})
    prose, shape = first.get("prose", np.zeros(BUCKETS)), first.get("shape", np.zeros(SHAPES))
    start = seeds(phrases)
    model, rest = dict(start), prose
    for _ in range(rounds):
        known = spark.sparkContext.broadcast((ratios(model["filler"], rest), ratios(model["notice"], rest)))

        learnt = summed(lambda laid, grams, known=known: dict(zip(("filler", "notice"), recognised(laid, grams, *known.value))))
        # what was learnt leaves the prose model
        rest = np.maximum(prose - sum(learnt.values()), 0)
        model = {k: mixed(start[k], learnt[k]) if k in learnt else start[k] for k in start}
    return {"filler": ratios(model["filler"], rest), "notice": ratios(model["notice"], rest), "slot": ratios(model["slot"], rest, SLOT_BACKOFF), "shape": ratios(model["shape"], shape)}


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 2, fit_rows: int | None = None, phrases: dict | None = None) -> DataFrame:
    """``key, window, slot, in_place, evidence, covered`` of documents with residue, by the models and windows.

    ``window``: a short window shows a slot; ``slot``: the exact check agrees; ``in_place``: filler, an error or a
    script notice stands in place of the content or of the rest after an opening.

    * null, empty and blank texts have none; repeated keys and rows stay as they are;
    * texts are scanned whole, whatever their length; an empty table gives an empty result; extra columns are ignored.

    The models are fitted on all documents, in ``rounds`` + 1 scans; their counts are tables of fixed size (2 ** 19
    buckets a model).  Every document is judged, in one more scan.  Only a caller who asks for it by ``fit_rows`` has
    the models of about that many documents, chosen by the hash of their key.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    phrases = phrases or known_phrases()
    if fit_rows is None:
        models = fitted(rows.select("text"), phrases, rounds)
    else:
        share = min(1.0, fit_rows / max(1, docs.count()))
        sample = materialise(rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).select("text"))
        models = fitted(sample, phrases, rounds)
        drop(sample)
    tables = spark.sparkContext.broadcast(models)

    def judge(batches):
        known = tables.value
        for batch in batches:
            out = []
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                laid = Laid.of(texts)
                grams = Grams.of(laid, BUCKETS)
                evidence, covered, _, _ = best_ends(laid, grams, known["filler"], known["notice"])
                windows = slot_windows(laid, grams, known["slot"], known["shape"])
                placed = (evidence >= EVIDENCE) & (covered >= COVERED)
                for i in sorted({*windows, *np.flatnonzero(placed).tolist()}):
                    out.append((keys[i], i in windows, i in windows and is_unfilled(texts[i], *windows[i]), bool(placed[i]), float(evidence[i]), float(covered[i])))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *[pa.array(c, x) for c, x in zip(cols[1:], (pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64()))]],
                                             names=[key, "window", "slot", "in_place", "evidence", "covered"])

    return rows.mapInArrow(judge, f"`{key}` {kind}, window boolean, slot boolean, in_place boolean, evidence double, covered double")


def windowed_residue(docs: DataFrame, **params) -> DataFrame:
    """What the n-gram models and windows find by themselves, without the exact check: ``doc_id, window, in_place, evidence, covered``."""
    return residue(docs, **params).select("doc_id", "window", "in_place", "evidence", "covered")


def residue_documents(docs: DataFrame, **params) -> DataFrame:
    return residue(docs, **params).filter("slot OR in_place").select("doc_id")


def without_residue(docs: DataFrame, **params) -> DataFrame:
    """The documents that remain."""
    return docs.join(residue_documents(docs, **params), "doc_id", "left_anti")
