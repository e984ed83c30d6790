"""State machines of live streams: pure steps ``(state, input) -> (state, outputs)``.

The same step serves a replay of a finished stream (a fold over its rows in
order) and Structured Streaming (state per key).
"""

from __future__ import annotations

RATE, CHUNK = 16_000, 4096
MARKS = ".!?。！？"


def hop_step(state, block, chunk: int, hop: int):
    """Buffers sample counts; gives (begin, end) of every full chunk, advancing by ``hop``.  state: (samples so far, begin of the next)."""
    total, begin = state or (0, 0)
    total += block
    out = []
    while total - begin >= chunk:
        out.append((begin, begin + chunk))
        begin += hop
    return (total, begin), out


def recent_step(state, block, chunk: int, hop: int, first: int | None = None):
    """As ``hop_step``, but a chunk is always the newest ``chunk`` samples, once ``hop`` new ones are there; older ones are skipped.

    ``first``: a shorter chunk to begin with, which grows by ``hop`` until it is full.  state: (samples so far, samples at which the next is due, size).
    """
    total, due, size = state or (0, first or chunk, first or chunk)
    total += block
    if total < due:
        return (total, due, size), []
    out = [(total - size, total)]
    grown = min(size + hop, chunk)
    return (total, total + (grown - size if size < chunk else hop), grown), out


def timeline_step(state, event, up: float, down: float):
    """A timeline of one speaker that can be taken back.

    state: (final frames, segments so far, begin of the open one, named snapshots).  Events: ("final", values) appends frames,
    ("tentative", values) shows what they would add, ("snapshot", name) keeps the timeline under a name, ("rollback", name)
    returns to it, ("rebuild", values) begins anew with these frames.
    Output: (kind, final frames, segments as (first, last)); an open segment ends at the last frame.
    """
    n, done, begin, kept = state or (0, (), None, ())
    kind, value = event

    def append(n, done, begin, values):
        for p in values:
            if begin is None and p is not None and p > up:
                begin = n
            elif begin is not None and (p is None or p < down):
                done, begin = (*done, (begin, n)), None
            n += 1
        return n, done, begin

    def shown(n, done, begin):
        return list(done) + ([(begin, n)] if begin is not None else [])

    if kind == "snapshot":
        kept = (*((k, v) for k, v in kept if k != value), (value, (n, done, begin)))
    elif kind == "rollback":
        n, done, begin = dict(kept).get(value, (n, done, begin))
    elif kind == "rebuild":
        n, done, begin = append(0, (), None, value)
    elif kind == "final":
        n, done, begin = append(n, done, begin, value)
    else:
        return (n, done, begin, kept), [(kind, n, shown(*append(n, done, begin, value)))]
    return (n, done, begin, kept), [(kind, n, shown(n, done, begin))]


def placed_step(state, block, rate: int = RATE):
    """Where a block with an end time goes: ahead of the buffer the gap is silence; behind it the newest samples give way to the late block.

    block: (end time or None, samples).  state: buffered samples.  Output: (kind, samples affected, buffer after).
    """
    held, (end, n) = state or 0, block
    begin = held if end is None else max(0, round(end * rate) - n)
    if begin > held:
        out = [("gap", begin - held, begin + n)]
    elif begin < held:
        out = [("back", held - begin, begin + n)]
    else:
        out = [("next", 0, begin + n)]
    return begin + n, out


def vad_step(state, p, up: float = 0.85, down: float = 0.70, pad: int = 1600, quiet: int = 12_000):
    """Start and end events of speech; state: (speaking, begin of silence or None, samples)."""
    on, hush, n = state or (False, None, 0)
    n += CHUNK
    out = []
    if p is not None and p >= up:
        hush = None
        if not on:
            on = True
            out.append(("start", max(0, n - pad - CHUNK)))
    elif on and (p is None or p < down):
        hush = n if hush is None else hush
        if n - hush >= quiet:
            on = False
            out.append(("end", max(0, hush + pad - CHUNK)))
            hush = None
    return (on, hush, n), out


def commit_step(state, event, delay: float = 3.0):
    """Commits text through its last punctuation mark; the rest stays tentative until a pause, an end of utterance or a request.

    event: (kind, text, time) of kind text, end, manual or timer.  state: (committed, tentative, deadline or None).
    """
    done, ghost, due = state or ("", "", None)
    kind, text, now = event
    reason = None
    if due is not None and now >= due and ghost and kind != "text":
        kind = "timer" if kind == "timer" else kind
    if kind == "text":
        text = text or ""
        at = max((text.rfind(m) for m in MARKS), default=-1)
        if at >= 0:
            rest = text[at + 1 :].lstrip()
            space = text[at + 1 : len(text) - len(rest)] or " "
            done, ghost, due, reason = done + text[: at + 1] + space, rest, None, "punctuation"
        else:
            ghost, due = text, now + delay
    elif kind in ("end", "manual") or (kind == "timer" and due is not None and now >= due):
        if ghost:
            done = done + ("" if not done or done.endswith(" ") else " ") + ghost
            reason = {"timer": "pause"}.get(kind, kind)
        ghost, due = "", None
    return (done, ghost, due), [(done, ghost, reason)]


def confirm_step(state, result, confident: float = 0.85, context: float = 10.0):
    """A confident result with enough context makes the one before it final.  result: (text, confidence, seconds so far); state: (final, tentative)."""
    final, tentative = state or ("", "")
    text, conf, seconds = result
    if (conf or 0.0) >= confident and seconds >= context and tentative:
        final = f"{final} {tentative}".strip()
    return (final, text or ""), [(final, text or "")]


def utterance_step(state, chunk, wait: int = 20_480):
    """End of an utterance: an end signal without new tokens must last ``wait`` samples; tokens or a chunk without the signal start over.  It fires once.

    chunk: (signal, new tokens, samples).  state: (samples of silence or None, fired).
    """
    quiet, fired = state or (None, False)
    signal, tokens, n = chunk
    if not signal or tokens:
        return (None, False), [False]
    quiet = (quiet or 0) + n
    now = quiet >= wait and not fired
    return (quiet, fired or now), [now]


def window_step(state, samples, chunk: int, left: int, right: int, frame: int = 1280, final: bool = False):
    """Windows with context: the first waits for a chunk and its right context, later ones for a chunk; the last frames are held back until the end.

    state: (samples so far, decoded to).  Output: (begin, first new, end).
    """
    total, done = state or (0, 0)
    total += samples
    out = []
    while total - done >= chunk + right:
        out.append((max(0, done - left) // frame * frame, done, done + chunk))
        done += chunk
    if final and total > done:
        out.append((max(0, done - left) // frame * frame, done, total))
        done = total
    return (total, done), out


def mean_step(state, x):
    """Running mean of a vector: state (n, mean)."""
    n, mean = state or (0, [0.0] * len(x))
    n += 1
    mean = [m + (v - m) / n for m, v in zip(mean, x)]
    return (n, mean), [mean]


def cache_step(state, frames, capacity: int):
    """Bounded cache of (score, frame): the best stay, in order of time."""
    both = [*(state or []), *frames]
    keep = sorted(both, key=lambda x: (-x[0], x[1]))[:capacity]
    return sorted(keep, key=lambda x: x[1]), []


def replay(step, items, start=None):
    """All outputs of a finished stream."""
    state, out = start, []
    for x in items:
        state, new = step(state, x)
        out += new
    return out
