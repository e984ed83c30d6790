"""Pronunciation rules: stress marks, Chinese tones, readings from binary tables."""

from __future__ import annotations

import struct
import unicodedata

# Stress marks and vowel letters of the phoneme alphabet.
PRIMARY, SECONDARY, VOWELS = "ˈ", "ˌ", set("AIOQWYaiuæɑɒɔəɛɜɪʊʌᵻ")


def stressed(sounds: str, level: float | None) -> str:
    """Stress raised or lowered to ``level``: below -1 none; -1 demotes; 0 to 1 gives an unstressed word a secondary mark; 1 and more promote; above 1 gives a primary one. Marks stand before the vowel."""
    if level is None:
        return sounds
    strong, weak = PRIMARY in sounds, SECONDARY in sounds
    if level < -1:
        return sounds.replace(PRIMARY, "").replace(SECONDARY, "")
    if level == -1 or (level in (0, -0.5) and strong):
        return sounds.replace(SECONDARY, "").replace(PRIMARY, SECONDARY)
    if not strong and weak and level >= 1:
        return sounds.replace(SECONDARY, PRIMARY)
    if not strong and not weak and level >= 0:
        mark = PRIMARY if level > 1 else SECONDARY
        at = next((i for i, c in enumerate(sounds) if c in VOWELS), None)
        if at is not None:
            return sounds[:at] + mark + sounds[at:]
    return sounds


def tones(syllables: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Tone changes: bu4 before a fourth tone and yi1 by what follows; of neighbouring third tones all but the last rise."""
    out = list(syllables)
    for i, (base, tone) in enumerate(out[:-1]):
        after = out[i + 1][1]
        if (base, tone) == ("bu", 4) and after == 4:
            out[i] = (base, 2)
        elif (base, tone) == ("yi", 1) and after in (1, 2, 3, 4):
            out[i] = (base, 2 if after == 4 else 4)
    third = [t == 3 for _, t in out] + [False]
    return [(b, 2 if third[i] and third[i + 1] else t) for i, (b, t) in enumerate(out)]


def numbered(pinyin: str) -> tuple[str, int]:
    """``nǐ`` as ``("ni", 3)``; without a mark the tone is 5."""
    # Tones of combining accents.
    accents = {"̄": 1, "́": 2, "̌": 3, "̀": 4}
    parts = unicodedata.normalize("NFD", pinyin)
    tone = next((accents[c] for c in parts if c in accents), 5)
    return unicodedata.normalize("NFC", "".join(c for c in parts if c not in accents)).replace("ü", "v"), tone


def single_readings(raw: bytes) -> dict[str, list[str]]:
    """Characters and their readings: code point (4 bytes, little-endian), number of readings, each with its length."""
    out, at = {}, 0
    try:
        while at < len(raw):
            (point,) = struct.unpack_from("<I", raw, at)
            n, at = raw[at + 4], at + 5
            readings = []
            for _ in range(n):
                size = raw[at]
                if at + 1 + size > len(raw):
                    raise IndexError
                readings.append(raw[at + 1 : at + 1 + size].decode())
                at += 1 + size
            out[chr(point)] = readings
    except (struct.error, IndexError):
        raise ValueError("the table of readings is cut off") from None
    return out


def phrase_readings(raw: bytes) -> dict[str, list[str]]:
    """Phrases and their syllables: length (2 bytes, little-endian), text, number of syllables, each with its length."""
    out, at = {}, 0
    try:
        while at < len(raw):
            (size,) = struct.unpack_from("<H", raw, at)
            phrase, at = raw[at + 2 : at + 2 + size].decode(), at + 2 + size
            n, at = raw[at], at + 1
            syllables = []
            for _ in range(n):
                size = raw[at]
                if at + 1 + size > len(raw):
                    raise IndexError
                syllables.append(raw[at + 1 : at + 1 + size].decode())
                at += 1 + size
            out[phrase] = syllables
    except (struct.error, IndexError):
        raise ValueError("the table of phrases is cut off") from None
    return out


def r_coloured(syllables: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``er`` after another syllable colours it (``zher``) and is no syllable of its own; at the beginning and after ``er`` it stays."""
    joins = [k > 0 and base == "er" and syllables[k - 1][0] not in ("er", "") for k, (base, _) in enumerate(syllables)] + [False]
    return [(base + "r" if joins[k + 1] else base, tone) for k, (base, tone) in enumerate(syllables) if not joins[k]]


# Phonetic signs of initials and finals.
INITIALS = {
    "b": "ㄅ", "p": "ㄆ", "m": "ㄇ", "f": "ㄈ", "d": "ㄉ", "t": "ㄊ", "n": "ㄋ", "l": "ㄌ", "g": "ㄍ", "k": "ㄎ", "h": "ㄏ", "j": "ㄐ", "q": "ㄑ", "x": "ㄒ",
    "zh": "ㄓ", "ch": "ㄔ", "sh": "ㄕ", "r": "ㄖ", "z": "ㄗ", "c": "ㄘ", "s": "ㄙ"}
FINALS = {
    "a": "ㄚ", "o": "ㄛ", "e": "ㄜ", "ai": "ㄞ", "ei": "ㄟ", "ao": "ㄠ", "ou": "ㄡ", "an": "ㄢ", "en": "ㄣ", "ang": "ㄤ", "eng": "ㄥ", "er": "ㄦ", "ong": "ㄨㄥ",
    "i": "ㄧ", "ia": "ㄧㄚ", "ie": "ㄧㄝ", "iao": "ㄧㄠ", "iu": "ㄧㄡ", "ian": "ㄧㄢ", "in": "ㄧㄣ", "iang": "ㄧㄤ", "ing": "ㄧㄥ", "iong": "ㄩㄥ",
    "u": "ㄨ", "ua": "ㄨㄚ", "uo": "ㄨㄛ", "uai": "ㄨㄞ", "ui": "ㄨㄟ", "uan": "ㄨㄢ", "un": "ㄨㄣ", "uang": "ㄨㄤ", "ueng": "ㄨㄥ", "v": "ㄩ", "ve": "ㄩㄝ", "van": "ㄩㄢ", "vn": "ㄩㄣ"}


def bopomofo(base: str, tone: int) -> str | None:
    """A numbered syllable in phonetic signs with its tone; r-coloured ones end in ㄦ; None for what isn't a syllable.

    Spellings with y, w, and with u for ü after j, q and x are taken back to their finals; the vowel of ``zhi``, ``si`` and the like isn't written.
    """
    coloured = base.endswith("r") and base != "er"
    plain = base[:-1] if coloured else base
    initial = next((plain[:n] for n in (2, 1) if plain[:n] in INITIALS), "")
    final = plain[len(initial) :]
    if not initial and plain[:1] == "y":
        rest = plain[1:]
        final = "v" + rest[1:] if rest[:1] == "u" else "iu" if rest == "ou" else rest if rest[:1] == "i" else "i" + rest
    elif not initial and plain[:1] == "w":
        final = {"wei": "ui", "wen": "un", "weng": "ueng", "wu": "u"}.get(plain, "u" + plain[1:])
    elif initial in ("j", "q", "x") and final[:1] == "u":
        final = "v" + final[1:]
    if initial in ("zh", "ch", "sh", "r", "z", "c", "s") and final == "i":
        signs = ""
    elif (signs := FINALS.get(final)) is None:
        return None
    return f"{INITIALS.get(initial, '')}{signs}{'ㄦ' if coloured else ''}{tone}"


def read_aloud(text: str, phrases: dict[str, list[str]], singles: dict[str, list[str]]) -> list[tuple[str, int]]:
    """Numbered syllables of a Chinese text by longest phrase, then single character (first reading); other characters are left out.

    Tone changes and r-colouring stay within a stretch of characters that have readings.
    """
    from cadenza.functions.spoken import longest_matches

    stretches: list[list[tuple[str, int]]] = [[]]
    known = {k: "" for k in phrases} | {k: "" for k in singles}
    for part, hit in longest_matches(text, known):
        if hit is None:
            stretches.append([])
        else:
            stretches[-1] += [numbered(p) for p in (phrases.get(part) or singles[part][:1])]
    return [s for stretch in stretches for s in tones(r_coloured(stretch))]
