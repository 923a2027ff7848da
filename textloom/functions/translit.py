"""Devanagari to Latin (IAST) and to eight other Brahmic scripts, as Arrow-batched functions.

The code points of those scripts lie at fixed offsets from Devanagari's; what differs is listed. Two
signs (letter and nukta) go before one, and a consonant looks at the sign after it, so regular
expressions over whole texts do the work, not tables of characters alone.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUKTA, VIRAMA = "़", "्"

# Devanagari signs and their Latin letters.
_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ṅ", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ñ", "ट": "ṭ", "ठ": "ṭh", "ड": "ḍ", "ढ": "ḍh", "ण": "ṇ",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "ś", "ष": "ṣ", "स": "s", "ह": "h", "ळ": "ḻ", "ऱ": "ṟ", "ऩ": "ṉ",
}
_NUKTAS = {"क" + NUKTA: "q", "ख" + NUKTA: "x", "ग" + NUKTA: "ġ", "ज" + NUKTA: "z", "ड" + NUKTA: "ṛ", "ढ" + NUKTA: "ṛh", "फ" + NUKTA: "f", "य" + NUKTA: "ẏ"}
_VOWELS = {
    "अ": "a", "आ": "ā", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "ū", "ऋ": "ṛ", "ॠ": "ṝ", "ऌ": "ḷ", "ॡ": "ḹ", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऎ": "e", "ऒ": "o",
}
_MATRAS = {"ा": "ā", "ि": "i", "ी": "ī", "ु": "u", "ू": "ū", "ृ": "ṛ", "ॄ": "ṝ", "ॢ": "ḷ", "ॣ": "ḹ", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॆ": "e", "ॊ": "o"}
_OTHERS = {
    "ं": "ṁ", "ँ": "m̐", "ः": "ḥ", "ॐ": "oṁ", "ऽ": "'", "।": "|", "॥": "||", VIRAMA: "",
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}

_SYLLABLE = re.compile(f"([{''.join(c[0] for c in _NUKTAS)}]{NUKTA}|[{''.join(_CONSONANTS)}]{NUKTA}?)([{VIRAMA}{''.join(_MATRAS)}])?|(.)", re.S)


def to_iast(text: str) -> str:
    """Consonants carry an inherent a unless a vowel sign or virama follows."""

    def one(m: re.Match) -> str:
        consonant, sign, other = m.groups()
        if consonant is None:
            return _VOWELS.get(other) or _MATRAS.get(other) or _OTHERS.get(other, other)
        head = _NUKTAS.get(consonant)
        if head is None:
            head = _CONSONANTS[consonant[0]]
            if len(consonant) == 2:  # a nukta without meaning here stays, after the vowel
                return head + "a" + NUKTA + (_MATRAS.get(sign, "") if sign else "")
        return head + ("a" if sign is None else _MATRAS.get(sign, ""))

    return _SYLLABLE.sub(one, text)


# First code point of each script's block.
BLOCKS = {"Mlym": 0x0D00, "Knda": 0x0C80, "Telu": 0x0C00, "Beng": 0x0980, "Gujr": 0x0A80, "Guru": 0x0A00, "Orya": 0x0B00}
#: Ranges of Devanagari that keep their offset in every block.
_RANGES = ((0x0901, 0x0939), (0x093C, 0x094D), (0x0950, 0x0950), (0x0958, 0x0963), (0x0966, 0x096F))
LOSSY = frozenset({"Taml", "Guru"})

# Signs that a script does not have at the offset. Letters with nukta lose it where none is listed, and ऩ is न.
_OWN = {
    "Mlym": {"ऍ": "എ", "ऑ": "ഒ", "ॅ": "െ", "ॉ": "ൊ", "ॐ": "ഓം"},
    "Knda": {"ऍ": "ಎ", "ऑ": "ಒ", "ॅ": "ೆ", "ॉ": "ೊ", "ॐ": "ಓಂ"},
    "Telu": {"ऍ": "ఎ", "ऑ": "ఒ", "ॅ": "ె", "ॉ": "ొ", "ॐ": "ఓం"},
    "Beng": {"ऍ": "এ", "ऎ": "এ", "ऑ": "ও", "ऒ": "ও", "ऱ": "র", "ळ": "ল", "व": "ব", "ॅ": "ে", "ॆ": "ে", "ॉ": "ো", "ॊ": "ো", "ॐ": "ওঁ", "ड़": "ড়", "ढ़": "ঢ়", "य़": "য়"},
    "Gujr": {"ऎ": "એ", "ऒ": "ઓ", "ऱ": "ર", "ॆ": "ે", "ॊ": "ો"},
    "Guru": {"ऋ": "ਰਿ", "ऌ": "ਲਿ", "ऎ": "ਏ", "ऒ": "ਓ", "ऱ": "ਰ", "ळ": "ਲ਼", "ष": "ਸ਼", "ऽ": "", "ृ": "੍ਰਿ", "ॄ": "੍ਰੀ", "ॅ": "ੇ", "ॆ": "ੇ", "ॉ": "ੋ", "ॊ": "ੋ", "ॐ": "ੴ", "ॠ": "ਰੀ", "ॡ": "ਲੀ", "ॢ": "੍ਲਿ", "ॣ": "੍ਲੀ", "क़": "ਕ਼", "ख़": "ਖ਼", "ग़": "ਗ਼", "ज़": "ਜ਼", "ड़": "ੜ", "फ़": "ਫ਼", "ं": "ੰ"},
    "Orya": {"ऎ": "ଏ", "ऒ": "ଓ", "ऱ": "ର", "व": "ବ", "ॅ": "େ", "ॆ": "େ", "ॉ": "ୋ", "ॊ": "ୋ", "ॐ": "ଓଁ", "ड़": "ଡ଼", "ढ़": "ଢ଼", "य़": "ୟ"},
}
# Tamil has fewer stops; nearest letters, Grantha where there is one.
_TAMIL = {
    "क": "க", "ख": "க", "ग": "க", "घ": "க", "ङ": "ங", "च": "ச", "छ": "ச", "ज": "ஜ", "झ": "ஜ", "ञ": "ஞ", "ट": "ட", "ठ": "ட", "ड": "ட", "ढ": "ட", "ण": "ண",
    "त": "த", "थ": "த", "द": "த", "ध": "த", "न": "ந", "प": "ப", "फ": "ப", "ब": "ப", "भ": "ப", "म": "ம", "य": "ய", "र": "ர", "ल": "ல", "व": "வ",
    "श": "ஶ", "ष": "ஷ", "स": "ஸ", "ह": "ஹ", "ळ": "ள", "ऱ": "ற",
    "अ": "அ", "आ": "ஆ", "इ": "இ", "ई": "ஈ", "उ": "உ", "ऊ": "ஊ", "ऋ": "ரு", "ॠ": "ரூ", "ऌ": "லு", "ॡ": "லூ", "ए": "ஏ", "ऐ": "ஐ", "ओ": "ஓ", "औ": "ஔ", "ऎ": "எ", "ऒ": "ஒ",
    "ा": "ா", "ि": "ி", "ी": "ீ", "ु": "ு", "ू": "ூ", "ृ": "்ரு", "ॄ": "்ரூ", "े": "ே", "ै": "ை", "ो": "ோ", "ौ": "ௌ", "ॆ": "ெ", "ॊ": "ொ", VIRAMA: "்",
    "ं": "ம்", "ँ": "ம்", "ः": "ஃ", "ॐ": "ௐ", "ऽ": "",
    "०": "௦", "१": "௧", "२": "௨", "३": "௩", "४": "௪", "५": "௫", "६": "௬", "७": "௭", "८": "௮", "९": "௯",
}


def _table(script: str) -> dict[str, str]:
    if script == "Taml":
        return _TAMIL
    shift = BLOCKS[script] - 0x0900
    out = {chr(c): chr(c + shift) for lo, hi in _RANGES for c in range(lo, hi + 1)}
    return out | {c: out[c[0]] for c in _NUKTAS} | {"ऩ": out["न"]} | _OWN[script]


_TABLES = {s: _table(s) for s in (*BLOCKS, "Taml")}
_PATTERNS = {s: re.compile("|".join(map(re.escape, sorted(t, key=len, reverse=True)))) for s, t in _TABLES.items()}

# Malayalam letters with a form of their own at a word's end, and r before a consonant.
_CHILLU = {"ന്": "ൻ", "ര്": "ർ", "ല്": "ൽ", "ള്": "ൾ", "ണ്": "ൺ"}
_CHILLU_R = re.compile("ര്(?=[ക-ഺ])")
_CHILLU_END = re.compile("(" + "|".join(_CHILLU) + r")(?=$|[\s।॥,;.!?)\]])")


def to_script(text: str, script: str) -> str:
    """script: an ISO 15924 code; Deva leaves the text, Latn is IAST, LOSSY ones lose distinctions."""
    if script == "Deva":
        return text
    if script == "Latn":
        return to_iast(text)
    table = _TABLES[script]
    out = _PATTERNS[script].sub(lambda m: table[m[0]], text)
    if script == "Mlym":
        out = _CHILLU_END.sub(lambda m: _CHILLU[m[1]], _CHILLU_R.sub("ർ", out))
    return out


def transliterate(col: Column | str, script: str) -> Column:
    """Column form, in Arrow batches; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else to_script(t, script))

    return F.pandas_udf(run, "string")(col)
