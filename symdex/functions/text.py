"""Tokens of the full-text index: words without case and diacritics, stemmed by Porter's algorithm of 1980."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a query; each may hold several tokens, which are then a phrase.
QUERY_WORD = re.compile(r"\w+")
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
WORD = re.compile(r"[^\W_]+")
FIRST_MARK = "\u0300"
#: Ends of lines other than a line feed.
RARE_ENDS = r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
SPLIT_LINES = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def plain_tokens(text: Column) -> Column:
    """Lower-case tokens with JVM functions alone: no diacritics are taken off and nothing is stemmed."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; a last line without a character isn't one."""
    text = F.coalesce(text, F.lit(""))
    parts = F.when(F.regexp_like(text, F.lit(RARE_ENDS)), F.split(text, SPLIT_LINES, -1)).otherwise(F.split(text, "\n", -1))  # a single character is split at without a pattern
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fold(text: str) -> str:
    """Lower case, without marks."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFD", low)
        for mark in [c for c in set(low) if c >= FIRST_MARK and unicodedata.category(c) == "Mn"]:
            low = low.replace(mark, "")
    return low


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    """The tokens of a text, in order."""
    words = WORD.findall(fold(text or ""))
    return list(map(stem, words)) if stemmed else words


def phrases(query: str, stemmed: bool = True) -> list[list[str]]:
    """The phrases of a query in order, repeats kept; a word without a token is none."""
    found = [tokens(word, stemmed) for word in QUERY_WORD.findall(query)]
    return [p for p in found if p]


def plain_phrases(query: str) -> list[list[str]]:
    """As `phrases`, for an index of plain tokens."""
    return [p for p in (re.findall(r"[^\W_]+", w.lower()) for w in QUERY_WORD.findall(query)) if p]


# ---- Porter's stemmer ---------------------------------------------------------------------

#: Suffixes of steps 2, 3 and 4 with what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "logi": "log", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
STEPS = tuple((table, tuple(table)) for table in (STEP2, STEP3))
#: Letters without y as vowels and consonants.
LETTERS = {i: "v" if chr(i) in "aeiou" else "c" for i in range(128)}
ENDINGS = ("ed", "ing")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    if "y" not in word:
        return word.translate(LETTERS)
    out = []
    for i, c in enumerate(word):
        out.append("v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    if not word.endswith(suffixes):  # most words
        return None
    return max((s for s in suffixes if word.endswith(s)), key=len)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; very short, very long and non-ASCII words stay."""
    if len(word) < 3 or len(word) > 64 or not word.isascii():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        ending = _longest(w, ENDINGS)
        if ending and "v" in _shape(w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, endings in STEPS:
        ending = _longest(w, endings)
        if ending and _measure(w[: -len(ending)]) > 0:
            w = w[: -len(ending)] + table[ending]
    ending = _longest(w, STEP4)
    if ending and _measure(w[: -len(ending)]) > 1 and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
