"""English stems by Porter's algorithm (M. F. Porter, "An algorithm for suffix stripping", 1980), and the analysis that
full-text indexes apply: lower case, no accents, stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import TERM, fold

#: The algorithm's suffix tables, (suffix, replacement), tried from the top.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Longer terms stay as they are.
LONGEST = 64
WORD = re.compile(r"[^\W_]+")


def _form(word: str) -> str:
    """The word as c and v: a, e, i, o, u are vowels, and y after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _short_end(word: str) -> bool:
    return len(word) > 2 and _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """As SQLite's porter tokenizer: lengths count bytes, and bytes that are no letters count as consonants."""
    if not word.isascii():
        return _stem(word.encode().decode("latin-1")).encode("latin-1").decode(errors="replace")
    return _stem(word)


def _stem(word: str) -> str:
    if not 3 <= len(word) <= LONGEST:
        return word
    # plurals
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive forms
    cut = None
    if word.endswith("eed") and len(word) > 3:
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _form(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _form(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _form(cut)[-1] == "c" and cut[-1] not in "lsz":
            word = cut[:-1]
        elif _measure(cut) == 1 and _short_end(cut):
            word = cut + "e"
        else:
            word = cut
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=lambda x: -len(x)):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=100_000)
def term(word: str) -> str:
    return stem(fold(word))


def analyzed(text: str | None) -> list[str]:
    return list(map(term, TERM.findall(text or "")))


def plain(word: str, forms: dict[str, str]) -> str:
    """The word in lower case, or what it is a form of."""
    # character by character, as SQL's lower() does it
    low = word.lower() if word.isascii() else word.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()
    return forms.get(low, low)


def plain_words(text: str | None, forms: dict[str, str]) -> list[str]:
    """The words of a text, letters and digits, without stems; the forms listed count as the word that they are given."""
    return [plain(w, forms) for w in WORD.findall(text or "")]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(text: pd.Series) -> pd.Series:
    """Index terms of a text, in order."""
    return text.map(analyzed)
