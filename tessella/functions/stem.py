"""Words as a search index holds them: accents folded, English endings taken off (Porter's published rules)."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import tokens

# The published rules, (ending, what replaces it), in the order in which endings are tried.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Words of fewer or more bytes are left as they are.
SHORTEST, LONGEST = 3, 64
#: Distinct words that a worker remembers.
REMEMBERED = 1 << 17

MARKS = r"[̀-ͯ]"


@cache
def letters() -> tuple[str, str]:
    """Letters whose canonical decomposition starts with a Latin letter of ASCII, and these letters, lower-cased."""
    known = set(string.ascii_letters)
    pairs = [(c, d[0].lower()) for c in map(chr, range(128, sys.maxunicode + 1)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in known]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def folded(text: Column) -> Column:
    """Text in lower case, Latin letters without their accents, combining marks left out; null for null."""
    return F.lower(F.translate(F.regexp_replace(text, MARKS, ""), *letters()))


def fold(text: str) -> str:
    """folded() of one string."""
    return re.sub(MARKS, "", text).translate(str.maketrans(*letters())).lower()


def _shape(word: str) -> str:
    """v for vowels, c for each byte of the others; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c" * len(c.encode())
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The word with the first ending that it has replaced, if the stem before it has a measure."""
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(ending) and len(word) > len(ending):
            stem = word[: -len(ending)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _past(word: str) -> str:
    """Without -eed, -ed and -ing."""
    if word.endswith("eed") and len(word) > 3:
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        stem = word[: -len(ending)]
        if word.endswith(ending) and "v" in _shape(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")) and len(stem) > 2:
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _shape(stem[-1]) == "c" and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


@lru_cache(REMEMBERED)
def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    if word.endswith("sses") and len(word) > 4 or word.endswith("ies") and len(word) > 3:
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for ending in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(ending) and len(word) > len(ending):
            stem = word[: -len(ending)]
            if _measure(stem) > 1 and (ending != "ion" or stem[-1] in "st"):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of an array of lower-case words, in order; null for null."""
    return words.map(lambda ws: None if ws is None else [porter(w) for w in ws])


def search_tokens(text: Column) -> Column:
    """The terms of a text: stems of its folded tokens, in order; null for null."""
    return stems(tokens(folded(text)))


def search_terms(query: str) -> list[str]:
    """search_tokens() of one string."""
    return [porter(w) for w in re.findall(r"[^\W_]+", fold(query))]
