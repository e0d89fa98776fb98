"""Porter's stemmer for English words, with the usual later amendments (short words, irregular forms, -logi, -fulli, -ied)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: ending and what stands in its place, first match counts.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Forms with stems of their own.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: ROUGE leaves words of up to this many letters as they are.
SHORT = 3


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _short_syllable(word: str) -> bool:
    shape = _shape(word)
    return shape == "vc" or shape.endswith("cvc") and word[-1] not in "wxy"


def _without_s(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _without_ed_ing(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    stem = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
    if "v" not in _shape(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1] == stem[-2:-1] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_syllable(stem) else stem


def _replaced(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    for ending, other in rules:
        if w.endswith(ending):
            stem = w[: -len(ending)]
            return stem + other if _measure(stem + "l" if ending == "logi" else stem) > 0 else w
    return w


def _without_suffix(w: str) -> str:
    for ending in STEP_4:
        if w.endswith(ending):
            stem = w[: -len(ending)]
            return stem if _measure(stem) > 1 and (ending != "ion" or stem[-1] in "st") else w
    return w


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    w = _without_ed_ing(_without_s(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = _without_suffix(_replaced(_replaced(w, STEP_2), STEP_3))
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _short_syllable(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stems(words: Column) -> Column:
    """An array of words as stems, those of up to SHORT letters as they are; null stays null. A batch stems each distinct word once."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def stem(w: str | None) -> str | None:
            if w is not None and w not in known:
                known[w] = porter(w) if len(w) > SHORT else w
            return known.get(w)

        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
