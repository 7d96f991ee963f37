"""English stems by the suffix rules published by M. F. Porter (Program 14, 1980)."""

from __future__ import annotations

import re

# The suffixes of the published steps and what replaces them.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
          "ous", "ive", "ize")
# Shorter words stay as they are.
SHORTEST = 4

WORD = re.compile(r"[a-z]+")


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace(word: str, rules, least: int) -> str:
    """Apply the rule of the longest suffix, if what is left has at least that measure."""
    table = dict(rules)
    found = _longest(word, table)
    if found is None or _measure(word[:len(word) - len(found)]) < least:
        return word
    return word[:len(word) - len(found)] + table[found]


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    found = _longest(word, ("ed", "ing"))
    left = word[:len(word) - len(found)] if found else ""
    if found is None or "v" not in _shape(left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if _double(left) and left[-1] not in "lsz":
        return left[:-1]
    return left + "e" if _measure(left) == 1 and _short_end(left) else left


def stem(word: str) -> str:
    """The stem of a lower-case English word; short words and other tokens unchanged."""
    if len(word) < SHORTEST or not WORD.fullmatch(word):
        return word
    word = _past(_replace(word, PLURALS, 0))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 1), STEP_3, 1)
    found = _longest(word, STEP_4)
    if found:
        left = word[:len(word) - len(found)]
        if _measure(left) > 1 and (found != "ion" or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short_end(left)):
            word = left
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word) > 1 else word
