"""English suffix stripping (M. F. Porter, 1980), and the stop words that an English index leaves out."""

from __future__ import annotations

import re
from functools import lru_cache

# Common English function words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having "
    "he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so "
    "some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours "
    "yourself yourselves"
).split()

# The endings of steps 2, 3 and 4 with what stands for them.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_LONGEST = lambda endings: sorted(endings, key=len, reverse=True)


def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case ASCII word; words of up to two letters and those with digits stay."""
    if len(word) < 3 or not word.isalpha() or not word.isascii():
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word.removesuffix(end) + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word.removesuffix(end)):
                word = word.removesuffix(end)
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP_2, STEP_3):
        for end in _LONGEST(step):
            if word.endswith(end):
                if _measure(word.removesuffix(end)) > 0:
                    word = word.removesuffix(end) + step[end]
                break
    for end in _LONGEST(STEP_4):
        if word.endswith(end):
            rest = word.removesuffix(end)
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
