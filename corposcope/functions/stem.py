"""The Porter stemmer (Porter 1980), for lists of distinct words."""
from __future__ import annotations

import re

#: Suffix rules of steps 2 to 4, longest match first by construction. Fixed values of the published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
         "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
         "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """'v' and 'c' for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1:] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """Stem of a lower-case ASCII word; words of up to two letters, and others, stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    s = _longest(w, ("sses", "ies", "ss", "s"))
    if s in ("sses", "ies"):
        w = w[:-2]
    elif s == "s":
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = _longest(w, ("ed", "ing"))
        if cut and "v" in _shape(w[:-len(cut)]):
            w = w[:-len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = _longest(w, rules)
        if s and _measure(w[:-len(s)]) > 0:
            w = w[:-len(s)] + rules[s]
    s = _longest(w, STEP4)
    if s and _measure(w[:-len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[:-len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
