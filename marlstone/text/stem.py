"""The English (Porter2) stemmer, from the published algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the algorithm: exceptional words and suffixes.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(w: str, start: int) -> int:
    m = re.search("[aeiouy][^aeiouy]", w[start:])
    return start + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.fullmatch("[aeiouy][^aeiouy]", w) or re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    # y after a vowel or at the start is a consonant.
    w = re.sub("(?<=[aeiouy])y", "Y", "Y" + w[1:] if w.startswith("y") else w)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else _region(w, 0)
    r2 = _region(w, r1)

    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w

    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if suffix.startswith("eed"):
                if len(base) >= r1:
                    w = base + "ee"
            elif re.search("[aeiouy]", base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    for suffix in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r1 and (suffix != "ogi" or base.endswith("l")) and (suffix != "li" or base[-1:] in tuple("cdeghkmnrt")):
                w = base + _STEP2[suffix]
            break

    for suffix in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= (r2 if suffix == "ative" else r1):
                w = base + _STEP3[suffix]
            break

    for suffix in _STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r2 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break

    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
