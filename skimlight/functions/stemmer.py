"""Porter's English suffix stripping (M. F. Porter, 1980)."""

from __future__ import annotations

import re


# The suffixes of steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _measure(s: str) -> int:
    """Number of vowel-consonant sequences."""
    forms = "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))
    return len(re.findall("v+c+", forms))


def _vowel(s: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") for i, c in enumerate(s))


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and s[-1] not in "aeiouy"


def _cvc(s: str) -> bool:
    if len(s) < 3:
        return False
    form = ["v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s)]
    return form[-3:] == ["c", "v", "c"] and s[-1] not in "wxy"


def stem(word: str) -> str:
    """Stem of a lower-case word; other than ASCII letters are left alone."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and _vowel(base):
                w = base
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        suffix = max((x for x in table if w.endswith(x)), key=len, default="")
        if suffix and _measure(w[: -len(suffix)]):
            w = w[: -len(suffix)] + table[suffix]
    suffix = max((x for x in _STEP4 if w.endswith(x)), key=len, default="")
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
