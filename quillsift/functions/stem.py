"""English stemmers: the algorithm of Porter (1980) and its revision, as published."""

from __future__ import annotations

import re

V = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in V:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(">")) for x in text.split()), key=lambda x: -len(x[0]))


_STEP2 = _rules("ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble")
_STEP3 = _rules("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>")
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=lambda x: -len(x))


def porter(word: str) -> str:
    """Words of one or two letters and what isn't a word stay as they are, in lower case."""
    w = word.lower()
    if len(w) <= 2 or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, to in rules:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


_WHOLE = dict(x.split(">") for x in "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl".split())
_SAME = set("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
_P2 = _rules("ization>ize ational>ate fulness>ful ousness>ous iveness>ive tional>tion biliti>ble lessli>less entli>ent ation>ate alism>al aliti>al ousli>ous iviti>ive fulli>ful enci>ence anci>ance abli>able izer>ize ator>ate alli>al bli>ble ogi>og li>")
_P3 = _rules("ational>ate tional>tion alize>al icate>ic iciti>ic ative> ical>ic ness> ful>")
_P4 = sorted("ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split(), key=lambda x: -len(x))


def _region(w: str, at: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(w, at)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def porter2(word: str) -> str:
    w = word.lower()
    if len(w) <= 2 or not w.replace("'", "").isalpha():
        return w
    w = w.removeprefix("'")
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _SAME:
        return w
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    w = re.sub(r"'s?'?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end in ("eedly", "eed"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for e, to in _P2:
        if w.endswith(e):
            stem = w[: -len(e)]
            if len(stem) >= r1 and (e != "ogi" or stem.endswith("l")) and (e != "li" or stem[-1:] in tuple("cdeghkmnrt")):
                w = stem + to
            break
    for e, to in _P3:
        if w.endswith(e):
            stem = w[: -len(e)]
            if len(stem) >= r1 and (e != "ative" or len(stem) >= r2):
                w = stem + to
            break
    for e in _P4:
        if w.endswith(e):
            stem = w[: -len(e)]
            if len(stem) >= r2 and (e != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
