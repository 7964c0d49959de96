"""Porter's stemming algorithm (M. F. Porter, 1980), table-driven, and a vectorized UDF.

``revised`` follows the author's later changes: words of up to two letters are
left alone, step 2 has BLI -> BLE in place of ABLI -> ABLE, and LOGI -> LOG.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes and replacements of steps 2, 3 and 4 as published.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VC = re.compile("v+c+")


def _shape(w: str) -> str:
    """Each letter as v(owel) or c(onsonant); y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(_VC.findall(_shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, table) -> str | None:
    return max((s for s in table if w.endswith(s)), key=len, default=None)


def stem(w: str, revised: bool = True) -> str:
    if revised and len(w) <= 2:
        return w
    # plurals and participles
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if cut is not None and "v" in _shape(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    # double suffixes, then -ic-, -full, -ness
    step2 = {**{k: v for k, v in STEP2.items() if k != "abli"}, "bli": "ble", "logi": "log"} if revised else STEP2
    for table in (step2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    # final -e and -ll
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_known: dict[str, str] = {}


def _cached(w: str) -> str:
    s = _known.get(w)
    if s is None:
        if len(_known) > 1_000_000:
            _known.clear()
        s = _known[w] = stem(w)
    return s


def stems(tokens: Column) -> Column:
    """The stems of an array of lower-case tokens; each process stems a word once."""

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda a: None if a is None else [_cached(w) for w in a])

    return run(tokens)
