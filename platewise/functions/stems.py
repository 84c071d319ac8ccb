"""English stems by suffix stripping (the published Porter2 rules), for words and for columns of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MEMO = 200_000

# The published rules.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = "inning outing canning herring earring proceed exceed succeed".split()
LONG_STARTS = ("gener", "commun", "arsen")
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
AFTER_LI = "cdeghkmnrt"

_VOWELS = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _longest(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: each behind the first consonant that follows a vowel."""
    start = next((len(s) for s in LONG_STARTS if word.startswith(s)), None)
    if start is None:
        found = _REGION.search(word)
        start = found.end() if found else len(word)
    again = _REGION.search(word, start)
    return start, again.end() if again else len(word)


def _plurals(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eedly", "eed"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not _has_vowel(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w[-2:] in DOUBLES:
        return w[:-1]
    return w + "e" if len(w) <= r1 and _SHORT_END.search(w) else w


def stem(word: str) -> str:
    """The stem of a lower-case word; other texts come back as they are."""
    if len(word) < 3 or not word.isascii() or not word.replace("'", "").isalpha():
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    w = _plurals(w)
    if w in FINISHED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for step, rules in ((2, STEP_2), (3, STEP_3)):
        end = _longest(w, (e for e, _ in rules))
        if end is not None and len(w) - len(end) >= r1:
            before = w[-len(end) - 1 : -len(end)]
            blocked = end == "ogi" and before != "l" or step == 2 and end == "li" and before not in AFTER_LI or end == "ative" and len(w) - len(end) < r2
            w = w if blocked else w[: -len(end)] + dict(rules)[end]
    end = _longest(w, STEP_4)
    if end is not None and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_column(words: str | Column) -> Column:
    """Stems of a column of words; each task remembers what it has stemmed."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            if len(known) > MEMO:
                known.clear()
            known.update({w: stem(w) for w in s.dropna().unique() if w not in known})
            yield pd.Series([known.get(w) for w in s], dtype=object)

    return run(F.col(words) if isinstance(words, str) else words)
