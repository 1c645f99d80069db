"""Suffix stripping after Porter, "An algorithm for suffix stripping", 1980."""

from __future__ import annotations

from functools import lru_cache

# The suffix tables of steps 2 to 4 of the paper.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant turns."""
    k = _consonants(stem)
    return sum(not a and b for a, b in zip(k, k[1:]))


def _vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    k = _consonants(word)
    return len(word) > 2 and k[-3] and not k[-2] and k[-1] and word[-1] not in "wxy"


def _table(word: str, table: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _table(_table(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word
