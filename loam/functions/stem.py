"""Porter's stemmer (1980), as published: each step is a table of endings, what replaces them, and what must hold for the rest."""

from __future__ import annotations

import functools
import re

# The measure m of a stem counts its changes from vowels to consonants; y is a vowel after a consonant.
_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
OVER_0 = re.compile(f"^({_CS})?{_VS}{_CS}")
ONE = re.compile(f"^({_CS})?{_VS}{_CS}({_VS})?$")
OVER_1 = re.compile(f"^({_CS})?{_VS}{_CS}{_VS}{_CS}")
VOWEL = re.compile(f"^({_CS})?{_V}")
SHORT = re.compile(f"^{_CS}{_V}[^aeiouwxy]$")  # consonant, vowel, consonant other than w, x, y

# The published rules.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], "")


def _ending(word: str, rules: dict[str, str]) -> str | None:
    """The longest of the rules' endings that the word has."""
    return max((e for e in rules if word.endswith(e)), key=len, default=None)


def _replaced(word: str, rules: dict[str, str], needs: re.Pattern) -> str:
    e = _ending(word, rules)
    return word[: -len(e)] + rules[e] if e and needs.match(word[: -len(e)]) else word


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """Words of lower-case Latin letters; any other, and those of one or two letters, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word  # a consonant in front
    if e := _ending(w, STEP_1A):
        w = w[: -len(e)] + STEP_1A[e]
    if w.endswith("eed"):
        w = w[:-1] if OVER_0.match(w[:-3]) else w
    elif (e := _ending(w, {"ed": "", "ing": ""})) and VOWEL.match(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"([^aeiouylsz])\1$", w):
            w = w[:-1]
        elif SHORT.match(w):
            w += "e"
    if w.endswith("y") and VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, STEP_2, OVER_0)
    w = _replaced(w, STEP_3, OVER_0)
    if (e := _ending(w, STEP_4)) and OVER_1.match(base := w[: -len(e)] + e[:1] if e in ("sion", "tion") else w[: -len(e)]):
        w = base
    if w.endswith("e") and (OVER_1.match(w[:-1]) or (ONE.match(w[:-1]) and not SHORT.match(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and OVER_1.match(w):
        w = w[:-1]
    return w.lower()
