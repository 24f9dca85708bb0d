"""English suffix stripping after M. F. Porter, "An algorithm for suffix
stripping", Program 14(3), 1980. Called once per distinct word of a batch."""

import functools
import re

# Suffix -> replacement of steps 2 and 3, suffixes of step 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
         "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
         "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
         "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
         "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
         "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
         "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ORDER2 = sorted(STEP2, key=len, reverse=True)
_ORDER3 = sorted(STEP3, key=len, reverse=True)
_STEP4 = sorted(STEP4, key=len, reverse=True)


def _shape(word):
    """The word with each letter replaced by c(onsonant) or v(owel)."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word):
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word):
    return "v" in _shape(word)


def _doubled(word):
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word):
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word, table, order):
    for suffix in order:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            return head + table[suffix] if _measure(head) > 0 else word
    return word


@functools.lru_cache(1 << 16)
def stem(word):
    """Stem of a lower-case word. Letters outside ASCII count as consonants,
    one for each of their bytes."""
    if word.isascii():
        return _stem(word)
    return _stem(word.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")


#: Fixed value: the longest word, in bytes, that the public tokenizer stems.
LONGEST = 64


def _stem(word):
    if not 2 < len(word) <= LONGEST:
        return word
    if word.endswith(("sses", "ies")) and word not in ("sses", "ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            head = word[: -len(suffix)]
            if word.endswith(suffix) and _has_vowel(head):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break

    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP2, _ORDER2)
    word = _replace(word, STEP3, _ORDER3)

    for suffix in _STEP4:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                word = head
            break

    if word.endswith("e"):
        head = word[:-1]
        size = _measure(head)
        if size > 1 or (size == 1 and not _short_end(head)):
            word = head
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
