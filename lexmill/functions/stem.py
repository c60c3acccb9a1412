"""Stemmers and lemmas. Each is a function of one word and a Pandas UDF that stems every distinct word of a batch once.

Porter (1980) and the English Snowball stemmer follow the published rules; Lancaster follows the published rule format.
Lemmas have no dictionary here: ``lemma`` is a declared approximation by suffix rules and a table of irregular words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiou"


def _is_consonant(word: str, i: int) -> bool:
    c = word[i]
    return c not in VOWELS and not (c == "y" and i > 0 and _is_consonant(word, i - 1))


def _shape(word: str) -> str:
    return "".join("c" if _is_consonant(word, i) else "v" for i in range(len(word)))


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _is_consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Suffix tables of the published Porter algorithm.
PORTER_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
PORTER_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
PORTER_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: -len(old)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (PORTER_2, PORTER_3):
        end = _longest(w, [s for s, _ in table])
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + dict(table)[end]
    end = _longest(w, PORTER_4)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Exceptions and suffix tables of the published English Snowball algorithm.
SNOWBALL_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SNOWBALL_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
SNOWBALL_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SNOWBALL_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
SNOWBALL_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
SNOWBALL_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
_V = "aeiouy"


def _region(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _V and word[i - 1] in _V:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V and w[-1] not in "wxY"


def snowball(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in SNOWBALL_WORDS:
        return SNOWBALL_WORDS[w]
    if w in SNOWBALL_SAME:
        return w
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _V) else c for i, c in enumerate(w))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in SNOWBALL_AFTER_1A:
        return w
    end = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _V for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    end = _longest(w, [*SNOWBALL_2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        stem = w[: -len(end)]
        if end == "ogi":
            w = stem + "og" if stem.endswith("l") else w
        elif end == "li":
            w = stem if stem[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = stem + SNOWBALL_2[end]
    end = _longest(w, [*SNOWBALL_3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + SNOWBALL_3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _longest(w, [*SNOWBALL_4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# The published Paice/Husk rules: reversed ending, * if only for intact words, letters to remove, letters to
# append, and > to go on or . to stop.
LANCASTER = "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.".split()
_RULE = re.compile(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])")
LANCASTER_RULES = [(m[1][::-1], bool(m[2]), int(m[3]), m[4], m[5] == ">") for m in map(_RULE.fullmatch, LANCASTER)]


def _acceptable(stem: str) -> bool:
    if not stem:
        return False
    return len(stem) >= 2 if stem[0] in VOWELS else len(stem) >= 3 and any(c in _V for c in stem)


def lancaster(word: str) -> str:
    w = intact = word.lower()
    going = True
    while going:
        going = False
        for end, only_intact, cut, add, more in LANCASTER_RULES:
            if w.endswith(end) and not (only_intact and w != intact):
                stem = w[: len(w) - cut] + add
                if _acceptable(w[: len(w) - cut]):
                    w, going = stem, more
                    break
    return w


# Irregular forms.
IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "people": "people", "lives": "life", "wives": "wife", "knives": "knife", "leaves": "leaf", "wolves": "wolf", "shelves": "shelf", "halves": "half", "data": "datum", "criteria": "criterion", "analyses": "analysis"}
IRREGULAR_VERBS = {"is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "did": "do", "does": "do", "done": "do", "went": "go", "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "saw": "see", "seen": "see", "got": "get", "gave": "give", "given": "give", "found": "find", "thought": "think", "told": "tell", "left": "leave", "felt": "feel", "brought": "bring", "kept": "keep", "held": "hold", "wrote": "write", "written": "write", "sold": "sell", "bought": "buy", "lost": "lose", "paid": "pay", "met": "meet"}


def lemma(word: str, pos: str = "n") -> str:
    """Approximate lemma of a noun ('n') or verb ('v'): irregular forms, then suffix rules."""
    w = word.lower()
    if pos == "v":
        if w in IRREGULAR_VERBS:
            return IRREGULAR_VERBS[w]
        for end in ("ing", "ed"):
            if w.endswith(end) and len(w) - len(end) >= 3 and _has_vowel(w[: -len(end)]):
                stem = w[: -len(end)]
                if _double(stem) and stem[-1] not in "lsz":
                    return stem[:-1]
                return stem + "e" if _cvc(stem) and _measure(stem) == 1 or stem.endswith(("at", "iz", "bl", "v", "s", "c", "u")) and not stem.endswith("ss") else stem
    elif w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) > 3:
        if w.endswith("ies"):
            return w[:-3] + "y"
        if w.endswith(("ches", "shes", "sses", "xes", "zes")):
            return w[:-2]
        if w.endswith("s") and not w.endswith(("ss", "us", "is")):
            return w[:-1]
    return w


def verb_lemma(word: str) -> str:
    return lemma(word, "v")


def each(values: pd.Series, function: Callable) -> pd.Series:
    """The function of every value; null stays null."""
    return pd.Series([function(v) if v is not None and v == v else None for v in values], dtype=object)


def word_udf(function: Callable[[str], str]):
    """A Pandas UDF over words; null stays null."""

    @F.pandas_udf(StringType())
    def apply(words: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return each(words, lambda w: known.get(w) or known.setdefault(w, function(w)))

    return apply


def text_udf(function: Callable[[str], str]):
    """A Pandas UDF over texts of words parted by spaces; null stays null."""

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        return each(texts, lambda text: " ".join(known.get(w) or known.setdefault(w, function(w)) for w in text.split(" ") if w))

    return apply
