"""Language labels: codes and English names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages by two-letter code, with their three-letter codes and English names (ISO 639).
LANGUAGES = {
    "ar": ("ara", "arabic"), "de": ("deu", "ger", "german"), "el": ("ell", "gre", "greek"), "en": ("eng", "english"), "es": ("spa", "spanish"), "fr": ("fra", "fre", "french"), "hi": ("hin", "hindi"),
    "it": ("ita", "italian"), "ja": ("jpn", "japanese"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "th": ("tha", "thai"), "zh": ("zho", "chi", "cmn", "chinese"),
}
CODES = sorted(LANGUAGES)
UNKNOWN = ("", "n/a", "na", "und", "unknown", "none", "null", "nan", "??", "?", "-", "xx", "zxx", "mul", "mis", "undefined", "undetermined", "unk")


def label_code(column: Column) -> Column:
    """Two-letter code that a label names, in any spelling, with or without a region; null if it names none of ours."""
    word = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]+)", 1)
    out = None
    for code, names in LANGUAGES.items():
        hit = word.isin(code, *names)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out
