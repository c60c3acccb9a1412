"""Pieces of DuckDB SQL that mirror the text kernels."""

from __future__ import annotations

from lexmill.functions import text as T


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = f"({quoted(T.stopwords())})"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{T.WORD}')"


def index_words(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: t NOT IN {STOP})"


def normalise(x: str) -> str:
    leaks = T.LEAKS.replace("'", "''")
    inner = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{leaks}', ' ', 'g'), '{T.URL}', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({inner}, '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return f"array_to_string(list_filter(string_split({normalise(x)}, ' '), lambda t: length(t) >= 2 AND t NOT IN {STOP}), ' ')"


def sentences(x: str) -> str:
    pieces = rf"string_split(regexp_replace(replace({x}, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda s: trim(s)), lambda s: length(s) > 20)"


def overlap_words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{3,}}'))"
