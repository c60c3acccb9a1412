"""Tokenisers and text helpers that need Python, as Pandas UDFs, and the native regex tokenisers beside them."""

from __future__ import annotations

import re
import textwrap
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .stem import each

# A word tokeniser in the manner of the Penn Treebank: clitics split off, punctuation alone, abbreviations and decimals whole.
_TREEBANK = re.compile(
    r"""(?:[A-Za-z]\.){2,}          # L.E.
      | \.\.\.                      # ellipsis
      | \w+(?=n't\b)                # do of don't
      | n't\b | '(?:s|m|d|ll|re|ve)\b
      | \d+(?:[.,]\d+)+             # 3.14, 1,000
      | \w+(?:-\w+)*                # words
      | [^\w\s]                     # any other mark
    """,
    re.VERBOSE | re.IGNORECASE,
)


def treebank(text: str) -> list[str]:
    return _TREEBANK.findall(text)


@F.pandas_udf(ArrayType(StringType()))
def treebank_words(texts: pd.Series) -> pd.Series:
    return each(texts, treebank)


@F.pandas_udf(StringType())
def wrap(texts: pd.Series) -> pd.Series:
    """Lines of at most 70 characters, broken at white space."""
    return each(texts, textwrap.fill)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text(page: str) -> str:
    """All text of a page, as an HTML parser reads it (script text included)."""
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(StringType())
def parsed_html(pages: pd.Series) -> pd.Series:
    return each(pages, html_text)


@F.pandas_udf(StringType())
def char_name(chars: pd.Series) -> pd.Series:
    """Unicode name of a character, '' if it has none."""
    return each(chars, lambda c: unicodedata.name(c[0], "") if c else "")


def decode_bytes(encoding: str):
    """A Pandas UDF from binary to text of an encoding that Spark's own decode doesn't take."""

    @F.pandas_udf(StringType())
    def apply(data: pd.Series) -> pd.Series:
        return each(data, lambda b: bytes(b).decode(encoding, "ignore"))

    return apply


# The five tokenisers that are compared.
SPACE_RUN = r"[ \t\n]+"
WORD_RUN = "[A-Za-z0-9_]+"
HYPHENATED = "[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)*"
VERBOSE = r"(?:[A-Z]\.)+|[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)*|\$?[0-9]+(?:\.[0-9]+)?%?|\.\.\.|[\]\[.,;'?():_\"-]"


def token_counts(text: Column) -> dict[str, Column]:
    return {
        "n_split": F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")),
        "n_resplit": F.size(F.split(text, SPACE_RUN)),
        "n_words": F.regexp_count(text, F.lit(WORD_RUN)),
        "n_hyphenated": F.regexp_count(text, F.lit(HYPHENATED)),
        "n_verbose": F.regexp_count(text, F.lit(VERBOSE)),
    }
