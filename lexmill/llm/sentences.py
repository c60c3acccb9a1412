"""Problem 2: sentence units of any language, by a finite transducer over boundary events.

A text's events are its quotation marks, stops, blank lines, Thai spaces and the text's end. A stop's symbol is made of
four classes: the word on its left (title, initial, number, word before numbers, ...), the stop, what follows it (capital,
small letter, digit, word that starts or goes on with a sentence, ...) and the text's case. The boundary rules are rows
over these classes; ``compiled`` turns them into the transducer's table, in which a symbol emits a boundary or not, and
only outside quotations, which are the states. Events of all texts of a batch form one sequence: it is cut into chunks,
each chunk's transition function (state -> state) is composed for all chunks side by side, a prefix scan composes the
chunk functions, and each chunk then runs from its known first state. A text of any length is therefore processed in
chunks like many short ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows

UNITS = "tbl string, row_key long, end_pos int"

# --- Fixed values: abbreviations, by what may follow them --------------------------------------------------------------
# never at a sentence's end
NEVER = frozenset(
    "dr dra mr mrs ms messrs prof sen rep gov sgt col capt lt cmdr adm maj rev hon pres sr sra srta ste mt dott sig sigg avv ing hr fr frl m mme mlle mgr jr vs cf approx i.e e.g ie eg viz "
    "z d h u a s o p ex ej ca bzw evtl ggf inkl av c.-à-d c.à.d cioè núm num nº nr tel ee т т.е напр им ул г-н г-жа проф акад см κ κα κος δρ π.χ πχ εκατ δισ αρ σ.σ د أ م डॉ श्री प्रो सं ver".split()
)
# at the end only before a word that starts sentences
MAYBE = frozenset("st gen ed eds dept univ assn bros".split())
# not before a number
BEFORE_NUMBER = frozenset("no nos n fig figs sec secs eq eqs ch chap vol pp pg art tab abs kap núm nr jan feb mar apr jun jul aug sep sept oct nov dec ene abr ago dic janv févr avr juil déc set out dez gen mag giu lug ott янв февр апр авг сент окт нояб дек № арт".split())
# at the end before what can start a sentence, else inside
EITHER = frozenset("etc inc ltd co corp plc llc jr sr ec ecc d.c usw uu j.-c j.c др пр т.п т.д в вв руб коп b.c a.d ff ibid".split())
TIMES = frozenset("al am pm a.m p.m".split())
YEARS, MONEY = frozenset("г гг".split()), frozenset("млн млрд тыс".split())
# "no." is a word and no number sign after these
SAYING = frozenset("said says say saying answered answers answer replied replies is was means meant".split())
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert".split())
# what goes on after a time or a name in text without case
GOING_ON = frozenset("on in at and or to of for by with from until till before after but as than then".split())
STARTERS = frozenset("the a an it in on at for this that these those we they he she i you there when while if but and no as his her our their what why how who is are was were after before".split())
OPENING, CLOSING = "“«„‘‹「『【（〈《〔([¿¡", "”»’›」』】）〉》〕)]"
# ------------------------------------------------------------------------------------------------------------------------

INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_NL = r"(?:\r\n|[\n\r\x0b\x0c\x85 ])"
EVENT = re.compile(
    rf"(?P<blank>{_NL}(?:[^\S\n\r\x0b\x0c\x85  ]*{_NL})+| )"
    r"|(?P<wide>[。！？｡]+)|(?P<stop>[.!?…؟।॥۔;;‽]+)|(?P<quote>[\"“”„«»「」『』‟])"
    r"|(?P<thai>(?<=[฀-๿])[  \t]+)"
)
SPACE = re.compile(r"\s*")
CLOSERS = re.compile(r"(?:[\"'”’»›」』】）〉》〕)\]]|[    ](?=[»›])|“(?=\s|$|[,;:.]))*")
SKIP = re.compile(r"[\s\"'“”«»„‘’‹›「」『』【】（）()\[\]<>*_—–\-•·#/|¿¡]*")
WORD = re.compile(r"[^\s\"“”«»„‘’()\[\]「」¿¡]+$")
NEXT = re.compile(r"\S+")
LETTER_BEFORE = re.compile(r"(?:^|[^\w])\w\.\s*$")

# classes of a stop's symbol
LEFTS = PLAIN, TITLE, MAYBE_END, INITIAL, LETTER, NUMBERED, EITHER_WAY, TIME, YEAR, YEAR_AFTER_NUMBER, AMOUNT, DOTTED, ORDINAL, LIST_NUMBER = range(14)
STOPS = DOT, ELLIPSIS, STRONG = range(3)
RIGHTS = NOTHING, GLUED, GLUED_CAPITAL, DIGIT, STARTER, STARTER_OR_JOIN, JOIN, CAPITAL, MONTH, CASELESS, SOFT, SOFT_JOIN, SMALL = range(13)
MODES = CASED, ALL_SMALL, ALL_CAPITALS = range(3)
STARTS = {DIGIT, STARTER, STARTER_OR_JOIN, JOIN, CAPITAL, MONTH, CASELESS, SOFT, SOFT_JOIN}
BY_CASE, CAPITALS = STARTS - {SOFT, SOFT_JOIN}, {STARTER, STARTER_OR_JOIN, JOIN, CAPITAL, MONTH}
START_WORDS, JOINS, UNCASED = {STARTER, STARTER_OR_JOIN}, {STARTER_OR_JOIN, JOIN, SOFT_JOIN}, {ALL_SMALL, ALL_CAPITALS}
ANY = None
# the first row that fits decides: left, stop, right, case of the text, whether a sentence may end
RULES = [
    (ANY, ANY, {NOTHING}, ANY, True),
    (ANY, ANY, {GLUED}, ANY, False),
    ({TITLE, MAYBE_END}, ANY, {GLUED_CAPITAL}, ANY, False),
    (ANY, ANY, {GLUED_CAPITAL}, ANY, True),
    # an ellipsis in running capitals or small letters goes on before a joining word
    (ANY, {ELLIPSIS}, JOINS, UNCASED, False),
    (ANY, {ELLIPSIS, STRONG}, STARTS, ANY, True),
    (ANY, {ELLIPSIS, STRONG}, ANY, ANY, False),
    ({TITLE, LETTER}, ANY, ANY, ANY, False),
    ({MAYBE_END, INITIAL, DOTTED}, ANY, START_WORDS, {CASED, ALL_SMALL}, True),
    ({MAYBE_END, INITIAL, DOTTED}, ANY, ANY, ANY, False),
    ({NUMBERED}, ANY, {DIGIT}, ANY, False),
    ({YEAR_AFTER_NUMBER}, ANY, STARTS, ANY, True),
    ({YEAR}, ANY, {DIGIT}, ANY, True),
    ({AMOUNT}, ANY, CAPITALS, ANY, True),
    ({YEAR_AFTER_NUMBER, YEAR, AMOUNT}, ANY, ANY, ANY, False),
    ({TIME}, ANY, JOINS, UNCASED, False),
    ({TIME, EITHER_WAY}, ANY, BY_CASE, ANY, True),
    ({TIME, EITHER_WAY}, ANY, {SOFT, SOFT_JOIN}, {ALL_SMALL}, True),
    ({TIME, EITHER_WAY}, ANY, ANY, ANY, False),
    ({LIST_NUMBER}, ANY, ANY, ANY, False),
    ({ORDINAL}, ANY, {MONTH}, ANY, False),
    (ANY, ANY, STARTS, ANY, True),
    (ANY, ANY, ANY, ANY, False),
]

DOC, BLANK, END, OPEN, CLOSE, LOW, HIGH_OR_CLOSE, STRAIGHT_OPEN, STRAIGHT_CLOSE, STRAIGHT = range(10)
SHAPE = (len(LEFTS), len(STOPS), len(RIGHTS), len(MODES))
FIRST_STOP = 10
# states: 0 outside, 1 and 2 in one or two quotations, 3 in straight quotes, 4 in straight quotes within one, 5 in low-opened
STATES = 6
QUOTE_STATE = [
    [0] * 6,  # DOC
    [0] * 6,  # BLANK
    [0, 1, 2, 3, 4, 5],  # END
    [1, 2, 2, 3, 4, 5],  # OPEN
    [0, 0, 1, 3, 4, 0],  # CLOSE
    [5, 2, 2, 3, 4, 5],  # LOW „
    [1, 2, 2, 3, 4, 0],  # “ closes a low-opened quotation and opens else
    [3, 4, 2, 3, 4, 5],  # " before a word
    [0, 1, 2, 0, 1, 5],  # " after a word
    [3, 4, 2, 0, 1, 5],  # " between
]


def compiled(rules: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The transducer's tables: next state and whether a boundary is emitted, by symbol and state. END always may end, a
    stop's symbol as its classes' rule says."""
    ends = np.zeros(SHAPE, bool)
    for *wanted, end in reversed(rules):
        ends[np.ix_(*(range(n) if w is ANY else sorted(w) for w, n in zip(wanted, SHAPE)))] = end
    follow = np.vstack([QUOTE_STATE, np.tile(QUOTE_STATE[END], (ends.size, 1))]).astype(np.int8)
    emits = np.zeros(follow.shape, bool)
    emits[[DOC, BLANK]] = True
    emits[END, 0] = True
    emits[FIRST_STOP:, 0] = ends.ravel()
    return follow, emits


NEXT_STATE, EMITS = compiled(RULES)


def stop_symbol(left: int, stop: int, right: int, mode: int) -> int:
    return FIRST_STOP + ((left * len(STOPS) + stop) * len(RIGHTS) + right) * len(MODES) + mode


def run_transducer(symbols: np.ndarray) -> np.ndarray:
    """Which events emit a boundary, the state before the first being 0."""
    n = len(symbols)
    if not n:
        return np.empty(0, bool)
    width = max(1, int(np.sqrt(n)))
    chunks = -(-n // width)
    padded = np.full(chunks * width, END, np.int64)
    padded[:n] = symbols
    grid = padded.reshape(chunks, width)
    # each chunk as a function of its first state, all chunks at once
    whole = np.tile(np.arange(STATES, dtype=np.int8), (chunks, 1))
    for k in range(width):
        whole = NEXT_STATE[grid[:, k : k + 1], whole]
    # inclusive prefix scan by doubling: after it, row i is the composition of the chunks 0..i
    step = 1
    while step < chunks:
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.r_[np.int8(0), whole[:-1, 0]]
    out = np.empty((chunks, width), bool)
    for k in range(width):
        out[:, k] = EMITS[grid[:, k], state]
        state = NEXT_STATE[grid[:, k], state]
    return out.ravel()[:n]


_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
BEYOND = re.compile(r"[^\x00-\x7f]+")


def _caseless(text: str) -> int:
    """ALL_SMALL for a text all but without capitals, ALL_CAPITALS for one of capitals, else CASED (also where the script has
    no case)."""
    raw = text.encode("utf-8", "replace")
    up = len(raw) - len(raw.translate(None, _CAPITALS))
    low = len(raw) - len(raw.translate(None, _SMALL))
    if len(raw) > len(text):
        beyond = "".join(BEYOND.findall(text))
        up, low = up + sum(map(str.isupper, beyond)), low + sum(map(str.islower, beyond))
    if up + low < 20:
        return CASED
    return ALL_SMALL if up < 0.004 * low else ALL_CAPITALS if low < 0.1 * up else CASED


def _first_in_unit(text: str, at: int) -> bool:
    while at > 0 and text[at - 1] == " ":
        at -= 1
    return at == 0 or text[at - 1] == "\n"


# a word's class, the later lists first
LEFT_OF = dict.fromkeys(EITHER, EITHER_WAY) | dict.fromkeys(TIMES, TIME) | dict.fromkeys(YEARS, YEAR) | dict.fromkeys(MONEY, AMOUNT) | dict.fromkeys(BEFORE_NUMBER, NUMBERED) | dict.fromkeys(MAYBE, MAYBE_END) | dict.fromkeys(NEVER, TITLE)


def _left(text: str, start: int, close: int) -> int:
    """The class of the word before a single stop."""
    before = WORD.search(text, max(0, start - 24), start)
    if not before:
        return PLAIN
    word, at = before.group(), before.start()
    if len(word) == 1 and word.isalpha():
        # a letter at a unit's start, or after another with its stop, is no end of a sentence
        lone = word.isupper() and not _first_in_unit(text, at) and not LETTER_BEFORE.search(text, max(0, at - 6), at)
        if lone and text[close - 1] not in CLOSING:
            return INITIAL
        return LETTER if text[close - 1] not in CLOSING or word.lower() in NEVER else PLAIN
    low = word.lower().lstrip("-–—/")
    found = LEFT_OF.get(low)
    if found is None:
        last = low.rpartition(".")[2]
        if len(last) > 1 and (last in NEVER or last in MAYBE):  # after a lost space
            return TITLE
        found = EITHER_WAY if low.rpartition("-")[2] in EITHER else TIME if low.rpartition("-")[2] in TIMES else None
    if found == YEAR:
        return YEAR_AFTER_NUMBER if text[max(0, at - 6) : at].rstrip()[-1:].isdigit() else YEAR
    if found == NUMBERED and word == "no":
        said = WORD.search(text[max(0, at - 24) : at].rstrip())
        return PLAIN if said and said.group().lower() in SAYING else NUMBERED
    if found is not None:
        return found
    parts = word.split(".")
    if len(parts) > 1 and all(len(p) == 1 and p.isalpha() for p in parts):  # B.V., J.R., U.S.
        return DOTTED
    if word.isdigit() and len(word) <= 2:
        return LIST_NUMBER if _first_in_unit(text, at) else ORDINAL
    return PLAIN


def _right(text: str, start: int, end: int, close: int, mode: int) -> int:
    """The class of what follows the stop run text[start:end] and its closing marks."""
    after = SPACE.match(text, close).end()
    if after == len(text):
        return NOTHING
    if after == close:
        # a lost space: a small word, the stop, a capitalised word
        glued = close == end and end + 1 < len(text) and text[end].isupper() and not text[end + 1].isupper() and text[max(0, start - 2) : start].islower()
        word = WORD.search(text, max(0, start - 24), start) if glued else None
        return GLUED_CAPITAL if word and word.group().isalpha() else GLUED
    first = SKIP.match(text, after).end()
    if first == len(text):
        return NOTHING
    c = text[first]
    following = NEXT.match(text, first)
    next_word = following.group() if following else ""
    bare = next_word.strip(".,;:!?…\"'”’»)").lower()
    join = bare in GOING_ON
    if not c.islower() or (len(next_word) > 1 and (next_word[1].isupper() or (c == "v" and next_word[1].isdigit()))):
        if c.isdigit():
            return DIGIT
        if not c.isupper():
            return CASELESS
        if bare in STARTERS and not (len(bare) == 1 and next_word[1:2] == "."):
            return STARTER_OR_JOIN if join else STARTER
        return JOIN if join else MONTH if bare in GERMAN_MONTHS else CAPITAL
    if close == end:
        # a small letter starts a sentence in a text, or a stretch, without capitals
        word = WORD.search(text, max(0, start - 24), start)
        w = word.group() if word else ""
        plain = (len(w) > 1 and w.isalpha()) or (len(w) > 2 and w.isdigit())
        if not join or (text[start] == "." and end - start == 1 and plain and len(w) > 2):
            if mode == ALL_SMALL or (plain and not any(map(str.isupper, text[first : first + 40]))):
                return SOFT_JOIN if join else SOFT
    return SMALL


def _stop(text: str, start: int, end: int, mode: int) -> tuple[int, int]:
    """The symbol of the stop run text[start:end] and the place after its closing marks."""
    close = CLOSERS.match(text, end).end()
    stop = DOT if text[start] == "." and end - start == 1 else ELLIPSIS if text[start] in ".…" else STRONG
    right = _right(text, start, end, close, mode)
    left = _left(text, start, close) if stop == DOT and right not in (NOTHING, GLUED, SMALL) or right == GLUED_CAPITAL else PLAIN
    return stop_symbol(left, stop, right, mode), close


def events(text: str) -> tuple[list[int], list[int], np.ndarray | None]:
    """Symbols of a text's events (without DOC) and where a unit would end at each; the places of its visible characters
    when invisible ones were taken out, else None."""
    places = None
    if not text.isascii() and INVISIBLE.search(text):
        gone = {m.start() for m in INVISIBLE.finditer(text)}
        places = np.fromiter((i for i in range(len(text)) if i not in gone), np.int64, len(text) - len(gone))
        text = INVISIBLE.sub("", text)
    mode = _caseless(text)
    symbols, at = [], []
    n = len(text)
    for m in EVENT.finditer(text):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "stop":
            if text[s] in ";\u037e" and not (s and ("Ͱ" <= text[s - 1] <= "Ͽ" or "ἀ" <= text[s - 1] <= "῿")):
                continue
            symbol, end = _stop(text, s, e, mode)
        elif kind == "wide":
            end = CLOSERS.match(text, e).end()
            if end > e and end < n and not text[end].isspace() and text[end] not in OPENING:
                continue
            symbol = END
        elif kind == "blank":
            symbol, end = BLANK, s
        elif kind == "thai":
            if e == n or text[e].isdigit() or text[s - 1].isdigit() or unicodedata.category(text[e]) == "Nd" or text[e] in "\n\r":
                continue
            symbol, end = END, s
        else:
            q, end = m.group(), s
            if q == '"':
                left = s == 0 or text[s - 1].isspace() or text[s - 1] in OPENING or text[s - 1] in "—–-/"
                right = e == n or text[e].isspace() or not (text[e].isalnum() or text[e] in OPENING or text[e] in "'¿¡$€")
                symbol = STRAIGHT if left == right else STRAIGHT_OPEN if left else STRAIGHT_CLOSE
            elif q in "«「『":
                symbol = OPEN
            elif q in "„‟":
                symbol = LOW
            elif q == "“":
                symbol = HIGH_OR_CLOSE
            else:
                symbol = CLOSE
        symbols.append(symbol)
        at.append(end)
    symbols.append(DOC)
    at.append(n)
    # a stop's event stands after its closing marks: events go in order of place, stops last
    if any(a > b for a, b in zip(at, at[1:])):
        order = sorted(range(len(at)), key=lambda i: (at[i], symbols[i] == END or symbols[i] >= FIRST_STOP, i))
        symbols, at = [symbols[i] for i in order], [at[i] for i in order]
    stripped = text.rstrip()
    out = []
    for a in at:
        while a > 0 and text[a - 1].isspace():
            a -= 1
        out.append(min(a, len(stripped)))
    return symbols, out, places


def unit_ends(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, end_pos) of every unit, in order; null and blank texts have none."""
    symbols, ends, owner, maps = [], [], [], {}
    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        s, e, places = events(text)
        symbols += s
        ends += e
        owner += [i] * len(s)
        if places is not None:
            maps[i] = places
    emitted = np.flatnonzero(run_transducer(np.array(symbols, np.int64)))
    own, end = np.array(owner, np.int64)[emitted], np.array(ends, np.int64)[emitted]
    # at each text's first event and wherever the end moves on
    keep = (end > 0) & np.r_[True, (own[1:] != own[:-1]) | (end[1:] > end[:-1])] if len(own) else np.empty(0, bool)
    own, end = own[keep], end[keep]
    for i, places in maps.items():
        a, b = np.searchsorted(own, [i, i + 1])
        end[a:b] = places[end[a:b] - 1] + 1
    return own, end


def sentence_units(df: DataFrame, tbl: str, key: str, text: str) -> DataFrame:
    """UNITS: one row per sentence unit of df[text], key df[key], end_pos in code points from the field's start to the
    unit's last character. Null and blank fields have no row; a field with no sentence end is one unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 2000, 1):
            own, end = unit_ends(b.column(1).to_pylist())
            keys = b.column(0).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array([tbl] * len(own), pa.string()), keys, pa.array(end.astype(np.int32))], names=["tbl", "row_key", "end_pos"])

    return df.select(F.col(key).cast("long"), text).where(F.col(text).isNotNull()).mapInArrow(run, UNITS)
