"""What a regular expression demands of a text, as a Boolean query of trigrams; and the evaluation of such queries on posting lists.

A query is a list of parts, all of which must hold; a part is a list of alternatives, sets of trigrams of which all must stand in the text.
Trigrams are of the text's UTF-8 bytes with A-Z lower-cased, so a query may let more texts pass than the expression, never fewer.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

import numpy as np

#: Strings of one exact piece; a larger piece ends there, and demands what it holds so far.
MOST_STRINGS = 64
#: Times that a repeated piece is written out.
MOST_REPEATS = 3

Part = list[frozenset[int]]
Query = list[Part]


def code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def trigrams(text: str) -> frozenset[int]:
    raw = text.encode()
    return frozenset(code(raw[i : i + 3]) for i in range(len(raw) - 2))


def fold(char: int) -> str | None:
    """The ASCII character as the index has it; None for others, whose cases may differ in bytes."""
    return chr(char).lower() if char < 128 else None


def demands(strings: set[str]) -> Query:
    """That one of the strings stands in the text: nothing where one of them is too short. A string that holds another's trigrams adds nothing."""
    sets = {trigrams(s) for s in strings}
    if not sets or any(not s for s in sets):
        return []
    return [sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)]


def either(queries: list[Query]) -> Query:
    """Any of the queries: a part of one alternative each where each is one conjunction, else what their first parts demand."""
    if any(not q for q in queries):
        return []
    return [[s for q in queries for s in min(q, key=len)]]


def class_of(items: list) -> set[str] | None:
    """The few characters of a class; None if there are many, or others than ASCII."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars = [value]
        elif kind is op.RANGE and value[1] - value[0] < 8:
            chars = range(value[0], value[1] + 1)
        else:
            return None
        folded = [fold(c) for c in chars]
        if None in folded:
            return None
        out.update(folded)
    return out if len(out) <= 8 else None


def pieces(tree: list) -> tuple[set[str] | None, Query]:
    """The exact strings that the tree matches (None if they are many), and what else it demands."""
    exact: set[str] = {""}
    whole, query = True, []

    def cut() -> None:
        nonlocal exact, whole
        query.extend(demands(exact))
        exact, whole = {""}, False

    for kind, value in tree:
        own: set[str] | None = None
        more: Query = []
        if kind is op.LITERAL:
            char = fold(value)
            own = None if char is None else {char}
        elif kind is op.IN:
            own = class_of(value)
        elif kind is op.SUBPATTERN:
            own, more = pieces(value[3])
        elif kind is op.ATOMIC_GROUP:
            own, more = pieces(value)
        elif kind is op.BRANCH:
            found = [pieces(x) for x in value[1]]
            if all(e is not None for e, _ in found):
                own = set().union(*(e for e, _ in found))
            else:
                more = either([q if e is None else demands(e) for e, q in found])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            once, inside = pieces(inner)
            if once is not None and least <= most <= MOST_REPEATS:
                own = {""} if least == 0 else set()
                step = {""}
                for i in range(1, most + 1):
                    step = {a + b for a in step for b in once}
                    own |= step if i >= least else set()
                    if len(own) > MOST_STRINGS:
                        own = None
                        break
            if own is None and least > 0:
                more = inside if once is None else demands(once)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            own = {""}
        if own is not None and len(exact) * len(own) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in own}
            continue
        cut()
        if own is not None:
            exact = set(own)
        query.extend(more)
    if whole and len(exact) <= MOST_STRINGS:
        return exact, query
    cut()
    return None, query


def trigram_query(pattern: str) -> Query:
    """What every text with a match of the pattern holds; empty if the pattern demands no trigram."""
    exact, query = pieces(list(parser.parse(pattern)))
    return demands(exact) if exact is not None else query


def vocabulary(queries: list[Query]) -> list[int]:
    return sorted({t for q in queries for part in q for s in part for t in s})


def answer(query: Query, postings: dict[int, np.ndarray]) -> np.ndarray:
    """Sorted numbers of the texts that satisfy a query (of one part at least): postings has the sorted numbers of each trigram's texts."""
    none = np.empty(0, np.int64)
    out = None
    for part in query:
        any_ = none
        for conjunction in part:
            lists = sorted((postings.get(t, none) for t in conjunction), key=len)
            all_ = lists[0]
            for more in lists[1:]:
                all_ = np.intersect1d(all_, more, assume_unique=True)
            any_ = np.union1d(any_, all_)
        out = any_ if out is None else np.intersect1d(out, any_, assume_unique=True)
    return out


def compiled(pattern: str) -> re.Pattern[str]:
    """Cases are those of ASCII: otherwise the Kelvin sign would be a k."""
    return re.compile(pattern, re.ASCII)
