"""Literal factors of patterns: texts one of which stands in every match.

A pattern is tried only where one of its factors stands, which is a search for a few constant texts; where lines are many and
sinks are few, nearly all of the patterns' work falls away, and no match is lost.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: More alternatives than the first are no quicker than the pattern; at most so many texts are spelt out meanwhile.
MOST, SPELT = 24, 64

Texts = frozenset[str] | None


def _better(a: Texts, b: Texts) -> Texts:
    """Of two sets of factors the one with the longer shortest text; of these the smaller one."""
    if a is None or b is None:
        return b if a is None else a
    rank = lambda s: (min(map(len, s)), -len(s))
    return a if rank(a) >= rank(b) else b


def _sequence(items) -> tuple[Texts, Texts]:
    """(all texts that a sequence matches, or None if they aren't few; factors of it, or None)."""
    run: Texts = frozenset([""])
    whole, best = True, None
    for op, value in items:
        exact, factors = _one(op, value)
        if exact is not None and len(run) * len(exact) <= SPELT:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        best = _better(best, _better(factors, _usable(run)))
        run = exact if exact is not None else frozenset([""])
    return (run if whole else None), _better(best, _usable(run))


def _usable(texts: Texts) -> Texts:
    return texts if texts and min(map(len, texts)) >= 1 else None


def _one(op, value) -> tuple[Texts, Texts]:
    if op is sre.LITERAL:
        return frozenset([chr(value)]), frozenset([chr(value)])
    if op is sre.IN:
        few = [v for o, v in value if o is sre.LITERAL]
        texts = frozenset(map(chr, few)) if len(few) == len(value) and len(few) <= 4 else None
        return texts, texts
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.ATOMIC_GROUP:
        return _sequence(value)
    if op is sre.BRANCH:
        found = [_sequence(b) for b in value[1]]
        exact = frozenset().union(*(e for e, _ in found)) if all(e is not None for e, _ in found) else None
        factors = frozenset().union(*(f for _, f in found)) if all(f is not None for _, f in found) else None
        return (exact if exact is not None and len(exact) <= SPELT else None), factors
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        exact, factors = _sequence(inner)
        if (least, most) == (1, 1):
            return exact, factors
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, None
        return None, factors if least else None
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return frozenset([""]), None
    return None, None


@lru_cache(maxsize=4096)
def literal_factors(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(factors, whether case is ignored) of a pattern; no factors where any text may match, where they are too many, or where one is a
    single letter, digit or space, which stands nearly everywhere.

    Factors are in lower case where case is ignored.
    """
    tree = parser.parse(pattern)
    ignored = bool(tree.state.flags & re.IGNORECASE)
    exact, factors = _sequence(tree)
    texts = factors if factors is not None else exact
    if not texts:
        return (), ignored
    texts = {t.lower() for t in texts} if ignored else set(texts)
    if not all(t.isascii() for t in texts):
        return (), ignored
    if "" in texts:
        return (), ignored
    kept = {t for t in texts if not any(o != t and o in t for o in texts)}
    common = any(len(t) < 2 and (not t or t.isalnum() or t.isspace()) for t in kept)
    return (tuple(sorted(kept)) if not common and len(kept) <= MOST else ()), ignored


def may_be_empty(pattern: str) -> bool:
    """Whether a match can be the empty text."""
    return parser.parse(pattern).getwidth()[0] == 0


def may_match(pattern: str, text: Column, lower: Column) -> Column | None:
    """Whether a factor of ``pattern`` stands in ``text`` (``lower`` where case is ignored); None for a pattern without factors."""
    texts, ignored = literal_factors(pattern)
    if not texts:
        return None
    where = lower if ignored else text
    return reduce(lambda a, b: a | b, [where.contains(t) for t in texts])


def guarded_match(pattern: str, text: Column, lower: Column) -> Column:
    """``text`` matches ``pattern``; the pattern is tried behind its factors alone."""
    near = may_match(pattern, text, lower)
    found = text.rlike(pattern)
    return found if near is None else near & found
