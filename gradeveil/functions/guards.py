"""Cheap tests that a text must pass before a pattern can match it: one of a few literals, signs, and a number of digits.

They are read off the pattern itself, so that no pattern can need less than its guard says.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters beside a-z that match one of them where case does not count.
ALIKE, LIKE = "ſıİK", "siik"


#: Signs that are looked up in a text's extract of signs and digits.
SIGNS = ":=@_.-"


def folded(text: Column) -> Column:
    """The text in which literals are looked up: whatever matches a letter without regard to case is that letter."""
    return F.lower(F.when(text.rlike(f"[{ALIKE}]"), F.translate(text, ALIKE, LIKE)).otherwise(text))


def signs_in(text: Column) -> Column:
    """A text's signs and decimal digits alone: short, for most texts."""
    return F.regexp_replace(text, rf"[^\p{{Nd}}{re.escape(SIGNS)}]+", "")


def digits_in(signs: Column) -> Column:
    return F.length(F.regexp_replace(signs, r"\P{Nd}+", ""))


def _score(literals: frozenset[str]) -> tuple:
    """Long literals first, then few of them."""
    return min(map(len, literals)), -len(literals)


def _digits_only(items) -> bool:
    return all((k is c.LITERAL and chr(v).isdecimal()) or (k is c.CATEGORY and v is c.CATEGORY_DIGIT) or (k is c.RANGE and chr(v[0]).isdecimal() and chr(v[1]).isdecimal()) for k, v in items)


def _sets(tree) -> list[frozenset[str]]:
    """Sets of literals; every match holds at least one of each set."""
    found, run = [], ""
    for kind, value in [*tree, (None, None)]:
        if kind is c.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if kind is c.SUBPATTERN:
            found += _sets(value[3])
        elif kind is c.BRANCH:
            parts = [_best(_sets(b)) for b in value[1]]
            found += [frozenset().union(*parts)] if all(parts) else []
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] >= 1:
            found += _sets(value[2])
        elif kind is c.IN and len(value) <= 4 and all(k is c.LITERAL for k, _ in value):
            found.append(frozenset(chr(v).lower() for _, v in value))
    return found


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    return max(sets, key=_score) if sets else None


def _digits(tree) -> int:
    """Decimal digits in every match, at least."""
    n = 0
    for kind, value in tree:
        if kind is c.LITERAL:
            n += chr(value).isdecimal()
        elif kind is c.IN:
            n += _digits_only(value)
        elif kind is c.SUBPATTERN:
            n += _digits(value[3])
        elif kind is c.BRANCH:
            n += min(map(_digits, value[1]))
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT):
            n += value[0] * _digits(value[2])
    return n


def required(pattern: str) -> tuple[list[frozenset[str]], int]:
    """Sets of lower-case literals of each of which every match of a pattern holds at least one (signs first, then the
    best set), and the least number of decimal digits in a match."""
    # Python knows no \p{...}; which letters it means does not matter here
    tree = parser.parse(re.sub(r"\\p\{\w+\}", r"\\w", pattern))
    sets = _sets(tree)
    chosen = [s for s in sets if all(x in SIGNS for x in s)]
    chosen += [_best(sets)] if sets and _best(sets) not in chosen else []
    shortest = [frozenset(x for x in s if not any(y != x and y in x for y in s)) for s in chosen]
    return list(dict.fromkeys(shortest)), _digits(tree)


def may_match(fold: Column, signs: Column, digits: Column, pattern: str) -> Column:
    """Whether a text can hold a match. fold: the folded text; signs, digits: its extract, and the digits in it."""
    sets, n = required(pattern)
    tests = [digits >= n] if n else []
    for s in sets:
        tests.append(reduce(lambda a, b: a | b, (F.contains(signs if x in SIGNS else fold, F.lit(x)) for x in sorted(s))))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
