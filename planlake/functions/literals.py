"""Texts that a regular expression cannot match without: they are looked for first, and the expression runs only on texts that hold one of them."""

from __future__ import annotations

from functools import lru_cache
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlake.functions.nested import contains_any


def _best(choices: list[tuple[str, ...] | None]) -> tuple[str, ...] | None:
    """Of sets of literals one of which each match holds, that whose shortest is longest."""
    known = [c for c in choices if c]
    return max(known, key=lambda c: (min(map(len, c)), -len(c))) if known else None


def _required(tree) -> tuple[str, ...] | None:
    """Literals one of which every match of a parsed expression holds; None if it cannot be told."""
    found, run = [], ""
    for op, arg in tree:
        if op is C.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        found.append((run,) if run else None)
        run = ""
        if op is C.SUBPATTERN:
            found.append(_required(arg[3]))
        elif op is C.BRANCH:
            parts = [_required(b) for b in arg[1]]
            found.append(tuple(dict.fromkeys(x for p in parts for x in p)) if all(parts) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            found.append(_required(arg[2]))
    found.append((run,) if run else None)
    return _best(found)


@lru_cache(maxsize=1024)
def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case texts one of which each text holds that pattern matches, whatever its case; empty if the pattern needs none.

    A text that holds another of them is left out, as the other is found wherever it is.
    """
    found = _required(parser.parse(pattern)) or ()
    return tuple(x for x in found if not any(y != x and y in x for y in found))


def may_match(lowered: Column, pattern: str) -> Column:
    """Whether a lower-cased text holds one of the pattern's literals; true for a pattern without any."""
    literals = required_literals(pattern)
    return contains_any(lowered, literals) if literals else F.lit(True)


def matches_where_possible(text: Column, lowered: Column, pattern: str) -> Column:
    """Whether pattern matches text in any case; the expression runs only where lowered, the text in lower case, holds a literal of it. Null matches nothing."""
    return F.coalesce(F.when(may_match(lowered, pattern), text.rlike("(?i)" + pattern)), F.lit(False))


