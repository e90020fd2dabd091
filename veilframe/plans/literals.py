"""Texts that a pattern's every match holds, read off the pattern.

A pattern is parsed into its parts.  What must be there are the runs of plain characters
that stand in it outside options and repetitions that may be missing; of alternatives,
one each.  The set of alternatives with the longest shortest text is taken, since a text
that holds none of it can't match.  Patterns that are written in ways the parser doesn't
know, ignore case, or need only short texts tell nothing, and have to be tried on all.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

#: Shorter texts stand in too many places.
LEAST = 3
#: More alternatives than this are none.
MOST = 64


def required(pattern: str) -> frozenset[str] | None:
    """Texts of which each match holds at least one; None where nothing is known."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    found = _best(list(tree))
    return frozenset(found) if found and min(map(len, found)) >= LEAST else None


def _best(parts: list) -> set[str] | None:
    """The best set of a sequence of parts."""
    sets, run = [], ""
    for op, value in [*parts, (None, None)]:
        if op is c.LITERAL:
            run += chr(value)
            continue
        if run:
            sets.append({run})
            run = ""
        if op is c.BRANCH:
            each = [_best(list(x)) for x in value[1]]
            if all(each):
                sets.append(set().union(*each))
        elif op is c.SUBPATTERN:
            _, added, _, inner = value
            if not added & re.IGNORECASE and (told := _best(list(inner))):
                sets.append(told)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            if value[0] >= 1 and (told := _best(list(value[2]))):
                sets.append(told)
        elif op is c.ATOMIC_GROUP and (told := _best(list(value))):
            sets.append(told)
    sets = [x for x in sets if len(x) <= MOST]
    return max(sets, key=lambda x: (min(map(len, x)), -len(x)), default=None)
