"""Literals that a regular expression can't match without: a plain substring search that spares most lines the match."""
from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

#: A literal of fewer characters spares too few lines; more alternatives cost more than the match.
SHORTEST, MOST = 3, 8


def _needed(node) -> list[frozenset[str]]:
    """Sets of lower-case literals, of each of which every match holds one."""
    out: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= SHORTEST:
            out.append(frozenset([run]))
        run = ""

    for op, value in node:
        if op is C.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if op is C.AT:  # word borders and line ends take no character
            continue
        close()
        if op is C.SUBPATTERN:
            out += _needed(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            out += _needed(value[2])
        elif op is C.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            if all(each):
                best = [min(sets, key=_cost) for sets in each]
                joined = frozenset().union(*best)
                if len(joined) <= MOST:
                    out.append(joined)
    close()
    return out


def _cost(literals: frozenset[str]) -> tuple[int, int]:
    return len(literals), -min(map(len, literals))


@lru_cache(maxsize=None)
def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every text that ``pattern`` matches holds one; none if there is no such set."""
    try:
        tree = parser.parse(pattern.replace("(?i)", ""), re.ASCII)
    except re.error:
        return ()
    found = _needed(tree)
    return tuple(sorted(min(found, key=_cost))) if found else ()
