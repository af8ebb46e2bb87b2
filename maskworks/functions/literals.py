"""Literals that a regular expression cannot match without: a cheap test before a costly search."""

from functools import cache, reduce
from re import _constants as codes
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_REPEATS = (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT)


def _of(tree) -> tuple[str, ...] | None:
    """The best set of strings of which every match has one, or None."""
    best: tuple[str, ...] | None = None
    run = ""

    def offer(found: tuple[str, ...] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in tree:
        if op is codes.LITERAL:
            run += chr(arg)
            continue
        offer((run,) if run else None)
        run = ""
        if op is codes.SUBPATTERN:
            # A group with flags of its own may ignore case, and then says nothing.
            offer(_of(arg[3]) if not arg[1] else None)
        elif op is codes.ATOMIC_GROUP:
            offer(_of(arg))
        elif op is codes.BRANCH:
            parts = [_of(x) for x in arg[1]]
            offer(tuple(dict.fromkeys(s for p in parts for s in p)) if all(parts) else None)
        elif op in _REPEATS and arg[0] > 0:
            offer(_of(arg[2]))
    offer((run,) if run else None)
    return best


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a pattern has one; empty when there are none to name."""
    return _of(parser.parse(pattern.replace(r"\z", r"\Z"))) or ()


def may_match(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """False only where a pattern surely has no match in a text."""
    words = needed(pattern)
    if not words:
        return F.lit(True)
    where = F.lower(text) if ignore_case else text
    return reduce(lambda a, b: a | b, [F.contains(where, F.lit(w.lower() if ignore_case else w)) for w in words])
