"""Legends: what the placeholders of a masked text stand for, without any real name."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.grammar import base_of, placeholders_in

#: What the known bases stand for, in legend order.
LABELS = {
    "__CLS__": "class or type names",
    "__FN__": "function or method names",
    "__VAR__": "variable or parameter names",
    "__PKG__": "package or module names",
    "__STR__": "words that appeared inside string literals",
    "__MANUAL__": "values the author marked as sensitive",
}
OTHER = "project-specific identifiers"
PREAMBLE = (
    "Note to the assistant: names in the code below were replaced by placeholders before it was shared. "
    "Please work with the placeholders as with ordinary names and repeat them unchanged in your answer."
)


def legend(symbols: Column | str, snippet: Column | None = None) -> Column:
    """One sentence with the number of placeholders of each base; empty without a numbered one.

    With a ``snippet`` only placeholders that stand in it count. Known bases come first in a fixed order, others
    in map order.
    """
    keys = F.transform(symbols, lambda e: e["placeholder"])
    if snippet is not None:
        keys = F.array_intersect(keys, placeholders_in(snippet))
    known = F.array(*map(F.lit, LABELS))
    label = lambda b: reduce(lambda acc, x: acc.when(b == x[0], x[1]), LABELS.items(), F.when(b.isNull(), "")).otherwise(OTHER)

    def told(bases):
        order = F.concat(F.array_intersect(known, bases), F.array_except(F.array_distinct(bases), known))
        part = lambda b: F.concat(b, F.lit("* are "), label(b), F.lit(" ("), F.size(F.filter(bases, lambda x: x == b)).cast("string"), F.lit(")"))
        text = F.concat(F.lit("Placeholder legend: "), F.array_join(F.transform(order, part), "; "), F.lit("."))
        return F.when(F.size(bases) > 0, text).otherwise("")

    # As the variable of a function, the bases are told once a row and not again for each use.
    return F.transform(F.array(F.filter(F.transform(keys, base_of), lambda b: b != "")), told)[0]


def with_preamble(anonymized: Column, symbols: Column | str | None = None) -> Column:
    """The masked text behind a note for its reader and, with a map, the legend of what it uses."""
    if symbols is None:
        return F.concat(F.lit(PREAMBLE + "\n\n"), anonymized)
    told = legend(symbols, anonymized)
    return F.concat(F.lit(PREAMBLE), F.when(told != "", F.concat(F.lit("\n"), told)).otherwise(""), F.lit("\n\n"), anonymized)
