"""Cutting source text into comments, strings and code with one regular expression per comment syntax.

Every quantifier over text is possessive or walks one character class, so long literals cannot exhaust
the regex engine's stack.
"""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import languages
from .grammar import WHITE


def _until(close: str) -> str:
    """Text up to and with a closing delimiter, or to the end."""
    return rf"[\s\S]*?(?:{re.escape(close)}|\z)"


def segment_regex(language: str) -> str:
    """A regex whose matches are the segments of a text, in order and without gaps."""
    syntax = languages.comment_syntax(language)
    comments = [f"{re.escape(d)}{_until(d)}" for d in syntax["docstring"]]
    comments += [rf"{re.escape(o)}[^\n]*+" for o in syntax["line"]]
    comments += [f"{re.escape(o)}{_until(c)}" for o, c in syntax["block"]]
    strings = [rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+(?:{q}|\\?\z)" for q in syntax["quotes"]]
    openers = "|".join(map(re.escape, [*syntax["docstring"], *syntax["line"], *(o for o, _ in syntax["block"]), *syntax["quotes"]]))
    # Code is walked by characters that can open nothing and single ones that do not open here.
    inert = "".join(sorted({re.escape(o[0]) for o in [*syntax["docstring"], *syntax["line"], *(b[0] for b in syntax["block"]), *syntax["quotes"]]}))
    code = rf"(?:[^{inert}]++|(?!{openers})[\s\S])++"
    return "|".join([*comments, *strings, code])


def _syntaxes() -> dict[str, list[str]]:
    """Languages by the segment regex they share."""
    found: dict[str, list[str]] = {}
    for language in languages.LANGUAGES:
        found.setdefault(segment_regex(language), []).append(language)
    return found


def segments(text: Column, language: Column | str) -> Column:
    """The segments of a text as an array of strings."""
    cut = lambda regex: F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    if isinstance(language, str):
        return cut(segment_regex(language))
    choice = F.when(language.isNull(), F.lit(None).cast("array<string>"))
    for regex, names in _syntaxes().items():
        choice = choice.when(language.isin(names), cut(regex))
    return choice


def is_comment(segment: Column, language: Column | str) -> Column:
    """Whether a segment is a comment, told by its beginning."""

    def one(lang: str) -> Column:
        syntax = languages.comment_syntax(lang)
        heads = [*syntax["docstring"], *syntax["line"], *(o for o, _ in syntax["block"])]
        return reduce(lambda a, b: a | b, [segment.startswith(h) for h in heads])

    return one(language) if isinstance(language, str) else languages._by_language(language, one)


def is_string(segment: Column, language: Column | str) -> Column:
    """Whether a segment is a string literal; docstrings are comments."""

    def one(lang: str) -> Column:
        return reduce(lambda a, b: a | b, [segment.startswith(q) for q in languages.comment_syntax(lang)["quotes"]]) & ~is_comment(segment, lang)

    return one(language) if isinstance(language, str) else languages._by_language(language, one)


def before(segs: Column | str) -> Column:
    """For each segment the one before it; nothing for the first."""
    some = F.col(segs) if isinstance(segs, str) else segs
    return F.slice(F.concat(F.array(F.lit("")), some), F.lit(1), F.size(some))


def names_module(front: Column | str) -> Column:
    """Whether a string behind some text names a module: ``from`` or ``import``, or ``require(`` or ``import(``, stands there.

    White space may come between; only the last few characters before it are looked at.
    """
    some = F.col(front) if isinstance(front, str) else front
    bare = lambda x: F.rtrim(x, F.lit(WHITE))
    word = lambda x, words: F.substring(x, -8, 8).rlike(rf"(?<![A-Za-z0-9_$])(?:{words})\z")
    end = bare(some)
    opened = bare(F.substring(end, F.lit(1), F.length(end) - 1))
    return word(end, "from|import") | (end.endswith("(") & word(opened, "require|import"))
