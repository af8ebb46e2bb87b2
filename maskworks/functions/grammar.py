"""The grammar of placeholders and identifiers, as regular expressions and Column functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases of placeholders by role, with their weight; the base of marks made by hand; the redaction prefix.
ROLE_BASES = {"class": "__CLS__", "function": "__FN__", "package": "__PKG__", "variable": "__VAR__", "string": "__STR__"}
ROLE_PRIORITY = {"class": 4, "function": 3, "package": 2, "variable": 1, "string": 0}
MANUAL_BASE = "__MANUAL__"
REDACTION_PREFIX = "__REDACTED_"

WORD = "[A-Za-z0-9_$]"
#: White space as source text knows it: ASCII spaces, no-break space, byte order mark, Unicode spaces and line ends.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same as characters.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PLACEHOLDER = r"__[A-Z][A-Z0-9_]*__[0-9]*"
PLACEHOLDER_TOKEN = rf"^{PLACEHOLDER}\z"
PLACEHOLDER_SCAN = rf"(?<!{WORD}){PLACEHOLDER}(?!{WORD})"
#: The same for Java: what stands in front is looked at only where two underscores stand.
_SCAN = rf"__(?<!{WORD}__)" + PLACEHOLDER.removeprefix("__") + rf"(?!{WORD})"
NUMBERED = r"^(__[A-Z][A-Z0-9_]*__)([0-9]+)\z"


def ascii_regex(pattern: str) -> str:
    """A Java regex with ASCII word bounds, explicit white space and line ends that do not hang on the JDK."""
    pattern = pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
    inner = SPACE[1:-1]
    pattern = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{inner}{m[2]}]", pattern).replace(r"\s", SPACE)
    if pattern.startswith("^"):
        pattern = r"(?<![^\n\r\u2028\u2029])" + pattern[1:]
    if pattern.endswith("$"):
        pattern = pattern[:-1] + r"(?=[\n\r\u2028\u2029]|\z)"
    return pattern


def is_placeholder(token: Column) -> Column:
    """Whether a whole token is a placeholder; null for null."""
    return token.rlike(PLACEHOLDER_TOKEN)


def placeholders_in(text: Column) -> Column:
    """All placeholders of a text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(_SCAN), F.lit(0))


def base_of(placeholder: Column) -> Column:
    """The base of a numbered placeholder; empty for others."""
    return F.regexp_extract(placeholder, NUMBERED, 1)


def number_of(placeholder: Column) -> Column:
    """The number of a numbered placeholder; null for others and for numbers beyond a long."""
    return F.regexp_extract(placeholder, NUMBERED, 2).try_cast("long")


def could_be_name(token: Column) -> Column:
    """Whether an identifier is worth masking by its shape: three characters, not all capitals, no placeholder."""
    return (F.length(token) > 2) & ~token.rlike(r"^[A-Z][A-Z0-9_]*\z") & ~is_placeholder(token)


def preview(term: Column, most: int = 30) -> Column:
    """A term cut to ``most`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(term) > most, F.concat(F.substring(term, 1, most), F.lit("…"))).otherwise(term)
