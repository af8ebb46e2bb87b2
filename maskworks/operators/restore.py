"""The backward direction: comments that a model added are stripped, placeholders become names again, and a report says which."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textswap
from ..functions.grammar import PLACEHOLDER_SCAN, REDACTION_PREFIX, SPACE, ascii_regex

_LINE = r"^[ \t]*//[ \t]*"
#: What can be stripped, in the order in which it is.
STRIP_PATTERNS = {
    "jsdoc": r"/\*\*[\s\S]*?\*/",
    "todo": _LINE + r"(?:TODO|FIXME|HACK|REVIEW)[^\n]*",
    "step-marker": _LINE + r"Step\s+\d+[:.][^\n]*",
    "narration": _LINE
    + r"(?:Handle|Validate|Initialize|Process|Check|Update|Create|Delete|Get|Set|Return|Log|Send|Fetch|Load|Save|Build|Parse|Format|Convert|Calculate|Generate|Execute|Run|Start|Stop|Connect|Disconnect|Register|Authenticate|Authorize)[^\n]*",
    "separator": _LINE + r"[-=*]{3,}[^\n]*",
    "section-header": _LINE + r"\*{2}[^\n\r  ]*\*{2}[ \t]*$",
    "inline-annotation": _LINE + r"@(?:param|returns?|type|throws?|deprecated|see|example)[^\n]*",
}
STRIPPABLE_TYPES = tuple(STRIP_PATTERNS)


def strip_set(option: str | Sequence[str] | None = None) -> tuple[str, ...]:
    """The types that an option names: all for none and "all", none for "none", else the list."""
    if option in (None, "all"):
        return STRIPPABLE_TYPES
    return () if option == "none" else tuple(t for t in STRIPPABLE_TYPES if t in set(option))


def strip_option(keep_docs: bool) -> str | tuple[str, ...]:
    """Everything, or everything but documentation blocks."""
    return tuple(t for t in STRIPPABLE_TYPES if t != "jsdoc") if keep_docs else "all"


def _java(pattern: str) -> str:
    return ascii_regex(pattern.replace(r"[\s\S]", r"[\x{0}-\x{10FFFF}]"))


def stripped(docs: DataFrame, text: str, strip: str | Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the text stripped and tidied and with ``stripped_items``: array of struct(type, content, line_number).

    A line number counts lines up to the first place where the stripped match stands in the text as the
    types before it left it. With anything to strip, lines of blanks are emptied and three or more line
    ends become two, whether or not something was found.
    """
    wanted = strip_set(strip)
    out = docs.withColumn("__now", F.col(text)).withColumn("stripped_items", F.array().cast("array<struct<type:string,content:string,line_number:int>>"))

    def item(kind: str):
        line = lambda m: F.size(F.split(F.call_function("substring_index", F.col("__now"), m, F.lit(1)), "\n"))
        return lambda m: F.struct(F.lit(kind).alias("type"), F.regexp_replace(m, rf"^{SPACE}+|{SPACE}+\z", "").alias("content"), line(m).alias("line_number"))

    for kind in wanted:
        regex = _java(STRIP_PATTERNS[kind])
        items = F.transform(F.regexp_extract_all("__now", F.lit(regex), F.lit(0)), item(kind))
        out = out.withColumn("stripped_items", F.concat("stripped_items", F.coalesce(items, F.array().cast("array<struct<type:string,content:string,line_number:int>>"))))
        out = out.withColumn("__now", F.regexp_replace("__now", regex, ""))
    if wanted:
        out = out.withColumn("__now", F.regexp_replace(F.regexp_replace("__now", ascii_regex(r"^[ \t]+$"), ""), r"\n{3,}", "\n\n"))
    return out.withColumn(text, F.col("__now")).drop("__now")


def restore(docs: DataFrame, text: str = "text", symbols: str = "symbols", strip: str | Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``restored``, ``stripped_count``, ``stripped_items`` and ``report``.

    ``symbols`` names a column of entries (placeholder, name, ord). Every placeholder of the map is replaced, whatever
    its shape, in one pass from the left, longer ones first and, unless ``strict``, also inside longer words: where
    only the first digits of a number are known, the rest stays behind the name. An automaton over the map's
    placeholders finds them, in time linear in text and map. ``report`` is struct(resolved, missing,
    unresolved): placeholders of the map that came back and that did not, in map order, and placeholders left in
    the restored text, in order, without redactions. A null text is restored to null and nothing came back.
    """
    out = stripped(docs.withColumn("__text", F.col(f"`{text}`")), "__text", strip)
    ordered = F.array_sort(F.transform(symbols, lambda e: F.struct(e["ord"].alias("ord"), e["placeholder"].alias("placeholder"), e["name"].alias("name"))))
    out = out.withColumn("__entries", F.coalesce(ordered, F.array().cast("array<struct<ord:int,placeholder:string,name:string>>")))
    keys = F.transform("__entries", lambda e: e["placeholder"])
    out = out.withColumn("__done", textswap.swap_terms(F.col("__text"), keys, F.transform("__entries", lambda e: e["name"]), strict))
    out = out.withColumn("restored", F.col("__done.text"))
    left = F.filter(F.array_distinct(F.regexp_extract_all("restored", F.lit(PLACEHOLDER_SCAN), F.lit(0))), lambda t: ~t.startswith(REDACTION_PREFIX))
    report = F.struct(
        F.array_intersect(keys, F.col("__done.found")).alias("resolved"),
        F.array_except(keys, F.col("__done.found")).alias("missing"),
        F.coalesce(left, F.array().cast("array<string>")).alias("unresolved"),
    )
    out = out.withColumn("report", report).withColumn("stripped_count", F.size("stripped_items"))
    return out.drop("__text", "__entries", "__done")


def summary(report: Column, most: int = 12) -> Column:
    """struct(total, clean, missing, more_missing, unresolved, more_unresolved) of a report, lists cut to ``most``."""
    over = lambda name: F.greatest(F.size(report[name]) - most, F.lit(0))
    return F.struct(
        (F.size(report["resolved"]) + F.size(report["missing"])).alias("total"),
        ((F.size(report["missing"]) == 0) & (F.size(report["unresolved"]) == 0)).alias("clean"),
        F.slice(report["missing"], 1, most).alias("missing"),
        over("missing").alias("more_missing"),
        F.slice(report["unresolved"], 1, most).alias("unresolved"),
        over("unresolved").alias("more_unresolved"),
    )


def stripped_by_type(restored: DataFrame, key: str, most: int = 3, cut: int = 80) -> DataFrame:
    """(key, type, n, shown): how many items of each type were stripped, with the first few of them."""
    item = restored.select(F.col(key).alias(key), F.posexplode("stripped_items").alias("i", "s"))
    item = item.select(key, "s.type", "i", F.substring("s.content", 1, cut).alias("c"))
    place = F.row_number().over(Window.partitionBy(key, "type").orderBy("i"))
    first = F.when(F.col("place") <= most, F.struct("i", "c"))
    by_type = item.withColumn("place", place).groupBy(key, "type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("first"))
    return by_type.select(key, "type", "n", F.transform("first", lambda x: x["c"]).alias("shown"))
