"""Marks made by hand: literal terms that are masked wherever they stand, comments included."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import secrets, textswap
from ..functions.grammar import MANUAL_BASE, PLACEHOLDER_SCAN, base_of, is_placeholder, number_of


CREDENTIAL = "a credential cannot be marked: marks are reversible and written to the map"
ALREADY = "a placeholder cannot be marked: the name behind it would be lost on restore"


class ManualMaskError(ValueError):
    """A term that must not be marked; ``term`` is what was asked for."""

    def __init__(self, term: str, message: str):
        super().__init__(message)
        self.term = term


def wanted_terms(docs: DataFrame, terms: Sequence[str]) -> list[str]:
    """Distinct, non-blank terms; a credential or a placeholder among them is refused. The message has no secret."""
    kept = [t for t in dict.fromkeys(terms) if t.strip()]
    if kept:
        spark = docs.sparkSession
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(kept)], "i int, t string")
        for i, secret, placeholder in asked.select("i", secrets.has_blocking(F.col("t")), is_placeholder(F.col("t"))).orderBy("i").collect():
            if secret:
                raise ManualMaskError(kept[i], CREDENTIAL)
            if placeholder:
                raise ManualMaskError(kept[i], ALREADY)
    return kept


def refused(terms: Column) -> Column:
    """Array of struct(nth, reason) for the terms of a row that must not be marked; the terms themselves are not told."""
    why = lambda t: F.when(secrets.has_blocking(t), F.lit(CREDENTIAL)).when(is_placeholder(t), F.lit(ALREADY))
    told = F.transform(terms, lambda t, i: F.struct((i + 1).alias("nth"), why(t).alias("reason")))
    return F.coalesce(F.filter(told, lambda e: e["reason"].isNotNull()), F.array().cast("array<struct<nth:int,reason:string>>"))


def mark_rows(docs: DataFrame, terms: str, text: str = "text", known: str = "known") -> DataFrame:
    """As :func:`apply_marks`, with each row's own terms from the array column ``terms``, plus ``refused``.

    A term that must not be marked is refused by its place and a reason in ``refused``; the row's other terms are
    marked. Null and blank terms count for nothing; a null array is none.
    """
    told = docs.withColumn("refused", refused(F.col(f"`{terms}`")))
    bad = lambda t: secrets.has_blocking(t) | is_placeholder(t)
    good = F.array_distinct(F.filter(F.col(f"`{terms}`"), lambda t: F.coalesce(F.trim(t) != "", F.lit(False)) & ~bad(t)))
    return _marked(told.withColumn("__terms", F.coalesce(good, F.array().cast("array<string>"))), text, known)


def apply_marks(docs: DataFrame, terms: Sequence[str], text: str = "text", known: str = "known") -> DataFrame:
    """``docs`` with terms replaced by placeholders and the new entries appended to ``known``.

    ``known`` is an array of struct(placeholder, name, ord) in map order. Marks in it are applied again before
    the given terms, which are numbered in the given order behind the largest number of that base in
    ``known`` and in the text. A term that has a placeholder keeps it, whatever its base. Longer terms win;
    nothing inside a placeholder is touched. A term that stands nowhere has an entry all the same.
    """
    terms = wanted_terms(docs, terms)
    return _marked(docs.withColumn("__terms", F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")), text, known)


def _marked(docs: DataFrame, text: str, known: str) -> DataFrame:
    entries = F.col(known)
    taken = F.array_max(
        F.concat(
            F.transform(F.filter(entries, lambda e: base_of(e["placeholder"]) == MANUAL_BASE), lambda e: number_of(e["placeholder"])),
            F.transform(F.filter(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER_SCAN), F.lit(0)), lambda p: base_of(p) == MANUAL_BASE), lambda p: number_of(p)),
        )
    )
    out = docs.withColumn("__taken", F.coalesce(taken, F.lit(0)).cast("long")).withColumn("__new", F.array_except("__terms", F.transform(entries, lambda e: e["name"])))
    most = F.coalesce(F.array_max(F.transform(entries, lambda e: e["ord"])), F.lit(0))
    fresh = F.transform("__new", lambda t, i: F.struct(F.concat(F.lit(MANUAL_BASE), (F.col("__taken") + i + 1).cast("string")).alias("placeholder"), t.alias("name"), (most + i + 1).cast("int").alias("ord")))
    again = F.transform(F.filter(entries, lambda e: e["placeholder"].startswith(MANUAL_BASE)), lambda e: e["name"])
    out = out.withColumn("__wanted", F.array_distinct(F.concat(again, "__terms"))).withColumn(known, F.concat(entries, fresh))
    # The automaton over a row's terms finds the longest at each place; placeholders go before all terms.
    return out.withColumn(text, textswap.mark_terms(F.col(text), F.col("__wanted"), F.col(known), PLACEHOLDER_SCAN)).drop("__taken", "__new", "__wanted", "__terms")


def terms_in(known: Column) -> Column:
    """The terms marked by hand among the entries of a map, in map order."""
    return F.transform(F.filter(known, lambda e: e["placeholder"].startswith(MANUAL_BASE)), lambda e: e["name"])


def unmask(docs: DataFrame, placeholder: str | Column, text: str = "text", known: str = "known") -> DataFrame:
    """One placeholder put back into the text and dropped from the map; unknown ones change nothing."""
    mark = F.lit(placeholder) if isinstance(placeholder, str) else placeholder
    one = F.get(F.transform(F.filter(known, lambda e: e["placeholder"] == mark), lambda e: e["name"]), F.lit(0))
    quoted = F.replace(F.replace(one, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    put_back = F.regexp_replace(F.col(text), F.concat(F.lit("\\Q"), mark, F.lit("\\E(?![0-9])")), quoted)
    return docs.withColumn(text, F.when(one.isNotNull(), put_back).otherwise(F.col(text))).withColumn(known, F.filter(known, lambda e: e["placeholder"] != mark))


def marks(known: DataFrame) -> DataFrame:
    """The marks of a symbol table (…, placeholder, name), by number."""
    return known.where(F.col("placeholder").startswith(MANUAL_BASE)).orderBy(number_of(F.col("placeholder")).asc_nulls_first(), "placeholder")
