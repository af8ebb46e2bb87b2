"""The forward direction: identifiers become role-typed placeholders, secrets go for good.

Per-document scope needs no shuffle: segments, names and roles are told within the row by array functions, an
Arrow helper numbers the distinct names and another puts the text together, both linear in the row.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages, secrets, textswap
from ..functions.grammar import ROLE_BASES, ROLE_PRIORITY, WORD, base_of, number_of
from . import identifiers, manual
from .identifiers import ENTRY, role_name
from .rules import Rule, replacement_base, usable, whitelisted


#: Ranges of keys that a corpus is numbered in.
KEY_RANGES = 200
#: More places than a row has names.
PLACES = 1 << 32
#: More characters than a text can have.
LONGEST = (1 << 31) - 1


def entries_of(symbols: dict[str, str]) -> Column:
    """A symbol map as the array of (placeholder, name, ord) that the operators take."""
    made = [F.struct(F.lit(p).alias("placeholder"), F.lit(n).alias("name"), F.lit(i).cast("int").alias("ord")) for i, (p, n) in enumerate(symbols.items())]
    return F.array(*made).cast(f"array<{ENTRY}>")


def as_map(entries: Column | str) -> Column:
    """Entries as a map from placeholder to name."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["placeholder"], e["name"])))


def _base(rules: list[Rule]) -> Column:
    role = role_name(F.col("role_priority"))
    by_role = F.lit(ROLE_BASES["variable"])
    for name, base in ROLE_BASES.items():
        by_role = F.when(role == name, F.lit(base)).otherwise(by_role)
    return F.coalesce(replacement_base(F.col("token"), rules), by_role)


def _own_base(name: Column, rules: list[Rule]) -> Column:
    """The base that rules give a name, an empty one if it stays, null if no rule says anything."""
    return F.when(whitelisted(name, rules), F.lit("")).otherwise(replacement_base(name, rules))


def placeholders_held(text: Column) -> Column:
    """The numbered placeholders that stand in a text as whole words, comments included."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!{WORD})__[A-Z][A-Z0-9_]*__[0-9]+(?!{WORD})"), F.lit(0)))
    return F.when(F.contains(text, F.lit("__")), found).otherwise(F.array().cast("array<string>"))


def prepared(docs: DataFrame, text: str, language: str | None, known: str | None, marks: Sequence[str], policy: str) -> DataFrame:
    """``docs`` with ``language`` (of the raw text), ``secrets``, ``known`` entries and redacted, marked text."""
    out = docs.withColumn("language", languages.resolve(F.col(text), language))
    out = secrets.with_findings(out, text, policy)
    entries = F.col(known) if known else F.array()
    out = out.withColumn("known", F.coalesce(entries.cast(f"array<{ENTRY}>"), F.array().cast(f"array<{ENTRY}>")))
    return manual.apply_marks(out, marks, text, "known") if known or any(t.strip() for t in marks) else out


def anonymize(
    docs: DataFrame, text: str = "text", language: str | None = None, known: str | None = None, rules: Sequence[Rule] = (), marks: Sequence[str] = (), policy: str = "redact", texts: bool = True
) -> DataFrame:
    """All columns of ``docs`` plus ``anonymized``, ``symbols``, ``identifier_count``, ``language`` and ``secrets``.

    ``symbols`` is the whole map, carried and new entries, as array of struct(placeholder, name, ord); ``known``
    names a column with entries to reuse and to count on from. Names are numbered longest first, then by
    first place; a name with an entry keeps it, a whitelisted one stays, the first matching replace rule
    gives its own base, all others go by their strongest role. Numbers go on behind placeholders in the text.
    Comments are left as they are. A null text gives null and no entries. Rows are documents of their own,
    whatever they repeat; columns with one of the new names are replaced. Without ``texts`` there is no
    ``anonymized``, and no text is put together. A session with Spark's default for the size of Arrow batches gets
    a smaller one.
    """
    textswap.small_batches(docs.sparkSession)
    active = usable(docs.sparkSession, list(rules))
    old = [c for c in docs.columns if c not in ("anonymized", "symbols", "identifier_count", "language", "secrets", "known")]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*old, *([known] if known else [])])])
    source = prepared(source.withColumn("__source", F.col(f"`{text}`")), "__source", language, known, marks, policy)
    which = F.col("language") if language in (None, "auto") else language
    row = identifiers.cut(source, "__source", which).withColumn("__found", textswap.settled(identifiers.found_names(which)))
    bases = None
    if active:
        row = row.withColumn("__bases", F.transform("__found", lambda x: _own_base(F.substring(x, 2, LONGEST), active)))
        bases = F.col("__bases")
    whole = [F.col("__segs"), F.col("__comment")] if texts else []
    row = row.withColumn("__swap", textswap.numbered(F.col("__found"), F.col("known"), placeholders_held(F.col("__source")), bases, *whole))
    fresh = F.col("__swap.entries")
    if known or any(t.strip() for t in marks):
        most = F.coalesce(F.array_max(F.transform("known", lambda e: e["ord"])), F.lit(-1))
        fresh = F.concat("known", F.transform(fresh, lambda e: F.struct(e["placeholder"].alias("placeholder"), e["name"].alias("name"), (most + e["ord"] + 1).cast("int").alias("ord"))))
    return row.select(
        *[F.col(f"`{c}`") for c in old],
        *([F.when(F.col("__source").isNotNull(), F.col("__swap.text")).alias("anonymized")] if texts else []),
        fresh.alias("symbols"),
        F.size(fresh).alias("identifier_count"),
        "language",
        "secrets",
    )


def _held(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(base, key, p): the largest number of each base among the placeholders that stand in each text."""
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(placeholders_held(F.col(text))).alias("t"))
    return found.select("key", base_of(F.col("t")).alias("base"), number_of(F.col("t")).alias("p")).where("p is not null").groupBy("base", "key").agg(F.max("p").alias("p"))


def last_numbers(symbols: DataFrame, docs: DataFrame, last: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(base, last): the largest number of each base in new symbols, in the texts they are from, and in ``last`` from before.

    Published with a symbol table, it is all that later documents need to know of earlier texts.
    """
    rows = symbols.select("base", F.col("n").cast("long").alias("last")).unionByName(_held(docs, key, text).select("base", F.col("p").alias("last")))
    return (rows if last is None else rows.unionByName(last.select("base", "last"))).groupBy("base").agg(F.max("last").alias("last"))


def corpus_symbols(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str | None = None, rules: Sequence[Rule] = (), known: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """(placeholder, base, n, name, first_key) of one symbol table for a whole corpus.

    With ``known``, the table published before, and ``last``, its :func:`last_numbers`, only names that it does not have
    are numbered, behind its numbers: what is published stays, only the texts of ``docs`` are read, and the
    tables together are that of all documents in order, if those before have smaller keys.

    As if the documents were masked one after another in the order of their integer keys with a growing map:
    a name is numbered in the first document that has it, by the role it has there, behind all numbers that
    placeholders in documents up to that one have. Documents without a key or a text are left out.
    """
    active = usable(docs.sparkSession, list(rules))
    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    source = source.withColumn("__lang", languages.resolve(F.col("__text"), language))
    row = identifiers.names(source, "__key", "__text", F.col("__lang") if language in (None, "auto") else language)
    # One grouping, by name, that sums up by hashing within each task: names recur in most documents, so little of them
    # is shuffled. Key and place are one whole number; a role of the first document is one whose smallest key is that key.
    # The key is told from that number, so that what counts names and what places them need the same columns: texts are searched once.
    places = F.lit(PLACES).cast("decimal(11,0)")
    least = {p: F.min(F.when(F.col("priority") == p, F.col("key"))).alias(f"key_{p}") for p in sorted(ROLE_PRIORITY.values(), reverse=True)}
    place = (F.col("key").cast("decimal(20,0)") * places + F.col("at")).cast("decimal(38,0)")
    first = row.withColumn("place", place).groupBy("token").agg(F.min("place").alias("place"), *least.values()).where(~whitelisted(F.col("token"), active))
    first = first.withColumn("at", F.pmod("place", places)).withColumn("key", F.expr(f"(place - at) div {PLACES}").cast(row.schema["key"].dataType))
    role = F.coalesce(*[F.when(F.col(f"key_{p}") == F.col("key"), F.lit(p)) for p in least])
    first = first.select("token", "key", F.col("at").cast("int").alias("at"), role.alias("role_priority"))
    if known is not None:
        first = first.join(known.select(F.col("name").alias("token")), "token", "left_anti")
    first = first.withColumn("base", _base(active))
    counts = first.groupBy("base", "key").agg(F.count("*").alias("n"))
    per_doc = counts.join(_held(source, "__key", "__text"), ["base", "key"], "full").withColumn("last", F.lit(0).cast("long"))
    if last is not None:
        # Numbers are counted from the last one before.
        per_doc = per_doc.drop("last").join(last.select("base", "last"), "base", "left").withColumn("last", F.coalesce("last", F.lit(0)))
        per_doc = per_doc.withColumn("p", F.col("p") - F.col("last"))
    # One row for each base and document that adds to it: numbers before a document are a running sum and maximum,
    # taken within ranges of keys and carried over the few rows of range totals.
    cuts = sorted(set(docs.select(F.col(key).cast("double")).approxQuantile(key, [i / KEY_RANGES for i in range(KEY_RANGES)], 0.2 / KEY_RANGES)))
    per_doc = per_doc.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("key").cast("double"))))
    inside = Window.partitionBy("base", "range").orderBy("key")
    per_doc = per_doc.withColumn("s", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_doc = per_doc.withColumn("reach", F.max(F.coalesce("p", F.lit(0)) - F.col("s")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("base").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_doc.groupBy("base", "range").agg(F.sum(F.coalesce("n", F.lit(0))).alias("sum"), F.max("reach").alias("most"))
    ranges = ranges.withColumn("sum", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    ranges = ranges.withColumn("most", F.coalesce(F.max(F.col("most") - F.col("sum")).over(before), F.lit(0)))
    start = F.col("last") + F.col("sum") + F.col("s") + F.greatest(F.col("most"), F.col("reach") - F.col("sum"), F.lit(0))
    starts = per_doc.join(ranges, ["base", "range"]).select("base", "key", start.alias("start"))
    own = Window.partitionBy("key", "base").orderBy(F.length("token").desc(), "at")
    placed = first.join(starts, ["base", "key"]).withColumn("n", F.col("start") + F.row_number().over(own))
    return placed.select(F.concat("base", F.col("n").cast("string")).alias("placeholder"), "base", "n", F.col("token").alias("name"), F.col("key").alias("first_key"))
