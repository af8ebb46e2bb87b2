"""Identifiers of source text as rows: occurrences, distinct names, roles."""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages, segments
from ..functions.grammar import PLACEHOLDER_TOKEN, ROLE_PRIORITY, SPACE, WORD, could_be_name

_RUN = rf"({WORD}*+)([^A-Za-z0-9_$]*+)"
IDENTIFIER = r"^[A-Za-z_$]"
ENTRY = "struct<placeholder:string,name:string,ord:int>"


def runs(docs: DataFrame, key: str, text: str, language: Column | str, known: str | None = None, extra: str | None = None) -> DataFrame:
    """One row per word run of each text: (key, language, seg, idx, comment, string, module, token, tail, before, entry, extra).

    ``token`` is a maximal run of word characters (empty where a segment begins with other ones), ``tail``
    what stands up to the next one, ``before`` the word in front if only white space lies between.
    Concatenating token and tail in order gives the text back. An empty text has one empty row, as has a null
    one. With ``known``, an array of struct(placeholder, name, ord), each of its entries is a row more, with
    the name as token, no tail and the entry in ``entry``; ``entry`` is null elsewhere. ``extra`` names a
    column that rides on a text's first row and is null on the others.
    """
    lang = F.lit(language) if isinstance(language, str) else language
    no_entries, rider = F.array().cast(f"array<{ENTRY}>"), F.col(extra) if extra else F.lit(None).cast("string")
    cut = docs.select(
        F.col(key).alias("key"), lang.alias("language"), segments.segments(F.coalesce(F.col(text), F.lit("")), language).alias("segs"),
        F.array(rider).alias("extra"), F.array(F.col(known).cast(f"array<{ENTRY}>") if known else no_entries).alias("known"),
    )
    cut = cut.withColumn("front", segments.before("segs"))
    # Zipping pads with nulls, so what belongs to the text as a whole stays on its first row.
    seg = cut.select("key", "language", F.posexplode_outer(F.arrays_zip("segs", "front", "extra", "known")).alias("seg", "s"))
    which = language if isinstance(language, str) else F.col("language")
    text_of = F.coalesce("s.segs", F.lit(""))
    seg = seg.select(
        "key", "language", "seg", text_of.alias("text"), segments.is_comment(text_of, which).alias("comment"), segments.is_string(text_of, which).alias("string"),
        F.coalesce("s.front", F.lit("")).alias("front"), F.array("s.extra").alias("extra"), F.coalesce("s.known", no_entries).alias("known"),
    )
    seg = seg.withColumn("module", F.col("string") & segments.names_module("front")).drop("front")
    seg = seg.withColumn("token", F.regexp_extract_all("text", F.lit(_RUN), F.lit(1))).withColumn("tail", F.regexp_extract_all("text", F.lit(_RUN), F.lit(2)))
    behind = lambda name: F.concat(F.array(F.lit("")), F.slice(name, 1, F.greatest(F.size(name) - 1, F.lit(0))))
    seg = seg.withColumn("before", behind("token")).withColumn("gap", behind("tail")).drop("text")
    if known:
        # Entries stand behind the tokens, as rows with the name as token.
        blank = lambda name: F.concat(name, F.transform("known", lambda e: F.lit("")))
        seg = seg.withColumn("entry", F.concat(F.transform("token", lambda t: F.lit(None).cast(ENTRY)), "known"))
        seg = seg.withColumn("token", F.concat("token", F.transform("known", lambda e: e["name"]))).withColumns({c: blank(c) for c in ("tail", "before", "gap")})
    else:
        seg = seg.withColumn("entry", no_entries)
    row = seg.select("key", "language", "seg", "comment", "string", "module", F.posexplode_outer(F.arrays_zip("token", "tail", "before", "gap", "entry", "extra")).alias("idx", "t"))
    row = row.where("idx = 0 or t.token <> '' or t.tail <> ''")
    near = F.col("t.gap").rlike(rf"^{SPACE}+\z") & F.col("t.before").rlike(IDENTIFIER)
    return row.select("key", "language", "seg", "idx", "comment", "string", "module", "t.token", "t.tail", F.when(near, F.col("t.before")).alias("before"), "t.entry", "t.extra")


def role_priority(which: Column | str) -> Column:
    """The role of an occurrence as its priority; null where a keyword stands in code."""
    named = {name: F.lit(p) for name, p in ROLE_PRIORITY.items()}
    token = F.col("token")
    return (
        F.when(F.col("string"), F.when(F.col("module"), named["package"]).otherwise(named["string"]))
        .when(languages.is_keyword("token", which), F.lit(None).cast("int"))
        .when(languages.follows_hint("before", which, languages.class_hints), named["class"])
        .when(languages.follows_hint("before", which, languages.function_hints) | F.col("tail").rlike(rf"^{SPACE}*\("), named["function"])
        .when(token.rlike("^[A-Z]") & token.rlike("[a-z]"), named["class"])
        .otherwise(named["variable"])
    )


ROLE_OF_PRIORITY = {p: name for name, p in ROLE_PRIORITY.items()}


def role_name(priority: Column) -> Column:
    """The role of a priority; "variable" for null, as for a name seen only where it is a keyword."""
    out = F.when(priority == 4, "class")
    for p in (3, 2, 0):
        out = out.when(priority == p, ROLE_OF_PRIORITY[p])
    return out.otherwise("variable")


def occurrences(docs: DataFrame, key: str, text: str, language: Column | str, known: str | None = None, extra: str | None = None) -> DataFrame:
    """:func:`runs` plus ``named`` (a maskable identifier) and ``priority`` (its role here)."""
    row = runs(docs, key, text, language, known, extra)
    which = language if isinstance(language, str) else F.col("language")
    word = F.col("token").rlike(IDENTIFIER) & ~F.col("comment") & F.col("entry").isNull()
    named = word & could_be_name(F.col("token")) & ~languages.is_keyword("token", which)
    return row.withColumn("named", named).withColumn("priority", F.when(word, role_priority(which)))


#: Identifiers as whole words, and those that are worth masking by their shape, as :func:`could_be_name` has it.
ANY_NAME = rf"(?<!{WORD})[A-Za-z_$]{WORD}*+"
NAME = rf"(?<!{WORD})(?![A-Z][A-Z0-9_]*+(?!{WORD}))(?!__[A-Z][A-Z0-9_]*__[0-9]*(?!{WORD}))[A-Za-z_$]{WORD}{{2,}}+"
#: Stands between segments that are searched as one text: no word, white space or parenthesis.
_SEAM = "\0"
#: Stands before a word behind a hint.
_MARK = "\x01"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.transform(F.array(value), use)[0]


def _distinct(text: Column, regex: Column | str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(regex) if isinstance(regex, str) else regex, F.lit(group)))


def _no_keyword(names: Column, which: Column | str) -> Column:
    def one(lang: str):
        words = sorted(languages.keywords(lang))
        return lambda t: ~(t.isin(words) | F.lower(t).isin(words) if lang in languages.CASE_INSENSITIVE else t.isin(words))

    if isinstance(which, str):
        return F.filter(names, one(which))

    def kept(t: Column) -> Column:
        # Told within the filter, so that the names are one expression and not one for each language.
        chosen = F.when(which.isNull(), F.lit(True))
        for lang in languages.LANGUAGES:
            chosen = chosen.when(which == lang, one(lang)(t))
        return chosen.otherwise(True)

    return F.filter(names, kept)


def _hint_regex(which: Column | str, one) -> Column:
    """A regex of a language; for an unknown one a regex that matches nothing."""
    if isinstance(which, str):
        return F.lit(one(which))
    chosen = F.when(which.isNull(), F.lit("()(?!)"))
    for lang in languages.LANGUAGES:
        chosen = chosen.when(which == lang, F.lit(one(lang)))
    return chosen.otherwise("()(?!)")


def _behind(which: Column | str, hints, name: str) -> Column:
    """A regex whose first group is a name behind one of a language's hints and white space."""
    return _hint_regex(which, lambda lang: rf"(?<!{WORD})(?:{'|'.join(sorted(hints(lang)))})(?={SPACE}+({name}))")


def _hinting(which: Column | str, hints) -> Column:
    """A regex that matches one of a language's hints, its first group, and the white space between it and a word."""
    return _hint_regex(which, lambda lang: rf"(?<!{WORD})({'|'.join(sorted(hints(lang)))}){SPACE}+(?={WORD})")


def _holds(words: Column, which: Column | str, hints) -> Column:
    """Whether a hint may stand among the words of a row; those that no name looks like are taken to."""

    def one(lang: str) -> Column:
        listed = sorted(hints(lang))
        return F.arrays_overlap(words, F.array(*map(F.lit, listed))) if all(re.fullmatch(NAME.replace("++", "+").replace("*+", "*"), h) for h in listed) else F.lit(True)

    return one(which) if isinstance(which, str) else languages._by_language(which, one)


def _joined(keep) -> Column:
    """The segments that ``keep`` takes by their index, as one text."""
    return F.array_join(F.filter("__segs", lambda s, i: keep(lambda flag: F.get(F.col(flag), i))), _SEAM)


def _sql(text: str) -> str:
    return "r'" + text + "'"


def _by_language(which: Column | str, pick) -> str:
    """SQL of a condition for one language, or told by the column ``language`` of a row."""
    if isinstance(which, str):
        return pick(which)
    return "case language " + " ".join(f"when '{name}' then {pick(name)}" for name in languages.LANGUAGES) + " else false end"


def _found_by_word(which: Column | str) -> Column:
    """The maskable names of a row, each behind the digit of its role, once for each of its roles, by first place.

    Over the row's arrays ``__segs``, ``__comment``, ``__string`` and ``__module``, and ``language`` unless one is
    named. What :func:`occurrences` tells row by row is told here within the row, so nothing is shuffled.
    """
    listed = lambda words: "(" + ", ".join(repr(w) for w in sorted(words)) + ")"
    among = lambda x, words: lambda lang: f"{x} in {listed(words(lang))}"
    keyword = lambda lang: f"(t in {listed(languages.keywords(lang))}" + (f" or lower(t) in {listed(languages.keywords(lang))})" if lang in languages.CASE_INSENSITIVE else ")")
    gap, before, tail = "get(g.tails, i - 1)", "get(g.tokens, i - 1)", "get(g.tails, i)"
    # Tests that look at a character or a hash come before those that need a pattern.
    behind = f"({gap} = ' ' or {gap} rlike {_sql(f'^{SPACE}+' + chr(92) + 'z')})"
    capitals = r"(upper(t) = t and t rlike r'^[A-Z][A-Z0-9_]*\z')"
    placeholder = f"(startswith(t, '__') and t rlike {_sql(PLACEHOLDER_TOKEN)})"
    named = f"length(t) > 2 and not substring(t, 1, 1) between '0' and '9' and not {_by_language(which, keyword)} and not {capitals} and not {placeholder}"
    call = f"(contains({tail}, '(') and {tail} rlike {_sql(f'^{SPACE}*' + chr(92) + '(')})"
    p = ROLE_PRIORITY
    role = f"""case when g.string then if(g.module, {p["package"]}, {p["string"]})
        when {_by_language(which, among(before, languages.class_hints))} and {behind} then {p["class"]}
        when {_by_language(which, among(before, languages.function_hints))} and {behind} or {call} then {p["function"]}
        when substring(t, 1, 1) between 'A' and 'Z' and upper(t) <> t then {p["class"]} else {p["variable"]} end"""
    segment = f"""transform(arrays_zip(__segs, __comment, __string, __module), s -> named_struct('comment', s.__comment, 'string', s.__string, 'module', s.__module,
        'tokens', regexp_extract_all(s.__segs, {_sql(_RUN)}, 1), 'tails', regexp_extract_all(s.__segs, {_sql(_RUN)}, 2)))"""
    tokens = f"filter(transform(g.tokens, (t, i) -> case when {named} then concat({role}, t) end), x -> x is not null)"
    return F.expr(f"array_distinct(flatten(transform({segment}, g -> if(g.comment, cast(array() as array<string>), {tokens}))))")


def found_names(which: Column | str, every: bool = False) -> Column:
    """The maskable names of a row, each behind the digit of its role, once for each of its roles, by first place.

    Over the row's arrays ``__segs``, ``__comment``, ``__string`` and ``__module``, and ``language`` unless one is
    named. What :func:`occurrences` tells word by word is told here by a few searches of the row, so nothing is shuffled
    and roles are told of distinct names. With ``every`` all identifiers that have a role are found, in any order.
    """
    if not every and not isinstance(which, str):
        # Searches that differ by language make a plan too large; each word is told within the row instead.
        return _found_by_word(which)
    name, p, none = ANY_NAME if every else NAME, ROLE_PRIORITY, F.array().cast("array<string>")
    as_role = lambda names, role: F.transform(names, lambda t: F.concat(F.lit(str(p[role])), t))
    plain = lambda names: names if every else _no_keyword(names, which)
    capital = lambda t: F.substring(t, 1, 1).between("A", "Z") & (F.upper(t) != t)
    by_shape = lambda names: F.transform(names, lambda t: F.concat(F.when(capital(t), str(p["class"])).otherwise(str(p["variable"])), t))

    def in_code(code: Column, words: Column, functions: Column) -> Column:
        """Names by their shape; where some stand as functions, only capitals that also stand elsewhere are classes by it."""
        marked = F.regexp_replace(F.translate(code, _MARK, _SEAM), _hinting(which, languages.function_hints), F.lit("$1" + _MARK))
        elsewhere = _distinct(marked, rf"(?<!{_MARK}){name}(?!{SPACE}*+\()")
        apart = F.concat(as_role(_no_keyword(words, which), "variable"), as_role(_no_keyword(F.filter(elsewhere, capital), which), "class"))
        return F.when(F.size(functions) > 0, apart).otherwise(by_shape(_no_keyword(words, which)))

    def told(x: Column, words: Column) -> Column:
        code, strings, module = x["code"], x["strings"], x["module"]
        calls = F.when(F.contains(code, F.lit("(")), _distinct(code, rf"({name}){SPACE}*+\(", 1)).otherwise(none)
        behind = lambda hints: F.when(_holds(words, which, hints), _distinct(code, _behind(which, hints, name), 1)).otherwise(none)
        functions = F.concat(behind(languages.function_hints), calls)
        classes = behind(languages.class_hints)
        # With strings, all names come first as of the weakest role: that keeps their order.
        quoted = F.when(strings != "", as_role(plain(_distinct(strings if every else x["all"], name)), "string")).otherwise(none)
        modules = F.when(module != "", as_role(plain(_distinct(module, name)), "package")).otherwise(none)
        strong = lambda found: F.concat(as_role(_no_keyword(found, which), "function"), as_role(_no_keyword(classes, which), "class"))
        return _let(functions, lambda found: F.array_distinct(F.concat(quoted, in_code(code, words, found), modules, strong(found))))

    texts = F.struct(
        _joined(lambda has: ~has("__comment")).alias("all"),
        _joined(lambda has: ~has("__comment") & ~has("__string")).alias("code"),
        _joined(lambda has: has("__string")).alias("strings"),
        _joined(lambda has: has("__module")).alias("module"),
    )
    return _let(texts, lambda x: _let(_distinct(x["code"], name), lambda words: told(x, words)))


def names_in(which: Column | str) -> Column:
    """The distinct maskable names of a row by first place, over ``__segs`` and ``__comment``."""
    return _no_keyword(_distinct(_joined(lambda has: ~has("__comment")), NAME), which)


def cut(docs: DataFrame, text: str, which: Column | str) -> DataFrame:
    """``docs`` with ``__segs``, the segments of a text, and ``__comment``, ``__string`` and ``__module`` for each of them."""
    out = docs.withColumn("__segs", segments.segments(F.coalesce(F.col(f"`{text}`"), F.lit("")), which))
    out = out.withColumn("__comment", F.transform("__segs", lambda s: segments.is_comment(s, which))).withColumn("__string", F.transform("__segs", lambda s: segments.is_string(s, which)))
    return out.withColumn("__module", F.zip_with("__string", segments.before("__segs"), lambda s, front: s & segments.names_module(front)))


def _keyed(docs: DataFrame, key: str, text: str, which: Column | str) -> DataFrame:
    """``key``, ``language`` and the arrays of :func:`cut` for each text."""
    lang = F.lit(which) if isinstance(which, str) else which
    return cut(docs.select(F.col(key).alias("key"), lang.alias("language"), F.col(text).alias("__text")), "__text", which if isinstance(which, str) else F.col("language"))


def names(docs: DataFrame, key: str, text: str, which: Column | str, every: bool = False) -> DataFrame:
    """(key, token, priority, at): the names of :func:`found_names` as rows, with their places in that order."""
    found = found_names(which if isinstance(which, str) else F.col("language"), every)
    rows = _keyed(docs, key, text, which).select("key", F.posexplode(found).alias("at", "x"))
    return rows.select("key", F.expr("substring(x, 2)").alias("token"), F.substring("x", 1, 1).cast("int").alias("priority"), "at")


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", language: Column | str = languages.DEFAULT) -> DataFrame:
    """(key, name, ord) of the distinct maskable identifiers of each text, longest first, then by first place."""
    found = names_in(language if isinstance(language, str) else F.col("language"))
    row = _keyed(docs, key, text, language).select("key", F.posexplode(found).alias("at", "token"))
    # Dealt by key alone, so that what groups or joins by it moves nothing again.
    first = row.repartition("key").groupBy("key", "token").agg(F.min("at").alias("at"))
    order = Window.partitionBy("key").orderBy(F.length("token").desc(), "at")
    return first.select(F.col("key").alias(key), F.col("token").alias("name"), F.row_number().over(order).alias("ord"))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", language: Column | str = languages.DEFAULT) -> DataFrame:
    """(key, name, role) of every identifier with a role, the strongest over its occurrences."""
    row = names(docs, key, text, language, every=True)
    return row.groupBy("key", "token").agg(F.max("priority").alias("p")).select(F.col("key").alias(key), F.col("token").alias("name"), role_name(F.col("p")).alias("role"))
