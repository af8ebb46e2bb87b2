"""Custom rules: names to leave alone and names with placeholders of their own."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``type`` is "whitelist" or "replace"; a pattern matches anywhere in a name; lower ``sort_order`` comes first."""

    type: str
    pattern: str
    placeholder: str | None = None
    enabled: bool = True
    sort_order: int = 0
    name: str = ""


def usable(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """Enabled rules in order; a pattern that Java refuses matches nothing, so its rule goes."""
    compiled = spark.sparkContext._jvm.java.util.regex.Pattern

    def valid(rule: Rule) -> bool:
        if not rule.enabled:
            return False
        try:
            compiled.compile(rule.pattern)
        except Exception:  # noqa: BLE001  py4j wraps the syntax error
            return False
        return True

    return sorted(filter(valid, rules), key=lambda r: r.sort_order)


#: A literal, with an anchor in front or behind.
_LITERAL = re.compile(r"(\^?)([A-Za-z0-9_]+)(\$?)").fullmatch


def _matches(name: Column, pattern: str) -> Column:
    """Whether a pattern matches an identifier, which holds no line end; literals are looked for without a regex."""
    if not (told := _LITERAL(pattern)):
        return name.rlike(pattern)
    front, literal, end = told.groups()
    if front and end:
        return name == literal
    return name.startswith(literal) if front else name.endswith(literal) if end else F.contains(name, F.lit(literal))


def whitelisted(name: Column, rules: list[Rule]) -> Column:
    """Whether a whitelist rule matches a name."""
    found = F.lit(False)
    for rule in rules:
        if rule.type == "whitelist":
            found = found | _matches(name, rule.pattern)
    return found


def replacement_base(name: Column, rules: list[Rule]) -> Column:
    """The placeholder base of the first replace rule that matches a name, else null."""
    found = F.when(name.isNull(), F.lit(None).cast("string"))
    for rule in rules:
        if rule.type == "replace":
            found = found.when(_matches(name, rule.pattern), F.lit(rule.placeholder))
    return found


#: A rule table: as :class:`Rule`, with an id, and a scope whose rules are its own; a null scope is the whole team's.
RULES = "rule_id long, scope string, type string, pattern string, placeholder string, enabled boolean, sort_order int"
#: The most characters of the literal pieces that names and rules meet by.
PIECE = 4
#: Shares that the names are dealt to which meet the rules without a piece.
SHARES = 64
#: What ``$`` may stand before at the end of a text.
_LINE_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])\z"


def needed_piece(pattern: Column) -> Column:
    """A piece of up to ``PIECE`` characters that every match of a pattern holds; empty where none is told.

    Told are patterns without alternatives, groups, classes, escapes and flags: what stands between anchors, dots and
    quantifiers is literal, but for a character in front of a quantifier, which may be missing.
    """
    simple = ~pattern.rlike(r"[|()\[\]\\{}]")
    parts = F.split(F.regexp_replace(pattern, r".[?*+]+", "\u0000"), r"[\u0000^$.]")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("size"), p.alias("piece"))))
    return F.when(simple, F.substring(longest["piece"], 1, PIECE)).otherwise("")


def _meeting(pattern: Column) -> Column:
    """What names must hold to meet a pattern: a kind and a piece.

    A literal behind ``^`` stands at the beginning of a name ("^"), one before ``$`` at its end ("$"); other pieces stand anywhere ("").
    """
    literal = r"[^|()\[\]\\{}?*+^$.]+"
    first, last = F.regexp_extract(pattern, rf"\A\^({literal})\$?\z", 1), F.regexp_extract(pattern, rf"\A({literal})\$\z", 1)
    front = F.struct(F.lit("^").alias("kind"), F.substring(first, 1, PIECE).alias("piece"))
    end = F.struct(F.lit("$").alias("kind"), F.substring(last, -PIECE, PIECE).alias("piece"))
    return F.when(first != "", front).when(last != "", end).otherwise(F.struct(F.lit("").alias("kind"), needed_piece(pattern).alias("piece")))


def matched(names: DataFrame, rules: DataFrame, name: str = "name", scope: str | None = None) -> DataFrame:
    """``names`` plus ``rule_id``, ``rule_type`` and ``rule_base``: the first rule of a table that matches each name.

    ``rules`` is a table like :data:`RULES`. Rules apply to names of their scope, those without one to all. A
    whitelist rule goes before all replacements, as it keeps the name; among rules of one type the smallest
    (sort_order, rule_id) counts. Of rules with one scope and pattern only the first can count, so the others go at once.
    Distinct names meet rules by the piece of text that a rule needs, and where it must stand, in one equi-join; only
    rules without any literal meet all names. Each pattern is tried only where they meet. Null names
    and names that no rule matches have nulls; a pattern that Java refuses fails the query.
    """
    own = F.col(f"`{scope}`") if scope else F.lit(None).cast("string")
    rank = F.struct((F.col("type") != "whitelist").alias("t"), "sort_order", "rule_id")
    active = rules.where("enabled and pattern is not null").groupBy(F.col("scope").alias("__rule_scope"), "pattern").agg(F.min_by(F.struct("rule_id", "type", "placeholder", "sort_order"), rank).alias("r"))
    active = active.withColumn("__meet", _meeting(F.col("pattern")))
    shares = F.when(F.col("__meet.piece") == "", F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    active = active.select("__rule_scope", "pattern", "r.*", F.col("__meet.kind").alias("__kind"), F.col("__meet.piece").alias("__piece"), F.explode(shares).alias("__share"))
    asked = names.select(F.col(f"`{name}`").alias("__name"), own.alias("__scope")).where("__name is not null").distinct()
    # Of the pieces of a name only those that are as long as some rule's, the empty one included: one row with at most nine sizes.
    sizes = active.agg(F.collect_set(F.concat("__kind", F.length("__piece").cast("string"))).alias("__sizes"))
    whole = F.col("__name")
    bare = F.regexp_replace(whole, _LINE_END, "")
    meet = lambda kind, piece, share=F.lit(0): F.struct(F.lit(kind).alias("kind"), piece.alias("piece"), share.cast("int").alias("share"))
    none = F.array().cast("array<struct<kind:string,piece:string,share:int>>")
    asked_for = lambda kind, n, found: F.when(F.array_contains("__sizes", f"{kind}{n}"), found).otherwise(none)
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: meet("", F.substring(whole, i, F.lit(n))))
    ends = lambda n: F.array(meet("$", F.substring(whole, -n, n)), meet("$", F.substring(bare, -n, n)))
    everywhere = F.array(meet("", F.lit(""), F.pmod(F.hash(whole, "__scope"), F.lit(SHARES))))
    some = [f for n in range(1, PIECE + 1) for f in (asked_for("", n, cut(n)), asked_for("^", n, F.array(meet("^", F.substring(whole, 1, n)))), asked_for("$", n, ends(n)))]
    pieces = F.array_distinct(F.concat(asked_for("", 0, everywhere), *some))
    near = asked.crossJoin(F.broadcast(sizes)).withColumn("__m", F.explode(pieces)).select("__name", "__scope", F.col("__m.kind").alias("__kind"), F.col("__m.piece").alias("__piece"), F.col("__m.share").alias("__share"))
    met = near.join(active, ["__kind", "__piece", "__share"]).where("(__rule_scope is null or __rule_scope <=> __scope) and __name rlike pattern")
    first = met.groupBy("__name", "__scope").agg(F.min_by(F.struct("rule_id", "type", "placeholder"), rank).alias("r"))
    first = first.select("__name", "__scope", F.col("r.rule_id").alias("rule_id"), F.col("r.type").alias("rule_type"), F.when(F.col("r.type") == "replace", F.col("r.placeholder")).alias("rule_base"))
    same = F.col(f"`{name}`") == F.col("__name")
    out = names.drop("rule_id", "rule_type", "rule_base").join(first, same & own.eqNullSafe(F.col("__scope")), "left")
    return out.drop("__name", "__scope")
