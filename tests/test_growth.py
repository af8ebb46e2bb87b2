"""What keeps the work in proportion to the input, and that the results stay what they were."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskworks.functions import grammar, languages, textswap
from maskworks.functions.grammar import NUMBERED
from maskworks.operators import anonymize, identifiers, legend, rules


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_meet_names_by_place_and_literal(spark):
    some = ["^Abcdef", "^Abcdef$", "xyz$", "wxyz$", "mid", "a.c", "^", "$", "x?y", "^ab*", "(q|r)s"]
    met = spark.createDataFrame([(p,) for p in some], "p string").select("p", rules._meeting(F.col("p")).alias("m"))
    assert {r["p"]: tuple(r["m"]) for r in met.collect()} == {
        "^Abcdef": ("^", "Abcd"), "^Abcdef$": ("^", "Abcd"), "xyz$": ("$", "xyz"), "wxyz$": ("$", "wxyz"), "mid": ("", "mid"), "a.c": ("", "c"),
        "^": ("", ""), "$": ("", ""), "x?y": ("", "y"), "^ab*": ("", "a"), "(q|r)s": ("", ""),
    }


def test_repeated_rules_equal_trying_all(spark):
    deal = random.Random(5)
    word = lambda n: "".join(deal.choice("abc") for _ in range(n))
    names = [(deal.choice(["x", "y", None]), word(deal.randint(1, 9)) + deal.choice(["", "", "", "\n", "\r\n"])) for _ in range(300)] + [("x", None), ("x", "")]
    forms = ("^{}", "{}$", "{}", "^{}$", "({})", "{}?", "{}+b", "^.{}")
    table = [(i, deal.choice(["x", "y", None]), deal.choice(["whitelist", "replace", "replace"]), deal.choice(forms).format(word(deal.randint(1, 6))), f"__R{i}__", i % 9 != 0, i % 4) for i in range(200)]
    found = rules.matched(spark.createDataFrame(names, "lang string, name string"), spark.createDataFrame(table, rules.RULES), "name", "lang")

    def first(lang, name):
        ends = re.compile(r"\$$")
        hits = [(t != "whitelist", o, i) for i, s, t, p, _, on, o in table if on and s in (None, lang) and name is not None and re.search(ends.sub(r"(?=(?:\\r\\n|[\\r\\n])?\\Z)", p) if p.endswith("$") else p, name)]
        return min(hits)[2] if hits else None

    assert sorted((str(r["lang"]), str(r["name"]), r["rule_id"]) for r in found.collect()) == sorted((str(a), str(n), first(a, n)) for a, n in names)


TEXTS = [
    "class Foo extends bar { function run(x) { return new Widget (x) } }\nimport x from 'left-pad'; const s = \"class Foo words new\"; // comment Name here\nrun(); Other\t(1)",
    "def main(arg): pass\nfrom a import b # note\nclass Klass(Base):\n  '''doc Words'''\n  x = 'quoted Klass main'\n",
    "SELECT Total from ORDERS where Name = 'Ann' -- hidden\ncreate table Things (Id int); /* gone */ create function doit ()",
    "fn walk(a: u8) -> Result { struct Inner; enum Kind {} } type Alias = Kind; interface class Deep",
    "12abc abc12 __CLS__1 __X__ ABC A_B Ab aB $x __x_y _z é fooé barclass class Baz class;Qux function \n\n tail function'quoted' call /* c */ (x)",
    "don't say 'twice' twice `tick ${name}` new new New", "", None, "a", "'", "require('pkg name') import(\"lib\") from 'mod'", "class", "async def go(): func  Run() {}",
]


@pytest.mark.parametrize("language", [*sorted(languages.LANGUAGES), None])
def test_names_within_the_row_equal_word_by_word(spark, language):
    langs = sorted(languages.LANGUAGES)
    rows = [(i, t, langs[i % len(langs)]) for i, t in enumerate(TEXTS * (1 if language else 4))]
    docs = spark.createDataFrame(rows, "k long, text string, lang string").coalesce(1)
    which = language or F.col("lang")
    # All words one by one, and all names of each row at once.
    slow = identifiers.occurrences(docs, "k", "text", which).select("key", "token", "named", "priority", "seg", "idx").collect()
    roles, first = {}, {}
    for r in slow:
        if r["priority"] is not None:
            roles[r["key"], r["token"]] = max(roles.get((r["key"], r["token"]), 0), r["priority"])
        if r["named"]:
            first.setdefault(r["key"], {}).setdefault(r["token"], []).append((r["seg"], r["idx"]))
    order = [(k, n) for k, at in first.items() for n in sorted(at, key=lambda n, at=at: (-len(n), min(at[n])))]
    assert {(r["key"], r["token"]): r["p"] for r in identifiers.names(docs, "k", "text", which, every=True).groupBy("key", "token").agg(F.max("priority").alias("p")).collect()} == roles
    named = identifiers.names(docs, "k", "text", which).groupBy("key", "token").agg(F.max("priority").alias("p"), F.min("at").alias("at")).collect()
    assert {(r["key"], r["token"]): r["p"] for r in named} == {x: roles[x] for x in order}
    by_place = sorted(named, key=lambda r: (r["key"], -len(r["token"]), r["at"]))
    assert [(r["key"], r["token"]) for r in by_place] == sorted(order, key=lambda x: x[0])
    got = identifiers.extract(docs, "k", "text", which).collect()
    assert sorted(((r["k"], r["ord"], r["name"]) for r in got)) == [(k, 1 + [n for j, n in order if j == k].index(n), n) for k, n in sorted(order, key=lambda x: x[0])]


def test_names_are_grouped_by_hashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (identifiers.extract(docs), identifiers.classify(docs), anonymize.corpus_symbols(docs, language="typescript")):
        assert "SortAggregate" not in plan(df)


def test_legend_tells_bases_once(spark):
    docs = spark.createDataFrame([("__CLS__1 __X__2",)], "text string").withColumn("s", anonymize.entries_of({"__CLS__1": "a", "__X__2": "b", "odd": "c", "__CLS__3": "d"}))
    told = docs.select(legend.legend(F.col("s"), F.col("text")).alias("told"), legend.legend(F.col("s")).alias("all"))
    assert told._jdf.queryExecution().analyzed().toString().count(NUMBERED) == 2
    assert told.first()["told"] == "Placeholder legend: __CLS__* are class or type names (1); __X__* are project-specific identifiers (1)."


def test_corpus_names_are_grouped_once(spark, sf):
    """Names are grouped by name alone, and what counts and what places them is one grouping, so texts are searched once."""
    shown = plan(anonymize.corpus_symbols(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), language="typescript"))
    made = re.findall(r"HashAggregate\(keys=\[token#[^\]]*\], functions=\[[^\n]{,40}", shown)
    assert made and all("keys=[token#" in x and "key#" not in x and "min(place#" in x for x in made)


def test_corpus_symbols_of_extreme_and_equal_keys(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(most, "lastName bothName"), (least, "xx firstName firstName()"), (-1, "new midName firstName"), (0, "midName zeroName"), (0, "new zeroName()")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["first_key"], r["placeholder"], r["name"]) for r in anonymize.corpus_symbols(docs, language="typescript").collect()}
    # Of names as long as each other the first in the text comes first; documents with one key are as one.
    assert got == {(least, "__FN__1", "firstName"), (-1, "__CLS__1", "midName"), (0, "__CLS__2", "zeroName"), (most, "__VAR__1", "lastName"), (most, "__VAR__2", "bothName")}


def test_names_numbered_by_batch_equal_row_by_row():
    deal, lists = random.Random(3), pa.list_(pa.string())
    word = lambda: deal.choice("abAB") + "".join(deal.choice("ab_1") for _ in range(deal.randint(2, 5)))
    own = {"a": None, "b": "", "A": "__X__", "B": "__CLS__"}
    for trial in range(60):
        rows = [None if deal.random() < 0.2 else list(dict.fromkeys(str(deal.randrange(5)) + word() for _ in range(deal.choice([0, 3, 20, 60])))) for _ in range(deal.randint(0, 8))]
        bases = [None if x is None else [own[n[1]] for n in x] for x in rows] if trial % 2 else None
        known = [[] if deal.random() < 0.6 or not x else [(f"__VAR__{i + 3}", n[1:]) for i, n in enumerate(x[:3])] for x in rows]
        held = [[] if deal.random() < 0.7 else ["__CLS__9", "__X__4", f"__VAR__{(1 << 63) - 1}"] for _ in rows]
        want = [textswap.number_names(f or [], k, h, bases[i] if bases else None) for i, (f, k, h) in enumerate(zip(rows, known, held, strict=True))]
        carried = [pa.array([[e[i] for e in k] for k in known], lists) for i in (0, 1)]
        got, whole = textswap._numbered(pa.array(rows, lists), *carried, pa.array(held, lists), None if bases is None else pa.array(bases, lists))
        assert got.to_pylist() == [[{"placeholder": p, "name": n, "ord": i} for i, (n, p) in enumerate(list(zip(a, b, strict=True))[:c])] for a, b, c in want]
        assert all((a, b) == want[i][:2] for i, (a, b) in whole.items())


def test_words_swapped_by_pieces_equal_word_by_word():
    segments, keep, swap = ["x  foo bar,foo\nbar  12foo foo ", "'foo  bar'", " foo", "", "foo"], [False, False, True, False, False], {"foo": "__A__1", "bar": "__A__2"}
    want = "".join(s if k else re.sub("[A-Za-z0-9_$]+", lambda m: swap.get(m[0], m[0]), s) for s, k in zip(segments, keep, strict=True))
    assert textswap._swapped(segments, keep, list(swap), list(swap.values())) == want
    # Each distinct piece between spaces is cut into words once.
    made = textswap._Swap(list(swap), list(swap.values()))
    assert [made[x] for x in ("a,foo", "foo", "zzz", "a,foo")] == ["a,__A__1", "__A__1", "zzz", "a,__A__1"] and set(made) == {"foo", "bar", "a,foo", "zzz"}


def test_literal_rules_need_no_regex(spark):
    some = ["^Th", "ing$", "tion", "^exact$", "a.c", "x?y", "^", "$", "(q|r)s"]
    names = ["Thing", "thTh", "ring", "ingot", "nations", "exact", "exactly", "abc", "y", "qs", "$", "T_h"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    both = table.select("n", *[rules._matches(F.col("n"), p).alias(f"a{i}") for i, p in enumerate(some)], *[F.col("n").rlike(p).alias(f"b{i}") for i, p in enumerate(some)])
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in both.collect() for i in range(len(some)))
    shown = plan(table.select(rules.whitelisted(F.col("n"), [rules.Rule("whitelist", "^Th")]), rules.replacement_base(F.col("n"), [rules.Rule("replace", "ing$", "__A__"), rules.Rule("replace", "tion", "__B__")])))
    assert "RLIKE" not in shown.upper()


def test_placeholders_are_looked_for_by_their_beginning(spark):
    deal = random.Random(7)
    texts = ["".join(deal.choice(["__", "_", "A", "X9", "1", " ", "$", "b", "é", "__A__1", "__B_C__"]) for _ in range(deal.randrange(14))) for _ in range(2000)]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    found = grammar.placeholders_in(F.col("t"))
    assert f"(?<!{grammar.WORD})__" not in plan(table.select(found))
    want = table.select(found.alias("a"), F.regexp_extract_all("t", F.lit(grammar.PLACEHOLDER_SCAN), F.lit(0)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in want) and sum(len(r["a"]) for r in want) > 100
