"""Masking and restoring: languages, roles, rules, maps, marks, reports."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskworks.functions import grammar, languages, links, secrets, textswap
from maskworks.operators import anonymize as masking
from maskworks.operators import identifiers, legend, manual, restore
from maskworks.operators.rules import RULES, Rule, matched

#: A sample of each language: code, words that stay, words that go.
SAMPLES = {
    "typescript": ("import { helper } from './billing';\nexport interface Invoice { total: number }\nconst invoiceTotal = (a: Invoice) => helper(a); // Invoice note\n", ["import", "const", "number"], ["Invoice", "invoiceTotal", "billing"]),
    "python": ("from billing.core import ledger\n\nclass LedgerBook:\n    \"\"\"LedgerBook prose.\"\"\"\n    def post_entry(self, amount):\n        # post_entry comment\n        return None\n", ["class", "def", "self", "None"], ["post_entry", "amount"]),
    "go": ("package ledger\n\nfunc PostEntry(amount int64) error {\n\terr := store(amount)\n\tif err != nil { return err }\n\treturn nil\n}\n", ["package", "func", "nil", "int64"], ["PostEntry", "amount"]),
    "java": ("import java.util.List;\npublic class LedgerBook {\n  @Override public String toString() { return owner; }\n  public static void main(String[] args) { System.out.println(ownerName); }\n}\n", ["public", "String", "System"], ["LedgerBook", "ownerName"]),
    "csharp": ("using System;\nnamespace Ledger.Core {\n  public class EntryBook { public int Amount { get; set; } }\n}\n", ["using", "namespace", "get"], ["EntryBook", "Amount"]),
    "rust": ("pub struct EntryBook { amount: u64 }\nimpl EntryBook {\n    pub fn post(&self) -> Result<u64, String> { let mut sumTotal = 1; Ok(sumTotal) }\n}\n", ["pub", "struct", "impl", "Result"], ["EntryBook", "sumTotal"]),
    "ruby": ("require 'ledger'\nclass EntryBook\n  attr_reader :amount\n  def post_entry\n    puts @amount unless closed\n  end\nend\n", ["class", "def", "puts", "end"], ["EntryBook", "post_entry"]),
    "php": ("<?php\nnamespace Ledger;\nclass EntryBook { public function post($amount) { $this->totalSum = $amount; echo $amount; } }\n", ["namespace", "class", "function", "echo"], ["EntryBook", "totalSum"]),
    "c": ("#include <stdio.h>\ntypedef struct { int amount; } EntryBook;\nint main(void) { printf(\"%d\", total_sum); return 0; }\n", ["include", "struct", "printf", "return"], ["EntryBook", "total_sum"]),
    "sql": ("SELECT amount_due FROM ledger_entries WHERE owner_id = 1 GROUP BY amount_due; -- ledger note\n", ["SELECT", "FROM", "GROUP"], ["amount_due", "ledger_entries"]),
}


def run(spark, texts, symbols=None, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    if symbols is not None:
        docs, options = docs.withColumn("kept", masking.entries_of(symbols)), options | {"known": "kept"}
    return masking.anonymize(docs, **({"language": "typescript"} | options)).orderBy("i").collect()


def symbols_of(row):
    return {e["placeholder"]: e["name"] for e in row["symbols"]}


def test_every_language_is_detected_masked_and_restored(spark):
    docs = spark.createDataFrame([(name, code) for name, (code, _, _) in SAMPLES.items()], "name string, text string")
    back = restore.restore(masking.anonymize(docs), "anonymized", strip="none")
    for r in back.collect():
        _, keep, mask = SAMPLES[r["name"]]
        assert r["language"] == r["name"] and r["restored"] == r["text"]
        words = set(r["anonymized"].replace("(", " ").replace(";", " ").replace("{", " ").split())
        assert all(any(k in w for w in words) for k in keep), r["anonymized"]
        assert set(mask) <= {e["name"] for e in r["symbols"]}


def test_roles_numbers_and_comments(spark):
    rows = run(spark, ["class PaymentHub { submitPayment() {} go2() {} }", "foo.barLonger(); new Widget(); // barLonger", "", None, "let x = 1 + 2"], language="typescript")
    assert rows[0]["anonymized"] == "class __CLS__1 { __FN__1() {} __FN__2() {} }"
    assert symbols_of(rows[0]) == {"__FN__1": "submitPayment", "__CLS__1": "PaymentHub", "__FN__2": "go2"}
    assert rows[1]["anonymized"] == "__VAR__1.__FN__1(); new __CLS__1(); // barLonger"
    assert (rows[2]["anonymized"], rows[2]["identifier_count"]) == ("", 0) and rows[3]["anonymized"] is None
    assert rows[4]["anonymized"] == "let x = 1 + 2"


def test_strings_and_module_specifiers(spark):
    code = "import thing from 'lodash';\nconst other = require( 'lodash' ); const text = \"lodash words\";"
    assert "__PKG__1" in symbols_of(run(spark, [code])[0]) and symbols_of(run(spark, [code])[0])["__PKG__1"] == "lodash"
    assert symbols_of(run(spark, ["const label = 'secretWord'"])[0])["__STR__1"] == "secretWord"
    long = "const label = '" + "a" * 40_000 + "\\'" * 1000
    assert run(spark, [long])[0]["identifier_count"] == 2


def test_masked_text_is_left_alone_and_counted_on(spark):
    rows = run(spark, ["class __CLS__1 { __FN__3() {} }", "class NewThing extends __CLS__4 {} // __CLS__9"])
    assert rows[0]["anonymized"] == "class __CLS__1 { __FN__3() {} }" and not rows[0]["symbols"]
    assert symbols_of(rows[1]) == {"__CLS__10": "NewThing"}


def test_existing_maps_are_reused_and_carried(spark):
    rows = run(spark, ["class Alpha extends BetaClass {}"], {"__CLS__5": "Alpha", "__P7__": "GammaOld", "__CLS__1": "DeltaOld"})
    assert rows[0]["anonymized"] == "class __CLS__5 extends __CLS__6 {}" and rows[0]["identifier_count"] == 4
    assert [e["placeholder"] for e in rows[0]["symbols"]] == ["__CLS__5", "__P7__", "__CLS__1", "__CLS__6"]
    again = run(spark, ["Alpha"], {"__CLS__1": "Alpha", "__VAR__2": "Alpha"})
    assert again[0]["anonymized"] == "__VAR__2"


def test_rules(spark):
    rules = [Rule("replace", "^acme", "__CORP__", sort_order=2), Rule("replace", "acmeBank", "__BANK__", sort_order=1), Rule("whitelist", "Keep"), Rule("replace", "(", "__BAD__"), Rule("replace", "other", "__OFF__", enabled=False)]
    row = run(spark, ["acmeBankCore acmeShop KeepMe otherName acmeKeep"], rules=rules)[0]
    assert symbols_of(row) == {"__BANK__1": "acmeBankCore", "__CORP__1": "acmeShop", "__VAR__1": "otherName"}
    assert "KeepMe" in row["anonymized"] and "acmeKeep" in row["anonymized"]


def test_marks_by_hand(spark):
    row = run(spark, ["// call Kowalska (88412) a.c axc\nfn(__FN__1)"], marks=["Kowalska", " ", "88412", "a.c", "FN", "Kowalska", "absent"])[0]
    assert row["anonymized"].startswith("// call __MANUAL__1 (__MANUAL__2) __MANUAL__3 axc") and "__FN__1" in row["anonymized"]
    assert symbols_of(row)["__MANUAL__5"] == "absent"
    key = "sk_" + "live_" + "a1B2" * 6
    with pytest.raises(manual.ManualMaskError) as refused:
        run(spark, ["x"], marks=[key])
    assert key not in str(refused.value) and refused.value.term == key
    with pytest.raises(manual.ManualMaskError):
        run(spark, ["x"], marks=["__FN__1"])
    for term in ["ok_term", "acct_88412037", "settlementAccount", "a.c", "FN"]:
        run(spark, ["x"], marks=[term])
    again = run(spark, ["Kowalska again"], {"__MANUAL__1": "Kowalska"})[0]
    assert again["anonymized"] == "__MANUAL__1 __VAR__1"


def test_unmask_is_literal_and_guards_digits(spark):
    docs = spark.createDataFrame([("__MANUAL__1 __MANUAL__10",)], "text string").withColumn("known", masking.entries_of({"__MANUAL__1": "a$1\\b", "__MANUAL__10": "z"}))
    row = manual.unmask(docs, "__MANUAL__1").first()
    assert row["text"] == "a$1\\b __MANUAL__10" and [e["placeholder"] for e in row["known"]] == ["__MANUAL__10"]
    assert manual.unmask(docs, "__MANUAL__7").first()["text"] == "__MANUAL__1 __MANUAL__10"


def test_secrets_are_redacted_for_good(spark):
    stripe = "sk_" + "live_" + "a1B2" * 6
    texts = [f'const apiKey = "{stripe}"; again("{stripe}")', 'password = "correcthorse"', "{ token: session.token }", "const credentials = request.body", "mail me at a.b@example.com from 10.0.0.8", f'data:{"a" * 40_000}']
    rows = run(spark, texts)
    assert rows[0]["anonymized"].count("__REDACTED_STRIPE_KEY_1__") == 2 and stripe not in str(rows[0]["symbols"]) + str(rows[0]["secrets"])
    assert [(s["type"], s["severity"], s["redacted"]) for s in rows[0]["secrets"]][0] == ("STRIPE_KEY", "critical", True)
    assert [(s["severity"], s["redacted"]) for s in rows[1]["secrets"]] == [("medium", False)]
    assert rows[2]["secrets"] == rows[3]["secrets"] == rows[5]["secrets"] == []
    assert {s["type"] for s in rows[4]["secrets"]} == {"EMAIL", "PRIVATE_IP"}
    assert stripe in run(spark, texts[:1], policy="warn")[0]["anonymized"] or run(spark, texts[:1], policy="warn")[0]["secrets"][0]["redacted"] is False
    assert run(spark, texts[:1], policy="off")[0]["secrets"] == []
    assert spark.range(1).select(secrets.has_blocking(F.lit(stripe))).first()[0] is True


def test_assigned_values_of_any_length_are_reported(spark):
    long = "aZ09" * 75
    rows = run(spark, [f'secret = "{long}"', 'password = "correct-horse-battery-staple"', "token = 'abcdefghijklmnopqrstuvwxyz'", 'token = "a b c d e f g h"', f"auth_key = '{'x' * 500}'"])
    assert [(s["type"], s["redacted"]) for s in rows[0]["secrets"]] == [("ASSIGNED_SECRET", True)] and long not in rows[0]["anonymized"]
    assert [[(s["type"], s["severity"]) for s in r["secrets"]] for r in rows[1:]] == [[("POSSIBLE_CREDENTIAL", "medium")]] * 2 + [[]] + [[("POSSIBLE_CREDENTIAL", "medium")]]


def test_stripped_items_by_type_show_the_first_few(spark):
    docs = spark.createDataFrame([(1, "// TODO: a\n// TODO: b\n// TODO: c\n// TODO: d\n// ----\nkept();"), (2, "none();"), (3, None)], "k int, text string")
    back = restore.restore(docs.withColumn("symbols", masking.entries_of({})), strip=None)
    rows = {(r["k"], r["type"]): (r["n"], [s.strip() for s in r["shown"]]) for r in restore.stripped_by_type(back, "k").collect()}
    assert rows == {(1, "todo"): (4, ["// TODO: a", "// TODO: b", "// TODO: c"]), (1, "separator"): (1, ["// ----"])}


def test_restore_strips_tidies_and_reports(spark):
    reply = "/** doc\n * two */\nclass __CLS__1 {\n  // TODO: x\n  // Getter\n  // Step 2. y\n  // ----- \n  // **Head**\n  // @returns z\n  // plain\n}\n\n\n\n\n__CLS__10 __FN__9 __REDACTED_JWT_1__ __fn__1"
    docs = spark.createDataFrame([(reply,), (None,)], "text string").withColumn("symbols", masking.entries_of({"__CLS__1": "Alpha", "__FN__1": "beta", "__VAR__1": "$1"}))
    row, null = restore.restore(docs, strip=None).collect()
    assert [i["type"] for i in row["stripped_items"]] == list(restore.STRIPPABLE_TYPES) and row["stripped_count"] == 7
    assert "// plain" in row["restored"] and "\n\n\n" not in row["restored"] and "class Alpha {" in row["restored"] and "Alpha0" in row["restored"]
    assert (row["report"]["resolved"], row["report"]["missing"], row["report"]["unresolved"]) == (["__CLS__1"], ["__FN__1", "__VAR__1"], ["__FN__9"])
    assert null["restored"] is None and null["report"]["missing"] == ["__CLS__1", "__FN__1", "__VAR__1"]
    bare = restore.restore(docs, strip="none").first()
    assert bare["restored"].count("//") == reply.count("//") and bare["stripped_count"] == 0
    assert "__CLS__10" in restore.restore(docs, strip="none", strict=True).first()["restored"]
    assert restore.strip_set(["todo"]) == ("todo",) and "jsdoc" not in restore.strip_option(True)


def test_legend_names_no_names(spark):
    docs = spark.createDataFrame([("__FN__1 x",)], "text string").withColumn("s", masking.entries_of({"__ZED__1": "q", "__FN__1": "a", "__FN__2": "b", "__CLS__1": "c", "__P1__": "d"}))
    row = docs.select(legend.legend(F.col("s")).alias("all"), legend.legend(F.col("s"), F.col("text")).alias("part"), legend.with_preamble(F.col("text"), F.col("s")).alias("told")).first()
    assert row["all"] == "Placeholder legend: __CLS__* are class or type names (1); __FN__* are function or method names (2); __ZED__* are project-specific identifiers (1)."
    assert row["part"] == "Placeholder legend: __FN__* are function or method names (1)." and row["told"].endswith("\n\n__FN__1 x")


def test_placeholder_grammar(spark):
    tokens = {"__CLS__1": True, "__P1__": True, "__A__": True, "__REDACTED_X_1__": True, "__init__": False, "__proto__": False, "__CLS__1x": False, "x__CLS__1": False, "__CLS__1\n": False, "": False}
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", grammar.is_placeholder(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == tokens


def test_extract_and_classify(spark):
    docs = spark.createDataFrame([(1, "new Foo(); fooBar(); café 9abc ALL_CAPS ab __CLS__1 $money // hidden"), (2, None)], "doc_id int, text string")
    assert [r["name"] for r in identifiers.extract(docs).orderBy("ord").collect()] == ["fooBar", "$money", "Foo", "caf"]
    assert {r["name"]: r["role"] for r in identifiers.classify(docs).collect()}["Foo"] == "class"


def test_detection_ties_and_empty(spark):
    rows = spark.createDataFrame([("",), (None,), ("plain words",)], "t string").select(languages.guess(F.col("t")).alias("g")).collect()
    assert all((r["g"]["language"], r["g"]["score"], r["g"]["fallback"]) == ("typescript", 0, True) for r in rows)
    assert [len(languages.keywords(x)) for x in languages.LANGUAGES] == [285, 242, 195, 219, 231, 221, 185, 206, 232, 198]


def test_safe_links(spark):
    cases = {"https://a.b": "https://a.b", " /x": "/x", "//evil": None, "java\tscript:x": None, "#top": "#top", "MAILTO:a@b": "MAILTO:a@b", "": None, "ht\ntps://a": "https://a", "data:x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", links.safe_href(F.col("h")).alias("s")).collect()
    assert {r["h"]: r["s"] for r in rows} == cases


def test_corpus_scope_equals_a_fold(spark):
    texts = ["alphaName betaName __VAR__7", "betaName gammaName", None, "__VAR__30 deltaName alphaName", "epsilonName"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["name"]: r["placeholder"] for r in masking.corpus_symbols(docs, language="typescript").collect()}
    symbols: dict = {}
    for t in texts:
        if t is not None:
            symbols = symbols_of(run(spark, [t], symbols, language="typescript")[0])
    assert got == {v: k for k, v in symbols.items()}


def test_corpus_numbers_do_not_depend_on_ranges(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: r.choice(["alpha", "beta", "Gamma", "delta"]) + r.choice("XYZ") + str(r.randrange(60))
    texts = [" ".join([*(word() for _ in range(r.randrange(6))), *([f"__VAR__{r.randrange(90)}"] if r.random() < 0.1 else []), *([f"__CLS__{r.randrange(90)}"] if r.random() < 0.1 else [])]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc_id", F.col("doc_id") * 37 - 5000)
    many = {r["name"]: r["placeholder"] for r in masking.corpus_symbols(docs, language="typescript").collect()}
    monkeypatch.setattr(masking, "KEY_RANGES", 1)
    one = {r["name"]: r["placeholder"] for r in masking.corpus_symbols(docs, language="typescript").collect()}
    assert many == one and len(set(one.values())) == len(one) > 300
    assert masking.corpus_symbols(docs.limit(0), language="typescript").count() == 0


def test_restore_by_automaton_equals_trying_all_terms(spark):
    """Terms of any shape, nested and overlapping, malformed keys included."""
    rng = random.Random(4)
    cases = []
    for _ in range(400):
        terms = list({"".join(rng.choice("ab_1P$") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 7))})
        cases.append(("".join(rng.choice("ab_1P$ ") for _ in range(rng.randint(0, 40))), terms))
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(cases)], "i int, text string, keys array<string>").withColumn("symbols", F.expr("transform(keys, (k, i) -> named_struct('placeholder', k, 'name', concat('<', k, '>'), 'ord', i))"))
    for strict in (False, True):
        got = {r["i"]: r for r in restore.restore(docs, strip="none", strict=strict).collect()}
        for i, (text, terms) in enumerate(cases):
            one = "|".join(re.escape(k) for k in sorted(terms, key=len, reverse=True))
            seen = []
            want = re.sub(rf"(?<![A-Za-z0-9_$])(?:{one})(?![A-Za-z0-9_$])" if strict else one, lambda m: seen.append(m[0]) or f"<{m[0]}>", text)
            assert got[i]["restored"] == want, (text, terms, strict)
            assert got[i]["report"]["resolved"] == [k for k in terms if k in seen] and got[i]["report"]["missing"] == [k for k in terms if k not in seen]
    row = restore.restore(spark.createDataFrame([("use P1 and {{x}}",)], "text string").withColumn("symbols", masking.entries_of({"P1": "alpha", "{{x}}": "beta"})), strip="none").first()
    assert row["restored"] == "use alpha and beta"


def test_a_large_map_is_restored_in_linear_time():
    keys = [f"__VAR__{i}" for i in range(50_000)]
    names = [f"name{i}" for i in range(50_000)]
    text = " ".join(keys[i * 7 % 50_000] for i in range(90_000))
    began = time.process_time()
    out, found = textswap.swapped_terms(text, keys, names)
    assert out == " ".join(names[i * 7 % 50_000] for i in range(90_000)) and len(found) == 50_000 and time.process_time() - began < 10


def test_rows_have_marks_of_their_own(spark):
    key = "sk_" + "live_" + "a1B2" * 6
    rows = [(1, "call Kowalska and Nowak, FN __FN__1", ["Nowak", "Kowalska", "FN", " ", None, "Nowak"]), (2, "Kowalska", None), (3, f"x {key} y", [key, "__FN__1", "y"]), (4, None, ["a"])]
    docs = spark.createDataFrame(rows, "i int, text string, terms array<string>").withColumn("known", masking.entries_of({}))
    out = {r["i"]: r for r in manual.mark_rows(docs, "terms").collect()}
    assert out[1]["text"] == "call __MANUAL__2 and __MANUAL__1, __MANUAL__3 __FN__1" and out[1]["refused"] == []
    assert out[2]["text"] == "Kowalska" and out[2]["known"] == [] and out[4]["text"] is None
    assert [(e["nth"], e["reason"]) for e in out[3]["refused"]] == [(1, manual.CREDENTIAL), (2, manual.ALREADY)] and out[3]["text"].endswith("__MANUAL__1")
    terms = docs.select(manual.terms_in(masking.entries_of({"__MANUAL__1": "a", "__CLS__1": "b", "__MANUAL__x": "c"})).alias("t")).first()["t"]
    assert terms == ["a", "c"]


def test_nothing_is_cut_off(spark):
    assert "__PKG__1" in symbols_of(run(spark, ["import x from" + " " * 450 + '"lodashLib"'])[0])
    assert "__PKG__1" in symbols_of(run(spark, ["require  (\n" + " " * 450 + "'lodashLib')"])[0]) and "__STR__1" in symbols_of(run(spark, ["xfrom 'lodashLib'"])[0])
    word = "k9" * 120
    row = run(spark, [f"postgres://{'u' * 300}:{word}@host/db"])[0]
    assert word not in row["anonymized"] and [s["type"] for s in row["secrets"]] == ["CONNECTION_PASSWORD"]
    named = run(spark, [f'aws_{"x" * 50}_secret_{"y" * 50} = "{"Ab1/" * 10}"'])[0]
    assert "AWS_SECRET_KEY" in [s["type"] for s in named["secrets"]]
    rule = Rule("replace", "|".join(f"name{i}x" for i in range(300)), "__LONG__")
    assert symbols_of(run(spark, ["name299x"], rules=[rule])[0]) == {"__LONG__1": "name299x"}


def test_rule_tables_equal_trying_all_rules(spark):
    rng = random.Random(9)
    names = [(rng.choice(["s", "t", None]), "".join(rng.choice("abcXY_") for _ in range(rng.randint(1, 7)))) for _ in range(300)] + [("s", None), (None, None)]
    shapes = ["^{}", "{}$", "{}", "{}.b", "a?{}", "{}+c", "({}|b)", "[ab]{}", "^.{}", "x*", "{}*"]
    rules = [(i, rng.choice(["s", None]), rng.choice(["whitelist", "replace"]), rng.choice(shapes).format("".join(rng.choice("abcX") for _ in range(rng.randint(1, 4)))), f"__B{i}__", rng.random() < 0.9, rng.randint(0, 5)) for i in range(60)]
    out = matched(spark.createDataFrame(names, "scope string, name string"), spark.createDataFrame(rules, RULES), "name", "scope").collect()
    assert len(out) == len(names)
    for r in out:
        hits = [x for x in rules if r["name"] is not None and x[5] and x[1] in (None, r["scope"]) and re.search(x[3], r["name"])]
        best = min(hits, key=lambda x: (x[2] != "whitelist", x[6], x[0]), default=(None,) * 7)
        assert (r["rule_id"], r["rule_type"], r["rule_base"]) == (best[0], best[2], best[4] if best[2] == "replace" else None), r


def test_a_published_symbol_table_grows(spark):
    texts = ["class Alpha {} __CLS__9", "let betaOne = new Alpha()", None, "class GammaTwo { betaOne() {} } __VAR__5", "let deltaX = epsilonY(__CLS__2)", "class Zeta {} let alphaB = deltaX"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: {(r["placeholder"], r["name"], r["first_key"]) for r in df.collect()}
    want = rows(masking.corpus_symbols(docs, language="typescript"))
    for cut in range(1, 6):
        one, two = docs.where(f"doc_id < {cut}"), docs.where(f"doc_id >= {cut}")
        day = masking.corpus_symbols(one, language="typescript")
        grown = masking.corpus_symbols(two, language="typescript", known=day, last=masking.last_numbers(day, one))
        assert rows(day) | rows(grown) == want, cut
