"""The registered queries of the library and their SQL for DuckDB."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, languages, links, secrets
from ..operators import anonymize as masking
from ..operators import identifiers, legend, restore
from ..operators.rules import Rule, matched
from ..sources import mapstore
from . import sql

#: Rules of the rule queries: what stays, and what gets a base of its own.
RULES = (Rule("whitelist", "^Th", sort_order=1), Rule("replace", "ing$", "__ACT__", sort_order=2), Rule("replace", "tion", "__ABS__", sort_order=3))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes for each core than this may be in fewer splits than there are cores.
SPLIT_BYTES = 64 << 20


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a table that is too small to give every core a split of its own, dealt to all of them.

    The size is the optimizer's, so no file is listed for it; larger tables are read where they lie.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size >= SPLIT_BYTES * cores else rows.repartition(4 * cores)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _masked(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    return masking.anonymize(_texts(spark, sf_dir), language="typescript", policy="off", texts=texts)


def anonymize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked as TypeScript, which prose falls back to, with the size of its map."""
    return _masked(spark, sf_dir).select("doc_id", "anonymized", "identifier_count")


ANONYMIZE_SQL = f"""with {sql.names_cte()}, c as (select k, count(*) n from sym group by k),
t as (select occ.k, string_agg(case when named then sym.base || sym.n else occ.r end, '' order by occ.si, occ.i) anonymized from occ left join sym on sym.k = occ.k and sym.r = occ.r group by occ.k)
select d.doc_id, case when d.text is not null then coalesce(t.anonymized, '') end anonymized, coalesce(c.n, 0)::int identifier_count
from documents d left join t on t.k = d.doc_id left join c on c.k = d.doc_id"""


def anonymize_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked in its detected language, secrets redacted."""
    out = masking.anonymize(_texts(spark, sf_dir))
    return out.select("doc_id", "language", "identifier_count", F.size("secrets").alias("n_secrets"), F.md5("anonymized").alias("anonymized_md5"))


def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct maskable identifiers of each document that has one."""
    names = identifiers.extract(_texts(spark, sf_dir))
    return names.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("name")).alias("longest"))


COUNTS_SQL = f"with {sql.names_cte()} select k doc_id, count(*) n, max(length(r))::int longest from name group by k"


def identifier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 identifiers that most documents have."""
    names = identifiers.extract(_texts(spark, sf_dir))
    return names.groupBy("name").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "name").limit(50)


TOP_SQL = f"with {sql.names_cte()} select r as name, count(*) docs from name group by r order by docs desc, r limit 50"


def role_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the language of the document and role, with all subtotals."""
    docs = _table(spark, sf_dir, "documents")
    # Counted by document first: what is joined and rolled up is a row for each role of a document.
    roles = identifiers.classify(_texts(spark, sf_dir)).groupBy("doc_id", "role").agg(F.count("*").alias("n")).join(docs.select("doc_id", "lang"), "doc_id")
    return roles.rollup("lang", "role").agg(F.sum("n").alias("names"), F.grouping_id().cast("int").alias("level"))


ROLLUP_SQL = f"""with {sql.names_cte()}, r as (select k, r, case max(prio) when 4 then 'class' when 3 then 'function' when 2 then 'package' when 0 then 'string' else 'variable' end role from occ where prio is not null group by k, r)
select d.lang, r.role, count(*) as names, grouping_id(d.lang, r.role)::int "level" from r join documents d on d.doc_id = r.k group by rollup (d.lang, r.role)"""


def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol map of every document as rows."""
    return _masked(spark, sf_dir, texts=False).select("doc_id", F.explode("symbols").alias("s")).select("doc_id", "s.placeholder", "s.name")


SYMBOLS_SQL = f"with {sql.names_cte()} select k doc_id, base || n placeholder, r as name from sym"


def corpus_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol table for the whole corpus."""
    return masking.corpus_symbols(_texts(spark, sf_dir), language="typescript").select("placeholder", "name", "first_key")


CORPUS_SQL = f"""with {sql.names_cte()}, f as (select r, arg_min(row(k, base, spot), k) v from sym group by r)
select v[2] || row_number() over (partition by v[2] order by v[1], length(r) desc, v[3]) placeholder, r as name, v[1] first_key from f"""


def corpus_symbols_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table in two days: the first half of the documents is published, the others' new names are added to it."""
    docs = _texts(spark, sf_dir)
    half = F.lit(docs.agg(F.max("doc_id")).first()[0] // 2)
    one, two = docs.where(F.col("doc_id") <= half), docs.where(F.col("doc_id") > half)
    day = masking.corpus_symbols(one, language="typescript")
    grown = masking.corpus_symbols(two, language="typescript", known=day, last=masking.last_numbers(day, one))
    return day.unionByName(grown).select("placeholder", "name", "first_key")


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that matches each name of each language, of a table with a rule from every document."""
    docs = _table(spark, sf_dir, "documents")
    word, k = F.regexp_extract("text", "[A-Za-z]{5,}", 0), F.col("doc_id")
    pattern = F.when(k % 3 == 0, F.concat(F.lit("^"), F.substring("w", 1, 4))).when(k % 3 == 1, F.concat(F.substring("w", -4, 4), F.lit("$"))).otherwise(F.substring("w", 2, 4))
    rules = docs.withColumn("w", word).where("w <> ''").select(
        k.alias("rule_id"), F.when(k % 5 == 0, F.col("lang")).alias("scope"), F.when(k % 7 == 0, "whitelist").otherwise("replace").alias("type"), pattern.alias("pattern"),
        F.concat(F.lit("__R"), (k % 10).cast("string"), F.lit("__")).alias("placeholder"), (k % 11 != 0).alias("enabled"), (k % 100).cast("int").alias("sort_order"),
    )
    names = identifiers.extract(_texts(spark, sf_dir)).join(docs.select("doc_id", "lang"), "doc_id").select("lang", "name").distinct()
    return matched(names, rules, "name", "lang").select("lang", "name", "rule_id", "rule_type", "rule_base")


RULE_TABLE_SQL = f"""with {sql.names_cte()}, w as (select doc_id k, lang, regexp_extract(text, '[A-Za-z]{{5,}}') w from documents where doc_id % 11 <> 0),
n as (select distinct d.lang, name.r from name join documents d on d.doc_id = name.k),
m as (select n.lang, n.r, w.k, row_number() over (partition by n.lang, n.r order by w.k % 7 <> 0, w.k % 100, w.k) place from n join w on w <> '' and (w.k % 5 <> 0 or w.lang is null or w.lang = n.lang)
  and case w.k % 3 when 0 then starts_with(n.r, w[1:4]) when 1 then ends_with(n.r, w[-4:]) else contains(n.r, w[2:5]) end)
select n.lang, n.r as name, m.k rule_id, case when m.k % 7 = 0 then 'whitelist' when m.k is not null then 'replace' end rule_type, case when m.k % 7 <> 0 then '__R' || (m.k % 10) || '__' end rule_base
from n left join m on m.place = 1 and m.r = n.r and m.lang is not distinct from n.lang"""


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guessed programming language of every page."""
    return _spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", languages.guess(F.col("html")).alias("g")).select("page_id", "g.language", F.col("g.score").cast("int").alias("score"), "g.fallback")


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct identifiers of the corpus are keywords of each language."""
    words = identifiers.classify(_texts(spark, sf_dir)).select("name").distinct()
    dimension = spark.createDataFrame([(lang, w) for lang in languages.LANGUAGES for w in sorted(languages.keywords(lang))], "language string, name string")
    return words.join(dimension, "name").groupBy("language").agg(F.count("*").alias("n"))


KEYWORD_SQL = f"""with {sql.names_cte()}, w as (select distinct r from occ where prio is not null),
kw as (select * from (values {", ".join(f"('{lang}', '{w}')" for lang in languages.LANGUAGES for w in sorted(languages.keywords(lang)))}) t("language", word))
select kw."language", count(*) n from w join kw on kw.word = w.r group by 1"""


def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legend of every masked document."""
    return _masked(spark, sf_dir).select("doc_id", legend.legend(F.col("symbols"), F.col("anonymized")).alias("legend"))


LEGEND_SQL = f"""with {sql.names_cte()}, c as (select k, base, count(*) n from sym group by k, base),
p as (select k, string_agg(base || '* are ' || case base {" ".join(f"when '{b}' then '{t}'" for b, t in legend.LABELS.items())} end || ' (' || n || ')', '; '
  order by list_position({list(legend.LABELS)}, base)) t from c group by k)
select d.doc_id, coalesce('Placeholder legend: ' || p.t || '.', '') legend from documents d left join p on p.k = d.doc_id"""


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many masked documents are restored to what they were, and how many reports are clean."""
    back = restore.restore(_masked(spark, sf_dir), "anonymized", strip="none")
    same = F.col("restored").eqNullSafe(F.col("text"))
    return back.agg(F.count("*").alias("docs"), F.count_if(same).alias("same"), F.count_if(restore.summary(F.col("report"))["clean"]).alias("clean"))


ROUND_TRIP_SQL = f"""with {sql.names_cte()},
p as (select occ.k, occ.si, occ.i, occ.r, case when named then sym.base || sym.n else occ.r end masked from occ left join sym on sym.k = occ.k and sym.r = occ.r),
b as (select p.k, string_agg(coalesce(sym.r, masked), '' order by si, i) back, count_if(sym.r is null and regexp_full_match(masked, '__[A-Z][A-Z0-9_]*__[0-9]*') and masked not like '\\_\\_REDACTED\\_%' escape '\\') odd
  from p left join sym on sym.k = p.k and sym.base || sym.n = p.masked group by p.k)
select count(*) docs, count_if(coalesce(b.back, '') = coalesce(d.text, '')) same, count_if(coalesce(odd, 0) = 0) "clean" from documents d left join b on b.k = d.doc_id"""


def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked names by base, under rules that keep some and rename others."""
    out = masking.anonymize(_texts(spark, sf_dir), language="typescript", rules=RULES, policy="off", texts=False)
    # The number is what stands behind the base, so a placeholder is searched once.
    names = out.select(F.explode("symbols").alias("s")).select(F.col("s.placeholder").alias("p"), grammar.base_of(F.col("s.placeholder")).alias("base"))
    number = F.when(F.col("base") != "", F.expr("substring(p, length(base) + 1)").try_cast("long"))
    return names.groupBy("base").agg(F.count("*").alias("names"), F.max(number).alias("most"))


RULES_SQL = f"""with {sql.names_cte()}, b as (select k, r, case when regexp_matches(r, 'ing$') then '__ACT__' when r like '%tion%' then '__ABS__' else base end nb from sym where r not like 'Th%'),
c as (select k, nb, count(*) n from b group by all)
select nb base, sum(n)::bigint as names, max(n) most from c group by nb"""


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the credential guard by type and severity."""
    return secrets.summarize(secrets.with_findings(_texts(spark, sf_dir), policy="warn"))


#: A comment of every kind that is stripped; turns are prose, and each gets these in front.
NOISE = "/** doc\n * more */\n// TODO later\n// Step 1: go\n  // Handle it\n// ----\n// **head**\n// @param x\nkept();\n\n\n\n"


def strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stripped from assistant turns, by type and line, and the digest of what is left."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    noisy = turns.select("conv_id", "turn", F.concat(F.lit(NOISE), "text").alias("text"))
    out = restore.restore(noisy.withColumn("symbols", masking.entries_of({})), "text")
    items = F.array_join(F.transform("stripped_items", lambda i: F.concat(i["type"], F.lit(":"), i["line_number"].cast("string"))), ",")
    return out.select("conv_id", "turn", "stripped_count", items.alias("items"), F.md5("restored").alias("left_md5"))


_LINE_KINDS = [k for k in restore.STRIPPABLE_TYPES if k != "jsdoc"]
_PATTERN_OF = {k: sql._quoted(restore.STRIP_PATTERNS[k]) for k in _LINE_KINDS}
# Block comments go first; then each line is of the first kind whose pattern it begins with, and the part that matches goes.
STRIP_SQL = rf"""with t as (select conv_id, turn, {sql._quoted(NOISE)} || text s from conversations where role = 'assistant'),
j as (select *, regexp_extract_all(s, '/\*\*(?s:.*?)\*/') blocks, regexp_replace(s, '/\*\*(?s:.*?)\*/', '', 'g') bare from t),
l as (select conv_id, turn, unnest(string_split(bare, chr(10))) line, generate_subscripts(string_split(bare, chr(10)), 1) i from j),
k as (select *, case {" ".join(f"when regexp_matches(line, {p}) then {n}" for n, p in enumerate(_PATTERN_OF.values()))} end kind from l),
c as (select *, case kind {" ".join(f"when {n} then regexp_replace(line, {p}, '')" for n, p in enumerate(_PATTERN_OF.values()))} else line end rest from k),
f as (select conv_id, turn, string_agg(case when regexp_full_match(rest, '[ \t]+') then '' else rest end, chr(10) order by i) rest, count(kind) n,
  string_agg(case kind {" ".join(f"when {n} then '{k}'" for n, k in enumerate(_PATTERN_OF))} end || ':' || i, ',' order by kind, i) filter (kind is not null) items from c group by conv_id, turn),
b as (select conv_id, turn, len(blocks) n, array_to_string(list_transform(blocks, lambda x: 'jsdoc:' || (1 + len(split_part(s, x, 1)) - len(replace(split_part(s, x, 1), chr(10), '')))), ',') items from j)
select conv_id, turn, (b.n + f.n)::int stripped_count, concat_ws(',', nullif(b.items, ''), f.items) items, md5(regexp_replace(rest, '\n{{3,}}', chr(10) || chr(10), 'g')) left_md5 from f join b using (conv_id, turn)"""


def restore_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are masked; the report of a reply that drops the last quarter and invents a placeholder."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    masked = masking.anonymize(turns, language="typescript", policy="off")
    held = F.expr("slice(symbols, 1, size(symbols) - size(symbols) div 4)")
    reply = masked.withColumn("reply", F.concat(F.array_join(F.transform(held, lambda e: e["placeholder"]), " "), F.lit(" __NEW__1")))
    out = restore.restore(reply, "reply", strip="none")
    return out.select("conv_id", "turn", F.size("report.resolved").alias("resolved"), F.size("report.missing").alias("missing"), F.array_join("report.unresolved", ",").alias("unresolved"))


REPORT_SQL = f"""with turns as (select row(conv_id, turn) kk, conv_id, turn, text from conversations where role = 'user'), {sql.names_cte("turns", "kk")}, c as (select k, count(*) n from sym group by k)
select t.conv_id, t.turn, (coalesce(c.n, 0) - coalesce(c.n, 0) // 4)::int resolved, (coalesce(c.n, 0) // 4)::int missing, '__NEW__1' unresolved from turns t left join c on c.k = t.kk"""


def href_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe, external and refused links of every page that has links."""
    hrefs = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    safe = links.safe_href(F.col("h"))
    return hrefs.groupBy("page_id").agg(F.count("*").alias("n"), F.count(safe).alias("safe"), F.count_if(links.is_external(safe)).alias("external"))


HREF_SQL = r"""with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) h from pages),
n as (select page_id, regexp_replace(regexp_replace(h, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g') h from h),
s as (select page_id, case when h = '/' or regexp_matches(h, '^/[^/]') or h like '#%' or regexp_matches(h, '^(?i:https?|mailto):') then h end s from n)
select page_id, count(*) n, count(s) "safe", coalesce(count_if(regexp_matches(s, '^(?i:https?:)')), 0)::bigint "external" from s group by page_id"""


def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of every masked document that stand in the text, and how often the first does."""
    found = grammar.placeholders_in(F.col("anonymized"))
    return _masked(spark, sf_dir).select("doc_id", F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("n_distinct"))


SCAN_SQL = f"""with {sql.names_cte()}, o as (select occ.k, occ.r from occ join sym on sym.k = occ.k and sym.r = occ.r where named)
select d.doc_id, count(o.r)::int n, count(distinct o.r)::int n_distinct from documents d left join o on o.k = d.doc_id group by d.doc_id"""


def map_export_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's most frequent names through an encrypted map file and back."""
    names = [r["name"] for r in identifier_top(spark, sf_dir).collect()]
    symbols = {f"__VAR__{i + 1}": n for i, n in enumerate(names)}
    word = " ".join(["quiet", "harbour", "morning"])
    back = mapstore.import_map(spark, mapstore.export_map(spark, symbols, word, iterations=1000), word)
    return spark.createDataFrame([(k, v) for k, v in back.items()], "placeholder string, name string")


MAP_SQL = f"with {sql.names_cte()}, t as (select r, count(*) docs from name group by r order by docs desc, r limit 50) select '__VAR__' || row_number() over (order by docs desc, r) placeholder, r as name from t"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        anonymize_docs, anonymize_auto, identifier_counts, identifier_top, role_rollup, symbol_table, corpus_symbols, corpus_symbols_grown, rule_table, language_guess, keyword_overlap,
        legend_counts, round_trip, rules_applied, secret_findings, strip_noise, restore_report, href_safety, placeholder_scan, map_export_check,
    )
}

ORACLE_SQL: dict[str, str] = {
    "anonymize_docs": ANONYMIZE_SQL,
    "identifier_counts": COUNTS_SQL,
    "identifier_top": TOP_SQL,
    "role_rollup": ROLLUP_SQL,
    "symbol_table": SYMBOLS_SQL,
    "corpus_symbols": CORPUS_SQL,
    "corpus_symbols_grown": CORPUS_SQL,
    "rule_table": RULE_TABLE_SQL,
    "language_guess": sql.guess_sql("pages", "page_id", "html"),
    "keyword_overlap": KEYWORD_SQL,
    "legend_counts": LEGEND_SQL,
    "round_trip": ROUND_TRIP_SQL,
    "rules_applied": RULES_SQL,
    "secret_findings": sql.findings_sql("documents", "doc_id", "text"),
    "strip_noise": STRIP_SQL,
    "restore_report": REPORT_SQL,
    "href_safety": HREF_SQL,
    "placeholder_scan": SCAN_SQL,
    "map_export_check": MAP_SQL,
}
