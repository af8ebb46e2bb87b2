"""SQL for DuckDB that gives what the registered queries give, from the same fixed tables of words and patterns."""

from ..functions import languages, secrets
from ..functions.grammar import ROLE_BASES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(words) -> str:
    return "(" + ", ".join(map(_quoted, sorted(words))) + ")"


#: White space in RE2's notation.
_SPACE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_SEGMENT = r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"[^"\\]*(?:\\(?s:.)[^"\\]*)*(?:"|\\?\z)|'[^'\\]*(?:\\(?s:.)[^'\\]*)*(?:'|\\?\z)|`[^`\\]*(?:\\(?s:.)[^`\\]*)*(?:`|\\?\z)|[^/"'`]+|/"""
_MODULE = rf"(?:^|[^A-Za-z0-9_$])(?:(?:from|import){_SPACE}*|(?:require|import){_SPACE}*\({_SPACE}*)$"


def names_cte(table: str = "documents", key: str = "doc_id", where: str = "true") -> str:
    """Common tables run (word runs with role priorities), name (distinct names) and sym (numbered names), as TypeScript."""
    base = " ".join(f"when {p} then '{ROLE_BASES[n]}'" for n, p in (("class", 4), ("function", 3), ("package", 2), ("string", 0)))
    return f"""
seg as (select k, s, si, coalesce(lag(s, 3) over v, '') || coalesce(lag(s, 2) over v, '') || coalesce(lag(s, 1) over v, '') front
  from (select {key} k, unnest(g) s, generate_subscripts(g, 1) si from (select {key}, regexp_extract_all(text, {_quoted(_SEGMENT)}) g from {table} where {where}))
  window v as (partition by k order by si)),
cut as (select k, si, s, s[1:2] in ('//', '/*') comment, s[1] in ('"', '''', '`') str,
  s[1] in ('"', '''', '`') and regexp_matches(front, {_quoted(_MODULE)}) module, regexp_extract_all(s, '[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+') g from seg),
flat as (select k, si, comment, str, module, unnest(g) r, generate_subscripts(g, 1) i from cut),
run as (select *, lag(r, 1) over w gap, lag(r, 2) over w prev, lead(r, 1) over w nxt from flat window w as (partition by k, si order by i)),
word as (select *, not comment and regexp_matches(r, '^[A-Za-z_$]') word, r in {_words(languages.keywords("typescript"))} kw,
  case when regexp_full_match(coalesce(gap, ''), {_quoted(_SPACE + "+")}) and regexp_matches(prev, '^[A-Za-z_$]') then prev else '' end before from run),
occ as (select *, word and not kw and length(r) > 2 and not regexp_full_match(r, '[A-Z][A-Z0-9_]*') and not regexp_full_match(r, '__[A-Z][A-Z0-9_]*__[0-9]*') named,
  case when not word then null when str then (case when module then 2 else 0 end) when kw then null
    when before in {_words(languages.class_hints("typescript"))} then 4
    when before in {_words(languages.function_hints("typescript"))} or regexp_matches(coalesce(nxt, ''), {_quoted("^" + _SPACE + "*[(]")}) then 3
    when regexp_matches(r, '^[A-Z]') and regexp_matches(r, '[a-z]') then 4 else 1 end prio from word),
name as (select k, r, max(prio) prio, min(row(si, i)) filter (named) spot from occ where word group by k, r having bool_or(named)),
sym as (select *, row_number() over (partition by k, base order by length(r) desc, spot) n from (select *, case prio {base} else '__VAR__' end base from name))"""


def guess_sql(table: str, key: str, text: str) -> str:
    """Language, score and fallback of each row of a table."""
    parts = []
    for order, (lang, marks) in enumerate(languages.MARKERS.items()):
        flags = "(?im)" if lang in languages.CASE_INSENSITIVE else "(?m)"
        terms = [f"least(len(regexp_extract_all(coalesce({text}, ''), {_quoted(flags + p.replace(chr(92) + 's', _SPACE).replace('[' + chr(92) + 'S', '[' + chr(92) + 'S')  if '[' + chr(92) + 's' not in p else flags + p)})), {languages.MARKER_CAP}) * {w}" for p, w in marks]
        parts.append(f"select {key} k, '{lang}' lang, {order} o, {' + '.join(terms)} score from {table}")
    return f"""select k {key}, case when max(score) = 0 then '{languages.DEFAULT}' else arg_max(lang, score * 100 - o) end "language", max(score)::int score, max(score) = 0 fallback
from ({" union all ".join(parts)}) group by k"""


#: White space and what is none, as Java tells them, in RE2's notation.
_BLANK = r" \t\n\x0B\f\r"
_LABEL = rf"(?i:(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|auth|credential)[A-Za-z0-9_]*)[\"']?[{_BLANK}]*[:=][{_BLANK}]*"
#: RE2 has no look-around: what stands before a secret is matched with it, what may not stand behind it is told by
#: taking the longest run of its characters and testing that as a whole.
_FINDERS = {
    "AWS_SECRET_KEY": (rf"(?i:\b[a-z0-9_]*?aws[a-z0-9_]*?secret[a-z0-9_]*)[\"']?[{_BLANK}]*[:=][{_BLANK}]*[\"']?([A-Za-z0-9/+]+)", "length(x) = 40"),
    "TELEGRAM_TOKEN": (r"(?:^|[^0-9])([0-9]{8,10}:AA[A-Za-z0-9_\-]{33})", "true"),
    "BEARER_TOKEN": (rf"(?i:bearer)[{_BLANK}]+([A-Za-z0-9_\-.~+/]{{20,}}=*)", "true"),
    "BASIC_AUTH": (rf"(?i:authorization)[\"']?[{_BLANK}]*[:=][{_BLANK}]*[\"']?(?i:basic)[{_BLANK}]+([A-Za-z0-9+/]{{8,}}=*)", "true"),
    "PRIVATE_KEY": (r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?)", "true"),
    "CONNECTION_PASSWORD": (rf"(?:^|[^A-Za-z])[a-z][a-z0-9+]*://[^{_BLANK}:/@\"']+:([^{_BLANK}/@\"']{{3,}})@", "true"),
    "ASSIGNED_SECRET": (rf"{_LABEL}[\"']([A-Za-z0-9_\-+/=.]{{20,}})[\"']", "regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z]')"),
    "POSSIBLE_CREDENTIAL": (rf"{_LABEL}[\"']([^\"'{_BLANK}]{{6,}})[\"']", "true"),
    "EMAIL": (r"(?:^|[^A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24})(?:\b|_)", "true"),
    "PRIVATE_IP": (r"([0-9.]+)", r"regexp_full_match(x, '(?:10\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}')"),
}


def findings_sql(table: str, key: str, text: str) -> str:
    """(type, severity, n) of the secrets of all rows, each counted once a row, for the first detector that finds it."""
    parts = []
    for order, d in enumerate(secrets.DETECTORS):
        bare = d.pattern.removeprefix(secrets._EDGE).removesuffix(secrets._END)
        if d.type in _FINDERS:
            regex, test = _FINDERS[d.type]
        elif bare == d.pattern:
            regex, test = bare, "true"
        elif r"\." in bare:
            regex, test = rf"(?:^|[^A-Za-z0-9_\-]){bare}", "true"
        else:
            regex, test = r"([A-Za-z0-9_\-]+)", f"regexp_full_match(x, {_quoted(bare)})"
        parts.append(f"select {key} k, {order} o, unnest(list_filter(regexp_extract_all({text}, {_quoted(regex)}, 1), lambda x: {test})) s from {table}")
    kinds = ", ".join(f"({i}, '{d.type}', '{d.severity}')" for i, d in enumerate(secrets.DETECTORS))
    return f"""with f as ({" union all ".join(parts)}), g as (select k, s, min(o) o from f group by k, s)
select t.type, t.severity, count(*) n from g join (values {kinds}) t(o, type, severity) on t.o = g.o group by 1, 2"""
