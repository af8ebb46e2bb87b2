"""Languages: keywords, role hints, comment syntax and detection."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import ascii_regex
from .literals import may_match

#: Languages in the order in which ties are decided, with their display names.
LANGUAGES = {
    "typescript": "TypeScript / JavaScript",
    "python": "Python",
    "go": "Go",
    "java": "Java / Kotlin",
    "csharp": "C#",
    "rust": "Rust",
    "ruby": "Ruby",
    "php": "PHP",
    "c": "C / C++",
    "sql": "SQL",
}
DEFAULT = "typescript"

#: Words that are never masked in any language.
COMMON = """
add all allSettled args arr assign body buf catch cb cfg charAt clear col concat data dir done end endsWith entries env every
file fill filter finally find findIndex findLast findLastIndex flat flatMap fn forEach freeze has hasOwnProperty head id idx
includes indexOf join keys lastIndexOf len log map ms msg node num obj ok opts out padEnd padStart parse path pop pos push race
raw reduce reduceRight reject repeat replace replaceAll resolve reverse root row shift size slice some sort splice split start
startsWith stop str stringify substring tail then tmp toFixed toLowerCase toString toUpperCase trim trimEnd trimStart ts unshift
url val valueOf values
""".split()

#: Reserved words, built-in types and ubiquitous library names of each language.
LISTED = {
    "typescript": """
AbortController AbortSignal Array Blob Boolean Buffer Component CustomEvent Date Error Event EventTarget File FileReader FormData
Fragment Function Headers JSON Map Math Number Object Promise Proxy RangeError React Reflect RegExp Request Response Set StrictMode
String Suspense Symbol TextDecoder TextEncoder TypeError URL URLSearchParams WeakMap WeakSet abstract any app as asserts async atob
await bigint boolean break btoa case catch children class clearInterval clearTimeout console const constructor continue createContext
createElement crypto ctx db declare decodeURI decodeURIComponent default defaultProps delete displayName do document else encodeURI
encodeURIComponent enum err export exports express extends false fetch finally for forwardRef from function get global if implements
import in infer instanceof interface is isFinite isNaN key keyof lazy let location memo module namespace navigator never new next null
number object of override package parseFloat parseInt performance private process props protected public queueMicrotask readonly ref
render req require res return router satisfies set setInterval setTimeout sql startTransition state static string structuredClone super
switch symbol this throw true try type typeof undefined unique unknown useCallback useContext useDebugValue useEffect useId
useImperativeHandle useLayoutEffect useMemo useReducer useRef useState using var void while window with yield
""",
    "python": """
Annotated Any AssertionError AttributeError BaseException Callable Dict Exception False FileNotFoundError Final Generic IOError
ImportError IndexError Iterable Iterator KeyError List Literal Mapping None NotImplementedError OSError Optional Protocol RuntimeError
Sequence StopIteration True Tuple TypeError TypeVar Union ValueError ZeroDivisionError abs all and any args as assert async asyncio
await bool break bytearray bytes callable case chr class classmethod cls collections continue dataclass datetime def del dict dir divmod
elif else enumerate eval except field filter finally float for format from frozenset functools getattr global hasattr hash hex if import
in input int is isinstance issubclass iter itertools json kwargs lambda len list logging map match math max min next nonlocal not object
oct open or ord os pass pathlib pow print property raise range re repr return reversed round self set setattr slice sorted staticmethod
str sum super sys time try tuple type typing vars while with yield zip
""",
    "go": """
Context Duration Errorf Mutex Printf Println Sprintf Time WaitGroup any append bool break byte bytes cap case chan close comparable
complex complex128 complex64 const context continue copy ctx default defer delete else err error errors fallthrough false float32 float64
fmt for func go goto http if imag import int int16 int32 int64 int8 interface io iota json len make map max min new nil ok os package
panic print println range real recover return rune select sort strconv string strings struct switch sync testing time true type uint
uint16 uint32 uint64 uint8 uintptr var
""",
    "java": """
ArrayList Arrays BigDecimal Boolean Byte Character Class Collection Collections Comparable Deprecated Double Exception Float HashMap
HashSet IllegalArgumentException IllegalStateException Integer Iterable List LocalDate LocalDateTime Long Map Math Object Optional
Override RuntimeException Set Short Stream String StringBuilder SuppressWarnings System Thread Throwable Unit abstract assert boolean
break byte case catch char class companion const continue data default do double else enum equals extends final finally float for fun
goto hashCode if implements import in init instanceof int interface internal is lateinit length long main native new null object open out
override package permits println private protected public record return sealed short static strictfp super suspend switch synchronized
this throw throws toString transient true try typealias val var void volatile when while yield false
""",
    "csharp": """
Action ArgumentException ArgumentNullException Boolean Console Count DateTime Decimal Dictionary Double Equals Exception Func GetHashCode
Guid IDictionary IEnumerable IList Int32 Int64 InvalidOperationException Length Linq List Main NotImplementedException Nullable String
System Task TimeSpan ToString ValueTask WriteLine abstract as async await base bool break byte case catch char checked class const
continue decimal default delegate do double dynamic else enum event explicit extern false finally fixed float for foreach from get global
goto if implicit in init int interface internal is lock long nameof namespace new null object operator out override params partial private
protected public readonly record ref remove return sbyte sealed select set short sizeof stackalloc static string struct switch this throw
true try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while yield
""",
    "rust": """
Arc BTreeMap Box Cell Clone Copy Cow Debug Default Display Drop Eq Err Fn FnMut FnOnce From Hash HashMap HashSet Into IntoIterator
Iterator Mutex None Ok Option Ord PartialEq PartialOrd Path PathBuf Rc RefCell Result RwLock Self Send Sized Some String Sync TryFrom
TryInto Vec as as_ref as_str async await bool break char collect const continue crate derive dyn else enum eprintln expect extern f32 f64
false fn for format i128 i16 i32 i64 i8 if impl in into_iter isize iter let loop match matches mod move mut panic print println pub ref
return self static str struct super to_string todo trait true type u128 u16 u32 u64 u8 unimplemented union unsafe unwrap use usize vec
where while
""",
    "ruby": """
ArgumentError Array Class Comparable Enumerable Exception Float Hash Integer Kernel Module Object Proc Range RuntimeError StandardError
String Struct Symbol alias and attr_accessor attr_reader attr_writer begin break case class def defined do each each_with_index else elsif
empty? end ensure extend false for if in include initialize inject lambda loop module new next nil nil? not or prepend print proc puts
raise redo reject require require_relative rescue retry return select self super then to_a to_h to_i to_s to_sym true undef unless until
when while yield
""",
    "php": """
ArrayObject Closure Exception Generator Throwable abstract and array array_filter array_keys array_map array_merge array_values as bool
break callable case catch class clone const continue count declare default die do echo else elseif empty enddeclare endfor endforeach
endif endswitch endwhile enum explode extends false final finally float fn for foreach function global goto if implements implode in_array
include instanceof insteadof int interface is_array is_null isset iterable json_decode json_encode list match mixed namespace never new
null object or parent print printf private protected public readonly require return self sprintf static stdClass string strlen switch this
throw trait true try unset use var var_dump void while xor yield
""",
    "c": """
FILE NULL alignas alignof argc argv asm auto bool break calloc case catch cerr char cin class concept const const_cast consteval
constexpr continue cout decltype default define defined delete do double dynamic_cast elif else endif endl enum exit explicit export
extern false fclose float fopen for fprintf fread free friend fwrite goto if ifdef ifndef include inline int int16_t int32_t int64_t
int8_t line long main malloc memcpy memset mutable namespace new noexcept nullptr nullptr_t operator pragma printf private protected
public realloc register reinterpret_cast requires restrict return scanf shared_ptr short signed size_t sizeof sprintf ssize_t static
static_assert static_cast std strcmp strcpy string strlen strncpy struct switch template this thread_local throw true try typedef typeid
typename uint16_t uint32_t uint64_t uint8_t undef union unique_ptr unsigned using vector virtual void volatile while
""",
    "sql": """
all alter and array as asc avg begin between bigint boolean cascade case cast char check coalesce commit conflict constraint count create
cross date decimal default delete desc distinct drop else end exists false foreign from full grant group having ilike in index inner insert
int integer into is join json jsonb left like limit max min not now null nullif numeric offset on or order outer primary real recursive
references returning revoke right rollback select serial set smallint sum table text then timestamp timestamptz transaction true union
unique update using uuid values varchar view when where with
""",
}
CASE_INSENSITIVE = ("sql",)

#: Words that make the identifier behind them a type or a function.
CLASS_HINTS = "class interface enum extends implements new".split()
FUNCTION_HINTS = "function def async".split()
MORE_CLASS_HINTS = {
    "go": "struct type",
    "rust": "struct trait impl enum union",
    "java": "record data object sealed",
    "csharp": "record struct namespace",
    "c": "struct union typedef template",
    "ruby": "module",
    "php": "trait",
    "python": "dataclass",
}
MORE_FUNCTION_HINTS = {"go": "func", "rust": "fn", "java": "fun suspend", "php": "fn", "ruby": "def", "csharp": "void task"}

#: Line comment openers, block comment ends, docstring quotes and string quotes; languages not named are like C.
C_STYLE = {"line": ["//"], "block": [["/*", "*/"]], "docstring": [], "quotes": ['"', "'", "`"]}
COMMENTS = {
    "python": {"line": ["#"], "block": [], "docstring": ['"""', "'''"], "quotes": ['"', "'"]},
    "ruby": {"line": ["#"], "block": [["=begin", "=end"]], "docstring": [], "quotes": ['"', "'"]},
    "php": {"line": ["//", "#"], "block": [["/*", "*/"]], "docstring": [], "quotes": ['"', "'"]},
    "sql": {"line": ["--"], "block": [["/*", "*/"]], "docstring": [], "quotes": ["'", '"']},
}

#: Fixed values, taken as they are for identical output: what speaks for a language, as (pattern, weight).
MARKER_CAP = 3
MARKERS = {
    "typescript": (
        (r"\b(?:const|let)\s+[\w$]+\s*[=:]", 2),
        (r"=>", 1),
        (r"\binterface\s+\w+\s*\{", 3),
        (r"\bexport\s+(?:default|const|function|class|interface|type)\b", 3),
        (r"\bimport\s+[^;\n]*\bfrom\s+['\"]", 3),
        (r":\s*(?:string|number|boolean|void|unknown|any)\b", 2),
        (r"\bconsole\.(?:log|error|warn)\b", 2),
        (r"\bfunction\s+\w+\s*\(", 1),
        (r"\basync\s+function\b", 2),
        (r"\bnull\b|\bundefined\b", 1),
    ),
    "python": (
        (r"^[ \t]*def\s+\w+\s*\(", 3),
        (r"^[ \t]*(?:async\s+)?def\s+\w+\s*\([^)]*\)\s*(?:->[^:]+)?:", 3),
        (r"^[ \t]*class\s+\w+[^{]*:[ \t]*$", 3),
        (r"\belif\b", 3),
        (r"\bself\b", 2),
        (r"__init__|__name__|__main__", 3),
        (r"^[ \t]*from\s+[\w.]+\s+import\s+", 3),
        (r"\b(?:True|False|None)\b", 2),
        (r"^[ \t]*#[^!]", 1),
        (r"\"\"\"|'''", 2),
    ),
    "go": (
        (r"^package\s+\w+", 3),
        (r"\bfunc\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s*)?\w*\s*\(", 3),
        (r":=", 3),
        (r"\bnil\b", 2),
        (r"\bstruct\s*\{", 3),
        (r"\berr\s*!=\s*nil\b", 3),
        (r"\bfmt\.\w+", 3),
        (r"\b(?:int64|float64|uint8|rune|byte)\b", 2),
        (r"\bdefer\s+", 2),
        (r"\bchan\s+\w+|<-", 2),
    ),
    "java": (
        (r"\bpublic\s+(?:static\s+)?(?:final\s+)?(?:class|void|int|String|abstract)\b", 3),
        (r"\bSystem\.out\.print", 3),
        (r"^import\s+(?:java|javax|kotlin)[\w.]*;?", 3),
        (r"@(?:Override|Deprecated|SuppressWarnings|Autowired|Component|Service)\b", 3),
        (r"\bpublic\s+static\s+void\s+main\b", 3),
        (r"\bfun\s+\w+\s*\(", 3),
        (r"\bval\s+\w+\s*[:=]", 2),
        (r"\bnew\s+[A-Z]\w*\s*\(", 1),
        (r"\bimplements\s+\w+|\bextends\s+\w+", 1),
        (r"\bthrows\s+\w+Exception\b", 3),
    ),
    "csharp": (
        (r"^using\s+System[\w.]*;", 3),
        (r"\bnamespace\s+[\w.]+", 3),
        (r"\bConsole\.Write(?:Line)?\b", 3),
        (r"\bpublic\s+(?:async\s+)?(?:Task|void|string|int|bool)\b", 2),
        (r"\bvar\s+\w+\s*=\s*new\b", 2),
        (r"\{\s*get;\s*(?:set;)?\s*\}", 3),
        (r"\bstring\[\]\s+args\b", 3),
        (r"\bIEnumerable<|\bList<\w+>\s+\w+", 2),
        (r"\bnameof\s*\(", 3),
    ),
    "rust": (
        (r"\bfn\s+\w+\s*[(<]", 3),
        (r"\blet\s+mut\b", 3),
        (r"\bimpl(?:\s*<[^>]*>)?\s+\w+", 3),
        (r"\bpub\s+(?:fn|struct|enum|mod|trait|const)\b", 3),
        (r"->\s*(?:Result|Option)<", 3),
        (r"\buse\s+[\w:]+::", 3),
        (r"&(?:mut\s+)?self\b|&str\b", 3),
        (r"\bmatch\s+\w+\s*\{", 2),
        (r"\.unwrap\(\)|\.expect\(|\?;", 2),
        (r"#\[derive\(|#\[cfg\(", 3),
    ),
    "ruby": (
        (r"^[ \t]*def\s+\w+[?!]?", 2),
        (r"^[ \t]*end[ \t]*$", 3),
        (r"\bputs\b", 3),
        (r"\belsif\b", 3),
        (r"\brequire(?:_relative)?\s+['\"]", 3),
        (r"\bdo\s*\|[\w, ]*\|", 3),
        (r"@\w+\s*=", 2),
        (r"\battr_(?:accessor|reader|writer)\b", 3),
        (r"\bunless\b|\bnil\?", 2),
        (r":\w+\s*=>|\bdef\s+initialize\b", 2),
    ),
    "php": (
        (r"<\?php", 3),
        (r"\$\w+\s*=", 3),
        (r"\becho\b", 2),
        (r"\bfunction\s+\w+\s*\([^)]*\)\s*(?::\s*\w+\s*)?\{", 1),
        (r"\$this->\w+", 3),
        (r"\bpublic\s+function\b", 3),
        (r"\buse\s+[\w\\]+\\[\w]+;", 3),
        (r"\barray\s*\(|\[\s*['\"]\w+['\"]\s*=>", 2),
        (r"\bnamespace\s+[\w\\]+;", 2),
    ),
    "c": (
        (r"^\s*#include\s*[<\"]", 3),
        (r"\bint\s+main\s*\(", 3),
        (r"\bprintf\s*\(|\bfprintf\s*\(", 3),
        (r"\bstd::\w+", 3),
        (r"\b(?:malloc|calloc|free|memcpy|memset)\s*\(", 3),
        (r"\btypedef\s+struct\b", 3),
        (r"\bvoid\s*\*|\bchar\s*\*", 2),
        (r"\b(?:size_t|uint\d+_t|int\d+_t)\b", 2),
        (r"^\s*#(?:define|ifndef|pragma)\b", 3),
        (r"\bcout\s*<<|\bstd::endl\b", 3),
    ),
    "sql": (
        (r"\bSELECT\b[\s\S]{0,400}?\bFROM\b", 3),
        (r"\bINSERT\s+INTO\b", 3),
        (r"\bCREATE\s+(?:TABLE|INDEX|VIEW|OR\s+REPLACE)\b", 3),
        (r"\bALTER\s+TABLE\b", 3),
        (r"\b(?:INNER|LEFT|RIGHT|FULL|CROSS)\s+(?:OUTER\s+)?JOIN\b", 3),
        (r"\bGROUP\s+BY\b|\bORDER\s+BY\b", 3),
        (r"\bWHERE\b[\s\S]{0,200}?[=<>]", 2),
        (r"\bPRIMARY\s+KEY\b|\bFOREIGN\s+KEY\b", 3),
        (r"\bUPDATE\b[\s\S]{0,200}?\bSET\b", 3),
    ),
}


def keywords(language: str) -> frozenset[str]:
    """Words that are never masked in a language."""
    return frozenset(COMMON) | frozenset(LISTED[language].split())


def class_hints(language: str) -> frozenset[str]:
    """Words that make the identifier behind them a type."""
    return frozenset(CLASS_HINTS) | frozenset(MORE_CLASS_HINTS.get(language, "").split())


def function_hints(language: str) -> frozenset[str]:
    """Words that make the identifier behind them a function."""
    return frozenset(FUNCTION_HINTS) | frozenset(MORE_FUNCTION_HINTS.get(language, "").split())


def comment_syntax(language: str) -> dict[str, list]:
    """How comments and strings of a language begin and end."""
    return COMMENTS.get(language, C_STYLE)


def _by_language(language: Column, pick) -> Column:
    """A condition that differs by language; false for unknown languages."""
    chosen = reduce(lambda acc, name: acc.when(language == name, pick(name)), LANGUAGES, F.when(language.isNull(), F.lit(False)))
    return chosen.otherwise(False)


def _among(name: str, words) -> Column:
    """Whether a SQL expression is one of some words; one parsed list is far quicker to build than a literal each."""
    return F.expr(f"{name} in ({', '.join(repr(w) for w in sorted(words))})")


def is_keyword(name: str, language: Column | str) -> Column:
    """Whether a word, given as SQL, is a keyword of a language; SQL does not tell cases apart."""

    def one(lang: str) -> Column:
        exact = _among(name, keywords(lang))
        return exact | _among(f"lower({name})", keywords(lang)) if lang in CASE_INSENSITIVE else exact

    return one(language) if isinstance(language, str) else _by_language(language, one)


def follows_hint(previous: str, language: Column | str, hints) -> Column:
    """Whether the word before an identifier, given as SQL, is one of a language's hints; false without one."""
    one = lambda lang: _among(f"coalesce({previous}, '')", hints(lang))
    return one(language) if isinstance(language, str) else _by_language(language, one)


def marker_regex(language: str, pattern: str) -> str:
    """A marker for Java's regex engine."""
    return ("(?i)" if language in CASE_INSENSITIVE else "") + ascii_regex(pattern)


def scores(text: Column) -> dict[str, Column]:
    """The marker score of each language: hits of each marker up to the cap, times its weight."""

    def count(lang: str, pattern: str) -> Column:
        hits = F.least(F.regexp_count(text, F.lit(marker_regex(lang, pattern))), F.lit(MARKER_CAP))
        return F.when(may_match(text, pattern, lang in CASE_INSENSITIVE), hits).otherwise(0)

    return {lang: reduce(lambda a, b: a + b, [count(lang, p) * w for p, w in marks]) for lang, marks in MARKERS.items()}


def guess(text: Column) -> Column:
    """struct(language, score, fallback): the best score; ties go to the earlier language, no hit to the default."""
    text = F.coalesce(text, F.lit(""))
    ranked = [F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(lang).alias("language")) for i, (lang, s) in enumerate(scores(text).items())]
    best = F.array_max(F.array(*ranked))
    return F.transform(F.array(best), lambda b: F.struct(b["language"].alias("language"), b["score"].alias("score"), (b["score"] == 0).alias("fallback")))[0]


def resolve(text: Column, option: str | None = None) -> Column:
    """The language to use: a named one, or the guess for none and "auto"."""
    if option in (None, "auto"):
        return guess(text)["language"]
    if option not in LANGUAGES:
        raise ValueError(f"unknown language {option!r}")
    return F.lit(option)
