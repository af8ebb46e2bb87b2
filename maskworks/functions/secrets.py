"""Credential detection and one-way redaction, by patterns of our own.

Families: cloud, payment, code-hosting, chat, model-provider and package-registry keys, JSON web tokens,
bearer tokens, private keys, passwords in connection strings and generic assignments. Critical and high
findings are redacted and block a mark by hand; medium ones are reported only. No raw secret is ever
written to a map, a report or an error: previews are cut.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grammar import REDACTION_PREFIX
from .literals import may_match

BLOCKING = ("critical", "high")
POLICIES = ("redact", "warn", "off")
_EDGE, _END = r"(?<![A-Za-z0-9_\-])", r"(?![A-Za-z0-9_\-])"


@dataclass(frozen=True)
class Detector:
    """A kind of secret: its type, how bad it is, and a Java regex whose first group is the secret."""

    type: str
    severity: str
    pattern: str


def _key(prefix: str, body: str) -> str:
    return f"{_EDGE}({prefix}{body}){_END}"


_ASSIGNED = r"(?i:(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|auth|credential)[A-Za-z0-9_]*)[\"']?\s*[:=]\s*"

DETECTORS = (
    Detector("AWS_ACCESS_KEY", "critical", _key("(?:AKIA|ASIA)", "[A-Z0-9]{16}")),
    Detector("AWS_SECRET_KEY", "critical", r"(?i:(?<![a-z0-9_])(?>[a-z0-9_]*?aws)(?>[a-z0-9_]*?secret)[a-z0-9_]*+)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+])"),
    Detector("GOOGLE_API_KEY", "critical", _key("AIza", r"[A-Za-z0-9_\-]{35}")),
    Detector("GOOGLE_OAUTH_SECRET", "critical", _key("GOCSPX-", r"[A-Za-z0-9_\-]{28}")),
    Detector("GOOGLE_OAUTH_TOKEN", "high", _key(r"ya29\.", r"[A-Za-z0-9_\-]{20,}")),
    Detector("AZURE_STORAGE_KEY", "critical", r"AccountKey=([A-Za-z0-9+/]{86}==)"),
    Detector("AZURE_SAS", "high", r"[?&]sig=([A-Za-z0-9%]{43,}%3[Dd])"),
    Detector("STRIPE_KEY", "critical", _key("(?:sk|rk)_(?:live|test)_", "[A-Za-z0-9]{16,}")),
    Detector("STRIPE_WEBHOOK", "high", _key("whsec_", "[A-Za-z0-9]{24,}")),
    Detector("GITHUB_TOKEN", "critical", _key("gh[pousr]_", "[A-Za-z0-9]{36,}")),
    Detector("GITHUB_PAT", "critical", _key("github_pat_", "[A-Za-z0-9_]{60,}")),
    Detector("GITLAB_TOKEN", "critical", _key("glpat-", r"[A-Za-z0-9_\-]{20,}")),
    Detector("SLACK_TOKEN", "critical", _key("xox[abeprs]-", r"[A-Za-z0-9\-]{10,}")),
    Detector("SLACK_WEBHOOK", "high", r"(https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,})"),
    Detector("MODEL_PROVIDER_KEY", "critical", _key("sk-(?:ant|proj|svcacct|admin)-", r"[A-Za-z0-9_\-]{16,}")),
    Detector("SECRET_KEY", "critical", _key("sk-(?:live|test)-", "[A-Za-z0-9]{4,}")),
    Detector("SECRET_KEY", "critical", _key("sk-", "[A-Za-z0-9]{32,}")),
    Detector("NPM_TOKEN", "critical", _key("npm_", "[A-Za-z0-9]{36}")),
    Detector("PYPI_TOKEN", "critical", _key("pypi-", r"[A-Za-z0-9_\-]{40,}")),
    Detector("SENDGRID_KEY", "critical", _key(r"SG\.", r"[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}")),
    Detector("TWILIO_KEY", "high", _key("SK", "[0-9a-f]{32}")),
    Detector("MAILGUN_KEY", "high", _key("key-", "[0-9a-f]{32}")),
    Detector("DIGITALOCEAN_TOKEN", "critical", _key("do[opr]_v1_", "[0-9a-f]{64}")),
    Detector("SHOPIFY_TOKEN", "critical", _key("shp(?:at|ca|pa|ss)_", "[0-9a-fA-F]{32}")),
    Detector("HUGGINGFACE_TOKEN", "critical", _key("hf_", "[A-Za-z0-9]{30,}")),
    Detector("TELEGRAM_TOKEN", "high", r"(?<![0-9])([0-9]{8,10}:AA[A-Za-z0-9_\-]{33})"),
    Detector("JWT", "high", _key("eyJ", r"[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}")),
    Detector("BEARER_TOKEN", "high", r"(?i:bearer)\s+([A-Za-z0-9_\-.~+/]{20,}=*)"),
    Detector("BASIC_AUTH", "high", r"(?i:authorization)[\"']?\s*[:=]\s*[\"']?(?i:basic)\s+([A-Za-z0-9+/]{8,}=*)"),
    Detector("PRIVATE_KEY", "critical", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?)"),
    Detector("CONNECTION_PASSWORD", "high", r"(?<![A-Za-z])[a-z][a-z0-9+]++://[^\s:/@\"']++:([^\s/@\"']{3,}+)@"),
    Detector("ASSIGNED_SECRET", "high", _ASSIGNED + r"[\"'](?=[^\"'0-9]*+[0-9])(?=[^\"'A-Za-z]*+[A-Za-z])([A-Za-z0-9_\-+/=.]{20,}+)[\"']"),
    Detector("POSSIBLE_CREDENTIAL", "medium", _ASSIGNED + r"[\"']([^\"'\s]{6,}+)[\"']"),
    Detector("EMAIL", "medium", r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24})(?![A-Za-z0-9])"),
    Detector("PRIVATE_IP", "medium", r"(?<![0-9.])((?:10\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9.])"),
)


def _found(text: Column, detector: Detector) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(1)))
    return F.when(may_match(text, detector.pattern), found).otherwise(F.array().cast("array<string>"))


def _preview(secret: Column) -> Column:
    size = F.length(secret)
    ends = F.when(size >= 16, F.concat(F.substring(secret, 1, 4), F.lit("…"), F.substring(secret, -4, 4))).otherwise(F.concat(F.substring(secret, 1, 1), F.lit("…")))
    return F.concat(ends, F.lit(" ("), size.cast("string"), F.lit(" chars)"))


def _raw_findings(text: Column) -> Column:
    """Findings with the secret in them; a secret that several detectors find counts for the first."""

    def told(detector: Detector) -> Column:
        return F.transform(_found(text, detector), lambda s: F.struct(F.lit(detector.type).alias("type"), F.lit(detector.severity).alias("severity"), s.alias("secret")))

    return F.concat(*map(told, DETECTORS))


def with_findings(docs: DataFrame, text: str = "text", policy: str = "redact") -> DataFrame:
    """``docs`` with ``secrets`` and, under "redact", with critical and high findings replaced in the text.

    ``secrets``: array of struct(type, severity, line, preview, redacted). A redaction is the prefix, the
    type, a number that counts the distinct secrets of that type in the text, and two underscores; a
    repeated secret keeps its number. Longer secrets are replaced before shorter ones. "warn" reports
    only, "off" looks for nothing. A null text has no findings.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    empty = "array<struct<type:string,severity:string,line:int,preview:string,redacted:boolean>>"
    if policy == "off":
        return docs.withColumn("secrets", F.array().cast(empty))
    source = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__raw", _raw_findings(source))
    # Every field of the report is derived before anything is replaced; the first detector of a secret speaks for it.
    out = out.withColumn("__raw", F.filter("__raw", lambda x, i: F.array_position(F.transform("__raw", lambda y: y["secret"]), x["secret"]) == i + 1))
    blocking = F.filter("__raw", lambda x: x["severity"].isin(*BLOCKING))
    out = out.withColumn("__block", blocking)
    rank = lambda x: F.size(F.filter("__block", lambda y: (y["type"] == x["type"]) & (F.array_position("__block", y) <= F.array_position("__block", x))))
    token = lambda x: F.concat(F.lit(REDACTION_PREFIX), x["type"], F.lit("_"), rank(x).cast("string"), F.lit("__"))
    out = out.withColumn("__swap", F.transform("__block", lambda x: F.struct((-F.length(x["secret"])).alias("size"), x["secret"].alias("secret"), token(x).alias("token"))))
    redact = policy == "redact"
    out = out.withColumn(
        "secrets",
        F.transform(
            "__raw",
            lambda x: F.struct(
                x["type"].alias("type"),
                x["severity"].alias("severity"),
                F.size(F.split(F.call_function("substring_index", source, x["secret"], F.lit(1)), "\n")).alias("line"),
                _preview(x["secret"]).alias("preview"),
                (x["severity"].isin(*BLOCKING) & F.lit(redact)).alias("redacted"),
            ),
        ),
    )
    if redact:
        swapped = F.aggregate(F.array_sort("__swap"), F.col(text), lambda acc, x: F.replace(acc, x["secret"], x["token"]))
        out = out.withColumn(text, F.when(F.size("__swap") > 0, swapped).otherwise(F.col(text)))
    return out.drop("__raw", "__block", "__swap")


def has_blocking(text: Column) -> Column:
    """Whether a text holds a critical or high secret."""
    return reduce(lambda a, b: a | b, [text.rlike(d.pattern) for d in DETECTORS if d.severity in BLOCKING])


def summarize(findings: DataFrame, secrets: str = "secrets") -> DataFrame:
    """(type, severity, n) over all rows' findings."""
    return findings.select(F.explode(secrets).alias("s")).groupBy("s.type", "s.severity").agg(F.count("*").alias("n"))
