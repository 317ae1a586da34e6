"""Predicates and projections over names, values, paths and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that hold a secret, and names that only describe one.
SECRET_NAME = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?(token|key)|credential|salt)"
NOT_SECRET_NAME = r"(?i)(_|^)(url|uri|endpoint|path|file|dir|header|prefix|suffix|pattern|regex|field|param|name|label|type|algorithm|scheme|format|template|env|var|placeholder|example|column|attr|arg|kwarg)s?$"
#: What stands in for a secret.
PLACEHOLDER = r"(?i)^\s*$|^(none|null|todo|tbd|placeholder|example|xxx+|\.\.\.|test|dummy|fake|sample|<.*>|\$\{.*\}|%\(.*\)s|\{.*\})\s*$"
PLACEHOLDER_PARTS = ("changeme", "change-me", "change_me", "your-", "your_", "yourkey", "replace-me", "replace_me", "insert-", "insert_", "placeholder", "example.com", "xxxxx", "notasecret", "dummy", "<", ">", "${", "{{")
URL_VALUE = r"(?i)^[a-z][a-z0-9+.-]*://"
KEY_LIKE = r"^[A-Za-z0-9+/=_\-]+$"
#: Formats of known credentials, the most specific first, with their severity.
SIGNATURES = (
    ("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", "critical"),
    ("aws_access_key", r"\b(A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b", "critical"),
    ("github_token", r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b", "critical"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "critical"),
    ("stripe_key", r"\b(sk|rk)_(live|test)_[A-Za-z0-9]{20,}\b", "critical"),
    ("openai_key", r"\bsk-(proj-)?[A-Za-z0-9_-]{20,}\b", "critical"),
    ("google_api_key", r"\bAIza[A-Za-z0-9_-]{35}\b", "high"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\b", "high"),
    ("connection_string", r"\b(postgres|postgresql|mysql|mongodb(\+srv)?|redis|amqp)://[^\s:@/]+:[^\s:@/]+@", "high"),
)
#: A requirement line's name, operator and version.
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(==|>=|~=)\s*([A-Za-z0-9][A-Za-z0-9.*+!-]*)"


def is_placeholder(value: Column) -> Column:
    parts = F.array(*[F.lit(p) for p in PLACEHOLDER_PARTS])
    return F.rlike(value, F.lit(PLACEHOLDER)) | F.exists(parts, lambda p: F.contains(F.lower(value), p))


def is_secret_assignment(name: Column, value: Column, least: int = 8) -> Column:
    return F.rlike(name, F.lit(SECRET_NAME)) & ~F.rlike(name, F.lit(NOT_SECRET_NAME)) & (F.length(value) >= least) & ~is_placeholder(value) & ~F.rlike(value, F.lit(URL_VALUE))


def signature(value: Column) -> tuple[Column, Column]:
    """(name, severity) of the first known format that the value holds; null for none."""
    name, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, pattern, s in reversed(SIGNATURES):
        hit = F.rlike(value, F.lit(pattern))
        name, severity = F.when(hit, F.lit(n)).otherwise(name), F.when(hit, F.lit(s)).otherwise(severity)
    return name, severity


def redact(value: Column) -> Column:
    return F.when(F.length(value) <= 8, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("********"), F.right(value, F.lit(2))))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty text. One walk over the sorted characters."""
    chars = F.array_sort(F.filter(F.split(value, ""), lambda c: c != ""))
    weight = lambda n: n * F.log2(n)
    state = lambda char, run, total: F.struct(char.alias("char"), run.alias("run"), total.alias("total"))

    def step(at: Column, char: Column) -> Column:
        same = at["char"] == char
        return state(char, F.when(same, at["run"] + 1.0).otherwise(F.lit(1.0)), F.when(same, at["total"]).otherwise(at["total"] + weight(at["run"])))

    n = F.size(chars).cast("double")
    walked = F.aggregate(chars, state(F.lit(""), F.lit(1.0), F.lit(0.0)), step, lambda at: at["total"] + weight(at["run"]))
    return F.when(F.size(chars) > 0, F.log2(n) - walked / n).otherwise(0.0)


def is_test_path(path: Column) -> Column:
    base, framed = basename(path), F.concat(F.lit("/"), path, F.lit("/"))
    return base.startswith("test_") | base.endswith("_test.py") | (base == "conftest.py") | framed.contains("/tests/") | framed.contains("/test/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def repo_name(url: Column) -> Column:
    return F.replace(F.regexp_extract(F.rtrim(url, F.lit("/")), r"([^/]*)$", 1), F.lit(".git"), F.lit(""))


def short_sha(sha: Column) -> Column:
    return F.nullif(F.left(F.coalesce(sha, F.lit("")), F.lit(7)), F.lit(""))


def renamed_path(raw: Column) -> Column:
    """The new path of a rename in `old => new` or `a/{old => new}/b` form."""
    braced = F.regexp_replace(raw, r"\{[^}]*=>\s*([^}]*?)\s*\}", "$1")
    braced = F.btrim(F.replace(braced, F.lit("//"), F.lit("/")), F.lit("/"))
    plain = F.trim(F.element_at(F.split(raw, "=>"), -1))
    return F.when(~raw.contains("=>"), raw).when(raw.contains("{") & raw.contains("}"), braced).otherwise(plain)


def code_lines(source: Column) -> Column:
    """Lines that hold something other than blanks or a comment."""
    return F.size(F.filter(F.split(source, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))).cast("long")


def joined_lines(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def line_slice(source: Column, start: Column, end: Column) -> Column:
    return joined_lines(F.split(source, "\n"), start, end)
