"""Classification of texts by ordered rules: formats, log kinds, content languages.

A rule is a kind and its tests; a test is a list of conditions that all hold. Conditions are "re" (an
expression that java.util.regex and RE2 read alike), "twice" (one found two times or more), "has" (a
literal) and "even" (the first two lines hold a separator equally often, twice at least). The same lists
give a Spark column and DuckDB SQL. Texts are read whole.

The rules are written from the formats' own documents, which are named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeshift import SHAPES

# RFC 9110 and RFC 5789.
_METHODS = "GET|HEAD|POST|PUT|DELETE|CONNECT|OPTIONS|TRACE|PATCH"
_KEY = "[A-Za-z_][A-Za-z0-9_-]*"
LANGUAGES = (
    # GNU diffutils, unified format: a range line, or both file lines.
    ("diff", [[("re", r"(?m)^@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+(?:,[0-9]+)? @@")], [("re", r"(?m)^--- \S"), ("re", r"(?m)^[+]{3} \S")], [("re", r"(?m)^diff --git ")]]),
    # RFC 8259: an object or an array from end to end.
    ("json", [[("re", r'(?s)^\{\s*(?:"|\}).*\}$|^\{\}$')], [("re", r'(?s)^\[\s*[\[{"0-9tfn\]-].*\]$|^\[\]$')]]),
    # Apache core and mod_rewrite directives.
    ("apacheconf", [[("re", r"(?m)^[ \t]*</(?:VirtualHost|Directory|Location|Files|IfModule)>")], [("re", r"(?m)^[ \t]*(?:ServerName|ServerAlias|DocumentRoot|ErrorLog|CustomLog|LoadModule|RewriteRule|RewriteCond)[ \t]+\S")]]),
    # XML 1.0 and HTML: a tag, a declaration or a comment comes first.
    ("markup", [[("re", r"(?s)^<(?:[A-Za-z]|!DOCTYPE|!--|\?xml).*>")]]),
    # YAML 1.2: a document marker, a key over an indented block, or a sequence.
    ("yaml", [[("re", r"(?m)^---[ \t]*$")], [("re", rf"(?m)^{_KEY}:[ \t]*\n[ \t]+(?:-[ \t]|{_KEY}:)")], [("re", r"^- [^\n]+\n(?:[ \t]+|- )\S")]]),
    # TOML 1.0: a table header and a typed value, or a multi-line string or array first.
    ("toml", [[("re", r"(?m)^\[{1,2}[A-Za-z0-9_.-]+\]{1,2}[ \t]*$"), ("re", rf"(?m)^{_KEY}[ \t]*=[ \t]*(?:[\"'\[{{0-9]|true|false)")], [("re", rf"^{_KEY}[ \t]*=[ \t]*(?:\"{{3}}|'{{3}}|\[)")]]),
    ("ini", [[("re", r"(?m)^\[[^\[\]\n]+\][ \t]*$"), ("re", r"(?m)^[A-Za-z][^=\n]*=")]]),
    # RFC 9112: a request line or a status line.
    ("http", [[("re", rf"(?m)^(?:{_METHODS}) \S+ HTTP/[0-9](?:[.][0-9])?")], [("re", r"(?m)^HTTP/[0-9](?:[.][0-9])? [1-5][0-9]{2}\b")]]),
    # nginx: a context that opens a block, and a directive that a semicolon ends.
    ("nginx", [[("re", r"(?m)^[ \t]*(?:http|events|server|upstream [^\s{]+|location [^{\n]+)[ \t]*\{[ \t]*$"), ("re", r"(?m);[ \t]*$")]]),
    # SQL-92: the statements, on one line.
    ("sql", [[("re", r"(?im)^[ \t]*(?:select\b.*\bfrom\b|insert[ \t]+into\b|update\b.*\bset\b|delete[ \t]+from\b|(?:create|alter|drop)[ \t]+(?:table|view|index|database)\b)")]]),
    # Python: definitions, imports by name, a first line that names the interpreter.
    ("python", [[("re", r"(?m)^[ \t]*(?:async )?def \w+\(.*\).*:")], [("re", r"(?m)^[ \t]*class \w+(?:\(.*\))?:")], [("re", r"(?m)^from [\w.]+ import ")], [("re", r"^#!\S*[/ ]python")]]),
    # Java language specification: package, import, modifiers before a declaration.
    ("java", [[("re", r"(?m)^package [\w.]+;")], [("re", r"(?m)^import (?:static )?javax?[.]")], [("re", r"\bpublic (?:(?:static|final|abstract) )*(?:class|interface|enum|void|int|boolean|String) ")]]),
    ("csharp", [[("re", r"(?m)^using System(?:[.]\w+)*;")], [("re", r"(?m)^namespace [A-Z][\w.]*[ \t]*[{;]?")]]),
    ("go", [[("re", r"(?m)^package [a-z]\w*$")], [("re", r"(?m)^func (?:\([^)\n]*\) )?\w+\(")]]),
    # A first line that names a shell, or a prompt.
    ("bash", [[("re", r"^#!\S*[/ ](?:ba|da|k|z)?sh\b")], [("re", r"^\$ \S")]]),
    # ECMAScript: declarations, functions, modules.
    ("javascript", [[("re", r"(?m)^[ \t]*(?:const|let|var) [\w$]+ = ")], [("re", r"\bfunction ?[\w$]*\(")], [("re", r"(?m)^export (?:default|const|function|class) ")], [("has", "=> {")]]),
    # RFC 4180: records of as many fields.
    ("csv", [[("even", ",")]]),
    ("log", [[("re", r"(?m)^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}")], [("re", r"(?m)^(?:\S+ ){0,4}\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b")]]),
)
LOG_KINDS = (
    # printk times: seconds since the start, with six decimals.
    ("kernel", [[("twice", r"(?m)^\[ *[0-9]+[.][0-9]{6}\] \S")]]),
    # RFC 3261: request line or status line.
    ("sip", [[("re", r"\b[A-Z]+ sips?:\S+ SIP/2[.]0\b")], [("re", r"(?m)^SIP/2[.]0 [1-6][0-9]{2}\b")]]),
    # RFC 5321: each relay adds a trace line.
    ("mail_headers", [[("twice", r"(?im)^Received:[ \t]")]]),
    # The common log format: host, identity, user, time, request.
    ("web_access", [[("re", r'(?m)^\S+ \S+ \S+ \[[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9:]{8} [+-][0-9]{4}\] "')]]),
    # AWS: resource names, and the fields of audit records.
    ("aws", [[("re", r"\barn:aws(?:-[a-z]+)*:[a-z0-9-]+:[a-z0-9-]*:[0-9]*:")], [("re", r'"eventSource"\s*:\s*"[a-z0-9-]+[.]amazonaws[.]com"')], [("re", r'"awsRegion"\s*:\s*"')]]),
    # Headers of the two filters, and the heading of the longer report.
    ("spam_report", [[("re", r"(?im)^X-Spam(?:d-Result|-Status|-Report):")], [("has", "Content analysis details")]]),
    # GPX 1.1: the root element.
    ("gpx", [[("re", r"(?i)<gpx\b")]]),
    # OpenSSH, sudo, su and PAM: what they tell the authentication log.
    ("auth", [[("twice", r"\bsshd\[[0-9]+\]:|\b(?:sudo|su)(?:\[[0-9]+\])?: |\bpam_unix\(|\bFailed (?:password|publickey) for |\bAccepted (?:password|publickey) for |\bauthentication failure\b")]]),
)
TIMES = "|".join(f"(?:{p})" for _, p in SHAPES)
#: The preset for a kind of log; the others have none.
PRESETS = {"sip": "sip-voip", "web_access": "nginx-apache", "aws": "aws-cloudwatch", "auth": "auth-logs"}
EXTENSIONS = {"json": "json", "xml": "xml", "csv": "csv", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def _separators(text: Column, line: int, sep: str) -> Column:
    found = F.split_part(text, F.lit("\n"), F.lit(line))
    return F.length(found) - F.length(F.replace(found, F.lit(sep), F.lit("")))


def _holds(text: Column, kind: str, what: str) -> Column:
    if kind == "even":
        return (_separators(text, 1, what) == _separators(text, 2, what)) & (_separators(text, 1, what) >= 2)
    if kind == "twice":
        return F.regexp_count(text, F.lit(what)) >= 2
    return {"re": text.rlike, "has": text.contains}[kind](what)


def first_kind(text: Column, rules, default: str = "plain") -> Column:
    """The kind of the first rule with an alternative whose conditions all hold."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, alternatives in rules:
        tests = [reduce(lambda a, b: a & b, [_holds(text, *c) for c in conditions]) for conditions in alternatives]
        out = out.when(reduce(lambda a, b: a | b, tests), kind)
    return out.otherwise(default)


def duck_first_kind(text: str, rules, default: str = "plain") -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def separators(line: int, sep: str) -> str:
        found = f"split_part({text}, chr(10), {line})"
        return f"(length({found}) - length(replace({found}, {quoted(sep)}, '')))"

    def holds(kind: str, what: str) -> str:
        if kind == "even":
            return f"{separators(1, what)} = {separators(2, what)} and {separators(1, what)} >= 2"
        return {"re": f"regexp_matches({text}, {quoted(what)})", "twice": f"len(regexp_extract_all({text}, {quoted(what)})) >= 2", "has": f"contains({text}, {quoted(what)})"}[kind]

    cases = " ".join(f"when {' or '.join('(' + ' and '.join(holds(*c) for c in conditions) + ')' for conditions in alternatives)} then '{kind}'" for kind, alternatives in rules)
    return f"case {cases} else '{default}' end"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def language(text: Column) -> Column:
    return first_kind(trimmed(text), LANGUAGES)


def log_kind(text: Column) -> Column:
    return first_kind(text, LOG_KINDS, "none")


def has_times(text: Column) -> Column:
    return text.rlike(TIMES)


def format_of(extension: Column, text: Column) -> Column:
    """json, xml, csv, yaml, toml by extension, else by the first character; else unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for ext, kind in EXTENSIONS.items():
        out = out.when(F.lower(extension) == ext, kind)
    first = F.substring(trimmed(text), 1, 1)
    return out.when(first.isin("{", "["), "json").when(first == "<", "xml").otherwise("unknown")


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def csv_first_bad_row(text: Column) -> Column:
    """The number (from 2) of the first record whose fields are not as many as the header's; null if none."""
    rows = F.filter(F.split(text, r"\r?\n"), lambda r: r != "")

    def commas(row: Column) -> Column:
        return F.regexp_count(F.regexp_replace(row, '"[^"]*"', ""), F.lit(","))

    bad = F.filter(F.transform(rows, lambda r, i: F.when(commas(r) != commas(F.get(rows, 0)), i + 1)), lambda x: x.isNotNull())
    return F.get(bad, 0)
