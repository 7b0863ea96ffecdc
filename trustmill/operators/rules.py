"""Security predicates over text cells: the rule table, personal data, look-alike and invisible characters, findings."""

from __future__ import annotations

import hashlib
import hmac
import html
import unicodedata
import urllib.parse
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule, category, severity, confidence, pattern (matched without regard to case, ^ and $ at lines).
RULES = [
    ("prompt.role_boundary_marker", "prompt_injection", "REVIEW", 0.80, r"(?:<\|\s*(?:system|developer|assistant|tool|user)\s*\|>|#{2,}\s*(?:system|developer|assistant|tool|user)\s*:|\bBEGIN\s+(?:system|developer|assistant|tool|user)\s+MESSAGE\b|\bEND\s+(?:system|developer|assistant|tool|user)\s+MESSAGE\b)"),
    ("prompt.system_prompt_disclosure", "prompt_injection", "REVIEW", 0.90, r"(?:(?:reveal|disclose|show|print|return|dump|exfiltrate)\s+(?:the\s+)?(?:system\s+prompt|developer\s+message|hidden\s+instructions|tool\s+instructions|previous\s+messages|confidential\s+prompt)|(?:system\s+prompt|developer\s+message|hidden\s+instructions|tool\s+instructions|previous\s+messages|confidential\s+prompt)\s+(?:must\s+be\s+)?(?:revealed|disclosed|shown|printed|returned|dumped))"),
    ("prompt.developer_message_override", "prompt_injection", "REVIEW", 0.85, r"(?:(?:override|replace|ignore|bypass)\s+(?:the\s+)?(?:system|developer|assistant|tool)\s+(?:message|instructions|prompt|policy)|(?:act|respond|behave)\s+as\s+(?:the\s+)?(?:system|developer|admin|root)|developer\s+mode)"),
    ("prompt.ignore_previous_instructions", "prompt_injection", "BLOCK", 0.90, r"\bignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+instructions?\b"),
    ("prompt.system_prompt_leak", "prompt_injection", "BLOCK", 0.90, r"\b(?:reveal|show|print|dump|exfiltrate)\s+(?:the\s+)?(?:system|developer)\s+prompt\b"),
    ("prompt.role_override", "prompt_injection", "REVIEW", 0.75, r"\b(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be)\s+(?:a\s+)?(?:root|admin|developer|system|jailbroken)\b"),
    ("prompt.jailbreak_mode", "prompt_injection", "REVIEW", 0.75, r"\b(?:dan\s+mode|developer\s+mode|jailbreak|do\s+anything\s+now)\b"),
    ("prompt.policy_bypass", "prompt_injection", "REVIEW", 0.80, r"\b(?:bypass|disable|ignore|override)\s+(?:safety|policy|guardrails?|filters?|restrictions?)\b"),
    ("xss.script_tag", "xss", "BLOCK", 0.95, r"<\s*script\b[^>]*>"),
    ("xss.javascript_uri", "xss", "BLOCK", 0.90, r"\bjavascript\s*:"),
    ("xss.event_handler", "xss", "REVIEW", 0.85, r"\bon(?:load|error|click|mouseover|focus|submit|mouseenter|mouseleave)\s*="),
    ("xss.svg_onload", "xss", "BLOCK", 0.90, r"<\s*svg\b[^>]*\bonload\s*="),
    ("xss.iframe_srcdoc", "xss", "REVIEW", 0.80, r"<\s*iframe\b[^>]*\bsrcdoc\s*="),
    ("sqli.union_select", "sqli", "BLOCK", 0.90, r"\bunion\s+(?:all\s+)?select\b"),
    ("sqli.boolean_tautology", "sqli", "REVIEW", 0.75, r"""(?:'|\")?\s*(?:or|and)\s+(?:'|\")?\d+(?:'|\")?\s*=\s*(?:'|\")?\d+"""),
    ("sqli.comment_sequence", "sqli", "REVIEW", 0.65, r"(?:--|#|/\*)\s*$"),
    ("sqli.stacked_query", "sqli", "BLOCK", 0.85, r";\s*(?:drop|delete|insert|update|alter|create|truncate)\s+\w+"),
    ("sqli.time_based", "sqli", "REVIEW", 0.80, r"\b(?:sleep|benchmark|pg_sleep|waitfor\s+delay)\s*\("),
    ("cmd.shell_separator", "command_injection", "REVIEW", 0.80, r"(?:;|\|\||&&)\s*(?:cat|curl|wget|bash|sh|powershell|cmd|whoami|id|nc|netcat)\b"),
    ("cmd.command_substitution", "command_injection", "REVIEW", 0.80, r"(?:`\s*(?:cat|curl|wget|bash|sh|powershell|pwsh|cmd|whoami|id|nc|netcat|python|python3|perl|ruby|php|node|npx|npm|pip|pip3|chmod|chown|rm|del|copy|cp|mv|tar|zip|unzip|scp|ssh)\b[^`]*`|\$\(\s*(?:cat|curl|wget|bash|sh|powershell|pwsh|cmd|whoami|id|nc|netcat|python|python3|perl|ruby|php|node|npx|npm|pip|pip3|chmod|chown|rm|del|copy|cp|mv|tar|zip|unzip|scp|ssh)\b[^)]*\))"),
    ("cmd.powershell_encoded", "command_injection", "BLOCK", 0.90, r"\bpowershell(?:\.exe)?\b.*\s-(?:enc|encodedcommand)\b"),
    ("path.traversal_dotdot", "path_traversal", "REVIEW", 0.85, r"(?:\.\./|\.\.\\){2,}"),
    ("path.traversal_encoded", "path_traversal", "REVIEW", 0.85, r"(?:%2e%2e%2f|%2e%2e/|%252e%252e%252f|%c0%ae)"),
    ("path.sensitive_unix_file", "path_traversal", "REVIEW", 0.80, r"/etc/(?:passwd|shadow|hosts)\b"),
    ("path.sensitive_windows_file", "path_traversal", "REVIEW", 0.80, r"\bC:\\Windows\\(?:System32|win\.ini)"),
    ("template.jinja_arithmetic", "template_injection", "REVIEW", 0.75, r"\{\{\s*\d+\s*[*+\-/]\s*\d+\s*\}\}"),
    ("template.jndi_lookup", "template_injection", "BLOCK", 0.98, r"\$\{\s*jndi\s*:\s*(?:ldap|ldaps|rmi|dns|iiop|corba|nis|nds|http|https)\s*://"),
    ("template.java_runtime_exec", "template_injection", "BLOCK", 0.98, r"(?:\$\{\s*T\s*\(\s*java\.lang\.Runtime\s*\)\s*\.getRuntime\s*\(\s*\)\s*\.exec\s*\(|java\.lang\.Runtime\s*\.getRuntime\s*\(\s*\)\s*\.exec\s*\(|Runtime\s*\.getRuntime\s*\(\s*\)\s*\.exec\s*\()"),
    ("template.jsp_runtime_exec", "template_injection", "BLOCK", 0.98, r"<%\s*=?\s*.{0,120}?(?:Runtime\s*\.getRuntime\s*\(\s*\)\s*\.exec|java\.lang\.Runtime\s*\.getRuntime\s*\(\s*\)\s*\.exec)"),
    ("template.expression_runtime_exec", "template_injection", "BLOCK", 0.90, r"(?:\$\{\s*.{0,80}?(?:exec\s*\(|popen\s*\(|ProcessBuilder\s*\(|getRuntime\s*\(\s*\)).{0,120}?\})"),
    ("template.jinja_function_call", "template_injection", "REVIEW", 0.75, r"\{\{\s*[a-zA-Z_][\w.]{0,80}\s*\([^{}]{0,200}\)\s*\}\}"),
    ("template.jinja_code_execution", "template_injection", "BLOCK", 0.95, r"\{\{[^{}]{0,500}(?:popen|subprocess|os\.|eval\s*\(|exec\s*\(|__import__\s*\()[^{}]{0,500}\}\}"),
    ("ldap.wildcard_filter", "ldap_injection", "REVIEW", 0.75, r"\(\s*\|\s*\([^()=]{1,64}=\*\)\s*\)"),
    ("ldap.filter_breakout", "ldap_injection", "REVIEW", 0.65, r"\)\s*\(\s*\|"),
]
#: What a text must have, in lower case, for a rule to match: a cheap test before the pattern.
HINTS = {
    "xss.script_tag": ("script",), "xss.javascript_uri": ("javascript",), "xss.svg_onload": ("svg",), "xss.iframe_srcdoc": ("srcdoc",), "sqli.union_select": ("union",),
    "sqli.boolean_tautology": ("=",), "sqli.comment_sequence": ("--", "#", "/*"), "sqli.stacked_query": (";",), "sqli.time_based": ("sleep", "benchmark", "delay"),
    "xss.event_handler": ("onload", "onerror", "onclick", "onmouseover", "onfocus", "onsubmit", "onmouseenter", "onmouseleave"), "cmd.shell_separator": (";", "||", "&&"), "cmd.powershell_encoded": ("powershell",), "path.traversal_dotdot": ("../", "..\\"), "path.traversal_encoded": ("%2e", "%252e", "%c0%ae"),
    "path.sensitive_unix_file": ("/etc/",), "path.sensitive_windows_file": ("c:\\windows",), "template.jinja_arithmetic": ("{{",), "template.jndi_lookup": ("jndi",), "template.java_runtime_exec": ("getruntime",),
    "template.jsp_runtime_exec": ("<%",), "template.expression_runtime_exec": ("${",), "template.jinja_function_call": ("{{",), "template.jinja_code_execution": ("{{",), "ldap.wildcard_filter": ("|",),
    "ldap.filter_breakout": ("|",), "prompt.ignore_previous_instructions": ("instruction",), "prompt.system_prompt_leak": ("prompt",), "prompt.role_override": ("you", "act", "pretend"),
    "prompt.jailbreak_mode": ("mode", "jailbreak", "anything"), "prompt.policy_bypass": ("bypass", "disable", "ignore", "override"),
    "prompt.role_boundary_marker": ("<|", "##", "message"), "prompt.system_prompt_disclosure": ("prompt", "message", "instructions"), "prompt.developer_message_override": ("system", "developer", "assistant", "tool", "admin", "root"),
    "cmd.command_substitution": ("`", "$("),
}
#: Of these it must have one as well.
ALSO = {
    "prompt.role_boundary_marker": ("system", "developer", "assistant", "tool", "user"), "prompt.system_prompt_disclosure": ("reveal", "disclose", "show", "print", "return", "dump", "exfiltrate"),
    "prompt.developer_message_override": ("override", "replace", "ignore", "bypass", "act", "respond", "behave", "mode"), "prompt.role_override": ("root", "admin", "developer", "system", "jailbroken"),
    "sqli.stacked_query": ("drop", "delete", "insert", "update", "alter", "create", "truncate"),
}
#: Our own rules for secrets; they always block.
SECRETS = [
    ("secret.aws_access_key", "secret", "BLOCK", 0.95, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret.private_key", "secret", "BLOCK", 0.98, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("secret.token_assignment", "secret", "BLOCK", 0.80, r"\b(?:api[_-]?key|secret|token|password)\s*[:=]\s*['\"][A-Za-z0-9+/_=-]{16,}['\"]"),
]
SQL_LIKE = r"(?:select|insert|update|delete|drop|--|;|\bor\b|\band\b)"
#: Personal data rules.
SYNTHETIC_DOMAINS = ("example.com", "company.com", "test.com", "email.com")
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
PHONE = r"(?<![\w#])(?:\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?){1,3}\d{3,4}|\(\d{3}\)[\s.-]?\d{3}[\s.-]?\d{4}|\d{3}[\s.-]\d{3}[\s.-]\d{4})(?!\w)"
IBAN = r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
#: Cyrillic letters and the Latin ones they look like.
CYRILLIC = "аАеЕоОрРсСуУхХіІјЈѕЅѵѴӏԁԀԛԚԝԜЬВНКМТ"
LATIN = "aAeEoOpPcCyYxXiIjJsSvVldDqQwWbBHKMT"
#: A token, from its first letter on, that has an ASCII letter and a Cyrillic one of those.
MIXED = f"(?<![A-Za-zЀ-ӿ])(?=[Ѐ-ӿ]*+[A-Za-z])(?=[A-Za-zЀ-ӿ&&[^{CYRILLIC}]]*+[{CYRILLIC}])[A-Za-zЀ-ӿ]{{3,}}+"
INVISIBLE = r"[\p{Cf}\p{Cc}&&[^\n\r\t]]"
ENVIRONMENT_KEY = "TRUSTMILL_FINGERPRINT_KEY"


def plain_cells(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """column, row_index, text: the non-blank cells of text columns, one row each."""
    return _spread(df, columns, row, lambda text: {"text": text})


def _spread(df: DataFrame, columns: list[str], row: str, made) -> DataFrame:
    """The non-blank cells with what is made of each. It is made where cells are spread, so once; filters behind do not make it anew."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[v.alias(n) for n, v in made(F.col(f"`{c}`")).items()]) for c in columns])).alias("c")
    out = dealt(df, row).select(F.col(f"`{row}`").alias("row_index"), pairs).select("c.column", "row_index", *[f"c.{n}" for n in made(F.lit(None))])
    return out.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))


def dealt(df: DataFrame, row: str) -> DataFrame:
    """Rows of fewer files than there are cores are dealt out: a file may be one task's, and a cell's patterns cost more than to move it."""
    files = len(df.inputFiles())
    return df.repartition(F.col(f"`{row}`")) if 0 < files < df.sparkSession.sparkContext.defaultParallelism else df


def cells(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """plain_cells() with value_sha256."""
    return plain_cells(df, columns, row).withColumn("value_sha256", F.sha2("text", 256))


def plain_letters(text: Column) -> Column:
    """Lower case, with letters that a pattern takes for others whatever their case: the long s, the dotless and the dotted i."""
    some = text.contains("ſ") | text.contains("ı") | text.contains("İ") | text.contains("\u0307")
    return F.when(some, F.translate(F.lower(text), "ſıİ\u0307", "sii")).otherwise(F.lower(text))


def matching(text: Column, rules: list[tuple] = RULES, plain: Column | None = None) -> Column:
    """Array of the rules that a text matches, as structs. plain: its plain_letters(), if they are at hand."""
    plain = plain_letters(text) if plain is None else plain

    def hinted(rule: str) -> Column:
        out = F.lit(True)
        for table in (HINTS, ALSO):
            if rule in table:
                out = out & reduce(lambda a, b: a | b, [plain.contains(h) for h in table[rule]])
        return out

    hits = [F.when(hinted(r) & text.rlike("(?imdU)" + p), F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(q).alias("confidence"))) for r, c, s, q, p in rules]
    return F.array_compact(F.array(*hits))


def rule_findings(df: DataFrame, columns: list[str], row: str, rules: list[tuple] | None = None, variants: bool = False) -> DataFrame:
    """A finding for each rule and cell; with variants, also for normalised forms of the text."""
    if variants:
        out = text_variants(cells(df, columns, row)).select("column", "row_index", "value_sha256", F.explode(matching(F.col("text"), rules or RULES + SECRETS)).alias("r")).select("r.*", "column", "row_index", "value_sha256")
    else:  # texts are hashed where a rule has matched only
        found = _spread(df, columns, row, lambda text: {"text": text, "plain": plain_letters(text)})
        hit = found.select("column", "row_index", "text", F.explode(matching(F.col("text"), rules or RULES + SECRETS, F.col("plain"))).alias("r"))
        out = hit.select("r.*", "column", "row_index", F.sha2("text", 256).alias("value_sha256"))
    return dedupe_findings(out.withColumn("detector", F.lit("regex")).withColumn("subtype", F.col("rule_id"))) if variants else out


def text_variants(found: DataFrame) -> DataFrame:
    """Rows of cells() for each different form: as is, NFKC, then HTML-unescaped, then URL-unquoted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                forms = [text, unicodedata.normalize("NFKC", text)]
                forms.append(html.unescape(forms[-1]))
                forms.append(urllib.parse.unquote(forms[-1]))
                for form in dict.fromkeys(forms):
                    keep.append(i)
                    texts.append(form)
            columns = [pa.array(texts, pa.string()) if n == "text" else b.column(n).take(pa.array(keep, pa.int64())) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return found.mapInArrow(run, found.schema)


def fingerprint(value: str, key: bytes | None = None) -> str:
    raw = value.encode("utf-8", "replace")
    return hmac.new(key, raw, hashlib.sha256).hexdigest() if key else hashlib.sha256(raw).hexdigest()


def sql_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, hits: cells that look like SQL in the widest sense."""
    from .structural import _melt

    return _melt(df.agg(*[F.coalesce(F.sum(F.col(f"`{c}`").rlike("(?i)" + SQL_LIKE).cast("long")), F.lit(0)).alias(f"hits{i}") for i, c in enumerate(columns)]), columns, ["hits"])


def prompt_assertions(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """Findings of the five static prompt assertions, REVIEW at 0.85."""
    five = [r for r in RULES if r[0] in ("prompt.ignore_previous_instructions", "prompt.system_prompt_leak", "prompt.policy_bypass", "prompt.role_override", "prompt.jailbreak_mode")]
    return rule_findings(df, columns, row, [(r, c, "REVIEW", 0.85, p) for r, c, _, _, p in five])


def real_email(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    return F.exists(found, lambda m: ~F.lower(F.substring_index(m, "@", -1)).isin(*SYNTHETIC_DOMAINS))


def personal_data(text: Column) -> dict[str, Column]:
    """Rule -> whether a text holds it. Cards are judged by card_findings()."""
    return {"pii.regex.email": real_email(text), "pii.regex.ipv4": text.rlike(IPV4), "pii.regex.phone": text.rlike(PHONE), "pii.regex.iban": text.rlike(IBAN)}


def card_numbers(text: Column) -> Column:
    """Digit strings of 13 to 19 digits that pass the checksum, outside hexadecimal tokens, addresses of pages and longer words."""
    bare = F.regexp_replace(text, r"(?i)\b[0-9a-f]{32,}\b|https?://\S+|[A-Za-z_]\w*\d{13,}\w*|\d{13,}[A-Za-z_]\w*", " ")
    digits = F.transform(F.regexp_extract_all(bare, F.lit(CARD), F.lit(0)), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    return F.filter(digits, lambda d: F.call_function("luhn_check", d))


def homoglyph_tokens(text: Column) -> Column:
    """Tokens of three letters or more that mix ASCII letters with Cyrillic ones that look alike."""
    return F.regexp_extract_all(text, F.lit(MIXED), F.lit(0))


def latinised(text: Column) -> Column:
    return F.translate(text, CYRILLIC, LATIN)


def homoglyph_confidence(n: Column) -> Column:
    return F.when(n >= 5, 0.95).when(n >= 2, 0.90).when(n >= 1, 0.80)


def invisible_characters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVISIBLE))


KEY = ["category", "subtype", "rule_id", "detector", "column", "row_index", "value_sha256"]


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding of each key: the most confident, then the most severe."""
    rest = [c for c in findings.columns if c not in KEY]
    order = F.struct(*[F.col(f"`{c}`") for c in sorted(rest, key=lambda c: (c != "confidence", c))]).alias("o")
    best = findings.groupBy(*KEY).agg(F.max(order).alias("o"))
    return best.select(*[F.col(c) if c in KEY else F.col(f"o.{c}").alias(c) for c in findings.columns])


def suppress_urls_in_emails(findings: DataFrame) -> DataFrame:
    """Drops URL findings on cells where the same recogniser found an email address."""
    mail = findings.where((F.col("detector") == "presidio") & (F.upper("subtype") == "EMAIL_ADDRESS")).select("column", "row_index", "value_sha256").distinct()
    url = (F.col("detector") == "presidio") & (F.upper("subtype") == "URL")
    return findings.where(~url).unionByName(findings.where(url).join(mail, ["column", "row_index", "value_sha256"], "left_anti"))


def evidence(findings: DataFrame, df: DataFrame, row: str, limit: int = 500) -> DataFrame:
    """findings with the row they are about, values clipped."""
    clip = lambda c: F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...[truncated]"))).otherwise(c)
    values = df.select(F.col(f"`{row}`").alias("row_index"), F.to_json(F.struct(*[clip(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])).alias("evidence"))
    return findings.join(values, "row_index")
