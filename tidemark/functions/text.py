"""Token rules, set similarity, clean-up of volatile text, and small scalar functions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the pair tokenizer.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
# Stop words of the symptom tokenizer.
SYMPTOM_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "may", "might", "must", "shall",
    "and", "or", "but", "if", "then", "else", "when", "where", "while", "as", "of", "to", "in", "on", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "from", "up", "down", "out", "off", "over", "under", "again", "further", "i", "you", "he", "she", "it",
    "we", "they", "what", "which", "who", "whom", "this", "that", "these", "those", "error", "info", "warning", "warn", "debug", "trace", "fatal", "line", "file", "thread", "exception", "stack",
)
# Identifiers that the pair tokenizer removes, in this order.
CLEANED = (
    r"(?i)\b(?:during|scenario)\s+[a-z0-9]+(?:-[a-z0-9]+){1,}\b",
    r"(?i)\b[a-f0-9]{16,64}\b",
    r"(?i)\b[\w.-]+-\d{8}T\d{6}Z-[\w.-]+\b",
    r"(?i)\b\d{4}-\d{2}-\d{2}-[a-z0-9_.-]+\b",
    r"\b[A-Z][A-Z0-9]+-\d+\b",
)
# Volatile parts of log lines and what stands for them, in this order.
VOLATILE = (
    (r"\b\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:\d{2})?\b", "<ts>"),
    (r"\b[0-9a-f]{32}\b", "<tid>"),
    (r"\b[0-9a-f]{16}\b", "<sid>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b1\d{12,18}\b", "<epoch>"),
    (r"latency_ms=\d+(?:\.\d+)?", "latency_ms=<n>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d{1,5}\b", "<ip:port>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    (r":\d{4,5}\b", ":<port>"),
    (r"-[a-f0-9]{8,10}-[a-z0-9]{5}\b", "-<pod>"),
    (r"(/product/)[A-Z0-9]{8,16}\b", "$1<sku>"),
    (r"(product\s+#\"?)[A-Z0-9]{8,16}(\")?", "$1<sku>"),
)
# The same for event sequences.
SEQUENCE = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b[0-9a-f]{32}\b", "<TRACE>"),
    (r"\b[0-9a-f]{16}\b", "<SPAN>"),
    (r"\b\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:\d{2})?\b", "<TS>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?\b", "<IP>"),
    (r"-[a-f0-9]{7,}-[a-z0-9]{5}\b", "-<HASH>-<ID>"),
    (r"\b[0-9a-f]{8,}\b", "<HEX>"),
    (r"\b\d{6,}\b", "<N>"),
)
# Coarse error classes, by what a text mentions.
ERROR_CLASSES = (
    ("timeout", r"(?i)\btimeout\b|\bdeadline\b|\bdeadlineexceeded\b"),
    ("unavailable", r"(?i)\bunavailable\b|\bconnectionrefused\b|\bENOTFOUND\b"),
    ("redis_failure", r"(?i)\bredis\b.*\b(error|failed|refused|timeout)\b"),
    ("oom", r"(?i)\bOOM\b|\boutofmemory\b|memory.*saturat"),
    ("dns_failure", r"(?i)\bDNS\b|\bnoSuchHost\b|name.*resolution"),
    ("server_error", r"(?i)\b5\d\d\b|\binternal.*error\b|\bservererror\b"),
    ("client_error", r"(?i)\b4\d\d\b|\binvalid\b|\bvalidation\b"),
    ("crash", r"(?i)\bpanic\b|\bunhandled\b|\bsegfault\b"),
    ("canceled", r"(?i)\bcanceled\b"),
    ("not_found", r"(?i)\bnotfound\b|\bnot_found\b"),
)
# Reasons, by what a text mentions; the first that fits holds.
REASONS = (
    ("outage", r"(?i)outage|down|unavailable|cannot connect|not responding"),
    ("latency_regression", r"(?i)slow|latency|timeout|hangs|freezes"),
    ("restart_with_impact", r"(?i)restart|crash|oom|out of memory|killed|crashloop"),
    ("network", r"(?i)network|partition|packet loss|connection refused|dns"),
)
# Bands of p95 latency in ms, lower bound inclusive.
LATENCY_BANDS = ((0, 50, "p95_under_50ms"), (50, 250, "p95_50_to_250ms"), (250, 1000, "p95_250ms_to_1s"), (1000, 5000, "p95_1s_to_5s"), (5000, 10**9, "p95_over_5s"))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def words_a(c: Column) -> Column:
    """Lower-cased runs of letters a-z and digits, of two characters or more."""
    return F.filter(_all(F.lower(c), r"[a-z0-9]+"), lambda x: F.length(x) >= 2)


def words_b(c: Column) -> Column:
    """Identifiers of two characters or more, lower-cased; repeated ones stay."""
    return F.transform(_all(c, r"[A-Za-z_][A-Za-z0-9_]+"), F.lower)


def cleaned(c: Column) -> Column:
    """Text without identifiers of runs, windows, scenarios and issues, white space as one space."""
    for pattern in CLEANED:
        c = F.regexp_replace(c, pattern, " ")
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def words_c(c: Column) -> Column:
    """Words of the cleaned lower-cased text without stop words and single characters; repeated ones stay."""
    return F.filter(_all(cleaned(F.lower(c)), r"[a-z0-9_]+"), lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))


def symptom_words(c: Column) -> Column:
    """Distinct symptom words of three characters or more."""
    return F.array_distinct(F.filter(_all(F.lower(c), r"[a-z][a-z0-9_]{2,}"), lambda x: ~x.isin(*SYMPTOM_STOP_WORDS)))


def corpus_words(c: Column) -> Column:
    """Distinct identifiers of three characters or more, lower-cased."""
    return F.array_distinct(F.transform(_all(c, r"[A-Za-z_][A-Za-z_0-9]{2,}"), F.lower))


def stem(w: Column) -> Column:
    """A word without the first of the endings ing, ed, es, s that leaves three characters; else null."""
    out = F.lit(None).cast("string")
    for end in ("s", "es", "ed", "ing"):
        fits = w.endswith(end)
        long = F.length(w) > len(end) + 2
        out = F.when(fits & long, w.substr(F.lit(1), F.length(w) - len(end))).otherwise(out)
    return out


def rerank_words(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of three characters or more with their stems."""
    ws = F.filter(_all(F.lower(c), r"[a-z][a-z0-9]{2,}"), lambda x: ~x.isin(*stop))
    return F.array_distinct(F.concat(ws, F.array_compact(F.transform(ws, stem))))


def camel_parts(c: Column) -> Column:
    """Parts of a CamelCase name."""
    return _all(c, r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+")


def service_of_pod(c: Column) -> Column:
    """A pod's name without its two trailing hashes; null where it has no '-'."""
    parts = F.split(c, "-")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "-")).when(F.size(parts) == 2, c)


def _lower_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x))), lambda x: x.isNotNull() & (x != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two string arrays, trimmed and lower-cased; 0 where both are empty."""
    x, y = _lower_set(a), _lower_set(b)
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / every)


def replaced(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Text after replacements in order."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip_volatile(c: Column) -> Column:
    """A log line without what differs between requests and instances."""
    return replaced(c, VOLATILE)


def normal_sequence(c: Column) -> Column:
    """A line of an event sequence without identifiers and long numbers."""
    return replaced(c, SEQUENCE)


def error_classes(c: Column) -> Column:
    """Coarse error classes that a text mentions, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")).rlike(p), F.lit(name)) for name, p in ERROR_CLASSES]))


def reason_class(c: Column) -> Column:
    """The first reason that a text mentions, else 'other'."""
    out = F.lit("other")
    for name, p in reversed(REASONS):
        out = F.when(F.coalesce(c, F.lit("")).rlike(p), name).otherwise(out)
    return out


def latency_band(ms: Column) -> Column:
    """Band of a p95 latency; null where it is null, zero or less, or beyond every band."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(LATENCY_BANDS):
        out = F.when((ms >= low) & (ms < high) & (ms > 0), name).otherwise(out)
    return out


def hash_mod_10(c: Column) -> Column:
    """int(sha256(text), 16) modulo 10, without wide integers: 16 and all its powers leave 6."""
    digits = F.transform(F.split(F.sha2(c, 256), ""), lambda x: F.conv(x, 16, 10).cast("int"))
    digits = F.filter(digits, lambda x: x.isNotNull())
    total = F.aggregate(digits, F.lit(0), lambda s, x: s + x)
    last = F.element_at(digits, -1)
    return F.pmod(F.lit(6) * (total - last) + last, F.lit(10))


def family_split(family: Column) -> Column:
    """A family's split by the hash of its name: 0-1 test, 2-3 validation, else train."""
    h = hash_mod_10(family)
    return F.when(h <= 1, "test").when(h <= 3, "validation").otherwise("train")


def slug(c: Column) -> Column:
    """Lower-cased text with runs of other characters as one '-', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def run_of_window(c: Column) -> Column:
    """The run part of a window id: up to its first '-rN-'; empty where there is none."""
    return F.regexp_extract(c, r"^(.*?-r\d+)-", 1)


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s++$", "")


def family_key(c: Column) -> Column:
    """A family in one spelling: trimmed, lower-cased, runs of '-', '_' and spaces as one '-'."""
    return F.regexp_replace(F.lower(trimmed(c)), r"(?U)[-_\s]+", "-")


def iso_timestamp(c: Column) -> Column:
    """An ISO time string (Z, +00:00 or +0000, any number of fraction digits) as a UTC timestamp in microseconds; null if it is none."""
    c = F.regexp_replace(F.btrim(c), r"(\.\d{6})\d+", "$1")
    c = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.try_to_timestamp(c)
