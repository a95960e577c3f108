"""Text columns: log parsing, templates, fingerprints, hashes, trigrams.

Everything here is a built-in JVM expression; none of it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns of the template rule, in the order they apply.
TOKEN_RULES = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\d+(?:ms|s|m|h|d)\b", "<DURATION>"),
    (r"\d+", "<NUM>"),
)

# The public Grok definitions behind the three log line shapes.
_ISO_TS = (
    r"\d{4}-(?:0?[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]|[1-9])[T ](?:2[0123]|[01]?\d):?[0-5]\d"
    r"(?::?(?:[0-5]?\d|60)(?:[:.,]\d+)?)?(?:Z|[+-](?:2[0123]|[01]?\d)(?::?[0-5]\d)?)?"
)
_LEVEL = (
    r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|"
    r"[Ww]arn?(?:ing)?|WARN?(?:ING)?|[Ee]rr?(?:or)?|ERR?(?:OR)?|[Cc]rit?(?:ical)?|CRIT?(?:ICAL)?|"
    r"[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)"
)
_MONTH = (
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b"
)
LINE_SHAPES = {
    "java": (
        rf"({_ISO_TS}) ({_LEVEL}) (\S+) (\S+) : (.*)",
        ("timestamp", "level", "thread", "logger", "message"),
    ),
    "exception": (
        r"((?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*): (.*)",
        ("exception_class", "exception_msg"),
    ),
    "syslog": (
        rf"<([1-9]\d*)>({_MONTH}) +((?:0[1-9]|[12]\d|3[01]|[1-9])) "
        r"((?:2[0123]|[01]?\d):[0-5]\d(?::(?:[0-5]?\d|60)(?:[:.,]\d+)?)?) "
        r"([0-9A-Za-z][0-9A-Za-z.-]*) (\S+): (.*)",
        ("syslog_pri", "month", "day", "time", "host", "tag", "message"),
    ),
}

PREVIEW_CHARS = 4096
WINDOW_SECONDS = 300


def normalize(c: Column) -> Column:
    """Message to template: ids, addresses, durations and numbers become placeholders.

    Every rule but the first needs a digit, so text without one skips the rest.
    """
    raw = F.coalesce(c, F.lit(""))
    pattern, token = TOKEN_RULES[0]
    first = out = F.regexp_replace(raw, pattern, token)
    for pattern, token in TOKEN_RULES[1:]:
        out = F.regexp_replace(out, pattern, token)
    return F.when(raw.rlike("[0-9]"), out).otherwise(first)


def _text_or_null_word(c: Column) -> Column:
    """A missing part hashes as the word ``null``, not as an empty or dropped part."""
    return F.coalesce(c, F.lit("null"))


def _digest(*parts: Column) -> Column:
    """sha256 that is never null, so a join on it adds no null check that would run the text rules again."""
    return F.coalesce(F.sha2(F.concat(*parts), 256), F.lit(""))


def fingerprint(service: Column, level: Column, template: Column) -> Column:
    """Stream-side fingerprint: sha256 of ``service:level:template``."""
    colon = F.lit(":")
    return _digest(_text_or_null_word(service), colon, _text_or_null_word(level), colon, _text_or_null_word(template))


def ingest_fingerprint(service: Column, level: Column, norm: Column) -> Column:
    """Store-side fingerprint: the same parts without separators."""
    return _digest(_text_or_null_word(service), _text_or_null_word(level), _text_or_null_word(norm))


def parse_log(c: Column, pattern: str = "java") -> Column:
    """Struct of the named parts of a line plus ``matched``; no match leaves the parts null.

    For the shapes with a ``message`` part, an unmatched line is its own message.
    """
    rx, names = LINE_SHAPES[pattern]
    matched = F.coalesce(c.rlike(rx), F.lit(False))
    parts = []
    for i, name in enumerate(names, start=1):
        miss = F.coalesce(c, F.lit("")) if name == "message" else F.lit(None).cast("string")
        parts.append(F.when(matched, F.regexp_extract(c, rx, i)).otherwise(miss).alias(name))
    return F.struct(*parts, matched.alias("matched"))


def log_body(c: Column) -> Column:
    """The message part of a Java line, else the line: one regex pass for the hot path."""
    rx = LINE_SHAPES["java"][0]
    whole = r"\A[\s\S]*?" + rx + r"[\s\S]*\z"
    return F.regexp_replace(F.coalesce(c, F.lit("")), whole, "$5")


def structured_fields(c: Column) -> Column:
    """The parsed parts as an open map, as carried inside a parsed log."""
    p = parse_log(c, "java")
    names = LINE_SHAPES["java"][1]
    full = F.create_map(*[x for n in names for x in (F.lit(n), p[n])])
    only = F.create_map(F.lit("message"), F.coalesce(c, F.lit("")))
    return F.when(p["matched"], full).otherwise(only)


def extract_json(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; the whole text when there is no such span."""
    span = F.regexp_extract(c, r"\{[\s\S]*\}", 0)
    return F.when(span != "", span).otherwise(c)


# The frame pattern and the banner put before the code of the anchored class.
STACK_FRAME = r"at\s+([a-zA-Z0-9._$]+)\.([a-zA-Z0-9_$]+)\("
ANCHOR_HEAD = "--- CRITICAL STACK CONTEXT MATCHED FOR CLASS "
ANCHOR_TAIL = " ---\n"


def anchor_context(trace: Column, code: Column) -> Column:
    """Prefix the code context with the class of the first stack frame, if there is one."""
    cls = F.regexp_extract(F.coalesce(trace, F.lit("")), STACK_FRAME, 1)
    return F.when(cls != "", F.concat(F.lit(ANCHOR_HEAD), cls, F.lit(ANCHOR_TAIL), code)).otherwise(code)


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    """At most ``n`` characters of a value, marked when cut; null reads as empty."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def window_id(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Number of the tumbling window a timestamp falls in; a missing one counts as now."""
    return F.floor(F.unix_seconds(F.coalesce(ts.cast("timestamp"), F.current_timestamp())) / seconds).cast("bigint")


def _blank_separated(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def distinct_words(c: Column) -> Column:
    """The distinct lower-case words, whose trigrams ``trigrams`` gives."""
    return F.filter(F.array_distinct(F.split(_blank_separated(c), " ")), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """Distinct padded word trigrams: two blanks before and one after each lower-case word.

    The distinct words are laid out with three blanks between them, so every window of three characters is
    a trigram of one word unless it ends in two blanks; one linear scan yields them all.
    """
    words = _blank_separated(c)
    padded = F.concat(F.lit("  "), F.array_join(F.array_distinct(F.split(words, " ")), "   "), F.lit(" "))
    grams = F.regexp_extract_all(padded, F.lit(r"(?=(...))"), F.lit(1))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(grams, lambda g: ~g.endswith("  ")))
    )
