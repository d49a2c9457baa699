"""Normalisation, validation and rendering rules as column expressions.

Every rule is a pair: a normalised value and a boolean "is valid" column, so whole tables can be
split into accepted and rejected rows in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that decide which input is accepted.
IDENTIFIER_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$"
SLUG_PATTERN = r"^[a-z0-9][a-z0-9-]{1,61}[a-z0-9]$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URI_PATTERN = r"^(https://|http://|s3://)"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
IDENTIFIER_MAX = 128
EXTERNAL_ID_MAX = 256
NAME_MAX = 200
EMAIL_MAX = 320
URI_MAX = 2048
VALUE_MAX_BYTES = 16384
METADATA_MAX_BYTES = 4096
EXCERPT_MAX = 8000
RATIONALE_MAX = 4000
REASON_MAX = 2000

# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.trim(c, F.lit(WHITE_SPACE))


def collapse(c: Column) -> Column:
    """Strip, and turn every inner run of white space into one space."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def _bounded(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(c).between(low, high), F.lit(False))


def normalize_identifier(c: Column) -> Column:
    return F.lower(strip(c))


def identifier_ok(normalized: Column) -> Column:
    return _bounded(normalized, 1, IDENTIFIER_MAX) & normalized.rlike(IDENTIFIER_PATTERN)


def normalize_external_id(c: Column) -> Column:
    return strip(c)


def external_id_ok(normalized: Column) -> Column:
    """1..256 characters, all printable (no control, format or exotic separator characters)."""
    return _bounded(normalized, 1, EXTERNAL_ID_MAX) & ~normalized.rlike(r"[\p{C}\p{Z}&&[^ ]]")


def normalize_slug(c: Column) -> Column:
    return F.lower(strip(c))


def slug_ok(normalized: Column) -> Column:
    return F.coalesce(normalized.rlike(SLUG_PATTERN), F.lit(False))


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))


def email_ok(normalized: Column) -> Column:
    return _bounded(normalized, 1, EMAIL_MAX) & normalized.rlike(EMAIL_PATTERN)


def normalize_name(c: Column) -> Column:
    return collapse(c)


def name_ok(normalized: Column) -> Column:
    return _bounded(normalized, 1, NAME_MAX)


def canonical_json(text: Column) -> Column:
    """Sorted keys, compact separators, raw Unicode; null for malformed text.

    The result is a fixed point: equal JSON values give equal text, which is what equality and
    hashing of values use. 1 and 1.0 are one value; booleans stay distinct from numbers.
    """
    return F.to_json(F.try_parse_json(text))


def escaped_bytes(json_text: Column) -> Column:
    """Bytes of the JSON text once every non-ASCII character is written as \\u escapes."""
    ascii_count = F.length(F.regexp_replace(json_text, r"[^\x00-\x7F]", ""))
    astral_count = F.length(F.regexp_replace(json_text, r"[^\x{10000}-\x{10FFFF}]", ""))
    other = F.length(json_text) - ascii_count - astral_count
    return ascii_count + 6 * other + 12 * astral_count


def fact_value_ok(canonical: Column) -> Column:
    """JSON, not null, small enough."""
    return F.coalesce(
        canonical.isNotNull() & (canonical != "null") & (escaped_bytes(canonical) <= VALUE_MAX_BYTES),
        F.lit(False),
    )


def value_sha256(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def normalize_confidence(c: Column) -> Column:
    """Three decimals, ties to even; null when not a number."""
    exact = c.cast("string").try_cast("decimal(38,18)")
    return F.bround(exact, 3).try_cast("decimal(4,3)")


def confidence_ok(normalized: Column) -> Column:
    return F.coalesce(normalized.between(0, 1), F.lit(False))


def authority_ok(c: Column) -> Column:
    return F.coalesce(c.between(0, 100), F.lit(False))


def normalize_uri(c: Column) -> Column:
    return strip(c)


def uri_ok(normalized: Column) -> Column:
    """A null uri is fine."""
    return normalized.isNull() | (
        (F.length(normalized) <= URI_MAX) & normalized.rlike(URI_PATTERN)
    )


def normalize_excerpt(c: Column) -> Column:
    """Unix line ends, no surrounding white space; inner content untouched."""
    return strip(F.regexp_replace(c, r"\r\n?", "\n"))


def excerpt_problem(normalized: Column) -> Column:
    """Null when storable, else the reason."""
    return (
        F.when(normalized.isNull() | (F.length(normalized) == 0), F.lit("empty_excerpt"))
        .when(F.length(normalized) > EXCERPT_MAX, F.lit("excerpt_too_long"))
        .when(F.instr(normalized, "\x00") > 0, F.lit("excerpt_has_nul"))
    )


def content_hash(normalized: Column) -> Column:
    return F.sha2(normalized.cast("binary"), 256)


def metadata_ok(text: Column) -> Column:
    """Null, or a small JSON object."""
    canonical = canonical_json(text)
    return text.isNull() | F.coalesce(
        canonical.startswith("{") & (escaped_bytes(canonical) <= METADATA_MAX_BYTES), F.lit(False)
    )


def normalize_rationale(c: Column) -> Column:
    stripped = strip(c)
    return F.when(F.length(stripped) > 0, stripped)


def rationale_ok(normalized: Column) -> Column:
    return normalized.isNull() | (F.length(normalized) <= RATIONALE_MAX)


def utc_iso(ts: Column) -> Column:
    """ISO-8601 with +00:00; microseconds only when they are not zero."""
    t = ts.cast("timestamp")
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == 0, F.concat(base, F.lit("+00:00"))).otherwise(
        F.concat(base, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("+00:00"))
    )


def window_contains(start: Column, end: Column, instant: Column) -> Column:
    """Half-open [start, end); a null end never ends."""
    return (start <= instant) & (end.isNull() | (end > instant))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def run_id(date: Column, commit: Column) -> Column:
    stamp = F.substring(F.regexp_replace(date, "[^0-9T]", ""), 1, 15)
    return F.concat(stamp, F.lit("-"), F.substring(commit, 1, 8))


def json_string(c: Column) -> Column:
    """A string rendered as a JSON string literal."""
    return F.get(F.regexp_extract_all(F.to_json(F.struct(c.alias("v"))), F.lit(r"(?s)^\{\"v\":(.*)\}$"), 1), 0)


def display_json(canonical: Column) -> Column:
    """Canonical JSON with a blank after every ',' and ':' that is not inside a string."""
    # Keep quoted strings whole: the pieces are either a quoted string, a separator or the rest.
    pieces = F.regexp_extract_all(
        canonical, F.lit(r'("(?:[^"\\]|\\.)*+"|[,:]|[^",:]+)'), 1
    )
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.isin(",", ":"), F.concat(p, F.lit(" "))).otherwise(p)), ""
    )
