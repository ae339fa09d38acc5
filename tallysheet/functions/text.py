"""Text expressions (N2-N4, N10-N16, P14). All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters dropped or replaced by the cleaner.
BLANK_LIKE = " |¦"
SINGLE_QUOTES = "‘’"
DOUBLE_QUOTES = "“”"
DASHES = "‐‑‒–—―"
ZERO_WIDTH = "​‌‍﻿"
EDGE_CHARACTERS = " :;,."
FALLBACK_KEY = "field"

_FROM = BLANK_LIKE + SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + ZERO_WIDTH
_TO = "   " + "''" + '""' + "-" * len(DASHES)
_NOT_ASCII = r"[^\x00-\x7F]"
_NEEDS_CLEANING = r"[^ -{}~]|  "


def _unicode_form(text: Column, method: str) -> Column:
    """NFKC (`compose`) or NFKD (`decompose`) by ICU, skipped for plain ASCII."""
    converted = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(True)
    )
    return F.when(text.rlike(_NOT_ASCII), converted).otherwise(text)


def clean_text(text: Column) -> Column:
    """N2. Only text with a bar, two spaces together or anything but plain ASCII needs more than its edges trimmed."""
    plain = F.translate(_unicode_form(text, "compose"), _FROM, _TO)
    spaced = F.when(text.rlike(_NEEDS_CLEANING), F.regexp_replace(plain, r"(?U)\s+", " ")).otherwise(text)
    return F.btrim(spaced, F.lit(EDGE_CHARACTERS))


def unaccented(cleaned: Column) -> Column:
    """Lower-case compatibility decomposition of cleaned text, marks left in place."""
    return F.lower(_unicode_form(cleaned, "decompose"))


def squash(folded: Column) -> Column:
    """Keep only a-z and 0-9 of folded text, with `&` read as `and`."""
    return F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "")


def term(text: Column) -> Column:
    """N3."""
    return squash(unaccented(clean_text(text)))


def noisy_term(normalized: Column) -> Column:
    """N4 on a term: digits that look like letters become letters in mostly alphabetic text."""
    letters = F.length(F.regexp_replace(normalized, "[^a-z]", ""))
    digits = F.length(normalized) - letters
    return F.when(
        (letters > 0) & (digits <= letters), F.translate(normalized, "012568", "oizsgb")
    ).otherwise(normalized)


def field_key(label: Column) -> Column:
    """N10."""
    folded = F.replace(unaccented(label), F.lit("&"), F.lit(" and "))
    bare = F.regexp_replace(folded, "[̀-ͯ]", "")
    slug = F.btrim(F.regexp_replace(bare, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit(FALLBACK_KEY)).otherwise(slug)


def title_label(text: Column) -> Column:
    """Every word start upper-cased, the rest left alone."""
    spaced = F.btrim(F.regexp_replace(clean_text(text), r"(?U)[_\-\s]+", " "))
    pieces = F.regexp_extract_all(spaced, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    raised = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike("^[a-z]"), F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
        ).otherwise(p),
    )
    return F.array_join(raised, "")


def split_list(text: Column) -> Column:
    """Comma list, trimmed, blanks dropped."""
    parts = F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def is_populated(value: Column, kind: Column | None = None) -> Column:
    """A value that is neither missing, empty nor boolean false.

    Canonical values are text, so boolean false needs its `kind` ('boolean').
    """
    filled = value.isNotNull() & (value != "")
    if kind is None:
        return filled
    return filled & ~(F.coalesce(kind, F.lit("string")).eqNullSafe("boolean") & (value == "false"))


def signed_flag(value: Column) -> Column:
    """N14, as written: the exact texts `true` and `signed`."""
    return F.coalesce(value.isin("true", "signed"), F.lit(False))


def valid_email(value: Column) -> Column:
    """P14 for member lists."""
    return (F.length(value) <= 254) & value.rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]{2,}$")


def valid_phone(value: Column) -> Column:
    return value.rlike(r"(?U)^\+?[0-9()\-\s.]{7,32}$")


def inline_label(text: Column) -> Column:
    """Label of `label: value` text, null when there is none."""
    return _inline_part(text, 1)


def inline_value(text: Column) -> Column:
    return _inline_part(text, 2)


_INLINE = r"(?U)^(.{2,80}?)\s*[:;=]\s*(.+)$"


def _inline_part(text: Column, group: int) -> Column:
    cleaned = clean_text(text)
    parts = [clean_text(F.regexp_extract(cleaned, _INLINE, g)) for g in (1, 2)]
    return F.when((parts[0] != "") & (parts[1] != ""), parts[group - 1])


# Names whose values are hidden in diagnostics, in the order applied.
BEARER_HEADER = r"(authorization:\s*bearer\s+)[^\s,;]+"
ANY_BEARER = r"(bearer\s+)[^\s,;]+"
GATEWAY_KEY = "ocp-apim-subscription-key"
SECRET_NAMES = r"(?:api[_-]?key|subscription[_-]?key|token)"
ACCESS_TOKEN = r"access[_-]?token"
CLOUD_KEYS = r"(?:aws[_-]?)?(?:access[_-]?key[_-]?id|secret[_-]?access[_-]?key)"


def redaction_patterns(any_bearer: bool = False, access_token: bool = False) -> list[str]:
    names = [GATEWAY_KEY, SECRET_NAMES, *([ACCESS_TOKEN] if access_token else []), CLOUD_KEYS]
    assignments = [f"({name}[\"']?\\s*[:=]\\s*[\"']?)[^\"',\\s}}]+" for name in names]
    return [BEARER_HEADER, *([ANY_BEARER] if any_bearer else []), *assignments]


def redact_text(
    text: Column, limit: int | None = None, any_bearer: bool = False, access_token: bool = False
) -> Column:
    """Whitespace collapsed, secret values hidden, the first `limit` characters kept if given."""
    hidden = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    for pattern in redaction_patterns(any_bearer, access_token):
        hidden = F.regexp_replace(hidden, f"(?i){pattern}", "$1[redacted]")
    return hidden if limit is None else F.substring(hidden, 1, limit)


def export_name(title: Column, suffix: str = "", fallback: str = "records-export") -> Column:
    """S11."""
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    slug = F.substring(F.btrim(dashed, F.lit("-")), 1, 80)
    return F.concat(F.when(slug == "", F.lit(fallback)).otherwise(slug), F.lit(suffix))
