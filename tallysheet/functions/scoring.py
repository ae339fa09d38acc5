"""Header and label scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysheet.functions.numeric import int_div
from tallysheet.functions.text import noisy_term, term

# Words that mark a kind of field, and the names it also goes by.
COMMON_TERMS = (
    (("name", "fullname"),
     ("full name", "student name", "participant name", "attendee name")),
    (("matric", "matriculation", "registration", "regno", "studentid"),
     ("matric no", "matric number", "matriculation number", "reg no", "registration number",
      "student id", "student number", "admission number")),
    (("department", "dept"),
     ("dept", "department", "programme", "program", "course")),
    (("level", "year"),
     ("level", "year", "class", "grade")),
    (("email", "mail"),
     ("email", "email address", "e mail", "mail")),
    (("phone", "telephone", "mobile"),
     ("phone", "phone number", "mobile", "mobile number", "tel", "telephone")),
    (("signature", "signed", "sign"),
     ("signature", "sign", "signed", "signature mark")),
    (("date",),
     ("date", "attendance date", "day")),
)
# An edit distance d scores d + 10, so accepted ones are at most 4.
ACCEPT_SCORE, ACCEPT_DISTANCE = 14, 4
PAIR_DEFAULT = 74
FALLBACK_COLUMN = 58
FALLBACK_COLUMN_GEO = 62
FALLBACK_PAIR = 62
FALLBACK_FORM = 56


def configured_terms(key: Column, label: Column, aliases: Column) -> Column:
    return F.transform(F.concat(F.array(key, label), F.coalesce(aliases, F.array())), term)


def field_terms(configured: Column) -> Column:
    """Configured terms plus the common names of every group they trigger."""
    terms = configured
    for triggers, names in COMMON_TERMS:
        hit = F.exists(configured, lambda t: t.rlike("|".join(triggers)))
        extra = F.array(*[F.lit(n.replace(" ", "")) for n in names])
        terms = F.array_union(terms, F.when(hit, extra).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(terms), lambda t: F.length(t) >= 2)


def variants(terms: Column) -> Column:
    """Each term and its noisy reading, distinct and non-empty."""
    both = F.array_distinct(F.concat(terms, F.transform(terms, noisy_term)))
    return F.filter(both, lambda t: t != "")


def own_variants(one: Column, noisy: Column) -> Column:
    """`variants` of one term whose noisy reading is known, without a lambda so that it is compiled."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(one, F.lit("")) == "", none).when(one == noisy, F.array(one)).otherwise(F.array(one, noisy))


def pair_score(a: Column, b: Column, farthest: int | None = None) -> Column:
    """N7 for one pair of terms; lower is better, null is no match.

    `farthest` stops the edit distance early and drops pairs farther apart than it.
    """
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    allowed = F.greatest(F.lit(2), int_div(long * 22, F.lit(100)))
    if farthest is None:
        distance = F.levenshtein(a, b)
    else:
        allowed = F.least(allowed, F.lit(farthest))
        distance = F.levenshtein(a, b, farthest)
    near = F.when((long - short <= allowed) & (short > 1), distance)
    return (
        F.when(a == b, 0)
        .when((short >= 3) & (a.contains(b) | b.contains(a)), (long - short + 2).cast("int"))
        .when((near >= 0) & (near <= allowed) & (near < short), (near + 10).cast("int"))
    )


def match_score(header_variants: Column, term_variants: Column, farthest: int | None = None) -> Column:
    """Best score over all pairs."""
    return F.array_min(
        F.flatten(
            F.transform(
                header_variants,
                lambda h: F.transform(term_variants, lambda t: pair_score(h, t, farthest)),
            )
        )
    )


def letters_of(text: Column) -> Column:
    """The letters and digits of a term (N3) as bits of a number."""
    bits = [F.when(text.contains(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")]
    found = bits[0]
    for bit in bits[1:]:
        found = found.bitwiseOR(bit)
    return found


def may_be_accepted(a: Column, b: Column) -> Column:
    """False for `letters_of` terms that `accepted_score` cannot accept.

    A term that holds another has all of its letters, and an edit adds or removes one kind of letter at most.
    """
    only_a, only_b = a.bitwiseAND(F.bitwise_not(b)), b.bitwiseAND(F.bitwise_not(a))
    near = (F.bit_count(only_a) <= ACCEPT_DISTANCE) & (F.bit_count(only_b) <= ACCEPT_DISTANCE)
    return (only_a == 0) | (only_b == 0) | near


def accepted_score(a: Column, b: Column) -> Column:
    """`pair_score` of two terms (N3) where it is accepted; else null or above ACCEPT_SCORE.

    Lengths decide first, and the edit distance stands once, so that it is computed once.
    """
    size_a, size_b = F.octet_length(a), F.octet_length(b)  # terms are plain ASCII
    short, apart = F.least(size_a, size_b), F.abs(size_a - size_b)
    allowed = F.least(F.lit(ACCEPT_DISTANCE), F.greatest(F.lit(2), int_div(F.greatest(size_a, size_b) * 22, F.lit(100)))).cast("int")
    # -1, too far, becomes 999
    distance = F.pmod(F.call_function("levenshtein", a, b, F.least(allowed, short - 1)), F.lit(1000))
    return (
        F.when(a == b, 0)
        .when((apart <= ACCEPT_SCORE - 2) & (short >= 3) & (a.contains(b) | b.contains(a)), apart + 2)
        .when((apart <= allowed) & (short > 1), distance + 10)
    ).cast("int")


def match_confidence(score: Column) -> Column:
    """N8 in hundredths."""
    return F.when(score == 0, 96).when(score <= 4, 90).when(score <= 8, 82).otherwise(72)
