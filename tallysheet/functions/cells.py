"""Type-directed cell cleaning (N1, J10, T12) as one chain of projections.

Every step that later steps read more than once is a column of its own, so it is computed
once per row and only for the types that need it. Confidences are whole hundredths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import clean_text, noisy_term, squash, unaccented

# Texts read as a signature, and as its absence.
SIGNED_TERMS = (
    "x", "yes", "y", "ok", "tick", "check", "checked", "signed", "present", "signature",
    "signaturemark",
)
UNSIGNED_TERMS = ("no", "n", "absent", "unsigned", "missing")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Confidence in hundredths per outcome.
TEXT_OK, EMAIL_OK, PHONE_OK, NUMBER_OK, DATE_OK = 90, 94, 90, 92, 90
EMAIL_BAD, PHONE_BAD, NUMBER_BAD, DATE_BAD, OPTION_BAD = 42, 44, 40, 40, 46
NO_OPTIONS, SEVERAL_CAP, LIST_CAP, REQUIRED_CAP = 78, 68, 90, 50
OPTION_EXACT, OPTION_CONTAINS, OPTION_EDIT = 92, 78, 72
MISSING_REQUIRED, MISSING_OPTIONAL = 34, 68
SIGNED, NOT_SIGNED, UNCLEAR = 88, 84, 72


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def option_terms(options: Column) -> Column:
    """Declared options as structs with both comparison terms; done once per field."""
    cleaned = F.filter(F.transform(options, clean_text), lambda o: o != "")
    with_terms = F.transform(
        cleaned, lambda o: F.struct(o.alias("option"), squash(unaccented(o)).alias("term"))
    )
    return F.transform(
        with_terms,
        lambda s: F.struct(
            s["option"].alias("option"), s["term"].alias("term"),
            noisy_term(s["term"]).alias("noisy"),
        ),
    )


OPTION_TERMS = "array<struct<option:string,term:string,noisy:string>>"


def match_options(probes: str, options: str) -> str:
    """J10 as SQL: for each probe struct(term, noisy) the best option as
    struct(confidence, place, option), null when none is close enough.

    Exact beats contained beats a small edit distance; ties go to the first option (D9),
    an empty term matches nothing (D8).
    """
    contained = " OR ".join(
        f"contains({x}, {y}) OR contains({y}, {x})" for x in ("p.term", "p.noisy") for y in ("o.term", "o.noisy")
    )
    distance = ", ".join(
        f"levenshtein({x}, {y})" for x in ("p.term", "p.noisy") for y in ("o.term", "o.noisy")
    )
    allowed = "greatest(1, greatest(length(p.term), length(o.term)) div 5)"
    score = f"""CASE WHEN p.term = '' OR o.term = '' THEN NULL
        WHEN p.term IN (o.term, o.noisy) OR p.noisy IN (o.term, o.noisy) THEN {OPTION_EXACT}
        WHEN length(o.term) >= 4 AND ({contained}) THEN {OPTION_CONTAINS}
        WHEN abs(length(p.term) - length(o.term)) <= {allowed} AND least({distance}) <= {allowed}
        THEN {OPTION_EDIT} END"""
    return f"""transform({probes}, p -> array_max(filter(
        transform({options}, (o, i) -> struct({score} AS confidence, -i AS place, o.option AS option)),
        m -> m.confidence IS NOT NULL)))"""


# Spellings an e-mail address is repaired from, in the order applied.
EMAIL_REPAIRS = (
    (r"(?U)\s+(?:at|\(at\)|\[at\])\s+", "@"),
    (r"(?U)\s+(?:dot|\(dot\)|\[dot\])\s+", "."),
    (r"(?U)\s*@\s*", "@"),
    (r"(?U)\s*\.\s*", "."),
    (r",", "."),
    (r"c0m(?![A-Za-z0-9_])", "com"),
    (r"0rg(?![A-Za-z0-9_])", "org"),
    (r"c0(?![A-Za-z0-9_])", "co"),
    (r"(?U)\s+", ""),
)
# Letters commonly read in place of digits.
DIGIT_LETTERS = "'OoIl|SsBb', '001115588'"
DATE_LETTERS = "'OoIl|Ss', '0011155'"
ISO_DATE = r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$"
LOCAL_DATE = r"^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}$"
NAMED_DATE = r"^[0-9OoIlSs]{1,2}\s+[A-Za-z]+\s+[0-9OoIlSs]{2,4}$"


def _email_text() -> str:
    text = "lower(raw_value)"
    for pattern, to in EMAIL_REPAIRS:
        text = f"regexp_replace({text}, r'{pattern}', '{to}')"
    return text


def normalize_cells(
    cells: DataFrame,
    raw: str = "raw_text",
    kind: str = "type",
    required: str = "required",
    options: str = "option_terms",
) -> DataFrame:
    """N1 over cells that already carry their field's type, required flag and option terms.

    Adds raw_value, normalized_value, value_kind, confidence_pct and issues.
    """
    k, chosen = f"`{kind}`", f"`{kind}` IN ('select', 'multi_select')"
    steps = [{
        "raw_value": F.coalesce(clean_text(F.col(raw)), F.lit("")),
        "_must": F.coalesce(F.col(required), F.lit(False)),
        "_options": F.coalesce(F.col(options), F.array().cast(OPTION_TERMS)),
    }, {
        "_fixed": F.expr(rf"""CASE {k} WHEN 'email' THEN {_email_text()}
            WHEN 'phone' THEN regexp_replace(translate(raw_value, {DIGIT_LETTERS}), '[^0-9+]', '')
            WHEN 'number' THEN regexp_replace(translate(raw_value, {DIGIT_LETTERS}), r'(?U)[,\s]', '')
            WHEN 'date' THEN translate(raw_value, {DATE_LETTERS}) END"""),
        "_folded": F.when(
            F.expr(f"{chosen} OR {k} = 'signature'"), unaccented(F.col("raw_value"))
        ),
    }, {
        "_term": squash(F.col("_folded")),
        "_phone": F.expr(f"""CASE WHEN {k} = 'phone' THEN
            if(startswith(_fixed, '00'), concat('+', substr(_fixed, 3)), _fixed) END"""),
        "_form": F.expr(rf"""CASE WHEN {k} <> 'date' THEN NULL WHEN _fixed RLIKE r'{ISO_DATE}' THEN 'iso'
            WHEN _fixed RLIKE r'{LOCAL_DATE}' THEN 'local' WHEN raw_value RLIKE r'{NAMED_DATE}' THEN 'named' END"""),
        "_parts": F.expr(rf"""CASE WHEN {chosen} AND size(_options) > 0 THEN filter(transform(
            split(_folded, r'(?i)(?U)\s*(?:,|;|(?<![A-Za-z0-9_])and(?![A-Za-z0-9_]))\s*'), p -> btrim(p, ' :;,.')), p -> p <> '') END"""),
        "_whole": F.expr(rf"""CASE WHEN {k} = 'number' AND _fixed RLIKE r'^[-+]?[0-9]+(\.[0-9]+)?$'
            THEN regexp_replace(regexp_extract(_fixed, r'^[-+]?0*([0-9]*)', 1), '^$', '0') END"""),
    }, {
        "_terms": F.when(
            F.col("_parts").isNotNull(),
            F.concat(F.array("_term"), F.transform("_parts", squash)),
        ),
        "_digits": F.expr("regexp_replace(_phone, '[^0-9]', '')"),
        "_bits": F.expr("if(_form = 'named', split(raw_value, ' '), split(_fixed, '[-/.]'))"),
        "_size": F.expr(r"""CASE WHEN _whole IS NULL THEN NULL
            WHEN regexp_extract(_fixed, r'\.([0-9]*?)0*$', 1) = '' THEN _whole
            ELSE concat(_whole, '.', regexp_extract(_fixed, r'\.([0-9]*?)0*$', 1)) END"""),
    }, {
        "_probes": F.transform(
            "_terms", lambda t: F.struct(t.alias("term"), noisy_term(t).alias("noisy"))
        ),
        "_numbers": F.expr(f"""CASE WHEN _form = 'named' THEN array(
              try_cast(translate(_bits[2], {DATE_LETTERS}) AS INT),
              int(array_position(array({sql_list(MONTHS)}), lower(left(_bits[1], 3)))),
              try_cast(translate(_bits[0], {DATE_LETTERS}) AS INT))
            WHEN _form = 'iso' THEN transform(_bits, b -> try_cast(b AS INT))
            WHEN _form = 'local' THEN if(int(_bits[0]) <= 12 AND int(_bits[1]) > 12,
              array(int(_bits[2]), int(_bits[0]), int(_bits[1])),
              array(int(_bits[2]), int(_bits[1]), int(_bits[0]))) END"""),
    }, {
        "_found": F.expr(match_options("_probes", "_options")),
        "_year": F.expr("""CASE WHEN _numbers[0] >= 100 THEN _numbers[0]
            WHEN _numbers[0] >= 70 THEN _numbers[0] + 1900 ELSE _numbers[0] + 2000 END"""),
    }, {
        "_one": F.expr("_found[0]"),
        "_several": F.expr("slice(_found, 2, greatest(size(_found) - 1, 0))"),
        "_date": F.expr("""CASE WHEN _year BETWEEN 1900 AND 2100 THEN
            date_format(try_to_date(format_string('%04d-%02d-%02d', _year, _numbers[1], _numbers[2]), 'yyyy-MM-dd'),
              'yyyy-MM-dd') END"""),
    }, {
        "_names": F.expr("transform(_several, m -> m.option)"),
        "_all_match": F.expr("size(_several) >= 1 AND forall(_several, m -> m IS NOT NULL)"),
    }, {
        "_low": F.expr("""array_min(transform(
            filter(_several, (m, i) -> array_position(_names, m.option) = i + 1), m -> m.confidence))"""),
        "_names": F.expr("array_distinct(_names)"),
    }, {
        # Which of the outcomes below applies; anything after `ok_` has no issue.
        "_case": F.expr(rf"""CASE
            WHEN raw_value = '' THEN if(_must, 'missing_required', 'ok_missing')
            WHEN {k} = 'email' THEN if(_fixed RLIKE r'^[^\s@]+@[^\s@]+\.[^\s@]+$', 'ok_email', 'bad_email')
            WHEN {k} = 'phone' THEN if(length(_digits) BETWEEN 7 AND 15, 'ok_phone', 'bad_phone')
            WHEN {k} = 'number' THEN if(_size IS NOT NULL, 'ok_number', 'bad_number')
            WHEN {k} = 'date' THEN CASE WHEN _form IS NULL OR (_form = 'named' AND _numbers[1] = 0) THEN 'bad_date'
              WHEN _date IS NULL THEN 'invalid_date' ELSE 'ok_date' END
            WHEN {chosen} AND size(_options) = 0 THEN 'ok_no_options'
            WHEN {k} = 'select' THEN CASE WHEN _all_match AND size(_names) >= 2 THEN 'option_multiple'
              WHEN _one IS NOT NULL THEN 'ok_option' ELSE 'option_unknown' END
            WHEN {k} = 'multi_select' THEN if(_all_match, 'ok_options', 'options_unknown')
            WHEN {k} = 'signature' THEN CASE WHEN _term IN ({sql_list(SIGNED_TERMS)}) THEN 'ok_signed'
              WHEN _term NOT IN ({sql_list(UNSIGNED_TERMS)}) THEN 'signature_unclear'
              WHEN _must THEN 'signature_missing' ELSE 'ok_unsigned' END
            ELSE 'ok_text' END"""),
    }, {
        "normalized_value": F.expr(f"""CASE
            WHEN {k} = 'signature' THEN if(_case IN ('ok_signed', 'signature_unclear'), 'true', 'false')
            WHEN raw_value = '' THEN '' WHEN {k} = 'email' THEN _fixed
            WHEN {k} = 'phone' THEN if(contains(_phone, '+'), concat('+', _digits), _phone)
            WHEN _case = 'ok_number' THEN if(startswith(_fixed, '-') AND _size <> '0', concat('-', _size), _size)
            WHEN _case = 'ok_date' THEN _date WHEN _case = 'ok_option' THEN _one.option
            WHEN _case IN ('option_multiple', 'ok_options') THEN array_join(_names, ', ')
            ELSE raw_value END"""),
        "confidence_pct": F.expr(f"""int(CASE _case
            WHEN 'missing_required' THEN {MISSING_REQUIRED} WHEN 'ok_missing' THEN {MISSING_OPTIONAL}
            WHEN 'ok_email' THEN {EMAIL_OK} WHEN 'bad_email' THEN if(_must, least({EMAIL_BAD}, {REQUIRED_CAP}), {EMAIL_BAD})
            WHEN 'ok_phone' THEN {PHONE_OK} WHEN 'bad_phone' THEN if(_must, least({PHONE_BAD}, {REQUIRED_CAP}), {PHONE_BAD})
            WHEN 'ok_number' THEN {NUMBER_OK} WHEN 'bad_number' THEN if(_must, least({NUMBER_BAD}, {REQUIRED_CAP}), {NUMBER_BAD})
            WHEN 'ok_date' THEN {DATE_OK} WHEN 'bad_date' THEN {DATE_BAD} WHEN 'invalid_date' THEN {DATE_BAD}
            WHEN 'ok_no_options' THEN {NO_OPTIONS} WHEN 'ok_option' THEN _one.confidence
            WHEN 'option_multiple' THEN least({SEVERAL_CAP}, _low, if(_must, {REQUIRED_CAP}, 100))
            WHEN 'ok_options' THEN least({LIST_CAP}, _low)
            WHEN 'option_unknown' THEN {OPTION_BAD} WHEN 'options_unknown' THEN {OPTION_BAD}
            WHEN 'ok_signed' THEN {SIGNED} WHEN 'ok_unsigned' THEN {NOT_SIGNED}
            WHEN 'signature_missing' THEN {REQUIRED_CAP} WHEN 'signature_unclear' THEN {UNCLEAR}
            ELSE {TEXT_OK} END)"""),
        "issues": F.expr("if(startswith(_case, 'ok_'), CAST(array() AS ARRAY<STRING>), array(_case))"),
        "value_kind": F.expr(
            f"CASE WHEN {k} = 'signature' THEN 'boolean' WHEN _case = 'ok_number' THEN 'number' ELSE 'string' END"
        ),
    }]
    staged = cells
    for columns in steps:
        staged = staged.withColumns(columns)
    return staged.drop(*{c for columns in steps for c in columns if c.startswith("_")})


def canonical_options(chosen: Column, options: Column) -> Column:
    """Chosen options in declared order."""
    return F.array_join(F.filter(options, lambda o: F.array_contains(chosen, o)), ", ")
