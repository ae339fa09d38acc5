"""Cell cleaning, text functions and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from tallysheet.functions import cells as c
from tallysheet.functions import scoring, text
from tallysheet.functions.numeric import blend_confidence


def _noise(column):
    """Digits written as the letters they are confused with."""
    return F.translate(column, "015", "OlS")


def _cell_result(df, *ids):
    return c.normalize_cells(df).select(
        *ids, "raw_value", "normalized_value", "confidence_pct",
        F.array_join("issues", ",").alias("issues"),
    )


def _no_options(df):
    return df.withColumn("option_terms", F.lit(None).cast("array<struct<option:string,term:string,noisy:string>>"))


def q_n1_date(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = (
        F.when(k % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k % 6 == 1, F.date_format(day, "dd/MM/yy"))
        .when(k % 6 == 2, F.date_format(day, "M.d.yyyy"))
        .when(k % 6 == 3, _noise(F.date_format(day, "yyyy/MM/dd")))
        .when(k % 6 == 4, F.concat(F.date_format(day, "yyyy-MM"), F.lit("-31")))
        .otherwise(F.concat(F.lit("on "), F.date_format(day, "yyyy")))
    )
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", spelled.alias("raw_text"), F.lit("date").alias("type"), (k % 2 == 0).alias("required")
    )
    return _cell_result(_no_options(rows), "o_orderkey")


def q_n1_month_name(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", F.lit("date").alias("type"), F.lit(False).alias("required"),
        F.when(k % 2 == 0, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "d MMM yy")).alias("raw_text"),
    )
    return _cell_result(_no_options(rows), "o_orderkey")


def q_n1_number(spark, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    cents = F.round(price * 100).cast("bigint").cast("string")
    raw = (
        F.when(k % 5 == 0, _noise(cents))
        .when(k % 5 == 1, F.concat(F.lit("+0"), F.substring(cents, 1, 3), F.lit(","), F.substring(cents, 4, 3)))
        .when(k % 5 == 2, F.concat(F.lit("- "), F.substring(cents, 1, 4), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("0")))
        .when(k % 5 == 3, F.concat(cents, F.lit("%")))
        .otherwise("")
    )
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", raw.alias("raw_text"), F.lit("number").alias("type"), (k % 2 == 0).alias("required")
    )
    return _cell_result(_no_options(rows), "o_orderkey")


def q_n1_phone(spark, sf):
    k, d = F.col("c_custkey"), F.substring("c_name", 10, 9)
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("+44 (0) "), _noise(d)))
        .when(k % 4 == 1, F.concat(F.lit("00234-"), d))
        .when(k % 4 == 2, F.substring(d, 5, 5)).otherwise(F.concat(d, F.lit(" / "), d))
    )
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", raw.alias("raw_text"), F.lit("phone").alias("type"), (k % 3 == 0).alias("required")
    )
    return _cell_result(_no_options(rows), "c_custkey")


def q_n1_email(spark, sf):
    k, u = F.col("c_custkey"), F.concat(F.lit("User"), F.col("c_custkey").cast("string"))
    raw = (
        F.when(k % 5 == 0, F.concat(u, F.lit(" AT Mail dot Com")))
        .when(k % 5 == 1, F.concat(u, F.lit(" [at] mail [dot] c0m;")))
        .when(k % 5 == 2, F.concat(u, F.lit(" @ mail . 0rg")))
        .when(k % 5 == 3, F.concat(u, F.lit("@mail,c0"))).otherwise(F.concat(u, F.lit(".mail.com")))
    )
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", raw.alias("raw_text"), F.lit("email").alias("type"), (k % 2 == 0).alias("required")
    )
    return _cell_result(_no_options(rows), "c_custkey")


def q_n1_text_email(spark, sf):
    """Every white-space separated token of the documents that holds an at sign."""
    tokens = b.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"[ \n\t\r]+")).alias("place", "raw_text")
    ).filter(F.contains("raw_text", F.lit("@")))
    rows = tokens.withColumn("type", F.lit("email")).withColumn("required", F.lit(False))
    return _cell_result(_no_options(rows), "doc_id", "place")


OPTIONS = ("Small", "Medium", "Large", "Promo", "Standard", "Economy")


def _choices(spark, sf, kind):
    k, t = F.col("p_partkey"), F.col("p_type")
    raw = (
        F.when(k % 6 == 0, F.lower(t)).when(k % 6 == 1, F.translate(t, "OS", "05"))
        .when(k % 6 == 2, F.concat(t, F.lit("s"))).when(k % 6 == 3, F.concat(t, F.lit(" and Promo; "), t))
        .when(k % 6 == 4, F.concat(t, F.lit(", other"))).otherwise(F.lit("--"))
    )
    options = F.array(*[F.lit(o) for o in OPTIONS])
    return b.table(spark, sf, "part").select(
        "p_partkey", raw.alias("raw_text"), F.lit(kind).alias("type"), (k % 2 == 0).alias("required"),
        c.option_terms(options).alias("option_terms"),
    )


def q_n1_select(spark, sf):
    return _cell_result(_choices(spark, sf, "select"), "p_partkey")


def q_n1_multi_select(spark, sf):
    return _cell_result(_choices(spark, sf, "multi_select"), "p_partkey")


def q_n1_signature(spark, sf):
    k = F.col("c_custkey")
    raw = (
        F.when(k % 5 == 0, "Signed.").when(k % 5 == 1, "N").when(k % 5 == 2, F.col("c_name"))
        .when(k % 5 == 3, " ; ").otherwise("Y e s")
    )
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", raw.alias("raw_text"), F.lit("signature").alias("type"), (k % 2 == 0).alias("required")
    )
    return _cell_result(_no_options(rows), "c_custkey")


def q_n2(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def q_n3(spark, sf):
    t = text.term(F.col("text"))
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", t.alias("term"))
    return rows.withColumn("noisy", text.noisy_term(F.col("term")))


def q_n4(spark, sf):
    raw = F.concat_ws(" ", F.translate("p_name", "oisgzb", "015628"), F.col("p_brand"))
    rows = b.table(spark, sf, "part").select("p_partkey", text.term(raw).alias("term"))
    return rows.withColumn("noisy", text.noisy_term(F.col("term")))


def q_n5(spark, sf):
    cells = b.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 101).alias("structure"), (F.col("l_suppkey") % 101).alias("value"),
        (F.col("l_linenumber") % 3).alias("issues"),
    ).distinct()
    return cells.withColumn(
        "confidence_pct", blend_confidence(F.col("structure"), F.col("value"), F.col("issues"))
    )


def q_n9(spark, sf):
    fields = b.template_fields(spark, sf)
    terms = scoring.field_terms(scoring.configured_terms(F.col("key"), F.col("label"), F.col("aliases")))
    return fields.select("field_id", F.array_join(F.sort_array(terms), ",").alias("terms"))


def q_n10(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", text.field_key(F.col("text")).alias("key"), text.title_label(F.col("text")).alias("label")
    )


def q_n12(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.split_list(F.col("text")), "|").alias("parts")
    )


def q_n15(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.redact_text(F.col("text")).alias("redacted"))


def q_n16(spark, sf):
    line = F.concat_ws(" ", F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit(":")).otherwise(F.lit("-")), F.col("p_type"))
    rows = b.table(spark, sf, "part").select("p_partkey", line.alias("line"))
    return rows.select("p_partkey", text.inline_label(F.col("line")).alias("label"), text.inline_value(F.col("line")).alias("value"))


QUERIES = {
    "n1_date_cells": q_n1_date, "n1_month_name_dates": q_n1_month_name, "n1_number_cells": q_n1_number,
    "n1_phone_cells": q_n1_phone, "n1_email_cells": q_n1_email, "n1_document_emails": q_n1_text_email,
    "n1_select_cells": q_n1_select, "n1_multi_select_cells": q_n1_multi_select,
    "n1_signature_cells": q_n1_signature, "n2_clean_text": q_n2, "n3_terms": q_n3,
    "n4_noisy_terms": q_n4, "n5_blend_confidence": q_n5, "n9_field_terms": q_n9,
    "n10_keys_and_labels": q_n10, "n12_split_list": q_n12, "n15_redact_text": q_n15,
    "n16_inline_pair": q_n16,
}

_BLANK = r"' :;,.' || chr(10) || chr(13) || chr(9)"
CLEAN = r"""trim(regexp_replace(replace(translate({0}, '|¦‘’“”‐‑‒–—―', '  ''''""------'), ' ', ' '), '\s+', ' ', 'g'), ' :;,.')"""
TERM = r"regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', '', 'g')"
NOISY = r"""CASE WHEN length(regexp_replace({0}, '[^a-z]', '', 'g')) > 0
  AND length(regexp_replace({0}, '[a-z]', '', 'g')) <= length(regexp_replace({0}, '[^a-z]', '', 'g'))
  THEN translate({0}, '012568', 'oizsgb') ELSE {0} END"""


def _failing(required, base):
    return f"CASE WHEN {required} THEN least({base}, 50) ELSE {base} END"


def _select_sql(multi: bool) -> str:
    """Option matching row by row: parts against options, best confidence then option order."""
    score = """CASE WHEN part_term = '' THEN NULL
      WHEN part_term IN (opt_term, opt_noisy) OR part_noisy IN (opt_term, opt_noisy) THEN 92
      WHEN length(opt_term) >= 4 AND (contains(part_term, opt_term) OR contains(opt_term, part_term)
        OR contains(part_noisy, opt_term) OR contains(opt_term, part_noisy) OR contains(part_term, opt_noisy)
        OR contains(opt_noisy, part_term) OR contains(part_noisy, opt_noisy) OR contains(opt_noisy, part_noisy)) THEN 78
      WHEN least(levenshtein(part_term, opt_term), levenshtein(part_noisy, opt_term),
        levenshtein(part_term, opt_noisy), levenshtein(part_noisy, opt_noisy))
        <= greatest(1, greatest(length(part_term), length(opt_term)) // 5) THEN 72 END"""
    several = "c.n_parts >= 1 AND c.n_bad = 0" if multi else "c.n_parts >= 2 AND c.n_bad = 0 AND len(c.names) >= 2"
    cap = 90 if multi else 68
    unknown = "options_unknown" if multi else "option_unknown"
    listed = "array_to_string(c.names, ', ')"
    if multi:
        value = f"CASE WHEN {several} THEN {listed} ELSE raw_value END"
        conf = f"CASE WHEN {several} THEN least({cap}, c.low) ELSE {_failing('required', '46')} END"
        issue = f"CASE WHEN {several} THEN '' ELSE '{unknown}' END"
    else:
        value = f"CASE WHEN {several} THEN {listed} WHEN one.name IS NOT NULL THEN one.name ELSE raw_value END"
        conf = (f"CASE WHEN {several} THEN {_failing('required', f'least({cap}, c.low)')} "
                f"WHEN one.name IS NOT NULL THEN one.conf ELSE {_failing('required', '46')} END")
        issue = f"CASE WHEN {several} THEN 'option_multiple' WHEN one.name IS NOT NULL THEN '' ELSE '{unknown}' END"
    term = TERM.format("part")
    return f"""WITH raw AS (
      SELECT p_partkey, p_partkey % 2 = 0 AS required, {CLEAN.format('t')} AS raw_value FROM (
        SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN lower(p_type) WHEN 1 THEN translate(p_type, 'OS', '05')
          WHEN 2 THEN p_type || 's' WHEN 3 THEN p_type || ' and Promo; ' || p_type WHEN 4 THEN p_type || ', other'
          ELSE '--' END AS t FROM part)),
    parts AS (SELECT p_partkey, 0 AS pos, raw_value AS part FROM raw
      UNION ALL
      SELECT p_partkey, unnest(range(1, len(ps) + 1)), unnest(ps) FROM (
        SELECT p_partkey, list_filter(list_transform(
          regexp_split_to_array(lower(raw_value), '\\s*(?:,|;|\\band\\b)\\s*'), lambda x: trim(x, ' :;,.')), lambda x: x <> '') AS ps
        FROM raw)),
    terms AS (SELECT *, {NOISY.format('part_term')} AS part_noisy FROM (SELECT *, {term} AS part_term FROM parts)),
    opts AS (SELECT *, {NOISY.format('opt_term')} AS opt_noisy FROM (
      SELECT unnest({list(OPTIONS)}) AS name, lower(unnest({list(OPTIONS)})) AS opt_term,
        unnest(range(0, {len(OPTIONS)})) AS place)),
    best AS (SELECT * FROM (SELECT p_partkey, pos, name, place, {score} AS conf FROM terms, opts) WHERE conf IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY p_partkey, pos ORDER BY conf DESC, place) = 1),
    hit AS (SELECT p.p_partkey, p.pos, name, conf FROM parts p LEFT JOIN best USING (p_partkey, pos)),
    firsts AS (SELECT p_partkey, name, min(pos) AS pos, arg_min(conf, pos) AS conf FROM hit
      WHERE pos > 0 AND name IS NOT NULL GROUP BY ALL),
    c AS (SELECT h.p_partkey, n_parts, n_bad, names, low FROM
        (SELECT p_partkey, count(*) FILTER (pos > 0) AS n_parts, count(*) FILTER (pos > 0 AND name IS NULL) AS n_bad
         FROM hit GROUP BY ALL) h
      LEFT JOIN (SELECT p_partkey, list(name ORDER BY pos) AS names, min(conf) AS low FROM firsts GROUP BY ALL) USING (p_partkey))
    SELECT p_partkey, raw_value, {value} AS normalized_value, CAST({conf} AS INTEGER) AS confidence_pct, {issue} AS issues
    FROM raw JOIN c USING (p_partkey) LEFT JOIN (SELECT * FROM hit WHERE pos = 0) one USING (p_partkey)"""


def _email_sql(source: str, ids: str, required: str) -> str:
    steps = [(r"\s+(?:at|\(at\)|\[at\])\s+", "@"), (r"\s+(?:dot|\(dot\)|\[dot\])\s+", "."), (r"\s*@\s*", "@"),
             (r"\s*\.\s*", "."), (",", "."), (r"c0m\b", "com"), (r"0rg\b", "org"), (r"c0\b", "co"), (r"\s+", "")]
    value = "lower(raw_value)"
    for pattern, to in steps:
        value = f"regexp_replace({value}, '{pattern}', '{to}', 'g')"
    ok = r"regexp_matches(v, '^[^\s@]+@[^\s@]+\.[^\s@]+$')"
    missing = f"CASE WHEN {required} THEN 34 ELSE 68 END"
    return f"""SELECT {ids}, raw_value, v AS normalized_value,
      CAST(CASE WHEN raw_value = '' THEN {missing} WHEN {ok} THEN 94 ELSE {_failing(required, '42')} END AS INTEGER) AS confidence_pct,
      CASE WHEN raw_value = '' THEN CASE WHEN {required} THEN 'missing_required' ELSE '' END
        WHEN {ok} THEN '' ELSE 'bad_email' END AS issues
    FROM (SELECT *, {value} AS v FROM (SELECT *, {CLEAN.format('t')} AS raw_value FROM ({source})))"""


_REPAIR = "translate({0}, 'OoIl|SsBb', '001115588')"
_DATE_FIX = "translate({0}, 'OoIl|Ss', '0011155')"
ORACLE = {
    "n1_date_cells": rf"""WITH r AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS required, CASE o_orderkey % 6
          WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%y')
          WHEN 2 THEN strftime(o_orderdate, '%-m.%-d.%Y') WHEN 3 THEN translate(strftime(o_orderdate, '%Y/%m/%d'), '015', 'OlS')
          WHEN 4 THEN strftime(o_orderdate, '%Y-%m') || '-31' ELSE 'on ' || strftime(o_orderdate, '%Y') END AS raw_value
        FROM orders),
      f AS (SELECT *, {_DATE_FIX.format('raw_value')} AS v FROM r),
      g AS (SELECT *, string_split_regex(v, '[-/.]') AS p, regexp_matches(v, '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}$') AS iso,
          regexp_matches(v, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}$') AS loc FROM f),
      h AS (SELECT *, CASE WHEN iso THEN TRY_CAST(p[1] AS INTEGER) WHEN loc THEN TRY_CAST(p[3] AS INTEGER) END AS y0,
          CASE WHEN iso THEN TRY_CAST(p[2] AS INTEGER)
            WHEN loc AND TRY_CAST(p[1] AS INTEGER) <= 12 AND TRY_CAST(p[2] AS INTEGER) > 12 THEN TRY_CAST(p[1] AS INTEGER)
            WHEN loc THEN TRY_CAST(p[2] AS INTEGER) END AS m,
          CASE WHEN iso THEN TRY_CAST(p[3] AS INTEGER)
            WHEN loc AND TRY_CAST(p[1] AS INTEGER) <= 12 AND TRY_CAST(p[2] AS INTEGER) > 12 THEN TRY_CAST(p[2] AS INTEGER)
            WHEN loc THEN TRY_CAST(p[1] AS INTEGER) END AS d FROM g),
      i AS (SELECT *, CASE WHEN y0 >= 100 THEN y0 WHEN y0 >= 70 THEN y0 + 1900 ELSE y0 + 2000 END AS y FROM h),
      j AS (SELECT *, printf('%04d-%02d-%02d', y, m, d) AS t FROM i)
      SELECT o_orderkey, raw_value, CASE WHEN (iso OR loc) AND TRY_CAST(t AS DATE) IS NOT NULL THEN t ELSE raw_value END AS normalized_value,
        CAST(CASE WHEN (iso OR loc) AND TRY_CAST(t AS DATE) IS NOT NULL THEN 90 ELSE 40 END AS INTEGER) AS confidence_pct,
        CASE WHEN NOT (iso OR loc) THEN 'bad_date' WHEN TRY_CAST(t AS DATE) IS NULL THEN 'invalid_date' ELSE '' END AS issues
      FROM j""",
    "n1_month_name_dates": """SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN strftime(o_orderdate, '%-d %B %Y')
          ELSE strftime(o_orderdate, '%-d %b %y') END AS raw_value,
        strftime(o_orderdate, '%Y-%m-%d') AS normalized_value, CAST(90 AS INTEGER) AS confidence_pct, '' AS issues FROM orders""",
    "n1_number_cells": rf"""WITH r AS (SELECT *, o_orderkey % 2 = 0 AS required, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS c FROM orders),
      s AS (SELECT o_orderkey, required, CASE o_orderkey % 5 WHEN 0 THEN translate(c, '015', 'OlS')
          WHEN 1 THEN '+0' || substr(c, 1, 3) || ',' || substr(c, 4, 3)
          WHEN 2 THEN '- ' || substr(c, 1, 4) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '0'
          WHEN 3 THEN c || '%' ELSE '' END AS raw_value FROM r),
      f AS (SELECT *, regexp_replace({_REPAIR.format('raw_value')}, '[,\s]', '', 'g') AS v FROM s),
      g AS (SELECT *, regexp_matches(v, '^[-+]?\d+(\.\d+)?$') AS ok, TRY_CAST(v AS DECIMAL(18,4)) AS n FROM f)
      SELECT o_orderkey, raw_value, CASE WHEN ok THEN regexp_replace(regexp_replace(CAST(n AS VARCHAR), '0+$', ''), '\.$', '') ELSE raw_value END AS normalized_value,
        CAST(CASE WHEN raw_value = '' THEN CASE WHEN required THEN 34 ELSE 68 END WHEN ok THEN 92 ELSE 40 END AS INTEGER) AS confidence_pct,
        CASE WHEN raw_value = '' THEN CASE WHEN required THEN 'missing_required' ELSE '' END WHEN ok THEN '' ELSE 'bad_number' END AS issues FROM g""",
    "n1_phone_cells": rf"""WITH r AS (SELECT c_custkey, c_custkey % 3 = 0 AS required, substr(c_name, 10, 9) AS d FROM customer),
      s AS (SELECT c_custkey, required, CASE c_custkey % 4 WHEN 0 THEN '+44 (0) ' || translate(d, '015', 'OlS')
          WHEN 1 THEN '00234-' || d WHEN 2 THEN substr(d, 5, 5) ELSE d || ' / ' || d END AS raw_value FROM r),
      f AS (SELECT *, regexp_replace({_REPAIR.format('raw_value')}, '[^0-9+]', '', 'g') AS k FROM s),
      g AS (SELECT *, CASE WHEN starts_with(k, '00') THEN '+' || substr(k, 3) ELSE k END AS k2 FROM f),
      h AS (SELECT *, regexp_replace(k2, '[^0-9]', '', 'g') AS digits FROM g)
      SELECT c_custkey, raw_value, CASE WHEN contains(k2, '+') THEN '+' || digits ELSE k2 END AS normalized_value,
        CAST(CASE WHEN length(digits) BETWEEN 7 AND 15 THEN 90 ELSE 44 END AS INTEGER) AS confidence_pct,
        CASE WHEN length(digits) BETWEEN 7 AND 15 THEN '' ELSE 'bad_phone' END AS issues FROM h""",
    "n1_email_cells": _email_sql(
        """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN u || ' AT Mail dot Com' WHEN 1 THEN u || ' [at] mail [dot] c0m;'
          WHEN 2 THEN u || ' @ mail . 0rg' WHEN 3 THEN u || '@mail,c0' ELSE u || '.mail.com' END AS t
        FROM (SELECT c_custkey, 'User' || c_custkey AS u FROM customer)""", "c_custkey", "c_custkey % 2 = 0"),
    "n1_document_emails": _email_sql(
        r"""SELECT * FROM (SELECT doc_id, CAST(unnest(range(0, len(w))) AS INTEGER) AS place, unnest(w) AS t FROM
          (SELECT doc_id, string_split_regex(text, '[ \n\t\r]+') AS w FROM documents)) WHERE contains(t, '@')""",
        "doc_id, place", "false"),
    "n1_select_cells": _select_sql(False),
    "n1_multi_select_cells": _select_sql(True),
    "n1_signature_cells": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Signed' WHEN 1 THEN 'N' WHEN 2 THEN c_name
          WHEN 3 THEN '' ELSE 'Y e s' END AS raw_value,
        CASE WHEN c_custkey % 5 IN (1, 3) THEN 'false' ELSE 'true' END AS normalized_value,
        CAST(CASE c_custkey % 5 WHEN 0 THEN 88 WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 50 ELSE 84 END WHEN 2 THEN 72
          WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 34 ELSE 68 END ELSE 88 END AS INTEGER) AS confidence_pct,
        CASE WHEN c_custkey % 5 = 1 AND c_custkey % 2 = 0 THEN 'signature_missing' WHEN c_custkey % 5 = 2 THEN 'signature_unclear'
          WHEN c_custkey % 5 = 3 AND c_custkey % 2 = 0 THEN 'missing_required' ELSE '' END AS issues FROM customer""",
    "n2_clean_text": f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents",
    "n3_terms": f"""SELECT conv_id, turn, term, {NOISY.format('term')} AS noisy FROM (
        SELECT conv_id, turn, {TERM.format(CLEAN.format('text'))} AS term FROM conversations)""",
    "n4_noisy_terms": f"""SELECT p_partkey, term, {NOISY.format('term')} AS noisy FROM (
        SELECT p_partkey, {TERM.format("(translate(p_name, 'oisgzb', '015628') || ' ' || p_brand)")} AS term FROM part)""",
    "n5_blend_confidence": """SELECT DISTINCT l_partkey % 101 AS structure, l_suppkey % 101 AS value, l_linenumber % 3 AS issues,
        CAST(least(99, greatest(5, CASE WHEN l_linenumber % 3 > 0
          THEN least(68, ((l_suppkey % 101) * 72 + (l_partkey % 101) * 28 + 50) // 100)
          ELSE ((l_suppkey % 101) * 72 + (l_partkey % 101) * 28 + 50) // 100 END)) AS INTEGER) AS confidence_pct FROM lineitem""",
    "n9_field_terms": b.sql(
        ", g(triggers, names) AS (VALUES " + ", ".join(
            f"({list(t)}, {[n.replace(' ', '') for n in names]})" for t, names in scoring.COMMON_TERMS
        ) + f"""), own AS (SELECT field_id, unnest([{TERM.format('key')}, {TERM.format('label')}]) AS term FROM v_template_fields),
        more AS (SELECT DISTINCT field_id, unnest(names) AS term FROM (
          SELECT DISTINCT field_id, names FROM own, g WHERE len(list_filter(triggers, lambda t: contains(term, t))) > 0))
        SELECT field_id, string_agg(term, ',' ORDER BY term) AS terms FROM (
          SELECT field_id, term FROM own WHERE length(term) >= 2 UNION SELECT field_id, term FROM more) GROUP BY field_id""",
        "v_template_fields"),
    "n12_split_list": r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS parts FROM documents""",
    "n15_redact_text": r"""SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
        '(?i)(authorization:\s*bearer\s+)[^\s,;]+', '\1[redacted]', 'g'),
        '(?i)((?:api[_-]?key|subscription[_-]?key|token)["'']?\s*[:=]\s*["'']?)[^"'',\s}]+', '\1[redacted]', 'g') AS redacted FROM documents""",
    "n16_inline_pair": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS label,
        CASE WHEN p_partkey % 2 = 0 THEN p_type END AS value FROM part""",
}
ORACLE["n10_keys_and_labels"] = rf"""WITH l AS (SELECT doc_id, text AS line FROM documents),
  c AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(replace(lower(strip_accents(line)), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field') AS key,
    trim(regexp_replace({CLEAN.format('line')}, '[_\-\s]+', ' ', 'g')) AS spaced FROM l)
  SELECT doc_id, key, array_to_string(list_transform(regexp_extract_all(spaced, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
    lambda p: CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE p END), '') AS label FROM c"""
