"""Review state, validation, lookups and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from tallysheet.functions.cells import canonical_options
from tallysheet.functions.json_guards import scalar_entries, string_items
from tallysheet.functions.numeric import confidence_label
from tallysheet.functions.text import is_populated, signed_flag, valid_email, valid_phone
from tallysheet.operators import review as v
from tallysheet.schemas import STATUS_LABELS


def _decisions(spark, sf):
    flag = F.col("l_returnflag")
    return b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.when(flag == "R", "rejected").when(flag == "A", "approved").otherwise("needs_review").alias("status"),
        F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_shipdate").alias("decided_at"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")],
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("decision_id"),
    )


def q_t1(spark, sf):
    rows = b.records(spark, sf).select(
        "record_id", "confidence", F.when(F.col("status") == "approved", F.col("status")).alias("given")
    )
    return rows.select("record_id", v.initial_status(F.col("given"), F.col("confidence")).alias("status"))


def q_t2(spark, sf):
    done = v.apply_decisions(b.records(spark, sf), _decisions(spark, sf))
    return done.select("record_id", "status", "reviewed_by", b.stamp_text(F.col("reviewed_at")).alias("reviewed_at"))


def _edits(spark, sf):
    k = F.col("o_orderkey")
    last = F.create_map(F.lit("f1"), (k % 50).cast("string"), F.lit("f2"), F.col("o_orderpriority"),
                        F.lit("zz"), F.lit("not a field"))
    earlier = F.create_map(F.lit("f1"), F.lit("earlier"), F.lit("f3"), F.col("o_orderpriority"))
    made = F.array(F.struct(F.lit(2).alias("at"), last.alias("data")), F.struct(F.lit(1).alias("at"), earlier.alias("data")))
    return b.table(spark, sf, "orders").filter(k % 11 == 0).select(
        k.cast("string").alias("record_id"), F.explode(made).alias("e")
    ).select("record_id", "e.*")


def _edited(spark, sf):
    cells = b.event_cells(spark, sf).select(
        "record_id", "field_id", F.col("normalized_value").alias("raw_value"), "normalized_value",
        "confidence", "issues",
    )
    return v.apply_cell_edits(
        b.records_with_data(spark, sf), cells, _edits(spark, sf), b.event_fields(spark, sf), [F.col("at")]
    )


def _pairs(data):
    entries = F.sort_array(F.transform(F.map_entries(data), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.array_join(entries, ";")


def q_t3_cells(spark, sf):
    return _edited(spark, sf)[1].select(
        "record_id", "field_id", "raw_value", "normalized_value", "confidence",
        F.size("issues").cast("bigint").alias("issue_count"),
    )


def q_t3_records(spark, sf):
    return _edited(spark, sf)[0].select("record_id", "confidence", _pairs(F.col("data")).alias("data"))


def q_t4(spark, sf):
    return v.reopen_on_edit(b.records(spark, sf), _edits(spark, sf)).select("record_id", "status")


def _submitted(spark, sf):
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(
        k.cast("string").alias("record_id"), (F.col("o_custkey") % 25).cast("string").alias("event_id"),
        (k % 250 + 1).alias("position"), F.when(k % 3 == 0, k % 7 + 1).alias("row_number"),
        F.create_map(F.lit("f1"), F.col("o_orderpriority"), F.lit("f9"), F.lit("x")).alias("data"),
        F.when(k % 17 != 0, (k % 101) / F.lit(100.0)).alias("confidence"),
        F.when(k % 4 == 0, F.lit("approved")).alias("status"),
    )


def q_t5_records(spark, sf):
    return v.create_records(_submitted(spark, sf), b.event_fields(spark, sf))[0].withColumn(
        "data", _pairs(F.col("data"))
    )


def q_t5_cells(spark, sf):
    return v.create_records(_submitted(spark, sf), b.event_fields(spark, sf))[1]


def q_t8(spark, sf):
    k = F.col("p_partkey")
    requests = b.table(spark, sf, "part").select(
        k.alias("document_id"), F.col("p_size").alias("total_pages"),
        F.when(k % 3 != 0, (k % 60 + 1).cast("int")).alias("page_start"),
        F.when(k % 4 != 0, (k % 20 + 1).cast("int")).alias("page_count"),
    )
    return v.page_plan(requests)


def q_t12(spark, sf):
    options = F.array(*[F.lit(o) for o in ("SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD")])
    chosen = F.array(F.lit("PROMO"), F.col("p_type"), F.lit("MEDIUM"))
    return b.table(spark, sf, "part").select(
        "p_partkey", canonical_options(chosen, options).alias("value")
    )


def _searchable(spark, sf):
    docs = b.documents(spark, sf).select("document_id", "file_name")
    return b.records_with_data(spark, sf).join(docs, "document_id", "left")


def q_p3(spark, sf):
    return v.search_records(_searchable(spark, sf), " ER#00000001 ", "approved").select("record_id", "status")


def q_p3_label(spark, sf):
    return v.search_records(_searchable(spark, sf), "needs R").select("record_id", "status")


def q_p4(spark, sf):
    keys = F.array(*[F.lit(f"f{n}") for n in (1, 2, 4, 8)])
    return b.records_with_data(spark, sf).select(
        "record_id",
        _pairs(v.project_to_template(F.coalesce("data", F.create_map().cast("map<string,string>")), keys)).alias("data"),
    )


def q_p5(spark, sf):
    t = F.col("event_type")
    number = F.regexp_extract("props", "([0-9]+)", 1)
    obj = F.concat(F.lit('{"k":'), number, F.lit(',"n":{"z":1},"l":[2],"t":"'), t, F.lit('","b":true}'))
    arr = F.concat(F.lit('["a",1,null,["q"],"'), t, F.lit('"]'))
    return b.table(spark, sf, "events").select(
        "event_id", _pairs(scalar_entries(obj)).alias("scalars"),
        F.array_join(string_items(arr), ",").alias("strings"),
        F.size(string_items(obj)).cast("bigint").alias("not_an_array"),
    )


def q_p6(spark, sf):
    kind = F.when(F.col("field_id") == "5", "boolean").otherwise("string")
    return b.cells(spark, sf).select(
        "record_id", "field_id", is_populated(F.col("normalized_value"), kind).alias("populated")
    )


def q_p8(spark, sf):
    docs, people = b.documents(spark, sf), b.users(spark, sf)
    view = v.record_view(
        b.records(spark, sf), docs, people, b.event_cells(spark, sf), b.event_fields(spark, sf)
    )
    joined = F.array_join(
        F.transform("cells", lambda c: F.concat(c["key"], F.lit("="), c["normalized_value"])), ";"
    )
    return view.select("record_id", "file_name", "reviewer_name", joined.alias("cells"))


def q_p10(spark, sf):
    return v.attention_cells(b.cells(spark, sf)).select("record_id", "field_id", "confidence")


def q_p11_records(spark, sf):
    k = F.col("o_orderkey")
    rows = b.table(spark, sf, "orders").select(
        k.cast("string").alias("record_id"), F.when(k % 9 != 0, k % 50).alias("row_number"),
        (F.round("o_totalprice").cast("bigint") / F.lit(400000.0)).alias("confidence"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "paused").alias("status"),
        (F.col("o_custkey") % 300).alias("batch_size"),
    )
    return v.validate_records(rows).select("record_id", F.array_join("reasons", ",").alias("reasons"))


def q_p11_fields(spark, sf):
    k = F.col("p_partkey")
    many = F.sequence(F.lit(1), (k % 60 + 1))
    rows = b.table(spark, sf, "part").select(
        k.cast("string").alias("field_id"), F.repeat("p_name", F.col("p_size")).alias("label"),
        F.when(k % 9 == 0, "").otherwise(F.col("p_name")).alias("key"),
        F.when(k % 8 == 0, "color").otherwise("text").alias("type"),
        (k % 10 - 1).alias("sort_order"), many.cast("array<string>").alias("aliases"),
        many.cast("array<string>").alias("options"), (k % 90).alias("field_count"),
    )
    return v.validate_fields(rows).select("field_id", F.array_join("reasons", ",").alias("reasons"))


def q_p11_events(spark, sf):
    k = F.col("c_custkey")
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 5 != 0, F.repeat("c_name", (k % 9).cast("int"))).alias("title"),
        F.repeat("c_mktsegment", (k % 140).cast("int")).alias("description"),
    )
    return v.validate_events(rows).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


def q_p12(spark, sf):
    k = F.col("p_partkey")
    rows = b.table(spark, sf, "part").select(
        k.cast("string").alias("field_id"), (k % 8).alias("position"),
        F.when(k % 2 == 0, k % 3 == 0).alias("required"),
        F.when(k % 5 != 0, (k % 11).cast("int")).alias("sort_order"),
        F.when(k % 7 != 0, F.array(F.col("p_brand"))).alias("aliases"),
        F.when(k % 4 == 0, "select").when(k % 4 == 1, "multi_select").otherwise("text").alias("type"),
        F.when(k % 6 != 0, F.array("p_type", "p_brand")).alias("options"),
    )
    return v.field_defaults(rows).select(
        "field_id", "required", "sort_order", F.array_join("aliases", ",").alias("aliases"),
        F.array_join("options", ",").alias("options"),
    )


def q_p13(spark, sf):
    rows = b.table(spark, sf, "part").select(
        F.call_function("div", F.col("p_partkey"), F.lit(8)).alias("template_id"), F.col("p_type").alias("key")
    )
    return v.duplicate_field_keys(rows)


def _contacts(spark, sf):
    k, digits = F.col("c_custkey"), F.substring("c_name", 10, 9)
    mail = F.when(k % 4 == 0, F.concat(digits, F.lit("@mail.example.com"))).when(
        k % 4 == 1, F.concat(digits, F.lit(" x@mail.com"))).when(
        k % 4 == 2, F.concat(digits, F.lit("@mail.c"))).otherwise(F.concat(digits, F.lit("@a@b.org")))
    phone = F.when(k % 3 == 0, F.concat(F.lit("+44 (0)"), digits)).when(
        k % 3 == 1, F.concat(digits, F.lit("x"))).otherwise(F.substring("c_name", 14, 5))
    return b.table(spark, sf, "customer").select("c_custkey", mail.alias("email"), phone.alias("phone"))


def q_p14(spark, sf):
    return _contacts(spark, sf).select(
        "c_custkey", valid_email(F.col("email")).alias("email_ok"), valid_phone(F.col("phone")).alias("phone_ok")
    )


def q_j1(spark, sf):
    return v.record_details(b.records(spark, sf), b.documents(spark, sf), b.users(spark, sf)).select(
        "record_id", "document_id", "file_name", "reviewed_by", "reviewer_name"
    )


def q_j2(spark, sf):
    return v.cells_with_fields(b.event_cells(spark, sf).drop("key"), b.event_fields(spark, sf)).select(
        "record_id", "field_id", "key", "type", "sort_order"
    )


def q_j12(spark, sf):
    return b.records(spark, sf).select(
        "record_id", F.element_at(v.label_map(STATUS_LABELS), F.col("status")).alias("label"),
        confidence_label(F.col("confidence")).alias("confidence_label"),
        signed_flag(F.col("status")).alias("signed"),
    )


def q_w1(spark, sf):
    t = F.col("p_partkey")
    templates = b.table(spark, sf, "part").select(
        t.cast("string").alias("template_id"), F.col("p_brand").alias("event_id"),
        (t % 7 == 0).alias("is_default"), F.col("p_size").alias("created_at"),
    )
    return v.effective_templates(templates)


def q_w13(spark, sf):
    order = F.array(*[F.lit(p) for p in v.PROVIDER_ORDER])
    ok = (F.col("role") == "assistant") & (F.col("conv_id") % 3 != 0)
    attempts = b.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.call_function("div", F.col("turn"), F.lit(7)).cast("string")).alias("document_id"),
        F.get(order, ((F.col("turn") * 3 + F.col("conv_id")) % 7).cast("int")).alias("provider"),
        ok.alias("ok"), F.col("text").alias("error"),
    )
    return v.first_success(attempts, v.PROVIDER_ORDER).select(
        "document_id", "provider", F.array_join(F.transform("failures", lambda f: f["provider"]), ",").alias("failed"),
        F.array_join(F.transform("failures", lambda f: f["message"]), "|").alias("messages"),
    )


def q_o1(spark, sf):
    return b.records(spark, sf).orderBy(*v.listing_order()).select("record_id", "row_number")


def q_o2(spark, sf):
    return b.records(spark, sf).orderBy("event_id", *v.export_order()).select("event_id", "record_id", "row_number")


QUERIES = {
    "t1_initial_status": q_t1, "t2_apply_decisions": q_t2, "t3_edited_cells": q_t3_cells,
    "t3_edited_records": q_t3_records, "t4_reopen_on_edit": q_t4, "t5_created_records": q_t5_records,
    "t5_created_cells": q_t5_cells, "t8_page_plan": q_t8, "t12_canonical_options": q_t12,
    "p3_search_records": q_p3, "p3_search_status_label": q_p3_label, "p4_project_to_template": q_p4,
    "p5_json_guards": q_p5, "p6_is_populated": q_p6, "p8_record_view": q_p8,
    "p10_attention_cells": q_p10, "p11_validate_records": q_p11_records,
    "p11_validate_fields": q_p11_fields, "p11_validate_events": q_p11_events,
    "p12_field_defaults": q_p12, "p13_duplicate_keys": q_p13, "p14_contact_checks": q_p14,
    "j1_record_details": q_j1, "j2_cells_with_fields": q_j2, "j12_status_labels": q_j12,
    "w1_effective_template": q_w1, "w13_first_success": q_w13, "o1_listing_order": q_o1,
    "o2_export_order": q_o2,
}

DECISIONS = """, decisions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS record_id,
    CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'needs_review' END AS status,
    CAST(l_suppkey AS VARCHAR) AS user_id, l_shipdate AS decided_at
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC,
    l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) DESC) = 1)
"""
DATA = ", data AS (SELECT record_id, string_agg('f' || field_id || '=' || normalized_value, ';' ORDER BY field_id) AS data FROM v_cells GROUP BY ALL)\n"
_EDITED = "CAST(record_id AS BIGINT) % 11 = 0"
ORACLE = {
    "t1_initial_status": b.sql(
        """SELECT record_id, CASE WHEN status = 'approved' THEN status
          WHEN coalesce(confidence, 1) < 0.75 THEN 'needs_review' ELSE 'draft' END AS status FROM v_records""",
        "v_records"),
    "t2_apply_decisions": b.sql(
        DECISIONS + """SELECT record_id, coalesce(d.status, r.status) AS status,
          CASE WHEN d.status IN ('approved','rejected') THEN user_id WHEN d.status IS NULL THEN reviewed_by END AS reviewed_by,
          strftime(CASE WHEN d.status IN ('approved','rejected') THEN decided_at WHEN d.status IS NULL THEN reviewed_at END,
            '%Y-%m-%d %H:%M:%S') AS reviewed_at
        FROM v_records r LEFT JOIN decisions d USING (record_id)""", "v_records"),
    "t3_edited_cells": b.sql(
        f"""SELECT record_id, event_id || '_' || field_id AS field_id, normalized_value AS raw_value, normalized_value,
          v_cells.confidence, CAST(issue_count AS BIGINT) AS issue_count
        FROM v_cells JOIN v_records USING (record_id) WHERE NOT ({_EDITED})
        UNION ALL
        SELECT record_id, field_id, value, value, 1.0, 0 FROM (
          SELECT record_id, field_id, CASE key WHEN 'f1' THEN CAST(CAST(record_id AS BIGINT) % 50 AS VARCHAR)
            WHEN 'f2' THEN o_orderpriority ELSE '' END AS value
          FROM v_records JOIN v_event_fields USING (event_id)
          JOIN orders ON CAST(o_orderkey AS VARCHAR) = record_id WHERE {_EDITED})""",
        "v_cells", "v_records", "v_event_fields"),
    "t3_edited_records": b.sql(
        DATA + f"""SELECT record_id, CASE WHEN {_EDITED} THEN 1.0 ELSE confidence END AS confidence,
          CASE WHEN {_EDITED} THEN 'f1=' || (CAST(record_id AS BIGINT) % 50) || ';f2=' || o_orderpriority
            || ';f3=;f4=;f5=;f6=;f7=' ELSE data END AS data
        FROM v_records LEFT JOIN data USING (record_id) JOIN orders ON CAST(o_orderkey AS VARCHAR) = record_id""",
        "v_records", "v_cells"),
    "t4_reopen_on_edit": b.sql(
        f"""SELECT record_id, CASE WHEN {_EDITED} AND status IN ('approved','rejected') THEN 'needs_review'
          ELSE status END AS status FROM v_records""", "v_records"),
    "t5_created_records": """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_custkey % 25 AS VARCHAR) AS event_id,
          CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 + 1 ELSE o_orderkey % 250 + 1 END AS INTEGER) AS row_number,
          CASE WHEN o_orderkey % 4 = 0 THEN 'approved'
            WHEN o_orderkey % 17 <> 0 AND (o_orderkey % 101) / 100.0::DOUBLE < 0.75 THEN 'needs_review' ELSE 'draft' END AS status,
          CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 101) / 100.0::DOUBLE ELSE 1.0 END AS confidence,
          'f1=' || o_orderpriority || ';f2=;f3=;f4=;f5=;f6=;f7=' AS data FROM orders""",
    "t5_created_cells": """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, (o_custkey % 25) || '_' || n AS field_id,
          CASE WHEN n = 1 THEN o_orderpriority ELSE '' END AS normalized_value,
          CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 101) / 100.0::DOUBLE ELSE 1.0 END AS confidence
        FROM orders, (SELECT unnest(range(1, 8)) AS n)""",
    "t8_page_plan": """SELECT document_id, total_pages, page_start, page_count,
          CAST(unnest(range(page_start, page_start + page_count)) AS INTEGER) AS page FROM (
          SELECT document_id, total_pages, page_start,
            least(wanted, greatest(1, total_pages - page_start + 1)) AS page_count FROM (
            SELECT p_partkey AS document_id, p_size AS total_pages,
              CAST(least(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 60 + 1 ELSE 1 END, p_size) AS INTEGER) AS page_start,
              CAST(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 20 + 1 ELSE 1 END AS INTEGER) AS wanted FROM part))""",
    "t12_canonical_options": """SELECT p_partkey, array_to_string(list_filter(
          ['SMALL','MEDIUM','LARGE','PROMO','STANDARD'], lambda o: o IN ('PROMO','MEDIUM') OR o = p_type), ', ') AS value
        FROM part""",
    "p3_search_records": b.sql(
        """SELECT record_id, status FROM v_records r LEFT JOIN v_documents d ON d.document_id = r.document_id
        WHERE status = 'approved' AND contains(lower(file_name), 'er#00000001')""", "v_records", "v_documents"),
    "p3_search_status_label": b.sql(
        "SELECT record_id, status FROM v_records WHERE status = 'needs_review'", "v_records"),
    "p4_project_to_template": b.sql(
        """SELECT record_id, 'f1=' || coalesce(max(normalized_value) FILTER (field_id = '1'), '')
          || ';f2=' || coalesce(max(normalized_value) FILTER (field_id = '2'), '')
          || ';f4=' || coalesce(max(normalized_value) FILTER (field_id = '4'), '') || ';f8=' AS data
        FROM v_records LEFT JOIN v_cells USING (record_id) GROUP BY record_id""", "v_records", "v_cells"),
    "p5_json_guards": """SELECT event_id, 'b=true;k=' || json_extract_string(props, '$.k') || ';t=' || event_type AS scalars,
          'a,' || event_type AS strings, CAST(0 AS BIGINT) AS not_an_array FROM events""",
    "p6_is_populated": b.sql(
        """SELECT record_id, field_id, normalized_value <> '' AND NOT (field_id = '5' AND normalized_value = 'false')
          AS populated FROM v_cells""", "v_cells"),
    "p8_record_view": b.sql(
        DATA + """SELECT r.record_id, file_name, name AS reviewer_name, data AS cells
        FROM v_records r LEFT JOIN v_documents d ON d.document_id = r.document_id
        LEFT JOIN v_users u ON u.user_id = r.reviewed_by LEFT JOIN data USING (record_id)""",
        "v_records", "v_documents", "v_users", "v_cells"),
    "p10_attention_cells": b.sql(
        "SELECT record_id, field_id, confidence FROM v_cells WHERE confidence < 0.75 OR issue_count > 0", "v_cells"),
    "p11_validate_records": """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, array_to_string(list_filter([
          CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 50 < 1 THEN 'row_number' END,
          CASE WHEN CAST(round(o_totalprice) AS BIGINT) / 400000.0::DOUBLE > 1 THEN 'confidence' END,
          CASE WHEN o_orderstatus = 'P' THEN 'status' END,
          CASE WHEN o_custkey % 300 > 250 THEN 'batch_size' END], lambda r: r IS NOT NULL), ',') AS reasons FROM orders""",
    "p11_validate_fields": """SELECT CAST(p_partkey AS VARCHAR) AS field_id, array_to_string(list_filter([
          CASE WHEN length(p_name) * p_size > 80 THEN 'label' END, CASE WHEN p_partkey % 9 = 0 THEN 'key' END,
          CASE WHEN p_partkey % 8 = 0 THEN 'type' END, CASE WHEN p_partkey % 10 = 0 THEN 'sort_order' END,
          CASE WHEN p_partkey % 60 + 1 > 20 THEN 'aliases' END, CASE WHEN p_partkey % 60 + 1 > 50 THEN 'options' END,
          CASE WHEN p_partkey % 90 > 80 THEN 'field_count' END], lambda r: r IS NOT NULL), ',') AS reasons FROM part""",
    "p11_validate_events": """SELECT c_custkey, array_to_string(list_filter([
          CASE WHEN c_custkey % 5 = 0 OR NOT (length(c_name) * (c_custkey % 9) BETWEEN 1 AND 120) THEN 'title' END,
          CASE WHEN length(c_mktsegment) * (c_custkey % 140) > 1000 THEN 'description' END],
          lambda r: r IS NOT NULL), ',') AS reasons FROM customer""",
    "p12_field_defaults": """SELECT CAST(p_partkey AS VARCHAR) AS field_id, p_partkey % 2 = 0 AND p_partkey % 3 = 0 AS required,
          CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 11 ELSE p_partkey % 8 + 1 END AS INTEGER) AS sort_order,
          CASE WHEN p_partkey % 7 <> 0 THEN p_brand ELSE '' END AS aliases,
          CASE WHEN p_partkey % 4 < 2 AND p_partkey % 6 <> 0 THEN p_type || ',' || p_brand ELSE '' END AS options FROM part""",
    "p13_duplicate_keys": """SELECT p_partkey // 8 AS template_id, p_type AS key, count(*) AS uses FROM part
        GROUP BY ALL HAVING count(*) > 1""",
    "p14_contact_checks": r"""SELECT c_custkey, regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]{2,}$') AS email_ok,
          regexp_matches(phone, '^\+?[0-9()\-\s.]{7,32}$') AS phone_ok FROM (
          SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN d || '@mail.example.com' WHEN 1 THEN d || ' x@mail.com'
              WHEN 2 THEN d || '@mail.c' ELSE d || '@a@b.org' END AS email,
            CASE c_custkey % 3 WHEN 0 THEN '+44 (0)' || d WHEN 1 THEN d || 'x' ELSE substr(c_name, 14, 5) END AS phone
          FROM (SELECT *, substr(c_name, 10, 9) AS d FROM customer))""",
    "j1_record_details": b.sql(
        """SELECT r.record_id, r.document_id, file_name, reviewed_by, name AS reviewer_name
        FROM v_records r LEFT JOIN v_documents d ON d.document_id = r.document_id
        LEFT JOIN v_users u ON u.user_id = r.reviewed_by""", "v_records", "v_documents", "v_users"),
    "j2_cells_with_fields": b.sql(
        """SELECT record_id, f.field_id, f.key, f.type, CAST(f.sort_order AS INTEGER) AS sort_order FROM v_cells c
        JOIN v_records r USING (record_id) JOIN v_event_fields f ON f.field_id = r.event_id || '_' || c.field_id""",
        "v_cells", "v_records", "v_event_fields"),
    "j12_status_labels": b.sql(
        """SELECT record_id, CASE status WHEN 'draft' THEN 'Draft' WHEN 'needs_review' THEN 'Needs review'
          WHEN 'approved' THEN 'Approved' ELSE 'Rejected' END AS label,
          coalesce(CAST(round(confidence * 100) AS BIGINT) || '%', 'n/a') AS confidence_label, false AS signed FROM v_records""",
        "v_records"),
    "w1_effective_template": """SELECT p_brand AS event_id, CAST(p_partkey AS VARCHAR) AS template_id FROM part
        QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 7 = 0 DESC, p_size, CAST(p_partkey AS VARCHAR)) = 1""",
    "w13_first_success": r""", a AS (SELECT conv_id || '-' || (turn // 7) AS document_id, (turn * 3 + conv_id) % 7 AS rank,
            role = 'assistant' AND conv_id % 3 <> 0 AS ok,
            regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
              '(?i)((?:api[_-]?key|subscription[_-]?key|token|access[_-]?token)["'']?\s*[:=]\s*["'']?)[^"'',\s}]+', '\1[redacted]', 'g') AS message
          FROM conversations),
        w AS (SELECT document_id, min(rank) FILTER (ok) AS won FROM a GROUP BY ALL),
        p AS (SELECT ['azure','google','textract','vision','http','local','mock'] AS names)
        SELECT document_id, names[won + 1] AS provider,
          coalesce(string_agg(names[rank + 1], ',' ORDER BY rank) FILTER (NOT ok AND (won IS NULL OR rank < won)), '') AS failed,
          coalesce(string_agg(message, '|' ORDER BY rank) FILTER (NOT ok AND (won IS NULL OR rank < won)), '') AS messages
        FROM a JOIN w USING (document_id), p GROUP BY document_id, won, names""".replace(", a AS", "WITH a AS", 1),
    "o1_listing_order": b.sql("SELECT record_id, row_number FROM v_records", "v_records"),
    "o2_export_order": b.sql("SELECT event_id, record_id, row_number FROM v_records", "v_records"),
}
