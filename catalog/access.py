"""Access, rosters and stored-table changes."""

from __future__ import annotations

import uuid
from pyspark.sql import functions as F

from catalog import bindings as b
from tallysheet.session import checkpoint_root
from tallysheet.operators import access as a
from tallysheet.operators import storage as s


def q_p1(spark, sf):
    return a.access_pairs(b.team_events(spark, sf), b.team_members(spark, sf))


def q_p1_user(spark, sf):
    return a.visible_events(b.team_events(spark, sf), b.team_members(spark, sf), "7").select("event_id", "title")


def q_p2(spark, sf):
    return a.manageable_pairs(b.team_events(spark, sf), b.team_members(spark, sf))


def q_j3(spark, sf):
    return a.members_with_users(b.members(spark, sf), b.users(spark, sf))


def q_o4(spark, sf):
    rows = a.members_with_users(b.members(spark, sf), b.users(spark, sf))
    return rows.orderBy("event_id", *a.team_order()).select("event_id", "user_id", "role")


def q_p9(spark, sf):
    fields = b.template_fields(spark, sf).withColumn("options", F.array().cast("array<string>"))
    t = F.col("template_id").cast("bigint")
    templates = fields.groupBy("template_id").agg(F.count("*").alias("n")).select(
        "template_id", (t % 400).cast("string").alias("event_id"), (t % 7 == 0).alias("is_default"),
        (t % 11).alias("created_at"),
    )
    view = a.event_view(b.team_events(spark, sf), templates, fields)
    return view.select(
        "event_id", "event_day", "template_id",
        F.array_join(F.transform("fields", lambda f: f["key"]), ",").alias("field_keys"),
    )


def q_p9_members(spark, sf):
    return a.event_members_view(b.team_members(spark, sf), b.users(spark, sf)).select(
        "event_id", "user_id", "email", "role"
    )


def _invites(spark, sf):
    k, u = F.col("o_orderkey"), F.col("o_orderkey") % 130
    known = F.concat(F.lit(" Supplier."), F.lpad(u.cast("string"), 9, "0"), F.lit("@Example.com"))
    return b.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("event_id"),
        F.when(k % 3 != 0, known).otherwise(F.concat(F.lit("guest"), (k % 50).cast("string"), F.lit("@x.org "))).alias("email"),
        F.when(k % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Guest "), (k % 9).cast("string"))).alias("name"),
        F.concat(F.lit("g"), k.cast("string")).alias("user_id"), (k % 60).cast("string").alias("invited_by"),
        k.alias("position"),
    )


def _roster(spark, sf):
    return a.roster_sync(
        b.team_events(spark, sf), b.team_members(spark, sf), b.users(spark, sf), _invites(spark, sf)
    )


def q_t9_users(spark, sf):
    return _roster(spark, sf)[0]


def q_t9_members(spark, sf):
    return _roster(spark, sf)[1]


def q_t9_outbox(spark, sf):
    return _roster(spark, sf)[2]


def _changes(spark, sf):
    n = F.col("l_linenumber") % 3
    return b.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 1400).cast("string").alias("event_id"),
        (F.col("l_partkey") % 60).cast("string").alias("user_id"),
        F.when(n == 0, "remove").when(n == 1, "reviewer").otherwise("owner").alias("action"),
    )


def _role_changes(spark, sf):
    return a.role_changes(b.team_events(spark, sf), b.team_members(spark, sf), _changes(spark, sf))


def q_t10_members(spark, sf):
    return _role_changes(spark, sf)[0].select("event_id", "user_id", "role")


def q_t10_events(spark, sf):
    return _role_changes(spark, sf)[1].select("event_id", "owner_id")


def q_t10_refused(spark, sf):
    return _role_changes(spark, sf)[2]


def _claimed(spark, sf):
    return a.claim_ownerless(b.team_events(spark, sf), b.team_members(spark, sf), "7")


def q_t11_events(spark, sf):
    return _claimed(spark, sf)[0].select("event_id", "owner_id")


def q_t11_members(spark, sf):
    return _claimed(spark, sf)[1]


def q_s12(spark, sf):
    k = F.col("c_custkey")
    changes = b.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("user_id"),
        F.concat(F.lit("supplier."), F.lpad((k % 140).cast("string"), 9, "0"), F.lit("@example.com")).alias("email"),
        F.when(k % 3 != 0, F.col("c_name")).alias("name"), k.alias("at"),
    )
    return s.upsert_by_key(
        b.users(spark, sf), changes, ["email"], keep_old_when_null=["name"], latest=[F.col("at")]
    )


def _reextracted(spark, sf):
    rows = b.records(spark, sf).select("record_id", "document_id")
    new = rows.filter((F.col("record_id").cast("bigint") % 10 == 0) & F.col("document_id").isNotNull())
    new = new.withColumn("record_id", F.concat(F.lit("n"), "record_id"))
    new_cells = new.select("record_id", F.lit("1").alias("field_id"))
    return rows, b.cells(spark, sf).select("record_id", "field_id"), new, new_cells


def q_s13_records(spark, sf):
    return s.replace_by_document(*_reextracted(spark, sf))[0]


def q_s13_cells(spark, sf):
    return s.replace_by_document(*_reextracted(spark, sf))[1]


def q_s13_parts(spark, sf):
    """The same on a table stored by document, of which only the changed parts are written."""
    rows, _, new, _ = _reextracted(spark, sf)
    path = f"{checkpoint_root(spark)}/parts-{uuid.uuid4().hex}"
    s.write_parts(rows, path, "document_id", parts=16)
    s.replace_documents(spark, path, new, new, parts=16)
    return s.read_parts(spark, path).select("record_id", "document_id")


def q_s14_documents(spark, sf):
    gone = b.documents(spark, sf).filter(F.col("document_id").cast("bigint") % 7 == 0)
    docs, recs, cells = s.delete_documents(
        gone, b.documents(spark, sf).select("document_id"),
        b.records(spark, sf).select("record_id", "document_id"), b.cells(spark, sf).select("record_id", "field_id"),
    )
    return (
        docs.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), F.lit("").alias("part"))
        .unionByName(recs.select(F.lit("record").alias("kind"), F.col("record_id").alias("id"), F.lit("").alias("part")))
        .unionByName(cells.select(F.lit("cell").alias("kind"), F.col("record_id").alias("id"), F.col("field_id").alias("part")))
    )


def q_s14_events(spark, sf):
    """The rows that stay in all four tables."""
    gone = b.table(spark, sf, "nation").filter(F.col("n_nationkey") % 4 == 0).select(
        F.col("n_nationkey").cast("string").alias("event_id"))
    kept = s.delete_events(gone, {
        "members": b.members(spark, sf), "documents": b.documents(spark, sf),
        "records": b.records(spark, sf), "cells": b.cells(spark, sf),
    })
    ids = {"members": ("event_id", "user_id"), "documents": ("event_id", "document_id"),
           "records": ("event_id", "record_id"), "cells": ("record_id", "field_id")}
    parts = [kept[n].select(F.lit(n).alias("kind"), F.col(x).alias("owner"), F.col(y).alias("id")) for n, (x, y) in ids.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def q_s14_references(spark, sf):
    gone = b.users(spark, sf).filter(F.col("user_id").cast("bigint") % 9 == 0)
    return s.clear_references(
        b.records(spark, sf).select("record_id", "reviewed_by"), "reviewed_by", gone, "user_id"
    )


def q_s15(spark, sf):
    new = b.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 25).cast("string").alias("event_id"),
        F.col("l_suppkey").cast("string").alias("user_id"),
        F.when(F.col("l_returnflag") == "R", "owner").otherwise("reviewer").alias("role"),
    )
    return s.insert_skip_duplicates(b.members(spark, sf), new, ["event_id", "user_id"], [F.col("role")])


def _attempts(spark, sf):
    """Texts with `token` failed; every second failure is named, with up to three causes."""
    text, k = F.col("text"), F.col("doc_id")
    cause = lambda i: F.struct(F.when(k % 2 == 0, f"Error{i}").alias("name"), F.concat(F.lit(f"token: t{i} of "), k.cast("string")).alias("message"))
    bad = F.contains(text, F.lit("token"))
    return b.table(spark, sf, "documents").select(
        k.cast("string").alias("document_id"), "lang",
        F.when(k % 3 == 0, "application/pdf").otherwise("image/png").alias("file_type"),
        (k % 4).cast("int").alias("page_start"), F.when(k % 5 > 0, (k % 5).cast("int")).alias("page_count"),
        F.when(bad, text).alias("error"), F.when(k % 2 == 0, "RangeError").alias("error_name"),
        F.slice(F.array(cause(1), cause(2), cause(3)), F.lit(1), (k % 4).cast("int")).alias("causes"),
    )


def q_s16_failed(spark, sf):
    failed = s.quarantine(_attempts(spark, sf), name="error_name", causes="causes")[1]
    return failed.select(
        "document_id", "status", "layout", "message", "error_name",
        F.array_join(F.transform("causes", lambda c: F.concat_ws("=", c["name"], c["message"])), ";").alias("causes"),
        F.concat_ws("-", "pages.start", "pages.count", "pages.total").alias("pages"),
    )


def q_s16_good(spark, sf):
    return s.quarantine(_attempts(spark, sf), name="error_name", causes="causes")[0].select("document_id", "lang")


def q_u5(spark, sf):
    rows = b.records(spark, sf).select("record_id", "event_id")
    new = b.table(spark, sf, "customer").filter(F.col("c_custkey") % 25 < 5).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"),
        (F.col("c_custkey") % 25).cast("string").alias("event_id"),
    )
    return s.replace_slice(rows, new, "event_id")


def q_w12(spark, sf):
    return a.reorder_fields(
        b.template_fields(spark, sf), [F.col("label").desc(), F.col("field_id")]
    ).select("field_id", "sort_order")


QUERIES = {
    "p1_access_pairs": q_p1, "p1_visible_events": q_p1_user, "p2_manageable_pairs": q_p2,
    "p9_event_view": q_p9, "p9_event_members": q_p9_members, "j3_members_with_users": q_j3,
    "o4_team_order": q_o4, "t9_roster_users": q_t9_users, "t9_roster_members": q_t9_members,
    "t9_invitation_outbox": q_t9_outbox, "t10_role_members": q_t10_members,
    "t10_event_owners": q_t10_events, "t10_refused_changes": q_t10_refused,
    "t11_claimed_events": q_t11_events, "t11_claimed_members": q_t11_members,
    "s12_upsert_users": q_s12, "s13_replaced_records": q_s13_records, "s13_replaced_cells": q_s13_cells, "s13_rewritten_parts": q_s13_parts,
    "s14_delete_documents": q_s14_documents, "s14_delete_events": q_s14_events,
    "s14_clear_references": q_s14_references, "s15_insert_skip_duplicates": q_s15,
    "s16_failed_documents": q_s16_failed, "s16_good_documents": q_s16_good, "u5_replace_slice": q_u5,
    "w12_reorder_fields": q_w12,
}

PAIRS = "SELECT owner_id AS user_id, event_id FROM v_team_events WHERE owner_id IS NOT NULL UNION SELECT user_id, event_id FROM v_team_members"
INVITES = """, inv AS (SELECT CAST(o_custkey AS VARCHAR) AS event_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'supplier.' || lpad(CAST(o_orderkey % 130 AS VARCHAR), 9, '0') || '@example.com'
      ELSE 'guest' || (o_orderkey % 50) || '@x.org' END AS email,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'Guest ' || (o_orderkey % 9) END AS name,
    'g' || o_orderkey AS user_id, CAST(o_orderkey % 60 AS VARCHAR) AS invited_by, o_orderkey AS position FROM orders),
  newest AS (SELECT email, arg_max(name, position) FILTER (name IS NOT NULL) AS name,
    arg_min(user_id, position) AS fresh FROM inv GROUP BY ALL),
  people AS (SELECT coalesce(u.user_id, fresh) AS user_id, email, coalesce(newest.name, u.name) AS name
    FROM v_users u FULL JOIN newest USING (email)),
  added AS (SELECT event_id, people.user_id, email, arg_min(invited_by, position) AS invited_by
    FROM inv JOIN people USING (email) ANTI JOIN v_team_members m ON m.event_id = inv.event_id AND m.user_id = people.user_id
    GROUP BY ALL)
"""
INVITES = INVITES.replace(
    "FROM inv JOIN people USING (email) ANTI JOIN v_team_members m ON m.event_id = inv.event_id AND m.user_id = people.user_id\n    GROUP BY ALL",
    "FROM inv JOIN people USING (email)\n    WHERE NOT EXISTS (SELECT 1 FROM v_team_members m WHERE m.event_id = inv.event_id AND m.user_id = people.user_id)\n    GROUP BY event_id, people.user_id, email")
ROLES = """, ask AS (SELECT CAST(l_orderkey % 1400 AS VARCHAR) AS event_id, CAST(l_partkey % 60 AS VARCHAR) AS user_id,
    max(CASE l_linenumber % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'reviewer' ELSE 'owner' END) AS action FROM lineitem GROUP BY ALL),
  j AS (SELECT m.*, action, count(*) FILTER (action = 'owner' OR (role = 'owner' AND coalesce(action, '') <> 'reviewer'))
      OVER (PARTITION BY m.event_id) AS left_owners
    FROM v_team_members m LEFT JOIN ask USING (event_id, user_id)),
  k AS (SELECT *, CASE WHEN role = 'owner' AND action = 'remove' THEN 'owner_not_removable'
      WHEN role = 'owner' AND action = 'reviewer' AND left_owners = 0 THEN 'last_owner' END AS reason FROM j),
  n AS (SELECT event_id, user_id, created_at, role AS was, CASE WHEN reason IS NULL THEN action END AS did,
      CASE WHEN reason IS NULL AND action IN ('owner','reviewer') THEN action ELSE role END AS role
    FROM k WHERE reason IS NOT NULL OR coalesce(action, '') <> 'remove')
"""
REMAINING = """, keep AS (SELECT record_id FROM v_records WHERE CAST(event_id AS INTEGER) % 4 <> 0)
"""

ORACLE = {
    "p1_access_pairs": b.sql(PAIRS, "v_team_events", "v_team_members"),
    "p1_visible_events": b.sql(
        f"SELECT event_id, title FROM v_team_events SEMI JOIN (SELECT * FROM ({PAIRS}) WHERE user_id = '7') USING (event_id)",
        "v_team_events", "v_team_members"),
    "p2_manageable_pairs": b.sql(
        """SELECT user_id, event_id FROM v_team_members WHERE role = 'owner'
        UNION ALL
        SELECT owner_id, event_id FROM v_team_events e WHERE owner_id IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM v_team_members m WHERE m.event_id = e.event_id AND m.user_id = e.owner_id)""",
        "v_team_events", "v_team_members"),
    "p9_event_view": b.sql(
        """, t AS (SELECT template_id, CAST(CAST(template_id AS INTEGER) % 400 AS VARCHAR) AS event_id,
            string_agg(key, ',' ORDER BY sort_order) AS field_keys FROM v_template_fields GROUP BY template_id),
        eff AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY
            CAST(template_id AS INTEGER) % 7 = 0 DESC, CAST(template_id AS INTEGER) % 11, template_id) = 1)
        SELECT event_id, strftime(event_date, '%Y-%m-%d') AS event_day, template_id, coalesce(field_keys, '') AS field_keys
        FROM v_team_events LEFT JOIN eff USING (event_id)""", "v_team_events", "v_template_fields"),
    "p9_event_members": b.sql(
        "SELECT event_id, user_id, email, role FROM v_team_members JOIN v_users USING (user_id)",
        "v_team_members", "v_users"),
    "j3_members_with_users": b.sql(
        "SELECT event_id, user_id, role, email, name FROM v_members JOIN v_users USING (user_id)",
        "v_members", "v_users"),
    "o4_team_order": b.sql(
        "SELECT event_id, user_id, role FROM v_members JOIN v_users USING (user_id)", "v_members", "v_users"),
    "t9_roster_users": b.sql(INVITES + "SELECT * FROM people", "v_users", "v_team_members"),
    "t9_roster_members": b.sql(
        INVITES + """SELECT event_id, user_id, role FROM v_team_members
        UNION ALL SELECT event_id, user_id, 'reviewer' FROM added""", "v_users", "v_team_members"),
    "t9_invitation_outbox": b.sql(
        INVITES + """SELECT event_id, title, email AS invitee, invited_by,
          CASE WHEN length('reviewer-invite-' || event_id || '-' || regexp_replace(email, '[^a-z0-9]+', '-', 'g')) <= 256
            THEN 'reviewer-invite-' || event_id || '-' || regexp_replace(email, '[^a-z0-9]+', '-', 'g')
            ELSE substr('reviewer-invite-' || event_id || '-' || regexp_replace(email, '[^a-z0-9]+', '-', 'g'), 1, 223) || '-'
              || md5('reviewer-invite-' || event_id || '-' || regexp_replace(email, '[^a-z0-9]+', '-', 'g')) END AS idempotency_key
        FROM added JOIN v_team_events USING (event_id)""", "v_users", "v_team_members", "v_team_events"),
    "t10_role_members": b.sql(ROLES + "SELECT event_id, user_id, role FROM n", "v_team_members"),
    "t10_event_owners": b.sql(
        ROLES + """, h AS (SELECT event_id, arg_min(user_id, (created_at, user_id)) FILTER (role = 'owner') AS heir,
            arg_min(user_id, (created_at, user_id)) FILTER (did = 'owner' AND was <> 'owner') AS promoted FROM n GROUP BY ALL)
        SELECT e.event_id, CASE WHEN lost.user_id IS NOT NULL THEN heir ELSE coalesce(owner_id, promoted) END AS owner_id
        FROM v_team_events e LEFT JOIN h USING (event_id)
        LEFT JOIN (SELECT * FROM n WHERE was = 'owner' AND role = 'reviewer') lost
          ON lost.event_id = e.event_id AND lost.user_id = e.owner_id""", "v_team_members", "v_team_events"),
    "t10_refused_changes": b.sql(
        ROLES + "SELECT event_id, user_id, action, reason FROM k WHERE reason IS NOT NULL", "v_team_members"),
    "t11_claimed_events": b.sql("SELECT event_id, coalesce(owner_id, '7') AS owner_id FROM v_team_events", "v_team_events"),
    "t11_claimed_members": b.sql(
        """SELECT event_id, user_id, role FROM v_team_members UNION ALL
        SELECT event_id, '7', 'owner' FROM v_team_events e WHERE owner_id IS NULL AND NOT EXISTS
          (SELECT 1 FROM v_team_members m WHERE m.event_id = e.event_id AND m.user_id = '7')""",
        "v_team_events", "v_team_members"),
    "s12_upsert_users": b.sql(
        """, ch AS (SELECT 'c' || c_custkey AS user_id,
            'supplier.' || lpad(CAST(c_custkey % 140 AS VARCHAR), 9, '0') || '@example.com' AS email,
            CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer
            QUALIFY row_number() OVER (PARTITION BY c_custkey % 140 ORDER BY c_custkey DESC) = 1)
        SELECT coalesce(ch.user_id, u.user_id) AS user_id, email, coalesce(ch.name, u.name) AS name
        FROM v_users u FULL JOIN ch USING (email)""", "v_users"),
    "s13_replaced_records": b.sql(
        """, rep AS (SELECT DISTINCT document_id FROM v_records WHERE CAST(record_id AS BIGINT) % 10 = 0 AND document_id IS NOT NULL)
        SELECT record_id, document_id FROM v_records WHERE document_id IS NULL OR document_id NOT IN (FROM rep)
        UNION ALL SELECT 'n' || record_id, document_id FROM v_records WHERE CAST(record_id AS BIGINT) % 10 = 0 AND document_id IS NOT NULL""",
        "v_records"),
    "s13_replaced_cells": b.sql(
        """, rep AS (SELECT DISTINCT document_id FROM v_records WHERE CAST(record_id AS BIGINT) % 10 = 0 AND document_id IS NOT NULL)
        SELECT record_id, field_id FROM v_cells WHERE record_id NOT IN (SELECT record_id FROM v_records SEMI JOIN rep USING (document_id))
        UNION ALL SELECT 'n' || record_id, '1' FROM v_records WHERE CAST(record_id AS BIGINT) % 10 = 0 AND document_id IS NOT NULL""",
        "v_records", "v_cells"),
    "s14_delete_documents": b.sql(
        """, lost AS (SELECT record_id FROM v_records WHERE CAST(document_id AS BIGINT) % 7 = 0)
        SELECT 'document' AS kind, document_id AS id, '' AS part FROM v_documents WHERE CAST(document_id AS BIGINT) % 7 <> 0
        UNION ALL SELECT 'record', record_id, '' FROM v_records WHERE record_id NOT IN (FROM lost)
        UNION ALL SELECT 'cell', record_id, field_id FROM v_cells WHERE record_id NOT IN (FROM lost)""",
        "v_documents", "v_records", "v_cells"),
    "s14_delete_events": b.sql(
        """, gone AS (SELECT CAST(n_nationkey AS VARCHAR) AS event_id FROM nation WHERE n_nationkey % 4 = 0)
        SELECT 'cells' AS kind, record_id AS owner, field_id AS id FROM v_cells
          WHERE record_id NOT IN (SELECT record_id FROM v_records JOIN gone USING (event_id))
        UNION ALL SELECT 'documents', event_id, document_id FROM v_documents ANTI JOIN gone USING (event_id)
        UNION ALL SELECT 'members', event_id, user_id FROM v_members ANTI JOIN gone USING (event_id)
        UNION ALL SELECT 'records', event_id, record_id FROM v_records ANTI JOIN gone USING (event_id)""",
        "v_records", "v_cells", "v_documents", "v_members"),
    "s14_clear_references": b.sql(
        """SELECT record_id, CASE WHEN reviewed_by IN (SELECT user_id FROM v_users WHERE CAST(user_id AS BIGINT) % 9 = 0)
          THEN NULL ELSE reviewed_by END AS reviewed_by FROM v_records""", "v_records", "v_users"),
    "s15_insert_skip_duplicates": b.sql(
        """SELECT event_id, user_id, role FROM v_members UNION ALL
        SELECT event_id, user_id, min(role) FROM (SELECT CAST(l_partkey % 25 AS VARCHAR) AS event_id,
            CAST(l_suppkey AS VARCHAR) AS user_id, CASE WHEN l_returnflag = 'R' THEN 'owner' ELSE 'reviewer' END AS role FROM lineitem) x
        WHERE NOT EXISTS (SELECT 1 FROM v_members m WHERE m.event_id = x.event_id AND m.user_id = x.user_id)
        GROUP BY event_id, user_id""", "v_members"),
    "s16_failed_documents": r"""SELECT CAST(doc_id AS VARCHAR) AS document_id, 'failed' AS status, 'table' AS layout,
          regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
            '(?i)((?:api[_-]?key|subscription[_-]?key|token)["'']?\s*[:=]\s*["'']?)[^"'',\s}]+', '\1[redacted]', 'g') AS message,
          CASE WHEN doc_id % 2 = 0 THEN 'RangeError' ELSE 'string' END AS error_name,
          array_to_string([CASE WHEN doc_id % 2 = 0 THEN 'Error' || i ELSE 'string' END || '=token: [redacted] of ' || doc_id
            FOR i IN range(1, 1 + least(2, doc_id % 4))], ';') AS causes,
          CASE WHEN doc_id % 3 = 0 THEN concat_ws('-', doc_id % 4, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 ELSE 1 END,
            CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 ELSE 1 END) ELSE '' END AS pages
        FROM documents WHERE contains(text, 'token')""",
    "s16_good_documents": "SELECT CAST(doc_id AS VARCHAR) AS document_id, lang FROM documents WHERE NOT contains(text, 'token')",
    "u5_replace_slice": b.sql(
        """, new AS (SELECT 'c' || c_custkey AS record_id, CAST(c_custkey % 25 AS VARCHAR) AS event_id FROM customer WHERE c_custkey % 25 < 5)
        SELECT record_id, event_id FROM v_records WHERE event_id NOT IN (SELECT event_id FROM new) UNION ALL FROM new""",
        "v_records"),
    "w12_reorder_fields": b.sql(
        """SELECT field_id, CAST(row_number() OVER (PARTITION BY template_id ORDER BY label DESC, field_id) AS INTEGER) AS sort_order
        FROM v_template_fields""", "v_template_fields"),
}
ORACLE["s13_rewritten_parts"] = ORACLE["s13_replaced_records"]
