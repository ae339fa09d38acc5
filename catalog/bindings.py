"""The given tables seen as domain tables, once in Spark and once as SQL.

records   orders          documents  customer and supplier
cells     lineitem        members    supplier, 25 events each
fields    part            teams      customer (events) and orders (memberships)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def days(base, count):
    return base + F.make_dt_interval(count.cast("int"))


def day_text(column):
    return F.date_format(column, "yyyy-MM-dd")


def stamp_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def documents(spark, sf):
    start = F.lit("1996-01-01").cast("timestamp_ntz")

    def shape(df, key, name):
        return df.select(
            key.cast("string").alias("document_id"), (key % 25).cast("string").alias("event_id"),
            F.col(name).alias("file_name"), days(start, key % 2000).alias("updated_at"),
        )

    return shape(table(spark, sf, "customer"), F.col("c_custkey"), "c_name").unionByName(
        shape(table(spark, sf, "supplier"), F.col("s_suppkey") + 10_000_000, "s_name")
    )


def records(spark, sf):
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        k.cast("string").alias("record_id"), (F.col("o_custkey") % 25).cast("string").alias("event_id"),
        F.when(k % 13 != 0, F.col("o_custkey").cast("string")).alias("document_id"),
        F.when(k % 29 != 0, (k % 97 + 1).cast("int")).alias("row_number"),
        F.when(done, F.when(k % 4 == 0, "rejected").otherwise("approved"))
        .when(F.col("o_orderstatus") == "P", "needs_review").otherwise("draft").alias("status"),
        F.when(done & (k % 7 != 0), (k % 120).cast("string")).alias("reviewed_by"),
        day.alias("created_at"), days(day, F.lit(3)).alias("updated_at"),
        F.when(done & (k % 5 != 0), days(day, k % 5)).alias("reviewed_at"),
        F.when(
            k % 17 != 0, (F.round(F.col("o_totalprice") * 100).cast("bigint") % 101) / F.lit(100.0)
        ).alias("confidence"),
    )


def _first_lines(spark, sf):
    """One lineitem per (order, line number). Lines of an order are brought together, for what groups by order next."""
    order = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    row = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                   "l_shipdate")
    return table(spark, sf, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min_by(row, order).alias("r")
    ).select("l_orderkey", "l_linenumber", "r.*")


def _cell_value():
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, F.col("l_quantity").cast("int").cast("string"))
        .when(n == 2, F.col("l_returnflag"))
        .when(n == 3, day_text(F.col("l_shipdate")))
        .when(n == 4, F.when(F.col("l_tax") == 0, "").otherwise(F.col("l_linestatus")))
        .when(n == 5, F.when(F.col("l_returnflag") == "A", "true").otherwise("false"))
        .otherwise(F.col("l_partkey").cast("string"))
    )


def cells(spark, sf):
    flagged = F.when(F.col("l_returnflag") == "R", F.lit("flag"))
    untaxed = F.when(F.col("l_tax") == 0, F.lit("tax"))
    return _first_lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.col("l_linenumber").cast("string").alias("field_id"),
        _cell_value().alias("normalized_value"),
        ((100 - 5 * F.round(F.col("l_discount") * 100).cast("int")) / F.lit(100.0)).alias("confidence"),
        F.array_compact(F.array(flagged, untaxed)).alias("issues"),
    )


FIELD_KINDS = ("number", "select", "date", "text", "signature", "text", "text")


def event_fields(spark, sf):
    """Seven fields for every event, one event per nation."""
    kinds = F.array(*[F.lit(k) for k in FIELD_KINDS])
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("event_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"),
    ).select(
        "event_id", F.concat_ws("_", "event_id", F.col("n").cast("string")).alias("field_id"),
        F.concat(F.lit("f"), F.col("n").cast("string")).alias("key"),
        F.element_at(kinds, F.col("n")).alias("type"), (F.col("n") % 2 == 0).alias("required"),
        F.col("n").alias("sort_order"),
    )


def event_cells(spark, sf):
    """Cells whose field belongs to the event of their record."""
    owner = records(spark, sf).select("record_id", "event_id")
    return cells(spark, sf).join(owner, "record_id").withColumn(
        "key", F.concat(F.lit("f"), "field_id")
    ).withColumn("field_id", F.concat_ws("_", "event_id", "field_id"))


def records_with_data(spark, sf):
    """Records with the map of their (at most seven) cells."""
    data = cells(spark, sf).groupBy("record_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat(F.lit("f"), "field_id"), "normalized_value"))
        ).alias("data")
    )
    return records(spark, sf).join(data, "record_id", "left")


def users(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("user_id"),
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.col("s_name").alias("name"),
    )


def members(spark, sf):
    k, e = F.col("s_suppkey"), F.col("e")
    return table(spark, sf, "supplier").select(
        k, F.explode(F.sequence(F.lit(0), F.lit(24))).alias("e")
    ).filter((k + e) % 3 != 0).select(
        e.cast("string").alias("event_id"), k.cast("string").alias("user_id"),
        F.when(k % 10 == 0, "owner").otherwise("reviewer").alias("role"),
    )


def team_events(spark, sf):
    """One event per customer."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.cast("string").alias("event_id"), F.col("c_name").alias("title"),
        F.when(k % 6 != 0, (k % 60).cast("string")).alias("owner_id"),
        days(F.lit("1997-01-01").cast("timestamp_ntz"), k % 900).alias("created_at"),
        days(F.lit("1998-01-01").cast("timestamp_ntz"), k % 700).alias("event_date"),
    )


def team_members(spark, sf):
    k, u = F.col("o_custkey"), F.col("o_orderkey") % 60
    return table(spark, sf, "orders").groupBy(
        k.cast("string").alias("event_id"), u.cast("string").alias("user_id")
    ).agg(
        F.max(F.when((k + u) % 5 == 0, 1).otherwise(0)).alias("_o"),
        F.min("o_orderdate").alias("created_at"),
    ).select(
        "event_id", "user_id", F.when(F.col("_o") == 1, "owner").otherwise("reviewer").alias("role"),
        "created_at",
    )


# Label and type of a field by its place in a template of eight part rows.
PLACES = (
    ("Full Name", "text"), ("Email Address", "email"), ("Phone", "phone"), (None, "text"),
    ("Signature", "signature"), (None, "select"), ("Attendance Date", "date"), (None, "number"),
)


def template_of(spark, sf, key):
    """A template for each number of an order or file, all templates alike."""
    return (key % (table(spark, sf, "part").count() // 8)).cast("string")


def template_fields(spark, sf):
    """Templates of eight fields, one field per part row."""
    k, place = F.col("p_partkey"), F.col("p_partkey") % 8
    label, kind = None, None
    for i, (name, type_) in enumerate(PLACES):
        own = {3: F.col("p_name"), 5: F.concat_ws(" ", "p_type", "p_brand"),
               7: F.concat_ws(" ", F.lit("Size of"), "p_name")}
        value = F.lit(name) if name else own[i]
        label = F.when(place == i, value) if label is None else label.when(place == i, value)
        kind = F.when(place == i, type_) if kind is None else kind.when(place == i, type_)
    rows = table(spark, sf, "part").select(
        F.call_function("div", k, F.lit(8)).cast("string").alias("template_id"),
        k.cast("string").alias("field_id"), (place + 1).cast("int").alias("sort_order"),
        label.alias("label"), kind.alias("type"), (F.col("p_size") % 2 == 0).alias("required"),
    )
    return rows.withColumn(
        "key", F.btrim(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), F.lit("_"))
    ).withColumn("aliases", F.array().cast("array<string>")).withColumn(
        "options",
        F.when(F.col("type") == "select", F.array(*[F.lit(o) for o in ("Open", "Filled", "Shipped")]))
        .otherwise(F.array().cast("array<string>")),
    )


# The same views as SQL.
VIEWS = {
    "v_documents": """
      SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(c_custkey % 25 AS VARCHAR) AS event_id,
             c_name AS file_name,
             TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS updated_at
      FROM customer
      UNION ALL
      SELECT CAST(s_suppkey + 10000000 AS VARCHAR), CAST((s_suppkey + 10000000) % 25 AS VARCHAR),
             s_name,
             TIMESTAMP '1996-01-01' + to_days(CAST((s_suppkey + 10000000) % 2000 AS INTEGER))
      FROM supplier""",
    "v_records": """
      SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_custkey % 25 AS VARCHAR) AS event_id,
             CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS document_id,
             CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderkey % 97 + 1 AS INTEGER) END AS row_number,
             CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' ELSE 'approved' END
                  WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'draft' END AS status,
             CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0
                  THEN CAST(o_orderkey % 120 AS VARCHAR) END AS reviewed_by,
             o_orderdate AS created_at, o_orderdate + to_days(3) AS updated_at,
             CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0
                  THEN o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) END AS reviewed_at,
             CASE WHEN o_orderkey % 17 <> 0
                  THEN (CAST(round(o_totalprice * 100) AS BIGINT) % 101) / 100.0::DOUBLE END AS confidence
      FROM orders""",
    "v_lines": """
      SELECT * FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1""",
    "v_cells": """
      SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_linenumber AS VARCHAR) AS field_id,
             CASE l_linenumber
               WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
               WHEN 2 THEN l_returnflag
               WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%d')
               WHEN 4 THEN CASE WHEN l_tax = 0 THEN '' ELSE l_linestatus END
               WHEN 5 THEN CASE WHEN l_returnflag = 'A' THEN 'true' ELSE 'false' END
               ELSE CAST(l_partkey AS VARCHAR) END AS normalized_value,
             (100 - 5 * CAST(round(l_discount * 100) AS INTEGER)) / 100.0::DOUBLE AS confidence,
             CAST(l_returnflag = 'R' AS INTEGER) + CAST(l_tax = 0 AS INTEGER) AS issue_count
      FROM v_lines""",
    "v_event_fields": """
      SELECT CAST(n_nationkey AS VARCHAR) AS event_id, n_nationkey || '_' || n AS field_id,
             'f' || n AS key,
             ['number','select','date','text','signature','text','text'][n] AS type,
             n % 2 = 0 AS required, n AS sort_order
      FROM nation, (SELECT unnest(range(1, 8)) AS n)""",
    "v_users": """
      SELECT CAST(s_suppkey AS VARCHAR) AS user_id,
             lower(replace(s_name, '#', '.')) || '@example.com' AS email, s_name AS name
      FROM supplier""",
    "v_members": """
      SELECT CAST(e AS VARCHAR) AS event_id, CAST(s_suppkey AS VARCHAR) AS user_id,
             CASE WHEN s_suppkey % 10 = 0 THEN 'owner' ELSE 'reviewer' END AS role
      FROM supplier, (SELECT unnest(range(0, 25)) AS e) WHERE (s_suppkey + e) % 3 <> 0""",
    "v_team_events": """
      SELECT CAST(c_custkey AS VARCHAR) AS event_id, c_name AS title,
             CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 60 AS VARCHAR) END AS owner_id,
             TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS created_at,
             TIMESTAMP '1998-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS event_date
      FROM customer""",
    "v_team_members": """
      SELECT CAST(o_custkey AS VARCHAR) AS event_id, CAST(o_orderkey % 60 AS VARCHAR) AS user_id,
             CASE WHEN (o_custkey + o_orderkey % 60) % 5 = 0 THEN 'owner' ELSE 'reviewer' END AS role,
             min(o_orderdate) AS created_at
      FROM orders GROUP BY o_custkey, o_orderkey % 60""",
    "v_template_fields": """
      SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM (
        SELECT CAST(p_partkey // 8 AS VARCHAR) AS template_id, CAST(p_partkey AS VARCHAR) AS field_id,
               CAST(p_partkey % 8 + 1 AS INTEGER) AS sort_order,
               CASE p_partkey % 8 WHEN 0 THEN 'Full Name' WHEN 1 THEN 'Email Address' WHEN 2 THEN 'Phone'
                 WHEN 3 THEN p_name WHEN 4 THEN 'Signature' WHEN 5 THEN p_type || ' ' || p_brand
                 WHEN 6 THEN 'Attendance Date' ELSE 'Size of ' || p_name END AS label,
               ['text','email','phone','text','signature','select','date','number'][p_partkey % 8 + 1] AS type,
               p_size % 2 = 0 AS required
        FROM part)""",
}
NEEDS = {"v_cells": ("v_lines",)}


def sql(query: str, *views: str) -> str:
    """`query` with the named views, and what they need, in front."""
    wanted: list[str] = []
    for view in views:
        for name in (*NEEDS.get(view, ()), view):
            if name not in wanted:
                wanted.append(name)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + "\n" + query


def number_in_document(spark, sf):
    """Records with a document, numbered 1..n inside it by (created_at, record)."""
    from tallysheet.operators.ordered import number_rows

    rows = records(spark, sf).filter(F.col("document_id").isNotNull())
    return number_rows(
        rows, ["document_id"], [F.col("created_at"), F.col("record_id")], F.year("created_at"),
        "position",
    )
