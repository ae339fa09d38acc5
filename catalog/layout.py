"""Layout responses, tables, forms, words, matching and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import bindings as b
from tallysheet.operators import discovery, geometry, matching
from tallysheet.plans import tables, word_forms, word_tables
from tallysheet.sources import layouts

# One document per order, its first lineitem of each line number is a row.
HEADERS = {0: "Ful1 Name", 1: "E-mail Address:", 2: "Phone No", 3: "Date", 8: "Line Status", 9: "line  status"}


def _lines(spark, sf):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    return b._first_lines(spark, sf).select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("n"),
        F.concat(F.lit("Person "), k.cast("string")).alias("name"),
        F.concat(F.lit("u"), s.cast("string"), F.lit(" at mail dot com")).alias("email"),
        F.concat(F.lit("O8O1234"), F.lpad(s.cast("string"), 4, "0")).alias("phone"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("day"), F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"),
    )


ROW_VALUES = {0: "name", 1: "email", 2: "phone", 3: "day", 8: "status", 9: "flag"}


def documents(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        b.template_of(spark, sf, F.col("o_orderkey")).alias("template_id"),
    )


def cell_table_responses(spark, sf):
    """Two tables per document: lines 1-4 under a header, the rest continued without one."""
    def cell(kind, row, column, content, page):
        return F.struct(
            F.lit(kind).cast("string").alias("kind"), row.cast("int").alias("rowIndex"),
            F.lit(column).alias("columnIndex"), content.alias("content"),
            F.array(F.struct(F.lit(page).alias("pageNumber"),
                             F.array(*[F.lit(float(v)) for v in (1, 2, 5, 2, 5, 4, 1, 4)]).alias("polygon"))).alias("boundingRegions"),
        )
    head = F.array(*[cell("columnHeader", F.lit(0), c, F.lit(t), 1) for c, t in HEADERS.items()])
    # lines are collected as they are, cells are made of them where they meet
    grouped = _lines(spark, sf).groupBy("order").agg(
        F.collect_list(F.struct("n", *ROW_VALUES.values())).alias("lines"))

    def of(lines, first_line, page):
        return F.flatten(F.transform(lines, lambda l: F.array(
            *[cell(None, l["n"] - first_line, c, l[v], page) for c, v in ROW_VALUES.items()])))

    first, second = F.filter("lines", lambda l: l["n"] <= 4), F.filter("lines", lambda l: l["n"] > 4)
    body = F.struct(F.struct(F.array(
        F.struct(F.concat(head, of(first, 0, 1)).alias("cells")), F.struct(of(second, 5, 2).alias("cells"))
    ).alias("tables")).alias("analyzeResult"))
    return grouped.select(F.col("order").cast("string").alias("document_id"), F.to_json(body).alias("response"))


def q_s3(spark, sf):
    cells = layouts.read_cell_tables(cell_table_responses(spark, sf))
    return cells.select("document_id", "table_index", "row_index", "column_index", "is_header", "text", "page",
                        F.col("box.width").alias("width"))


def q_l1(spark, sf):
    cells = layouts.read_cell_tables(cell_table_responses(spark, sf))
    done = tables.table_rows(cells, documents(spark, sf), b.template_fields(spark, sf))
    return done.select("document_id", "output_row", "source_page", "sort_order", "normalized_value",
                       "confidence_pct", F.array_join("issues", ",").alias("issues"))


def q_l1_rows(spark, sf):
    cells = layouts.read_cell_tables(cell_table_responses(spark, sf))
    done = tables.table_rows(cells, documents(spark, sf), b.template_fields(spark, sf))
    return tables.rows_of(done)


def q_w9(spark, sf):
    return tables.header_rows(layouts.read_cell_tables(cell_table_responses(spark, sf)), carry=True)


def q_w4(spark, sf):
    mapped = tables.map_columns(_header_cells(spark, sf), b.template_fields(spark, sf))
    return mapped.select("document_id", "sort_order", "column_index", "score", "structure_pct")


def _header_cells(spark, sf):
    cells = F.array(*[F.struct(F.lit(c).alias("column_index"), F.lit(t).alias("text")) for c, t in HEADERS.items()])
    return documents(spark, sf).select(
        "document_id", "template_id", F.lit(0).alias("table_index"), F.explode(cells).alias("c")
    ).select("document_id", "template_id", "table_index", "c.*")


def q_x2(spark, sf):
    cells = layouts.read_cell_tables(cell_table_responses(spark, sf))
    found = discovery.table_suggestions(cells, documents(spark, sf), b.template_fields(spark, sf))
    return found.select("document_id", "label", "key", "type", F.array_join("options", ",").alias("options"),
                        F.array_join("samples", ",").alias("samples"))


def q_a13(spark, sf):
    values = b.table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("text"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    found = discovery.sample_values(values, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "text"])
    return found.select("l_suppkey", F.array_join("samples", ",").alias("samples"))


def q_a14(spark, sf):
    text = F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    values = b.table(spark, sf, "part").select(
        F.call_function("div", F.col("p_partkey"), F.lit(3)).alias("column"),
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("a@b."), F.col("p_name"))).otherwise(text).alias("text"),
    )
    return discovery.infer_column_types(values, ["column"])


def q_x4(spark, sf):
    rows = b.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit("Taxon id")).otherwise(F.col("p_name")).alias("header"),
        F.array(F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, F.lit("Song-birds")).otherwise(F.col("p_brand"))).alias("samples"),
    )
    return rows.select("p_partkey", discovery.known_domain(F.col("header"), F.col("samples")).alias("known"))


def _noisy_headers(spark, sf):
    fields = b.template_fields(spark, sf)
    k, label = F.col("field_id").cast("bigint"), F.col("label")
    text = (
        F.when(k % 5 == 0, F.translate(label, "oisl", "0151")).when(k % 5 == 1, F.expr("left(label, length(label) - 1)"))
        .when(k % 5 == 2, F.concat(label, F.lit(" no."))).when(k % 5 == 3, F.lit("E mail"))
        .otherwise(F.reverse(label))
    )
    return fields.select("field_id", "template_id", text.alias("text"))


def q_j5(spark, sf):
    scored = matching.match_headers(
        _noisy_headers(spark, sf).withColumnRenamed("field_id", "header_id"), b.template_fields(spark, sf), ["header_id"]
    )
    return scored.select("header_id", F.explode("matches").alias("m")).select("header_id", "m.field_id", "m.score")


def q_n7(spark, sf):
    from tallysheet.functions import scoring, text
    rows = b.table(spark, sf, "part").select(
        "p_partkey", scoring.variants(F.array(text.term(F.col("p_name")))).alias("a"),
        scoring.variants(F.array(text.term(F.concat_ws(" ", F.lit("red"), F.element_at(F.split("p_name", " "), -1))))).alias("b"),
    )
    scored = rows.withColumn("score", scoring.match_score(F.col("a"), F.col("b")))
    return scored.select("p_partkey", "score", scoring.match_confidence(F.col("score")).alias("confidence_pct"))


def _pairs_json(spark, sf):
    """One form per order from its customer: three known fields and one unknown."""
    pair = lambda k, v: F.struct(F.struct(F.lit(k).alias("content")).alias("key"), F.struct(v.alias("content")).alias("value"))
    k = F.col("o_custkey").cast("string")
    listed = F.array(
        pair("E-mail:", F.concat(F.lit("k"), k, F.lit(" [at] x dot org"))), pair("Attendance date", F.date_format("o_orderdate", "yyyy/M/d")),
        pair("Full Name", F.concat(F.lit("Customer "), k)), pair("Zebra", F.col("o_orderstatus")),
    )
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.to_json(F.struct(F.struct(listed.alias("keyValuePairs")).alias("analyzeResult"))).alias("response"),
    )


def q_s7(spark, sf):
    return layouts.read_listed_pairs(_pairs_json(spark, sf)).select("document_id", "item", "key", "value", "confidence_pct")


def q_l3(spark, sf):
    done = tables.pair_rows(layouts.read_listed_pairs(_pairs_json(spark, sf)), documents(spark, sf), b.template_fields(spark, sf))
    return done.select("document_id", "sort_order", "normalized_value", "confidence_pct")


def _anchored_json(spark, sf):
    """The text is `name|email`; cells point into it by byte range, names hold a two-byte letter."""
    name = F.concat(F.lit("Zoé "), F.col("c_custkey").cast("string"))
    mail = F.concat(F.lit("z"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    cut = F.octet_length(name)
    seg = lambda a, z: F.struct(F.struct(F.struct(F.array(F.struct(
        a.cast("string").alias("startIndex"), z.cast("string").alias("endIndex"))).alias("textSegments")).alias("textAnchor")).alias("layout"))
    inline = lambda t: F.struct(F.struct(F.struct(F.lit(t).alias("content")).alias("textAnchor")).alias("layout"))
    table = F.struct(
        F.array(F.struct(F.array(inline("Full Name"), inline("Email")).alias("cells"))).alias("headerRows"),
        F.array(F.struct(F.array(seg(F.lit(0), cut), seg(cut + 1, cut + 1 + F.octet_length(mail))).alias("cells"))).alias("bodyRows"),
    )
    doc = F.struct(F.concat(name, F.lit("|"), mail).alias("text"),
                   F.array(F.struct(F.lit(2).alias("pageNumber"), F.array(table).alias("tables"))).alias("pages"))
    return b.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("document_id"), F.to_json(F.struct(doc.alias("document"))).alias("response")
    )


def q_s4(spark, sf):
    return layouts.read_anchor_tables(_anchored_json(spark, sf)).select(
        "document_id", "row_index", "column_index", "is_header", "text", "page")


def _block_json(spark, sf):
    """A block graph per order: a table of two columns, cell texts below word blocks."""
    def block(id_, kind, text=None, row=None, column=None, ids=None, entity=None, confidence=None, selection=None):
        null = lambda t: F.lit(None).cast(t)
        return F.struct(
            id_.alias("Id"), F.lit(kind).alias("BlockType"), (text if text is not None else null("string")).alias("Text"),
            (confidence if confidence is not None else null("double")).alias("Confidence"), F.lit(3).alias("Page"),
            (row if row is not None else null("int")).alias("RowIndex"), (F.lit(column) if column else null("int")).alias("ColumnIndex"),
            F.array(*[F.lit(e) for e in (entity or [])]).cast("array<string>").alias("EntityTypes"),
            (selection if selection is not None else null("string")).alias("SelectionStatus"),
            F.array(F.struct(F.lit("CHILD").alias("Type"), (ids if ids is not None else F.array()).cast("array<string>").alias("Ids"))).alias("Relationships"),
        )
    def row(l):
        i = lambda p: F.concat(F.lit(p), l["n"].cast("string"))
        return F.array(
            block(i("a"), "CELL", row=l["n"] + 1, column=1, ids=F.array(i("w"), i("v")), confidence=F.lit(88.0)),
            block(i("b"), "CELL", row=l["n"] + 1, column=2, ids=F.array(i("s"), i("e"))),
            block(i("w"), "WORD", text=F.lit("Person")), block(i("v"), "WORD", text=F.element_at(F.split(l["name"], " "), -1)),
            block(i("s"), "SELECTION_ELEMENT", selection=F.when(l["flag"] == "R", "SELECTED").otherwise("NOT_SELECTED")),
            block(i("e"), "WORD", text=l["status"]),
        )

    # lines are collected as they are, blocks are made of them where they meet
    grouped = _lines(spark, sf).groupBy("order").agg(F.collect_list(F.struct("n", "name", "status", "flag")).alias("lines"))
    ids = F.flatten(F.transform("lines", lambda l: F.array(*[F.concat(F.lit(p), l["n"].cast("string")) for p in "ab"])))
    head = F.array(
        block(F.lit("h1"), "CELL", text=F.lit("Full Name"), row=F.lit(1), column=1, entity=["COLUMN_HEADER"]),
        block(F.lit("h2"), "CELL", text=F.lit("Signature"), row=F.lit(1), column=2, entity=["COLUMN_HEADER"]),
    )
    table = F.array(block(F.lit("t"), "TABLE", ids=F.concat(F.array(F.lit("h1"), F.lit("h2")), ids)))
    return grouped.select(
        F.col("order").cast("string").alias("document_id"),
        F.to_json(F.struct(F.concat(table, head, F.flatten(F.transform("lines", row))).alias("Blocks"))).alias("response"),
    )


def q_s5(spark, sf):
    return layouts.read_block_tables(_block_json(spark, sf)).select(
        "document_id", "row_index", "column_index", "is_header", "text", "provider_pct", "page")


def _words_json(spark, sf):
    v = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    q, p = F.col("l_quantity"), F.col("l_partkey") % 500
    word = F.struct(
        F.array(F.struct(F.lit("W").alias("text")), F.struct(F.col("l_returnflag").alias("text"))).alias("symbols"),
        F.struct(F.array(v(p, q), v(p + 12, q + 8)).alias("vertices")).alias("boundingBox"),
        (F.col("l_linenumber") / 10).alias("confidence"),
    )
    grouped = b._first_lines(spark, sf).groupBy("l_orderkey").agg(F.collect_list(word).alias("words"))
    page = F.struct(F.lit(500.0).alias("width"), F.lit(100.0).alias("height"), F.array(F.struct(F.array(
        F.struct(F.col("words")).alias("w")).alias("paragraphs"))).alias("blocks"))
    body = F.struct(F.array(F.struct(F.struct(F.array(page).alias("pages")).alias("fullTextAnnotation"))).alias("responses"))
    return grouped.select(F.col("l_orderkey").cast("string").alias("document_id"), F.to_json(body).alias("response"))


def q_s6(spark, sf):
    return layouts.read_word_boxes(_words_json(spark, sf)).select(
        "document_id", "page", "text", "x", "y", "width", "height", "confidence_pct")


def _ready_json(spark, sf):
    cell = F.array(F.struct(F.lit("email_address").alias("fieldKey"), F.col("email").alias("rawValue"), F.lit(0.777).alias("confidence")))
    row = F.struct(
        F.when(F.col("n") > 2, F.col("n") * 10).alias("rowNumber"), F.col("n").alias("sourcePage"),
        F.struct(F.col("name").alias("full_name"), F.col("phone")).alias("data"),
        F.when(F.col("flag") == "R", cell).otherwise(F.array().cast("array<struct<fieldKey:string,rawValue:string,confidence:double>>")).alias("values"),
        F.col("n").alias("_n"),
    )
    grouped = _lines(spark, sf).groupBy("order").agg(F.sort_array(F.collect_list(F.struct("n", row.alias("row")))).alias("rows"))
    body = F.struct(F.lit("reader").alias("providerName"), F.transform("rows", lambda r: r["row"]).alias("rows"))
    return grouped.select(F.col("order").cast("string").alias("document_id"), F.to_json(body).alias("response"))


def q_s2(spark, sf):
    rows = layouts.read_ready_rows(_ready_json(spark, sf))
    _, cells = tables.ready_rows(rows, documents(spark, sf), b.template_fields(spark, sf))
    return cells.select("document_id", "_at", "sort_order", "raw_value", "normalized_value", "confidence_pct").withColumnRenamed("_at", "place")


def q_s2_rows(spark, sf):
    rows = layouts.read_ready_rows(_ready_json(spark, sf))
    kept, _ = tables.ready_rows(rows, documents(spark, sf), b.template_fields(spark, sf))
    return kept.select("document_id", "row_number", "source_page", "row_confidence_pct")


def table_words(spark, sf, shift=0.0):
    """A page per order: a header line and one line of words per row."""
    def word(place, text, x, y, width):
        return F.struct(place.cast("int").alias("word"), text.alias("text"), F.lit(float(x) + shift).alias("x"),
                        y.cast("double").alias("y"), F.lit(float(width)).alias("width"))
    y = F.lit(40) + F.col("n") * 30
    body = F.array(*[
        word(F.col("n") * 10 + i, t, x, y + dy, w) for i, (t, x, dy, w) in enumerate((
            (F.lit("Person"), 10, 0, 44), (F.element_at(F.split("name", " "), -1), 58, 2, 36),
            (F.regexp_replace("email", " at mail dot com", "@mail.com"), 160, -1, 90), (F.col("phone"), 330, 1, 50)))
    ])
    head = F.array(*[
        word(F.lit(i), F.lit(t), x, F.lit(10), w) for i, (t, x, w) in enumerate((
            ("Full", 10, 40), ("Name", 54, 40), ("Email", 160, 42), ("Address", 206, 50), ("Phone", 330, 50)))
    ])
    lines = _lines(spark, sf)
    words = lines.select(F.col("order").cast("string").alias("document_id"), F.explode(body).alias("w")).unionByName(
        lines.select(F.col("order").cast("string").alias("document_id")).distinct().select("document_id", F.explode(head).alias("w"))
    )
    return words.select("document_id", F.lit(1).alias("page"), "w.*", F.lit(12.0).alias("height"), F.lit(95).alias("confidence_pct"))


def _word_result(cells):
    return cells.select("document_id", "output_row", "sort_order", "normalized_value", "confidence_pct")


def q_l2_nested(spark, sf):
    return _word_result(word_tables.word_table_rows(table_words(spark, sf), documents(spark, sf), b.template_fields(spark, sf), "nested"))


def q_l2_grid(spark, sf):
    return _word_result(word_tables.word_table_rows(table_words(spark, sf, 30.0), documents(spark, sf), b.template_fields(spark, sf), "grid"))


def form_words(spark, sf, one_per_page=False):
    """A page per order with one short form per line of the order, or a page per line."""
    document = F.col("order").cast("string")
    if one_per_page:
        document = F.concat_ws("-", document, F.col("n").cast("string"))
    def word(place, text, x, y, width):
        return F.struct((F.col("n") * 10 + place).cast("int").alias("word"), text.alias("text"), F.lit(float(x)).alias("x"),
                        (F.col("n") * 250 + y).cast("double").alias("y"), F.lit(float(width)).alias("width"))
    form = F.array(
        word(0, F.lit("Full"), 32, 0, 30), word(1, F.lit("Name:"), 66, 0, 40), word(2, F.lit("Person"), 160, 0, 44),
        word(3, F.element_at(F.split("name", " "), -1), 210, 0, 36), word(4, F.lit("Email"), 32, 38, 42),
        word(5, F.regexp_replace("email", " at mail dot com", "@mail.com"), 160, 38, 90), word(6, F.lit("Phone"), 32, 76, 44),
        word(7, F.col("phone"), 160, 76, 80),
    )
    return _lines(spark, sf).select(document.alias("document_id"), F.explode(form).alias("w")).select(
        "document_id", F.lit(1).alias("page"), "w.*", F.lit(18.0).alias("height"), F.lit(95).alias("confidence_pct"))


def q_l4_grid(spark, sf):
    return _word_result(word_forms.grid_form_rows(form_words(spark, sf), documents(spark, sf), b.template_fields(spark, sf)))


def q_l4_nested(spark, sf):
    pages = _lines(spark, sf).select(
        F.concat_ws("-", F.col("order").cast("string"), F.col("n").cast("string")).alias("document_id"),
        b.template_of(spark, sf, F.col("order")).alias("template_id"))
    return _word_result(word_forms.nested_form_rows(form_words(spark, sf, True), pages, b.template_fields(spark, sf)))


def _spots(spark, sf):
    """Words at heights given by quantities; page = order, all of them."""
    return b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.lit(1).alias("page"),
        F.xxhash64(*[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")]).alias("word"),
        F.col("l_returnflag").alias("text"), (F.col("l_partkey") % 600).cast("double").alias("x"),
        (F.col("l_quantity") * 4).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"),
    )


def q_w7(spark, sf):
    lined = geometry.with_lines(_spots(spark, sf), "grid")
    return lined.groupBy("document_id", "line_no").agg(
        F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("words"))


def q_w7_long_page(spark, sf):
    """One page that holds a third of all words and is many bands tall."""
    hot = F.col("l_orderkey") % 3 == 0
    words = b.table(spark, sf, "lineitem").select(
        F.when(hot, F.lit("hot")).otherwise(F.col("l_orderkey").cast("string")).alias("document_id"), F.lit(1).alias("page"),
        F.xxhash64(*[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")]).alias("word"),
        F.lit("w").alias("text"), F.lit(1.0).alias("x"),
        (F.col("l_orderkey") * 5 + F.col("l_quantity")).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"),
    )
    return geometry.with_lines(words, "grid").groupBy("document_id", "line_no").agg(F.min("y").alias("top"), F.count("*").alias("words"))


def q_j7(spark, sf):
    xs = [40.0, 180.0, 300.0, 460.0]
    places = F.array(*[F.lit(x) for x in xs])
    columns = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(f"c{i}").alias("field_id"), F.lit(x).alias("x"),
                 geometry.column_limit(F.lit(x), places, "grid").alias("limit")) for i, x in enumerate(xs)
    ])
    return b.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 600).cast("double").alias("x")
    ).withColumn("columns", columns).select(
        "x", geometry.nearest_column(F.col("x") + 10, F.col("columns")).alias("column")
    ).groupBy("x", "column").agg(F.count("*").alias("words"))


def q_a16(spark, sf):
    words = b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("document_id"), F.lit(1).alias("page"), (F.col("l_quantity") / 2).alias("height"))
    grid = geometry.page_tolerance(words, "grid").withColumnRenamed("_tolerance", "grid_tolerance")
    nested = geometry.page_tolerance(words, "nested").withColumnRenamed("_tolerance", "nested_tolerance")
    return grid.join(nested, ["document_id", "page"]).drop("page")


def q_w5(spark, sf):
    rows = b.table(spark, sf, "part").select(
        F.col("p_brand").alias("document_id"), "p_partkey",
        F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lower("p_type"), F.lit("_2"))).otherwise(F.lower("p_type")).alias("base"),
    )
    taken = F.array(F.lit("promo"), F.lit("small_3"), F.lit("other"))
    keyed = matching.dedupe_keys(rows, ["document_id"], "base", taken, [F.col("p_partkey")],
                                 F.call_function("div", F.col("p_partkey"), F.lit(64)))
    return keyed.select("document_id", "p_partkey", "base", "unique_key")


def q_w6(spark, sf):
    rows = b.table(spark, sf, "part").select(
        F.col("p_brand").alias("document_id"), (F.col("p_partkey") % 5).cast("string").alias("template_id"),
        F.lower(F.col("p_type")).alias("key"), F.col("p_partkey").alias("position"))
    fields = b.table(spark, sf, "nation").select(
        (F.col("n_nationkey") % 5).cast("string").alias("template_id"), F.lit("promo").alias("key")).distinct()
    return matching.dedupe_suggestions(rows, fields, [F.col("position")])


def q_w2(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("document_id"),
        (F.col("l_partkey") % 40).alias("page"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_number"),
    ).distinct()
    return tables.merge_pages(rows)


QUERIES = {
    "s2_ready_cells": q_s2, "s2_ready_rows": q_s2_rows, "s3_cell_tables": q_s3, "s4_anchor_tables": q_s4,
    "s5_block_tables": q_s5, "s6_word_boxes": q_s6, "s7_listed_pairs": q_s7, "l1_table_cells": q_l1,
    "l1_table_rows": q_l1_rows, "l2_nested_word_tables": q_l2_nested, "l2_grid_word_tables": q_l2_grid,
    "l3_pair_forms": q_l3, "l4_grid_forms": q_l4_grid, "l4_nested_forms": q_l4_nested, "w9_carried_headers": q_w9,
    "w4_column_mapping": q_w4, "x2_suggested_fields": q_x2, "a13_sample_values": q_a13, "a14_column_types": q_a14,
    "x4_known_domain": q_x4, "j5_match_headers": q_j5, "n7_match_score": q_n7, "w7_word_lines": q_w7,
    "w7_long_page_lines": q_w7_long_page, "j7_nearest_column": q_j7, "a16_page_tolerance": q_a16, "w5_unique_keys": q_w5, "w6_first_suggestions": q_w6, "w2_document_rows": q_w2,
}

LINES = """lines AS (SELECT l_orderkey AS ord, l_linenumber AS n, 'Person ' || l_partkey AS name, l_partkey, l_suppkey,
    'u' || l_suppkey || ' at mail dot com' AS email, 'O8O1234' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS phone,
    strftime(l_shipdate, '%d/%m/%Y') AS day, l_shipdate, l_linestatus AS status, l_returnflag AS flag
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1)"""
HEAD_SQL = ", ".join(f"({c}, '{t.rstrip(':')}')" for c, t in HEADERS.items())
CLEAN_HEAD = HEAD_SQL.replace("line  status", "line status")
VALUES = "[(0, name), (1, email), (2, phone), (3, day), (8, status), (9, flag)]"


def _filled(found: int, blank: str):
    """Expected cells of every row: three fields are found with this structure confidence, five are blank."""
    return f"""WITH {LINES}, x AS (SELECT ord, n, sort_order, required, CASE sort_order WHEN 1 THEN name WHEN 2 THEN 'u' || l_suppkey || '@mail.com'
          WHEN 3 THEN '0801234' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') WHEN 5 THEN 'false' ELSE '' END AS value
        FROM lines JOIN v_template_fields ON template_id = CAST(ord % {TEMPLATES} AS VARCHAR))
      SELECT CAST(ord AS VARCHAR) AS document_id, {{row}} AS output_row, sort_order, value AS normalized_value,
        CAST(CASE WHEN sort_order IN (1, 3) THEN (90*72+{found}*28+50)//100 WHEN sort_order = 2 THEN (94*72+{found}*28+50)//100 ELSE {blank} END AS INTEGER) AS confidence_pct
      FROM x"""


def _blank(structure: int) -> str:
    return f"CASE WHEN required THEN least(68, (34*72+{structure}*28+50)//100) ELSE (68*72+{structure}*28+50)//100 END"


TEMPLATES = "(SELECT count(*) // 8 FROM part)"
RANK = "CAST(row_number() OVER (PARTITION BY ord, sort_order ORDER BY n) AS INTEGER)"
ORACLE = {
    "s3_cell_tables": f"""WITH {LINES}, heads(c, t) AS (VALUES {CLEAN_HEAD}),
      v AS (SELECT ord, n, unnest([0,1,2,3,8,9]) AS c, unnest([name, email, phone, day, status, flag]) AS t FROM lines)
      SELECT CAST(ord AS VARCHAR) AS document_id, 0 AS table_index, 0 AS row_index, c AS column_index, true AS is_header, t AS text, 1 AS page, 4.0::DOUBLE AS width
      FROM (SELECT DISTINCT ord FROM lines), heads
      UNION ALL
      SELECT CAST(ord AS VARCHAR), CASE WHEN n <= 4 THEN 0 ELSE 1 END, CASE WHEN n <= 4 THEN n ELSE n - 5 END, c, false, t,
        CASE WHEN n <= 4 THEN 1 ELSE 2 END, 4.0::DOUBLE FROM v""",
    "l1_table_cells": f"""WITH {LINES}, f AS (SELECT CAST(template_id AS INTEGER) AS t, sort_order, type, required FROM v_template_fields),
      x AS (SELECT ord, n, sort_order, required, row_number() OVER (PARTITION BY ord, sort_order ORDER BY n) AS r,
        CASE sort_order WHEN 1 THEN name WHEN 2 THEN 'u' || l_suppkey || '@mail.com' WHEN 3 THEN '0801234' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0')
          WHEN 4 THEN '' WHEN 5 THEN 'false' WHEN 7 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS value,
        CASE sort_order WHEN 1 THEN 90 WHEN 2 THEN 94 WHEN 3 THEN 90 WHEN 7 THEN 90 ELSE CASE WHEN required THEN 34 ELSE 68 END END AS v,
        CASE sort_order WHEN 1 THEN 72 WHEN 2 THEN 96 WHEN 3 THEN 90 WHEN 7 THEN 96 ELSE 58 END AS s
      FROM lines JOIN f ON f.t = ord % (SELECT count(*) // 8 FROM part))
      SELECT CAST(ord AS VARCHAR) AS document_id, CAST(r AS INTEGER) AS output_row, CASE WHEN n <= 4 THEN 1 ELSE 2 END AS source_page,
        sort_order, value AS normalized_value,
        CAST(CASE WHEN value IN ('', 'false') AND required THEN least(68, (v * 72 + s * 28 + 50) // 100) ELSE (v * 72 + s * 28 + 50) // 100 END AS INTEGER) AS confidence_pct,
        CASE WHEN value IN ('', 'false') AND required THEN 'missing_required' ELSE '' END AS issues FROM x""",
    "w9_carried_headers": f"""WITH {LINES} SELECT DISTINCT CAST(ord AS VARCHAR) AS document_id, 0 AS table_index, 0 AS header_row, 0 AS header_table FROM lines
      UNION ALL SELECT DISTINCT CAST(ord AS VARCHAR), 1, NULL, 0 FROM lines WHERE n > 4""",
    "w4_column_mapping": """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, f AS sort_order,
        CAST([0, 1, 2, 4, 5, 6, 3, 7][f] AS INTEGER) AS column_index, CAST([11, 0, 4, NULL, NULL, NULL, 0, NULL][f] AS INTEGER) AS score,
        CAST([72, 96, 90, 58, 58, 58, 96, 58][f] AS INTEGER) AS structure_pct
      FROM orders, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS f) WHERE (o_orderkey % (SELECT count(*) // 8 FROM part)) * 8 <= (SELECT max(p_partkey) FROM part)""",
    "x2_suggested_fields": f"""WITH {LINES}, v AS (SELECT ord, n, unnest([8, 9]) AS c, unnest([status, flag]) AS t FROM lines),
      g AS (SELECT ord, c, string_agg(t, ',' ORDER BY p) AS samples, count(*) AS k FROM (SELECT ord, c, t, min(n) AS p FROM v GROUP BY ALL) GROUP BY ALL)
      SELECT CAST(ord AS VARCHAR) AS document_id, 'Line Status' AS label, CASE c WHEN 8 THEN 'line_status' ELSE 'line_status_2' END AS key,
        CASE WHEN k > 1 THEN 'select' ELSE 'text' END AS type, CASE WHEN k > 1 THEN samples ELSE '' END AS options, samples FROM g""",
    "a13_sample_values": """WITH f AS (SELECT l_suppkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS t,
        min((l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))) AS p FROM lineitem GROUP BY ALL)
      SELECT l_suppkey, string_agg(t, ',' ORDER BY p) AS samples FROM (SELECT * FROM f
        QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY p) <= 8) GROUP BY l_suppkey""",
    "a14_column_types": r"""WITH v AS (SELECT p_partkey // 3 AS "column", CASE WHEN p_partkey % 7 = 0 THEN 'a@b.' || p_name
          WHEN p_size % 5 = 0 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS t FROM part)
      SELECT "column", CASE WHEN bool_and(regexp_matches(t, '^-?[0-9]+(\.[0-9]+)?$')) THEN 'number'
        WHEN bool_and(regexp_matches(t, '^[^\s@]+@[^\s@]+\.[^\s@]+$')) THEN 'email'
        WHEN count(DISTINCT lower(t)) BETWEEN 2 AND 8 THEN 'select' ELSE 'text' END AS type FROM v GROUP BY "column" """,
    "x4_known_domain": "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS known FROM part",
    "w7_word_lines": """WITH d AS (SELECT DISTINCT l_orderkey, l_quantity * 4 AS y FROM lineitem),
      s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY y) <= 6.5 THEN 0 ELSE 1 END AS st FROM d),
      g AS (SELECT *, sum(st) OVER (PARTITION BY l_orderkey ORDER BY y) AS line FROM s)
      SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(line AS INTEGER) AS line_no, min(y) AS top, max(y) AS bottom, count(*) AS words
      FROM g JOIN lineitem l USING (l_orderkey) WHERE l.l_quantity * 4 = y GROUP BY ALL""",
    "w7_long_page_lines": """WITH l AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey AS VARCHAR) END AS document_id,
        l_orderkey * 5 + l_quantity AS y FROM lineitem), d AS (SELECT DISTINCT * FROM l),
      s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY document_id ORDER BY y) <= 6.5 THEN 0 ELSE 1 END AS st FROM d),
      g AS (SELECT *, sum(st) OVER (PARTITION BY document_id ORDER BY y) AS line FROM s)
      SELECT document_id, CAST(line AS INTEGER) AS line_no, min(y) AS top, count(*) AS words FROM g JOIN l USING (document_id, y) GROUP BY document_id, line""",
    "j7_nearest_column": """WITH w AS (SELECT CAST(l_partkey % 600 AS DOUBLE) AS x FROM lineitem),
      c(i, cx, lim) AS (VALUES (0, 40.0, 77.0), (1, 180.0, 66.0), (2, 300.0, 66.0), (3, 460.0, 88.0)),
      b AS (SELECT x, arg_min(CASE WHEN abs(x + 10 - cx) <= lim THEN 'c' || i ELSE '' END, (abs(x + 10 - cx), i)) AS hit
        FROM (SELECT DISTINCT x FROM w), c GROUP BY x)
      SELECT x, nullif(hit, '') AS "column", count(*) AS words FROM w JOIN b USING (x) GROUP BY ALL""",
    "a16_page_tolerance": """SELECT l_suppkey AS document_id, least(18.0, greatest(6.0, median(h) * 0.65)) AS grid_tolerance,
        greatest(8.0, list_sort(list(h))[count(*) // 2 + 1] * 0.75) AS nested_tolerance
      FROM (SELECT l_suppkey, l_quantity / 2 AS h FROM lineitem) GROUP BY l_suppkey""",
    "w5_unique_keys": r"""WITH r AS (SELECT p_brand AS document_id, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN lower(p_type) || '_2' ELSE lower(p_type) END AS base FROM part),
      used(stem, number) AS (VALUES ('promo', 1), ('small', 3), ('other', 1)),
      blocked AS (SELECT document_id, stem, number FROM (SELECT DISTINCT document_id FROM r), used
        UNION SELECT document_id, regexp_extract(base, '^(.+)_([0-9]+)$', 1), CAST(regexp_extract(base, '^(.+)_([0-9]+)$', 2) AS INTEGER) FROM r WHERE base LIKE '%\_2' ESCAPE '\'),
      n AS (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY p_partkey) AS nth FROM r),
      b AS (SELECT document_id, stem AS base, list(DISTINCT number) AS numbers FROM blocked GROUP BY ALL),
      k AS (SELECT n.*, list_filter(range(1, nth + 5), lambda x: NOT list_contains(coalesce(numbers, []::INTEGER[]), CAST(x AS INTEGER)))[nth] AS number FROM n LEFT JOIN b USING (document_id, base))
      SELECT document_id, p_partkey, base, CASE WHEN number = 1 THEN base ELSE base || '_' || number END AS unique_key FROM k""",
    "w6_first_suggestions": """SELECT p_brand AS document_id, CAST(p_partkey % 5 AS VARCHAR) AS template_id, lower(p_type) AS key, min(p_partkey) AS position
      FROM part WHERE p_type <> 'PROMO' GROUP BY ALL""",
    "w2_document_rows": """SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, row_number) AS document_row FROM (
      SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END AS document_id, l_partkey % 40 AS page,
        l_orderkey * 8 + l_linenumber AS row_number FROM lineitem)""",
    "s7_listed_pairs": """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS item,
        unnest(['E-mail', 'Attendance date', 'Full Name', 'Zebra']) AS key,
        unnest(['k' || o_custkey || ' [at] x dot org', strftime(o_orderdate, '%Y/%-m/%-d'), 'Customer ' || o_custkey, o_orderstatus]) AS value,
        74 AS confidence_pct FROM orders""",
    "l3_pair_forms": b.sql(
        """, x AS (SELECT o_orderkey, sort_order, required, CASE sort_order WHEN 1 THEN 'Customer ' || o_custkey WHEN 2 THEN 'k' || o_custkey || '@x.org'
            WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 5 THEN 'false' ELSE '' END AS value,
          CASE sort_order WHEN 1 THEN 90 WHEN 2 THEN 94 WHEN 7 THEN 90 ELSE CASE WHEN required THEN 34 ELSE 68 END END AS v,
          CASE WHEN sort_order IN (1, 2, 7) THEN 74 ELSE 62 END AS s
        FROM orders JOIN v_template_fields ON template_id = CAST(o_orderkey % (SELECT count(*) // 8 FROM part) AS VARCHAR))
        SELECT CAST(o_orderkey AS VARCHAR) AS document_id, sort_order, value AS normalized_value,
          CAST((v * 72 + s * 28 + 50) // 100 AS INTEGER) AS confidence_pct FROM x""", "v_template_fields"),
    "s4_anchor_tables": """SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(r AS INTEGER) AS row_index, CAST(c AS INTEGER) AS column_index, r = 0 AS is_header,
        CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'Full Name' ELSE 'Email' END WHEN c = 0 THEN 'Zoé ' || c_custkey ELSE 'z' || c_custkey || '@x.org' END AS text, 2 AS page
      FROM customer, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c)""",
    "s5_block_tables": f"""WITH {LINES} SELECT CAST(ord AS VARCHAR) AS document_id, CAST(n + 1 AS INTEGER) AS row_index, CAST(c AS INTEGER) AS column_index, false AS is_header,
        CASE WHEN c = 1 THEN name WHEN flag = 'R' THEN 'X ' || status ELSE status END AS text, CAST(CASE WHEN c = 1 THEN 88 END AS INTEGER) AS provider_pct, 3 AS page
      FROM lines, (SELECT unnest([1, 2]) AS c)
      UNION ALL SELECT DISTINCT CAST(ord AS VARCHAR), 1, c, true, CASE c WHEN 1 THEN 'Full Name' ELSE 'Signature' END, NULL, 3 FROM lines, (SELECT unnest([1, 2]) AS c)""",
    "s6_word_boxes": """WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1)
      SELECT CAST(l_orderkey AS VARCHAR) AS document_id, 1 AS page, 'W' || l_returnflag AS text, CAST(l_partkey % 500 AS DOUBLE) AS x, l_quantity AS y,
        12.0::DOUBLE AS width, 8.0::DOUBLE AS height, CAST(l_linenumber * 10 AS INTEGER) AS confidence_pct FROM l""",
    "s2_ready_cells": f"""WITH {LINES}, x AS (SELECT ord, n, sort_order, required, flag, l_suppkey, name, phone,
        CASE sort_order WHEN 1 THEN name WHEN 2 THEN CASE WHEN flag = 'R' THEN email ELSE '' END WHEN 3 THEN phone ELSE '' END AS raw
      FROM lines JOIN v_template_fields ON template_id = CAST(ord % {TEMPLATES} AS VARCHAR))
      SELECT CAST(ord AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY ord, sort_order ORDER BY n) - 1 AS INTEGER) AS place,
        sort_order, raw AS raw_value,
        CASE sort_order WHEN 2 THEN CASE WHEN flag = 'R' THEN 'u' || l_suppkey || '@mail.com' ELSE '' END
          WHEN 3 THEN '0801234' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') WHEN 5 THEN 'false' ELSE raw END AS normalized_value,
        CAST(CASE WHEN sort_order IN (1, 3) THEN 90 WHEN sort_order = 2 AND flag = 'R' THEN 78 WHEN required THEN 34 ELSE 68 END AS INTEGER) AS confidence_pct
      FROM x""",
    "s2_ready_rows": f"""WITH {LINES}, r AS (SELECT ord, n, flag, row_number() OVER (PARTITION BY ord ORDER BY n) AS at FROM lines)
      SELECT CAST(ord AS VARCHAR) AS document_id, CAST(CASE WHEN n > 2 THEN n * 10 ELSE any_value(r.at) END AS INTEGER) AS row_number, n AS source_page,
        CAST((2 * sum(CASE WHEN sort_order IN (1, 3) THEN 90 WHEN sort_order = 2 AND flag = 'R' THEN 78 WHEN required THEN 34 ELSE 68 END) + 8) // 16 AS BIGINT) AS row_confidence_pct
      FROM r JOIN v_template_fields ON template_id = CAST(ord % {TEMPLATES} AS VARCHAR) GROUP BY ord, n""",
    "l2_nested_word_tables": _filled(96, _blank(58)).replace("{row}", RANK),
    "l2_grid_word_tables": _filled(96, _blank(62)).replace("{row}", RANK),
    "l4_grid_forms": _filled(96, "CASE WHEN required THEN 34 ELSE 50 END").replace("{row}", RANK),
    # simple forms take no label away from another field: `Name` is two edits from `date`, so the date reads the name
    "l4_nested_forms": _filled(96, f"CASE sort_order WHEN 7 THEN (40*72+72*28+50)//100 ELSE {_blank(56)} END").replace("{row}", "1").replace(
        "SELECT CAST(ord AS VARCHAR) AS document_id", "SELECT ord || '-' || n AS document_id").replace("WHEN 1 THEN name", "WHEN 1 THEN name WHEN 7 THEN name"),
}
for _name in ("l1_table_cells", "s2_ready_cells", "s2_ready_rows", "l2_nested_word_tables", "l2_grid_word_tables", "l4_grid_forms", "l4_nested_forms"):
    ORACLE[_name] = ORACLE[_name].replace("WITH lines AS", f"WITH v_template_fields AS ({b.VIEWS['v_template_fields']}), lines AS", 1)

ORACLE["l1_table_rows"] = f"""SELECT document_id, CAST(output_row AS BIGINT) AS row_number, output_row, source_page,
  CAST((2 * sum(confidence_pct) + count(*)) // (2 * count(*)) AS BIGINT) AS row_confidence_pct FROM ({ORACLE["l1_table_cells"]}) GROUP BY ALL"""

_TERM = "regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', '', 'g')"
_SCORE = """CASE WHEN a = t THEN 0
    WHEN least(length(a), length(t)) >= 3 AND (contains(a, t) OR contains(t, a)) THEN abs(length(a) - length(t)) + 2
    WHEN levenshtein(a, t) <= greatest(2, greatest(length(a), length(t)) * 22 // 100) AND levenshtein(a, t) < least(length(a), length(t))
      THEN levenshtein(a, t) + 10 END"""
_NOISY = """CASE WHEN length(regexp_replace({0}, '[^a-z]', '', 'g')) > 0
  AND length(regexp_replace({0}, '[a-z]', '', 'g')) <= length(regexp_replace({0}, '[^a-z]', '', 'g'))
  THEN translate({0}, '012568', 'oizsgb') ELSE {0} END"""


def _groups() -> str:
    from tallysheet.functions.scoring import COMMON_TERMS
    return ", ".join(f"({list(t)}, {[n.replace(' ', '') for n in names]})" for t, names in COMMON_TERMS)


ORACLE["j5_match_headers"] = b.sql(
    f""", g(triggers, names) AS (VALUES {_groups()}),
    own AS (SELECT template_id, field_id, unnest([{_TERM.format('key')}, {_TERM.format('label')}]) AS t FROM v_template_fields),
    more AS (SELECT DISTINCT template_id, field_id, unnest(names) AS t FROM (
      SELECT DISTINCT template_id, field_id, names FROM own, g WHERE len(list_filter(triggers, lambda x: contains(own.t, x))) > 0)),
    base AS (SELECT * FROM own WHERE length(t) >= 2 UNION SELECT * FROM more),
    terms AS (SELECT template_id, field_id, t FROM base UNION SELECT template_id, field_id, {_NOISY.format('t')} FROM base),
    heads AS (SELECT field_id AS header_id, template_id, {_TERM.format("h")} AS t FROM (
      SELECT *, CASE CAST(field_id AS BIGINT) % 5 WHEN 0 THEN translate(label, 'oisl', '0151') WHEN 1 THEN left(label, length(label) - 1)
        WHEN 2 THEN label || ' no.' WHEN 3 THEN 'E mail' ELSE reverse(label) END AS h FROM v_template_fields)),
    tried AS (SELECT header_id, template_id, t AS a FROM heads UNION SELECT header_id, template_id, {_NOISY.format('t')} FROM heads)
    SELECT header_id, field_id, CAST(min(score) AS INTEGER) AS score FROM (
      SELECT header_id, field_id, {_SCORE} AS score FROM tried JOIN terms USING (template_id) WHERE a <> '' AND t <> '')
    GROUP BY ALL HAVING min(score) <= 14""", "v_template_fields")
ORACLE["n7_match_score"] = f"""WITH p AS (SELECT p_partkey, {_TERM.format('p_name')} AS a, {_TERM.format("('red ' || string_split(p_name, ' ')[-1])")} AS t FROM part),
  s AS (SELECT p_partkey, CAST({_SCORE} AS INTEGER) AS score FROM p)
  SELECT p_partkey, score, CAST(CASE WHEN score = 0 THEN 96 WHEN score <= 4 THEN 90 WHEN score <= 8 THEN 82 ELSE 72 END AS INTEGER) AS confidence_pct FROM s"""


def q_x3(spark, sf):
    """Columns of the parts, most with far more than eight values; one in five ends in a value of another kind."""
    column, size = F.col("p_partkey") % 35, F.col("p_size").cast("string")
    odd = (F.col("p_partkey") > 105) & (column % 5 == 4)
    text = (
        F.when(odd, "odd one").when(column % 7 < 2, size).when(column % 7 == 2, F.concat(size, F.lit("@example.org")))
        .when(column % 7 < 5, F.split("p_name", " ")[0]).when(column % 7 == 5, (F.col("p_size") % 8).cast("string"))
        .otherwise(F.concat(F.lit("kind "), (F.col("p_size") % 8).cast("string")))
    )
    values = b.table(spark, sf, "part").select(column.alias("column"), "p_partkey", text.alias("text"))
    found = discovery.describe_columns(values, ["column"], ["p_partkey"])
    return found.select("column", "type", F.array_join("options", ",").alias("options"), F.array_join("samples", ",").alias("samples"))


def q_w3(spark, sf):
    found = q_j5(spark, sf)
    return matching.best_per_field(found, ["field_id"], [F.col("score"), F.col("header_id")])


def q_j6(spark, sf):
    matched = matching.match_pairs(
        layouts.read_listed_pairs(_pairs_json(spark, sf)), documents(spark, sf), b.template_fields(spark, sf))
    return matched.select("document_id", "sort_order", "item", "score")


def q_j8(spark, sf):
    graph = layouts.blocks(_block_json(spark, sf))
    return layouts.block_links(graph, "child_ids", "child_id").filter(F.col("block_id") != "t").select(
        "document_id", "block_id", "at", "child_id")


def q_p7(spark, sf):
    """Rows of each supplier's lineitems: blank unless the flag is R; five rows kept where so many are asked for, else all."""
    cells = b._first_lines(spark, sf).select(
        F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_orderkey").alias("line"),
        F.col("l_linenumber").alias("field_id"), F.col("l_partkey").alias("_p"),
        F.when(F.col("l_returnflag") == "R", "R").otherwise("").alias("normalized_value"),
        F.lit("string").alias("value_kind"), (F.col("l_linenumber") * 10).alias("confidence_pct"),
        F.lit(None).cast("int").alias("page"),
    )
    documents_ = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("document_id"),
        F.when(F.col("s_suppkey") % 2 == 0, 5).alias("row_count"), F.lit(1).alias("page_start"))
    kept = tables.keep_filled_rows(cells, documents_, ["line"])
    return kept.select("document_id", "line", "output_row", "row_confidence_pct").distinct()


QUERIES.update({
    "x3_infer_type": q_x3, "w3_best_match": q_w3, "j6_match_pairs": q_j6, "j8_block_links": q_j8,
    "p7_filled_rows": q_p7,
})
ORACLE["x3_infer_type"] = r"""WITH v AS (SELECT p_partkey, p_partkey % 35 AS "column",
    CASE WHEN p_partkey > 105 AND p_partkey % 35 % 5 = 4 THEN 'odd one' WHEN p_partkey % 35 % 7 < 2 THEN CAST(p_size AS VARCHAR)
      WHEN p_partkey % 35 % 7 = 2 THEN p_size || '@example.org' WHEN p_partkey % 35 % 7 < 5 THEN string_split(p_name, ' ')[1]
      WHEN p_partkey % 35 % 7 = 5 THEN CAST(p_size % 8 AS VARCHAR) ELSE 'kind ' || (p_size % 8) END AS t FROM part),
  d AS (SELECT "column", t, min(p_partkey) AS p FROM v GROUP BY ALL),
  k AS (SELECT "column", CASE WHEN bool_and(regexp_matches(t, '^-?[0-9]+(\.[0-9]+)?$')) THEN 'number'
      WHEN bool_and(regexp_matches(t, '^[^\s@]+@[^\s@]+\.[^\s@]+$')) THEN 'email'
      WHEN count(DISTINCT lower(t)) BETWEEN 2 AND 8 THEN 'select' ELSE 'text' END AS type,
      string_agg(t, ',' ORDER BY p) AS every FROM d GROUP BY ALL),
  s AS (SELECT "column", string_agg(t, ',' ORDER BY p) AS samples FROM (
      SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY p) <= 8) GROUP BY ALL)
  SELECT "column", type, CASE WHEN type = 'select' THEN every ELSE '' END AS options, samples FROM k JOIN s USING ("column")"""
ORACLE["w3_best_match"] = (
    f"SELECT field_id, arg_min(header_id, (score, header_id)) AS header_id, min(score) AS score "
    f"FROM ({ORACLE['j5_match_headers']}) GROUP BY field_id"
)
ORACLE["j6_match_pairs"] = b.sql(
    """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, sort_order,
      CAST(CASE sort_order WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 7 THEN 1 END AS INTEGER) AS item,
      CAST(CASE sort_order WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 7 THEN 0 END AS INTEGER) AS score
    FROM orders JOIN v_template_fields ON template_id = CAST(o_orderkey % (SELECT count(*) // 8 FROM part) AS VARCHAR)""", "v_template_fields")
ORACLE["j8_block_links"] = f"""WITH {LINES}
  SELECT CAST(ord AS VARCHAR) AS document_id, p || n AS block_id, CAST(i AS INTEGER) AS at, c || n AS child_id
  FROM lines, (VALUES ('a', 0, 'w'), ('a', 1, 'v'), ('b', 0, 's'), ('b', 1, 'e')) x(p, i, c)"""
ORACLE["p7_filled_rows"] = b.sql(
    """, r AS (SELECT l_suppkey, l_orderkey, bool_or(l_returnflag = 'R') AS filled,
        (2 * sum(l_linenumber * 10) + count(*)) // (2 * count(*)) AS conf FROM v_lines GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n FROM r WHERE filled)
    SELECT CAST(l_suppkey AS VARCHAR) AS document_id, l_orderkey AS line, CAST(n AS INTEGER) AS output_row,
      CAST(conf AS BIGINT) AS row_confidence_pct
    FROM k WHERE l_suppkey % 2 = 1 OR n <= 5""", "v_lines")
