"""Layout responses as tables of cells, pairs, words or ready rows.

Every reader takes `responses` with document_id and a JSON text column. A response that
is not a JSON object gives no rows; `response_errors` lists those documents for S16.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.numeric import hundredths
from tallysheet.functions.text import clean_text
from tallysheet.operators.geometry import let

DEFAULT_PAIR_PCT = 74
DEFAULT_WORD_PCT = 82
DEFAULT_FLAT_WORD_PCT = 72

#: Blocks of a response in one list of its index by id; larger responses have more lists.
INDEX_LIST = 512

_POINT = "struct<x:double,y:double>"
CELL_TABLES = (
    "analyzeResult struct<"
    "tables:array<struct<cells:array<struct<kind:string,rowIndex:int,columnIndex:int,content:string,"
    "confidence:double,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>>>,"
    "keyValuePairs:array<struct<key:struct<content:string>,"
    "value:struct<content:string,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>,"
    "confidence:double>>>"
)
_LAYOUT = (
    "struct<layout:struct<textAnchor:struct<content:string,"
    "textSegments:array<struct<startIndex:string,endIndex:string>>>,confidence:double,"
    f"boundingPoly:struct<normalizedVertices:array<{_POINT}>,vertices:array<{_POINT}>>>>"
)
ANCHOR_TABLES = (
    "document struct<text:string,pages:array<struct<pageNumber:int,"
    f"tables:array<struct<headerRows:array<struct<cells:array<{_LAYOUT}>>>,"
    f"bodyRows:array<struct<cells:array<{_LAYOUT}>>>>>,"
    f"formFields:array<struct<fieldName:{_LAYOUT},fieldValue:{_LAYOUT}>>>>,"
    "entities:array<struct<type:string,mentionText:string,confidence:double,"
    "pageAnchor:struct<pageRefs:array<struct<page:string>>>>>>"
)
BLOCKS = (
    "Blocks array<struct<Id:string,BlockType:string,Text:string,Confidence:double,Page:int,"
    "RowIndex:int,ColumnIndex:int,EntityTypes:array<string>,SelectionStatus:string,"
    "Relationships:array<struct<Type:string,Ids:array<string>>>,"
    "Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>>>"
)
_POLY = f"struct<normalizedVertices:array<{_POINT}>,vertices:array<{_POINT}>>"
WORD_PAGES = (
    "responses array<struct<fullTextAnnotation:struct<pages:array<struct<width:double,height:double,"
    "blocks:array<struct<paragraphs:array<struct<words:array<struct<symbols:array<struct<text:string>>,"
    f"boundingBox:{_POLY},confidence:double>>>>>>>>>,"
    f"textAnnotations:array<struct<description:string,boundingPoly:{_POLY},score:double>>>>"
)
READY_ROWS = (
    "providerName string, rows array<struct<rowNumber:int,sourcePage:int,confidenceScore:double,"
    "data:map<string,string>,values:array<struct<fieldKey:string,key:string,rawValue:string,"
    "normalizedValue:string,confidence:double,issues:array<string>,validationIssues:array<string>>>>>,"
    "suggestedFields array<struct<label:string,key:string,type:string,aliases:array<string>,"
    "options:array<string>,sampleValues:array<string>,confidence:double>>"
)
BOX = "struct<page:int,x:double,y:double,width:double,height:double,normalized:boolean>"


def _parsed(responses: DataFrame, schema: str, json: str) -> DataFrame:
    return responses.select("document_id", F.from_json(json, schema).alias("r"))


def _each(exploded: DataFrame, place: str) -> DataFrame:
    """The entries of an outer explode. A plain one has Spark infer a filter that computes the list, here a
    whole parsed response, once more."""
    return exploded.filter(F.col(place).isNotNull())


def response_errors(responses: DataFrame, json: str = "response") -> DataFrame:
    """S16 input: every document with `error` set where its response is not a JSON object."""
    shape = F.schema_of_variant(F.try_parse_json(F.col(json)))
    return responses.withColumn(
        "error",
        F.when(shape.isNull(), F.lit("The layout response is not valid JSON."))
        .when(~shape.startswith("OBJECT"), F.lit("The layout response is not an object.")),
    )


def provider_pct(confidence: Column, scale: int = 1) -> Column:
    """Provider confidence in hundredths, kept in 5..99; null when absent."""
    pct = hundredths(confidence / scale)
    return F.when(confidence.isNotNull(), F.least(F.lit(99), F.greatest(F.lit(5), pct)).cast("int"))


def _box(page: Column, xs: Column, ys: Column, digits: int, normalized: Column) -> Column:
    left, top = F.array_min(xs), F.array_min(ys)
    return F.when(
        left.isNotNull() & top.isNotNull(),
        F.struct(
            page.cast("int").alias("page"), F.round(left, digits).alias("x"),
            F.round(top, digits).alias("y"), F.round(F.array_max(xs) - left, digits).alias("width"),
            F.round(F.array_max(ys) - top, digits).alias("height"), normalized.alias("normalized"),
        ).cast(BOX),
    )


def polygon_side(numbers: Column, side: int) -> Column:
    """The x (0) or y (1) values of a polygon given as x1, y1, x2, y2, ..; four points are the rule."""
    four = F.array(*[F.get(numbers, F.lit(i)) for i in range(side, 8, 2)])
    return F.when(F.size(numbers) == 8, four).otherwise(F.filter(numbers, lambda n, i: i % 2 == side))


def point_box(page: Column, poly: Column) -> Column:
    """A15 for a list of points, normalized ones first; rounded to four digits."""
    points = F.coalesce(poly["normalizedVertices"], poly["vertices"])
    xs = F.filter(F.transform(points, lambda p: p["x"]), lambda n: n.isNotNull())
    ys = F.filter(F.transform(points, lambda p: p["y"]), lambda n: n.isNotNull())
    return _box(page, xs, ys, 4, poly["normalizedVertices"].isNotNull())


CELL_COLUMNS = (
    "document_id", "table_index", "row_index", "column_index", "is_header", "text",
    "provider_pct", "page", "box",
)


def read_cell_tables(responses: DataFrame, json: str = "response") -> DataFrame:
    """S3: cells with explicit row and column numbers."""
    tables = _each(_parsed(responses, CELL_TABLES, json).select(
        "document_id", F.posexplode_outer("r.analyzeResult.tables").alias("table_index", "t")
    ), "table_index")
    cells = tables.select("document_id", "table_index", F.explode("t.cells").alias("c")).filter(
        F.col("c.rowIndex").isNotNull() & F.col("c.columnIndex").isNotNull()
    ).withColumn("_region", F.get(F.col("c.boundingRegions"), F.lit(0)))
    sides = {name: polygon_side(F.col("_region.polygon"), side) for side, name in enumerate(("_xs", "_ys"))}
    return cells.withColumns(sides).select(
        "document_id", "table_index", F.col("c.rowIndex").alias("row_index"),
        F.col("c.columnIndex").alias("column_index"),
        F.coalesce(F.col("c.kind") == "columnHeader", F.lit(False)).alias("is_header"),
        F.coalesce(clean_text(F.col("c.content")), F.lit("")).alias("text"),
        provider_pct(F.col("c.confidence")).alias("provider_pct"), F.col("_region.pageNumber").alias("page"),
        _box(F.col("_region.pageNumber"), F.col("_xs"), F.col("_ys"), 2, F.lit(False)).alias("box"),  # A15
    )


def _anchored(text: Column, layout: Column) -> Column:
    """Inline content, else the byte ranges of the document text put together."""
    data = F.encode(text, "UTF-8")
    size = F.octet_length(data)

    def piece(s: Column) -> Column:
        begin = F.least(F.coalesce(s["startIndex"].try_cast("int"), F.lit(0)), size)
        end = F.greatest(begin, F.least(F.coalesce(s["endIndex"].try_cast("int"), size), size))
        return F.make_valid_utf8(F.substring(data, begin + 1, end - begin).cast("string"))

    anchor = layout["textAnchor"]
    joined = F.array_join(F.transform(anchor["textSegments"], piece), "")
    return F.coalesce(
        F.when(anchor["content"] != "", anchor["content"]), joined, F.lit("")
    )


def _anchor_page(responses: DataFrame, json: str) -> DataFrame:
    return _each(_parsed(responses, ANCHOR_TABLES, json).select(
        "document_id", F.coalesce("r.document.text", F.lit("")).alias("_text"),
        F.posexplode_outer("r.document.pages").alias("_page_at", "p"),
    ), "_page_at")


def read_anchor_tables(responses: DataFrame, json: str = "response") -> DataFrame:
    """First header row and body rows whose cell texts are anchored in the document."""
    page_number = F.when(F.col("p.pageNumber") > 0, F.col("p.pageNumber"))
    tables = _anchor_page(responses, json).select(
        "document_id", "_text", page_number.alias("page"), "_page_at",
        F.posexplode("p.tables").alias("_table_at", "t"),
    )
    header = F.coalesce(F.get(F.col("t.headerRows"), F.lit(0))["cells"], F.lit(None))
    rows = tables.select(
        "document_id", "_text", "page",
        (F.col("_page_at") * 100_000 + F.col("_table_at")).alias("table_index"),
        F.posexplode(
            F.concat(
                F.array(header),
                F.coalesce(F.transform("t.bodyRows", lambda r: r["cells"]),
                           F.array().cast(f"array<array<{_LAYOUT}>>")),
            )
        ).alias("row_index", "cells"),
    )
    cells = rows.select(
        "document_id", "_text", "page", "table_index", "row_index",
        F.posexplode("cells").alias("column_index", "c"),
    )
    layout = F.col("c.layout")
    return cells.select(
        "document_id", "table_index", "row_index", "column_index",
        (F.col("row_index") == 0).alias("is_header"),
        clean_text(_anchored(F.col("_text"), layout)).alias("text"),
        provider_pct(layout["confidence"]).alias("provider_pct"), "page",
        point_box(F.col("page"), layout["boundingPoly"]).alias("box"),
    )


def _block_box(block: Column) -> Column:
    geometry = block["Geometry"]["BoundingBox"]
    return F.when(
        geometry["Left"].isNotNull() & geometry["Width"].isNotNull(),
        F.struct(
            block["Page"].alias("page"), F.round(geometry["Left"], 4).alias("x"),
            F.round(geometry["Top"], 4).alias("y"), F.round(geometry["Width"], 4).alias("width"),
            F.round(geometry["Height"], 4).alias("height"), F.lit(True).alias("normalized"),
        ).cast(BOX),
    )


def blocks(responses: DataFrame, json: str = "response") -> DataFrame:
    """One row per block of a block graph, links kept as id arrays by kind."""
    exploded = _each(_parsed(responses, BLOCKS, json).select(
        "document_id", F.posexplode_outer("r.Blocks").alias("place", "b")
    ), "place")

    return exploded.select(
        "document_id", "place", F.col("b.Id").alias("block_id"), F.col("b.BlockType").alias("kind"),
        F.col("b.Text").alias("own_text"), F.col("b.Confidence").alias("confidence"),
        F.col("b.Page").alias("page"), F.col("b.RowIndex").alias("row_index"),
        F.col("b.ColumnIndex").alias("column_index"),
        F.coalesce("b.EntityTypes", F.array().cast("array<string>")).alias("entity_types"),
        F.col("b.SelectionStatus").alias("selection"), _links(F.col("b"), "CHILD").alias("child_ids"),
        _links(F.col("b"), "VALUE").alias("value_ids"), _block_box(F.col("b")).alias("box"),
    )


def block_links(graph: DataFrame, ids: str, name: str) -> DataFrame:
    """(document_id, block_id, position, linked id) of one kind of link."""
    return _each(graph.select("document_id", "block_id", F.posexplode_outer(ids).alias("at", name)), "at")


def _links(block: Column, kind: str) -> Column:
    chosen = F.filter(block["Relationships"], lambda r: r["Type"] == kind)
    return F.flatten(F.transform(chosen, lambda r: F.coalesce(r["Ids"], F.array().cast("array<string>"))))


def _index(entries: Column) -> Column:
    """Entries struct(id, ..) of one response dealt to short lists by their ids, the last entry first."""

    def dealt(every: Column) -> Column:
        parts = F.call_function("div", F.size(every), F.lit(INDEX_LIST)).cast("int") + 1
        return F.transform(
            F.sequence(F.lit(0), parts - 1),
            lambda p: let(
                F.when(parts == 1, every).otherwise(F.filter(every, lambda e: F.pmod(F.hash(e["id"]), parts) == p)),
                lambda some: F.struct(F.transform(some, lambda e: e["id"]).alias("ids"), some.alias("entries")),
            ),
        )

    return let(F.reverse(entries), dealt)


def _entry(index: Column, wanted: Column) -> Column:
    """The entry of an id, the last one if several have it; null if none has."""
    return let(
        F.get(index, F.pmod(F.hash(wanted), F.size(index))),
        lambda part: F.get(part["entries"], F.array_position(part["ids"], wanted).cast("int") - 1),
    )


def _words_index(every: Column) -> Column:
    """What words, marks and signatures say, by block id."""

    def spoken(b: Column) -> Column:
        return (
            F.when(b["BlockType"] == "WORD", F.trim(b["Text"]))
            .when((b["BlockType"] == "SELECTION_ELEMENT") & (b["SelectionStatus"] == "SELECTED"), F.lit("X"))
            .when(b["BlockType"] == "SIGNATURE", F.lit("signed"))
        )

    said = F.transform(
        F.filter(every, lambda b: b["BlockType"].isin("WORD", "SELECTION_ELEMENT", "SIGNATURE")),
        lambda b: F.struct(b["Id"].alias("id"), spoken(b).alias("word")),
    )
    return _index(F.filter(said, lambda e: e["word"] != ""))


def _block_text(block: Column, words: Column) -> Column:
    """Own text, else words, marks and signatures below the block; not cleaned yet."""
    below = F.transform(_links(block, "CHILD"), lambda i: _entry(words, i)["word"])
    return F.when(F.trim(block["Text"]) != "", block["Text"]).otherwise(F.array_join(below, " "))


def _of_kind(every: Column, kind: str) -> Column:
    placed = F.transform(
        every, lambda b, i: F.when(b["BlockType"] == kind, F.struct(b["Id"].alias("id"), i.alias("place"), b.alias("b")))
    )
    return F.filter(placed, lambda e: e.isNotNull())


def read_block_tables(responses: DataFrame, json: str = "response") -> DataFrame:
    """Cells of a block graph. Rows and columns count from 1.

    The graph of a response is in its row, so links are followed there and blocks are not exchanged.
    """
    every = F.col("r.Blocks")
    cells = F.filter(
        _of_kind(every, "CELL"), lambda e: e["b"]["RowIndex"].isNotNull() & e["b"]["ColumnIndex"].isNotNull()
    )

    def cells_of(table: Column, words: Column, index: Column) -> Column:
        listed = F.filter(F.transform(_links(table["b"], "CHILD"), lambda i: _entry(index, i)["b"]), lambda b: b.isNotNull())
        return F.transform(
            listed,
            lambda b: F.struct(table["place"].alias("table_index"), _block_text(b, words).alias("text"), b.alias("b")),
        )

    found = let(
        _words_index(every),
        lambda words: let(
            _index(cells),
            lambda index: F.flatten(F.transform(_of_kind(every, "TABLE"), lambda t: cells_of(t, words, index))),
        ),
    )
    rows = _parsed(responses, BLOCKS, json).select("document_id", F.explode_outer(found).alias("c")).filter(
        F.col("c").isNotNull()
    ).select("document_id", "c.*")
    return rows.select(
        "document_id", "table_index", F.col("b.RowIndex").alias("row_index"), F.col("b.ColumnIndex").alias("column_index"),
        F.coalesce(F.array_contains("b.EntityTypes", "COLUMN_HEADER"), F.lit(False)).alias("is_header"),
        F.coalesce(clean_text(F.col("text")), F.lit("")).alias("text"),
        provider_pct(F.col("b.Confidence"), 100).alias("provider_pct"),
        F.when(F.col("b.Page") > 0, F.col("b.Page")).alias("page"), _block_box(F.col("b")).alias("box"),
    )


PAIR_COLUMNS = ("document_id", "item", "key", "value", "confidence_pct", "page")


def _pair_pct(pct: Column) -> Column:
    return F.coalesce(pct, F.lit(DEFAULT_PAIR_PCT)).alias("confidence_pct")


def read_listed_pairs(responses: DataFrame, json: str = "response") -> DataFrame:
    """S7 of cell-table responses."""
    pairs = _each(_parsed(responses, CELL_TABLES, json).select(
        "document_id", F.posexplode_outer("r.analyzeResult.keyValuePairs").alias("item", "p")
    ), "item")
    region = F.get(F.col("p.value.boundingRegions"), F.lit(0))
    return pairs.select(
        "document_id", "item", F.coalesce(clean_text(F.col("p.key.content")), F.lit("")).alias("key"),
        F.coalesce(clean_text(F.col("p.value.content")), F.lit("")).alias("value"),
        _pair_pct(provider_pct(F.col("p.confidence"))), region["pageNumber"].alias("page"),
    )


def read_anchor_pairs(responses: DataFrame, json: str = "response") -> DataFrame:
    """S7 of anchored responses: form fields of all pages, then entities."""
    fields = _anchor_page(responses, json).select(
        "document_id", "_text", "_page_at",
        F.when(F.col("p.pageNumber") > 0, F.col("p.pageNumber")).alias("page"),
        F.posexplode("p.formFields").alias("_at", "f"),
    )
    from_forms = fields.select(
        "document_id", (F.col("_page_at") * 100_000 + F.col("_at")).alias("item"),
        clean_text(_anchored(F.col("_text"), F.col("f.fieldName.layout"))).alias("key"),
        clean_text(_anchored(F.col("_text"), F.col("f.fieldValue.layout"))).alias("value"),
        _pair_pct(provider_pct(F.col("f.fieldValue.layout.confidence"))), "page",
    )
    entities = _each(_parsed(responses, ANCHOR_TABLES, json).select(
        "document_id", F.posexplode_outer("r.document.entities").alias("_at", "e")
    ), "_at")
    first_page = F.get(F.col("e.pageAnchor.pageRefs"), F.lit(0))["page"].try_cast("int")
    from_entities = entities.select(
        "document_id", (F.lit(2_000_000_000) + F.col("_at")).cast("int").alias("item"),
        F.coalesce(clean_text(F.col("e.type")), F.lit("")).alias("key"),
        F.coalesce(clean_text(F.col("e.mentionText")), F.lit("")).alias("value"),
        _pair_pct(provider_pct(F.col("e.confidence"))), (first_page + 1).alias("page"),
    )
    return from_forms.unionByName(from_entities).filter(F.col("key") != "")


def read_block_pairs(responses: DataFrame, json: str = "response") -> DataFrame:
    """S7 of block graphs: KEY blocks linked to their VALUE block, within the row of the response."""
    every = F.col("r.Blocks")
    sets = lambda role: F.filter(
        _of_kind(every, "KEY_VALUE_SET"), lambda e: F.array_contains(e["b"]["EntityTypes"], role)
    )

    def pair(key: Column, words: Column, values: Column) -> Column:
        linked = F.filter(F.transform(_links(key["b"], "VALUE"), lambda i: _entry(values, i)["b"]), lambda b: b.isNotNull())
        return let(
            F.get(linked, F.lit(0)),
            lambda v: F.struct(
                key["place"].alias("item"), _block_text(key["b"], words).alias("key"), key["b"]["Page"].alias("key_page"),
                F.when(v.isNotNull(), _block_text(v, words)).alias("value"), v["Confidence"].alias("confidence"),
                v["Page"].alias("value_page"),
            ),
        )

    found = let(
        _words_index(every),
        lambda words: let(
            _index(sets("VALUE")), lambda values: F.transform(sets("KEY"), lambda k: pair(k, words, values))
        ),
    )
    pairs = _parsed(responses, BLOCKS, json).select("document_id", F.explode_outer(found).alias("c")).filter(
        F.col("c").isNotNull()
    ).select("document_id", "c.*")
    positive = lambda name: F.when(F.col(name) > 0, F.col(name))
    return pairs.select(
        "document_id", "item", F.coalesce(clean_text(F.col("key")), F.lit("")).alias("key"),
        F.coalesce(clean_text(F.col("value")), F.lit("")).alias("value"),
        _pair_pct(provider_pct(F.col("confidence"), 100)),
        F.coalesce(positive("value_page"), positive("key_page")).alias("page"),
    ).filter(F.col("key") != "")


WORD_COLUMNS = ("document_id", "page", "word", "text", "x", "y", "width", "height", "confidence_pct")


def _word_box(page: Column, poly: Column, width: Column, height: Column) -> Column:
    """Missing coordinates count as 0; normalized points are scaled by a known page size."""
    scale = poly["normalizedVertices"].isNotNull() & (width > 0) & (height > 0)
    points = F.coalesce(poly["normalizedVertices"], poly["vertices"])
    zero, one = F.lit(0.0), F.lit(1.0)
    xs = F.transform(points, lambda p: F.coalesce(p["x"], zero) * F.when(scale, width).otherwise(one))
    ys = F.transform(points, lambda p: F.coalesce(p["y"], zero) * F.when(scale, height).otherwise(one))
    return _box(page, xs, ys, 4, F.lit(False))


def read_word_boxes(responses: DataFrame, json: str = "response") -> DataFrame:
    """Words of nested page responses, else of the flat list without its first entry.

    `responses` may carry page_start; pages count on from it.
    """
    start = F.col("page_start") if "page_start" in responses.columns else F.lit(1)
    parsed = responses.select(
        "document_id", F.coalesce(start, F.lit(1)).alias("_start"),
        F.get(F.from_json(json, WORD_PAGES)["responses"], F.lit(0)).alias("r"),
    )
    nested = F.flatten(
        F.transform(
            F.col("r.fullTextAnnotation.pages"),
            lambda p, i: F.flatten(
                F.transform(
                    p["blocks"],
                    lambda k: F.flatten(
                        F.transform(
                            k["paragraphs"],
                            lambda g: F.transform(
                                g["words"],
                                lambda w: F.struct(
                                    (F.col("_start") + i).cast("int").alias("page"),
                                    F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "").alias("text"),
                                    w["boundingBox"].alias("poly"), p["width"].alias("pw"),
                                    p["height"].alias("ph"), w["confidence"].alias("confidence"),
                                ),
                            ),
                        )
                    ),
                )
            ),
        )
    )
    flat = F.transform(
        F.slice("r.textAnnotations", 2, 1_000_000_000),
        lambda a: F.struct(
            F.col("_start").cast("int").alias("page"), a["description"].alias("text"),
            a["boundingPoly"].alias("poly"), F.lit(None).cast("double").alias("pw"),
            F.lit(None).cast("double").alias("ph"), a["score"].alias("confidence"),
        ),
    )
    words = parsed.withColumn("_nested", nested).withColumn("_flat", flat).select(
        "document_id", (F.size(F.coalesce("_nested", F.array())) > 0).alias("_is_nested"),
        F.posexplode(F.when(F.size("_nested") > 0, F.col("_nested")).otherwise(F.col("_flat"))).alias("word", "w"),
    )
    boxed = words.select(
        "document_id", "word", "_is_nested", F.col("w.page").alias("page"),
        F.coalesce(clean_text(F.col("w.text")), F.lit("")).alias("text"),
        _word_box(F.col("w.page"), F.col("w.poly"), F.col("w.pw"), F.col("w.ph")).alias("box"),
        provider_pct(F.col("w.confidence")).alias("_pct"),
    )
    default = F.when(F.col("_is_nested"), DEFAULT_WORD_PCT).otherwise(DEFAULT_FLAT_WORD_PCT)
    return boxed.filter((F.col("text") != "") & F.col("box").isNotNull()).select(
        "document_id", "page", "word", "text", "box.x", "box.y", "box.width", "box.height",
        F.coalesce("_pct", default).cast("int").alias("confidence_pct"),
    )


def read_ready_rows(responses: DataFrame, json: str = "response") -> DataFrame:
    """One row per extraction row with its data map and cells by field key."""
    rows = _parsed(responses, READY_ROWS, json).select(
        "document_id", F.col("r.providerName").alias("provider"),
        F.posexplode_outer("r.rows").alias("_at", "row"),
    ).filter(F.col("row").isNotNull())

    def positive(name: str) -> Column:
        return F.when(F.col(f"row.{name}") > 0, F.col(f"row.{name}"))

    return rows.select(
        "document_id", "provider", "_at",
        F.coalesce(positive("rowNumber"), F.col("_at") + 1).alias("row_number"),
        positive("sourcePage").alias("source_page"),
        provider_pct(F.col("row.confidenceScore")).alias("row_pct"),
        F.col("row.data").alias("data"), F.col("row.values").alias("values"),
    )


def read_suggestions(responses: DataFrame, json: str = "response") -> DataFrame:
    """Field suggestions that come ready with a response; incomplete ones are dropped."""
    from tallysheet.schemas import FIELD_TYPES

    listed = _each(_parsed(responses, READY_ROWS, json).select(
        "document_id", F.posexplode_outer("r.suggestedFields").alias("position", "s")
    ), "position")
    empty = F.array().cast("array<string>")
    return listed.filter(
        (F.trim("s.label") != "") & (F.trim("s.key") != "") & F.col("s.type").isin(*FIELD_TYPES)
    ).select(
        "document_id", "position", F.trim("s.label").alias("label"), F.trim("s.key").alias("key"),
        F.col("s.type").alias("type"), F.coalesce("s.aliases", empty).alias("aliases"),
        F.coalesce("s.options", empty).alias("options"),
        F.coalesce("s.sampleValues", empty).alias("samples"),
        F.coalesce(provider_pct(F.col("s.confidence")), F.lit(50)).alias("confidence_pct"),
    )
