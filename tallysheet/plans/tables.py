"""From layout cells and pairs to cleaned record rows.

Intermediate tables that several steps read are staged (see `tallysheet.session.stage`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.cells import normalize_cells, option_terms
from tallysheet.functions.numeric import blend_confidence, int_div, mean_of
from tallysheet.functions.scoring import FALLBACK_COLUMN, FALLBACK_PAIR, match_confidence
from tallysheet.functions.text import is_populated
from tallysheet.operators.joins import hot_keys, lookup_join
from tallysheet.operators.matching import (
    assign_in_field_order, fallback_columns, match_forms, match_headers, template_terms,
)
from tallysheet.operators.ordered import carry_forward, number_rows
from tallysheet.session import stage

BAND = 4096
#: Cells or words of a document from which on its rows are numbered in bands.
LARGE = 1_000_000


def large_documents(parts: DataFrame) -> DataFrame | None:
    """Documents that one task should not hold, counted over their cells or words; None if there are none."""
    return hot_keys(parts, ["document_id"], LARGE)


def split_large(df: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of all other documents and those of large ones."""
    if large is None:
        return df, None
    return df.join(large, "document_id", "left_anti"), df.join(large, "document_id", "left_semi")


def field_rules(fields: DataFrame) -> DataFrame:
    """What cleaning needs to know of a field; option terms are prepared once per field."""
    return with_option_terms(fields).select("template_id", "field_id", *RULES)


#: What cleaning needs to know of a field.
RULES = ("key", "type", "required", "option_terms")


def with_option_terms(fields: DataFrame) -> DataFrame:
    return fields.withColumn("option_terms", option_terms(F.coalesce("options", F.array().cast("array<string>"))))


def fields_with_rules(fields: DataFrame) -> DataFrame:
    """Fields with `rules`, what `field_rules` has for each, as a list: cells that carry it need no join of their own."""
    rules = field_rules(fields).groupBy("template_id", "field_id").agg(F.collect_list(F.struct(*RULES)).alias("rules"))
    return lookup_join(fields, rules, ["template_id", "field_id"])


def with_rules(cells: DataFrame, rules: str = "rules") -> DataFrame:
    """Cells with the RULES of the list they carry."""
    return cells.select(*[c for c in cells.columns if c != rules], F.explode_outer(rules).alias("_rule")).select(
        *[c for c in cells.columns if c != rules], "_rule.*")


def clean_and_score(
    cells: DataFrame, fields: DataFrame, spread: Sequence[str], value_confidence: str = "provider",
    keep_clean: bool = False,
) -> DataFrame:
    """N1, N6 and N5 for cells with template_id, field_id, raw_text, structure_pct, provider_pct.

    A provider confidence replaces the cleaner's ("provider"), or only lowers it ("min").
    With `keep_clean` the cleaner's own confidence stays as clean_pct.
    """
    typed = lookup_join(cells, field_rules(fields), ["template_id", "field_id"], spread=spread)
    return score_typed(typed, value_confidence, keep_clean)


def score_typed(typed: DataFrame, value_confidence: str = "provider", keep_clean: bool = False) -> DataFrame:
    """`clean_and_score` for cells that carry the RULES of their field."""
    cleaned = normalize_cells(typed)
    if keep_clean:
        cleaned = cleaned.withColumn("clean_pct", F.col("confidence_pct"))
    if value_confidence == "min":
        value = F.least(F.col("confidence_pct"), F.col("provider_pct"))
    else:
        value = F.coalesce("provider_pct", "confidence_pct")
    return cleaned.withColumn(
        "confidence_pct", blend_confidence(F.col("structure_pct"), value, F.size("issues"))
    ).drop("option_terms", "provider_pct", "structure_pct")


def header_rows(cells: DataFrame, carry: bool) -> DataFrame:
    """Per table its header row and the table whose header it uses.

    The header row is the first marked row, else the first row. With `carry`, a table
    without a marked row that follows another table uses the last header before it, and
    all of its rows are data. `header_row` is null then.
    """
    tables = cells.groupBy("document_id", "table_index").agg(
        F.min(F.when(F.col("is_header"), F.col("row_index"))).alias("_marked"),
        F.min("row_index").alias("_first"),
    )
    own = F.coalesce("_marked", "_first")
    if not carry:
        return tables.select(
            "document_id", "table_index", own.alias("header_row"), F.col("table_index").alias("header_table")
        )
    tables = stage(tables)  # read three times below, the cells once
    first_table = tables.groupBy("document_id").agg(F.min("table_index").alias("_first_table"))
    carried = carry_forward(
        tables, ["document_id"], [F.col("table_index")], int_div(F.col("table_index"), F.lit(BAND)),
        F.when(F.col("_marked").isNotNull(), F.col("table_index")), "_marked_table",
    )
    known = lookup_join(carried, first_table, "document_id", spread=["table_index"])
    header_table = F.coalesce("_marked_table", "_first_table")
    return known.select(
        "document_id", "table_index",
        F.when(header_table == F.col("table_index"), own).alias("header_row"),
        header_table.alias("header_table"),
    )


def mapped_tables(headers: DataFrame, fields: DataFrame, first_column: int = 0, fallback: bool = True,
                  extra: Sequence[str] = ()) -> DataFrame:
    """W4 (b): for every header table its fields with their columns and confidences as `_columns`, and `extra` of the fields.

    `headers`: document_id, template_id, table_index, column_index, text. A header is one
    row of one table, so its columns fit in a row. Equal headers of a template are mapped
    once and looked up by every table that has them.
    """
    tables = headers.groupBy("document_id", "template_id", "table_index").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("column_index").cast("int").alias("item"), "text"))
        ).alias("_header")
    )
    layouts = tables.select("template_id", "_header").distinct()
    scored = match_headers(
        layouts.select("template_id", "_header", F.explode("_header").alias("h")).select(
            "template_id", "_header", "h.item", "h.text"
        ),
        fields, ["_header", "item"],
    )
    items = scored.groupBy("template_id", "_header").agg(
        F.collect_list(F.struct("item", "matches")).alias("_items")
    )
    with_fields = lookup_join(
        items, template_terms(fields, extra), "template_id", how="inner", spread=["_header"]
    ).withColumn("_assigned", assign_in_field_order(F.col("_items"), F.col("fields")))
    if fallback:
        with_fields = with_fields.withColumn(
            "_assigned", fallback_columns(F.col("_assigned"), first_column)
        )
    column = F.transform("_assigned", lambda a, i: F.struct(
        a["sort_order"].alias("sort_order"), a["field_id"].alias("field_id"), a["item"].alias("column_index"), a["score"].alias("score"),
        F.when(a["score"].isNull(), FALLBACK_COLUMN).otherwise(match_confidence(a["score"])).alias("structure_pct"),
        *[F.get("fields", i)[c].alias(c) for c in extra],
    ))
    return lookup_join(
        tables, with_fields.select("template_id", "_header", column.alias("_columns")), ["template_id", "_header"],
        "inner", spread=["document_id", "table_index"],
    ).drop("_header")


def map_columns(headers: DataFrame, fields: DataFrame, first_column: int = 0, fallback: bool = True
                ) -> DataFrame:
    """W4 (b): for every header table one row per field with its column and confidence, see `mapped_tables`."""
    return mapped_tables(headers, fields, first_column, fallback).select(
        "document_id", "template_id", "table_index", F.explode("_columns").alias("a")
    ).select(
        "document_id", "template_id", "table_index", "a.field_id", "a.sort_order", "a.column_index", "a.score", "a.structure_pct",
    )


def table_rows(
    cells: DataFrame, documents: DataFrame, fields: DataFrame, carry: bool = True,
    first_column: int = 0, fallback: bool = True, value_confidence: str = "provider",
) -> DataFrame:
    """L1: the cleaned cells of every document's table rows, see `keep_filled_rows`.

    `documents`: document_id, template_id and optionally row_count and page_start.
    """
    rows, large = placed_rows(cells, documents, carry)
    headers = header_cells(rows)
    # the columns of a document by header table with the rules of their fields, so that its rows meet them by document alone
    mapped = mapped_tables(headers, fields_with_rules(fields), first_column, fallback, ["rules"]).repartition("document_id")
    mapping = mapped.groupBy("document_id", "table_index").agg(F.flatten(F.collect_list("_columns")).alias("_columns")).groupBy(
        "document_id").agg(F.map_from_entries(F.collect_list(F.struct("table_index", "_columns"))).alias("_maps"))
    body = rows.filter("is_data").join(mapping, "document_id")

    def cell(c: Column) -> Column:
        own = F.get(F.filter("_cells", lambda x: x["column_index"] == c["column_index"]), F.lit(0))
        return F.struct(
            c["field_id"].alias("field_id"), c["sort_order"].alias("sort_order"), c["structure_pct"].alias("structure_pct"),
            own["text"].alias("raw_text"), own["provider_pct"].alias("provider_pct"), own["box"].alias("box"),
            c["rules"].alias("rules"),
        )

    filled = body.withColumn("_columns", F.try_element_at("_maps", F.col("header_table"))).select(
        "document_id", "template_id", "table_index", "row_index", "row_number", "page",
        F.explode(F.transform("_columns", cell)).alias("c"),
    ).select("document_id", "template_id", "table_index", "row_index", "row_number", "page", "c.*")
    return keep_filled_rows(
        score_typed(with_rules(filled), value_confidence), documents, ["table_index", "row_index"], large)


def placed_rows(cells: DataFrame, documents: DataFrame, carry: bool) -> tuple[DataFrame, DataFrame | None]:
    """Staged rows of cells with their header table, see `_placed_by_document`, and the large documents."""
    mine = stage(lookup_join(cells, documents.select("document_id", "template_id"), "document_id", "inner"))
    large = large_documents(mine)
    some, most = split_large(mine, large)
    rows = _placed_by_document(some, carry)
    if most is not None:
        rows = rows.unionByName(_placed_by_table(most, carry))
    return stage(rows), large


def header_cells(rows: DataFrame) -> DataFrame:
    """The cells of the header rows among `placed_rows`."""
    return rows.filter("is_head").select(
        "document_id", "template_id", "table_index", F.explode("_cells").alias("c")
    ).select("document_id", "template_id", "table_index", "c.column_index", "c.text")


_ROW = ("document_id", "template_id", "table_index", "row_index")


def _row_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*_ROW).agg(
        F.collect_list(F.struct("column_index", "text", "provider_pct", "box")).alias("_cells"),
        F.min_by("page", "column_index").alias("page"),
        F.coalesce(F.bool_or("is_header"), F.lit(False)).alias("_marked"),
    )


def _placed_by_document(mine: DataFrame, carry: bool) -> DataFrame:
    """Rows of tables with their header table, whether they are its header or data, and row_number.

    All cells of a document meet once; rows, headers (W9, as `header_rows` finds them) and
    numbers are windows within what one exchange brought together.
    """
    rows = _row_cells(mine.repartition("document_id"))
    table, document = Window.partitionBy("document_id", "table_index"), Window.partitionBy("document_id")
    marked = F.min(F.when(F.col("_marked"), F.col("row_index"))).over(table)
    placed = rows.withColumn("_own", marked).withColumn("_head", F.coalesce("_own", F.min("row_index").over(table)))
    header_table = F.col("table_index")
    if carry:
        last = F.last(F.when(F.col("_own").isNotNull(), F.col("table_index")), ignorenulls=True).over(document.orderBy("table_index"))
        header_table = F.coalesce(last, F.min("table_index").over(document))
    placed = placed.withColumn("header_table", header_table)
    own = F.col("header_table") == F.col("table_index")
    placed = placed.withColumns({
        "is_head": own & (F.col("row_index") == F.col("_head")),
        "is_data": ~own | (F.col("row_index") > F.col("_head")),
    })
    number = F.sum(F.col("is_data").cast("int")).over(document.orderBy("table_index", "row_index"))
    return placed.withColumn("row_number", number.cast("bigint")).drop("_own", "_head", "_marked")


def _placed_by_table(mine: DataFrame, carry: bool) -> DataFrame:
    """The same for documents of any size: tables meet by table, rows are numbered in bands."""
    rows = stage(_row_cells(mine)).drop("_marked")
    placed = rows.join(header_rows(mine, carry), ["document_id", "table_index"]).withColumns({
        "is_head": F.coalesce(F.col("row_index") == F.col("header_row"), F.lit(False)),
        "is_data": F.col("header_row").isNull() | (F.col("row_index") > F.col("header_row")),
    }).drop("header_row")
    data = placed.filter("is_data").select("document_id", "table_index", "row_index")
    band = F.struct("table_index", int_div(F.col("row_index"), F.lit(BAND)).alias("b"))
    numbers = number_rows(data, ["document_id"], [F.col("table_index"), F.col("row_index")], band, "row_number")
    return placed.join(numbers, ["document_id", "table_index", "row_index"], "left")


def keep_filled_rows(
    scored: DataFrame, documents: DataFrame, place: Sequence[str], large: DataFrame | None = None, single: bool = False,
    together: Sequence[str] = (),
) -> DataFrame:
    """Drop rows without a populated cell, then keep as many as a document asks for.

    One row per cell, with its row's page, confidence and places: `row_number` counts
    before the blank rows are dropped, `output_row` after. The limit is row_count of the
    document; without one all rows stay. Rows are judged and numbered within their document:
    bring the rows of a document together before their cells are made. Those of the `large`
    ones that `large_documents` found meet by row and are numbered in bands. With `single` a document has one row. `together` names further
    columns that the cells of a row share: a table partitioned by them is not exchanged.
    """
    some, most = split_large(scored, large)
    filled = is_populated(F.col("normalized_value"), F.col("value_kind"))
    kept = _filled_together(some, filled, place, single, together)
    if most is not None:
        kept = kept.unionByName(_filled_by_place(most, filled, place, together))
    given = documents.columns
    if "row_count" in given:
        limits = documents.select("document_id", F.col("row_count").alias("_limit"))
        kept = lookup_join(kept, limits, "document_id").filter(
            F.col("_limit").isNull() | (F.col("output_row") <= F.col("_limit")))
    page = F.col("page")
    if "page_start" in given:
        kept = lookup_join(kept, documents.select("document_id", F.col("page_start").alias("_page")), "document_id")
        page = F.coalesce("page", "_page")
    at = _row_keys(scored, place)
    return kept.select(
        *at, *[c for c in scored.columns if c not in (*at, *together, "page")], "row_confidence_pct", "output_row",
        page.alias("source_page"))


def _row_keys(scored: DataFrame, place: Sequence[str]) -> list[str]:
    return [c for c in ("document_id", "template_id") if c in scored.columns] + list(place)


def _filled_together(scored: DataFrame, filled: Column, place: Sequence[str], single: bool, together: Sequence[str]
                     ) -> DataFrame:
    """Cells of filled rows by two windows over one order. Nothing is exchanged if documents are together already."""
    rest = [c for c in _row_keys(scored, place) if c not in ("document_id", *place)]
    row = Window.partitionBy("document_id", *place, *rest, *together)
    known = scored.withColumns({
        "_filled": F.max(filled).over(row),
        "row_confidence_pct": mean_of(F.sum(F.col("confidence_pct").cast("bigint")).over(row), F.count("confidence_pct").over(row)),
        "page": F.max("page").over(row),
    }).filter("_filled").drop("_filled")
    if single:
        return known.withColumn("output_row", F.lit(1))
    number = F.dense_rank().over(Window.partitionBy("document_id").orderBy(*place, *rest, *together))
    return known.withColumn("output_row", number)


def _filled_by_place(scored: DataFrame, filled: Column, place: Sequence[str], together: Sequence[str]) -> DataFrame:
    """The same for documents of any size: cells meet by row, rows are numbered in bands."""
    at = _row_keys(scored, place)
    rows = scored.groupBy(*at, *together).agg(
        F.collect_list(F.struct(*[c for c in scored.columns if c not in (*at, *together, "page")])).alias("_cells"),
        F.max(filled).alias("_filled"),
        mean_of(F.sum(F.col("confidence_pct").cast("bigint")), F.count("confidence_pct")).alias("row_confidence_pct"),
        F.max("page").alias("page"),
    ).filter("_filled").drop("_filled")
    band = F.struct(*place[:-1], int_div(F.col(place[-1]), F.lit(BAND)).alias("b"))
    banded = number_rows(stage(rows), ["document_id"], [F.col(p) for p in place], band, "output_row")
    cells = banded.withColumn("output_row", F.col("output_row").cast("int"))
    return cells.select(
        *at, *together, "page", "row_confidence_pct", "output_row", F.explode("_cells").alias("c")
    ).select(*at, *together, "page", "row_confidence_pct", "output_row", "c.*")


def rows_of(cells: DataFrame) -> DataFrame:
    """The rows of `keep_filled_rows` output."""
    return cells.select(
        "document_id", "row_number", "output_row", "source_page", "row_confidence_pct"
    ).distinct()


def pair_rows(pairs: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """L3: one row per document that has pairs."""
    matched = match_forms(pairs, documents, with_option_terms(fields), RULES).select(
        "document_id", "template_id", "form_keys", "field_id", "sort_order", "page", *RULES,
        F.lit(1).alias("table_index"), F.lit(1).alias("row_index"), F.lit(1).cast("bigint").alias("row_number"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("pair_pct", F.lit(FALLBACK_PAIR)).alias("structure_pct"),
        F.lit(None).cast("int").alias("provider_pct"),
    )
    return keep_filled_rows(
        score_typed(matched), documents, ["table_index", "row_index"], single=True, together=["form_keys"])


def form_or_table_rows(pairs: DataFrame, cells: DataFrame, documents: DataFrame, fields: DataFrame,
                       **table_options) -> DataFrame:
    """L3 with its fallback: a form request without pairs is read as a table."""
    forms = pair_rows(pairs, documents, fields)
    rest = cells.join(pairs.select("document_id").distinct(), "document_id", "left_anti")
    tables = table_rows(rest, documents, fields, **table_options)
    return forms.unionByName(tables.select(*forms.columns))


def ready_rows(rows: DataFrame, documents: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explicit cell values win over the data map, the cleaner fills what is missing.

    `rows` comes from `read_ready_rows`; a row holds at most one cell per field.
    """
    from tallysheet.sources.layouts import provider_pct

    template = with_option_terms(fields).groupBy("template_id").agg(
        F.sort_array(F.collect_list(F.struct("sort_order", "field_id", *RULES))).alias("_fields")
    )
    mine = lookup_join(rows, documents.select("document_id", "template_id"), "document_id", "inner", spread=["_at"])
    wide = lookup_join(mine, template, "template_id", "inner", spread=["document_id", "_at"])
    named = F.filter(
        "values", lambda v: F.coalesce(v["fieldKey"], v["key"]) == F.col("f.key")
    )
    own = ["document_id", "_at", "row_number", "source_page", "row_pct"]
    cells = wide.select(*own, "data", "values", F.explode("_fields").alias("f")).withColumn(
        "_cell", F.element_at(F.when(F.size(named) > 0, named), -1)
    ).select(
        *own, "f.*", "_cell", F.coalesce("_cell.rawValue", F.try_element_at("data", F.col("f.key")), F.lit("")).alias("given_raw"),
    )
    # cells keep what is known of their row, so that its mean needs no second reading of the rows
    done = normalize_cells(cells.withColumn("raw_text", F.col("given_raw"))).select(
        *own, "field_id", "sort_order", "key", F.col("given_raw").alias("raw_value"),
        F.coalesce("_cell.normalizedValue", "normalized_value").alias("normalized_value"), "value_kind",
        F.coalesce(provider_pct(F.col("_cell.confidence")), F.col("confidence_pct")).alias("confidence_pct"),
        F.coalesce("_cell.issues", "_cell.validationIssues", "issues").alias("issues"),
    )
    cleaned = done.drop("row_number", "source_page", "row_pct")
    kept = done.groupBy(*own).agg(
        mean_of(F.sum(F.col("confidence_pct").cast("bigint")), F.count("confidence_pct")).alias("_mean")
    ).select(
        "document_id", "_at", "row_number", "source_page",
        F.coalesce(F.col("row_pct").cast("bigint"), F.col("_mean")).alias("row_confidence_pct"),
    )
    return kept, cleaned


def merge_pages(rows: DataFrame) -> DataFrame:
    """Rows of all pages of a document in page order, numbered from 1.

    `rows`: document_id, page, row_number (place on its page).
    """
    band = F.struct("page", int_div(F.col("row_number"), F.lit(BAND)).alias("b"))
    return number_rows(rows, ["document_id"], [F.col("page"), F.col("row_number")], band, "document_row")


