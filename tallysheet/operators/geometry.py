"""Word boxes: lines, spans, header lines, columns.

Two styles of measuring are in use. `grid` compares word tops and looks at usable words
only; `nested` compares word centers and takes every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.text import clean_text
from tallysheet.operators.joins import lookup_join

PAGE = ["document_id", "page"]
LINE = [*PAGE, "line_no"]
BAND_PIXELS = 4096
MAX_SPAN_WORDS = 4

# Limits of both styles in pixels.
GRID_COLUMNS = (35, 109, 184, 260, 335, 410, 485, 560)
GRID_SINGLE_LIMIT, NESTED_SINGLE_LIMIT = 65, 80
GRID_SPAN_GAP, GRID_SPAN_FACTOR = 36, 1.4
NESTED_SPAN_GAP, NESTED_SPAN_FACTOR = 24, 1.8
GRID_MEDIAN, NESTED_MEDIAN = 10.0, 16.0
TABLE_LEFT, FORM_LEFT = 25, 20


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def prepare_words(words: DataFrame) -> DataFrame:
    """Cleaned text and the usable flag, once per word."""
    return words.withColumn("clean", F.coalesce(clean_text(F.col("text")), F.lit(""))).withColumn(
        "usable", F.col("clean").rlike("[A-Za-z0-9]")
    )


def word_struct() -> Column:
    """Natural order of the struct is left to right."""
    return F.struct("x", "y", "width", "height", "word", "clean", "confidence_pct")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` written, and computed, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(values: Column, default: float) -> Column:
    """The usual median, `default` for no values."""

    def middle(ordered: Column) -> Column:
        half = F.call_function("div", F.size(ordered), F.lit(2)).cast("int")
        upper = F.get(ordered, half)
        return F.when(F.size(ordered) % 2 == 1, upper).otherwise((F.get(ordered, half - 1) + upper) / 2)

    return F.coalesce(let(F.sort_array(values), middle), F.lit(default))


def array_upper_median(values: Column, default: float) -> Column:
    """The upper of the two middle positive values."""

    def upper(ordered: Column) -> Column:
        return F.get(ordered, F.call_function("div", F.size(ordered), F.lit(2)).cast("int"))

    return F.coalesce(let(F.sort_array(F.filter(values, lambda v: v > 0)), upper), F.lit(default))


def page_tolerance(words: DataFrame, style: str) -> DataFrame:
    """Line tolerance of each page from the heights of its words."""
    if style == "grid":
        height = F.coalesce(F.median("height"), F.lit(GRID_MEDIAN))
        tolerance = clamp(height * 0.65, 6, 18)
    else:
        upper = F.expr(
            "percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN height > 0 THEN height END DESC)"
        )
        tolerance = F.greatest(F.lit(8.0), F.coalesce(upper, F.lit(NESTED_MEDIAN)) * 0.75)
    return words.groupBy(*PAGE).agg(tolerance.alias("_tolerance"))


def page_levels(leveled: DataFrame, tolerance: DataFrame) -> DataFrame:
    """The distinct levels of each page with their band and the tolerance of the page, dealt by band.

    The tolerance meets the bands of a page first: levels joined by their page alone would all
    lie in one task, and the windows over bands would stay there.
    """
    levels = leveled.select(*PAGE, "_level").distinct().withColumn("_band", F.floor(F.col("_level") / BAND_PIXELS))
    reach = lookup_join(levels.select(*PAGE, "_band").distinct(), tolerance, PAGE)
    return levels.join(reach, [*PAGE, "_band"])


def with_lines(words: DataFrame, style: str) -> DataFrame:
    """line_no counts the lines of a page from the top (gaps and islands, D7).

    Only the distinct heights of a page are ordered, in bands, so a page of any size is
    never one task; words get their line back by an equi join.
    """
    level = F.col("y") if style == "grid" else F.col("y") + F.col("height") / 2
    leveled = words.withColumn("_level", level)
    levels = page_levels(leveled, page_tolerance(words, style))
    inside = Window.partitionBy(*PAGE, "_band").orderBy("_level")
    gap = F.col("_level") - F.lag("_level").over(inside)
    marked = levels.withColumn(
        "_starts", F.coalesce((gap > F.col("_tolerance")).cast("int"), F.lit(0))
    )
    bands = marked.groupBy(*PAGE, "_band").agg(
        F.min("_level").alias("_first"), F.max("_level").alias("_last"),
        F.max("_tolerance").alias("_tolerance"), F.sum("_starts").alias("_inner"),
    )
    across = Window.partitionBy(*PAGE).orderBy("_band")
    step = F.col("_first") - F.lag("_last").over(across)
    opened = bands.withColumn("_opens", F.coalesce((step > F.col("_tolerance")).cast("int"), F.lit(1)))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(
        *PAGE, "_band",
        (F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(earlier), F.lit(0)) + F.col("_opens"))
        .alias("_offset"),
    )
    running = F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("_running", running).join(offsets, [*PAGE, "_band"]).select(
        *PAGE, "_level", (F.col("_running") + F.col("_offset")).cast("int").alias("line_no")
    )
    return lookup_join(leveled, numbered, [*PAGE, "_level"], "inner", spread=["word"])


def line_arrays(lined: DataFrame) -> DataFrame:
    """One row per line with its words from left to right; a line is one line of a page."""
    return lined.groupBy(*LINE).agg(
        F.sort_array(F.collect_list(word_struct())).alias("words"), F.avg("_level").alias("line_y")
    )


def right_of(w: Column) -> Column:
    return w["x"] + w["width"]


def center_of(w: Column) -> Column:
    return w["x"] + w["width"] / 2


def span_left(words: Column) -> Column:
    return F.array_min(words["x"])


def span_right(words: Column) -> Column:
    return F.array_max(F.transform(words, right_of))


def span_top(words: Column) -> Column:
    return F.array_min(words["y"])


def span_bottom(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: w["y"] + w["height"]))


def span_average_y(words: Column) -> Column:
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + w["y"])
    return total / F.greatest(F.size(words), F.lit(1))


def is_compact(span: Column, style: str) -> Column:
    """Neighbouring words of a span are close, in pixels or compared with their width."""
    least, factor = (
        (GRID_SPAN_GAP, GRID_SPAN_FACTOR) if style == "grid" else (NESTED_SPAN_GAP, NESTED_SPAN_FACTOR)
    )
    widths = F.transform(span, lambda w: w["width"])
    middle = (
        array_median(widths, GRID_MEDIAN) if style == "grid" else array_upper_median(widths, NESTED_MEDIAN)
    )
    gaps = F.zip_with(F.slice(span, 2, MAX_SPAN_WORDS), span, lambda b, a: b["x"] - right_of(a))
    widest = F.coalesce(F.array_max(gaps), F.lit(0.0))
    return let(widest, lambda gap: (gap <= least) | (gap <= middle * factor))


def spans(words: Column, style: str) -> Column:
    """Runs of one to four neighbouring words of a line whose every prefix is compact."""
    n = F.size(words)

    def runs_from(s: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(MAX_SPAN_WORDS), n - s))
        compact = F.transform(
            sizes, lambda k: (k == 1) | is_compact(F.slice(words, s + 1, k), style)
        )
        return let(
            compact,
            lambda flags: F.transform(
                F.filter(
                    F.transform(flags, lambda f, i: i + 1),
                    lambda k: F.forall(F.slice(flags, F.lit(1), k), lambda f: f),
                ),
                lambda k: F.slice(words, s + 1, k),
            ),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), runs_from))


def span_sizes(words: Column, start: Column, style: str) -> Column:
    """How many spans of `spans` begin at the word `start` (from 0): their sizes are 1, 2, .. up to it.

    Written out word by word, so that it is compiled.
    """
    x, width = words["x"], words["width"]
    xs = [F.get(x, start + i) for i in range(MAX_SPAN_WORDS)]
    widths = [F.get(width, start + i) for i in range(MAX_SPAN_WORDS)]
    gaps = [xs[i] - (xs[i - 1] + widths[i - 1]) for i in range(1, MAX_SPAN_WORDS)]

    def compact(k: int) -> Column:
        widest = F.coalesce(F.greatest(*gaps[: k - 1]) if k > 2 else gaps[0], F.lit(0.0))
        if style == "grid":
            least, factor, ordered = GRID_SPAN_GAP, GRID_SPAN_FACTOR, F.sort_array(F.array(*widths[:k]))
            upper = F.get(ordered, F.lit(k // 2))
            middle = F.coalesce(upper if k % 2 else (F.get(ordered, F.lit(k // 2 - 1)) + upper) / 2, F.lit(GRID_MEDIAN))
        else:  # nulls come first, then the positive widths
            least, factor = NESTED_SPAN_GAP, NESTED_SPAN_FACTOR
            ordered = F.sort_array(F.array(*[F.when(w > 0, w) for w in widths[:k]]))
            none = sum((F.when(w > 0, 0).otherwise(1) for w in widths[1:k]), F.when(widths[0] > 0, 0).otherwise(1))
            middle = F.coalesce(F.get(ordered, F.shiftright(k + none, 1)), F.lit(NESTED_MEDIAN))
        return (start + k <= F.size(words)) & ((widest <= least) | (widest <= middle * factor))

    sizes = F.lit(MAX_SPAN_WORDS)
    for k in range(MAX_SPAN_WORDS, 1, -1):
        sizes = F.when(compact(k), sizes).otherwise(k - 1)
    return sizes


def words_text(words: Column, style: str) -> Column:
    """Text of words on one line: from left to right, in `nested` style by top first."""
    if style == "grid":
        return let(F.array_join(F.sort_array(words)["clean"], " "), clean_text)
    return let(F.array_join(from_top(words)["clean"], " "), clean_text)


def from_top(words: Column) -> Column:
    """(y, x, clean) of words by top first."""
    return F.sort_array(
        F.arrays_zip(words["y"], words["x"], words["clean"]).cast("array<struct<y:double,x:double,clean:string>>")
    )


def words_box(words: Column, page: Column, digits: int, also: tuple[Column, ...] | None = None) -> Column:
    """The box around a word group, null when it is empty.

    `also` is (left, top, right, bottom) of an area to include, each null for none.
    """
    found = [span_left(words), span_top(words), span_right(words), span_bottom(words)]
    if also:
        found = [F.least(found[0], also[0]), F.least(found[1], also[1]),
                 F.greatest(found[2], also[2]), F.greatest(found[3], also[3])]
    edges = F.struct(*[e.alias(n) for e, n in zip(found, "ltrb")])
    return let(
        edges,
        lambda e: F.when(
            e["l"].isNotNull(),
            F.struct(
                page.cast("int").alias("page"), F.round(e["l"], digits).alias("x"),
                F.round(e["t"], digits).alias("y"), F.round(e["r"] - e["l"], digits).alias("width"),
                F.round(e["b"] - e["t"], digits).alias("height"), F.lit(False).alias("normalized"),
            ),
        ),
    )


def nearest_column(center: Column, columns: Column) -> Column:
    """The closest column within its limit, null beyond; ties go to the first column.

    `columns`: array of struct(place, field_id, x, limit, ..).
    """
    offers = F.transform(
        columns, lambda c: F.struct(F.abs(center - c["x"]).alias("d"), c["place"].alias("place"),
                                    c["limit"].alias("limit"), c["field_id"].alias("field_id"))
    )
    return let(F.array_min(offers), lambda best: F.when(best["d"] <= best["limit"], best["field_id"]))


def column_limit(x: Column, others: Column, style: str) -> Column:
    """Reach of a column: a share of the gap to its nearest other column, kept in a range."""
    gaps = F.filter(F.transform(others, lambda o: F.abs(o - x)), lambda g: g > 0)
    share, low, high, single = (
        (0.55, 42, 140, GRID_SINGLE_LIMIT) if style == "grid" else (0.8, 36, 160, NESTED_SINGLE_LIMIT)
    )
    return F.coalesce(
        F.when(F.size(gaps) > 0, clamp(F.array_min(gaps) * share, low, high)), F.lit(float(single))
    )
