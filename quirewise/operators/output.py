"""Work lists, slice plans, names and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_name
from .layout import page_layout
from .ordered import rank_in_group

LONG_SIDE_CAP = 10000
TOP_FRACTION = 0.60
READ_DPI = 250
SLICE_DPI = 200
EXPAND_STEP = 4096


def render_scale(width: Column, height: Column, dpi: int) -> Column:
    """dots per point, lowered until the long side fits the cap."""
    long_side = F.greatest(width, height)
    base = F.lit(dpi / 72.0)
    return F.when(long_side * base > LONG_SIDE_CAP, F.lit(float(LONG_SIDE_CAP)) / long_side).otherwise(base)


def pixel_span(lo: Column, hi: Column, scale: Column) -> Column:
    """Pixels covered by [lo, hi] points; edges within a thousandth snap inwards."""
    return (F.ceil(hi * scale - 0.001) - F.floor(lo * scale + 0.001)).cast("int")


def read_worklist(pages: DataFrame, layout: DataFrame, dpi: int = READ_DPI) -> DataFrame:
    """One row per region whose text has to be read.

    ``pages`` is (book_id, page, width, height) in points.  Every column is
    read, and the whole width too unless the page is a single column already.
    ``col`` is null for the whole width.
    """
    full = F.struct(F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1"))
    columns = F.transform(F.col("cuts"), lambda c, i: F.struct(i.alias("col"), c.alias("cut")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("col"), full.alias("cut")))
    regions = F.when(F.col("layout") == "1-up", columns).otherwise(F.concat(columns, whole))
    scale = F.col("scale")
    px_w = pixel_span(F.lit(0.0), F.col("width"), scale)
    px_h = pixel_span(F.lit(0.0), F.col("height"), scale)
    return (
        page_layout(pages, layout)
        .withColumn("scale", render_scale(F.col("width"), F.col("height"), dpi))
        .select(
            "book_id", "page", "layout", "scale", px_w.alias("px_w"), px_h.alias("px_h"),
            F.explode(regions).alias("r"),
        )
        .select(
            "book_id",
            "page",
            "layout",
            F.col("r.col").alias("col"),
            "scale",
            F.floor(F.col("px_w") * F.col("r.cut.x0")).cast("int").alias("left"),
            F.floor(F.col("px_w") * F.col("r.cut.x1")).cast("int").alias("right"),
            F.floor(F.col("px_h") * F.lit(TOP_FRACTION)).cast("int").alias("bottom"),
        )
    )


def whole_page_segments(exam: DataFrame, layout: DataFrame) -> DataFrame:
    """Segments of documents stored as page ranges only: all columns of all pages.

    A range is expanded in bounded steps, so a long one never sits in one row.
    """
    steps = exam.select(
        "book_id",
        "idx",
        "end",
        F.explode(F.sequence(F.col("start"), F.col("end"), F.lit(EXPAND_STEP).cast("int"))).alias("from"),
    )
    pages = steps.select(
        "book_id",
        "idx",
        F.explode(
            F.sequence("from", F.least(F.col("end"), F.col("from") + (EXPAND_STEP - 1)))
        ).alias("page"),
    )
    cols = page_layout(pages, layout).select(
        "book_id", "idx", "page", F.posexplode("cuts").alias("col", "cut")
    )
    placed = cols.withColumn("place", F.col("page").cast("long") * 8 + F.col("col"))
    return rank_in_group(placed, ["book_id", "idx"], "place", "seq").select(
        "book_id", "idx", "seq", "page", "col"
    )


def _windows(segments: DataFrame, layout: DataFrame, pages: DataFrame) -> DataFrame:
    windows = page_layout(pages, layout).select("book_id", "page", "width", "height", "cuts")
    rows = segments.join(windows, ["book_id", "page"], "left")
    return rows.withColumn("cut", F.get("cuts", F.col("col"))).drop("cuts")


#: What a slice needs: a size of its page and a window of its column.
_PLACED = "width IS NOT NULL AND height IS NOT NULL AND cut IS NOT NULL"


def unplaced_segments(segments: DataFrame, layout: DataFrame, pages: DataFrame) -> DataFrame:
    """T4: the segments ``slice_plan`` can't place, with the reason."""
    why = F.when(F.col("width").isNull() | F.col("height").isNull(), "no page size").otherwise("no window")
    return _windows(segments, layout, pages).filter(f"NOT ({_PLACED})").select("book_id", "idx", "seq", "page", "col", why.alias("reason"))


def slice_plan(
    segments: DataFrame, layout: DataFrame, pages: DataFrame, dpi: int = SLICE_DPI
) -> DataFrame:
    """Output page -> source page, window in points, scale, pixel size.

    One co-partitioned lookup by (book_id, page).  A window of no pixels gives no
    page; segments without a page size or window are in ``unplaced_segments``.
    """
    x0, x1 = F.col("cut.x0") * F.col("width"), F.col("cut.x1") * F.col("width")
    scale = F.col("scale")
    return (
        _windows(segments, layout, pages)
        .filter(_PLACED)
        .withColumn("x0", x0)
        .withColumn("x1", x1)
        .withColumn("scale", render_scale(F.col("x1") - F.col("x0"), F.col("height"), dpi))
        .select(
            "book_id",
            "idx",
            F.col("seq").alias("out_page"),
            "page",
            "col",
            "x0",
            "x1",
            "scale",
            pixel_span(F.col("x0"), F.col("x1"), scale).alias("px_w"),
            pixel_span(F.lit(0.0), F.col("height"), scale).alias("px_h"),
        )
        .filter((F.col("px_w") > 0) & (F.col("px_h") > 0))
    )


def unique_names(
    df: DataFrame, name: str, order: str, mode: str = "simple", group: str = "book_id"
) -> DataFrame:
    """The 2nd, 3rd… use of a name becomes name(2), name(3)…

    ``simple`` can still meet a title that ends in "(2)" by itself; ``strict``
    tells such a pair apart with a blank and the index, which no base name holds.
    """
    ranked = rank_in_group(df, [group, name], order, "__use").withColumn(
        name,
        F.when(F.col("__use") > 1, F.concat(F.col(name), F.lit("("), F.col("__use"), F.lit(")"))).otherwise(
            F.col(name)
        ),
    )
    if mode == "simple":
        return ranked.drop("__use")
    if mode != "strict":
        raise ValueError(f"unknown naming mode {mode!r}")
    return (
        rank_in_group(ranked.drop("__use"), [group, name], order, "__again")
        .withColumn(
            name,
            F.when(F.col("__again") > 1, F.concat(F.col(name), F.lit(" #"), F.col(order))).otherwise(
                F.col(name)
            ),
        )
        .drop("__again")
    )


def manifest(exam: DataFrame, slices: DataFrame, mode: str = "simple") -> DataFrame:
    """T7"""
    counts = slices.groupBy("book_id", "idx").agg(F.count(F.lit(1)).cast("int").alias("pdf_pages"))
    named = exam.withColumn(
        "name", output_name(F.col("title"), F.col("school"), F.col("branch"), F.col("year"))
    )
    return (
        unique_names(named, "name", "idx", mode)
        .join(counts, ["book_id", "idx"], "left")
        .select(
            "book_id",
            F.col("idx").alias("index"),
            "name",
            F.concat("name", F.lit(".pdf")).alias("file"),
            F.col("start").alias("src_start"),
            F.col("end").alias("src_end"),
            F.coalesce("pdf_pages", F.lit(0)).alias("pdf_pages"),
            "school",
            "branch",
            "year",
        )
    )


def manifest_totals(man: DataFrame) -> DataFrame:
    """A12"""
    return man.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("exams"), F.coalesce(F.sum("pdf_pages"), F.lit(0)).alias("pages")
    )


def result_files(man: DataFrame) -> DataFrame:
    """Output files of each book with its manifest, sorted."""
    files = man.select("book_id", "file").filter(F.col("file").endswith(".pdf"))
    marker = man.select("book_id", F.lit("_manifest.json").alias("file")).distinct()
    return files.unionByName(marker).orderBy("book_id", "file")


def first_exams(man: DataFrame, n: int = 4) -> DataFrame:
    """K4: the first ``n`` documents of every book, whatever its indexes start at."""
    return rank_in_group(man, ["book_id"], "index", "__place").filter(F.col("__place") <= n).drop("__place")
