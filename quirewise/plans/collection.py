"""All stages for all books, as one set of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import output, segments, subpages
from ..operators.ordered import salted_lookup
from ..rules import CN_EXAM, SCAN, LayoutProfile, RuleProfile
from ..sources.listing import skip_pages
from ..sources.raster import ink_profile_of_tiles, tiles


@dataclass(frozen=True)
class Inputs:
    """``page_strip`` (book_id, page, cols, full) and a layout table, ink profiles
    or page rasters (whole, or tiles of rows with ``top``); ``pages`` (book_id,
    page, width, height) sizes the slices.  ``detected`` takes the findings of an
    earlier run instead of reading the texts again.  ``skip`` leading pages of
    every book, or by book (book_id, skip), take no part in any stage."""

    page_strip: DataFrame
    pages: DataFrame
    layout: DataFrame | None = None
    profile: DataFrame | None = None
    layout_overrides: DataFrame | None = None
    title_overrides: DataFrame | None = None
    detected: DataFrame | None = None
    raster: DataFrame | None = None
    skip: int | DataFrame = 0


#: The tables of ``Inputs`` that have a row or more per page of a book.
BY_PAGE = ("page_strip", "pages", "layout", "profile", "raster", "detected", "layout_overrides", "title_overrides")


def content_pages(inputs: Inputs) -> Inputs:
    """P1 for all tables: without the leading pages, overrides of them included."""
    by_book = isinstance(inputs.skip, DataFrame)
    if not by_book and inputs.skip <= 0:
        return inputs
    cut = lambda df: skip_pages(df, inputs.skip) if by_book else skip_pages(df, skip=inputs.skip)
    return replace(inputs, skip=0, **{n: cut(df) for n in BY_PAGE if (df := getattr(inputs, n)) is not None})


@dataclass(frozen=True)
class Result:
    layout: DataFrame
    detected: DataFrame
    subpages: DataFrame
    exam: DataFrame
    segments: DataFrame
    slices: DataFrame
    unplaced: DataFrame
    manifest: DataFrame
    strips: DataFrame
    subjects: DataFrame | None
    rules: RuleProfile

    def verify(self) -> tuple[DataFrame, DataFrame]:
        """(verdict per long document, hidden headers inside)."""
        return segments.verify_long(self.exam, self.segments, self.detected, self.subjects, self.rules)


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def split_collections(
    inputs: Inputs,
    rules: RuleProfile = CN_EXAM,
    scan: LayoutProfile = SCAN,
    infer_subject: bool = True,
    naming: str = "simple",
    keep: Callable[[DataFrame, str], DataFrame] = _as_is,
) -> Result:
    """Layout, overrides, detection, segmentation, slices, manifest, checks.

    Lazy throughout.  ``keep`` is called on the tables read more than once
    (layout, findings per page, subjects, segments); pass
    ``storage.materialize`` to write them to the shared folder, which is what
    a large run wants: the texts are then read once, by a pass without a
    shuffle, and everything after works on rows of a few dozen bytes.
    """
    inputs = content_pages(inputs)
    profile = inputs.profile
    if inputs.layout is None and profile is None and inputs.raster is not None:
        parts = inputs.raster if "top" in inputs.raster.columns else tiles(inputs.raster)
        profile = ink_profile_of_tiles(parts, scan).filter("error IS NULL").drop("error")
    if inputs.layout is not None:
        lay = inputs.layout
    elif profile is not None:
        lay = L.classify_layout(profile, inputs.pages, scan)
    else:
        raise ValueError("give a layout table, ink profiles or rasters")
    if inputs.layout_overrides is not None:
        lay = L.apply_layout_overrides(lay, inputs.layout_overrides).drop("old_layout", "changed")
    lay = keep(lay, "layout")
    detected = inputs.detected
    if detected is None:
        detected = keep(subpages.detect_headers(inputs.page_strip, rules), "detected")
    subjects = keep(subpages.subjects_of(detected), "subjects") if infer_subject else None
    sub = subpages.subpages_of(detected, lay, inputs.title_overrides, subjects, rules)
    marked = keep(segments.segment_columns(sub), "segments")
    exam = segments.roll_up(marked)
    slices = output.slice_plan(marked, lay, inputs.pages)
    return Result(
        layout=lay,
        detected=detected,
        subpages=sub,
        exam=exam,
        segments=marked,
        slices=slices,
        unplaced=output.unplaced_segments(marked, lay, inputs.pages),
        manifest=output.manifest(exam, slices, naming),
        strips=inputs.page_strip,
        subjects=subjects,
        rules=rules,
    )


def restrict(df: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of the named books."""
    named = books.select("book_id").distinct()
    return salted_lookup(df, named, "book_id", F.col("page"), how="left_semi")


def touched(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """The pages an override table names."""
    return pages.join(overrides.select("book_id", "page").distinct(), ["book_id", "page"], "left_semi")


def replace_pages(page_strip: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with those of the re-read pages put in place of the old ones."""
    kept = page_strip.join(new.select("book_id", "page"), ["book_id", "page"], "left_anti")
    return kept.unionByName(new.select(*page_strip.columns))


def recompute(
    inputs: Inputs,
    overrides: DataFrame,
    new_strips: DataFrame,
    rules: RuleProfile = CN_EXAM,
    keep: Callable[[DataFrame, str], DataFrame] = _as_is,
) -> Result:
    """After layout corrections, redo detection and slicing of those books.

    Refuses overrides of unknown pages, and a table without a valid override.  Only books with a touched page are
    computed; write the result with ``replace_books`` to swap exactly those.
    With the findings of the earlier run in ``inputs.detected``, only the
    touched pages are searched for headers again.
    """
    valid, _ = L.split_overrides(overrides)
    if valid.isEmpty():
        raise ValueError("no valid correction")
    books = valid.select("book_id").distinct()
    lay = L.apply_layout_overrides(restrict(inputs.layout, books), valid, on_unknown="fail").drop(
        "old_layout", "changed"
    )
    strips = replace_pages(restrict(inputs.page_strip, books), new_strips)
    titles, found = inputs.title_overrides, inputs.detected
    if found is not None:
        fresh = subpages.detect_headers(new_strips, rules)
        found = keep(replace_pages(restrict(found, books), fresh), "detected")
    return split_collections(
        Inputs(
            page_strip=strips,
            pages=restrict(inputs.pages, books),
            layout=lay,
            detected=found,
            title_overrides=None if titles is None else restrict(titles, books),
        ),
        rules,
        keep=keep,
    )


def reread_worklist(layout: DataFrame, pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """What has to be read again: the regions of the touched pages, as corrected."""
    patched = L.apply_layout_overrides(layout, overrides)
    return output.read_worklist(touched(pages, overrides), patched)


def summary(result: Result) -> DataFrame:
    """Documents and pages per book."""
    return output.manifest_totals(result.manifest).select(
        "book_id", "exams", F.col("pages").cast("long").alias("pages")
    )
