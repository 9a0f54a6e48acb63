"""JSON documents of any size, read and written by many tasks.

Reading: a file is cut at commas by Spark's splittable text source, so byte ranges
of one document go to different tasks.  Whether a comma ends an element of the
document depends on all text before it, but only through two numbers that add up:
quotes (their parity says whether a place is inside a string) and brackets outside
strings.  Every split is summed up for both parities, the sums of the splits of a
file are combined in order, and then each split finds its elements by itself; only
the first and last piece of a split meet those of its neighbours.  The task that reads
a split has its pieces in order, so it sums and cuts them as they pass: no text is
shuffled, and beside the file only the pieces at the ends of splits are stored.

Writing: a document is one array per (book, part), its lines put together row by
row, so no element list is ever held.  Spark's output committer makes a task's files
visible once, whichever attempt wrote them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import holds_any
from ..plans.storage import freed_shuffles, materialize

#: Elements of one written file.
PART_ROWS = 4096


def _decoded(name: Column) -> Column:
    """A name out of a URL; a plus sign is a plus sign there."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _book(path: Column) -> Column:
    """The folder of a file; the value of the partition folder that :func:`write_elements` makes."""
    folder = _decoded(F.regexp_extract(F.regexp_replace(path, "/part=[0-9]+(?=/[^/]*$)", ""), "([^/]+)/[^/]+$", 1))
    value = F.regexp_extract(folder, "^book_id=(.*)$", 1)
    return F.when(folder == "book_id=__HIVE_DEFAULT_PARTITION__", None).when(folder.startswith("book_id="), _decoded(value)).otherwise(folder)


def _part(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, "/part=([0-9]+)/[^/]*$", 1).try_cast("long"), F.lit(0))


def _balance(outside: Column) -> Column:
    """Brackets opened less brackets closed."""
    difference = F.length(F.translate(outside, "]}", "")) - F.length(F.translate(outside, "[{", ""))
    return F.when(holds_any(outside, "[]{}"), difference).otherwise(0)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The texts between commas of all files: file, split, n (order in the split), piece, quotes, and brackets if it starts outside or inside a string."""
    rows = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("piece"),
    )
    # An escape is a backslash and one more sign, which is never a comma, so none is cut.
    # Most pieces are prose without a sign that counts; byte searches tell them from the rest.
    escaped = F.contains("piece", F.lit("\\"))
    bare = rows.withColumn("bare", F.when(escaped, F.regexp_replace("piece", r"(?s)\\.", "")).otherwise(F.col("piece")))
    bare = bare.withColumn("quotes", F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit(""))))
    string, plain = '(?s)"[^"]*("|$)', F.col("quotes") == 0
    outside = F.when(plain, F.col("bare")).otherwise(F.regexp_replace("bare", string, ""))
    inside = F.when(plain, "").otherwise(F.regexp_replace(F.regexp_replace("bare", '(?s)^[^"]*("|$)', ""), string, ""))
    texts = bare.withColumns({"__outside": outside, "__inside": inside})
    return texts.select(
        "file", "split", "n", "piece", "quotes", _balance(F.col("__outside")).alias("outside"), _balance(F.col("__inside")).alias("inside")
    )


def _runs(batch: pa.RecordBatch, *keys: str) -> list[tuple[int, int]]:
    """Begin and end of the rows that stand together with equal keys, none of them null."""
    n = batch.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        c = batch.column(key)
        new |= pc.not_equal(c.slice(1), c.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return [*zip(at, at[1:])] if n else []


def _counts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("quotes", "outside", "inside")]


SPLIT_SUMS = "file string, split long, n long, head binary, quotes long, depth0 long, depth1 long"
CUT = "sid long, k long, text binary, rest boolean"


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: its pieces and the first of them, its quotes, and what it adds to the depth if it starts outside (0) or inside (1) a string."""
    at, head, sums = None, b"", np.zeros(4, np.int64)

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SPLIT_SUMS.split(", ")])

    for batch in batches:
        done = []
        files, splits = batch.column("file"), batch.column("split")
        quotes, outside, inside = _counts(batch)
        for a, b in _runs(batch, "file", "split"):
            if (key := (files[a].as_py(), splits[a].as_py())) != at:
                done += [(*at, int(sums[0]), head, *sums[1:].tolist())] if at else []
                at, head, sums = key, batch.column("piece")[a].as_py(), np.zeros(4, np.int64)
            q, o, i = quotes[a:b], outside[a:b], inside[a:b]
            even = (np.cumsum(q) - q + sums[1]) % 2 == 0
            sums += (b - a, q.sum(), np.where(even, o, i).sum(), np.where(even, i, o).sum())
        if done:
            yield summed(done)
    if at:
        yield summed([(*at, int(sums[0]), head, *sums[1:].tolist())])


def _joined(pieces: pa.Array, bounds: list[int]) -> pa.Array:
    """The pieces between two bounds each, as one text with its commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces), b",")


def _cut_rows(sid: int, first: int, texts: pa.Array, rest: bool = False) -> pa.RecordBatch:
    n = len(texts)
    columns = [pa.array(np.full(n, sid, np.int64)), pa.array(np.arange(first, first + n, dtype=np.int64)), texts, pa.array(np.full(n, rest))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CUT.split(", ")])


def _cut(whole: bool):
    """The pieces of splits to rows (sid, k, text, rest): the elements that stand in one split, or the ends of splits.

    ``k`` is the number of element ends before it in its split.  The ends of a split are
    the text before its first element end, unless the file begins there, and a row with
    the number of all its element ends, ``rest`` if pieces follow these, and their text
    unless they are a whole element, as the file ends there.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, last, parity, depth, k, held, rest = None, False, False, 0, 0, 0, [], False

        def closed() -> list[pa.RecordBatch]:
            entire = rest and last and (first or k > 0)
            if at is None or whole and not entire:
                return []
            text = b",".join(held) if rest and whole == entire else None
            return [_cut_rows(at, k, pa.array([text], pa.binary()), rest)]

        for batch in batches:
            done = []
            sids, pieces = batch.column("sid"), batch.column("piece")
            quotes, outside, inside = _counts(batch)
            for a, b in _runs(batch, "sid"):
                if sids[a].as_py() != at:
                    done += closed()
                    at, first, last, parity, depth = (batch.column(c)[a].as_py() for c in ("sid", "first", "last", "parity", "depth"))
                    k, held, rest = 0, [], False
                q = quotes[a:b]
                so_far = np.cumsum(q) + parity
                level = depth + np.cumsum(np.where((so_far - q) % 2 == 0, outside[a:b], inside[a:b]))
                ends = (np.flatnonzero((so_far % 2 == 0) & (level == 1)) + 1).tolist()
                parity, depth = int(so_far[-1] % 2), int(level[-1])
                mine = pieces.slice(a, b - a)
                if ends:
                    if whole == (first or k > 0):
                        text = b",".join([*held, _joined(mine, [0, ends[0]])[0].as_py()])
                        done.append(_cut_rows(at, k, pa.array([text], pa.binary())))
                    if whole and len(ends) > 1:
                        done.append(_cut_rows(at, k + 1, _joined(mine, ends)))
                    k, held, rest = k + len(ends), [], False
                if (after := ends[-1] if ends else 0) < b - a:
                    rest, began = True, first or k > 0
                    if began if whole else not (began and last):
                        held.append(_joined(mine, [after, b - a])[0].as_py())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        yield from closed()

    return of


def _starts(sums: DataFrame) -> DataFrame:
    """Of every split: sid, file, split, parity and depth at its beginning, whether it is the first or last of its file, and of what its file opens with."""
    in_file = Window.partitionBy("file").orderBy("split")
    past = in_file.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("parity", F.coalesce(F.sum("quotes").over(past), F.lit(0)) % 2)
    depth = F.sum(F.when(F.col("parity") == 0, F.col("depth0")).otherwise(F.col("depth1"))).over(past)
    head = F.col("head").cast("string")
    opening = F.regexp_extract(head, "^[\\s\ufeff]*([\\[{])", 1).alias("opening")
    blank = ((F.col("n") == 1) & head.rlike("^[\\s\ufeff]*[\\[{]\\s*[\\]}]\\s*$")).alias("blank")
    ends = [F.lag("split").over(in_file).isNull().alias("first"), F.lead("split").over(in_file).isNull().alias("last")]
    return sums.select(F.monotonically_increasing_id().alias("sid"), "file", "split", "parity", F.coalesce(depth, F.lit(0)).alias("depth"), *ends, opening, blank)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """book_id, seq, json: every element of the top array or object of each file, as a document of its own.

    ``seq`` counts from 0 over all files of a book (the parts that
    :func:`write_elements` makes, in order); the book is the file's folder.  A file of
    one split or of thousands gives the same rows.  White space around elements goes;
    an empty array or object gives none.  The text is expected to be JSON in UTF-8:
    a file that ends inside a string or bracket raises no error, its open rest is its last element.
    Lists and texts in an element stay whole, so an element has to fit into a row.
    """
    cut = pieces(spark, path).withColumn("piece", F.col("piece").cast("binary"))
    starts = materialize(_starts(cut.select("file", "split", "piece", "quotes", "outside", "inside").mapInArrow(_split_sums, SPLIT_SUMS)), "json-splits")
    # One row a split, as many as the driver plans.  The pieces have to stay in their tasks and in order,
    # and a shuffle would break both, so these rows are always copied to the tasks.
    begun = cut.join(F.broadcast(starts.drop("opening", "blank")), ["file", "split"])
    begun = begun.select("sid", "first", "last", "parity", "depth", "piece", "quotes", "outside", "inside")
    edges = materialize(begun.mapInArrow(_cut(False), CUT), "json-edges")

    # An element has the number of element ends before it, in whichever split its pieces are.
    ends = edges.groupBy("sid").agg(F.max("k").alias("n_ends"), F.max_by("rest", "k").alias("rest"))
    past = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = starts.join(ends, "sid").withColumn("before", F.coalesce(F.sum("n_ends").over(past), F.lit(0)))
    final = F.max(F.col("before") + F.col("n_ends") - (~F.col("rest")).cast("int")).alias("final")
    files = splits.groupBy("file").agg(final, F.max_by("opening", "first").alias("opening"), F.max_by("blank", "first").alias("blank"))
    files = files.filter(~((F.col("final") == 0) & F.col("blank"))).withColumns({"book_id": _book(F.col("file")), "part": _part(F.col("file"))})
    by_book = Window.partitionBy("book_id").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("offset", F.coalesce(F.sum(F.col("final") + 1).over(by_book), F.lit(0)))
    of_file = ("file", "book_id", "final", "opening", "offset")
    places = materialize(splits.select("file", "sid", "split", "before").join(files, "file").select("sid", "split", "before", *of_file), "json-places")

    # Elements that stand in one split, and those put together from the ends of splits.
    inner = begun.mapInArrow(_cut(True), CUT).join(F.broadcast(places), "sid")
    placed = ((F.col("before") + F.col("k")).alias("at"), *of_file, F.col("text").cast("string").alias("text"))
    joint = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), ",")
    outer = edges.filter("text IS NOT NULL").join(places, "sid").select("split", *placed)
    whole = inner.select(*placed).unionByName(outer.groupBy("at", *of_file).agg(joint.alias("text")))

    body = F.when(F.col("at") == 0, F.regexp_replace("text", "^[\\s\ufeff]*[\\[{]", "")).otherwise(F.col("text"))
    body = F.when(F.col("at") == F.col("final"), F.regexp_replace(body, "[\\]}]\\s*$", "")).otherwise(body)
    body = F.regexp_replace(body, "^\\s+|\\s+$", "")
    json = F.when(F.col("opening") == "{", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return whole.select("book_id", (F.col("at") + F.col("offset")).alias("seq"), json.alias("json"))


def write_elements(rows: DataFrame, path: str, order: str, element: Column, brackets: str = "[]", part_rows: int = PART_ROWS) -> None:
    """Write ``rows`` (book_id, ``order``) as JSON documents in ``path``/book_id=…/part=…, by the integer ``order``, never null.

    A part holds the rows of ``part_rows`` numbers of ``order``, so a small book is one
    file and a huge one is written by many tasks.  ``element`` is JSON text, or a
    ``"key": value`` where ``brackets`` are those of an object.  A null book has
    Spark's folder of nulls; a book without rows has no file.
    """
    parts = rows.select("book_id", _part_of(F.col(order), part_rows), F.col(order).alias("at"), element.alias("json"))
    _write_parts(parts, path, brackets)


def _part_of(order: Column, part_rows: int) -> Column:
    return F.floor(order / part_rows).cast("long").alias("part")


def _write_parts(parts: DataFrame, path: str, brackets: str = "[]") -> None:
    """Write rows (book_id, part, at, json); what was shuffled for it goes when the files stand."""
    in_part = Window.partitionBy("book_id", "part").orderBy("at")
    opened = F.when(F.lag("at").over(in_part).isNull(), F.lit(brackets[0])).otherwise(F.lit(""))
    closed = F.when(F.lead("at").over(in_part).isNull(), F.lit(brackets[1])).otherwise(F.lit(","))
    lines = parts.select("book_id", "part", "at", F.concat(opened, "json", closed).alias("value"))
    lines = lines.sortWithinPartitions("book_id", "part", "at").drop("at")
    with freed_shuffles(parts.sparkSession):
        lines.write.mode("overwrite").partitionBy("book_id", "part").text(path)


EXAM_FIELDS = ("start", "end", "school", "branch", "year", "title", "segments")
MANIFEST_FIELDS = ("index", "name", "file", "src_start", "src_end", "pdf_pages", "school", "branch", "year")
WITH_NULLS = {"ignoreNullFields": "false"}


def write_exam_sets(exam: DataFrame, segments: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Every exam as {start, end, school, branch, year, title, segments: [[page, col], …]}, in order of ``idx``.

    ``exam`` has book_id, idx and the plain fields, ``segments`` book_id, idx, seq,
    page, col.  An exam without segments has an empty list.  Nulls are written.
    """
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("seq", "page", "col"))), lambda s: F.array(s["page"], s["col"]))
    nested = segments.filter("idx IS NOT NULL").groupBy("book_id", "idx").agg(pairs.cast("array<array<int>>").alias("segments"))
    # The list of an exam's segments stands before it in its part, so texts are shuffled once, to where they are written.
    key = ("book_id", _part_of(F.col("idx"), part_rows), F.col("idx").alias("at"))
    exams = exam.select(*key, F.struct(*EXAM_FIELDS[:-1]).alias("plain"))
    both = exams.unionByName(nested.select(*key, "segments"), allowMissingColumns=True).repartition("book_id", "part")
    of_exam = Window.partitionBy("book_id", "part", "at").orderBy(F.col("plain").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("segments", F.last("segments", ignorenulls=True).over(of_exam)).filter("plain IS NOT NULL")
    listed = F.coalesce("segments", F.array().cast("array<array<int>>")).alias("segments")
    json = F.to_json(F.struct("plain.*", listed), WITH_NULLS)
    _write_parts(rows.select("book_id", "part", "at", json.alias("json")), path)


def write_manifest(manifest: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Every document of a book as one object, in order of ``index``; nulls are written."""
    rows = manifest.select("book_id", "index", F.to_json(F.struct(*MANIFEST_FIELDS), WITH_NULLS).alias("json"))
    write_elements(rows, path, "index", F.col("json"), part_rows=part_rows)


def write_strips(page_strip: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Pages (book_id, page, cols, full) as an object {"page": {"col": […], "full": "…"}, …}, in order of pages."""
    value = F.to_json(F.struct(F.col("cols").alias("col"), "full"), WITH_NULLS)
    entry = F.concat(F.lit('"'), F.col("page").cast("string"), F.lit('": '), value)
    write_elements(page_strip, path, "page", entry, "{}", part_rows)
