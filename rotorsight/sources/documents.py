"""Document sources: files to pages, and the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import limits as L
from ..functions.scalars import image_type, strip
from ..operators.runs import Series, number_runs, segment_number, stitch
from ..session import materialise
from . import chunk_table
from .csv_files import read_rows as read_csv_rows

PAGE_COLUMNS = ["source", "file_type", "part", "page", "sheet_name", "text"]
ROWS_PER_SLICE = 4096


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder with its suffix; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", suffix("path").alias("suffix"),
                    F.col("_metadata.file_path").alias("source")))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Each Markdown file is one page; blank files are dropped."""
    files = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.{md,markdown,MD,Markdown}").text(path, wholetext=True))
    return files.filter(strip("value") != "").select(
        F.input_file_name().alias("source"), F.lit("markdown").alias("file_type"),
        F.lit(0).cast("long").alias("part"), F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.replace("value", F.lit("\ufffd"), F.lit("")).alias("text"))


def pdf_pages(rows: DataFrame) -> DataFrame:
    """Extracted PDF pages (source, page, text) as page rows."""
    return rows.select("source", F.lit("pdf").alias("file_type"),
                       F.col("page").cast("long").alias("part"), F.col("page").cast("int"),
                       F.lit(None).cast("string").alias("sheet_name"), "text")


def sheet_pages(rows: DataFrame) -> DataFrame:
    """Extracted sheet rows (source, sheet_no, sheet_name, row_no, cells[]) as page rows."""
    cells = F.transform("cells", lambda c: strip(F.coalesce(c, F.lit(""))))
    line = F.regexp_replace(F.array_join(cells, " | "), "[ |]+$", "")
    filled = rows.filter(F.exists(cells, lambda c: c != "")).withColumn("line", line)
    return filled.groupBy("source", "sheet_no", "sheet_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))),
                                 lambda x: x["line"]), "\n").alias("text")).select(
        "source", F.lit("excel").alias("file_type"), F.col("sheet_no").cast("long").alias("part"),
        F.lit(None).cast("int").alias("page"), "sheet_name", "text")


def csv_pages(rows: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """CSV rows as pages: consecutive rows with one value of the segment column, 50 at most.

    Every row brings its file's header, so nothing is joined on the file. The runs are found in slices of rows and stitched, so a long file is not ordered in one task.
    """
    names = F.transform("header", lambda c: F.lower(strip(c)))
    position = F.coalesce(*[F.nullif(F.array_position(names, c).cast("int"), F.lit(0))
                            for c in L.CSV_SEGMENT_COLUMNS])
    value = strip(F.coalesce(F.try_element_at("cells", F.col("seg_col")), F.lit("")))
    body = (rows.filter(F.col("row_no") > 0)
            .withColumn("seg_col", position)
            .withColumn("key", F.when(F.col("seg_col").isNull(), "").otherwise(value))
            .withColumn("slice", F.expr(f"row_no div {int(rows_per_slice)}"))
            .withColumn("line", F.array_join("cells", " | ", "")))
    series = Series(keys=("source",), ts="row_no", state="key")
    placed = number_runs(body, series)
    runs = placed.groupBy("source", "slice", "run").agg(F.first("key").alias("state"),
                                                        F.min("row_no").alias("start"))
    units = materialise(runs.groupBy("source", "slice").agg(
        F.max("run").alias("n_runs"), F.min_by("state", "run").alias("first_state"),
        F.max_by("state", "run").alias("last_state"), F.max("start").alias("last_start")))
    start = F.when(F.col("continues") & (F.col("run") == 1), F.col("carried_start")) \
        .otherwise(F.col("row_no") - F.col("rn") + 1)
    capped = placed.join(stitch(units, series), ["source", "slice"]).withColumns({
        "segment": segment_number(),
        "piece": F.floor((F.col("row_no") - start) / L.CSV_ROWS_PER_DOC)})
    pages = capped.groupBy("source", "segment", "piece").agg(
        F.min("row_no").alias("part"), F.first("header").alias("header"),
        F.first("key").alias("segment_value"), F.count(F.lit(1)).alias("row_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))),
                                 lambda x: x["line"]), "\n").alias("body"))
    return pages.select(
        "source", F.lit("csv").alias("file_type"), F.col("part").cast("long").alias("part"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("sheet_name"),
        F.concat(F.array_join("header", " | "), F.lit("\n"), F.col("body")).alias("text"),
        "segment_value", "row_count")


def load_report(files: DataFrame, pages: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: files scanned and skipped, pages loaded, files failed."""
    known = L.PDF_SUFFIXES + L.EXCEL_SUFFIXES + L.MARKDOWN_SUFFIXES
    supported = F.col("suffix").isin(known)
    counts = files.agg(F.count_if(supported).alias("files_scanned"),
                       F.count_if(~supported).alias("files_skipped"))
    loaded = pages.agg(F.count(F.lit(1)).alias("docs_loaded"))
    errors = F.lit(0).cast("long") if failed is None else failed.agg(F.count(F.lit(1))).scalar()
    return counts.withColumns({"docs_loaded": loaded.scalar(), "files_failed": errors})


def load_outcomes(files: DataFrame, pages: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per file: source, outcome (loaded, skipped, failed), reason, docs_loaded.

    ``failed`` has source and error. A folder scan skips suffixes that no reader takes, among them
    CSV files, unless pages or failures show that they were read on purpose.
    """
    known = L.PDF_SUFFIXES + L.EXCEL_SUFFIXES + L.MARKDOWN_SUFFIXES
    # Readers write the same place with one slash or three.
    place = F.regexp_replace("source", "^([a-z0-9]+):/+", "$1:/").alias("place")
    docs = pages.groupBy(place).agg(F.count(F.lit(1)).alias("docs_loaded"))
    errors = failed.filter("error is not null").groupBy(place).agg(F.min("error").alias("error"))
    joined = files.select("source", "suffix", place).join(docs, "place", "left").join(
        errors, "place", "left")
    unread = ~F.col("suffix").isin(known) & F.col("docs_loaded").isNull()
    outcome = F.when(F.col("error").isNotNull(), "failed").when(unread, "skipped").otherwise("loaded")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(
        unread, F.concat(F.lit("no reader for suffix '"), "suffix", F.lit("'")))
    return joined.select("source", outcome.alias("outcome"), reason.alias("reason"),
                         F.coalesce("docs_loaded", F.lit(0)).alias("docs_loaded"))


def build_report(files: int, pages: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row with the counts of every step."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return chunks.agg(F.count(F.lit(1)).alias("chunks_created"),
                      F.countDistinct("chunk_id").alias("chunks_written")).withColumns({
                          "files_scanned": F.lit(files).cast("long"), "docs_loaded": count(pages),
                          "records": count(records)})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the chunk table."""
    return chunk_table.read(spark, path)


def write_chunks(spark: SparkSession, fresh: DataFrame, path: str, stored: bool) -> None:
    """Upsert into the chunk table; without ``stored`` the table holds the fresh chunks alone."""
    if stored:
        chunk_table.upsert(fresh, path)
    else:
        chunk_table.rebuild(fresh, path)


def rebuild_chunks(fresh: DataFrame, path: str) -> bool:
    """Replace the chunk table, but only if the new build has at least one chunk."""
    fresh = materialise(fresh)
    if fresh.isEmpty():
        return False
    chunk_table.rebuild(fresh, path)
    return True


def read_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Image files with type and hash; unsupported content keeps a null type."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "content", image_type("content").alias("mime"),
                     F.sha2("content", 256).alias("sha256")))
    return files if limit is None else files.orderBy("path").limit(limit)
