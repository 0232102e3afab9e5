"""Page layout: columns, routes to OCR, choice of OCR lines, and profiles of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.functions.text import collapse, is_contact_line, strip

#: Fixed thresholds: native characters of a page, of a document, of a routed page; share of dark pixels; pages.
NATIVE_PAGE, NATIVE_DOCUMENT, ROUTED_PAGE, DARK, MOST_PAGES = 40, 120, 80, 0.02, 12
#: Of a two-column page, as shares of its width and in points.
LEFT_BELOW, LEFT_END, BLOCKS, PER_SIDE, OVERLAP = 0.42, 0.68, 6, 2, 12.0


def multi_column(blocks: Column, width: Column) -> Column:
    """Whether blocks stand side by side: six or more with text, two or more on each side, one pair overlapping by more
    than 12 points in height."""
    w = F.greatest(width, F.lit(1.0))
    full = F.filter(blocks, lambda b: strip(b["text"]) != "")
    left = F.filter(full, lambda b: (b["x0"] < w * LEFT_BELOW) & (b["x1"] < w * LEFT_END))
    right = F.filter(full, lambda b: b["x0"] > w * LEFT_BELOW)
    beside = F.exists(left, lambda a: F.exists(right, lambda b: F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) > OVERLAP))
    return (F.size(full) >= BLOCKS) & (F.size(left) >= PER_SIDE) & (F.size(right) >= PER_SIDE) & beside


def multi_column_join(blocks: DataFrame) -> DataFrame:
    """The same over block rows (page_id, width, x0, y0, x1, y1, text): (page_id, multi_column).

    A sweep down each page: for each block, how far down the blocks of the other side reach that begin no lower. No pairs
    are made, so a page of n blocks costs a sort of n rows; the sweep and the counts share one shuffle by page."""
    w = F.greatest("width", F.lit(1.0))
    left = (F.col("x0") < w * LEFT_BELOW) & (F.col("x1") < w * LEFT_END)
    side = F.when(strip(F.col("text")) != "", F.when(left, "l").when(F.col("x0") > w * LEFT_BELOW, "r").otherwise("-"))
    rows = blocks.select("page_id", "y0", "y1", side.alias("side"))
    down = Window.partitionBy("page_id").orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tall = F.col("y1") - F.col("y0") > OVERLAP
    far = {k: F.max(F.when((F.col("side") == k) & tall, F.col("y1"))).over(down) for k in ("l", "r")}
    met = F.when(F.col("side") == "l", far["r"]).when(F.col("side") == "r", far["l"])
    swept = rows.withColumn("beside", tall & (met - F.col("y0") > OVERLAP))
    by = swept.groupBy("page_id").agg(F.count("side").alias("n"), *[F.count_if(F.col("side") == k).alias(k) for k in ("l", "r")], F.max("beside").alias("beside"))
    enough = (F.col("n") >= BLOCKS) & (F.col("l") >= PER_SIDE) & (F.col("r") >= PER_SIDE)
    return by.select("page_id", (enough & F.coalesce("beside", F.lit(False))).alias("multi_column"))


def dark_ratio(pixels: Column) -> Column:
    """Share of grey values below 230; null for no pixel."""
    return F.try_divide(F.size(F.filter(pixels, lambda p: p < 230)).cast("double"), F.size(pixels))


def route(dark: Column, native: Column, language: Column | str = "en", force: bool = False) -> Column:
    """Where a page's text comes from: ocr_<language>, native_text or skip_near_blank."""
    n = F.length(collapse(native))
    sparse = F.lit(True) if force else n < ROUTED_PAGE
    language = F.lit(language) if isinstance(language, str) else language
    return F.when((dark >= DARK) & sparse, F.concat(F.lit("ocr_"), language)).when(n > 0, F.lit("native_text")).otherwise(F.lit("skip_near_blank"))


def chosen_lines(paddle: Column, viet: Column) -> Column:
    """Of two readings of a page's lines, the first for contact lines, else the second; as many as the shorter has."""

    def chosen(both: Column) -> Column:
        n = F.least(F.size(both["p"]), F.size(both["v"]))
        return F.zip_with(F.slice(both["p"], F.lit(1), n), F.slice(both["v"], F.lit(1), n), lambda p, v: strip(F.when(is_contact_line(p), p).otherwise(v)))

    return F.transform(F.array(F.struct(paddle.alias("p"), viet.alias("v"))), chosen)[0]  # each reading is made once


def profiles(pages: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """(doc_id, text, profile, error) of documents from their pages' native texts and blocks; an error for too many pages."""
    rows = pages.select("doc_id", "page_no", strip(F.coalesce("native_text", F.lit(""))).alias("t"), F.coalesce(F.size("blocks"), F.lit(0)).alias("n"), F.coalesce(multi_column(F.col("blocks"), F.col("width")), F.lit(False)).alias("m"))
    out = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"), F.count_if(F.length("t") >= NATIVE_PAGE).cast("int").alias("native"), F.sum("n").cast("int").alias("blocks"),
        F.bool_or("m").alias("multi"), F.array_sort(F.collect_list(F.struct("page_no", "t"))).alias("p"),
    )
    out = out.withColumn("text", strip(F.array_join(F.filter(F.col("p.t"), lambda t: t != ""), "\n\n"))).withColumn("chars", F.length("text"))
    ocr = (F.col("native") < F.col("page_count")) | (F.col("chars") < NATIVE_DOCUMENT)
    profile = F.struct("page_count", F.col("native").alias("native_text_pages"), F.col("chars").alias("character_count"), F.col("blocks").alias("block_count"), F.col("multi").alias("likely_multi_column"), ocr.alias("needs_ocr"))
    return out.select("doc_id", "text", profile.alias("profile"), F.when(F.col("page_count") > most_pages, F.format_string("more than %d pages", F.lit(most_pages))).alias("error"))


def with_rejected(read: DataFrame, documents: DataFrame) -> DataFrame:
    """read (of profiles or ingested) with a row for each of documents (doc_id, each once, and encrypted, null for no): one
    without pages or an encrypted one has an error and no text, also where its pages were read."""
    rows = documents.select("doc_id", F.coalesce("encrypted", F.lit(False)).alias("is_encrypted")).join(read.withColumn("has_pages", F.lit(True)), "doc_id", "left")
    error = F.when(F.col("is_encrypted"), F.lit("encrypted")).when(F.col("has_pages").isNull(), F.lit("no pages")).otherwise(F.col("error"))
    given = {"text": F.when(~F.col("is_encrypted"), F.col("text")), "error": error}
    return rows.select(*[given.get(c, F.col(c)).alias(c) for c in read.columns])


def ingested(pages: DataFrame, language: str) -> DataFrame:
    """(doc_id, text, page_count, native_text_pages, ocr_pages, character_count, routes, ocr_quality_warning, error) with OCR
    text where a page's native text is short; an error where OCR found nothing, or for too many pages. A document without
    pages has no row here; with_rejected adds it."""
    native = strip(F.coalesce("native_text", F.lit("")))
    rows = pages.withColumn("n", native).withColumn("is_native", F.length("n") >= NATIVE_PAGE)
    ocr_route = F.lit("paddleocr_latin_vi" if language == "vi" else "paddleocr_en")
    rows = rows.withColumn("t", F.when(F.col("is_native"), F.col("n")).otherwise(strip(F.coalesce("ocr_text", F.lit("")))))
    out = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "t", F.when(F.col("is_native"), F.lit("pdf_text")).otherwise(ocr_route).alias("route")))).alias("p"),
        F.count_if("is_native").cast("int").alias("native_text_pages"), F.count_if(~F.col("is_native")).cast("int").alias("ocr_pages"), F.count_if(F.col("t") == "").alias("lost"),
    )
    text = strip(F.array_join(F.filter(F.col("p.t"), lambda t: t != ""), "\n"))
    return out.select(
        "doc_id", text.alias("text"), F.size("p").alias("page_count"), "native_text_pages", "ocr_pages", F.length(text).alias("character_count"), F.col("p.route").alias("routes"),
        (F.lit(language == "vi") & (F.col("ocr_pages") > 0)).alias("ocr_quality_warning"),
        F.when(F.size("p") > MOST_PAGES, F.lit("page count")).when(F.col("lost") > 0, F.lit("OCR found no text on a sparse page")).alias("error"),
    )
