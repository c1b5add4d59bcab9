"""Operators over recognised blocks and pages of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import density, page_text, utf16_units

#: Limits and thresholds.
DENSE, ROW_GAP, LOW_CONFIDENCE = 16, 0.01, 0.5
MOST_UNITS, MOST_BLOCKS, MOST_BLOCK_UNITS, MOST_BYTES = 1_000_000, 10_000, 100_000, 16_777_216


def _order(blocks) -> list:
    """Blocks by rows and within a row from the left; a row begins where a block is too far below the row's first one."""
    text = lambda b: (b["text"] or "").encode("utf-16-be", "surrogatepass")
    size = lambda b: (b["width"], b["height"], text(b))
    rows: list[list] = []
    for b in sorted(blocks, key=lambda b: (b["y"], b["x"], *size(b))):
        if not rows or b["y"] - rows[-1][0]["y"] >= ROW_GAP:
            rows.append([])
        rows[-1].append(b)
    return [b for row in rows for b in sorted(row, key=lambda b: (b["x"], b["y"], *size(b)))]


_BLOCKS = "array<struct<text:string,x:double,y:double,width:double,height:double>>"


def reading_order(blocks: Column) -> Column:
    """array<struct<text, x, y, width, height>> in reading order; the fold over rows is a page's own."""
    return F.pandas_udf(lambda pages: pd.Series([None if p is None else _order(list(p)) for p in pages]), _BLOCKS)(blocks.cast(_BLOCKS))


def block_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n", "")


def block_confidence(lines: Column) -> Column:
    """The mean of finite confidences that aren't negative, from 0 to 1; null where there are none."""
    usable = F.filter(lines, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    mean = F.aggregate(usable, F.lit(0.0), lambda a, x: a + x) / F.size(usable)
    return F.when(F.size(usable) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def low_confidence(confidences: Column) -> Column:
    return F.exists(confidences, lambda x: F.coalesce(x < LOW_CONFIDENCE, F.lit(False)))


def normalized_bounds(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column, flipped: bool = False) -> Column:
    """struct<x, y, width, height> from 0 to 1, cut to the image; flipped: y is given from below."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v.cast("double")))
    left, right = inside(x, image_width) / image_width, inside(x + width, image_width) / image_width
    low, high = inside(y, image_height) / image_height, inside(y + height, image_height) / image_height
    return F.struct(left.alias("x"), (1 - high if flipped else low).alias("y"), (right - left).alias("width"), (high - low).alias("height"))


def page_result(embedded: Column, recognized: Column, blocks: Column) -> Column:
    """struct<method, text, warnings, status>: a page by its embedded text, or where that is sparse, with recognised text.

    Sparse text that equals the recognised is said once, else both follow each other. Pages over the limits are failed.
    """
    own, seen = page_text(F.coalesce(embedded, F.lit(""))), page_text(F.coalesce(recognized, F.lit("")))
    dense = density(own) >= DENSE
    both = F.when(density(own) == 0, seen).when((density(seen) == 0) | (own == seen), own).otherwise(F.concat(own, F.lit("\n"), seen))
    text = F.when(dense, own).otherwise(both)
    over = (utf16_units(text) > MOST_UNITS) | F.coalesce(~dense & ((F.size(blocks) > MOST_BLOCKS) | F.exists(blocks, lambda b: utf16_units(b["text"]) > MOST_BLOCK_UNITS)), F.lit(False))
    warnings = F.array_compact(F.array(F.when(~dense & (density(own) > 0), F.lit("PDF_EMBEDDED_TEXT_SPARSE")), F.when(~dense, F.lit("PDF_PAGE_OCR_FALLBACK")), F.when(density(text) == 0, F.lit("PDF_PAGE_EMPTY"))))
    return F.struct(F.when(dense, "embedded-text").otherwise("ocr").alias("method"), F.when(~over, text).alias("text"), F.when(over, F.array(F.lit("PDF_PAGE_EXTRACTION_FAILED"))).otherwise(warnings).alias("warnings"), F.when(over, "failed").otherwise("complete").alias("status"))


def document_text(pages: DataFrame) -> DataFrame:
    """pages (key, page, status, text) to key, pages, failed_pages, status, text: complete pages in order with a blank line between.

    Any failed page, or too many bytes in all, blocks the text.
    """
    rows = pages.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("page", "status", "text"))).alias("p"))
    bad = F.filter("p", lambda x: x["status"] == "failed")
    joined = F.array_join(F.transform(F.filter("p", lambda x: x["status"] == "complete"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n")
    fits = F.octet_length(joined) <= MOST_BYTES
    return rows.select("key", F.size("p").cast("long").alias("pages"), F.transform(bad, lambda x: x["page"]).alias("failed_pages"), F.when(F.size(bad) > 0, "partial").when(~fits, "blocked").otherwise("ready").alias("status"), F.when((F.size(bad) == 0) & fits, joined).alias("text"))


def render_scale(width: Column, height: Column, low_memory: Column) -> Column:
    """The scale at which a page is drawn: 2,200 pixels a side and a budget of pixels at most."""
    budget = F.when(low_memory, 4_000_000.0).otherwise(8_000_000.0)
    return F.least(F.lit(2200.0) / F.greatest(width, height), F.sqrt(budget / (width * height)))


def pdf_envelope(content: Column) -> Column:
    """Whether bytes begin and end as a PDF does: %PDF- early, %%EOF after startxref late."""
    head, tail = F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.decode(F.right(content, F.lit(4096)), "ISO-8859-1")
    return F.coalesce(F.contains(head, F.lit("%PDF-")) & tail.rlike(r"(?s)startxref(?!.*startxref).*%%EOF"), F.lit(False))


def pdf_encrypted(content: Column) -> Column:
    """Whether the last trailer of a PDF, or the dictionary of its last cross-reference stream, names /Encrypt."""
    tail = F.decode(F.right(content, F.lit(65_536)), "ISO-8859-1")
    last = F.regexp_extract(tail, r"(?s).*(?:\btrailer\b|/Type\s*/XRef\b)(.*?)(?:startxref|$)", 1)
    return F.coalesce(last.rlike(r"/Encrypt\b"), F.lit(False))


def embedded_text(runs: Column) -> Column:
    """struct<text, error_code> of a page's content runs: each cleaned, joined by newlines, failed over the limit."""
    text = F.array_join(F.transform(runs, lambda r: page_text(F.coalesce(r, F.lit("")))), "\n")
    over = utf16_units(text) > MOST_UNITS
    return F.struct(F.when(~over, text).alias("text"), F.when(over, "PDF_PAGE_EXTRACTION_FAILED").alias("error_code"))


def remaining_pages(tasks: DataFrame, committed: DataFrame, retries: DataFrame) -> DataFrame:
    """task_id, page_index, error_code: the pages that a recovered task still has to read.

    tasks: task_id, sha256, script, page_count. committed: the pages of checkpoints, with the identity that each was
    made under (task_id, sha256, script, page_count, page_index, status). retries: task_id, page_index of failed pages
    to read again. A task whose checkpoint has another identity, a page that isn't the document's or comes twice, or
    that is to retry a page that didn't fail, gets one row with PDF_RESULT_INVALID and no page.
    """
    own = committed.groupBy("task_id", "page_index").agg(F.count("*").alias("n"), F.min("status").alias("status"), F.min("sha256").alias("c_sha"), F.min("script").alias("c_script"), F.min("page_count").alias("c_count"))
    again = retries.select(F.col("task_id").alias("r_task"), F.col("page_index").alias("r_page")).distinct()
    both = own.join(again, (F.col("task_id") == F.col("r_task")) & (F.col("page_index") == F.col("r_page")), "full_outer")
    pages = both.select(F.coalesce("task_id", "r_task").alias("p_task"), F.coalesce("page_index", "r_page").alias("p_index"), F.col("task_id").isNotNull().alias("there"), F.col("r_task").isNotNull().alias("retried"), "n", "status", "c_sha", "c_script", "c_count")
    rows = tasks.join(pages, F.col("task_id") == F.col("p_task"), "left")
    same = F.col("c_sha").eqNullSafe(F.col("sha256")) & F.col("c_script").eqNullSafe(F.col("script")) & F.col("c_count").eqNullSafe(F.col("page_count"))
    wrong = F.col("there") & (~same | (F.col("n") > 1) | (F.col("p_index") >= F.col("page_count")) | (F.col("p_index") < 0))
    wrong = F.coalesce(wrong | (F.col("retried") & ~(F.col("there") & (F.col("status") == "failed"))), F.lit(False))
    told = rows.groupBy("task_id", "page_count").agg(F.max(wrong).alias("bad"), F.collect_list(F.when(F.col("there") & ~F.col("retried"), F.col("p_index"))).alias("have"))
    # A document has few pages, so its list of them is short.
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("page_count").cast("long") - 1), F.col("have").cast("array<long>"))
    good = told.filter("not bad and page_count > 0").select("task_id", F.explode(left).alias("page_index"), F.lit(None).cast("string").alias("error_code"))
    return good.unionByName(told.filter("bad").select("task_id", F.lit(None).cast("long").alias("page_index"), F.lit("PDF_RESULT_INVALID").alias("error_code")))


def task_progress(pages: DataFrame) -> DataFrame:
    """pages (task_id, page_count, page_index, status, seq) as they end, to what is said after each: the pages done, and done over all.

    A page that ends again is counted once; checkpoints are what is said last.
    """
    first = pages.groupBy("task_id", "page_count", "page_index").agg(F.min("seq").alias("seq"), F.max_by("status", "seq").alias("status"))
    done = F.count("*").over(Window.partitionBy("task_id").orderBy("seq", "page_index"))
    return first.withColumn("done", done).withColumn("share", F.round(F.col("done") / F.col("page_count"), 6))
