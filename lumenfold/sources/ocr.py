"""Text of stored documents by providers, and its blocks with places and confidences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import trim

# Confidence of a block, the share of readable characters among the first bytes of a text, and boxes.
BLOCK_CONFIDENCE, READABLE, SNIFFED = 0.97, 0.85, 512
MARGIN, WIDTH, LINE, GAP = 60, 760, 18, 14


def recognised(documents: DataFrame, fixtures: DataFrame | None = None) -> DataFrame:
    """documents: (document_id, filename, content binary). Adds text: the content where it reads as UTF-8 text, else the fixture (filename, text) of its name, else empty."""
    head = F.try_to_binary(F.hex(F.substring("content", 1, SNIFFED)), F.lit("hex"))
    sniffed = F.decode(head, "ISO-8859-1")
    printable = F.length(F.regexp_replace(sniffed, r"[^\x09\x0A\x0D\x20-\x7E\x80-\xFF]", "")) / F.greatest(F.length(sniffed), F.lit(1))
    plain = (F.length(sniffed) > 0) & (printable >= READABLE) & F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(plain, F.col("content").cast("string"))
    if fixtures is not None:
        documents = documents.join(fixtures.select("filename", F.col("text").alias("_known")), "filename", "left")
        text = F.coalesce(text, "_known")
    return documents.withColumn("text", F.coalesce(text, F.lit(""))).drop("_known")


@dataclass(frozen=True)
class Provider:
    """Something that reads a text off an object. read: from the columns content, mime_type and filename to the text, null where it finds none; off_box: whether the bytes leave this cluster."""

    name: str
    read: Callable[[Column, Column, Column], Column]
    off_box: bool = False


def read_by(objects: DataFrame, provider: Provider) -> DataFrame:
    """objects: (document_id, filename, mime_type, content, ai_enabled). A row for each: document_id, provider, request_id, raw_text, page_count, confidence and error.

    A provider that sends bytes elsewhere gets null, not the content, of organisations that have not agreed (ai_enabled is
    not true): their rows have the error AI_PROCESSING_NOT_ENABLED. An object without text has no pages and no confidence.
    """
    refused = ~F.coalesce("ai_enabled", F.lit(False)) if provider.off_box else F.lit(False)
    text = F.coalesce(provider.read(F.when(~refused, F.col("content")), F.col("mime_type"), F.col("filename")), F.lit(""))
    rows = objects.select("document_id", "filename", refused.alias("refused"), F.when(refused, "").otherwise(text).alias("raw_text"))
    has = trim(F.col("raw_text")) != ""
    request = F.concat(F.lit(f"{provider.name}-"), F.coalesce("filename", F.lit("")))
    return rows.select("document_id", F.lit(provider.name).alias("provider"), request.alias("request_id"), "raw_text", has.cast("int").alias("page_count"), F.when(has, BLOCK_CONFIDENCE).alias("confidence"), F.when(F.col("refused"), "AI_PROCESSING_NOT_ENABLED").alias("error"))


def blocks(documents: DataFrame) -> DataFrame:
    """documents: (document_id, text). A row per paragraph: document_id, block_no, text, page, its box (x0, y0, x1, y1) and confidence.

    Boxes stand one below the other on a page of WIDTH: LINE for each line, GAP between paragraphs.
    """
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), trim), lambda x: x != "")
    rows = documents.select("document_id", F.posexplode(parts).alias("block_no", "text"))
    height = F.size(F.split("text", "\n")) * LINE
    above = Window.partitionBy("document_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.sum(height + GAP).over(above), F.lit(0)) + MARGIN
    boxes = rows.withColumn("y0", top.cast("int"))
    return boxes.select("document_id", "block_no", "text", F.lit(1).alias("page"), F.lit(MARGIN).alias("x0"), "y0", F.lit(WIDTH).alias("x1"), (F.col("y0") + height).alias("y1"), F.lit(BLOCK_CONFIDENCE).alias("confidence"))
