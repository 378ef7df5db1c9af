"""Whole extractions: stored documents and pasted text, with fields, warnings in order, mean confidence and status.

The rules meet each line once: what they match is kept as a table, from which come fields and warnings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.privacy import has_identifier, mask_identifiers
from ..functions.text import MOST_LINES, PAIR, fixed3, pasted_lines
from ..sources.stored import stored
from . import documents, extraction

# The most characters of pasted text, the longest label, what a label alone must score, the key of a name.
MOST_PASTED, LONGEST_LABEL, SURE_LABEL = 20_000, 60, extraction.EDGE
NAME = "customer.full_name"


def known_label(rules: DataFrame | list[Row]) -> Callable[[Column], Column]:
    """Whether a line by itself reads as a label of some rule."""
    own = [(r["labels"], r["negatives"]) for r in extraction.rule_rows(rules)]

    def known(c: Column) -> Column:
        scores = [extraction.label_score(extraction.plain_label(c), *o) >= SURE_LABEL for o in own]
        any_of = F.lit(False)
        for s in scores:
            any_of |= s
        return any_of & (F.length(c) <= LONGEST_LABEL)

    return known


def paired(rows: DataFrame, column: str, known: Callable[[Column], Column]) -> DataFrame:
    """A label alone in a line and the next line, which is neither a label nor a pair, become one pair; MOST_LINES lines stay.

    A line that was taken is no label itself, so that no choice depends on the one before. Each step is a column of
    its own that the next names twice: inlined, it would be evaluated once for each line.
    """
    told = F.transform(column, lambda x: F.struct(x.alias("text"), (~x.rlike(PAIR)).alias("bare"), known(x).alias("label")))
    follows = lambda a, b: F.coalesce(a["bare"] & a["label"] & b["bare"] & ~b["label"], F.lit(False))
    after = F.zip_with("_told", F.slice("_told", F.lit(2), F.size("_told")), lambda a, b: F.struct(a["text"].alias("text"), b["text"].alias("next"), follows(a, b).alias("joins")))
    taken = F.concat(F.array(F.lit(False)), F.transform("_pairs", lambda p: p["joins"]))
    joined = F.zip_with("_pairs", taken, lambda p, gone: F.when(~gone, F.when(p["joins"], F.concat(p["text"], F.lit(": "), p["next"])).otherwise(p["text"])))
    out = rows.withColumn("_told", told).withColumn("_pairs", after).withColumn(column, F.slice(F.array_compact(joined), 1, MOST_LINES))
    return out.drop("_told", "_pairs")


def _outcome(rows: DataFrame, matched: DataFrame, fields: DataFrame) -> DataFrame:
    """rows (document_id, early: warnings so far, wants_name, no_text, ...) with warnings, confidence and status; a document without text has no further warnings."""
    of_fields = fields.groupBy("document_id").agg(F.count("*").alias("_n"), fixed3(F.avg("confidence")).alias("confidence"), F.bool_or(F.col("key") == NAME).alias("_named"), F.bool_or(F.col("status") == "needs_review").alias("_doubt"))
    misread = matched.where("value is null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "key"))).alias("_bad"))
    out = rows.join(of_fields, "document_id", "left").join(misread, "document_id", "left")
    code = lambda name, key=None: F.struct(F.lit(name).alias("code"), (F.lit(None).cast("string") if key is None else key).alias("key"))
    late = F.array_compact(F.array(F.when(F.col("_n").isNull(), code("NO_FIELDS_FOUND")), F.when(F.col("wants_name") & ~F.coalesce("_named", F.lit(False)), code("NO_NAME_FOUND"))))
    bad = F.transform(F.coalesce("_bad", F.array().cast("array<struct<line_no:int,key:string>>")), lambda b: code("VALUE_NOT_UNDERSTOOD", b["key"]))
    early = F.transform("early", lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("key")))
    warnings = F.when(F.col("no_text"), early).otherwise(F.concat(early, bad, late))
    status = F.when(F.col("_doubt"), "review_required").otherwise("completed")
    return out.withColumns({"warnings": warnings, "status": status, "document_status": F.when(F.col("_doubt"), "review_required").otherwise("extracted")}).drop("_n", "_named", "_doubt", "_bad", "early", "wants_name", "no_text")


def pasted(texts: DataFrame, rules: DataFrame, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """texts: (document_id, text; null: empty). Fields of pasted text, and a row for each text: document_id, line_count, confidence, warnings, status.

    Every rule takes part, or those of the allowed keys; nothing was read off a page, so confidence is the label's own.
    Text beyond MOST_PASTED code points is not read, which a warning tells, as does one of a twelve-digit number.
    """
    rules = extraction.rule_rows(rules)
    own = [Row(**(r.asDict() | {"document_types": None})) for r in rules if allowed is None or r["key"] in allowed]
    text = F.coalesce("text", F.lit(""))
    cut = texts.select("document_id", F.left(text, F.lit(MOST_PASTED)).alias("text"), (F.length(text) > MOST_PASTED).alias("_long"))
    cut = paired(cut.withColumn("_lines", pasted_lines(F.col("text"), None)), "_lines", known_label(rules))
    # cut into lines once, for the fields and for the rows of all texts
    cut = stored(cut.select("document_id", "_lines", "_long", F.coalesce(has_identifier(F.col("text")), F.lit(False)).alias("_numbered")))
    lines = documents.lines(cut.select("document_id", F.array_join("_lines", "\n").alias("text"))).withColumns({"document_type": F.lit("generic"), "ocr_confidence": F.lit(1.0)})
    matched = stored(extraction.matched_lines(lines, own))
    fields = extraction.extract_fields(lines, own, matched)
    empty = F.size("_lines") == 0
    early = F.array_compact(F.array(F.when(F.col("_long"), "TEXT_TRUNCATED"), F.when(F.col("_numbered"), "AADHAAR_REMOVED"), F.when(empty, "NO_TEXT")))
    wants = F.lit(any(r["key"] == NAME for r in own))
    rows = cut.select("document_id", F.size("_lines").alias("line_count"), early.alias("early"), wants.alias("wants_name"), empty.alias("no_text"))
    return fields, _outcome(rows, matched, fields).drop("document_status")


def extracted(objects: DataFrame, signals: DataFrame, rules: DataFrame, local: Callable[[Column], Column], remote: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """objects: (document_id, content, filename, mime_type, hinted_type, ai_enabled). Fields, and a row for each document: document_id, document_type, classification_confidence, raw_text, confidence, warnings, status, document_status.

    local and remote read a text from content. A remote reader gets null, not the content, where the organisation has
    not agreed (ai_enabled is not true); the local one takes its place and a warning says so. raw_text has identifiers masked.
    """
    rules = extraction.rule_rows(rules)
    agreed = F.coalesce("ai_enabled", F.lit(False))
    text = local(F.col("content"))
    if remote is not None:
        text = F.when(agreed, remote(F.when(agreed, F.col("content")))).otherwise(text)
    read = objects.select("document_id", text.alias("text"), "filename", "mime_type", "hinted_type", (F.lit(remote is not None) & ~agreed).alias("_kept_here"))
    # read and classified once, for the lines and for the rows of all documents
    typed = stored(documents.classify(read, signals).select("document_id", "text", "document_type", "confidence", "_kept_here"))
    lines = documents.lines(typed, keep=("document_type",)).withColumn("ocr_confidence", F.lit(1.0))
    matched = stored(extraction.matched_lines(lines, rules))
    fields = extraction.extract_fields(lines, rules, matched)
    early = F.array_compact(F.array(F.when(F.col("_kept_here"), "AI_PROCESSING_NOT_ENABLED"), F.when(F.col("document_type") == "unknown", "UNKNOWN_DOCUMENT_TYPE")))
    wants = F.lit(False)
    for r in (r for r in rules if r["key"] == NAME):
        wants |= F.lit(True) if r["document_types"] is None else F.col("document_type").isin(*r["document_types"])
    rows = typed.select("document_id", "document_type", F.col("confidence").alias("classification_confidence"), mask_identifiers(F.coalesce("text", F.lit(""))).alias("raw_text"), early.alias("early"), wants.alias("wants_name"), F.lit(False).alias("no_text"))
    return fields, _outcome(rows, matched, fields)
