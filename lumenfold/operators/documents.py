"""Documents: class by signal phrases, lines as label and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import WS, trim
from ..functions.text import confidence
from ..sources.tables import constants

STRONG, WEAK, FILENAME, HINT = 3, 1, 2, 2
FLOOR, CLOSE, SHORT = 0.45, 0.05, 24


def classify(documents: DataFrame, signals: DataFrame) -> DataFrame:
    """documents: (document_id, text, filename, mime_type, hinted_type); signals: (class_no, document_type, strong, weak, filename_words), a row for each class.

    Adds document_type, confidence and alternatives (three at most). Every phrase counts once; a text of fewer than
    SHORT characters that is no PDF is a photo or a signature; a weak or undecided result is 'unknown'.
    The signals are a few rows of constants and become array literals of the plan: no join, no shuffle.
    """
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"{WS}+", " ")
    name = F.regexp_replace(F.lower(F.coalesce("filename", F.lit(""))), r"[^a-z0-9\u0900-\u097f]", "")
    # columns of their own: an expression repeated within a higher-order function is evaluated each time
    documents, text, name = documents.withColumns({"_text": text, "_name": name}), F.col("_text"), F.col("_name")
    hits = lambda hay, words: sum((F.contains(hay, F.lit(w)).cast("int") for w in words), F.lit(0))
    classes, raws = [], {}
    for s in sorted(constants(signals), key=lambda s: s["class_no"]):
        raw = hits(text, s["strong"]) * STRONG + hits(text, s["weak"]) * WEAK + hits(name, s["filename_words"]) * FILENAME
        raw += F.when(F.col("hinted_type") == s["document_type"], HINT).otherwise(0)
        raws[f"_raw{len(raws)}"] = raw  # in a column of its own, as what is made of it names it twice
        classes.append(F.struct((-confidence(F.col(list(raws)[-1]))).alias("c"), F.lit(s["class_no"]).alias("n"), F.lit(s["document_type"]).alias("t")))
    scored = F.array_sort(F.filter(F.array(*classes), lambda x: x["c"] < 0))
    rows = documents.withColumns(raws).withColumn("_s", scored)
    at = lambda i: F.get("_s", F.lit(i))
    best, second = -at(0)["c"], -at(1)["c"]
    bare = (F.length(trim(F.coalesce("text", F.lit("")))) < SHORT) & ~F.col("mime_type").eqNullSafe(F.lit("application/pdf"))
    picture = F.coalesce(at(0)["t"].isin("photo", "signature"), F.lit(False))
    unsure = best.isNull() | (best < FLOOR) | F.coalesce(best - second < CLOSE, F.lit(False))
    kind = F.when(bare, F.when(picture, at(0)["t"]).otherwise("photo")).when(unsure, "unknown").otherwise(at(0)["t"])
    sure = F.when(bare & ~picture, 0.5).otherwise(F.coalesce(best, F.lit(0.0)))
    rows = rows.withColumns({"document_type": kind, "confidence": sure})
    others = F.slice(F.filter("_s", lambda x: x["t"] != F.col("document_type")), 1, 3)
    return rows.withColumn("alternatives", F.transform(others, lambda x: F.struct(x["t"].alias("document_type"), (-x["c"]).alias("confidence")))).drop("_s", "_text", "_name", *raws)


#: A label of 2 to 60 characters, then a colon, an equals sign, two blanks or a dash between blanks, then a value.
LABEL_VALUE = rf"^(.{{2,60}}?){WS}*(?::|=|{WS}{{2,}}|{WS}[-–—]{WS}){WS}*(.+)$"


def lines(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """documents: (document_id, text). A row per line that is not empty: document_id, line_no, raw, label and value (null where the line is no pair), and the columns to keep."""
    rows = documents.select("document_id", *keep, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "raw"))
    rows = rows.withColumn("raw", trim(F.col("raw"))).where("raw <> ''").withColumn("_pair", F.col("raw").rlike(LABEL_VALUE))
    part = lambda i: F.when(F.col("_pair"), trim(F.regexp_extract("raw", LABEL_VALUE, i)))
    return rows.withColumns({"label": part(1), "value": part(2)}).drop("_pair")


def best_by_key(fields: DataFrame) -> DataFrame:
    """fields: (document_id, key, confidence, line_no, ...). The most confident field of each key, the earliest line among equals."""
    order = Window.partitionBy("document_id", "key").orderBy(F.desc("confidence"), "line_no")
    return fields.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
