"""Fields of documents: label rules over lines, values by kind, identifiers without a label, the last gate.

Rules are rows of constants (rule_no, key, kind, labels, negatives, document_types, high_risk). They become
expressions of a projection: lines are neither joined with them nor shuffled until one field of a key is chosen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.privacy import mask_identifiers
from ..functions.text import fixed3
from ..sources.tables import constants
from .documents import best_by_key

RULES = "rule_no int, key string, kind string, labels array<string>, negatives array<string>, document_types array<string>, high_risk boolean"
FIELDS = ("document_id", "line_no", "key", "label", "value", "confidence", "source_text", "status", "review_reason")

# How well a label matches, what doubt costs, the bands of confidence, the longest texts.
EXACT, EDGE, WORD = 0.95, 0.88, 0.80
AMBIGUOUS, INVALID, SAME = 0.75, 0.6, 0.01
UNLABELLED, HIGH, MEDIUM = 0.85, 0.9, 0.7
MOST_LABEL, MOST_SOURCE, MOST_TEXT, MOST_LONG_TEXT = 200, 500, 200, 500
# Printed words of a gender and of a category.
GENDERS = {
    "male": ("m", "male", "पुरुष"),
    "female": ("f", "female", "महिला", "स्त्री"),
    "transgender": ("t", "transgender", "ट्रांसजेंडर"),
    "other": ("other", "अन्य"),
}
CATEGORIES = {
    "general": ("general", "gen", "ur", "सामान्य"),
    "obc": ("obc", "other backward class", "अन्य पिछड़ा वर्ग", "ओबीसी"),
    "sc": ("sc", "scheduled caste", "अनुसूचित जाति"),
    "st": ("st", "scheduled tribe", "अनुसूचित जनजाति"),
    "ews": ("ews", "ईडब्ल्यूएस"),
}
_LETTER = r"a-zऀ-ॿ"


def rule_rows(rules: DataFrame | list[Row]) -> list[Row]:
    """The rules in their order, read once; rows that were read already stay."""
    return rules if isinstance(rules, list) else sorted(constants(rules), key=lambda r: r["rule_no"])


def _named(c: Column, names: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in names.items():
        out = F.when(c.isin(*words), name).otherwise(out)
    return out


def _collapsed(c: Column) -> Column:
    return N.trim(F.regexp_replace(c, f"{N.WS}+", " "))


def plain_label(c: Column) -> Column:
    """A printed label in lower case, without marks."""
    return _collapsed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[*_|]", " "))


def label_score(label: Column, labels: list[str], negatives: list[str] | None) -> Column:
    """How well a label (lower case, blanks collapsed) meets a rule; 0 where it does not or where a negative word occurs."""
    words = sorted({x for x in labels if x}, key=len, reverse=True)
    if not words:
        return F.lit(0.0)
    any_of = "(?:" + "|".join(map(re.escape, words)) + ")"
    bounded = rf"(?:^|[^{_LETTER}]){any_of}(?:$|[^{_LETTER}])"
    met = F.when(label.isin(*words), EXACT).when(label.rlike(f"^{any_of}|{any_of}$"), EDGE).when(label.rlike(bounded), WORD).otherwise(0.0)
    for word in negatives or ():
        met = F.when(F.contains(label, F.lit(word)), 0.0).otherwise(met)
    return met


def normalize_value(raw: Column, kind: Column) -> Column:
    """struct(value, valid) of a raw value by kind: name, date, mobile, pincode, pan, aadhaar (last four digits), number, year, gender, category, longtext; else text."""
    t = N.trim(F.coalesce(raw, F.lit("")))
    value = F.left(t, F.lit(MOST_TEXT))
    for name, own in _by_kind(t).items():
        value = F.when(kind == name, own).otherwise(value)
    value = F.when(t != "", value)
    return F.struct(value.alias("value"), value.isNotNull().alias("valid"))


def _by_kind(t: Column) -> dict[str, Column]:
    """The value of a trimmed text for each kind but plain text."""
    name = N.normalize_name(t)["value"]
    amount = F.regexp_replace(F.regexp_replace(t, rf"(?:[,₹]|{N.WS})", ""), "/-$", "")
    found = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
    category = _collapsed(F.lower(t))
    whole = {"name": F.when(~name.rlike("[0-9]{3}"), name), "mobile": N.normalize_mobile(t)["value"], "pincode": N.normalize_pincode(t)["value"], "pan": N.normalize_pan(t)["value"]}
    whole |= {"date": N.parse_date(t)["value"], "aadhaar": N.last_four(t), "number": found(amount, r"^[0-9]+(?:\.[0-9]+)?$"), "year": found(t, r"(?<![0-9A-Za-z_])(?:19|20)[0-9]{2}(?![0-9A-Za-z_])")}
    whole |= {"gender": _named(F.regexp_replace(F.lower(t), f"[^{_LETTER}]", ""), GENDERS), "category": F.coalesce(_named(category, CATEGORIES), _named(F.replace(category, F.lit(" ")), CATEGORIES))}
    return whole | {"longtext": F.left(t, F.lit(MOST_LONG_TEXT))}


def _with_value(rows: DataFrame, kinds: set[str]) -> DataFrame:
    """rows with _value, the value of their kind (_top.kind), for rules of the given kinds only.

    Each kind has a column of its own, so that its expression stands once in the plan and is compiled; the value
    passes through explode, as the optimizer would else repeat those expressions in every filter on it.
    """
    kind, text = F.col("_top.kind"), F.left("_trimmed", F.lit(MOST_TEXT))
    own = {f"_as_{k}": (k, v) for k, v in _by_kind(F.col("_trimmed")).items() if k in kinds}
    rows = rows.withColumn("_trimmed", N.trim(F.coalesce("value", F.lit(""))))
    rows = rows.withColumns({c: F.when(kind == k, v) for c, (k, v) in own.items()})
    plain = F.when(~kind.isin(*[k for k, _ in own.values()]), text) if own else text
    value = F.when(F.col("_trimmed") != "", F.coalesce(*own, plain))
    return rows.withColumn("_value", F.explode(F.array(value))).drop("_trimmed", *own)


def review_reason(confidence: Column, valid: Column, high_risk: Column, ambiguous: Column) -> Column:
    """Why a person has to look at a field; null: nobody has to. The first that holds, a doubtful rule before all."""
    return F.when(ambiguous, "ambiguous_match").when(~valid, "format_invalid").when(high_risk, "high_risk_field").when(confidence < MEDIUM, "low_confidence").when(confidence < HIGH, "medium_confidence")


def matched_lines(lines: DataFrame, rules: DataFrame | list[Row]) -> DataFrame:
    """lines: (document_id, line_no, raw, label, value, document_type, ocr_confidence). Every line that a rule claims, as a field.

    A rule holds for documents of its document_types, or for all where that is null. The best rule claims a line, the
    first of equals; a second one as good makes it ambiguous. value is null where it was not understood.
    """
    rows = lines.withColumn("_label", plain_label(F.col("label"))).where("_label <> '' and value <> ''")
    claims, known = [], rule_rows(rules)
    for r in known:
        score = label_score(F.col("_label"), r["labels"], r["negatives"])
        if r["document_types"] is not None:
            score = F.when(F.col("document_type").isin(*r["document_types"]), score).otherwise(0.0) if r["document_types"] else F.lit(0.0)
        claims.append(F.struct((-score).alias("s"), F.lit(r["rule_no"]).alias("n"), F.lit(r["key"]).alias("key"), F.lit(r["kind"]).alias("kind"), F.lit(bool(r["high_risk"])).alias("risk")))
    if not claims:
        claims = [F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit("").alias("key"), F.lit("").alias("kind"), F.lit(False).alias("risk"))]
    rows = rows.withColumn("_claims", F.slice(F.array_sort(F.filter(F.array(*claims), lambda x: x["s"] < 0)), 1, 2)).where("size(_claims) > 0")
    top, next_one = F.get("_claims", F.lit(0)), F.get("_claims", F.lit(1))
    rows = rows.withColumns({"_top": top, "_ambiguous": F.coalesce(next_one["s"] - top["s"] < SAME, F.lit(False))})
    rows = _with_value(rows, {r["kind"] for r in known}).withColumn("_valid", F.col("_value").isNotNull())
    bounded = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    sure = -F.col("_top.s") * bounded(F.col("ocr_confidence")) * F.when(F.col("_ambiguous"), AMBIGUOUS).otherwise(1.0) * F.when(F.col("_valid"), 1.0).otherwise(INVALID)
    rows = rows.withColumn("confidence", fixed3(bounded(sure)))
    reason = review_reason(F.col("confidence"), F.col("_valid"), F.col("_top.risk"), F.col("_ambiguous"))
    rows = rows.withColumn("review_reason", reason)
    status = F.when(F.col("review_reason").isNull(), "ok").otherwise("needs_review")
    return rows.select("document_id", "line_no", F.col("_top.key").alias("key"), F.left("label", F.lit(MOST_LABEL)).alias("label"), F.col("_value").alias("value"), "confidence", F.left("raw", F.lit(MOST_SOURCE)).alias("source_text"), status.alias("status"), "review_reason")


def unlabelled_identifiers(lines: DataFrame) -> DataFrame:
    """A PAN, or twelve digits whose checksum holds (their last four), anywhere in a line; always for review."""
    pan = F.regexp_extract(F.upper("raw"), r"(?<![0-9A-Za-z_])[A-Z]{5}[0-9]{4}[A-Z](?![0-9A-Za-z_])", 0)
    twelve = F.regexp_extract("raw", rf"(?<![0-9])[0-9]{{4}}(?:{N.WS}|-)?[0-9]{{4}}(?:{N.WS}|-)?[0-9]{{4}}(?![0-9])", 0)
    found = F.array(
        F.when(pan != "", F.struct(F.lit("customer.pan").alias("key"), F.lit("PAN").alias("label"), pan.alias("value"))),
        F.when(N.passes_verhoeff(twelve), F.struct(F.lit("customer.aadhaar_last4").alias("key"), F.lit("Aadhaar").alias("label"), N.last_four(twelve).alias("value"))),
    )
    rows = lines.select("document_id", "line_no", "raw", F.explode(F.array_compact(found)).alias("f"))
    return rows.select("document_id", "line_no", "f.*", F.lit(UNLABELLED).alias("confidence"), F.left("raw", F.lit(MOST_SOURCE)).alias("source_text"), F.lit("needs_review").alias("status"), F.lit("high_risk_field").alias("review_reason"))


def sanitize(fields: DataFrame, forbidden: tuple[str, ...] = ("customer.aadhaar",)) -> DataFrame:
    """fields without forbidden keys and without empty values; twelve-digit numbers keep their last four digits in value and source."""
    value = F.when(F.col("key") == "customer.aadhaar_last4", N.last_four(F.col("value"))).otherwise(mask_identifiers(F.col("value")))
    kept = fields.where(~F.col("key").isin(*forbidden)) if forbidden else fields
    return kept.withColumns({"value": value, "source_text": mask_identifiers(F.col("source_text"))}).where(N.trim(F.col("value")) != "")


def extract_fields(lines: DataFrame, rules: DataFrame | list[Row], matched: DataFrame | None = None) -> DataFrame:
    """One field of each key of a document (FIELDS): the most confident line, else an identifier found without a label.

    matched: matched_lines of these lines and rules, where it has been made already. Identifiers are sought only for keys that some rule allows in the document's class. Empty tables give no rows.
    """
    rules = rule_rows(rules)
    matched = matched_lines(lines, rules) if matched is None else matched
    named = best_by_key(matched.where("value is not null"))
    allowed = F.lit(False)
    for r in (r for r in rules if r["key"] in ("customer.pan", "customer.aadhaar_last4")):
        here = F.lit(True) if r["document_types"] is None else F.col("document_type").isin(*r["document_types"])
        allowed |= (F.col("key") == r["key"]) & here
    kinds = lines.groupBy("document_id").agg(F.min("document_type").alias("document_type"))
    found = unlabelled_identifiers(lines).join(kinds, "document_id").where(F.coalesce(allowed, F.lit(False)))
    found = best_by_key(found.select(*FIELDS)).join(named.select("document_id", "key"), ["document_id", "key"], "left_anti")
    return sanitize(named.select(*FIELDS).unionByName(found.select(*FIELDS)))


def warnings(lines: DataFrame, rules: DataFrame | list[Row]) -> DataFrame:
    """(document_id, code, key): lines whose value was not understood."""
    return matched_lines(lines, rules).where("value is null").select("document_id", F.lit("VALUE_NOT_UNDERSTOOD").alias("code"), "key")


def mean_confidence(fields: DataFrame) -> DataFrame:
    return fields.groupBy("document_id").agg(fixed3(F.avg("confidence")).alias("mean_confidence"))
