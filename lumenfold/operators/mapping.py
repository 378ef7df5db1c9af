"""From detected form fields to a proposal: what is filled, from where, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import transformed

HIGH, MEDIUM = 0.9, 0.7

# Input types that can be filled; the empty one is an element without a type.
SUPPORTED = ("text", "email", "tel", "number", "date", "datetime-local", "month", "week", "time", "color", "range", "search", "url", "select-one", "select-multiple", "radio", "checkbox", "textarea", "contenteditable", "combobox", "listbox", "custom-select", "switch", "slider", "spinbutton", "textbox", "custom-checkbox", "custom-radio", "")
# Why fields of an unsafe class are skipped.
UNSAFE = {"captcha": "captcha_field", "otp": "otp_field", "payment": "payment_field"}


def with_overrides(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """fields (signature, origin, ...) with override_field and override_transform of the organisation's own mapping; overrides: (signature, origin, ordinal, customer_field, transform), the first holds."""
    return fields.join(_first(overrides, "override", "signature", "origin"), ["signature", "origin"], "left")


def with_history(fields: DataFrame, history: DataFrame) -> DataFrame:
    """fields with history_field, history_transform and confirmations of what was accepted before; history: (signature, ordinal, customer_field, transform, confirmations)."""
    return fields.join(_first(history, "history", "signature"), "signature", "left")


def _first(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.min(F.struct("ordinal", *[c for c in rows.columns if c not in (*keys, "ordinal")])).alias("_b")).select(*keys, "_b.*").drop("ordinal")
    return best.withColumnsRenamed({"customer_field": f"{name}_field", "transform": f"{name}_transform"})


def with_verified(values: DataFrame, verified: DataFrame) -> DataFrame:
    """values: (customer_id, customer_field, value) overlaid by verified ones of the same shape."""
    both = values.join(verified.withColumnRenamed("value", "_v"), ["customer_id", "customer_field"], "full")
    return both.select("customer_id", "customer_field", F.coalesce("_v", "value").alias("value"))


def _skip(overwrite: bool) -> Column:
    kind = F.lower(F.coalesce("input_type", F.lit("")))
    unsafe = F.element_at(F.create_map(*[F.lit(x) for kv in UNSAFE.items() for x in kv]), F.col("safety_class"))
    out = F.when(F.col("safety_class") != "normal", F.coalesce(unsafe, F.lit("submit_control")))
    out = out.when(kind.isin("password", "file") | (~kind.isin(*SUPPORTED) & (F.col("tag_name") == "input")), "unsupported_type")
    out = out.when(~F.col("visible"), "not_visible").when(F.col("disabled"), "disabled").when(F.col("read_only"), "readonly")
    return out if overwrite else out.when(F.col("has_value"), "already_filled")


def propose(fields: DataFrame, values: DataFrame, high_risk: list[str], unverified: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """A mapping for every detected field.

    fields: (page_id, signature, customer_id, tag_name, input_type, safety_class, visible, disabled, read_only,
    has_value, adapter_status, adapter_field, adapter_transform, adapter_review, override_field, override_transform,
    history_field, history_transform, confirmations, dictionary_field, dictionary_transform, dictionary_score);
    values: (customer_id, customer_field, value); unverified: (customer_id, customer_field).

    Safety comes first, then what cannot be written to, then adapter, own mapping, history and dictionary in that
    order. Adds customer_field, source, confidence, transform, value, skip_reason and review_required. A mapping
    without a value or of low confidence keeps its field and says so in skip_reason.
    """
    choice = lambda name, source, sure: F.when(F.col(f"{name}_field").isNotNull(), F.struct(F.col(f"{name}_field").alias("customer_field"), F.lit(source).alias("source"), sure.cast("double").alias("confidence"), F.col(f"{name}_transform").alias("transform")))
    past = F.round(F.least(F.lit(0.95), 0.85 + F.col("confirmations") * 0.02), 3)
    picked = F.coalesce(choice("adapter", "adapter", F.when(F.col("adapter_status") == "active", 0.99).otherwise(0.9)), choice("override", "org_custom", F.lit(0.98)), choice("history", "history", past), choice("dictionary", "dictionary", F.col("dictionary_score")))
    rows = fields.withColumn("_skip", _skip(overwrite)).withColumn("_p", F.when(F.col("_skip").isNull(), picked))
    rows = rows.select("*", "_p.*").drop("_p").join(values.select("customer_id", "customer_field", F.col("value").alias("_raw")), ["customer_id", "customer_field"], "left")
    rows = rows.withColumn("value", F.nullif(transformed(F.col("transform"), F.col("_raw")), F.lit("")))
    if unverified is None:
        rows = rows.withColumn("_open", F.lit(False))
    else:
        rows = rows.join(unverified.select("customer_id", "customer_field", F.lit(True).alias("_open")).distinct(), ["customer_id", "customer_field"], "left")
    mapped, empty = F.col("customer_field").isNotNull(), F.col("value").isNull()
    skip = F.coalesce("_skip", F.when(~mapped, "no_mapping").when(empty, "no_value").when(F.col("confidence") < MEDIUM, "low_confidence"))
    review = F.col("customer_field").isin(high_risk) | (F.col("confidence") < HIGH) | F.coalesce("_open", F.lit(False)) | F.coalesce(F.col("adapter_field").isNotNull() & F.col("adapter_review"), F.lit(False))
    rows = rows.withColumn("skip_reason", skip).withColumn("review_required", mapped & ~empty & review)
    return rows.drop("_skip", "_raw", "_open")


def summary(mappings: DataFrame) -> DataFrame:
    """Eight counts by page."""
    has, fillable = F.col("customer_field").isNotNull(), F.col("skip_reason").isNull() & F.col("customer_field").isNotNull()
    of = lambda kind: F.count_if(F.col("safety_class") == kind).alias(kind)
    return mappings.groupBy("page_id").agg(F.count("*").alias("detected"), F.count_if(has).alias("proposed"), F.count_if(fillable & ~F.col("review_required")).alias("ready_to_fill"), F.count_if(fillable & F.col("review_required")).alias("needs_review"), F.count("skip_reason").alias("skipped"), of("captcha"), of("otp"), of("payment"))


def fill_order(mappings: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """mappings: (page_id, signature, ordinal, slug, adapter_key). Adds place: a page's order of detection, fields that depend on others after them (depths: slug, key, depth)."""
    rows = mappings.withColumn("_d", F.lit(0)) if depths is None else mappings.join(depths.select("slug", F.col("key").alias("adapter_key"), F.col("depth").alias("_d")), ["slug", "adapter_key"], "left")
    order = Window.partitionBy("page_id").orderBy(F.coalesce("_d", F.lit(0)), "ordinal")
    return rows.withColumn("place", F.row_number().over(order)).drop("_d")


def ranked(instructions: DataFrame, order: DataFrame) -> DataFrame:
    """instructions: (page_id, signature, ordinal, ...) with place by an order given from outside (page_id, signature, rank); what it does not name comes last, as it was."""
    rows = instructions.join(order.groupBy("page_id", "signature").agg(F.max("rank").alias("_r")), ["page_id", "signature"], "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("_r").asc_nulls_last(), "ordinal"))).drop("_r")
