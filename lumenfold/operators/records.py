"""Customer profiles: patches, provenance, flattening and reads of JSON members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import quote, with_values
from ..functions.normalize import trim
from ..functions.privacy import redact_json


def member(document: Column, path: str) -> Column:
    """The member of a JSON text at a dotted path, as text: strings that are not blank, numbers, booleans; null for all else."""
    value = F.try_variant_get(F.try_parse_json(document), "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind.rlike("^(OBJECT|ARRAY|VOID)"), None).otherwise(F.when(trim(text) != "", text))


def routed(values: DataFrame, registry: DataFrame, forbidden: list[str]) -> DataFrame:
    """values: (customer_id, key, value); registry: (key, kind: column, json, encrypted or derived; target; path).

    Adds patch (column, json or encrypted; null where skipped), the trimmed value (blank: null) and skip_reason.
    """
    rows = values.join(registry, "key", "left")
    reason = F.when(F.col("key").isin(forbidden), "forbidden").when(F.col("kind").isNull(), "unknown_field").when(F.col("kind") == "derived", "derived").when(~F.col("kind").isin("column", "json", "encrypted"), "unknown_field")
    return rows.select("customer_id", "key", F.nullif(trim(F.col("value")), F.lit("")).alias("value"), "target", "path", reason.alias("skip_reason"), F.when(reason.isNull(), F.col("kind")).alias("patch"))


def patched(profiles: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """profiles with the columns that routed() changes name set to their values; of several changes to a column the last key holds."""
    of = lambda c: F.max_by(F.struct("value"), F.when(F.col("target") == c, F.col("key"))).alias(f"_{c}")
    news = changes.where("patch = 'column'").groupBy("customer_id").agg(*[of(c) for c in columns])
    rows = profiles.join(news, "customer_id", "left")
    held = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(held).drop(*[f"_{c}" for c in columns])


def json_patched(profiles: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """profiles with members of a JSON column set by routed() changes at dotted paths of any length.

    Changes are made in the order of their keys, those of one key in that of their values. Members that no change names
    keep their bytes; a column that no change names stays as it is; one that is no JSON object counts as an empty one.
    """
    own = changes.where((F.col("patch") == "json") & (F.col("target") == column)).select("customer_id", "key", F.split("path", r"\.").alias("path"), quote(F.col("value")).alias("raw"))
    levels = own.agg(F.max(F.size("path"))).head()[0] or 1
    # as many as the registry has fields
    news = own.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("key", "path", "raw"))).alias("_new"))
    rows = profiles.join(news, "customer_id", "left")
    return rows.withColumn(column, F.when(F.col("_new").isNull(), F.col(column)).otherwise(with_values(F.col(column), F.col("_new"), levels))).drop("_new")


def provenance(decisions: DataFrame, encrypted: list[str], seal, masks: dict[str, object], user: str) -> DataFrame:
    """decisions: (org, customer_id, key, action: accept, edit or reject; value, confidence, document_id). One row each: a sealed value is not kept in plain, a rejected one not at all.

    seal: from a Column to its sealed form; masks: by key, from a Column to what is shown.
    """
    taken, sealed = F.col("action") != "reject", F.col("key").isin(encrypted)
    shown = F.col("value")
    for key, mask in masks.items():
        shown = F.when(F.col("key") == key, mask(F.col("value"))).otherwise(shown)
    return decisions.select("org", "customer_id", F.col("key").alias("field_key"), F.when(taken & ~sealed, F.col("value")).alias("value_text"), F.when(taken & sealed, seal(F.col("value"))).alias("value_encrypted"), F.when(taken, shown).alias("display_value"), F.col("document_id").alias("source_document_id"), F.when(taken, F.col("confidence")).alias("confidence"), F.when(taken, "operator_verified").otherwise("rejected").alias("status"), F.lit(user).alias("created_by"))


def flattened(profiles: DataFrame, registry: list[tuple[str, str, str, str | None]], masks: dict[str, object] | None = None) -> DataFrame:
    """(customer_id, key, value) of every registered field that has a value. registry: (key, kind: column or json, column, path); masks as in provenance."""
    of = lambda key, kind, column, path: member(F.col(column), path) if kind == "json" else F.when(trim(F.col(column).cast("string")) != "", F.col(column).cast("string"))
    mask = lambda key, value: (masks or {}).get(key, lambda v: v)(value)
    items = F.array(*[F.struct(F.lit(r[0]).alias("key"), mask(r[0], of(*r)).alias("value")) for r in registry])
    return profiles.select("customer_id", F.inline(items)).where("value is not null")


def audit_rows(events: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """events: (org, actor, action, entity_type, entity_id, metadata: JSON text); actions: (action, sensitivity), a small table. Rows to append: sensitivity by the catalogue (normal where it lacks the action), secrets in metadata redacted."""
    rows = events.join(actions.select("action", "sensitivity"), "action", "left")
    return rows.select("org", "actor", "action", "entity_type", "entity_id", F.coalesce("sensitivity", F.lit("normal")).alias("sensitivity"), redact_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata"), as_of.alias("created_at"))


def usage_rows(taken: DataFrame, as_of: Column) -> DataFrame:
    """taken: (org, user_id, event_type, quantity). Rows to append to usage: one unit unless told otherwise, billable."""
    return taken.select("org", "user_id", "event_type", F.coalesce("quantity", F.lit(1)).alias("quantity"), F.lit(True).alias("billable"), as_of.alias("created_at"))


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows to a table of Parquet files."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
