"""Usage metering and entitlement decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN_SCHEMA = "plan_code string, price int, fills int, ai_extractions int, seats int, customers int, storage_mb int, api_access boolean"
# Plans by code; a null allowance is unlimited.
PLANS = [
    ("free", 0, 25, 10, 1, 50, 200, False),
    ("starter", 299, 300, 100, 2, 1000, 2000, False),
    ("professional", 599, 1000, 400, 4, 5000, 10000, False),
    ("business", 999, None, 1500, 10, None, 50000, False),
]
PAID_UP = ("active", "trialing")
SECONDS_PER_FIELD = 12


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, PLAN_SCHEMA)


def month_start(as_of: Column) -> Column:
    return F.date_trunc("month", as_of)


def usage_since(usage: DataFrame, since: Column) -> DataFrame:
    """usage: (org, event_type, quantity, billable, created_at). Billable quantities by organisation and kind."""
    return usage.where(F.col("billable") & (F.col("created_at") >= since)).groupBy("org", "event_type").agg(F.sum("quantity").cast("long").alias("total"))


def decisions(subscriptions: DataFrame, usage: DataFrame, quantity: int = 1) -> DataFrame:
    """Whether each organisation may take quantity more of each metered kind.

    subscriptions: (org, plan_code, status); usage: (org, event_type, total), kinds fill, ai_extraction, seat,
    storage, document_tool. Unknown plans count as free; the free plan is always paid up; no allowance means
    unlimited; document tools are not metered. Adds allowed, remaining and reason.
    """
    known = plans(subscriptions.sparkSession)
    code = F.when(F.col("plan_code").isin([p[0] for p in PLANS]), F.col("plan_code")).otherwise("free")
    rows = usage.join(subscriptions.withColumn("plan_code", code), "org").join(F.broadcast(known), "plan_code")
    included = F.when(F.col("event_type") == "fill", F.col("fills")).when(F.col("event_type") == "ai_extraction", F.col("ai_extractions")).when(F.col("event_type") == "seat", F.col("seats")).when(F.col("event_type") == "storage", F.col("storage_mb"))
    label = F.when(F.col("event_type") == "fill", "fills").when(F.col("event_type") == "ai_extraction", "ai_extractions").when(F.col("event_type") == "seat", "seats").otherwise("storage")
    unpaid = (F.col("plan_code") != "free") & ~F.coalesce(F.col("status").isin(*PAID_UP), F.lit(False))
    left = included - F.coalesce("total", F.lit(0))
    reason = F.when(unpaid, "payment_required").when(left < quantity, label)
    remaining = F.when(reason.isNotNull(), F.lit(0)).otherwise(left - quantity).cast("long")
    return rows.select("org", "plan_code", "event_type", "total", reason.isNull().alias("allowed"), remaining.alias("remaining"), reason.alias("reason"))


def usage_ratios(used: DataFrame) -> DataFrame:
    """used: (org, plan_code, fills_used, ai_used, seats_used, customers_used, storage_used). A row per allowance: item, used, included, ratio (null: unlimited or 0)."""
    rows = used.join(F.broadcast(plans(used.sparkSession)), "plan_code")
    pairs = {"fill": ("fills_used", "fills"), "ai_extraction": ("ai_used", "ai_extractions"), "seat": ("seats_used", "seats"), "customers": ("customers_used", "customers"), "storage_mb": ("storage_used", "storage_mb")}
    items = F.array(*[F.struct(F.lit(k).alias("item"), F.col(u).cast("long").alias("used"), F.col(i).cast("long").alias("included")) for k, (u, i) in pairs.items()])
    rows = rows.select("org", "plan_code", F.inline(items))
    return rows.withColumn("ratio", F.when(F.col("included") > 0, F.least(F.lit(1.0), F.col("used") / F.col("included"))))


def seconds_saved(fields: Column) -> Column:
    return fields * SECONDS_PER_FIELD


def megabytes(size: Column) -> Column:
    """Whole megabytes, rounded up."""
    return F.ceil(size / (1 << 20)).cast("long")
