"""Home-screen counters of an organisation: one pass over each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("draft", "pending_documents", "ready_to_fill", "filled", "submitted", "pending_followup")


def summary(sessions: DataFrame, customers: DataFrame, extractions: DataFrame, applications: DataFrame, as_of: Column) -> DataFrame:
    """One row per organisation (each source has org): fills_today, customers_served_today, customers_total, documents_today, applications_open, reviews_pending, fields_this_month."""
    day, month = F.date_trunc("day", as_of), F.date_trunc("month", as_of)
    today = F.col("created_at") >= day
    parts = [
        sessions.groupBy("org").agg(F.count_if(today & (F.col("status") == "filled")).alias("fills_today"), F.countDistinct(F.when(today, F.col("customer_id"))).alias("customers_served_today"), F.sum(F.when(F.col("created_at") >= month, F.col("filled_fields"))).alias("fields_this_month")),
        customers.where("deleted_at is null").groupBy("org").agg(F.count("*").alias("customers_total")),
        extractions.groupBy("org").agg(F.count_if(today & F.col("status").isin("completed", "accepted", "review_required")).alias("documents_today"), F.count_if(F.col("status") == "review_required").alias("reviews_pending")),
        applications.where("deleted_at is null").groupBy("org").agg(F.count_if(F.col("status").isin(*OPEN)).alias("applications_open")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "org", "full")
    return out.na.fill(0)


def remaining_owners(members: DataFrame, without: Column) -> DataFrame:
    """members: (org, role, status). Active owners of each organisation besides the rows that `without` selects."""
    return members.groupBy("org").agg(F.count_if((F.col("role") == "owner") & (F.col("status") == "active") & ~F.coalesce(without, F.lit(False))).alias("owners"))
