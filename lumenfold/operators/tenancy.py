"""Organisations: start, invitations, codes, retention, removal, contexts and run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .metering import megabytes
from .snapshots import keep_latest

# Months that documents are kept; null: until they are deleted.
RETENTION = {"keep": None, "12m": 12, "24m": 24, "36m": 36}


def within_days(at: Column, first: Column | None, last: Column | None) -> Column:
    """Whether a moment lies from the first day to the end of the last, both included; a missing bound is open."""
    out = F.lit(True)
    if first is not None:
        out &= at >= first
    return out if last is None else out & (at < F.date_add(F.to_date(last), 1))


def later(*pairs: tuple[Column, Column]) -> Column:
    """Row-wise (a, b, ...) > (c, d, ...)."""
    return F.struct(*[p[0] for p in pairs]) > F.struct(*[p[1] for p in pairs])


def expired(created: Column, preset: Column, as_of: Column) -> Column:
    """Whether a document is older than its organisation's retention preset allows."""
    months = F.element_at(F.create_map(*[F.lit(x) for k, n in RETENTION.items() for x in (k, n)]), preset)
    return F.coalesce(created < F.add_months(as_of, -months), F.lit(False))


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with nth, from 1 within their key in the given order (name a tie-break in it).

    Two passes: ranges of (key, order) are numbered apart, then shifted by what their key has in the ranges before. A
    key that most rows have is spread over as many tasks as there are ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    # a row for each range that a key reaches into
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    found = placed.withColumn("nth", nth).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("nth", F.col("nth") + F.col("_before")).drop("_part", "_key", "_of", "_before")


def customer_codes(customers: DataFrame, *order: Column) -> DataFrame:
    """customers: (org, customer_code, ...). Those without a code get the organisation's next ones: C and five digits, after the largest given."""
    number = F.when(F.col("customer_code").rlike("^C[0-9]+$"), F.substring("customer_code", 2, 1 << 30).cast("long"))
    last = customers.groupBy(F.col("org").alias("_org")).agg(F.max(number).alias("_last"))
    fresh = numbered(customers.where("customer_code is null"), "org", *order).join(last, F.col("org").eqNullSafe(F.col("_org")), "left")
    code = F.concat(F.lit("C"), F.lpad((F.coalesce(F.col("_last"), F.lit(0)) + F.col("nth")).cast("string"), 5, "0"))
    return customers.where("customer_code is not null").unionByName(fresh.withColumn("customer_code", code).select(*customers.columns))


def wiped(tables: dict[str, DataFrame], org: Column) -> dict[str, DataFrame]:
    """Every table (with org) without an organisation's rows."""
    return {name: t.where(~F.coalesce(F.col("org") == org, F.lit(False))) for name, t in tables.items()}


def invitation_outcome(invitations: DataFrame, as_of: Column) -> DataFrame:
    """invitations: (token_hash, status, expires_at, email, actor, actor_email), token_hash with a null status where no invitation has it. Adds outcome: accepted, or the first check that fails."""
    failed = F.when(F.col("actor").isNull(), "unauthenticated").when(F.col("status").isNull(), "not_found").when(F.col("status") != "pending", "not_pending").when(F.col("expires_at") < as_of, "expired").when(F.lower(F.coalesce("actor_email", F.lit(""))) != F.lower("email"), "email_mismatch")
    return invitations.withColumn("outcome", F.coalesce(failed, F.lit("accepted")))


def accepted(invitations: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """members: (org, user_id, role, status) after the invitations (org, role and those of invitation_outcome) that may be accepted; a member gets the invitation's role, of several the first by name."""
    news = invitation_outcome(invitations, as_of).where("outcome = 'accepted'").select("org", F.col("actor").alias("user_id"), "role", F.lit("active").alias("status"), "token_hash")
    news = keep_latest(news, ["org", "user_id"], F.asc("role"), F.asc("token_hash")).drop("token_hash")
    return members.join(news, ["org", "user_id"], "left_anti").unionByName(news)


def started(names: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """names: (org, name, owner). The rows that a new organisation adds to each table; Spark writes no two tables at once, so a reader may see some before others."""
    return {
        "organizations": names.select("org", "name", F.lit("free").alias("plan_code"), as_of.alias("created_at")),
        "members": names.select("org", F.col("owner").alias("user_id"), F.lit("owner").alias("role"), F.lit("active").alias("status")),
        "subscriptions": names.select("org", F.lit("free").alias("plan_code"), F.lit("active").alias("status")),
        "audit": names.select("org", F.col("owner").alias("actor"), F.lit("organization.created").alias("action"), as_of.alias("created_at")),
    }


def memberships(members: DataFrame, organizations: DataFrame) -> DataFrame:
    """Active members with their organisation as a struct; organizations: (org, ...)."""
    orgs = organizations.select(F.col("org"), F.struct("*").alias("organization"))
    return members.where("status = 'active'").join(orgs, "org")


def entitlement_context(organizations: DataFrame, subscriptions: DataFrame, usage: DataFrame, members: DataFrame, customers: DataFrame, objects: DataFrame, since: Column) -> DataFrame:
    """What a decision needs of each organisation (org, plan_code): subscription_status, usage (a map by kind), seats_in_use, customer_count, storage_used_mb.

    Every input is aggregated by org before it is joined.
    """
    status = subscriptions.where(F.col("status").isin("active", "trialing", "past_due")).groupBy("org").agg(F.min("status").alias("subscription_status"))
    kinds = usage.where(F.col("billable") & (F.col("created_at") >= since)).groupBy("org", "event_type").agg(F.sum("quantity").cast("long").alias("total"))
    kinds = kinds.groupBy("org").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "total")))).alias("usage"))
    seats = members.where("status = 'active'").groupBy("org").agg(F.count("*").alias("seats_in_use"))
    people = customers.where("deleted_at is null").groupBy("org").agg(F.count("*").alias("customer_count"))
    stored = objects.groupBy("org").agg(megabytes(F.sum("bytes")).alias("storage_used_mb"))
    rows = organizations.select("org", "plan_code")
    for other in (status, kinds, seats, people, stored):
        rows = rows.join(other, "org", "left")
    return rows.fillna(0, ["seats_in_use", "customer_count", "storage_used_mb"]).withColumn("usage", F.coalesce("usage", F.create_map().cast("map<string,bigint>")))


def fill_counts(results: DataFrame) -> DataFrame:
    """results: (session_id, action). Fields filled, skipped, edited and failed by session."""
    of = lambda a: F.count_if(F.col("action") == a).alias(a)
    return results.groupBy("session_id").agg(*[of(a) for a in ("filled", "skipped", "edited", "failed")])


def run_counts(outcomes: DataFrame) -> DataFrame:
    """outcomes: (run_id, ok, will_retry). Jobs claimed, completed, to be retried and failed by run."""
    return outcomes.groupBy("run_id").agg(F.count("*").alias("claimed"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok") & F.col("will_retry")).alias("retried"), F.count_if(~F.col("ok") & ~F.col("will_retry")).alias("failed"))
