"""Tenancy: rows that a principal may see, support grants, and what roles permit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READ, WRITE, ADMIN = ("owner", "manager", "operator", "viewer"), ("owner", "manager", "operator"), ("owner", "manager")
BILLING_VIEW, BILLING_MANAGE = ("owner", "manager", "billing_admin"), ("owner", "billing_admin")

# What each role permits beyond the roles named before it.
OPERATOR = "customer.view customer.create customer.update customer.reveal_sensitive document.view document.upload document.download extraction.review documenttool.use fill.run formreport.create application.view application.create application.update member.view".split()
MANAGER = OPERATOR + "customer.delete customer.export document.delete application.delete member.invite member.remove member.change_role org.settings adapter.manage audit.view billing.view".split()
VIEWER = "customer.view document.view application.view member.view".split()
BILLING = "billing.view billing.manage".split()
SCOPES = {"metadata": ("metadata", "customer_records", "documents"), "customer_records": ("customer_records", "documents"), "documents": ("documents",)}


def secure(rows: DataFrame, members: DataFrame, user: str, roles: tuple[str, ...] = READ) -> DataFrame:
    """Rows (with org) of the organisations in which the user is an active member with one of the roles."""
    own = members.where((F.col("user_id") == user) & (F.col("status") == "active") & F.col("role").isin(*roles))
    return rows.join(own.select("org"), "org", "left_semi")


def with_support(rows: DataFrame, grants: DataFrame, user: str, scope: str, as_of: Column) -> DataFrame:
    """Rows (with org) for which the user holds a grant, not revoked and not expired, of the scope or a wider one."""
    live = grants.where((F.col("granted_to") == user) & F.col("revoked_at").isNull() & (F.col("expires_at") > as_of) & F.col("scope").isin(*SCOPES[scope]))
    return rows.join(live.select("org"), "org", "left_semi")


def permissions(spark: SparkSession, owner: list[str]) -> DataFrame:
    """(role, permission); owner: all permissions."""
    by_role = {"owner": owner, "manager": MANAGER, "operator": OPERATOR, "viewer": VIEWER, "billing_admin": BILLING}
    return spark.createDataFrame([(r, p) for r, own in by_role.items() for p in own], "role string, permission string")


def granted(members: DataFrame, matrix: DataFrame) -> DataFrame:
    """(org, user_id, permission): the union over each active member's roles.

    A member's few roles are gathered, and become permissions afterwards: no shuffle or table of a task holds these.
    """
    roles = members.where("status = 'active'").groupBy("org", "user_id").agg(F.collect_set("role").alias("roles"))
    by_role = matrix.where("role is not null").groupBy("role").agg(F.collect_set("permission").alias("own"))
    by_role = by_role.agg(F.map_from_entries(F.collect_list(F.struct("role", "own"))).alias("by_role"))  # one row
    own = F.transform("roles", lambda r: F.coalesce(F.try_element_at("by_role", r), F.array().cast("array<string>")))
    return roles.join(F.broadcast(by_role)).select("org", "user_id", F.explode(F.array_distinct(F.flatten(own))).alias("permission"))
