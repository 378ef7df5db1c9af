"""Row policies by table and action, and which roles a member may assign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .security import ADMIN, BILLING_MANAGE, BILLING_VIEW, READ, SCOPES, WRITE

ALL, OWNER = ("owner", "manager", "operator", "viewer", "billing_admin"), ("owner",)
ACTIONS = ("select", "insert", "update", "delete")

# By table, the roles that may select, insert, update and delete (None: nobody), and what else opens a
# row to reading: the scope of a support grant, "global" (rows of no organisation), "user_id" or "granted_to" (own rows).
POLICIES = {
    "organizations": (ALL, None, ADMIN, OWNER, "metadata"),
    "organization_members": (ALL, ADMIN, ADMIN, ADMIN, "user_id"),
    "organization_invitations": (ADMIN, ADMIN, ADMIN, None, None),
    "customers": (READ, WRITE, WRITE, ADMIN, "customer_records"),
    "customer_field_values": (WRITE, WRITE, WRITE, ADMIN, "customer_records"),
    "documents": (READ, WRITE, WRITE, ADMIN, "documents"),
    "document_extractions": (WRITE, WRITE, WRITE, None, "documents"),
    "document_derivatives": (READ, WRITE, None, ADMIN, None),
    "document_requirement_presets": (ALL, ADMIN, ADMIN, ADMIN, "global"),
    "applications": (READ, WRITE, WRITE, ADMIN, "customer_records"),
    "application_status_events": (READ, WRITE, None, None, None),
    "application_documents": (READ, WRITE, WRITE, WRITE, None),
    "portal_adapters": (ALL, ADMIN, ADMIN, ADMIN, "global"),
    "org_field_mappings": (READ, WRITE, WRITE, WRITE, None),
    "fill_sessions": (READ, WRITE, WRITE, None, None),
    "fill_session_fields": (READ, WRITE, None, None, None),
    "form_reports": (READ, WRITE, None, None, None),
    "subscriptions": (BILLING_VIEW, BILLING_MANAGE, BILLING_MANAGE, BILLING_MANAGE, None),
    "usage_events": (BILLING_VIEW, WRITE, None, None, None),
    "audit_logs": (ADMIN, ALL, None, None, "metadata"),
    "consent_records": (READ, WRITE, WRITE, None, None),
    "support_access_grants": (ALL, OWNER, OWNER, None, "granted_to"),
    "data_requests": (ADMIN, OWNER, None, None, None),
}
# The roles that a member of a role may give to others.
ASSIGNABLE = {"owner": ALL, "manager": ("operator", "viewer")}


def permitted(rows: DataFrame, table: str, action: str, members: DataFrame, grants: DataFrame, user: str, as_of: Column) -> DataFrame:
    """Rows (with org) on which the user may act. Tables without a policy, and actions that none allows, give no rows.

    The organisations of one user are few but are not assumed to be: both sides meet in semi-joins on org.
    """
    policy = POLICIES.get(table)
    roles = policy[ACTIONS.index(action)] if policy else None
    if roles is None:
        return rows.limit(0)
    own = members.where((F.col("user_id") == user) & (F.col("status") == "active") & F.col("role").isin(*roles)).select("org")
    more = policy[4] if action == "select" else None
    if more in SCOPES:
        live = grants.where((F.col("granted_to") == user) & F.col("revoked_at").isNull() & (F.col("expires_at") > as_of) & F.col("scope").isin(*SCOPES[more]))
        own = own.union(live.select("org"))
    if more not in ("global", "user_id", "granted_to"):
        return rows.join(own.distinct(), "org", "left_semi")
    open_to = F.col("org").isNull() if more == "global" else F.coalesce(F.col(more) == user, F.lit(False))
    return rows.join(own.distinct().withColumn("_member", F.lit(True)), "org", "left").where(open_to | F.col("_member").isNotNull()).select(*rows.columns)


def _policy_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The policies as relations: (table, action, role), and (table, opening) of what else opens rows to reading."""
    roles = [(t, a, r) for t, p in POLICIES.items() for a, own in zip(ACTIONS, p, strict=False) for r in own or ()]
    opened = [(t, p[4]) for t, p in POLICIES.items() if p[4]]
    return spark.createDataFrame(roles, "table string, action string, role string"), spark.createDataFrame(opened, "table string, opening string")


def permitted_to_all(rows: DataFrame, members: DataFrame, grants: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Who may do what to which rows: (user_id, table, action, row_id), for all of users (user_id) and all tables at once.

    rows: (table, row_id, org, user_id, granted_to), the last two null where the table has no such column. The policies
    are relations that meet members by role and grants by scope; what they give meets the rows by table and organisation.
    Rows of no organisation in tables that everybody may read are given to every user, by the table.
    """
    roles, opened = (F.broadcast(x) for x in _policy_rows(rows.sparkSession))  # some hundred fixed rows
    asked = users.select("user_id").distinct()
    by_role = members.where("status = 'active'").join(asked, "user_id").join(roles, "role").select("user_id", "org", "table", "action")
    scopes = F.broadcast(rows.sparkSession.createDataFrame([(o, s) for o, own in SCOPES.items() for s in own], "opening string, scope string"))
    live = grants.where(F.col("revoked_at").isNull() & (F.col("expires_at") > as_of)).select(F.col("granted_to").alias("user_id"), "org", "scope").join(asked, "user_id")
    by_scope = live.join(scopes, "scope").join(opened, "opening").select("user_id", "org", "table", F.lit("select").alias("action"))
    ways = by_role.unionByName(by_scope).distinct()
    found = rows.select("table", "row_id", "org").join(ways, ["table", "org"]).select("user_id", "table", "action", "row_id")
    reading = rows.join(opened, "table").withColumn("action", F.lit("select"))
    own = F.when(F.col("opening") == "user_id", F.col("user_id")).when(F.col("opening") == "granted_to", F.col("granted_to"))
    mine = reading.withColumn("user_id", own).join(asked, "user_id").select("user_id", "table", "action", "row_id")
    shared = opened.where("opening = 'global'").select("table")
    readers = asked.withColumn("table", F.explode(F.array(*[F.lit(t) for t, p in POLICIES.items() if p[4] == "global"])))
    everyone = rows.where("org is null").join(shared, "table").select("table", "row_id").join(readers, "table").select("user_id", "table", F.lit("select").alias("action"), "row_id")
    return found.unionByName(mine).unionByName(everyone).distinct()


def may_assign(actor_role: Column, role: Column) -> Column:
    """Whether a member of one role may give another; never where either is null."""
    allowed = F.lit(False)
    for actor, roles in ASSIGNABLE.items():
        allowed |= (actor_role == actor) & role.isin(*roles)
    return F.coalesce(allowed, F.lit(False))
