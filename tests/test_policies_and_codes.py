"""Policies of all users at once, and the numbering of an organisation that has most rows."""

import random

from pyspark.sql import functions as F

from lumenfold.operators import policies, security, tenancy

ROWS = "table string, row_id int, org int, user_id string, granted_to string"


def test_policies_for_all_users_equal_plain_checks(spark):
    rng = random.Random(4)
    tables, users = list(policies.POLICIES), [f"u{i}" for i in range(6)]
    rows = [(t, i, rng.choice([1, 2, 3, None]), rng.choice([*users, None]), rng.choice([*users, None])) for i, t in enumerate(tables * 4 + ["unknown"])]
    members = [(rng.choice([1, 2, 3]), u, rng.choice(["owner", "manager", "operator", "viewer", "billing_admin", "guest"]), rng.choice(["active", "active", "suspended"])) for u in users[:5] for _ in range(2)]
    grants = [(rng.choice([1, 2, 3]), u, rng.choice(["metadata", "customer_records", "documents"]), rng.choice(["2020-01-01", "2030-01-01"]), rng.choice([None, None, "2024-01-01"])) for u in users for _ in range(2)]
    want = set()
    for u in users:
        for t, i, org, own, given in rows:
            policy = policies.POLICIES.get(t)
            for n, action in enumerate(policies.ACTIONS if policy else ()):
                roles, opening = policy[n] or (), policy[4] if action == "select" else None
                ok = any(org == o and u == m and r in roles and s == "active" for o, m, r, s in members)
                ok |= opening in security.SCOPES and any(org == o and u == g and sc in security.SCOPES[opening] and e > "2024-06-01" and rev is None for o, g, sc, e, rev in grants)
                ok |= (opening == "global" and org is None) or (opening == "user_id" and own == u) or (opening == "granted_to" and given == u)
                if ok:
                    want.add((u, t, action, i))
    got = policies.permitted_to_all(
        spark.createDataFrame(rows, ROWS), spark.createDataFrame(members, "org int, user_id string, role string, status string"),
        spark.createDataFrame(grants, "org int, granted_to string, scope string, expires_at string, revoked_at string"), spark.createDataFrame([(u,) for u in users * 2], "user_id string"), F.lit("2024-06-01"),
    ).collect()
    assert sorted((r.user_id, r.table, r.action, r.row_id) for r in got) == sorted(want) and len(want) > 200


def test_one_organisation_with_most_rows_is_numbered_by_many_tasks(spark):
    rows = spark.range(30_000).selectExpr("cast(case when id % 1000 = 1 then 2 when id % 1000 = 2 then null else 1 end as int) as org", "(id * 7919) % 30000 as key", "case when id % 10 = 0 then concat('C', lpad(id, 5, '0')) end as customer_code")
    got = tenancy.customer_codes(rows, F.asc("key"))
    assert got.count() == 30_000 and got.select("org", "customer_code").distinct().count() == 30_000
    first = {r.org: r.customer_code for r in rows.where("customer_code is null").join(got.withColumnsRenamed({"org": "o", "customer_code": "code", "key": "k"}), (F.col("key") == F.col("k"))).groupBy("org").agg(F.min("code").alias("customer_code")).collect()}
    assert first == {1: "C29991", 2: "C00001", None: "C00001"}
    order = got.join(rows.where("customer_code is null").select("key"), "key", "left_semi").where("org = 1").selectExpr("cast(substring(customer_code, 2) as int) - 29990 as nth", "key").toPandas().sort_values("key")
    assert (order["nth"].to_numpy() == range(1, len(order) + 1)).all()
    sizes = tenancy.numbered(rows, "org", F.asc("key")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 15_000
