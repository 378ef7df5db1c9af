"""Row policies, input checks and extraction runs beyond what the registered queries show."""

from pyspark.sql import functions as F

from lumenfold.operators import extraction, inputs, policies, runs


def test_policies_of_empty_and_unknown_tables(spark):
    rows = spark.createDataFrame([(1, 1, "u"), (2, None, "v")], "id int, org int, user_id string")
    members = spark.createDataFrame([], "org int, user_id string, role string, status string")
    grants = spark.createDataFrame([], "org int, granted_to string, scope string, revoked_at string, expires_at string")
    got = lambda table, action: {r.id for r in policies.permitted(rows, table, action, members, grants, "u", F.lit("2024")).collect()}
    assert got("customers", "select") == set() and got("none", "select") == set()
    assert got("portal_adapters", "select") == {2} and got("organization_members", "select") == {1}
    assert set(policies.ACTIONS) == {"select", "insert", "update", "delete"} and all(len(p) == 5 for p in policies.POLICIES.values())


def test_first_message_of_a_field_holds(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, n int")
    out = inputs.checked(rows, [("n", F.col("n").isNotNull(), "missing"), ("n", F.col("n") > 0, "small"), ("id", F.col("id") < 3, "large")])
    assert {r.id: (r.ok, r.errors) for r in out.collect()} == {1: (True, {}), 2: (False, {"n": "missing"}), 3: (False, {"n": "small", "id": "large"})}


def test_orphan_labels(spark):
    rules = spark.createDataFrame([(1, "a", "text", ["name"], None, None, False), (2, "b", "text", ["father"], ["mother"], None, False)], extraction.RULES)
    cases = [["Name", "Ram"], ["Name", "Father", "Shyam"], ["Name"], ["Name", "City: X"], [], ["Ram", "Name", "Amit", "Father", "Om"]]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, lines array<string>")
    got = {r.id: r.lines for r in runs.paired(rows, "lines", runs.known_label(rules)).collect()}

    def plain(lines):
        known, out, i = lambda x: x.lower() in ("name", "father"), [], 0
        while i < len(lines):
            alone = known(lines[i]) and i + 1 < len(lines) and ":" not in lines[i + 1] and not known(lines[i + 1])
            out.append(f"{lines[i]}: {lines[i + 1]}" if alone else lines[i])
            i += 1 + alone
        return out

    assert got == {i: plain(c) for i, c in enumerate(cases)}
