"""Seeded records and adapter packages, and rows that tie in snapshot writes."""

import json

from pyspark.sql import functions as F

from lumenfold.operators import forms, snapshots, tenancy
from lumenfold.sources import adapters, seeded


def numbers(seed, count):
    """The generator as it is usually written, with a running state."""
    word = 0xFFFFFFFF
    for _ in range(count):
        seed = (seed + 0x6D2B79F5) & word
        t = ((seed ^ (seed >> 15)) * (seed | 1)) & word
        t = (t + ((t ^ (t >> 7)) * (t | 61))) & word ^ t
        yield ((t ^ (t >> 14)) & word) / 2**32


def test_draws_equal_a_running_generator(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 1, 20260101, 2**31, 2**32 - 1)], "seed long")
    got = rows.select("seed", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda n: seeded.draw(F.col("seed"), n)).alias("x")).collect()
    assert all(list(r.x) == list(numbers(r.seed, 50)) for r in got)


def test_seeded_records(spark):
    rows = seeded.records(spark.range(200).withColumnRenamed("id", "number"))
    got = {r.number: r for r in rows.collect()}
    assert len(got) == 200 and {r.number: r for r in seeded.records(spark.createDataFrame([(7,)], "number long")).collect()} == {7: got[7]}
    assert rows.where("not (mobile rlike '^99000[0-9]{5}$' and pan rlike '^ZZZP[A-Z][0-9]{4}Q$' and aadhaar_last4 = '0000' and pincode rlike '^9[0-9]{5}$' and try_cast(date_of_birth as date) is not null)").count() == 0
    draws = list(numbers(20260101 + 4, 42))
    first, last = seeded.MEN[int(draws[0] * 15)], seeded.SURNAMES[int(draws[1] * 14)]
    assert got[4].full_name == f"{first} {last}" and got[4].gender == "male" and got[4].bank_name == seeded.BANKS[int(draws[41] * 4)] and got[4].pan[4] == "E"


GOOD = {"id": "1", "slug": "demo", "portalName": "Demo", "formName": "Form", "urlPatterns": ["https://demo.example/**"], "version": "1.0.0", "status": "active", "fields": [{"key": "state", "customerField": "customer.state", "inputType": "select-one"}, {"key": "district", "customerField": "customer.district", "inputType": "select-one", "dependsOn": "state", "labelPatterns": ["जिला"]}], "documentRequirements": [{"key": "photo", "label": "Photo"}]}


def packages(spark, *texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "package int, text string")


def test_a_broken_package_is_reported_and_not_loaded(spark):
    broken = [
        {k: v for k, v in GOOD.items() if k != "slug"}, GOOD | {"status": "live", "notes": "x" * 1001}, GOOD | {"urlPatterns": [], "region": 5}, GOOD | {"urlPatterns": ["u" * 401, 7]},
        GOOD | {"fields": [{"key": "", "customerField": "name", "inputType": "text", "required": "yes"}, [1]]}, GOOD | {"documentRequirements": [{"label": "no key"}]}, "[]", "{broken", None, GOOD | {"fields": "none"}, GOOD | {"fields": [GOOD["fields"][0]] * 301},
    ]
    rows = packages(spark, GOOD, *broken)
    got = {}
    for r in adapters.violations(rows).collect():
        got.setdefault(r.package, set()).add((r.path, r.violation))
    assert got == {
        1: {("slug", "required")}, 2: {("status", "enum"), ("notes", "too_long")}, 3: {("urlPatterns", "too_short"), ("region", "type")}, 4: {("urlPatterns[0]", "too_long"), ("urlPatterns[1]", "type")},
        5: {("fields[0].key", "too_short"), ("fields[0].customerField", "pattern"), ("fields[0].required", "type"), ("fields[1]", "type")}, 6: {("documentRequirements[0].key", "required")}, 7: {("", "no_object")}, 8: {("", "no_object")}, 9: {("", "no_object")}, 10: {("fields", "type")}, 11: {("fields", "too_long")},
    }
    assert [r.package for r in adapters.loaded(rows).collect()] == [0]


def test_packages_from_files_are_layered_and_matched(spark, tmp_path):
    (tmp_path / "demo.json").write_text(json.dumps(GOOD, indent=2), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    built_in = adapters.loaded(adapters.read_packages(spark, str(tmp_path))).withColumn("package", F.lit(0))
    own = adapters.loaded(packages(spark, GOOD | {"version": "2.0.0"}, GOOD | {"slug": "other", "urlPatterns": ["https://other.example/*"]}))
    latest = adapters.loaded(packages(spark, GOOD | {"version": "3.0.0"}))
    merged = adapters.merged([built_in, own, latest])
    assert {(r.slug, r.version) for r in merged.collect()} == {("demo", "3.0.0"), ("other", "1.0.0")}
    pages = spark.createDataFrame([(1, "https://demo.example/a/b"), (2, "https://other.example/x"), (3, "https://none.example/")], "page_id int, url string")
    assert {(r.page_id, r.slug) for r in forms.select_adapters(pages, adapters.url_patterns(merged)).collect()} == {(1, "demo"), (2, "other")}
    depths = {(r.slug, r.key): r.depth for r in forms.dependency_depths(adapters.field_rules(merged).select("slug", "key", "depends_on")).collect()}
    assert depths[("demo", "district")] == 1 and depths[("demo", "state")] == 0


def test_rows_that_tie_do_not_depend_on_their_order(spark):
    now, rows = spark.createDataFrame([(1, 0, "old")], "id int, v int, x string"), [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, 1, "d"), (2, 1, "e")]
    make = lambda r: spark.createDataFrame(r, "id int, v int, x string")
    for f in (lambda r: snapshots.upsert(now, make(r), ["id"], "v"), lambda r: snapshots.insert_missing(now, make(r), ["id"]), lambda r: snapshots.overlay([now, make(r)], ["id"])):
        assert sorted(f(rows).collect()) == sorted(f(rows[::-1]).collect())
    invited = [(7, role, token, "pending", "2030-01-01", "a@x.in", "u1", "a@x.in") for role, token in (("viewer", "t1"), ("manager", "t2"), ("manager", "t0"))]
    schema = "org int, role string, token_hash string, status string, expires_at string, email string, actor string, actor_email string"
    members = spark.createDataFrame([], "org int, user_id string, role string, status string")
    assert [[tuple(r) for r in tenancy.accepted(spark.createDataFrame(x, schema), members, F.lit("2024-01-01")).collect()] for x in (invited, invited[::-1])] == [[(7, "u1", "manager", "active")]] * 2
