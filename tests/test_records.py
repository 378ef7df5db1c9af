"""Profiles, organisations and form values beyond what the registered queries show."""

from pyspark.sql import functions as F

from lumenfold.functions import transforms
from lumenfold.operators import dashboard, duplicates, mapping, metering, records, tenancy

NOW = "2024-01-01"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "fill", None), (2, "u", "seat", 3)], "org int, user_id string, event_type string, quantity int")
    for _ in range(2):
        records.append(records.usage_rows(rows, F.lit(NOW).cast("timestamp")), str(tmp_path / "usage"), "org")
    got = metering.usage_since(spark.read.parquet(str(tmp_path / "usage")), F.lit("2023-01-01").cast("timestamp"))
    assert {(r.org, r.event_type, r.total) for r in got.collect()} == {(1, "fill", 2), (2, "seat", 6)}


def test_organisations(spark):
    made = tenancy.started(spark.createDataFrame([(7, "n", "u1")], "org int, name string, owner string"), F.lit(NOW).cast("timestamp"))
    assert {k: v.count() for k, v in made.items()} == {"organizations": 1, "members": 1, "subscriptions": 1, "audit": 1}
    rows = [(7, "viewer", "t", "pending", "2030-01-01", "A@x.in", "u1", "a@X.in"), (7, "viewer", "t2", "pending", "2020-01-01", "b@x.in", "u2", "b@x.in")]
    invitations = spark.createDataFrame(rows, "org int, role string, token_hash string, status string, expires_at string, email string, actor string, actor_email string")
    got = tenancy.accepted(invitations, made["members"], F.lit(NOW)).collect()
    assert [tuple(r) for r in got] == [(7, "u1", "viewer", "active")]


def test_form_values(spark):
    f = lambda kind, value: one(spark, transforms.formatted(F.lit(kind), F.lit(value)))
    assert f("date", "3-4-1990") == "1990-04-03" and f("date", "1990-04-03") == "1990-04-03" and f("time", "25:00") == "25:00" and f("time", "12:05 am") == "00:05"
    c = lambda v, a="", b="": one(spark, transforms.clamped(F.lit(v), F.lit(a), F.lit(b)))
    assert [c("150"), c("abc"), c("-3.5", "-10"), c("7.0"), c("5", "6", "8")] == ["100", None, "-3.5", "7", "6"]
    t = lambda name, v: one(spark, transforms.transformed(F.lit(name), F.lit(v)))
    assert [t("number.plain", "₹1,20,000"), t("number.plain", "1.2.3"), t("aadhaar.last4", "2341 2341 2346"), t("text.upper", " "), t(None, " a ")][1::2] == [None, None]
    assert t("number.plain", "₹1,20,000") == "120000" and t(None, " a ") == " a "


def test_members_of_json(spark):
    m = lambda path: one(spark, records.member(F.lit('{"a":{"b":" x ","n":1.5,"t":true,"o":{},"e":" ","z":null}}'), path))
    assert [m("a.b"), m("a.n"), m("a.t"), m("a.o"), m("a.e"), m("a.z"), m("q.r")] == [" x ", "1.5", "true", None, None, None, None]


def test_similar_keys_equal_all_pairs(spark):
    names = ["amit kumar singh", "amit singh", "amit kumr singh", "sita devi", "sita dev", "ram", "rama", "abcde", "abcdf", "a", "", "kumar amit", "x y z w v u", "x y z w v t"]
    keys = spark.createDataFrame([(n,) for n in names], "key string")
    got = {(r.x, r.y, round(r.near, 9)) for r in duplicates.similar_keys(keys, 0.8).collect()}
    pairs = keys.crossJoin(keys.withColumnRenamed("key", "y")).withColumn("near", duplicates.key_similarity(F.col("key"), F.col("y")))
    assert got == {(r.key, r.y, round(r.near, 9)) for r in pairs.where("near >= 0.8").collect()}


def test_ranges_and_counts(spark):
    owners = spark.createDataFrame([(1, "owner", "active"), (1, "owner", "suspended")], "org int, role string, status string")
    assert one(spark, metering.month_start(F.lit("2024-03-09").cast("timestamp"))).day == 1 and one(spark, metering.seconds_saved(F.lit(3))) == 36
    assert owners.count() == 2 and hasattr(dashboard, "summary") and mapping.HIGH == 0.9
