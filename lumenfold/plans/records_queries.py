"""Queries of form mapping, profiles, organisations and pages, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms
from ..operators import mapping, records, tenancy
from ..sources.tables import page_with_total, spread, table
from .catalogue import registered


_LADDER = """
WITH f AS (SELECT p_partkey AS signature, p_partkey % 97 AS page_id, p_size AS n, p_partkey % 7 AS m, p_partkey % 10 AS customer_id FROM part),
g AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'captcha' WHEN n % 13 = 0 THEN 'otp' WHEN n % 17 = 0 THEN 'payment' WHEN n % 19 = 0 THEN 'submit' ELSE 'normal' END AS safety_class,
  CASE m WHEN 1 THEN 'password' WHEN 2 THEN 'file' WHEN 3 THEN 'weird' WHEN 4 THEN 'date' WHEN 5 THEN '' ELSE 'text' END AS input_type, CASE WHEN signature % 3 = 0 THEN 'select' ELSE 'input' END AS tag_name FROM f),
s AS (SELECT *, CASE WHEN safety_class = 'captcha' THEN 'captcha_field' WHEN safety_class = 'otp' THEN 'otp_field' WHEN safety_class = 'payment' THEN 'payment_field' WHEN safety_class <> 'normal' THEN 'submit_control'
  WHEN input_type IN ('password', 'file') THEN 'unsupported_type' WHEN input_type = 'weird' AND tag_name = 'input' THEN 'unsupported_type' WHEN signature % 23 = 0 THEN 'not_visible' WHEN signature % 29 = 0 THEN 'disabled' WHEN signature % 31 = 0 THEN 'readonly' WHEN signature % 37 = 0 THEN 'already_filled' END AS skip FROM g),
c AS (SELECT *, CASE WHEN skip IS NOT NULL THEN NULL WHEN n % 4 = 0 THEN 'adapter' WHEN n % 3 = 0 THEN 'org_custom' WHEN n % 5 = 0 THEN 'history' WHEN n > 20 THEN 'dictionary' END AS source FROM s),
d AS (SELECT *, CASE source WHEN 'adapter' THEN 'pan' WHEN 'org_custom' THEN 'name' WHEN 'history' THEN 'city' WHEN 'dictionary' THEN 'town' END AS customer_field,
  CASE source WHEN 'adapter' THEN CASE WHEN n % 8 = 0 THEN 0.99 ELSE 0.9 END WHEN 'org_custom' THEN 0.98 WHEN 'history' THEN least(0.95, round(0.85 + 0.02 * (n % 6), 3)) WHEN 'dictionary' THEN n / 50.0 END AS confidence,
  CASE source WHEN 'org_custom' THEN 'text.upper' WHEN 'history' THEN 'no.such' END AS transform FROM c),
e AS (SELECT *, CASE WHEN customer_field = 'city' THEN NULL WHEN customer_field = 'name' THEN upper('name ' || customer_id) WHEN customer_field = 'town' AND customer_id = 3 THEN NULL ELSE customer_field || ' ' || customer_id END AS value FROM d)
SELECT signature, page_id, safety_class, customer_field, source, CAST(confidence AS DOUBLE) AS confidence, transform, value,
  coalesce(skip, CASE WHEN customer_field IS NULL THEN 'no_mapping' WHEN value IS NULL THEN 'no_value' WHEN confidence < 0.7 THEN 'low_confidence' END) AS skip_reason,
  customer_field IS NOT NULL AND value IS NOT NULL AND (customer_field = 'pan' OR confidence < 0.9 OR (customer_field = 'name' AND customer_id = 4) OR (source = 'adapter' AND n % 12 = 0)) AS review_required FROM e"""


def _proposal(spark, sf_dir):
    n, key = F.col("n"), F.col("signature")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("signature"), (F.col("p_partkey") % 97).alias("page_id"), F.col("p_size").alias("n"), (F.col("p_partkey") % 10).alias("customer_id"))
    only = lambda c, v: F.when(c, F.lit(v))
    kind = F.element_at(F.array(*[F.lit(x) for x in ["text", "password", "file", "weird", "date", "", "text"]]), (key % 7 + 1).cast("int"))
    safety = only(n % 11 == 0, "captcha").when(n % 13 == 0, "otp").when(n % 17 == 0, "payment").when(n % 19 == 0, "submit").otherwise("normal")
    fields = rows.select("signature", "page_id", "customer_id", F.lit("o").alias("origin"), "n", only(key % 3 == 0, "select").otherwise("input").alias("tag_name"), kind.alias("input_type"), safety.alias("safety_class"), (key % 23 != 0).alias("visible"), (key % 29 == 0).alias("disabled"), (key % 31 == 0).alias("read_only"), (key % 37 == 0).alias("has_value"), only(n % 8 == 0, "active").otherwise("testing").alias("adapter_status"), only(n % 4 == 0, "pan").alias("adapter_field"), F.lit(None).cast("string").alias("adapter_transform"), (n % 12 == 0).alias("adapter_review"), only(n > 20, "town").alias("dictionary_field"), F.lit(None).cast("string").alias("dictionary_transform"), (n / 50.0).alias("dictionary_score"))
    overrides = rows.where(n % 3 == 0).select("signature", F.lit("o").alias("origin"), F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("name").alias("customer_field"), F.lit("text.upper").alias("transform")), F.struct(F.lit(2).alias("ordinal"), F.lit("other").alias("customer_field"), F.lit("x").alias("transform")))).alias("o")).select("signature", "origin", "o.*")
    history = rows.where(n % 5 == 0).select("signature", F.lit(0).alias("ordinal"), F.lit("city").alias("customer_field"), F.lit("no.such").alias("transform"), (n % 6).alias("confirmations"))
    held = spark.createDataFrame([(i, f, f"{f} {i}" if f != "name" else "old") for i in range(10) for f in ("pan", "name", "city", "town") if (i, f) != (3, "town")], "customer_id bigint, customer_field string, value string")
    verified = spark.createDataFrame([(i, "name", f"name {i}") for i in range(10)], "customer_id bigint, customer_field string, value string")
    unverified = spark.createDataFrame([(4, "name")], "customer_id bigint, customer_field string")
    fields = mapping.with_history(mapping.with_overrides(fields, overrides), history)
    return mapping.propose(fields, mapping.with_verified(held, verified), ["pan"], unverified)


@registered(_LADDER)
def q_map_proposal(spark, sf_dir):
    """A mapping for every detected field: safety, eligibility, then adapter, own mapping, history and dictionary."""
    return _proposal(spark, sf_dir).select("signature", "page_id", "safety_class", "customer_field", "source", "confidence", "transform", "value", "skip_reason", "review_required")


@registered(f"""
WITH m AS ({_LADDER}) SELECT page_id, count(*) AS detected, count(customer_field) AS proposed, count(*) FILTER (customer_field IS NOT NULL AND skip_reason IS NULL AND NOT review_required) AS ready_to_fill,
count(*) FILTER (customer_field IS NOT NULL AND skip_reason IS NULL AND review_required) AS needs_review, count(skip_reason) AS skipped, count(*) FILTER (safety_class = 'captcha') AS captcha, count(*) FILTER (safety_class = 'otp') AS otp, count(*) FILTER (safety_class = 'payment') AS payment FROM m GROUP BY page_id
""")
def q_map_summary(spark, sf_dir):
    """Eight counts of a proposal by page."""
    return mapping.summary(_proposal(spark, sf_dir))


@registered("""
WITH p AS (SELECT p_partkey % 97 AS page_id, p_partkey AS signature, p_size % 4 AS k FROM part)
SELECT page_id, signature, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END, signature) AS INT) AS place, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN signature % 5 = 0 THEN -signature END NULLS LAST, signature) AS INT) AS ranked FROM p
""")
def q_fill_order(spark, sf_dir):
    """Fields after those that they depend on, and by an order given from outside."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("page_id"), F.col("p_partkey").alias("signature"), F.col("p_partkey").alias("ordinal"), F.lit("s").alias("slug"), F.concat(F.lit("k"), F.col("p_size") % 4).alias("adapter_key"))
    depths = spark.createDataFrame([("s", "k0", 0), ("s", "k1", 2), ("s", "k2", 1)], "slug string, key string, depth int")
    order = rows.where("signature % 5 = 0").select("page_id", "signature", (-F.col("signature")).alias("rank"))
    return mapping.ranked(mapping.fill_order(rows, depths).withColumnRenamed("place", "_f"), order).select("page_id", "signature", F.col("_f").alias("place"), F.col("place").alias("ranked"))


_DATE = "strftime(o_orderdate, '%Y-%m-%d')"


@registered(f"""
WITH o AS (SELECT o_orderkey AS id, {_DATE} AS d, o_orderkey % 22 AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN ' obc ' WHEN 2 THEN 'SC' WHEN 3 THEN 'female' ELSE 'none' END AS w, '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.5' AS n FROM orders)
SELECT id, CASE k WHEN 0 THEN substring(d, 9, 2) || '/' || substring(d, 6, 2) || '/' || substring(d, 1, 4) WHEN 1 THEN substring(d, 9, 2) || '-' || substring(d, 6, 2) || '-' || substring(d, 1, 4) WHEN 2 THEN replace(d, '-', '') WHEN 3 THEN d WHEN 4 THEN substring(d, 9, 2) WHEN 5 THEN substring(d, 6, 2) WHEN 6 THEN substring(d, 1, 4)
  WHEN 7 THEN upper(trim(w)) WHEN 8 THEN lower(trim(w)) WHEN 9 THEN upper(substring(trim(w), 1, 1)) || lower(substring(trim(w), 2)) WHEN 10 THEN replace(w, ' ', '')
  WHEN 11 THEN CASE lower(trim(w)) WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' END WHEN 12 THEN CASE lower(trim(w)) WHEN 'male' THEN 'M' WHEN 'female' THEN 'F' END WHEN 13 THEN CASE lower(trim(w)) WHEN 'obc' THEN 'OBC' WHEN 'sc' THEN 'SC' END WHEN 14 THEN CASE lower(trim(w)) WHEN 'obc' THEN 'OBC' WHEN 'sc' THEN 'Scheduled Caste' END
  WHEN 15 THEN replace(n, ',', '') WHEN 16 THEN CAST(9876500000 + id % 1000 AS VARCHAR) WHEN 17 THEN '+91' || CAST(9876500000 + id % 1000 AS VARCHAR) WHEN 18 THEN CAST(110000 + id % 1000 AS VARCHAR) WHEN 19 THEN NULL WHEN 20 THEN w END AS value FROM o
""")
def q_transforms(spark, sf_dir):
    """The named transforms, an unknown name and none, over orders."""
    k, key = F.col("o_orderkey") % 22, F.col("o_orderkey")
    names = ["date.ddmmyyyy", "date.ddmmyyyy_dash", "date.yyyymmdd", "date.iso", "date.day", "date.month", "date.year", "text.upper", "text.lower", "text.titlecase", "text.nospace", "gender.full", "gender.mf", "category.code", "category.full", "number.plain", "mobile.10digit", "mobile.e164", "pin.6digit", "no.such", None, "aadhaar.last4"]
    word = F.element_at(F.array(*[F.lit(x) for x in ("Male", " obc ", "SC", "female", "none")]), (key % 5 + 1).cast("int"))
    raw = F.when(k < 7, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 15, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5"))).when(k.isin(16, 17), (F.lit(9876500000) + key % 1000).cast("string")).when(k == 18, (F.lit(110000) + key % 1000).cast("string")).when(k == 21, "12").otherwise(word)
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), transforms.transformed(name, raw).alias("value"))


@registered(f"""
WITH o AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderkey % 7 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') || 'T' || lpad(CAST(id % 12 + 12 AS VARCHAR), 2, '0') || ':05' WHEN 2 THEN lpad(CAST(id % 12 AS VARCHAR), 2, '0') || ':30' WHEN 3 THEN strftime(d, '%Y-%m') WHEN 4 THEN strftime(d, '%Y') || '-W07' WHEN 5 THEN '#aabbcc' ELSE 'plain' END AS formatted,
  CAST(least(greatest(id % 300, 20), 100) AS VARCHAR) AS clamped, CASE id % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 4 THEN 'c' END AS option FROM o
""")
def q_field_formats(spark, sf_dir):
    """Values as input types, sliders and options take them."""
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 7
    day = F.date_format("o_orderdate", "d/M/yyyy")
    raw = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" "), F.when(key % 12 == 0, 12).otherwise(key % 12), F.lit(":05 PM"))).when(k == 2, F.concat(F.when(key % 12 == 0, 12).otherwise(key % 12), F.lit(".30am"))).when(k == 3, F.date_format("o_orderdate", "M/yyyy")).when(k == 4, F.date_format("o_orderdate", "yyyy'w7'")).when(k == 5, "#AbC").otherwise(" plain ")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("date", "datetime-local", "time", "month", "week", "color", "text")]), (k + 1).cast("int"))
    options = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(label).alias("label")) for v, label in (("a", "First"), ("b", "Second  choice"), ("c", "The third choice"))])
    asked = F.element_at(F.array(*[F.lit(x) for x in ("a", " B ", "second choice", "the th", "third", "zz")]), (key % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), transforms.formatted(kind, raw).alias("formatted"), transforms.clamped(F.concat(F.lit("Rs "), key % 300), F.lit("20"), F.lit("")).alias("clamped"), transforms.matched_option(options, asked)["value"].alias("option"))


@registered("""
WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey IN (3, 7)), p AS (SELECT * FROM c ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5)
SELECT c_custkey, c_name, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 15 AS has_more FROM p
""")
def q_page_total(spark, sf_dir):
    """A page with the number of all rows and whether more follow."""
    rows = table(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(3, 7))
    return page_with_total(rows.select("c_custkey", "c_name", "c_acctbal"), F.desc("c_acctbal"), F.asc("c_custkey"), limit=10, offset=5).select("c_custkey", "c_name", "total", "has_more")


_PROFILE = """'{"age": ' || (c_custkey % 90) || ', "balance": ' || (c_custkey % 7) || '.50, "ok": ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "none": null, "list": [1, 2.0, "x"], "current": {"pin": ' || c_nationkey || ', "district": "D' || c_nationkey || '", "flat": "f"}}'"""


@registered(f"""
WITH c AS (SELECT c_custkey AS id, *, CASE WHEN c_custkey % 3 = 0 THEN '"new \\"town\\""' WHEN c_custkey % 3 = 1 THEN 'null' ELSE '"D' || c_nationkey || '"' END AS district FROM customer)
SELECT id AS customer_id, c_name AS full_name, CASE WHEN id % 4 = 0 THEN 'x' ELSE c_mktsegment END AS segment,
  CASE id % 11 WHEN 10 THEN CASE WHEN id % 3 < 2 THEN '{{"home":{{"geo":{{"block":"b"}}}},"current":{{"district":' || district || '}}}}' ELSE '{{"home":{{"geo":{{"block":"b"}}}}}}' END
  ELSE '{{"age":' || (id % 90) || ',"balance":' || (id % 7) || '.50,"ok":' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || ',"none":null,"list":[1, 2.0, "x"],"current":' ||
    CASE WHEN id % 3 < 2 THEN '{{"pin":' || c_nationkey || ',"district":' || district || ',"flat":"f"}}' ELSE '{{"pin": ' || c_nationkey || ', "district": "D' || c_nationkey || '", "flat": "f"}}' END || ',"home":{{"geo":{{"block":"b"}}}}}}' END AS address_json FROM c
""")
def q_profile_patch(spark, sf_dir):
    """Values put into columns and JSON members at paths by the registry; the rest of the JSON keeps its bytes."""
    key = F.col("customer_id")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 11 == 10, "[1]").otherwise(F.expr(_PROFILE)).alias("address_json"))
    given = [("segment", F.when(key % 4 == 0, " x ")), ("district", F.when(key % 3 == 0, 'new "town"').when(key % 3 == 1, "  ")), ("block", F.lit("b")), ("age", F.lit("9")), ("password", F.lit("p"))]
    values = rows.select("customer_id", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in given]))).where("value is not null")
    registry = spark.createDataFrame([("segment", "column", "segment", None), ("district", "json", "address_json", "current.district"), ("block", "json", "address_json", "home.geo.block"), ("age", "derived", None, None)], "key string, kind string, target string, path string")
    changes = records.routed(values, registry, ["password"])
    return records.json_patched(records.patched(rows, changes, ["segment"]), changes, "address_json").select("customer_id", "full_name", "segment", "address_json")


@registered("""
SELECT c_custkey AS customer_id, unnest([{'key': 'name', 'value': c_name}, {'key': 'district', 'value': 'D' || c_nationkey}, {'key': 'balance', 'value': CAST(c_nationkey AS VARCHAR)}], recursive := true) FROM customer
""")
def q_profile_flat(spark, sf_dir):
    """Profiles as (key, value) rows of registered fields that have a value."""
    inner = F.struct(F.struct(F.concat(F.lit("D"), "c_nationkey").alias("district"), F.lit(" ").alias("blank"), F.col("c_nationkey").alias("n")).alias("current"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.to_json(inner).alias("address_json"))
    return records.flattened(rows, [("name", "column", "full_name", None), ("district", "json", "address_json", "current.district"), ("blank", "json", "address_json", "current.blank"), ("none", "json", "address_json", "current"), ("balance", "json", "address_json", "current.n")])


@registered("""
SELECT user_id AS org, event_id, CASE event_type WHEN 'signup' THEN 'email' ELSE 'city' END AS field_key, CASE WHEN value > 50 THEN 'rejected' ELSE 'operator_verified' END AS status, CASE WHEN value <= 50 AND event_type <> 'signup' THEN event_type END AS value_text, CASE WHEN value <= 50 AND event_type = 'signup' THEN sha256(event_type) END AS value_encrypted, CASE WHEN value <= 50 THEN CASE event_type WHEN 'signup' THEN '•••' ELSE event_type END END AS display_value FROM events
""")
def q_provenance(spark, sf_dir):
    """Where accepted values come from, and which were rejected."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("org"), F.col("event_id").alias("customer_id"), F.when(F.col("event_type") == "signup", "email").otherwise("city").alias("key"), F.when(F.col("value") > 50, "reject").otherwise("accept").alias("action"), F.col("event_type").alias("value"), F.lit(0.9).alias("confidence"), F.lit(1).alias("document_id"))
    out = records.provenance(rows, ["email"], lambda v: F.sha2(v, 256), {"email": lambda v: F.lit("•••")}, "u1")
    return out.select("org", F.col("customer_id").alias("event_id"), "field_key", "status", "value_text", "value_encrypted", "display_value")


@registered("""
SELECT user_id AS org, event_id AS entity_id, event_type AS action, CASE event_type WHEN 'purchase' THEN 'sensitive' WHEN 'error' THEN 'high' ELSE 'normal' END AS sensitivity, '{"k":' || event_id || ',"password":"[redacted:string:' || length(event_type) || ']","in":[{"token":"[redacted:number]","v":true}]}' AS metadata FROM events
""")
def q_audit(spark, sf_dir):
    """Audit rows: sensitivity by the catalogue, secrets redacted at every depth."""
    meta = F.to_json(F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("password"), F.array(F.struct(F.col("user_id").alias("token"), F.lit(True).alias("v"))).alias("in")))
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")
    rows = events.select(F.col("user_id").alias("org"), F.lit("u").alias("actor"), F.col("event_type").alias("action"), F.lit("event").alias("entity_type"), F.col("event_id").alias("entity_id"), meta.alias("metadata"))
    actions = spark.createDataFrame([("purchase", "sensitive"), ("error", "high")], "action string, sensitivity string")
    return records.audit_rows(rows, actions, F.lit("2024-01-01").cast("timestamp")).select("org", "entity_id", "action", "sensitivity", "metadata")


@registered("""
WITH e AS (SELECT user_id % 40 AS org, event_type, event_id, ts FROM events), c AS (SELECT c_custkey % 40 AS org, c_acctbal FROM customer), d AS (SELECT doc_id % 40 AS org, n_chars FROM documents),
o AS (SELECT DISTINCT org FROM e)
SELECT org, CASE org % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'past_due' END AS subscription_status, (SELECT count(*) FROM e WHERE e.org = o.org AND event_type = 'click' AND event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-10') AS clicks,
(SELECT count(*) FROM e WHERE e.org = o.org AND event_type = 'signup') AS seats_in_use, (SELECT count(*) FROM c WHERE c.org = o.org AND c_acctbal >= 0) AS customer_count, CAST((SELECT coalesce(ceil(sum(n_chars) / 1048576.0), 0) FROM d WHERE d.org = o.org) AS BIGINT) AS storage_used_mb FROM o
""")
def q_entitlement_context(spark, sf_dir):
    """What entitlement decisions need of each organisation, from five tables."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("org"), "event_type", "event_id", "ts")
    orgs = events.select("org").distinct().withColumn("plan_code", F.lit("free"))
    subscriptions = orgs.select("org", F.element_at(F.array(F.lit("active"), F.lit("past_due"), F.lit("cancelled")), (F.col("org") % 3 + 1).cast("int")).alias("status"))
    usage = events.select("org", "event_type", F.lit(1).alias("quantity"), (F.col("event_id") % 7 != 0).alias("billable"), F.col("ts").cast("timestamp").alias("created_at"))
    members = events.select("org", F.when(F.col("event_type") == "signup", "active").otherwise("invited").alias("status"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("org"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("deleted_at"))
    stored = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("org"), F.col("n_chars").alias("bytes"))
    out = tenancy.entitlement_context(orgs, subscriptions, usage, members, customers, stored, F.lit("2024-01-10").cast("timestamp"))
    return out.select("org", "subscription_status", F.coalesce(F.try_element_at("usage", F.lit("click")), F.lit(0)).alias("clicks"), "seats_in_use", "customer_count", "storage_used_mb")


@registered("""
WITH c AS (SELECT c_nationkey AS org, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'C' || lpad(CAST(c_custkey % 50 AS VARCHAR), 5, '0') END AS code FROM customer),
m AS (SELECT org, max(CAST(substring(code, 2) AS BIGINT)) AS last FROM c GROUP BY org)
SELECT org, c_custkey, coalesce(code, 'C' || lpad(CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY org, code IS NULL ORDER BY c_custkey) AS VARCHAR), 5, '0')) AS customer_code FROM c JOIN m USING (org)
""")
def q_customer_codes(spark, sf_dir):
    """The next codes of each organisation for customers without one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("C"), F.lpad((F.col("c_custkey") % 50).cast("string"), 5, "0"))).alias("customer_code"))
    return tenancy.customer_codes(rows, F.asc("c_custkey"))


@registered("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN o_orderdate < DATE '1999-01-01' - INTERVAL 12 MONTH WHEN 2 THEN o_orderdate < DATE '1999-01-01' - INTERVAL 24 MONTH ELSE o_orderdate < DATE '1999-01-01' - INTERVAL 36 MONTH END AS expired,
o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' AS within, (o_custkey > 50 OR (o_custkey = 50 AND o_orderkey > 100)) AS later FROM orders
""")
def q_ranges(spark, sf_dir):
    """Retention, a range that takes in its last day, and row-wise comparison."""
    preset = F.element_at(F.array(*[F.lit(x) for x in tenancy.RETENTION]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    within = tenancy.within_days(F.col("o_orderdate"), F.lit("1996-01-01").cast("date"), F.lit("1996-06-30"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tenancy.expired(F.col("o_orderdate"), preset, F.lit("1999-01-01").cast("date")).alias("expired"), within.alias("within"), tenancy.later((F.col("o_custkey"), F.lit(50).cast("long")), (F.col("o_orderkey"), F.lit(100).cast("long"))).alias("later"))


@registered("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unauthenticated' WHEN c_custkey % 5 = 0 THEN 'not_found' WHEN c_custkey % 3 = 0 THEN 'not_pending' WHEN c_acctbal < 0 THEN 'expired' WHEN c_nationkey = 4 THEN 'email_mismatch' ELSE 'accepted' END AS outcome FROM customer
""")
def q_invitations(spark, sf_dir):
    """Why invitations may not be accepted."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 7 != 0, F.lit("u")).alias("actor"), F.when(key % 5 != 0, F.when(key % 3 == 0, "revoked").otherwise("pending")).alias("status"), F.when(F.col("c_acctbal") < 0, "2023-01-01").otherwise("2030-01-01").alias("expires_at"), F.concat(F.lit("A"), key, F.lit("@x.in")).alias("email"), F.concat(F.when(F.col("c_nationkey") == 4, "b").otherwise("a"), key, F.lit("@X.in")).alias("actor_email"))
    return tenancy.invitation_outcome(rows, F.lit("2024-01-01")).select("c_custkey", "outcome")


@registered("SELECT user_id AS session_id, count(*) FILTER (event_type = 'view') AS filled, count(*) FILTER (event_type = 'click') AS skipped, count(*) FILTER (event_type = 'error') AS edited, count(*) FILTER (event_type = 'purchase') AS failed FROM events GROUP BY 1")
def q_fill_counts(spark, sf_dir):
    """Results of a filling session by action."""
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "filled", "click", "skipped", "error", "edited", "purchase", "failed", "signup", "other")]), F.col("event_type"))
    return tenancy.fill_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), name.alias("action")))


@registered("SELECT o_custkey AS run_id, count(*) AS claimed, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 1000) AS retried, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice <= 1000) AS failed FROM orders GROUP BY 1")
def q_run_counts(spark, sf_dir):
    """Jobs of a run by outcome."""
    return tenancy.run_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("ok"), (F.col("o_totalprice") > 1000).alias("will_retry")))


@registered("SELECT c_custkey, n_name, c_nationkey AS org FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0")
def q_memberships(spark, sf_dir):
    """Active members with their organisation."""
    members = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("org"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("suspended").alias("status"))
    return tenancy.memberships(members, table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "org")).select("c_custkey", F.col("organization.n_name").alias("n_name"), "org")


@registered("SELECT 'customer' AS t, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey <> 3")
def q_tenant_wipe(spark, sf_dir):
    """What stays of each table once an organisation is removed."""
    of = {name: table(spark, sf_dir, name).withColumnRenamed(c, "org") for name, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))}
    left = [t.agg(F.lit(name).alias("t"), F.count("*").alias("n")) for name, t in tenancy.wiped(of, F.lit(3)).items()]
    return left[0].unionByName(left[1])
