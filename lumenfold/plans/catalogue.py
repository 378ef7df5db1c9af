"""All registered queries of the core operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import privacy as P
from ..functions import text as T
from ..operators import dashboard, documents, duplicates, extraction, field_match, forms, lifecycle, metering, quality, search, security, snapshots
from ..sources.stored import shared_folder
from ..sources.tables import page, spread, table, values

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _rows(rows: list[tuple]) -> str:
    """Rows as the body of a VALUES clause."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


SINCE = "TIMESTAMP '2024-01-10 00:00:00'"
_KIND = "CASE event_type WHEN 'purchase' THEN 'fill' WHEN 'signup' THEN 'seat' WHEN 'click' THEN 'ai_extraction' WHEN 'error' THEN 'storage' ELSE 'document_tool' END"
_PLAN = "CASE user_id % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'professional' WHEN 3 THEN 'business' ELSE 'other' END"
_STATUS = "CASE user_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' ELSE 'past_due' END"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr(_KIND)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("org"), "event_id", "user_id", kind.alias("event_type"), F.lit(1).alias("quantity"), (F.col("event_id") % 7 != 0).alias("billable"), F.col("ts").cast("timestamp").alias("created_at"))


_USAGE = f"SELECT user_id AS org, event_type, CAST(sum(quantity) AS BIGINT) AS total FROM (SELECT user_id, {_KIND} AS event_type, 1 AS quantity FROM events WHERE event_id % 7 <> 0 AND ts >= {SINCE}) GROUP BY ALL"


@registered(_USAGE)
def q_usage_since(spark, sf_dir):
    """Billable usage since a given time."""
    return metering.usage_since(_usage(spark, sf_dir), F.lit("2024-01-10").cast("timestamp"))


_PLAN_ROWS = _rows([(p[0], *p[2:7]) for p in metering.PLANS])


@registered(f"""
WITH used AS ({_USAGE}), p(plan_code, fills, ai, seats, customers, mb) AS ({_PLAN_ROWS}),
s AS (SELECT DISTINCT user_id AS org, CASE WHEN {_PLAN} = 'other' THEN 'free' ELSE {_PLAN} END AS plan_code, {_STATUS} AS status FROM events),
j AS (SELECT org, plan_code, event_type, total, status, CASE event_type WHEN 'fill' THEN fills WHEN 'ai_extraction' THEN ai WHEN 'seat' THEN seats WHEN 'storage' THEN mb END - total AS rest FROM used JOIN s USING (org) JOIN p USING (plan_code)),
r AS (SELECT *, CASE WHEN plan_code <> 'free' AND status NOT IN ('active', 'trialing') THEN 'payment_required' WHEN rest < 1 THEN CASE event_type WHEN 'fill' THEN 'fills' WHEN 'ai_extraction' THEN 'ai_extractions' WHEN 'seat' THEN 'seats' ELSE 'storage' END END AS reason FROM j)
SELECT org, plan_code, event_type, total, reason IS NULL AS allowed, CAST(CASE WHEN reason IS NOT NULL THEN 0 ELSE rest - 1 END AS BIGINT) AS remaining, reason FROM r
""")
def q_entitlement(spark, sf_dir):
    """What each organisation may still take of each metered kind."""
    subscriptions = table(spark, sf_dir, "events").select(F.col("user_id").alias("org"), F.expr(_PLAN).alias("plan_code"), F.expr(_STATUS).alias("status")).distinct()
    return metering.decisions(subscriptions, q_usage_since(spark, sf_dir))


@registered(f"""
WITH u AS (SELECT user_id AS org, CASE WHEN {_PLAN} = 'other' THEN 'free' ELSE {_PLAN} END AS plan_code, count(*) FILTER (event_type = 'purchase') AS f, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'view') AS c, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY ALL),
p(plan_code, fills, ai, seats, customers, mb) AS ({_PLAN_ROWS}),
j AS (SELECT * FROM u JOIN p USING (plan_code)),
i AS (SELECT org, plan_code, 'fill' AS item, f AS used, fills AS included FROM j UNION ALL SELECT org, plan_code, 'ai_extraction', a, ai FROM j UNION ALL SELECT org, plan_code, 'seat', s, seats FROM j UNION ALL SELECT org, plan_code, 'customers', c, customers FROM j UNION ALL SELECT org, plan_code, 'storage_mb', m, mb FROM j)
SELECT org, plan_code, item, used, CAST(included AS BIGINT) AS included, CASE WHEN included > 0 THEN least(1.0, CAST(used AS DOUBLE) / included) END AS ratio FROM i
""")
def q_usage_ratios(spark, sf_dir):
    """Used and included amounts of every plan item."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    plan = F.expr(f"CASE WHEN {_PLAN} = 'other' THEN 'free' ELSE {_PLAN} END")
    used = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("org"), plan.alias("plan_code")).agg(n("purchase").alias("fills_used"), n("click").alias("ai_used"), n("signup").alias("seats_used"), n("view").alias("customers_used"), n("error").alias("storage_used"))
    return metering.usage_ratios(used)


@registered("""
WITH e AS (SELECT user_id % 10 AS org, user_id, event_type, CAST(floor(value) AS BIGINT) AS v, ts FROM events),
s AS (SELECT org, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' AND event_type = 'purchase') AS fills_today, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN user_id END) AS customers_served_today, CAST(coalesce(sum(v) FILTER (ts >= TIMESTAMP '2024-01-01'), 0) AS BIGINT) AS fields_this_month FROM e GROUP BY org),
c AS (SELECT c_custkey % 10 AS org, count(*) AS customers_total FROM customer WHERE c_acctbal >= 0 GROUP BY 1),
x AS (SELECT o_custkey % 10 AS org, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus IN ('F', 'O')) AS documents_today, count(*) FILTER (o_orderstatus = 'O') AS reviews_pending, count(*) FILTER (o_orderstatus = 'P') AS applications_open FROM orders GROUP BY 1)
SELECT s.org, fills_today, customers_served_today, fields_this_month, customers_total, documents_today - 0 AS documents_today, reviews_pending, applications_open FROM s JOIN c USING (org) JOIN x USING (org)
""")
def q_dashboard(spark, sf_dir):
    """Seven counters by organisation."""
    sessions = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("org"), F.col("user_id").alias("customer_id"), F.when(F.col("event_type") == "purchase", "filled").otherwise("open").alias("status"), F.expr("cast(floor(value) as bigint)").alias("filled_fields"), F.col("ts").alias("created_at"))
    people = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("org"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("deleted_at"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("org"), "o_orderstatus", (F.col("o_orderdate") + F.expr("case when o_orderdate >= timestamp_ntz'2000-01-01' then interval '9000' day else interval '0' day end")).alias("created_at"))
    extractions = orders.select("org", F.when(F.col("o_orderstatus") == "O", "review_required").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), "created_at")
    applications = orders.select("org", F.when(F.col("o_orderstatus") == "P", "submitted").otherwise("approved").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return dashboard.summary(sessions, people, extractions, applications, F.lit("2024-01-20").cast("timestamp_ntz"))


@registered("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal >= 0 AND c_acctbal < 9000 ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 5")
def q_list_page(spark, sf_dir):
    """One page of a filtered, ordered list."""
    rows = table(spark, sf_dir, "customer").where((F.col("c_nationkey") == 7) & (F.col("c_acctbal") >= 0) & (F.col("c_acctbal") < 9000))
    return page(rows.select("c_custkey", "c_name", "c_acctbal"), F.desc("c_acctbal"), F.asc("c_custkey"), offset=5)


@registered("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q_recent_orders(spark, sf_dir):
    """The latest order of each customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return snapshots.keep_latest(rows, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@registered("""
WITH c AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS amount FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
n AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM n)
""")
def q_upsert(spark, sf_dir):
    """Changes merged into a snapshot by key; the last write wins."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "O").alias("open"))
    current = snapshots.keep_latest(rows.where("not open"), ["k"], F.desc("v"))
    return snapshots.upsert(current, rows.where("open"), ["k"], "v").drop("open")


@registered("""
SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)
""")
def q_insert_missing(spark, sf_dir):
    """Rows appended where their key is not taken."""
    of = lambda name, c, shift=0: table(spark, sf_dir, name).select((F.col(f"{c}key") + shift).alias("id"), F.col(f"{c[0]}_name").alias("name"))
    new = of("supplier", "s_supp", 1_000_000_000).unionByName(of("part", "p_part"))
    return snapshots.insert_missing(of("customer", "c_cust"), new, ["id"])


@registered("SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_totalprice < 1000 THEN 1 END) AS gone FROM orders GROUP BY 1")
def q_soft_delete(spark, sf_dir):
    """Rows marked as deleted, counted."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.lit(None).cast("timestamp").alias("deleted_at"))
    done = snapshots.soft_delete(rows, F.col("o_totalprice") < 1000, F.lit("2024-01-01").cast("timestamp"))
    return done.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("deleted_at").alias("gone"))


@registered("SELECT count(*) AS purged FROM events WHERE ts < TIMESTAMP '2024-01-05'")
def q_purge(spark, sf_dir):
    """How many rows a purge removes."""
    return snapshots.purge(table(spark, sf_dir, "events"), F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"))[1]


@registered("SELECT p_partkey % 50 AS k, max(CASE WHEN p_size > 25 THEN 'own' ELSE 'global' END) AS layer FROM part GROUP BY 1")
def q_global_overlay(spark, sf_dir):
    """A tenant's rows over global ones."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k"), (F.col("p_size") > 25).alias("own"))
    layer = lambda own: rows.where(F.col("own") == own).select("k", F.lit("own" if own else "global").alias("layer")).distinct()
    return snapshots.overlay([layer(False), layer(True)], ["k"])


MEMBERS = [(1, "u1", "owner", "active"), (2, "u1", "viewer", "active"), (3, "u1", "operator", "suspended"), (4, "u1", "billing_admin", "active"), (5, "u2", "owner", "active"), (7, "u1", "manager", "active")]
GRANTS = [(1, "u9", "documents", "2030-01-01", None), (2, "u9", "metadata", "2030-01-01", None), (3, "u9", "documents", "2020-01-01", None), (4, "u9", "customer_records", "2030-01-01", "2024-01-01"), (5, "u9", "customer_records", "2030-01-01", None)]


@registered(f"SELECT c_custkey, c_nationkey AS org FROM customer WHERE c_nationkey IN (SELECT org FROM ({_rows(MEMBERS)}) m(org, user_id, role, status) WHERE user_id = 'u1' AND status = 'active' AND role IN ('owner', 'manager', 'operator', 'viewer'))")
def q_rls_customers(spark, sf_dir):
    """Customers that a member may read."""
    members = values(spark, "org int, user_id string, role string, status string", MEMBERS)
    return security.secure(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("org")), members, "u1").select("c_custkey", "org")


@registered(f"SELECT c_custkey, c_nationkey AS org FROM customer WHERE c_nationkey IN (SELECT org FROM ({_rows(GRANTS)}) g(org, granted_to, scope, expires_at, revoked_at) WHERE granted_to = 'u9' AND revoked_at IS NULL AND expires_at > '2024-06-01' AND scope IN ('customer_records', 'documents'))")
def q_support_grant(spark, sf_dir):
    """Customers that a support grant opens."""
    grants = values(spark, "org int, granted_to string, scope string, expires_at string, revoked_at string", GRANTS)
    return security.with_support(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("org")), grants, "u9", "customer_records", F.lit("2024-06-01")).select("c_custkey", "org")


_EDGES = _rows([(a, b) for a, own in lifecycle.TRANSITIONS.items() for b in own.split()])
_STATE = "CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'draft' WHEN 1 THEN 'pending_documents' WHEN 2 THEN 'ready_to_fill' WHEN 3 THEN 'filled' WHEN 4 THEN 'submitted' WHEN 5 THEN 'pending_followup' WHEN 6 THEN 'approved' WHEN 7 THEN 'rejected' ELSE 'cancelled' END"


@registered(f"""
WITH e(o, n) AS ({_EDGES}), s AS (SELECT o_custkey AS application_id, o_orderkey AS seq, {_STATE} AS status FROM orders),
h AS (SELECT *, lag(status) OVER (PARTITION BY application_id ORDER BY seq) AS old_status FROM s)
SELECT application_id, seq, status, old_status, old_status IS DISTINCT FROM status AS changed, old_status IS NULL OR old_status = status OR e.o IS NOT NULL AS valid FROM h LEFT JOIN e ON e.o = old_status AND e.n = status
""")
def q_status_history(spark, sf_dir):
    """Status changes with whether they are allowed."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("application_id"), F.col("o_orderkey").alias("seq"), F.expr(_STATE).alias("status"))
    return lifecycle.history(rows, ["seq"], lifecycle.transitions(spark))


_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_SIMILAR = "CASE WHEN {0} = '' OR {1} = '' THEN 0.0 WHEN {0} = {1} THEN 1.0 ELSE greatest(1 - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1})), 0.95 * len(list_intersect(string_split({0}, ' '), string_split({1}, ' '))) / least(len(list_distinct(string_split({0}, ' '))), len(list_distinct(string_split({1}, ' '))))) END"
_MADE_NAME = "CASE WHEN p_partkey % 11 = 0 THEN p_name || ' kumar' WHEN p_partkey % 13 = 0 THEN substring(p_name, 1, length(p_name) - 1) ELSE p_name END"
_MADE_MOBILE = "CASE WHEN p_partkey % 7 < 3 THEN '98765' || lpad(CAST(p_partkey // 3 AS VARCHAR), 5, '0') END"


_DUPLICATES = f"""
WITH r AS (SELECT p_partkey AS id, {_MADE_NAME} AS full_name, {_MADE_MOBILE} AS mobile, p_size AS born, lower(p_type) AS father, lower(p_brand) AS district FROM part),
p AS (SELECT id, {_KEY.format("full_name")} AS k, mobile, born, father, district FROM r),
n AS (SELECT x.k AS x, y.k AS y, {_SIMILAR.format("x.k", "y.k")} AS s FROM (SELECT DISTINCT k FROM p) x, (SELECT DISTINCT k FROM p) y),
f AS (SELECT x.father AS x, y.father AS y, {_SIMILAR.format("x.father", "y.father")} >= 0.85 AS alike FROM (SELECT DISTINCT father FROM p) x, (SELECT DISTINCT father FROM p) y),
m AS (SELECT a.id AS subject_id, b.id AS candidate_id, s, coalesce(a.mobile = b.mobile, false) AS mobile, s >= 0.85 AND a.born = b.born AS born, s >= 0.85 AND alike AS father, s >= 0.8 AND a.district = b.district AS district
  FROM p a JOIN n ON n.x = a.k JOIN p b ON b.k = n.y AND a.id <> b.id JOIN f ON f.x = a.father AND f.y = b.father),
t AS (SELECT *, greatest(CASE WHEN mobile THEN CASE WHEN s >= 0.7 THEN 0.97 ELSE 0.8 END ELSE 0 END, CASE WHEN born THEN 0.95 ELSE 0 END, CASE WHEN father THEN 0.88 ELSE 0 END, CASE WHEN district THEN 0.72 ELSE 0 END, CASE WHEN s >= 0.92 AND NOT (mobile OR born OR father OR district) THEN 0.65 ELSE 0 END) AS score FROM m)
SELECT subject_id, candidate_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws(',', CASE WHEN mobile THEN 'SAME_MOBILE' END, CASE WHEN born THEN 'SAME_NAME_AND_DOB' END, CASE WHEN father THEN 'SAME_NAME_AND_FATHER' END, CASE WHEN district THEN 'SIMILAR_NAME_SAME_DISTRICT' END, CASE WHEN score = 0.65 THEN 'SIMILAR_NAME' END) AS reasons
FROM t WHERE score >= 0.6
"""


@registered(_DUPLICATES)
def q_dup_pairs(spark, sf_dir):
    """Likely duplicates by all five rules, among all records."""
    rows = _records(spark, sf_dir)
    return duplicates.find(rows, rows, separator=",")


@registered(_DUPLICATES)
def q_dup_batches(spark, sf_dir):
    """The same, found by an index that meets the records in three batches."""
    rows, index = _records(spark, sf_dir), duplicates.DuplicateIndex(spark, shared_folder(spark))
    found = [index.add(rows.where(F.col("id") % 3 == i), separator=",") for i in range(3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer records made of parts."""
    made = lambda sql: F.expr(sql.replace("//", "div").replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made(_MADE_NAME).alias("full_name"), made(_MADE_MOBILE).alias("mobile"), F.col("p_size").cast("string").alias("date_of_birth"), F.col("p_type").alias("father_name"), F.col("p_brand").alias("district"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@registered(f"""
WITH t AS (SELECT p_partkey, p_name, {_TRI.format("p_name")} AS x, {_TRI.format("'red wid'")} AS y FROM part),
s AS (SELECT p_partkey, p_name, CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(x || y)) AS similarity FROM t)
SELECT p_partkey, p_name, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3
""")
def q_trgm_search(spark, sf_dir):
    """Parts by trigram similarity."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", T.trigram_similarity(F.col("p_name"), F.lit("red wid")).alias("similarity"))
    return rows.where(F.col("similarity") >= search.SIMILAR).withColumn("similarity", F.round("similarity", 6))


@registered("SELECT doc_id FROM documents WHERE len(list_filter(['the', 'of', 'this'], lambda q: NOT list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), q))) = 0")
def q_fulltext(spark, sf_dir):
    """Documents that have all the words of a query."""
    return table(spark, sf_dir, "documents").where(T.matches_all(F.col("text"), F.lit("The of this"))).select("doc_id")


@registered("SELECT source, CAST(ceil(sum(n_chars) / 1048576.0) AS BIGINT) AS mb FROM documents GROUP BY source")
def q_storage_mb(spark, sf_dir):
    """Storage by source in whole megabytes."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(metering.megabytes(F.sum("n_chars")).alias("mb"))


SIGNALS = [(0, "english", ["that the", "of the"], ["the", "and"], ["en"]), (1, "german", ["und die", "in die"], ["und", "ein"], ["de"]), (2, "french", ["que le", "en la"], ["que", "les"], ["fr"]), (3, "photo", [], [], ["photo"])]


def _class_sql() -> str:
    text, name = "regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')", "lower(coalesce(source, ''))"
    hit = lambda hay, words, w: " + ".join([f"{w} * CAST(contains({hay}, '{x}') AS INT)" for x in words] or ["0"])
    raws = ", ".join(f"{{'n': {n}, 't': '{t}', 'r': {hit(text, s, 3)} + {hit(text, w, 1)} + {hit(name, f, 2)}}}" for n, t, s, w, f in SIGNALS)
    return f"""
WITH a AS (SELECT doc_id, list_filter([{raws}], lambda x: x.r > 0) AS c, length(trim(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, n, list_sort(list_transform(c, lambda x: {{'r': -x.r, 'n': x.n, 't': x.t}})) AS s FROM a),
d AS (SELECT doc_id, n, s[1].t AS t, round(-s[1].r / (2.0 - s[1].r), 3) AS c1, round(-s[2].r / (2.0 - s[2].r), 3) AS c2 FROM b)
SELECT doc_id, CASE WHEN n < 24 THEN 'photo' WHEN t IS NULL OR c1 < 0.45 OR (c2 IS NOT NULL AND c1 - c2 < 0.05) THEN 'unknown' ELSE t END AS document_type FROM d"""


@registered(_class_sql())
def q_doc_class(spark, sf_dir):
    """Documents by signal phrases."""
    signals = values(spark, "class_no int, document_type string, strong array<string>, weak array<string>, filename_words array<string>", SIGNALS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("filename"), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("string").alias("hinted_type"))
    return documents.classify(docs, signals).select("doc_id", "document_type")


_BLANK = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PAIR = rf"^(.{{2,60}}?){_BLANK}*(?::|=|{_BLANK}{{2,}}|{_BLANK}[-–—]{_BLANK}){_BLANK}*(.+)$"
_trimmed = lambda c: f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@registered(f"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS raw FROM documents), t AS (SELECT doc_id, {_trimmed("raw")} AS raw FROM l),
p AS (SELECT doc_id, regexp_matches(raw, '{_PAIR}') AS pair, {_trimmed(f"regexp_extract(raw, '{_PAIR}', 1)")} AS label, {_trimmed(f"regexp_extract(raw, '{_PAIR}', 2)")} AS value FROM t WHERE raw <> '')
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN pair THEN 1 END) AS n_pairs, CAST(coalesce(sum(CASE WHEN pair THEN length(label) END), 0) AS BIGINT) AS label_chars, CAST(coalesce(sum(CASE WHEN pair THEN length(value) END), 0) AS BIGINT) AS value_chars FROM p GROUP BY doc_id
""")
def q_lines(spark, sf_dir):
    """Lines and label-value pairs of documents."""
    rows = documents.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    chars = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias(f"{c}_chars")
    return rows.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.count("label").alias("n_pairs"), chars("label"), chars("value"))


@registered("SELECT lang, round(avg(quality), 6) AS mean_quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def q_confidence_mean(spark, sf_dir):
    """Mean label by language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("mean_quality"), F.count("*").alias("n"))


@registered("SELECT doc_id, document_type, confidence FROM (SELECT doc_id, source AS document_type, n_chars AS confidence FROM documents) QUALIFY row_number() OVER (PARTITION BY document_type ORDER BY confidence DESC, doc_id) = 1")
def q_best_by_key(spark, sf_dir):
    """The largest document of each source."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.lit(0).alias("document_id"), F.col("source").alias("key"), F.col("n_chars").alias("confidence"))
    return documents.best_by_key(rows).select(F.col("line_no").alias("doc_id"), F.col("key").alias("document_type"), "confidence")


@registered("SELECT c_custkey, sha256(c_name) AS sha, upper(substring(c_name, 1, 1)) || '…' AS masked FROM customer")
def q_sha(spark, sf_dir):
    """Hashed and masked customer names."""
    return table(spark, sf_dir, "customer").select("c_custkey", P.sha256(F.col("c_name")).alias("sha"), P.mask_name(F.col("c_name")).alias("masked"))


@registered("SELECT o_orderkey, CAST(2024 - year(o_orderdate) - CAST((month(o_orderdate), day(o_orderdate)) > (3, 15) AS INT) AS INT) AS age FROM orders")
def q_age(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.age(F.col("o_orderdate").cast("date"), F.lit("2024-03-15").cast("date")).alias("age"))


@registered("""
WITH w AS (SELECT o_orderkey, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS s FROM orders)
SELECT o_orderkey, '₹' || CASE WHEN length(s) <= 3 THEN s WHEN length(s) <= 5 THEN s[:-4] || ',' || s[-3:] ELSE s[:-6] || ',' || s[-5:-4] || ',' || s[-3:] END AS inr FROM w
""")
def q_inr(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.format_inr(F.col("o_totalprice")).alias("inr"))


PATTERNS = [("news", "active", "https://*.example.com/**"), ("news", "active", "http://*.example.com/en/*"), ("old", "draft", "http**"), ("net", "testing", "https://m.*.example.net/**"), ("gone", "deprecated", "**")]


@registered("""
WITH m AS (SELECT page_id, 3 AS s, 'news' AS slug, 25 AS len, CASE WHEN regexp_matches(url, '(?i)^http://[^/]*\\.example\\.com/en/[^/]*$') THEN 25 - 20 ELSE 24 - 30 END AS specificity FROM pages WHERE regexp_matches(url, '(?i)^https://[^/]*\\.example\\.com/.*$') OR regexp_matches(url, '(?i)^http://[^/]*\\.example\\.com/en/[^/]*$')
UNION ALL SELECT page_id, 1, 'old', 6, 6 - 20 FROM pages WHERE regexp_matches(url, '(?i)^http.*$')
UNION ALL SELECT page_id, 2, 'net', 26, 26 - 30 FROM pages WHERE regexp_matches(url, '(?i)^https://m\\.[^/]*\\.example\\.net/.*$'))
SELECT page_id, slug, CAST(specificity AS INT) AS specificity FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY s DESC, specificity DESC, slug) = 1
""")
def q_url_match(spark, sf_dir):
    """The adapter of each page."""
    return forms.select_adapters(table(spark, sf_dir, "pages").select("page_id", "url"), values(spark, "slug string, status string, pattern string", PATTERNS))


# Fields made of parts: two forms with one long chain each, one of rings of seven with fields that lead into them.
_DEPENDS = "CASE WHEN p_partkey % 3 < 2 THEN p_partkey - 3 WHEN p_partkey % 5 = 0 THEN p_partkey + 3 WHEN (p_partkey // 3) % 7 = 6 THEN p_partkey - 18 ELSE p_partkey + 3 END"


@registered(f"""
WITH RECURSIVE f AS (SELECT p_partkey % 3 AS form, p_partkey AS key, {_DEPENDS} AS dep FROM part),
down(form, key, depth) AS (SELECT form, key, 0 FROM f WHERE form < 2 AND dep NOT IN (SELECT key FROM f) UNION ALL SELECT f.form, f.key, d.depth + 1 FROM down d JOIN f ON f.form = d.form AND f.dep = d.key),
up(form, key, above, seen) AS (SELECT form, key, dep, [key] FROM f WHERE form = 2 UNION ALL SELECT u.form, u.key, f.dep, u.seen || [f.key] FROM up u JOIN f ON f.form = 2 AND f.key = u.above WHERE NOT list_contains(u.seen, f.key))
SELECT CAST(form AS VARCHAR) AS slug, key, CAST(depth AS INT) AS depth FROM down UNION ALL SELECT CAST(form AS VARCHAR), key, CAST(max(len(seen)) - 1 AS INT) FROM up GROUP BY ALL
""")
def q_dep_depth(spark, sf_dir):
    """Depth of form fields in their chains of dependencies."""
    key = F.col("p_partkey")
    fields = table(spark, sf_dir, "part").select((key % 3).cast("string").alias("slug"), key.alias("key"), F.expr(_DEPENDS.replace("//", "div")).alias("depends_on"))
    return forms.dependency_depths(fields)


@registered("SELECT event_id, v AS violation FROM (SELECT event_id, unnest(list_filter([CASE WHEN value < 10 THEN 'least_value' END, CASE WHEN event_type = 'error' AND value > 50 THEN 'error_value' END], lambda x: x IS NOT NULL)) AS v FROM events)")
def q_constraints(spark, sf_dir):
    """Rows that break named checks."""
    value = F.col("value")
    return quality.violations(table(spark, sf_dir, "events"), "event_id", least_value=value >= 10, error_value=(F.col("event_type") != "error") | (value <= 50))


@registered("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q_unique_keys(spark, sf_dir):
    """Keys that should be unique under a condition and are not."""
    return quality.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P")


_PEOPLE = """people AS (SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '\\p{L}+')[1:3], ' ') AS full_name, 'C' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS customer_code, '98' || lpad(CAST(doc_id * 7919 % 100000000 AS VARCHAR), 8, '0') AS mobile, source AS district FROM documents)"""
_ASKED = "CASE (id // 100) % 6 WHEN 0 THEN full_name WHEN 1 THEN split_part(full_name, ' ', 1) WHEN 2 THEN full_name[:-3] WHEN 3 THEN lower(customer_code) WHEN 4 THEN '+91 ' || mobile ELSE mobile[-6:] END"


_TRI_ALL = _TRI.replace("[^a-z0-9]+", "[^\\p{{L}}\\p{{N}}]+")


def _ranked_sql(asked: str) -> str:
    """All pairs of asked (query_id, q) and people, ranked."""
    split = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), x -> x <> '')".replace("x -> ", "lambda x: ")
    return f"""
{_PEOPLE}, asked AS ({asked}),
q AS (SELECT query_id, trim(coalesce(q, '')) AS q, list_distinct({split.format("coalesce(q, '')")}) AS words, {_TRI_ALL.format("coalesce(q, '')")} AS grams, right(regexp_replace(coalesce(q, ''), '[^0-9]', '', 'g'), 10) AS number FROM asked),
c AS (SELECT *, right(regexp_replace(mobile, '[^0-9]', '', 'g'), 10) AS number, {split.format("concat_ws(' ', full_name, customer_code, mobile, district)")} AS tokens, {_TRI_ALL.format("coalesce(full_name, '')")} AS grams FROM people),
p AS (SELECT query_id, id, q.q, q.words, c.tokens, CASE WHEN len(q.grams) + len(c.grams) = 0 THEN 0.0 ELSE CAST(len(list_intersect(q.grams, c.grams)) AS DOUBLE) / len(list_distinct(q.grams || c.grams)) END AS s, lower(q.q) = lower(customer_code) AS code, q.number = c.number AND length(q.number) = 10 AS number, length(q.number) >= 4 AND suffix(c.number, q.number) AS ends, len(q.words) > 0 AND len(list_intersect(q.words, c.tokens)) = len(q.words) AS w FROM q, c),
f AS (SELECT * FROM p WHERE q = '' OR w OR s >= 0.3 OR code OR ends),
t AS (SELECT query_id, id, words, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM f WHERE len(words) > 1),
o AS (SELECT query_id, id, list_position(words, token) AS word, place FROM t WHERE list_contains(words, token)),
r AS (SELECT x.query_id, x.id, 1 - product(1 - 0.1 * sqrt(CASE WHEN abs(x.place - y.place) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.place - y.place) / 1.5 - 2)) END)) AS pairs FROM o x JOIN o y ON x.query_id = y.query_id AND x.id = y.id AND y.word < x.word GROUP BY ALL),
g AS (SELECT f.*, CASE WHEN q = '' THEN 0.0 WHEN number THEN 1.0 WHEN code THEN 0.99 ELSE greatest(s, CASE len(words) WHEN 0 THEN 0.0 WHEN 1 THEN coalesce(list_sum(list_transform(range(1, len(list_filter(tokens, lambda x: x = words[1])) + 1), lambda i: 0.1 / (i * i))), 0.0) / 1.64493406685 ELSE coalesce(pairs, 1e-20) END) END AS rank FROM f LEFT JOIN r USING (query_id, id))"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers made of documents: their first three words as names."""
    key = F.col("doc_id")
    name = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), 1, 3), " ")
    digits = F.lpad((key * 7919 % 100000000).cast("string"), 8, "0")
    return table(spark, sf_dir, "documents").select(key.alias("id"), name.alias("full_name"), F.concat(F.lit("C"), F.lpad(key.cast("string"), 6, "0")).alias("customer_code"), F.concat(F.lit("98"), digits).alias("mobile"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.col("source").alias("district"))


@registered(f"WITH {_ranked_sql("SELECT 0 AS query_id, 'the of' AS q")} SELECT id, round(rank, 6) AS rank FROM g ORDER BY CAST(rank AS FLOAT) DESC, id LIMIT 25")
def q_customer_search(spark, sf_dir):
    """The first page of a search for two words."""
    return search.search(_people(spark, sf_dir), "the of").select("id", F.round(F.col("rank").cast("double"), 6).alias("rank"))


@registered(f"WITH {_ranked_sql(f'SELECT id AS query_id, {_ASKED} AS q FROM people WHERE id % 100 = 0')} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CAST(rank AS FLOAT) DESC, id) AS INT) AS place, id, round(rank, 6) AS rank FROM g QUALIFY place <= 25")
def q_search_batch(spark, sf_dir):
    """The first page for every hundredth customer's name, part of a name, code or number, by one index."""
    people = _people(spark, sf_dir)
    key, name = F.col("id"), F.col("full_name")
    kind = F.floor(key / 100) % 6
    asked = F.when(kind == 0, name).when(kind == 1, F.split_part(name, F.lit(" "), F.lit(1))).when(kind == 2, F.left(name, F.length(name) - 2)).when(kind == 3, F.lower("customer_code")).when(kind == 4, F.concat(F.lit("+91 "), "mobile")).otherwise(F.right("mobile", F.lit(6)))
    found = search.search_batch(search.search_index(people), people.where(key % 100 == 0).select(key.alias("query_id"), asked.alias("text")))
    return found.select("query_id", "place", "id", F.round(F.col("rank").cast("double"), 6).alias("rank"))


_KEPT_LIST = "list_transform(range(0, least(20, event_id % 30)), lambda x: CAST(x AS VARCHAR))"


@registered(f"""
SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE '{{"event":' || event_id || ',"props":' || replace(props, ' ', '') || ',"user_email":"[redacted:string:' || length('u' || user_id || '@example.test') || ']","note":"' || CASE event_id % 3 WHEN 0 THEN 'call [redacted:mobile] "now"' WHEN 1 THEN 'id [redacted:id12] and [redacted:pan]' ELSE 'mail [redacted:email] to [redacted:digits]' END ||
  '","list":[' || array_to_string({_KEPT_LIST}, ',') || CASE WHEN event_id % 30 > 20 THEN ',"[+' || (event_id % 30 - 20) || ' more]"' ELSE '' END || '],"tokens":"[redacted:array:2]","sessionId":null,"a":{{"b":{{"c":{{"d":{{"e":{{"f":"[redacted:depth]"}}}}}}}}}}}}' END AS props FROM events
""".replace('"now"', '\\"now\\"'))
def q_redact_json(spark, sf_dir):
    """JSON made of events with sensitive members described, strings scrubbed, long lists and deep members cut."""
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    note = F.when(key % 3 == 0, 'call 98765 43210 \\"now\\"'.replace(" 43", "43")).when(key % 3 == 1, "id 1234 5678 9012 and ABCDE1234F").otherwise("mail a.b@example.test to 123456789")
    items = F.when(key % 30 == 0, F.array().cast("array<string>")).otherwise(F.sequence(F.lit(0), (key % 30 - 1).cast("int")).cast("array<string>"))
    text = F.concat(F.lit('{"event": '), key, F.lit(', "props": '), "props", F.lit(', "user_email": "u'), user, F.lit('@example.test", "note": "'), note, F.lit('", "list": ['), F.array_join(items, ", "), F.lit('], "tokens": [1, 2], "sessionId": null, "a": {"b": {"c": {"d": {"e": {"f": ['), user, F.lit("]}}}}}}"))
    text = F.when(key % 50 == 7, F.concat("props", F.lit("}"))).otherwise(text)
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "event_id")
    return events.select("event_id", P.redact_json(text).alias("props"))


@registered("SELECT c_custkey, c_name AS opened, true AS sealed_differs, true AS wrong_context FROM customer")
def q_seal(spark, sf_dir):
    """Values sealed and opened again; the wrong context opens nothing."""
    key, aad = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").withColumn("s", P.seal(F.col("c_name"), key, aad))
    return rows.select("c_custkey", P.unseal(F.col("s"), key, aad).alias("opened"), (F.col("s") != F.col("c_name")).alias("sealed_differs"), P.unseal(F.col("s"), key, F.lit("x")).isNull().alias("wrong_context"))


_FIELD_LABEL = "CASE c_custkey % 6 WHEN 0 THEN 'captcha_code' WHEN 1 THEN 'Enter OTP' WHEN 2 THEN 'adoption-status' WHEN 3 THEN 'Card Number' WHEN 4 THEN 'District' ELSE c_mktsegment END"
_FIELD_COLUMNS = ("signature", "tag_name", "input_type", "name", "id", "placeholder", "label_text", "aria_label", "nearby_text", "section_heading", "class_name", "autocomplete")


def _form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields made of customers: the label by key, every seventh a submit control."""
    own = {"signature": F.col("c_name"), "tag_name": F.lit("input"), "input_type": F.when(F.col("c_custkey") % 7 == 0, "submit").otherwise("text"), "label_text": F.expr(_FIELD_LABEL)}
    return table(spark, sf_dir, "customer").select("c_custkey", *[own.get(c, F.lit(None).cast("string")).alias(c) for c in _FIELD_COLUMNS])


@registered("SELECT c_custkey, CASE WHEN c_custkey % 6 = 3 THEN 'payment' WHEN c_custkey % 6 = 0 THEN 'captcha' WHEN c_custkey % 6 = 1 THEN 'otp' WHEN c_custkey % 7 = 0 THEN 'submit' ELSE 'normal' END AS safety_class FROM customer")
def q_field_safety(spark, sf_dir):
    """Which form fields a person has to fill."""
    return field_match.safety_class(_form_fields(spark, sf_dir)).select("c_custkey", "safety_class")


# Example entries: a segment's name as a label, another for one word of it, two that tie.
FIELD_ENTRIES = [(1, "segment.building", ["building"], None, None, None, False, None), (2, "segment.household", ["household goods", "household"], None, None, ["number"], False, None), (3, "place.district", ["district"], None, None, None, False, None), (4, "place.home", ["district"], None, None, None, False, None), (5, "status.adoption", ["adoption"], None, ["captcha"], None, False, None)]


@registered(f"""
WITH f AS (SELECT c_custkey, {_FIELD_LABEL} AS l FROM customer)
SELECT c_custkey, CASE l WHEN 'BUILDING' THEN 'segment.building' WHEN 'HOUSEHOLD' THEN 'segment.household' WHEN 'District' THEN 'place.district' WHEN 'adoption-status' THEN 'status.adoption' END AS dictionary_field,
  CAST(CASE l WHEN 'BUILDING' THEN 1.0 WHEN 'HOUSEHOLD' THEN 0.5 WHEN 'District' THEN 0.65 WHEN 'adoption-status' THEN 0.8 END AS DOUBLE) AS dictionary_score FROM f
""")
def q_field_dictionary(spark, sf_dir):
    """What each form field means by its best dictionary entry."""
    return field_match.dictionary_match(_form_fields(spark, sf_dir), values(spark, field_match.ENTRIES, FIELD_ENTRIES)).select("c_custkey", "dictionary_field", "dictionary_score")


@registered(f"""
WITH f AS (SELECT c_custkey, {_FIELD_LABEL} AS l FROM customer)
SELECT c_custkey, CASE l WHEN 'District' THEN 'place' WHEN 'Card Number' THEN 'card' END AS adapter_field, CAST(CASE l WHEN 'District' THEN 8 WHEN 'Card Number' THEN 4 END AS INTEGER) AS adapter_score FROM f
""")
def q_field_adapter(spark, sf_dir):
    """What each form field means by the rules of an adapter."""
    rules = [(1, "place", "place", None, ["dist", "District:"], None), (2, "card", "card", None, ["card"], ["captcha"])]
    return field_match.adapter_match(_form_fields(spark, sf_dir), values(spark, field_match.ADAPTER_RULES, rules)).select("c_custkey", "adapter_field", "adapter_score")


# Example rules: an order's printed lines.
ORDER_RULES = [(1, "order.year", "year", ["year"], None, None, False), (2, "order.total", "number", ["total"], ["tax"], ["O", "F"], False), (3, "order.priority", "text", ["priority"], None, None, True)]


@registered("""
WITH o AS (SELECT o_orderkey AS document_id, o_orderstatus AS k, CAST(floor(o_totalprice) AS BIGINT) AS t, year(o_orderdate) AS y, o_orderpriority AS p FROM orders)
SELECT document_id, 'order.year' AS key, CAST(y AS VARCHAR) AS value, CAST(0.95 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS review_reason FROM o
UNION ALL SELECT document_id, 'order.total', CAST(t AS VARCHAR), 0.88, 'medium_confidence' FROM o WHERE k IN ('O', 'F')
UNION ALL SELECT document_id, 'order.priority', p, 0.8, 'high_risk_field' FROM o
""")
def q_extract_fields(spark, sf_dir):
    """Fields of orders, printed as lines and read again by label rules."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"), "o_orderkey")
    line = lambda no, label, value: F.struct(F.lit(no).alias("line_no"), F.lit(label).alias("label"), value.cast("string").alias("value"))
    printed = F.array(line(0, "Year", F.year("o_orderdate")), line(1, "Grand Total", F.floor("o_totalprice").cast("bigint")), line(2, "Order Priority level", F.col("o_orderpriority")), line(3, "Tax total", F.lit(1)))
    lines = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("document_type"), F.lit(1.0).alias("ocr_confidence"), F.explode(printed).alias("l")).select("document_id", "document_type", "ocr_confidence", "l.*")
    lines = lines.withColumn("raw", F.concat_ws(": ", "label", "value"))
    return extraction.extract_fields(lines, values(spark, extraction.RULES, ORDER_RULES)).select("document_id", "key", "value", "confidence", "review_reason")
