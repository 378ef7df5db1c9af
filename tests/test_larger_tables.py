"""Queries on rows that only larger tables have: long keys, cut pages, few large files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.normalize import BLANKS
from lumenfold.functions.text import pasted_lines
from lumenfold.operators import duplicates, forms, runs, search, security
from lumenfold.plans import catalogue, intake_queries, records_queries, value_queries  # noqa: F401, the others add to the first


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    rows = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    want = sorted(map(str, rows.fetchall()))
    got = sorted(str(tuple(r)) for r in catalogue.queries()[name](spark, str(folder)).select(*names).collect())
    assert got == want and want
    return got


def test_verhoeff_of_longer_numbers(spark, tmp_path):
    keys = spark.range(106_000, 106_400).unionByName(spark.range(9_000_000, 9_000_400))
    keys.select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    got = same_as_sql(spark, tmp_path, "q_verhoeff")
    assert any("True, True" in r for r in got)


@pytest.mark.parametrize("heading", ["a&amp;&amp b", "a&amp;&amp", "k = &quot;x&quot; &lt;", "&#65; &amp;lt; &x"])
def test_page_fields_of_other_references(spark, tmp_path, heading):
    html = f"<html><body><main><article><h1>{heading}</h1><p>t</p></article></main><footer>f</footer></body></html>"
    spark.createDataFrame([(n, "http://x", html) for n in range(4)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    same_as_sql(spark, tmp_path, "q_page_fields")


def single_file(spark, folder, name, columns):
    """A table of one file, which one task reads."""
    spark.range(600).coalesce(1).select(*columns).write.parquet(f"{folder}/{name}.parquet")


def tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("name", ["q_pasted_runs", "q_pasted_fields"])
def test_pasted_texts_of_one_file(spark, tmp_path, monkeypatch, name):
    single_file(spark, tmp_path, "customer", [F.col("id").alias("c_custkey"), F.format_string("Customer#%d", "id").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment")])
    kept, stored = [], runs.stored
    monkeypatch.setattr(runs, "stored", lambda df: kept.append(tasks(df)) or stored(df))
    same_as_sql(spark, tmp_path, name)
    assert min(kept) > 1, "all texts in one task"


def test_blank_lines_are_cut_at_once(spark):
    texts = ["a: 1\n\n \r\n \nb\t\n", "\n \n", "", " x \n\n", "a\r\rb , c: d", "​\n﻿q　\n"]
    own = [[x.strip(BLANKS) for x in t.replace("​", "").replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").split("\n")] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", pasted_lines(F.col("t"), None).alias("x")).orderBy("n").collect()
    want = [[y for y in x if y] for x in own]
    want[4] = ["a", "b", "c: d"]
    assert [r.x for r in rows] == want


def test_wide_rows_are_made_in_many_tasks(spark, tmp_path):
    key = F.col("id")
    single_file(spark, tmp_path, "customer", [key.alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("m").alias("c_mktsegment")])
    single_file(spark, tmp_path, "events", [key.alias("event_id"), key.alias("user_id"), F.lit("click").alias("event_type"), F.lit('{"k": 1}').alias("props")])
    for name in ("q_seeded_records", "q_audit", "q_redact_json"):
        assert tasks(catalogue.queries()[name](spark, str(tmp_path))) > 1, name


def test_permissions_are_not_shuffled(spark):
    members = spark.createDataFrame([(1, 1, "owner", "active"), (1, 1, "viewer", "active"), (1, 2, "guest", "active"), (None, 3, "viewer", "active"), (2, 1, "owner", "suspended")], "org int, user_id int, role string, status string")
    out = security.granted(members, security.permissions(spark, security.MANAGER))
    assert {(r.org, r.user_id) for r in out.collect()} == {(1, 1), (None, 3)}
    assert out.where("org = 1").count() == len(set(security.MANAGER)) and out.where("org is null").count() == len(security.VIEWER)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "permission" not in [line for line in plan.splitlines() if "Aggregate" in line][0]


def test_dependency_depths_send_no_table_to_the_driver(spark):
    chain = spark.range(64).select(F.lit("s").alias("slug"), F.col("id").alias("key"), (F.col("id") - 1).alias("depends_on"))
    parents = chain.select("slug", "key", F.when(F.col("key") > 0, F.col("depends_on")).alias("at"), F.lit(1).alias("steps"), F.lit(0).alias("root"))
    assert "BroadcastHashJoin" not in forms._jumped(parents)._jdf.queryExecution().executedPlan().toString()
    assert {r.key: r.depth for r in forms.dependency_depths(chain).collect()} == {n: n for n in range(64)}


RECORDS = "id long, full_name string, mobile string, date_of_birth string, father_name string, district string"


def records(spark, n):
    return spark.range(n).selectExpr("id", "concat('amit kumar', if(id % 3 = 0, ' lal', ''))", "if(id % 4 = 0, '9876543210', null)", "'1990'", "if(id % 2 = 0, 'ramesh', 'sunil')", "'Gaya'").toDF(*[c.split()[0] for c in RECORDS.split(", ")])


def test_pairs_of_alike_names_compare_no_texts(spark):
    rows = records(spark, 12)
    plan = duplicates.find(rows, rows)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    by_name = plan[: next(i for i, line in enumerate(plan) if line.startswith("+- "))]
    assert "Join" in "".join(by_name) and "levenshtein" not in "".join(by_name)


def test_pairs_of_batches_are_not_stored(spark, tmp_path, monkeypatch):
    rows, kept, stored = records(spark, 12), [], duplicates.stored
    monkeypatch.setattr(duplicates, "stored", lambda df: kept.append(df.columns) or stored(df))
    index = duplicates.DuplicateIndex(spark, str(tmp_path / "index"))
    first, second = (index.add(rows.where(f"id % 2 = {i}")) for i in range(2))
    assert kept and not any("subject_id" in c for c in kept)
    pairs = {(r.subject_id, r.candidate_id) for r in first.unionByName(second).collect()}
    assert pairs == {(x, y) for x in range(12) for y in range(12) if x != y}


def test_queries_of_one_text_are_searched_once(spark, monkeypatch):
    people = spark.range(40).selectExpr("id", "concat('amit kumar', id % 3) full_name", "concat('C', id) customer_code", "timestamp'2024-01-01' created_at")
    index, kept, stored = search.search_index(people), [], search.stored
    monkeypatch.setattr(search, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    asked = spark.createDataFrame([(n, ["Amit", " amit ", "AMIT", "kumar1", ""][n % 5]) for n in range(50)], "query_id int, text string")
    found = {}
    for r in search.search_batch(index, asked, 7).collect():
        found.setdefault(r.query_id % 5 if r.query_id % 5 > 2 else 0, {}).setdefault(r.query_id, set()).add((r.place, r.id, r["rank"]))
    assert kept[0].count() == 2, "one row a text"
    assert [len(found[k]) for k in (0, 3, 4)] == [30, 10, 10]
    assert all(len(set(map(frozenset, f.values()))) == 1 and len(next(iter(f.values()))) == 7 for f in found.values())


def test_pairs_of_one_name_take_few_rows_dealt(spark, tmp_path, monkeypatch):
    """What a name asks and offers is dealt out, each of more than MOST rows: rows are repeated by the other side's deals alone, and those met before are dealt once."""
    monkeypatch.setattr(duplicates, "MOST", 16)
    rows = spark.range(60).selectExpr("id", "'amit kumar' full_name", "if(id % 5 = 0, '9876543210', null) mobile", "if(id % 2 = 0, '1990', '1991') date_of_birth", "if(id % 3 = 0, 'ramesh', 'sunil') father_name", "'' district")
    kept, met = [], duplicates._met

    def dealt(asked, offered):
        kept.append((asked.count(), offered.count(), met(asked, offered)))
        return kept[-1][-1]

    monkeypatch.setattr(duplicates, "_met", dealt)
    want = {(x, y): ((x % 5 == 0 == y % 5, x % 2 == y % 2, (x % 3 == 0) == (y % 3 == 0))) for x in range(60) for y in range(60) if x != y}
    score = lambda mobile, born, father: 0.97 if mobile else 0.95 if born else 0.88 if father else 0.65
    got = {(r.subject_id, r.candidate_id): r.score for r in duplicates.find(rows, rows).collect()}
    assert got == {ids: score(*rules) for ids, rules in want.items()}
    by_name = kept[0][-1].where("kind = 0")
    assert by_name.count() == 60 * 60 and by_name.select("part").distinct().count() > 9
    kept.clear()
    index = duplicates.DuplicateIndex(spark, str(tmp_path / "index"))
    found = [index.add(rows.where(f"id % 2 = {i}")) for i in range(2)]
    again = {(r.subject_id, r.candidate_id): r.score for r in found[0].unionByName(found[1]).collect()}
    assert again == got
    asked, offered, _ = kept[2]
    assert (asked, offered) == (30, 60 * 4), "each record offers its name, and that with its district, birth date and father, once"
