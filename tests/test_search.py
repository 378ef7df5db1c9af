"""Batch search against the search over the whole table, and ranks against known values."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import search

PEOPLE = "id bigint, full_name string, customer_code string, mobile string, district string, created_at timestamp"


def rank(spark, document, query):
    return spark.range(1).select(text.text_rank(F.lit(document), F.lit(query)).alias("x")).head().x


def test_known_ranks(spark):
    """Values that a text-search database gives."""
    assert rank(spark, "a b", "a b") == pytest.approx(0.0991032, abs=1e-6)
    assert rank(spark, "a x b", "b a a") == pytest.approx(0.0985009, abs=1e-5)
    assert rank(spark, "a b a", "a b") == pytest.approx(1 - (1 - 0.0991032) ** 2, abs=1e-6)
    assert rank(spark, "a", "a") == pytest.approx(0.0607927, abs=1e-6)
    assert rank(spark, "a a", "a") == pytest.approx(0.0759909, abs=1e-6)
    assert rank(spark, "c", "a") == 0 and rank(spark, "a", "a b") == 1e-20 and rank(spark, "", "") == 0


def people(spark):
    rng = random.Random(9)
    names = ["Amit", "Kumar", "Singh", "Sunita", "Devi", "Ram", "Prasad", "Éva", "राम", "O'Neil-Smith"]
    rows = [(i, " ".join(rng.choices(names, [9, 9, 9, 3, 3, 2, 2, 1, 1, 1], k=rng.randrange(1, 4))), f"C{i:04d}", rng.choice([f"+91 98{i:08d}", f"{i:05d}", None, "9876543210"]), rng.choice(["Sitapur", "Gaya", None]), None) for i in range(300)]
    rows += [(300, None, None, None, None, None), (301, "", "c0301", "", "Gaya", None), (302, "  ", "C0001", "12", None, None)]
    return spark.createDataFrame(rows, PEOPLE).withColumn("created_at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 7 as int))"))


QUERIES = ["amit kumar", "Kumar", "sunita devi sitapur", "Amt Kumr", "c0007", "C0001", "9876543210", "+91 98 0000 0012", "0042", "042", "eva", "राम", "smith o'neil", "kumar kumar", "zzz", "...", "   ", None, "devi unknownword", "Ram"]


def test_a_batch_gives_what_each_query_gives(spark):
    rows = people(spark)
    index = search.search_index(rows)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    got = {}
    for r in search.search_batch(index, asked, 12).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.rank, 6)))
    for i, q in enumerate(QUERIES):
        want = search.search(rows.withColumn("deleted_at", F.lit(None).cast("timestamp")), q, limit=12).select("id", "rank").collect()
        assert got.get(i, []) == [(r.id, round(r["rank"], 6)) for r in want], q


def test_a_batch_scans_no_customers_for_each_query(spark):
    index = search.search_index(people(spark))
    plan = search.search_batch(index, spark.createDataFrame([(1, "amit")], "query_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert search.search_batch(search.search_index(people(spark).limit(0)), spark.createDataFrame([(1, "amit"), (2, None)], "query_id int, text string")).count() == 0


def test_names_that_share_too_few_rare_trigrams_are_not_compared(spark):
    rows = spark.createDataFrame([(14, 14, 1), (14, 14, 2), (14, 14, 3), (4, 13, 3), (4, 13, 1), (1, 1, 1)], "x int, y int, shared int")
    got = rows.withColumn("may", search._may_be_similar(F.col("shared"), F.col("x"), F.col("y"))).collect()
    # of 14 the four most frequent are left out, of 13 three: 3 + 4 of 28 reach 0.3, 2 + 4 of them do not
    assert [r.may for r in got] == [False, False, True, True, True, True]
    people = spark.range(300).selectExpr("id", "concat(chr(97 + id % 7), 'mit ', chr(97 + id % 11), 'umar', id % 5) full_name", "concat('C', id) customer_code", "timestamp'2024-01-01' created_at")
    index = search.search_index(people)
    found = {r.id for r in search.search_batch(index, spark.createDataFrame([(1, "amit kumar1")], "query_id int, text string"), 300).collect()}
    assert found == {r.id for r in search.ranked(people.withColumn("mobile", F.lit(None).cast("string")), "amit kumar1").collect()}
