"""The catalogue against its SQL, and cases of single functions and operators."""

import collections
import datetime
import decimal
import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import normalize as N
from lumenfold.functions import privacy as P
from lumenfold.functions import text as T
from lumenfold.operators import documents, duplicates, lifecycle, security, snapshots
from lumenfold.plans import catalogue, intake_queries, records_queries, value_queries  # noqa: F401, the others add to the first
from lumenfold.sources import ocr, tables
from lumenfold.streaming import metering as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    r = duck.sql(catalogue.oracle_sql()[name])
    at = [r.columns.index(c) for c in cols]
    assert len(r.columns) == len(cols)
    assert got == collections.Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def one(spark, *columns):
    return list(spark.range(1).select(*columns).head())


def test_masks(spark):
    lit = F.lit
    assert one(spark, P.mask_aadhaar(lit("1234 5678 9012")), P.mask_pan(lit("ABCDE1234F")), P.mask_mobile(lit("9876543210")), P.mask_account(lit("123456")), P.mask_name(lit("Amit Kumar")), P.preview(lit("abcdef")), P.preview(lit(""))) == ["XXXX XXXX 9012", "ABC••••4F", "••••••3210", "••3456", "A… K…", "ab…(6)", ""]
    assert one(spark, P.mask_identifiers(lit("no 1234-5678-9012.")), P.has_identifier(lit("12345678901"))) == ["no XXXX XXXX 9012.", False]


def test_redact(spark):
    df = spark.createDataFrame([('{"full_name":"A","n":1,"note":"call 9876543210","sessionId":"s","list":[1,null]}',), ("no json",), (None,)], "s string")
    assert [r[0] for r in df.select(P.redact_json(F.col("s"))).collect()] == ['{"full_name":"[redacted:string:1]","n":1,"note":"call [redacted:mobile]","sessionId":"s","list":[1,null]}', None, None]


def test_text(spark):
    lit = F.lit
    assert one(spark, T.normalize_label(lit("applicantName_(Full)*")), T.confidence(lit(3)), T.form_signature(lit("")), T.storage_org(lit("0aa11111-1111-1111-1111-111111111111/x"))) == ["applicant name full", 0.6, "ztntfp", "0aa11111-1111-1111-1111-111111111111"]
    assert one(spark, T.pasted_lines(lit("Name: A, Father: B\r\nAddress: H 1, Rampur"))) == [["Name: A", "Father: B", "Address: H 1, Rampur"]]
    assert one(spark, T.mime_type(lit(b"%PDF-1.4")), T.mime_type(lit(b"RIFF0000WEBP")), T.mime_type(lit(b"RIFF0000WAVE"))) == ["application/pdf", "image/webp", None]
    assert one(spark, T.trigram_similarity(lit("word"), lit("two words")))[0] == pytest.approx(4 / 11)
    assert one(spark, N.format_inr(lit(123456)), N.format_inr(lit(-5)), N.search_mobile(lit("+91 98765-43210"))) == ["₹1,23,456", "-₹5", "9876543210"]


def test_similarity(spark):
    a, b, c = one(spark, T.name_similarity(F.lit("Amit Kumar Singh"), F.lit("Amit Singh")), T.name_similarity(F.lit("X"), F.lit("")), T.name_similarity(F.lit("अमित कुमार"), F.lit("अमित कुमारी")))
    assert a == 0.95 and b == 0 and c > 0.85


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "Amit Kumar", "9876543210", "1990-01-01", "Ram", "X"), (2, "Amit Kumar", "+919876543210", None, None, None), (3, "Sita Devi", None, "1990-01-01", None, "X"), (4, "Amit Kumar", None, "1990-01-01", "Ram", "Y")], "id int, full_name string, mobile string, date_of_birth string, father_name string, district string")
    found = {(r.subject_id, r.candidate_id): (r.score, r.confidence, r.reasons) for r in duplicates.find(rows, rows).collect()}
    assert found[1, 2] == (0.97, "high", ["SAME_MOBILE"])
    assert found[1, 4] == (0.95, "high", ["SAME_NAME_AND_DOB", "SAME_NAME_AND_FATHER"])
    assert found[2, 4] == found[4, 2] == (0.65, "low", ["SIMILAR_NAME"])  # equal names, whatever else differs
    assert (1, 3) not in found and len(found) == 6


def test_snapshots(spark):
    tokens = spark.createDataFrame([(1, None, "2030-01-01"), (2, "2020-01-01", "2030-01-01"), (3, None, "2020-01-01")], "id int, consumed_at string, expires_at string")
    out = snapshots.consume(tokens, F.lit(True), F.lit("2024-01-01"))
    assert [r.consumed_at for r in out.orderBy("id").collect()] == ["2024-01-01", "2020-01-01", None]


def test_claim_reclaims(spark, sf):
    jobs = value_queries._jobs(spark, sf)
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    assert lifecycle.claim(jobs, "w", now, batch=10_000).where("status = 'running' and locked_by is null").count() > 0
    assert lifecycle.claim(jobs.withColumn("locked_until", F.lit("2024-01-01").cast("timestamp")), "w", now, batch=10_000, reclaim_expired=True).where("status = 'running' and locked_by is null and run_after <= timestamp'2024-01-15 00:00:00'").count() == 0


def test_billing_admin_reads_no_customers(spark):
    members = spark.createDataFrame(catalogue.MEMBERS, "org int, user_id string, role string, status string")
    rows = spark.range(10).select(F.col("id").cast("int").alias("org"))
    assert sorted(r.org for r in security.secure(rows, members, "u1").collect()) == [1, 2, 7]
    assert [r.org for r in security.secure(rows, members, "u1", security.BILLING_MANAGE).orderBy("org").collect()] == [1, 4]


def test_ocr(spark):
    docs = spark.createDataFrame([("a", "a.txt", bytearray("Name: A\n\nDOB: B\nC".encode())), ("b", "b.png", bytearray(b"\x00\x01\x02\x03")), ("c", "c.png", bytearray(b""))], "document_id string, filename string, content binary")
    known = spark.createDataFrame([("b.png", "known text")], "filename string, text string")
    text = {r.document_id: r.text for r in ocr.recognised(docs, known).collect()}
    assert text == {"a": "Name: A\n\nDOB: B\nC", "b": "known text", "c": ""}
    assert [(r.text, r.y0, r.y1) for r in ocr.blocks(ocr.recognised(docs, known)).where("document_id = 'a'").orderBy("block_no").collect()] == [("Name: A", 60, 78), ("DOB: B\nC", 92, 128)]


def test_single_rows(spark):
    assert tables.maybe_one(spark.range(0)) is None and tables.exactly_one(spark.range(1)).id == 0
    with pytest.raises(ValueError):
        tables.maybe_one(spark.range(2))
    with pytest.raises(LookupError):
        tables.exactly_one(spark.range(0))


def test_classify_picture_and_tie(spark):
    signals = spark.createDataFrame(catalogue.SIGNALS, "class_no int, document_type string, strong array<string>, weak array<string>, filename_words array<string>")
    docs = spark.createDataFrame([("a", "", "x.png", "image/png", None), ("b", "that the end of the text and more", "x", "application/pdf", None), ("c", "the ein words without an end", "x", "text/plain", None)], "document_id string, text string, filename string, mime_type string, hinted_type string")
    assert [r.document_type for r in documents.classify(docs, signals).orderBy("document_id").collect()] == ["photo", "english", "unknown"]


def test_streaming(spark, sf, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    usage = events.select(F.col("user_id").alias("org"), "event_type", F.lit(1).alias("quantity"), F.col("ts").cast("timestamp").alias("created_at"), "event_id")
    for name, df, mode in (("by_day", streaming.usage_by_window(usage.drop("event_id")), "complete"), ("once", streaming.once(usage, "event_id"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.table("by_day").agg(F.sum("total")).head()[0] == n and spark.table("once").count() == n
