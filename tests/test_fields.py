"""Field extraction and form fields: cases of single rules, nulls and empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import normalize as N
from lumenfold.operators import extraction as X
from lumenfold.operators import field_match as M

LINES = "document_id int, line_no int, raw string, label string, value string, document_type string, ocr_confidence double"
RULES = [
    (1, "customer.full_name", "name", ["name", "नाम"], ["father", "पिता"], ["card", "form"], False),
    (2, "customer.father_name", "name", ["father's name", "पिता का नाम"], None, ["form"], False),
    (3, "customer.pincode", "pincode", ["pin code"], None, ["form"], False),
    (4, "customer.pan", "pan", ["pan"], None, ["card"], True),
    (5, "customer.aadhaar_last4", "aadhaar", ["aadhaar"], None, ["card"], True),
]


def line(doc, no, label, value, kind="form", ocr=1.0):
    return doc, no, f"{label}: {value}" if label else value, label, value, kind, ocr


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, X.RULES)


def extracted(spark, rules, rows):
    found = X.extract_fields(spark.createDataFrame(rows, LINES), rules).collect()
    return {(r.document_id, r.key): (r.value, r.confidence, r.review_reason) for r in found}


def test_fields_by_label(spark, rules):
    got = extracted(spark, rules, [
        line(1, 0, "Name", " Asha  Devi "), line(1, 1, "पिता का नाम / Father's Name", "Ram"), line(1, 2, "PIN Code", "261001", ocr=0.9),
        line(1, 3, "Applicant name here", "Second"), line(1, 4, "Surnames", "Nobody"), line(2, 0, "PIN Code", "261001", kind="card"), line(3, 0, "Name", "A 12345"), line(4, 0, None, None),
    ])
    assert got == {
        (1, "customer.full_name"): ("Asha Devi", 0.95, None),
        (1, "customer.father_name"): ("Ram", 0.88, "medium_confidence"),
        (1, "customer.pincode"): ("261001", 0.855, "medium_confidence"),
    }


def test_not_understood_and_ambiguous(spark, rules):
    rows = spark.createDataFrame([line(1, 0, "PIN Code", "9"), line(2, 0, "aadhaar pan", "234123412346", kind="card")], LINES)
    assert [tuple(r) for r in X.warnings(rows, rules).collect()] == [(1, "VALUE_NOT_UNDERSTOOD", "customer.pincode"), (2, "VALUE_NOT_UNDERSTOOD", "customer.pan")]
    doubt = X.matched_lines(spark.createDataFrame([line(2, 0, "aadhaar pan", "ABCDE1234F", kind="card")], LINES), rules).head()
    assert (doubt.key, doubt.confidence, doubt.review_reason) == ("customer.pan", 0.66, "ambiguous_match")


def test_unlabelled_identifiers_only_where_allowed(spark, rules):
    got = extracted(spark, rules, [line(1, 0, None, "abcde1234f", kind="card"), line(1, 1, None, "2341 2341 2346", kind="card"), line(2, 0, None, "ABCDE1234F"), line(3, 0, None, "234123412347", kind="card"), line(4, 0, "PAN", "ABCDE1234F", kind="card"), line(4, 1, None, "XYZAB9876C", kind="card")])
    assert got == {
        (1, "customer.pan"): ("ABCDE1234F", 0.85, "high_risk_field"),
        (1, "customer.aadhaar_last4"): ("2346", 0.85, "high_risk_field"),
        (4, "customer.pan"): ("ABCDE1234F", 0.95, "high_risk_field"),
    }


def test_no_full_number_leaves(spark, rules):
    got = X.extract_fields(spark.createDataFrame([line(1, 0, "Name", "X 2341-2341-2346"), line(2, 0, None, "2341 2341 2346", kind="card")], LINES), rules).collect()
    assert [(r.value, r.source_text) for r in got] == [("2346", "XXXX XXXX 2346")]


def test_values_by_kind(spark):
    cases = [
        ("gender", "Female / महिला", None), ("gender", "महिला", "female"), ("category", "Scheduled  Caste", "sc"), ("number", "₹ 1,20,000/-", "120000"), ("number", "12a", None),
        ("year", "March 2019", "2019"), ("year", "20191", None), ("date", "05/04/1999", "1999-04-05"), ("text", "x" * 300, "x" * 200), ("text", "  ", None), ("text", None, None), ("longtext", "x" * 600, "x" * 500),
    ]
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, raw string")
    got = rows.select("i", X.normalize_value(F.col("raw"), F.col("kind"))["value"].alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [c[2] for c in cases]


def test_extraction_of_nothing(spark, rules):
    assert X.extract_fields(spark.createDataFrame([], LINES), rules).count() == 0
    assert X.extract_fields(spark.createDataFrame([line(1, 0, "Name", "A")], LINES), rules.limit(0)).count() == 0


COLUMNS = ("signature", "tag_name", "input_type", "name", "id", "placeholder", "label_text", "aria_label", "nearby_text", "section_heading", "class_name", "autocomplete")


def fields(spark, *rows):
    return spark.createDataFrame([tuple({"signature": str(i), "tag_name": "input", "input_type": "text"}.get(c) if c not in r else r[c] for c in COLUMNS) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in COLUMNS))


def test_safety(spark):
    cases = [
        ({"name": "captcha_code"}, "captcha"), ({"label_text": "Enter OTP"}, "otp"), ({"name": "adoption_status"}, "normal"), ({"label_text": "CVV / security code"}, "payment"),
        ({"autocomplete": "cc-exp"}, "payment"), ({"input_type": "submit"}, "submit"), ({"id": "pay-now"}, "submit"), ({"label_text": "Submit date"}, "normal"), ({"name": None}, "normal"), ({"label_text": "सुरक्षा कोड"}, "captcha"),
    ]
    got = M.safety_class(fields(spark, *[c for c, _ in cases])).orderBy(F.col("signature").cast("int")).collect()
    assert [r.safety_class for r in got] == [k for _, k in cases]


ENTRIES = [
    (1, "customer.full_name", ["name", "applicant name"], ["full_name"], ["father"], ["text"], False, "upper"),
    (2, "customer.father_name", ["father name"], ["fname"], None, None, True, None),
    (3, "customer.district", ["district"], ["district"], None, ["select-one"], False, None),
    (4, "customer.home_district", ["district"], None, None, ["select-one"], False, None),
]


def test_dictionary(spark):
    cases = [
        ({"label_text": "Applicant Name"}, ("customer.full_name", 1.0)), ({"name": "fullName"}, ("customer.full_name", 0.95)), ({"label_text": "Father Name *"}, ("customer.father_name", 1.0)),
        ({"name": "x_full_name_y"}, ("customer.full_name", 0.72)), ({"placeholder": "name", "input_type": "email"}, ("customer.full_name", 0.45)), ({"nearby_text": "the father name is"}, ("customer.full_name", 0.65)),
        ({"label_text": "District", "tag_name": "select"}, ("customer.district", 0.65)), ({}, (None, None)), ({"label_text": "unknown"}, (None, None)), ({"section_heading": "Your name"}, ("customer.full_name", 0.55)),
    ]
    got = M.dictionary_match(fields(spark, *[c for c, _ in cases]), spark.createDataFrame(ENTRIES, M.ENTRIES)).orderBy(F.col("signature").cast("int")).collect()
    assert [(r.dictionary_field, r.dictionary_score) for r in got] == [k for _, k in cases]


def test_adapter_rules(spark):
    rules = spark.createDataFrame([(1, "applicantName", "customer.full_name", "#nm", ["Name of applicant"], ["father"]), (2, "dist", "customer.district", None, ["District:"], None)], M.ADAPTER_RULES)
    cases = [
        ({"signature": "form#nm", "name": "q"}, ("customer.full_name", 1000)), ({"name": "applicant_name"}, ("customer.full_name", 900)), ({"id": "txt_applicantName_1"}, ("customer.full_name", 800)),
        ({"label_text": "(Name of applicant)"}, ("customer.full_name", 17)), ({"label_text": "Father: name of applicant"}, (None, None)), ({"label_text": "District"}, ("customer.district", 8)), ({}, (None, None)),
    ]
    rows = fields(spark, *[c for c, _ in cases]).withColumn("i", F.monotonically_increasing_id())
    assert [(r.adapter_field, r.adapter_score) for r in M.adapter_match(rows, rules).orderBy("i").collect()] == [k for _, k in cases]


def test_instructions_and_edits(spark):
    mappings = [(1, s, "input", "text", f, c, k, 7) for s, f, c, k in (("a", "x", "normal", None), ("b", "x", "otp", None), ("c", "x", "normal", "hidden"), ("d", "y", "normal", "low_confidence"), ("e", "x", "normal", None), ("f", "z", "normal", None), ("g", "x", "normal", None))]
    made = M.fill_instructions(
        spark.createDataFrame(mappings, "page_id int, signature string, tag_name string, input_type string, customer_field string, safety_class string, skip_reason string, customer_id int"),
        spark.createDataFrame([(7, "x", "one"), (7, "y", "two"), (7, "z", "")], "customer_id int, customer_field string, value string"),
        spark.createDataFrame([(1, s) for s in "abcdefa"], "page_id int, signature string"),
        spark.createDataFrame([(1, "a", "edited"), (1, "e", "")], "page_id int, signature string, value string"),
    )
    assert sorted((r.signature, r.value) for r in made.collect()) == [("a", "edited"), ("d", "two")]
    kept = spark.createDataFrame([(7, "a", "1", False), (7, "b", "1", False), (7, "c", "1", True), (7, "d", None, False)], "customer_id int, key string, value string, encrypted boolean")
    form = spark.createDataFrame([(7, "a", " 1 "), (7, "b", "2"), (7, "c", "1"), (7, "d", "  ")], "customer_id int, key string, value string")
    assert sorted((r.key, r.value) for r in M.edit_decisions(kept, form).collect()) == [("b", "2"), ("c", "1")]


def test_constants_are_few(spark):
    from lumenfold.sources.tables import constants

    assert len(constants(spark.range(3), 3)) == 3
    with pytest.raises(ValueError):
        constants(spark.range(4), 3)


def test_trim_as_patterns_do(spark):
    cases = ["", " ", "﻿ a b 　", " x", "y \n", None, "​z", "é  "]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")

    plain = lambda c: None if c is None else re.sub("^[%s]+|[%s]+$" % (N.BLANKS, N.BLANKS), "", c)
    assert [r.t for r in rows.select("i", N.trim(F.col("c")).alias("t")).orderBy("i").collect()] == [plain(c) for c in cases]
