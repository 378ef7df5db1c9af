"""JSON writes and redaction, and dependency depths, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import json_text, privacy
from lumenfold.operators import forms, records

CHANGES = "array<struct<path:array<string>,raw:string>>"


def written(spark, doc, changes, levels=3):
    rows = spark.createDataFrame([(doc, [{"path": p, "raw": r} for p, r in changes])], f"d string, c {CHANGES}")
    return rows.select(json_text.with_values(F.col("d"), F.col("c"), levels).alias("x")).head().x


@pytest.mark.parametrize(
    ("doc", "changes", "want"),
    [
        ('{ "n": 1.50, "e":2.0e5, "t" : true, "z":null, "l":[ 1,{"k" : 2}], "s":"q\\"\\u00e9\\/{" }', [(["new"], '"v"')], '{"n":1.50,"e":2.0e5,"t":true,"z":null,"l":[ 1,{"k" : 2}],"s":"q\\"\\u00e9\\/{","new":"v"}'),
        ('{"current":{"village":"R", "pin":1},"permanent":{"state":"UP"}}', [(["current", "district"], '"S"')], '{"current":{"village":"R","pin":1,"district":"S"},"permanent":{"state":"UP"}}'),
        ('{"a":[1],"b":"x"}', [(["a", "k"], "1"), (["b", "c", "d"], "null")], '{"a":{"k":1},"b":{"c":{"d":null}}}'),
        ("{}", [(["a"], "1"), (["a", "b"], "2"), (["a"], "3"), (["c", "d"], "4"), (["c", "e"], "5")], '{"a":3,"c":{"d":4,"e":5}}'),
        ('{"a":{"b":1}}', [(["a"], '"x"'), (["a", "c"], "2")], '{"a":{"c":2}}'),
        (None, [(["a"], "1")], '{"a":1}'), ("[1]", [(["a"], "1")], '{"a":1}'), ('{"a":1', [(["a"], "2")], '{"a":2}'), ('{"a":1} x', [(["b"], "2")], '{"b":2}'),
        ('{"long":"' + "\\n" * 9000 + '"}', [(["a"], "1")], '{"long":"' + "\\n" * 9000 + '","a":1}'),
        ('{"deep":' + "[" * 200 + "]" * 200 + "}", [(["a"], "1")], '{"deep":' + "[" * 200 + "]" * 200 + ',"a":1}'),
        ("[" * 200_000, [(["a"], "1")], '{"a":1}'),
    ],
)
def test_json_writes(spark, doc, changes, want):
    assert written(spark, doc, changes) == want


def test_json_writes_equal_plain_ones(spark):
    rng = random.Random(3)
    leaf = lambda: rng.choice([1, 2.5, True, None, "s", "é\"\\", [1, {"x": "y"}], [], {}])
    tree = lambda n: {k: tree(n - 1) if n and rng.random() < 0.5 else leaf() for k in rng.sample("abcd", rng.randrange(4))}

    def put(node, path, value):
        for p in path[:-1]:
            if not isinstance(node.get(p), dict):
                node[p] = {}
            node = node[p]
        node[path[-1]] = value

    rows, want = [], []
    for i in range(150):
        doc = tree(3)
        changes = [([rng.choice("abcde") for _ in range(rng.randrange(1, 4))], rng.choice(["v", None, "q\"z"])) for _ in range(rng.randrange(1, 5))]
        rows.append((i, json.dumps(doc, ensure_ascii=rng.random() < 0.5), [{"path": p, "raw": json.dumps(v)} for p, v in changes]))
        for p, v in changes:
            put(doc, p, v)
        want.append(doc)
    got = spark.createDataFrame(rows, f"i int, d string, c {CHANGES}").select("i", json_text.with_values(F.col("d"), F.col("c"), 3).alias("x")).collect()
    assert all(json.loads(r.x) == want[r.i] and list(json.loads(r.x)) == list(want[r.i]) for r in got)


def test_columns_that_no_change_names_stay(spark):
    profiles = spark.createDataFrame([(1, '{ "a" : 1.0 }'), (2, '{ "a" : 1.0 }'), (3, None)], "customer_id int, address string")
    changes = spark.createDataFrame([(1, "k", "x", "address", "b.c", None, "json"), (1, "k", "y", "other", "b", None, "json")], "customer_id int, key string, value string, target string, path string, skip_reason string, patch string")
    got = {r.customer_id: r.address for r in records.json_patched(profiles, changes, "address").collect()}
    assert got == {1: '{"a":1.0,"b":{"c":"x"}}', 2: '{ "a" : 1.0 }', 3: None}
    assert records.json_patched(profiles, changes.limit(0), "address").count() == 3


def redacted(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    return [r.x for r in rows.select("i", privacy.redact_json(F.col("d")).alias("x")).orderBy("i").collect()]


def test_redaction(spark):
    texts = ['{"customerId":"c-1","full_name":"Amit","mobile":"9900012345","list":[{"key":"customer.pan","value":"ZZZPD1234Q","confidence":0.91}],"raw_text":"x"}', '{"items":[' + ",".join(map(str, range(50))) + "]}", '{"a":{"b":{"c":{"d":{"e":{"f":{"g":"deep"}}}}}}}', '[[[[[[1,"mail a@b.co",[2]]]]]]]']
    assert redacted(spark, *texts) == [
        '{"customerId":"c-1","full_name":"[redacted:string:4]","mobile":"[redacted:string:10]","list":[{"key":"customer.pan","value":"[redacted:string:10]","confidence":0.91}],"raw_text":"[redacted:string:1]"}',
        '{"items":[' + ",".join(map(str, range(20))) + ',"[+30 more]"]}',
        '{"a":{"b":{"c":{"d":{"e":{"f":"[redacted:depth]"}}}}}}',
        '[[[[[[1,"mail [redacted:email]","[redacted:depth]"]]]]]]',
    ]
    odd = ['{"email":null,"cards":[1,2],"otp":true,"income":1.5,"dob":{"y":1},"sessionId":"call 9876543210","valueType":"t"}', '"id 1234 5678 9012"', "true", '{"u":"a\\ud800b"}', "[" * 200_000, "[" * 200_000 + "]" * 200_000, '{"a":1,"a":2}', '{"a":1}}', "", None, "{}", '{"n":"' + "é" * 300 + '"}', "not json"]
    got = redacted(spark, *odd)
    assert got[:3] == ['{"email":"[redacted:null]","cards":"[redacted:array:2]","otp":"[redacted:boolean]","income":"[redacted:number]","dob":"[redacted:object]","sessionId":"call [redacted:mobile]","valueType":"t"}', '"id [redacted:id12]"', "true"]
    assert got[3] == '{"u":"a?b"}' and got[4:10] == [None] * 6 and got[10] == "{}" and got[11] == '{"n":"' + "é" * 200 + '…[+100]"}' and got[12] is None
    plan = spark.range(1).select(privacy.redact_json(F.lit("{}")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_depths(rows):
    up, out = {}, {}
    for slug, key, parent in sorted(rows, key=str):
        up[(slug, key)] = max(filter(None, (parent, up.get((slug, key)))), default=None)
    for slug, key in up:
        seen, at = [key], up[(slug, key)]
        while at is not None and (slug, at) in up and at not in seen:
            seen.append(at)
            at = up[(slug, at)]
        out[(slug, key)] = len(seen) - 1
    return out


def test_dependency_depths(spark):
    rng = random.Random(1)
    rows = [(None, "k", "k2"), (None, "k2", None), ("", "k", "k"), ("", None, "k")]
    for s in range(15):
        n = rng.randrange(1, 25)
        rows += [(f"s{s}", f"k{i}", rng.choice([None, "missing"] + [f"k{j}" for j in range(n)] * 3)) for i in range(n)]
    rows += [("ring", f"c{i:04d}", f"c{(i - 1) % 300:04d}") for i in range(300)] + [("ring", "tail", "c0003"), ("ring", "self", "self"), ("ring", "u", "self"), ("ring", "v", "u"), ("ring", "v", "u")]
    got = {(r.slug, r.key): r.depth for r in forms.dependency_depths(spark.createDataFrame(rows, "slug string, key string, depends_on string")).collect()}
    assert got == plain_depths([r for r in rows if r[1] is not None])
    assert forms.dependency_depths(spark.createDataFrame([], "slug string, key string, depends_on string")).count() == 0


def test_a_chain_of_ten_thousand_fields(spark):
    fields = spark.range(10_000).selectExpr("'a' as slug", "id as key", "id - 1 as depends_on")
    assert forms.dependency_depths(fields).where("depth <> key").count() == 0
