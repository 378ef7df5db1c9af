"""Nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names."""

import json
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import chat, fingerprints, jaccard_join, line_dedup, lm_scoring, mixing, sentencepiece_scan, token_files, toxicity, vector_graph
from lumenfold.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, h string, node string, n string, score string, ids string, thash string, features string, block string, label string"
EXTRA = ("x",) * 10
LONG = "word " * 60_000
ROWS = [(1, None, "en", "a", None, *EXTRA), (2, "", "en", None, 0, *EXTRA), (3, " \n ", None, "b", 3, *EXTRA), (4, LONG, "en", "a", len(LONG), *EXTRA), (5, "one two three four five six\nsame line of five words here", "en", "a", 9, *EXTRA), (5, "one two three four five six\nsame line of five words here", "en", "a", 9, *EXTRA), (None, "no id on this row at all", "en", "a", 9, *EXTRA), (6, "same line of five words here", "de", "b", 28, *EXTRA), (7, None, None, None, None, *EXTRA), (8, "ünï çødé 😀 words and more words", "fr", "b", 30, *EXTRA)]


@pytest.fixture(scope="module", params=["full", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "full" else [], DOCS)


def same_others(before, after, changed):
    """Whether after has the columns and, but for those changed, the values of before."""
    names = [c for c in before.columns if c not in changed]
    return set(before.columns) <= set(after.columns) and sorted(map(str, before.select(names).collect())) == sorted(map(str, after.select(names).collect()))


def test_documents(spark, docs):
    n = docs.count()
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (99, 0)], "doc_id bigint, toxic int")
    target = spark.createDataFrame([(4,), (None,)], "doc_id bigint")
    path = tokenizer_path("piece_bpe_32k.model")
    assert mixing.mix(docs).count() == n
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert token_files.token_digest(docs, tokenizer_path=tokenizer_path("byte_bpe_50k.json")).count() == n
    assert toxicity.score_documents(docs, labels).where("score between 0 and 1").count() == n
    assert fingerprints.edited_fingerprints(docs).count() == n
    assert fingerprints.fingerprint_table(docs).count() == n
    assert sentencepiece_scan.encode_digest(docs, model_path=path).where("round_trip").count() == n
    assert jaccard_join.jaccard_components(docs, words=4, percent=85).count() == n
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() == max(n - 1, 0)
    assert lm_scoring.cross_entropy_difference(docs, target).count() == n
    assert same_others(docs, toxicity.score_documents(docs, labels), {"score"})
    deduped = line_dedup.dedup_lines(docs, min_words=5)
    assert same_others(docs, deduped, {"text"})
    assert deduped.count() == n and deduped.where("doc_id = 6 and text <> ''").count() == 0


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, at string, p string"
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0
    call = '{"content":"c","tool_calls":[{"id":"b","name":"f","arguments":{"y":1,"x":"s"},"depends_on":["a"]},{"id":"a","name":"g","arguments":{}}]}'
    tools = '{"content":"s","tools":[{"name":"f","parameters":{"required":["x","z"],"properties":{"x":{"type":"string"}}}}]}'
    rows = [(1, 0, "system", tools), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"b","content":"rb"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"ra"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"o"}'), (None, None, None, None), (2, 0, "user", "{broken"), (2, 0, "user", "{broken")]
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect()}
    assert (got[1].n_messages, got[1].n_calls, got[1].n_linked, got[1].n_orphans, got[1].n_invalid) == (5, 2, 2, 1, 1)
    text = got[1].chat
    assert text.index('"id":"a"') < text.index('"id":"b"') < text.index('"ra"') < text.index('"rb"') < text.index('"o"')
    assert '{"arguments":{"x":"s","y":1},"depends_on":["a"],"id":"b","name":"f","valid":false}' in text
    assert got[None].chat == "[{}]" and got[2].n_messages == 2 and got[2].n_calls == 0


def plain_verdict(value, schema):
    """A plain validator of what the operator checks: (whether it is met, whether something was not checked)."""
    if isinstance(schema, bool):
        return schema, False
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    of = {"string": isinstance(value, str), "number": number, "integer": number and value == int(value), "boolean": isinstance(value, bool), "object": isinstance(value, dict), "array": isinstance(value, list), "null": value is None}
    met = not kinds or any(of[k] for k in kinds)
    same = lambda e: isinstance(value, bool) == isinstance(e, bool) and (type(value) is type(e) or (number and isinstance(e, (int, float)))) and value == e
    met &= "enum" not in schema or any(same(e) for e in schema["enum"])
    met &= "const" not in schema or same(schema["const"])
    for kind, size, low, high in ((number, value, "minimum", "maximum"), (isinstance(value, str), value, "minLength", "maxLength"), (isinstance(value, list), value, "minItems", "maxItems"), (isinstance(value, dict), value, "minProperties", "maxProperties")):
        if kind:
            size = size if number else len(size)
            met &= schema.get(low, size) <= size <= schema.get(high, size)
    if number:
        met &= "exclusiveMinimum" not in schema or value > schema["exclusiveMinimum"]
    unsure = bool({"pattern", "anyOf", "$ref", "not"} & set(schema))
    parts = [(value, s) for s in schema.get("allOf", [])]
    if isinstance(value, dict):
        own, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        met &= not set(schema.get("required", [])) - set(value) and not (others is False and set(value) - set(own))
        parts += [(v, own[k] if k in own else others) for k, v in value.items() if k in own or isinstance(others, dict)]
    if isinstance(value, list) and "items" in schema:
        parts += [(v, schema["items"]) for v in value]
    found = [plain_verdict(*p) for p in parts]
    return met and all(m for m, _ in found), unsure or any(u for _, u in found)


def test_chat_validates_and_orders_generated_calls(spark):
    rng = random.Random(4)
    types = ["string", "number", "integer", "boolean", "object", "array", "null"]

    def value(depth):
        kinds = [lambda: rng.choice(["1", "x", ""]), lambda: rng.randint(0, 3), lambda: 1.5, lambda: rng.random() < 0.5, lambda: None]
        if depth:
            kinds += [lambda: {k: value(depth - 1) for k in rng.sample("xyz", 2)}, lambda: [value(depth - 1) for _ in range(2)]] * 2
        return rng.choice(kinds)()

    def schema(depth):
        s = {}
        if rng.random() < 0.5:
            s["type"] = rng.choice([rng.choice(types), rng.sample(types, 3)])
        if rng.random() < 0.15:
            s["enum"] = [value(0) for _ in range(3)]
        for name, low in (("minimum", 1), ("exclusiveMinimum", 0), ("minLength", 1), ("maxItems", 1), ("maxProperties", 1)):
            if rng.random() < 0.1:
                s[name] = low
        if rng.random() < 0.05:
            s["const"] = value(1)
        if rng.random() < 0.06:
            s |= rng.choice([{"pattern": "("}, {"anyOf": []}, {"$ref": "#/x"}, {"description": "d", "format": "f"}])
        if depth and rng.random() < 0.1:
            s["allOf"] = [schema(depth - 1), True]
        if depth:
            s |= rng.choice([{}, {"properties": {k: schema(depth - 1) for k in "xy"}}, {"items": schema(depth - 1)}, {"properties": {"x": schema(depth - 1)}, "required": ["x"], "additionalProperties": False}, {"properties": {"x": schema(depth - 1)}, "additionalProperties": schema(depth - 1)}, {"properties": {"x": rng.random() < 0.8}}])
        return s

    rows, want = [], {}
    for conv in range(250):
        tool = {"properties": {k: schema(2) for k in "xyz"}} | rng.choice([{}, {"required": ["x"]}, {"additionalProperties": False}])
        args = {k: value(2) for k in rng.sample("xyzw", 2)}
        ids = [f"c{i}" for i in range(4)]
        needs = {i: rng.sample(ids[:n], min(n, 1)) for n, i in enumerate(ids)}
        calls = [{"id": i, "name": "f", "arguments": args, "depends_on": needs[i]} for i in rng.sample(ids, 4)]
        rows += [(conv, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": tool}]})), (conv, 1, "assistant", json.dumps({"content": "", "tool_calls": calls}))]
        met, unsure = plain_verdict(args, tool)
        want[conv] = (None if met and unsure else met, needs)
    rows.append((500, 0, "assistant", '{"tool_calls":[{"id":"a","name":"g","arguments":"{\\"x\\": 1"}]}'))
    for r in chat.format_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        calls = [c for m in json.loads(r.chat) for c in m.get("tool_calls", [])]
        if r.conv_id == 500:
            assert calls == [{"id": "a", "name": "g", "arguments": '{"x": 1', "valid": False}]
            continue
        ok, needs = want[r.conv_id]
        assert [c.get("valid") for c in calls] == [ok] * 4, rows[2 * r.conv_id : 2 * r.conv_id + 2]
        place = {c["id"]: i for i, c in enumerate(calls)}
        assert len(place) == 4 and all(place[n] < place[i] for i in needs for n in needs[i])


def test_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, dim string, ids string"
    assert vector_graph.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = [(0, [1.0, 0.0], "x", "y"), (1, [1.0, 0.0], "x", "y"), (2, None, "x", "y"), (3, [0.0, 0.0], "x", "y"), (4, [float("nan"), 1.0], "x", "y"), (5, [None, 1.0], "x", "y"), (None, [2.0, 1.0], "x", "y"), (6, [0.0, 3.0], "x", "y"), (7, [1.0], "x", "y"), (6, [0.0, 3.0], "x", "y")]
    got = [tuple(r) for r in vector_graph.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 6)]
    # an id with several vectors counts once, by the nearest
    twice = [(0, [0.0, 1.0], "x", "y"), (0, [9.0, 1.0], "x", "y"), (1, [0.0, 2.0], "x", "y"), (1, [8.0, 1.0], "x", "y"), (2, [0.0, 4.0], "x", "y")]
    got = vector_graph.nearest(spark.createDataFrame(twice, schema), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (2, 2, 3.0)]


def test_pipeline_stages(spark):
    """Every stage against a plain version of what it decides, on what the one before it kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_copies", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, prose(60), "en", "ab"[i % 2], 1) for i in range(40)]
    base = rows[3][1].split()
    rows += [(50, " ".join(base[:-1] + ["other"]), "en", "a", 1), (51, rows[4][1], "en", "b", 1), (52, "first of mine\n" + prose(30) + "\nshared line of some words", "en", "a", 1), (53, "shared line of some words\n" + prose(30), "en", "b", 1), (54, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    text = {r[0]: r[1] for r in rows}
    got = {r.doc_id: r for r in stages["line_dedup"](spark, docs, "").collect()}
    want = {**text, 51: "", 53: text[53].split("\n")[1]}
    assert {d: r.text for d, r in got.items()} == want and got[53].n_chars == len(want[53]) and got[52].n_chars == 1
    kept = stages["near_copies"](spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(text) - {50, 51}
    mixed = stages["mixing"](spark, kept, "")
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= set(text.items())
    out = stages["sentencepiece"](spark, kept, "").collect()
    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert len(out) == kept.count() and all(r.n_tokens == len(processor.encode(text[r.doc_id] or "")) and r.round_trip for r in out)
