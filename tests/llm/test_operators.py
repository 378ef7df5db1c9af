"""The ten operators against brute force, the libraries themselves, exact round trips or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from lumenfold.llm import fingerprints, hashing, jaccard_join, line_dedup, lm_scoring, mixing, sentencepiece_scan, token_files, toxicity, vector_graph
from lumenfold.llm.queries import queries, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(fold))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, sf, docs):
    got = queries()["op1_mixing"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries()["op1_mixing"](spark, sf).collect()))
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    total = Counter()
    for d, _, s in docs:
        total[s] += size[d]
    target = brute_targets(total, (5, 2, 1), 1.5, 2.0)
    source, taken = {d: s for d, _, s in docs}, Counter()
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_mixing_without_broadcasts(spark, sf, monkeypatch):
    want = sorted(map(tuple, queries()["op1_mixing"](spark, sf).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, queries()["op1_mixing"](spark, sf).collect())) == want


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 501)], "sidx int, n bigint")
    rows = mixing.split_quotas(quotas, 4, 3).collect()
    sums, shards = Counter(), Counter()
    for r in rows:
        assert r.n >= 0
        sums[r.sidx] += r.n
        shards[r.shard] += r.n
    assert sums == Counter({0: 1000, 1: 37, 3: 501}) and len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 4
    # a node's left share has the mean and the variance of a hypergeometric draw
    draws = spark.range(4000).selectExpr("id + 1 as node", "array(60L, 40L) as quotas").selectExpr(f"element_at({mixing._left_share(5)}, 1) as x").toPandas()["x"]
    assert abs(draws.mean() - 30) < 0.2 and abs(draws.var() - 50 * 0.6 * 0.4 * 50 / 99) < 0.6


def test_token_files(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = sorted(queries()["op3_token_files"](spark, sf).collect())
    at = 0
    for r, (d, text, _) in zip(rows, sorted(docs), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


ODD = ["", " ", "a", "  two  blanks ", "tab\tand\nline\r\n end ", "it's 1234 don't", "é   nbsp   em", "▁ a▁b ▁", "日本語 の テキスト", "😀😀 a😀", "x" * 300, "a b" * 5000, "\x00\x01 z", "<|endoftext|> x <s> y</s>", "\n\n\nA  \n B", "ab " * 3 + "   ", "'s 's'", " 　 x", "\x1c a \x85 b"]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [*ODD, "wörd " * 300_000, "x" * 1_200_000, " ".join(f"{i} word{i % 977}.\n" * (i % 5 == 0) or f"w{i}" for i in range(250_000))]
    got = token_files.Encoder(path).encode(texts)
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files_keep_special_tokens(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, "one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>  c <|endoftext|>\n"]
    rows = token_files.token_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tokenizer_path=path).collect()
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}


def test_read_document(spark, tmp_path, docs):
    frame = spark.createDataFrame([(d, t) for d, t, _ in docs[:50]], "doc_id bigint, text string")
    token_files.write_token_files(frame, str(tmp_path / "f"), tokenizer_path=tokenizer_path("byte_bpe_50k.json"))
    raw = token_files.read_document(spark, str(tmp_path / "f"), docs[7][0])
    assert raw == token_files.Encoder(tokenizer_path("byte_bpe_50k.json")).encode([docs[7][1]])[0] + np.array([2], "<u4").tobytes()
    assert token_files.read_document(spark, str(tmp_path / "f"), -5) is None


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity(spark, sf):
    sf = sf.replace("sf0.01", "sf0.1")
    rows = queries()["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()
    held = rows[rows["held_out"] & rows["toxic"].notna()]
    got = auc(held["score"].to_numpy(), held["toxic"].to_numpy())
    print("held-out AUC", got, "accuracy", (held["predicted"] == held["toxic"]).mean(), "toxic share", held["toxic"].mean(), "recall", held[held["toxic"] == 1]["predicted"].mean(), "clean flagged", held[held["toxic"] == 0]["predicted"].mean())
    assert got > 0.9


def test_neighbours(spark, sf):
    rows = queries()["op5_neighbours"](spark, sf).collect()
    v = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(v["embedding"]).astype(np.float64), v["vec_id"].to_numpy()
    got = defaultdict(dict)
    for r in rows:
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for _, i in sorted(zip(d[ids != q], ids[ids != q], strict=True))[:10]]
        own = [got[q][k] for k in sorted(got[q])]
        assert own == sorted(own, key=lambda p: (p[1], p[0])) and len(own) == 10
        assert all(s == pytest.approx(d[ids == i][0], abs=1e-12) for i, s in own)
        hit, total = hit + len(set(best) & {i for i, _ in own}), total + 10
    assert hit / total >= 0.9


def test_graph_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[100:160] = x[100]
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(3000)], "vec_id bigint, embedding array<double>")
    rows = vector_graph.nearest(frame, F.col("vec_id") % 100 == 0, k=10, shard_nodes=500).toPandas()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for _, i in sorted((d[i], i) for i in range(3000) if i != q)[:10]]
        hit += len(set(best) & set(rows[rows["query_id"] == q]["vec_id"]))
    assert hit / 300 >= 0.9


def test_shards_grow_instead_of_becoming_more(spark, monkeypatch):
    """Every query is searched for in every shard, so their number must not follow the rows."""
    x = np.random.default_rng(4).normal(size=(3000, 16))
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(3000)], "vec_id bigint, embedding array<double>")
    shards, table = [], vector_graph.table
    monkeypatch.setattr(vector_graph, "table", lambda df: (made := table(df), "shard" in df.columns and shards.append(made.count()))[0])
    rows = vector_graph.nearest(frame, F.col("vec_id") % 100 == 0, k=10, shard_nodes=30).toPandas()
    assert shards == [vector_graph.SHARDS]
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        hit += len({i for _, i in sorted((d[i], i) for i in range(3000) if i != q)[:10]} & set(rows[rows["query_id"] == q]["vec_id"]))
    assert hit / 300 >= 0.9


def test_recall_of_a_grown_shard():
    points = np.random.default_rng(6).normal(size=(12_000, 64)).astype(np.float32)
    graph, entry = vector_graph.build_graph(points)
    own = np.arange(0, len(points), 100)
    found, _ = vector_graph.beam_search(points, graph, entry, points[own], vector_graph.search_beam(len(points)))
    hit = 0
    for i, row in zip(own, found.tolist(), strict=True):
        d = ((points - points[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & set([y for y in row if y != i][:10]))
    assert hit / (10 * len(own)) >= 0.9


@pytest.mark.parametrize("dim", [128, 256])
def test_recall_of_a_whole_shard(dim):
    rng = np.random.default_rng(dim)
    points = rng.normal(size=(vector_graph.SHARD_NODES, dim)).astype(np.float32)
    graph, entry = vector_graph.build_graph(points)
    own = np.arange(0, len(points), 64)
    found, _ = vector_graph.beam_search(points, graph, entry, points[own], vector_graph.SEARCH_BEAM)
    far = ((points[None, :, :] - points[own][:, None, :]) ** 2).sum(2) if dim < 200 else np.stack([((points - points[i]) ** 2).sum(1) for i in own])
    far[np.arange(len(own)), own] = np.inf
    best = np.argsort(far, 1)[:, :10]
    found = [[x for x in row if x != i][:10] for i, row in zip(own, found.tolist(), strict=True)]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.tolist(), found, strict=True)]) >= 0.9


def test_back_edges_beyond_one_round_are_pruned_in(monkeypatch):
    points = np.random.default_rng(1).normal(size=(600, 8)).astype(np.float32)
    points[0] = 0
    monkeypatch.setattr(vector_graph, "BACK_EDGES", 7)
    graph, entry = vector_graph.build_graph(points)
    found, _ = vector_graph.beam_search(points, graph, entry, points, 96)
    best = np.argsort(((points[None] - points[:, None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.tolist(), found[:, :10].tolist(), strict=True)]) >= 0.97


def test_fingerprints(spark, sf, docs):
    rows = {r.doc_id: r for r in queries()["op6_fingerprints"](spark, sf).collect()}
    order = sorted(docs, reverse=True)
    errors = []
    for (d, t, _), (d2, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = t or "", u or "", rows[d]
        h = len(t) // 2
        edited = t[: len(t) - h] + u[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprints([t])[0] and r.edited_fingerprint == fingerprints.fingerprints([edited])[0]
        a, b = shingle_set(t, 5), shingle_set(edited, 5)
        if a and b:
            errors.append(r.near_edited - len(a & b) / len(a | b))
        assert r.near_next == fingerprints.likeness(r.fingerprint, rows[d2].fingerprint)
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.05


@pytest.mark.parametrize("chunk", [7, 64, 1 << 15])
def test_sentencepiece(spark, docs, chunk):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + [t for _, t, _ in docs[:: 200 if chunk < 1000 else 10]]
    if chunk == 7:
        texts = [t[:400] if t else t for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    rows = sentencepiece_scan.decode(sentencepiece_scan.encode(frame, model_path=path, chunk_chars=chunk), model_path=path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids, "<i4").tolist() == sp.encode(texts[r.doc_id] or ""), texts[r.doc_id][:50]
        assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ")


def brute_components(docs, n, percent):
    sets = {d: shingle_set(t, n) for d, t in docs}
    by_token = defaultdict(list)
    for d, s in sets.items():
        for t in s:
            by_token[t].append(d)
    shared = Counter()
    for own in by_token.values():
        own.sort()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, docs, n, percent, monkeypatch):
    if n == 2:
        monkeypatch.setattr(jaccard_join, "GROUP_SIZE", 4)
        monkeypatch.setattr(jaccard_join, "QUERY_SIZE", 3)
        monkeypatch.setattr(jaccard_join, "DEMOTE_ABOVE", 2)
        monkeypatch.setattr(jaccard_join, "MOST_BROADCAST_IDS", 0)
    own = [(d, t) for d, t, _ in docs][: 1000 if n > 2 else 300]
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame, words=n, percent=percent).collect()}
    assert got == brute_components(own, n, percent)


@pytest.mark.parametrize("block", [50, 1 << 19])
def test_lm_scoring(spark, docs, block, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", block)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", 5000)
    if block == 50:
        monkeypatch.setattr(lm_scoring, "MOST_BROADCAST_IDS", 0)
    good = {d for d, _, _ in docs if d % 3 == 0}
    own = [(d, t) for d, t, _ in docs][: 200 if block > 50 else 30]
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    target = spark.createDataFrame([(d,) for d in good], "doc_id bigint")
    rows = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame, target).collect()}
    assert len(rows) == len(own)
    words = {d: WORD.findall((t or "").translate(fold)) for d, t in own}
    counts = [Counter(w for d in words if not k or d in good for w in words[d]) for k in (0, 1)]
    known = {w for w, c in counts[0].items() if c >= lm_scoring.LEAST_COUNT}
    unknown = [sum(c for w, c in counts[k].items() if w not in known) for k in (0, 1)]
    pairs = [Counter(p for d in words if not k or d in good for p in zip(["<s>", *words[d]], words[d], strict=False)) for k in (0, 1)]
    kept = {p for p, c in pairs[0].items() if c >= lm_scoring.LEAST_COUNT}
    starts = [sum(c for p, c in pairs[k].items() if p[0] == "<s>" and p in kept) for k in (0, 1)]

    def loss(k, a, b):
        before = starts[k] if a == "<s>" else counts[k][a]
        uni = ((counts[k][b] if b in known else unknown[k]) + 0.5) / (sum(counts[k].values()) + 0.5 * (len(known) + 1))
        return -np.log(lm_scoring.MIXED_IN * (pairs[k][a, b] if (a, b) in kept else 0) / max(before, 1) + (1 - lm_scoring.MIXED_IN) * uni)

    for d in words:
        n = len(words[d])
        want = [np.mean([loss(k, a, b) for a, b in zip(["<s>", *words[d]], words[d], strict=False)]) if n else 0.0 for k in (0, 1)]
        assert rows[d].n_tokens == n and rows[d].background_loss == pytest.approx(want[0]) and rows[d].target_loss == pytest.approx(want[1])
        assert rows[d].score == pytest.approx(want[1] - want[0])


def test_lm_scoring_knows_rare_words_of_a_large_corpus(spark):
    own = [(1, "x y " * 800_000), (2, "x y " * 800_000), (3, "rare"), (4, "rare"), (5, "rare"), (6, "once")]
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    rows = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame, spark.createDataFrame([(3,)], "doc_id bigint")).collect()}
    # known are x, y and rare; of the first words, three times "rare" and twice "x" are counted
    total, starts = 3_200_004, 5
    assert rows[4].background_loss == pytest.approx(-np.log(0.7 * 3 / starts + 0.3 * 3.5 / (total + 2)))
    assert rows[6].background_loss == pytest.approx(-np.log(0.3 * 1.5 / (total + 2)))
    assert rows[4].target_loss == pytest.approx(-np.log(0.7 + 0.3 * 1.5 / 3)) and rows[6].target_loss == pytest.approx(-np.log(0.3 * 0.5 / 3))
    assert rows[1].n_tokens == 1_600_000


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_lines(docs, min_words=1):
    lines = [(d, i, x.strip(" \t\r\v\f")) for d, t in sorted(docs, key=lambda r: r[0]) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(WORD.findall(x[2])) >= min_words]
    seen, dropped = defaultdict(set), defaultdict(set)
    for d, i, x in lines:
        if x in seen[len(x)] or any(within_one(x, y) for n in (len(x) - 1, len(x), len(x) + 1) for y in seen[n]):
            dropped[d].add(i)
        seen[len(x)].add(x)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dropped[d]) for d, t in docs}


def test_line_dedup(spark, docs):
    own = [(d, t) for d, t, _ in docs][:250]
    long = [t for _, t in own if t and len(t) > 300][:20]
    line = [x for t in long for x in t.split("\n") if len(x.split()) >= 6]
    rng = np.random.default_rng(1)
    for i, x in enumerate(line[:60]):
        j = int(rng.integers(0, len(x)))
        own.append((10_000 + i, [x[:j] + x[j + 1 :], x[:j] + "q" + x[j:], x[:j] + "é" + x[j + 1 :], x[:j] + x[j + 2 :]][i % 4] + "\nplain line"))
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    want = brute_lines(own)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_line_dedup_of_lines_of_any_length(spark):
    rng = np.random.default_rng(6)
    line = lambda n: "".join(rng.choice(list("abcé 😀"), n))
    own = [(i, "\n".join(line(int(rng.integers(0, 12))) for _ in range(4))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(own, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(own)


def test_line_dedup_without_broadcasts(spark, docs, monkeypatch):
    own = [(d, t) for d, t, _ in docs][:120]
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST_LINES", 0)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == want


def test_line_dedup_takes_short_lines(spark, tmp_path):
    own = [(1, "ok\n\nAll rights reserved.\n本製品は無断で複製することを禁じます"), (2, "All rights reserved.\n\nno\n本製品は無断で複製する事を禁じます\n本製品は無断で複製することを禁じまし"), (3, " ok \nAll right reserved.\noj")]
    spark.createDataFrame(own, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in queries()["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: own[0][1], 2: "\nno\n本製品は無断で複製する事を禁じます", 3: ""}
    docs = spark.createDataFrame([(*r, None, None, None) for r in own], DOCS)
    assert {r.doc_id: r.text for r in dict(STAGES)["line_dedup"](spark, docs, "").collect()} == got


def test_features_of_a_long_text_do_not_depend_on_cuts(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["you", "vile", "w", "x", "PLAIN", "v1le", "deine", "12345", "...", "ünder"]
    text = " ".join(rng.choice(words, 40_000)) + " " + "7 " * 5000 + "vile " + "8 " * 3000 + "you w x y z"
    lowered = toxicity._letter_words(*(lambda p: (p[0], p[3]))(hashing.spans([b"vile"])))[0]
    lex = toxicity.Lexicon(lowered, np.array([2.5]))
    whole = toxicity.features([text], lex)
    monkeypatch.setattr(hashing, "BATCH_BYTES", 4096)
    monkeypatch.setattr(hashing.pieces, "__defaults__", (4096,))
    cut = toxicity.features([text], lex)
    assert np.allclose(whole, cut) and whole[0][toxicity.FEATURES.index("near_second_person")] > 0 and whole[0][toxicity.FEATURES.index("spelled_out")] > 0


def test_toxicity_feature_values():
    """Some values by hand: hits, nearness, capitals, marks, inner marks, disguise and spelling."""
    lowered = toxicity._letter_words(*(lambda p: (p[0], p[3]))(hashing.spans([b"vile"])))[0]
    lex = toxicity.Lexicon(lowered, np.array([2.0]))
    row = dict(zip(toxicity.FEATURES, toxicity.features(["You VILE one! v1le f.o.o a b c d vile"], lex)[0], strict=True))
    # letter words: You VILE one v le f o o a b c d vile
    assert row["lexicon_density"] == pytest.approx(2 / 13) and row["lexicon_mean"] == pytest.approx(4 / 13) and row["lexicon_hits"] == pytest.approx(np.log1p(2))
    assert row["second_person"] == pytest.approx(1 / 13) and row["near_second_person"] == pytest.approx(1 / 13) and row["shouted"] == pytest.approx(1 / 13)
    assert row["disguised"] == pytest.approx(1 / 13) and row["obfuscated"] == pytest.approx(3 / 13) and row["spelled_out"] == pytest.approx(5 / 13) and row["words"] == pytest.approx(np.log1p(13))


def test_toxicity_features():
    lex = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    out = toxicity.features(["", None, "You are GREAT!! f.o.o", "a b c d"], lex)
    assert out.shape == (4, len(toxicity.FEATURES)) and np.isfinite(out).all() and (out[0] == out[1]).all()
