"""Ranked lexical search over an inverted index in shards, with MaxScore.

Index: the documents that a task reads make shards of about SHARD_BYTES of text, so nothing is shuffled to build it. A
shard has a row for its documents (ids and lengths) and one for each term: the documents that hold it, its occurrences
in each, and, for longer lists, the shortest document of each number of occurrences.

Search: query terms meet the index by a join that gives their document counts and weights, and by another that gives
their lists; nothing but the query terms, below a checked size, is broadcast. Queries come in blocks. For
each shard and query MaxScore orders the lists by upper bounds, which the shortest documents give exactly. Lists whose
remaining bounds together reach the lowest score that still counts are essential: they are added up. The others are
only probed, for documents that can still qualify. A task carries each query's best documents and lowest score from
shard to shard and returns the best of all its shards; the best of all tasks are the result.

Scores are integers. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document scores the sum, over the
query's terms with repeats, of weight * ((10^9 * tf) div (1000 * tf + 12 * m)), m = 75 + (25 * n * N) div L: N
documents with terms, of L terms together, of which the document has n.

Defined results: terms are runs of ASCII letters, digits and all other characters beyond ASCII, with A-Z lowered; a null
or empty text has none and is never found; each row of documents and of queries counts as one of its own, also where
ids repeat or are null; equal scores go by ascending doc_id, null last. Documents that score 0 are no results. Terms are
told apart by 128 bits within a shard and by their text between shards and queries. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing
from .work import scoped, table

#: Queries come in blocks of 2 ** BLOCK_BITS.
SHARD_BYTES, BLOCK_BITS, FOUND = 8 << 20, 10, 20
#: Lists of fewer documents store no shortest documents: their bounds follow from the documents themselves.
LEAST_LIST = 16
#: Bytes of query terms that are broadcast at most; beyond it the index is joined with them by a shuffle.
MOST_BROADCAST_BYTES = 8 << 20
#: Fixed value: what separates terms, all of ASCII but digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

INDEX = "shard bigint, term string, n_docs bigint, n_terms bigint, doc_ids array<bigint>, docs binary, tf binary, impacts binary"
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("docs", pa.binary()), ("tf", pa.binary()), ("impacts", pa.binary())])


def _slices(values: np.ndarray, begins: np.ndarray, kind=pa.binary()) -> pa.Array:
    """values cut at begins (with the end), as an Arrow array of byte strings."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(kind, len(begins) - 1, [None, pa.py_buffer((begins * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[b : b + n] for each b and n, joined, and where each begins (one more at the end)."""
    upto = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    return data[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], upto


class _Terms:
    """The terms of some documents: hashes and text of each, and the documents that hold it."""

    def __init__(self, parts: list[bytes], first: int):
        """parts: texts of documents numbered from first."""
        data, _, _, at = hashing.spans(parts)
        data = _LOWERED[data]
        edge = np.flatnonzero(np.diff(_IN_TERM[data].view(np.int8), prepend=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        a, b = (hashing.span_hashes(x, starts, ends, False) for x in (data, ~data))
        order = np.argsort(a, kind="stable")
        if ((np.diff(a[order]) == 0) & (np.diff(b[order]) != 0)).any():
            order = np.lexsort((b, a))
        a, b, starts, ends = a[order], b[order], starts[order], ends[order]
        doc = np.searchsorted(at, starts, "right") - 1
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])[: len(a)]
        posting = np.flatnonzero(new | np.concatenate([[True], np.diff(doc) != 0])[: len(a)])
        self.a, self.b = a[new], b[new]
        self.text, self.begins = _gathered(data, starts[new], ends[new] - starts[new])
        self.term = (np.cumsum(new) - 1)[posting]
        self.doc = doc[posting] + first
        self.tf = np.diff(np.append(posting, len(a)))


def _shard(number: int, ids: list, held: list[_Terms]) -> pa.RecordBatch:
    """The index rows of a shard of documents ids, whose terms are in held."""
    a, b = (np.concatenate([getattr(h, x) for h in held]) for x in "ab")
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])[: len(a)]
    number_of = np.empty(len(a), np.int64)
    number_of[order] = np.cumsum(new) - 1
    shift = np.concatenate([[0], np.cumsum([len(h.a) for h in held])])
    term = number_of[np.concatenate([h.term + s for h, s in zip(held, shift, strict=False)])]
    doc, tf = (np.concatenate([getattr(h, x) for h in held]) for x in ("doc", "tf"))
    by_term = np.argsort(term, kind="stable")  # documents are ascending already
    term, doc, tf = term[by_term], doc[by_term], tf[by_term]
    # a long document comes in pieces
    posting = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(doc) != 0)])[: len(term)])
    tf = np.add.reduceat(tf, posting) if len(posting) else tf
    term, doc = term[posting], doc[posting]
    n = np.bincount(doc, tf, len(ids)).astype(np.int64)
    begins = np.searchsorted(term, np.arange(int(new.sum()) + 1))
    size = np.diff(begins)
    # for each term and number of occurrences (255 stands for all from there on) the least length
    long = np.repeat(size >= LEAST_LIST, size)
    key = np.sort(term[long] << 40 | np.minimum(tf[long], 255) << 32 | np.minimum(n[doc[long]], (1 << 32) - 1))
    least = key[np.concatenate([[True], np.diff(key >> 32) != 0])[: len(key)]]
    times = least >> 32 & 255
    last = np.concatenate([np.diff(least >> 40) != 0, [True]])[: len(least)]
    most = np.maximum.reduceat(tf, begins[:-1]) if len(size) else tf
    times[last] = most[least[last] >> 40]
    impacts = np.stack([times, least & (1 << 32) - 1], 1).astype(np.uint32)
    of_impacts = 2 * np.searchsorted(least >> 40, np.arange(len(size) + 1))
    at = np.concatenate([[0], np.cumsum([len(h.text) for h in held])])
    begin = np.concatenate([h.begins[:-1] + s for h, s in zip(held, at, strict=False)])[order[new]]
    width = np.concatenate([np.diff(h.begins) for h in held])[order[new]]
    text, of_text = _gathered(np.concatenate([h.text for h in held]), begin, width)
    none = len(size)
    terms = [
        pa.array(np.full(none, number)), _slices(text, of_text, pa.string()), pa.array(size), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())),
        _slices(doc.astype(np.uint32), begins), _slices(tf.astype(np.uint32), begins), _slices(impacts.reshape(-1), of_impacts),
    ]
    head = [[number], [None], [int((n > 0).sum())], [int(n.sum())], [ids], [None], [n.astype("<i8").tobytes()], [None]]
    own = [pa.concat_arrays([pa.array(x, f.type), y]) for x, y, f in zip(head, terms, _INDEX, strict=True)]
    return pa.RecordBatch.from_arrays(own, schema=_INDEX)


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of docs (doc_id, text), a row for each shard and each of its terms. Write it down: shards differ between readings."""

    def run(batches):
        from pyspark import TaskContext

        number, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for start, parts in hashing.batches(batch.column("text").to_pylist()):
                if len(parts) == 1 and len(parts[0]) > hashing.BATCH_BYTES:
                    held += [_Terms([piece], len(ids)) for piece in hashing.pieces(parts[0])]
                else:
                    held.append(_Terms(parts, len(ids)))
                ids += names[start : start + len(parts)]
                size += sum(map(len, parts))
                if size >= SHARD_BYTES:
                    yield _shard(number, ids, held)
                    number, ids, held, size = number + 1, [], [], 0
        if ids:
            yield _shard(number, ids, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def _satisfied(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class _List:
    """A term's documents in a shard; their shares are computed when they are asked for."""

    def __init__(self, row: dict, shard: _Shard):
        self.docs, self.tf, self.weight, self.m = np.frombuffer(row["docs"], np.uint32), np.frombuffer(row["tf"], np.uint32), row["weight"], shard.m
        impacts = np.frombuffer(row["impacts"], np.uint32).reshape(-1, 2)
        best = self.weight * _satisfied(impacts[:, 0], shard.damped(impacts[:, 1].astype(np.int64))) if len(impacts) else self.share()
        self.bound = int(best.max())

    def share(self, some=slice(None)) -> np.ndarray:
        return self.weight * _satisfied(self.tf[some], self.m[self.docs[some]])

    def probe(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of docs (ascending) the list holds, and their shares."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        held = self.docs[at] == docs
        return held, self.share(at[held])


class _Shard:
    """A shard's documents and the lists of the block's query terms in it."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        ids = pa.array(row["doc_ids"], pa.int64())
        self.ids, self.no_id = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.damped = lambda n: 75 + 25 * n * n_docs // max(n_terms, 1)
        self.m = self.damped(np.frombuffer(row["tf"], "<i8"))
        self.lists: dict[int, list] = defaultdict(list)

    def add(self, row: dict) -> None:
        own = _List(row, self)
        for item, times in zip(row["items"], row["times"], strict=True):
            self.lists[item].append((own, times))


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def max_score(lists: list[tuple[_List, int]], n_docs: int, k: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that score at least lowest (and 1) and may be among the k best, and their scores."""
    lists = sorted(lists, key=lambda x: -x[0].bound * x[1])
    rest = np.append(np.cumsum([x.bound * times for x, times in reversed(lists)])[::-1], 0).tolist()
    lowest, total, upto = max(lowest, 1), np.zeros(n_docs, np.int64), 0
    for own, times in lists:  # the essential ones
        if rest[upto] < lowest:
            break
        total[own.docs] += times * own.share()
        upto += 1
        if upto % 4 == 0:
            lowest = max(lowest, _kth(total, k))
    docs = np.flatnonzero(total + rest[upto] >= lowest) if upto else np.zeros(0, np.int64)
    docs = docs[total[docs] > 0]
    scores = total[docs]
    for i in range(upto, len(lists)):
        if not len(docs):
            break
        own, times = lists[i]
        held, share = own.probe(docs)
        scores[held] += times * share
        lowest = max(lowest, _kth(scores, k))
        may = scores + rest[i + 1] >= lowest
        docs, scores = docs[may], scores[may]
    good = scores >= max(lowest, _kth(scores, k))
    return docs[good], scores[good]


class _Best:
    """The k best documents of each query of a block so far."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def take(self, shard: _Shard) -> None:
        for item, lists in shard.lists.items():
            before = self.of.get(item)
            lowest = int(before[0][-1]) if before and len(before[0]) == self.k else 0
            docs, scores = max_score(lists, len(shard.ids), self.k, lowest)
            own = [scores, shard.no_id[docs], shard.ids[docs]]
            if before:
                own = [np.concatenate(x) for x in zip(before, own, strict=True)]
            order = np.lexsort((own[2], own[1], -own[0]))[: self.k]
            self.of[item] = [x[order] for x in own]

    def rows(self, block: int) -> pa.RecordBatch:
        items = sorted(self.of)
        score, no_id, ids = (np.concatenate([self.of[i][x] for i in items] or [np.zeros(0, np.int64)]) for x in range(3))
        item = np.repeat(np.array(items, np.int32), [len(self.of[i][0]) for i in items])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(item), block)), pa.array(item), pa.array(ids.astype(np.int64), mask=no_id.astype(bool)), pa.array(score.astype(np.int64))], names=["block", "item", "doc_id", "score"])


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _query_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, item, item_id) of every row of queries (item_id, text), and (block, item, term, times)."""
    row = F.monotonically_increasing_id()
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = queries.select("item_id", F.shiftright(row, BLOCK_BITS).alias("block"), (row % (1 << BLOCK_BITS)).cast("int").alias("item"), F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)).alias("terms"))
    rows = table(rows)
    return rows.drop("terms"), rows.select("block", "item", F.explode("terms").alias("term")).groupBy("block", "item", "term").agg(F.count("*").cast("int").alias("times"))


@scoped
def search(index: DataFrame, queries: DataFrame, k: int = FOUND) -> DataFrame:
    """The k best documents of index (a written table of build_index) for each row of queries (item_id, text): item_id, rank, doc_id, score."""
    spark = index.sparkSession
    items, terms = _query_terms(queries)
    terms = table(terms)
    few = (terms.agg(F.sum(F.length("term") + 40)).head()[0] or 0) <= MOST_BROADCAST_BYTES
    small = F.broadcast if few else lambda df: df
    whole = index.where("term is null")
    n_docs, n_terms = whole.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).head()
    lists = index.where("term is not null")
    counts = lists.select("term", "n_docs").join(small(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weights = counts.select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("weight")).where("weight > 0")
    asked = terms.join(weights, "term").groupBy("block", "term", "weight").agg(F.collect_list("item").alias("items"), F.collect_list("times").alias("times"))
    asked = table(asked)
    hits = lists.join(small(asked), "term").select("block", "shard", F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("doc_ids"), "docs", "tf", "impacts", "weight", "items", "times")
    blocks = [r[0] for r in asked.select("block").distinct().collect()]  # a number a block
    of_docs = whole.select(F.explode(F.array(*map(F.lit, blocks)).cast("array<bigint>")).alias("block"), "shard", F.lit(0).alias("kind"), "doc_ids", "docs", "tf", "impacts", F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast("array<int>").alias("items"), F.lit(None).cast("array<int>").alias("times"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = hits.unionByName(of_docs).repartition(parts, "block", "shard").sortWithinPartitions("block", "shard", "kind")

    def run(batches):
        block = shard = best = None
        for row in _rows(batches):
            if row["kind"]:
                shard.add(row)
                continue
            if shard is not None:
                best.take(shard)
            if best is None or row["block"] != block:
                if best is not None:
                    yield best.rows(block)
                block, best = row["block"], _Best(k)
            shard = _Shard(row, n_docs, n_terms)
        if shard is not None:
            best.take(shard)
            yield best.rows(block)

    found = placed.mapInArrow(run, "block bigint, item int, doc_id bigint, score bigint")
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items, ["block", "item"]).select("item_id", "rank", "doc_id", "score")


@scoped
def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = FOUND) -> DataFrame:
    """search over an index of docs (doc_id, text) that is deleted afterwards."""
    return search(table(build_index(docs)), queries, k)
