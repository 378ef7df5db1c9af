"""Language-model scoring by cross-entropy difference.

Two bigram models are counted over the corpus: the background over all documents, the target over the documents
that are marked as such. They are matched: one vocabulary (words that occur LEAST_COUNT times in the corpus; all
others are one unknown word), one set of bigrams (those that occur LEAST_COUNT times), one interpolation. A
document's score is the mean over its words of the target's loss less the background's: lower reads more like the
target.

The counts grow with the corpus. They are partitioned by key and looked up there; nothing of them is collected or
broadcast but five totals.

1. Documents are read once into blocks of about BLOCK_WORDS words: a block's distinct words as hashes, and its word
   sequence as numbers of them. A longer document runs over several blocks.
2. A block sends each bucket of keys (words and bigrams, by hash) one row: its distinct keys there, ascending, and how
   often they occur in the block and in its target documents. Whatever is frequent is one key a block.
3. A bucket's task sums the counts and answers each block's row with the totals of its keys, in the same order. A
   bucket holds about BUCKET_KEYS keys: their number follows from the blocks' own counts of distinct keys. Buckets are
   asked in PARTS passes, so that only one pass's keys are on disk at a time.
4. A block meets the answers to its own rows and scores its documents.

Defined results: A-Z are lowered, words are runs of non-blank characters; a text without words (or null) has
n_tokens 0 and losses 0; target ids that are null or unknown are ignored; without target documents the target model
is uniform; rows with equal id are all scored, and all are the target's if their id is. Losses are sums of doubles:
their last digits may differ between runs. Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .work import scoped, table

LEAST_COUNT, MIXED_IN = 2, 0.7
BLOCK_WORDS, BUCKET_KEYS, PARTS = 1 << 18, 1 << 20, 2
#: Target ids broadcast at most; beyond it they are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000

_BLOCK = "block bigint, rows array<bigint>, doc_ids array<bigint>, inside array<int>, first array<int>, lead int, vocabulary binary, sequence binary, n_keys bigint"
#: The hash of what stands before a text's first word.
_START = np.uint64(1)
#: A key's last two bits say what it counts.
_PAIR, _FIRST, _WORD = (np.uint64(i) for i in range(3))
_NO_LEAD = -1
#: What is summed over all distinct keys: words, unknown and known ones, and counted first words, in all texts and in the target's.
_TOTALS = ("words", "words_target", "unknown", "unknown_target", "known", "first", "first_target")


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, text, in_target): their row numbers, ids, the places of those in the target, their bounds, and their words.

    lead is the number of the word that stands before the block in the first row's text, _NO_LEAD where that begins here.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        made = row = 0
        rows: list[int] = []
        ids: list = []
        flags: list[bool] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size, before = 0, None

        def block():
            hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
            own = hashes if before is None else np.append(hashes, before)
            vocabulary, sequence = np.unique(own, return_inverse=True)
            lead = _NO_LEAD if before is None else int(sequence[-1])
            sequence = sequence[: len(hashes)].astype(np.int32)
            first = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=first[1:])
            n_keys = len(vocabulary) + len(np.unique(_pairs(sequence, first, lead, len(vocabulary))))
            values = (part + made, rows, ids, np.flatnonzero(flags).tolist(), first.tolist(), lead, vocabulary.tobytes(), sequence.tobytes(), n_keys)
            return pa.RecordBatch.from_pylist([dict(zip(types.names, values, strict=True))], schema=types)

        for batch in batches:
            doc_ids, in_target = batch.column("doc_id").to_pylist(), batch.column("in_target").to_pylist()
            for start, parts in hashing.batches(batch.column("text").to_pylist()):
                w = hashing.words(parts)
                for i in range(len(parts)):
                    own = w.hashes[w.first[i] : w.first[i + 1]]
                    at = 0
                    while True:
                        piece = own[at : at + max(BLOCK_WORDS - size, 1)]
                        rows.append(part + row)
                        ids.append(doc_ids[start + i])
                        flags.append(in_target[start + i])
                        counts.append(len(piece))
                        held.append(piece)
                        size, at = size + len(piece), at + len(piece)
                        if size >= BLOCK_WORDS:
                            yield block()
                            made, rows, ids, flags, counts, held, size = made + 1, [], [], [], [], [], 0
                            before = own[at - 1] if at < len(own) else None
                        if at >= len(own):
                            break
                    row += 1
        if rows:
            yield block()

    types = pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("inside", pa.list_(pa.int32())), ("first", pa.list_(pa.int32())), ("lead", pa.int32()), ("vocabulary", pa.binary()), ("sequence", pa.binary()), ("n_keys", pa.int64())])
    return docs.mapInArrow(run, _BLOCK)


def _pairs(sequence: np.ndarray, first: np.ndarray, lead: int, n: int) -> np.ndarray:
    """Each word with the one before it in its text (n: none) as one number, before * (n + 1) + word."""
    before = np.empty(len(sequence), np.int64)
    before[1:] = sequence[:-1]
    before[first[:-1][np.diff(first) > 0]] = n
    if len(before) and lead != _NO_LEAD:
        before[0] = lead
    return before * (n + 1) + sequence


class _Block:
    """A block's words and bigrams: distinct ones by ascending key, and which of them each word is."""

    def __init__(self, first, lead: int, vocabulary: bytes, sequence: bytes):
        self.first = np.asarray(first, np.int32)
        self.words, self.sequence = np.frombuffer(vocabulary, np.uint64), np.frombuffer(sequence, np.int32)
        n = len(self.words)
        pairs, self.pair_of = np.unique(_pairs(self.sequence, self.first, lead, n), return_inverse=True)
        self.before, self.own = pairs // (n + 1), pairs % (n + 1)
        hashes = np.append(self.words, _START)
        pair_keys = hashing.mix(hashing.mix(hashes[self.before]) + hashes[self.own]) & ~np.uint64(3) | np.where(self.before == n, _FIRST, _PAIR)
        keys = np.concatenate([hashing.mix(self.words) & ~np.uint64(3) | _WORD, pair_keys])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs; weights: of each word."""
        n = np.concatenate([np.bincount(x, weights, k) for x, k in ((self.sequence, len(self.words)), (self.pair_of, len(self.own)))])
        return n[self.order].astype(np.int32)

    def bounds(self, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin: buckets are ranges of keys."""
        edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])

    def by_key(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values in the keys' order as those of the words and of the bigrams."""
        out = np.empty_like(values)
        out[self.order] = values
        return out[: len(self.words)], out[len(self.words) :]


def _marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """docs (doc_id, text) with in_target."""
    target = table(target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct())
    few = target.count() <= MOST_BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(target) if few else target, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.isnotnull("_id").alias("in_target"))


def _sent(blocks: DataFrame, buckets: int, part: int) -> DataFrame:
    """(bucket, block, keys, n, n_target), packed, of every block and bucket of the part."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block(r["first"], r["lead"], r["vocabulary"], r["sequence"])
                flags = np.zeros(len(b.first) - 1)
                flags[r["inside"]] = 1
                n, inside = b.counts(), b.counts(np.repeat(flags, np.diff(b.first)))
                at = b.bounds(buckets).tolist()
                some = [i for i in range(part, buckets, PARTS) if at[i + 1] > at[i]]
                packed = [pa.array([x[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()) for x in (b.keys, n, inside)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([r["block"]] * len(some), pa.int64()), *packed], names=["bucket", "block", "keys", "n", "n_target"])

    return blocks.select("block", "first", "lead", "vocabulary", "sequence", "inside").mapInArrow(run, "bucket int, block bigint, keys binary, n binary, n_target binary")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _wide(packed: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(packed, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, np.int64, offset=size)
    return counts


def _answered(sent: DataFrame) -> DataFrame:
    """(block, bucket, size, n, n_target): the totals of the keys (size of them) that each block sent; with a null block, a bucket's _TOTALS."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        upto = np.concatenate([[0], np.cumsum(frame["keys"].map(len).to_numpy() // 8)]).tolist()
        keys, place = np.unique(np.frombuffer(b"".join(frame["keys"]), np.uint64), return_inverse=True)
        n, inside = (np.bincount(place, np.frombuffer(b"".join(frame[x]), np.int32), len(keys)).astype(np.int64) for x in ("n", "n_target"))
        kind = keys & np.uint64(3)
        word, first, known = kind == _WORD, (kind == _FIRST) & (n >= LEAST_COUNT), n >= LEAST_COUNT
        sums = [n[word].sum(), inside[word].sum(), n[word & ~known].sum(), inside[word & ~known].sum(), (word & known).sum(), n[first].sum(), inside[first].sum()]
        out = {"block": [*frame["block"], None], "bucket": frame["bucket"].iloc[0], "size": [*np.diff(upto), 0], "totals": [None] * len(frame) + [sums]}
        for name, total in (("n", n), ("n_target", inside)):
            own = total[place]
            out[name] = [_narrow(own[a:b]) for a, b in zip(upto, upto[1:], strict=False)] + [None]
        return pd.DataFrame(out).astype({"block": "Int64"})

    return sent.groupBy("bucket").applyInPandas(run, "block bigint, bucket int, size int, n binary, n_target binary, totals array<bigint>")


def _losses(block: dict, totals: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The losses of the block's documents, summed over their words, by the target and by the background."""
    b = _Block(block["first"], block["lead"], block["vocabulary"], block["sequence"])
    answers = sorted(block["answers"] or [], key=lambda a: a["bucket"])
    none = np.zeros(0, np.int64)
    counts = [b.by_key(np.concatenate([none, *(_wide(a[name], a["size"]) for a in answers)])) for name in ("n_target", "n")]
    is_known, counted = counts[1][0] >= LEAST_COUNT, counts[1][1] >= LEAST_COUNT
    out = []
    for (single, pair), of in zip(counts, ("_target", ""), strict=True):
        share = (np.where(is_known, single, totals[f"unknown{of}"]) + 0.5) / (totals[f"words{of}"] + 0.5 * (totals["known"] + 1))
        context = np.append(single, totals[f"first{of}"])[np.where(b.before == len(b.words), len(single), b.before)]
        loss = -np.log(MIXED_IN * np.where(counted, pair, 0) / np.maximum(context, 1) + (1 - MIXED_IN) * share[b.own])
        upto = np.concatenate([[0.0], np.cumsum(loss[b.pair_of])])
        out.append(upto[b.first[1:]] - upto[b.first[:-1]])
    return tuple(out)


def _scored(blocks: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(row, doc_id, n_tokens, target_loss, background_loss), sums, of every document of blocks with their answers."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                columns = [pa.array(r["rows"], pa.int64()), pa.array(r["doc_ids"], pa.int64()), pa.array(np.diff(r["first"]).astype(np.int64)), *(pa.array(x) for x in _losses(r, totals))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "target_loss", "background_loss"])

    return blocks.mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, target_loss double, background_loss double")


@scoped
def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of every row of docs (doc_id, text); target (doc_id) names the target's documents."""
    blocks = table(_blocks(_marked(docs, target)))
    buckets = max(1, -(-(blocks.agg(F.sum("n_keys")).head()[0] or 0) // BUCKET_KEYS))
    answers = functools.reduce(DataFrame.unionByName, [table(_answered(_sent(blocks, buckets, part))) for part in range(PARTS)])
    sums = answers.where("block is null").select(*[F.sum(F.col("totals")[i]).alias(x) for i, x in enumerate(_TOTALS)]).head()
    totals = {x: sums[x] or 0 for x in _TOTALS}
    answered = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "size", "n", "n_target")).alias("answers"))
    parts = table(_scored(blocks.drop("n_keys", "inside").join(answered, "block", "left"), totals))
    # a document that runs over several blocks has a part in each
    rows = parts.groupBy("row", "doc_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "target_loss", "background_loss")])
    rows = rows.select("doc_id", "n_tokens", *[(F.col(x) / F.greatest("n_tokens", F.lit(1))).alias(x) for x in ("target_loss", "background_loss")])
    return rows.withColumn("score", F.col("target_loss") - F.col("background_loss"))
