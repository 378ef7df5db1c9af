"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit values.

Each distinct five-word shingle is hashed once. The hash's top bits choose one of BINS bins, the rest is its
value; a bin keeps its least value. An empty bin i takes the value of the first non-empty bin in a walk of
pseudo-random bins that depends on i and the attempt alone (optimal densification), so equal bins of two texts
borrow alike. A fingerprint stores the low BITS bits of every bin; the likeness of two fingerprints corrects the
share of equal bins for chance matches: (p - c) / (1 - c), c = 2 ** -BITS.

Defined results: A-Z are lowered and words are runs of non-blank characters; a text of one to four words has its
whole sequence as its only shingle; a text without words (or null) has the fingerprint of zeros of length 0 (the
empty string), whose likeness is 1 to itself and 0 to any other.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

BINS, BITS, WORDS = 256, 8, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Makes the low bits of one value differ between bins, for texts with few shingles.
_SALT = hashing.mix(np.arange(1, BINS + 1, dtype=np.uint64))


def _walks() -> np.ndarray:
    """For each attempt the bins that empty bins look at next."""
    attempts, bins = np.meshgrid(np.arange(1, 4097, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return (hashing.mix(attempts * np.uint64(0x100000001B3) + bins * np.uint64(0x9E3779B1)) % np.uint64(BINS)).astype(np.int64)


_WALKS = _walks()


def signatures(texts: list) -> np.ndarray:
    """Low bits of the densified bins, a row of BINS bytes a text; texts without words have no meaningful row."""
    out = np.zeros((len(texts), BINS), np.uint8)
    for start, parts in hashing.batches(texts):
        values, first = hashing.shingles(hashing.words(parts), WORDS)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(parts)), count)
        slot = owner * BINS + (values >> np.uint64(56)).astype(np.int64)
        least = np.full(len(parts) * BINS, _NONE)
        np.minimum.at(least, slot, values & np.uint64((1 << 56) - 1))
        least = least.reshape(len(parts), BINS)
        full = least != _NONE
        have = least.copy()
        text, empty = np.nonzero(~full & (count > 0)[:, None])
        for walk in _WALKS:
            if not len(text):
                break
            donor = walk[empty]
            found = full[text, donor]
            least[text[found], empty[found]] = have[text[found], donor[found]]
            text, empty = text[~found], empty[~found]
        least[text, empty] = have.min(1)[text]
        out[start : start + len(parts)] = (hashing.mix(least ^ _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return out


def fingerprints(texts: list) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() if t and _has_words(t) else "" for row, t in zip(signatures(texts), texts, strict=True)]


def _has_words(text: str) -> bool:
    return bool(text.strip(" \t\n\v\f\r"))


def likeness(a: str, b: str) -> float:
    """The estimated resemblance of two fingerprints' texts, 0 to 1."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(base64.b64decode(s), np.uint8) for s in (a, b))
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float((x == y).mean()) - chance) / (1 - chance)))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text); works in place, without a shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fingerprints(batch.column("text").to_pylist()), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _cuts(ids: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the table into about equally many rows."""
    if buckets < 2:
        return []
    found = ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).head()[0]
    return sorted(set(found or []))


def _bucket_of(cuts: list[int]):
    """The bucket of an id: 1 and up in ascending order, 0 for null."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids):
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges, ids[known].to_numpy(np.int64)) + 1
        return pd.Series(out)

    return bucket


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(rows, limit: int = 2 << 20):
    """Lists of consecutive (doc_id, text) of one bucket and the text after each list's last row, about limit characters each."""
    held, size, current = [], 0, None
    for bucket, extra, doc, text in rows:
        if held and (bucket != current or extra or size > limit):
            if bucket == current:
                yield held, text
            held, size = [], 0
        current = bucket
        if not extra:
            held.append((doc, text))
            size += len(text)
    assert not held, "every bucket ends with the head of another"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    row's text, in descending doc_id, nulls last, rows of one id by text; after the last row comes the first. Rows
    are dealt into buckets of consecutive ids; each bucket's first row also goes to the bucket above it, so texts
    are shuffled once and a task holds a few MB of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = _bucket_of(_cuts(docs.select("doc_id"), 4 * partitions))
    heads = {r[0]: r[1] for r in docs.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id")).collect()}
    order = sorted(heads, reverse=True)
    also = [(heads[b], above) for above, b in zip(order, order[1:] + order[:1], strict=True)]
    also = spark.createDataFrame(also, "head bigint, target int")  # a row a bucket
    placed = docs.withColumn("bucket", bucket("doc_id")).join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    both = F.when(F.col("target").isNull(), F.array(F.struct("bucket", F.lit(False).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("extra")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("extra"))))
    placed = placed.select(F.inline(both), "doc_id", "text").repartition(partitions, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True)

        for held, after in _with_next(rows()):
            texts = [t for _, t in held] + [after]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
            own, new = fingerprints(texts), fingerprints(edited)
            columns = (
                pa.array([d for d, _ in held], pa.int64()),
                pa.array([len(t) for _, t in held], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array(own[:-1]),
                pa.array(new),
                pa.array([likeness(x, y) for x, y in zip(own, new, strict=False)]),
                pa.array([likeness(x, y) for x, y in zip(own, own[1:], strict=False)]),
            )
            yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.mapInArrow(run, RESULT)
