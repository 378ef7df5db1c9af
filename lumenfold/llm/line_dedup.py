"""Line dedup with a deletion-neighbourhood join.

A line is dropped when an earlier line, of the same or another document, is within one edit (insertion, deletion or
substitution of a code point) of it; the earliest always stays. Lines are compared without the blanks around them;
those of fewer than ``min_words`` words are never dropped and never cause a drop (1, the default: every line that is not
blank takes part, however short). Earlier means: smaller doc_id (null
last), then the text's hash, then the line's number; rows with equal doc_id and text are one document.

1. Equal lines form classes by a 128-bit hash; all but a class's first line go.
2. The first lines emit the variants within the edit bound as hashed keys: all deletions of one code point, with
   their place, and the line itself. Equal keys are joined: two lines of one length that give one variant at one
   place differ by a substitution; a line that equals another's variant differs by a deletion. A key's earliest line
   is found by an aggregate, so a key that very many lines share makes as many rows as lines, not as pairs.
3. The pairs found (a dropped line and the one that drops it) are verified by edit distance.

Two lines within one edit agree on all but one segment of any partition, so only lines that agree with another on
all but one half, then on all but one eighth, emit variants, and only those that delete within that eighth.

Defined results: a null text stays null and has no lines; dropping keeps the order of the rest and a document whose
lines all go has an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .mixing import WORD
from .work import scoped, table

MIN_WORDS, SEGMENTS = 1, 8
#: Numbers of lines to compare that are broadcast at most to the documents; beyond it the documents are joined by a shuffle, as always with the lines to drop.
MOST_BROADCAST_LINES = 1_000_000


def _line_columns() -> list[Column]:
    return [F.isnull("doc_id").alias("no_id"), F.col("doc_id"), F.col("thash"), F.col("line_no")]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Every line that counts: its document, number and comparable text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("thash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    keyed = keyed.withColumn("line", F.btrim("line", F.lit(" \t\r\v\f")))
    return keyed.where(F.regexp_count("line", F.lit(WORD)) >= min_words)


def _half_keys() -> Column:
    """For either length that a partner's shorter line may have, hashes of the line's start and end that leave out one half."""
    n = F.char_length("line")
    out = []
    for short in (n, n - 1):
        half = F.floor(short / 2).cast("int")
        out += [F.xxhash64(F.lit(1), short, F.substring("line", F.lit(1), half)), F.xxhash64(F.lit(2), short, F.substring("line", n - (short - half) + 1, short - half))]
    return F.array(*out)


def _shared_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key more than one row has."""
    often = rows.groupBy(key).count().where("count > 1").select(key)
    return rows.join(often, key)


def _point_hashes(line: str) -> np.ndarray:
    """Sums of hashed code points times powers: total[j] - total[i] stands for line[i:j] at its place."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    terms = hashing.mix(points + np.uint64(1)) * hashing._power(hashing._P, len(points))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])


def _cut(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the line without line[start:stop]: the rest moves up."""
    gap = (stop - start).astype(np.int64)
    return total[start] + (total[-1] - total[stop]) * hashing._power(hashing._P_INV, int(gap.max(initial=0)) + 1)[gap]


def _segments(n: int) -> np.ndarray:
    return np.arange(SEGMENTS + 1) * n // SEGMENTS


def _eighth_keys(lines: DataFrame) -> DataFrame:
    """A row for each line, shorter length and segment: a hash of all but that segment."""

    def run(batches):
        for batch in batches:
            names, texts = batch.column("id").to_numpy(), batch.column("line").to_pylist()
            ids, shorter, segment, keys = [], [], [], []
            for name, line in zip(names, texts, strict=True):
                total, n = _point_hashes(line), len(line)
                for short in (n, n - 1):
                    at = _segments(short)
                    rest = _cut(total, at[:-1], at[1:] + (n - short))
                    key = hashing.mix(rest + np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([short], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    ids.append(np.full(SEGMENTS, name))
                    shorter.append(np.full(SEGMENTS, n - short, np.int32))
                    segment.append(np.arange(SEGMENTS, dtype=np.int32))
                    keys.append(key.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, shorter, segment, keys)], names=["id", "shorter", "segment", "key"])

    return lines.select("id", "line").mapInArrow(run, "id bigint, shorter int, segment int, key bigint")


def _variants(lines: DataFrame) -> DataFrame:
    """lines: (id, line, wanted: array of (shorter, segment)). The deletion neighbourhood as (id, key, role).

    Roles: 0 a deletion at its place (a substitution's key), 1 the line itself, 2 a deletion (a longer line's key).
    """

    def run(batches):
        for batch in batches:
            ids, keys, roles = [], [], []
            for name, line, wanted in zip(batch.column("id").to_pylist(), batch.column("line").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                total, n = _point_hashes(line), len(line)
                found = [(hashing.mix(total[-1:] + np.uint64(n)), 1)]
                for w in wanted:
                    at = _segments(n - w["shorter"])
                    place = np.arange(at[w["segment"]], min(at[w["segment"] + 1] + w["shorter"], n))
                    gone = _cut(total, place, place + 1) + np.uint64(n - 1)
                    if w["shorter"]:
                        found.append((hashing.mix(gone), 2))
                    else:
                        found.append((hashing.mix(gone ^ hashing.mix(place.astype(np.uint64) + np.uint64(1))), 0))
                for key, role in found:
                    ids.append(np.full(len(key), name))
                    keys.append(key.view(np.int64))
                    roles.append(np.full(len(key), role, np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, roles)], names=["id", "key", "role"])

    return lines.mapInArrow(run, "id bigint, key bigint, role int").distinct()


def _with_numbers(docs: DataFrame, lines: DataFrame, name: str, most_broadcast: int = 0) -> DataFrame:
    """docs (with doc_id, thash) joined with the numbers of the given lines (doc_id, thash, line_no) of each, if any; up to most_broadcast numbers are broadcast."""
    by_doc = table(lines.groupBy("doc_id", "thash").agg(F.collect_set("line_no").alias(name)))
    few = most_broadcast > 0 and (by_doc.agg(F.sum(F.size(name) + 4)).head()[0] or 0) <= most_broadcast
    by_doc = by_doc.withColumnRenamed("doc_id", "_id").withColumnRenamed("thash", "_thash")
    found = docs.join(F.broadcast(by_doc) if few else by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("thash") == F.col("_thash")), "left")
    return found.drop("_id", "_thash")


@scoped
def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines of docs (doc_id, text) to drop: doc_id, thash (of the text), line_no."""
    lines = _lines(docs.select("doc_id", "text"), min_words)
    lines = lines.select("doc_id", "thash", "line_no", F.xxhash64(F.lit(2), "line").alias("a"), F.xxhash64(F.lit(3), "line").alias("b"), _half_keys().alias("halves"))
    lines = table(lines)
    order = F.struct(*_line_columns())
    classes = lines.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("count"), F.first("halves").alias("halves"))
    classes = table(classes)
    firsts = classes.select("a", "b", "first.*", "halves")
    # a line that very many rows repeat is a skewed key on the left side alone, which adaptive execution splits
    repeated = lines.select("doc_id", "thash", "line_no", "a", "b").join(classes.where("count > 1").select("a", "b", "first"), ["a", "b"]).where(F.struct(*_line_columns()) > F.col("first")).select("doc_id", "thash", "line_no")

    halves = firsts.select("doc_id", "thash", "line_no", F.explode("halves").alias("key"))
    near = _shared_keys(halves, "key").select("doc_id", "thash", "line_no").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("thash"), "text")
    texts = _with_numbers(texts, near, "numbers", MOST_BROADCAST_LINES).where("numbers is not null").dropDuplicates(["doc_id", "thash"])
    asked = texts.select("doc_id", "thash", F.explode("numbers").alias("line_no"), "text")
    asked = asked.select("doc_id", "thash", "line_no", F.btrim(F.element_at(F.split("text", "\n"), F.col("line_no") + 1), F.lit(" \t\r\v\f")).alias("line"))
    asked = table(asked.withColumn("id", F.xxhash64("doc_id", "thash", "line_no")))

    eighths = _shared_keys(_eighth_keys(asked), "key").groupBy("id").agg(F.collect_set(F.struct("shorter", "segment")).alias("wanted"))
    keys = _variants(asked.join(eighths, "id").select("id", "line", "wanted"))
    keys = table(keys.join(asked.select("id", F.struct(*_line_columns()).alias("at")), "id"))
    least = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "id")))
    firsts = keys.groupBy("key").agg(F.count("*").alias("n"), least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2")).where("n > 1")
    by = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = keys.join(firsts, "key").withColumn("by", by).where(F.col("by.at") < F.col("at")).select("id", F.col("by.id").alias("by_id")).distinct()
    text_of = asked.select("id", "line")
    checked = pairs.join(text_of, "id").join(text_of.select(F.col("id").alias("by_id"), F.col("line").alias("by_line")), "by_id").where(F.levenshtein("line", "by_line", 1) >= 0)
    changed = asked.join(checked.select("id").distinct(), "id", "left_semi").select("doc_id", "thash", "line_no")
    return repeated.unionByName(changed).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text and any other columns) with text without its duplicate lines, n_lines and n_removed (columns of these names are replaced)."""
    dropped = duplicate_lines(docs, min_words)
    docs = docs.drop("n_lines", "n_removed")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("thash"), "text")
    found = _with_numbers(own, dropped, "dropped")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_removed"))
