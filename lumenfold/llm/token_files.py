"""Token-id files: every document compressed on its own with one trained zstandard dictionary.

Layout of a file set (two Parquet tables, so that any store Spark writes to can hold it):

* ``dictionary``: one row (dict_hash: hex SHA-256, dictionary: bytes).
* ``blocks``: a row per block of documents in ascending order: part, block, start (ids before it in its part),
  dict_hash, doc_ids, n_tokens, offsets (n + 1 bounds of the frames in blob) and blob. A frame is the zstandard
  form of the document's ids as little-endian unsigned 32-bit integers.

A short document is read by its block's row and the slice between two offsets. The reader refuses blocks whose
dictionary hash is not that of the dictionary it holds.

Encoding gives each task its share of the documents (range-partitioned by doc_id). Words repeat, and no pre-token
crosses a blank that stands between two characters that are no white space, so the tokenizer runs once per distinct
blank-led word and worker, for many words at a time, and the ids of a text are gathered from those of its words.

Defined results: a null text is empty; a document always ends with the end id; null ids come first, rows of one
id in order of their text; an empty table gives an empty file set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .word_ids import WordIds
from .work import folder

BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 2048
#: Bounds of what the dictionary is trained on, and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4096, 112 << 10
#: Words whose ids a task keeps; beyond it the memory starts afresh.
MEMO_WORDS = 2_000_000

BLOCKS = "part int, block int, start bigint, dict_hash string, doc_ids array<bigint>, n_tokens array<int>, offsets array<bigint>, blob binary"
_BLOCK_TYPES = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("blob", pa.binary())])


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the tokenizer's own.

    literal: a special token's text is encoded as plain text, not as the token.
    """

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level vocabulary writes a byte as a character
            width[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            width[i] = len(token.content.encode())
        self.words = WordIds(self._plain, width, MEMO_WORDS)

    def _plain(self, texts: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        data, starts, at, joinable = _units(parts)
        ids, bounds = self.words.encode(data, starts, joinable, at)
        raw, bounds = ids.astype("<u4", copy=False).tobytes(), (bounds * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list) -> list[bytes]:
        out: list[bytes] = []
        for _, parts in hashing.batches(texts):
            if len(parts) == 1 and len(parts[0]) > hashing.BATCH_BYTES:
                out.append(b"".join(x for piece in _long(parts[0]) for x in self._encode([piece])))
            else:
                out += self._encode(parts)
        return out


#: White space beyond ASCII: the bytes of U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_CODES = np.sort(np.array([int.from_bytes(x.ljust(3, b"\0"), "big") for x in _WIDE]))
_NARROW = np.zeros(256, bool)
_NARROW[[*range(9, 14), *range(28, 33)]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[x[0] for x in _WIDE]] = True


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any kind."""
    space = _NARROW[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        two = padded[lead] == 0xC2
        code = padded[lead] << 16 | padded[lead + 1] << 8 | np.where(two, 0, padded[lead + 2])
        lead, two = (x[np.isin(code, _WIDE_CODES)] for x in (lead, two))
        space[lead] = space[lead + 1] = True
        space[lead[~two] + 2] = True
    return space


def _units(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, where their units start (a text's first, and every blank between two characters that are no white space), where texts start (one more at the end), and which units begin with such a blank and end with a character that is no white space."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    space = _spaces(data)
    lone = np.zeros(len(data) + 1, bool)
    lone[1:-2] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
    inside = np.ones(len(data) + 2, bool)  # a text's first and last bytes stand beside no other text
    inside[at] = False
    inside[at - 1] = False
    lone &= inside[:-1]
    begins = lone.copy()
    begins[at[:-1][at[1:] > at[:-1]]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return data, starts, at, lone[starts] & ~space[ends - 1] if len(starts) else np.zeros(0, bool)


def _long(part: bytes):
    """A long text in pieces that begin with units of its own; one without a place to cut stays whole."""
    starts = _units([part])[1]
    begun = 0
    for i in starts[np.searchsorted(starts, np.arange(hashing.BATCH_BYTES, starts[-1] + 1, hashing.BATCH_BYTES))].tolist():
        if i > begun:
            yield part[begun:i]
            begun = i
    yield part[begun:]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path, literal=False)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Consecutive row ranges of about limit bytes of text."""
    sizes = np.diff(np.asarray(_lengths(batch.column(column))))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), out=out[1:])
    return out


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """A zstandard dictionary from the ids of a bounded, fixed sample (SAMPLE_DOCS documents, a window of SAMPLE_CHARS of each)."""
    import zstandard

    h = F.xxhash64(F.lit(3), "doc_id")
    chosen = docs.select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS)
    last = chosen.agg(F.max("h")).head()[0]  # the numbers alone decide; texts are then read of the chosen ones only
    # anywhere in the text
    window = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    chosen = docs.where(h <= F.lit(last)).select(h.alias("h"), F.substring("text", window, F.lit(SAMPLE_CHARS)).alias("text"))
    sample = chosen.groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    end = np.array([end_id], "<u4").tobytes()
    serialized = [x + end for x in Encoder(tokenizer_path, literal=False).encode([r.text for r in sample.collect()])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, serialized).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the sample itself is the dictionary's content
        return b"".join(serialized)[:DICTIONARY_BYTES]


def write_token_files(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = 2, level: int = 3) -> None:
    """Encode docs (doc_id, text; other columns are ignored) and write the file set to path."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    content = train_dictionary(docs, tokenizer_path, end_id)
    dict_hash = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(dict_hash, content)], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(content)

    def compress(batches):
        import zstandard
        from pyspark import TaskContext

        content = shared.value
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        part, block, start, begun = TaskContext.get().partitionId(), 0, 0, 0
        encoder, end = _encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        ids: list = []
        counts: list[int] = []
        bounds, frames = [0], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, block, begun, dict_hash, ids, counts, bounds, b"".join(frames)), _BLOCK_TYPES, strict=True)], schema=_BLOCK_TYPES)

        for batch in batches:
            for a, b in _slices(batch, "text"):
                part_of = batch.slice(a, b - a)
                for doc, raw in zip(part_of.column("doc_id").to_pylist(), encoder.encode(part_of.column("text").to_pylist()), strict=True):
                    raw += end
                    frame = squeeze.compress(raw)
                    ids.append(doc)
                    counts.append(len(raw) // 4)
                    frames.append(frame)
                    bounds.append(bounds[-1] + len(frame))
                    start += counts[-1]
                    if bounds[-1] >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield row()
                        block, begun, ids, counts, bounds, frames = block + 1, start, [], [], [0], []
        if ids:
            yield row()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(compress, BLOCKS).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32)."""
    (dict_hash, content), *_ = spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").collect()
    if hashlib.sha256(content).hexdigest() != dict_hash:
        raise ValueError("the dictionary is damaged")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    parts = blocks.groupBy("part").agg(F.sum(total).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    shared = spark.sparkContext.broadcast(content)
    types = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary())])

    def expand(batches):
        import zstandard

        content = shared.value
        swell = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                starts = r["start"] + r["before"] + np.concatenate([[0], np.cumsum(r["n_tokens"])])[:-1]
                frames = [swell.decompress(r["blob"][a:b]) for a, b in zip(r["offsets"], r["offsets"][1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["n_tokens"], pa.int32()), pa.array(frames, pa.binary())], schema=types)

    # a row per part of the file set: their number is that of the writing job's tasks
    return blocks.join(F.broadcast(parts), "part").mapInArrow(expand, "doc_id bigint, start bigint, n_tokens int, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> bytes | None:
    """One document's ids (None: there is no such document), by its block's row alone."""
    import zstandard

    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.array_contains("doc_ids", doc_id)).select(F.array_position("doc_ids", doc_id).alias("at"), "offsets", "blob").limit(1)
    rows = found.select(F.expr("substring(blob, cast(element_at(offsets, cast(at as int)) as int) + 1, cast(element_at(offsets, cast(at as int) + 1) - element_at(offsets, cast(at as int)) as int))").alias("frame")).collect()
    content = spark.read.parquet(f"{path}/dictionary").collect()[0]["dictionary"]
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None).decompress(rows[0].frame) if rows else None


def token_digest(docs: DataFrame, *, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as a file set in the shared folder and digest what is read back from it."""
    path = folder(docs.sparkSession)
    write_token_files(docs, path, tokenizer_path=tokenizer_path, end_id=end_id)
    read = read_token_files(docs.sparkSession, path)
    return read.select("doc_id", "start", F.col("n_tokens").cast("long"), F.crc32("ids").alias("ids_crc32"))
