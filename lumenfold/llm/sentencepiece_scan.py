"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A text is a path through the lattice of vocabulary pieces. For a merge-based (BPE) model the encoding is the one
path whose neighbouring pieces are all *compatible*: the model encodes the two of them, joined, as just these two.
So edges weigh 0 when compatible and minus infinity otherwise, and encoding is a maximum-weight path: a max-plus
product of transfer matrices. (The only public model at hand is of this kind; the sums of its piece scores
do not rank encodings, so weights taken from the scores would not give the model's ids.)

A document of more than ``chunk_chars`` characters is split into chunks of that length. A boundary's state is the
piece that begins last before it: (characters back to its start, its length). Each chunk's task yields the matrix of
the states at its two ends whose weight is 0; the matrices are multiplied along the document, which settles the
state at every boundary; then each chunk traces its own pieces back. No piece crosses from a letter into a blank, so
inside a chunk the lattice is built only up to its first such place and from its last one; between them, and in
short documents, the words are encoded by the library once each per worker. A chunk without such a place gets the
whole lattice.

The matrices are combined as a tree of FAN_IN branches: products go up level by level, and the states at each node's
ends come down the same way, so a group holds FAN_IN small matrices however long the document is.

Defined results: a null or empty text has no ids; equal giant texts are encoded once; the ids are the library's
own for the whole text. Decoding is exact except that U+2581 in a text comes back as a blank.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .word_ids import WordIds, gathered
from .work import scoped, table

BLANK = "▁"
#: Words whose ids a worker keeps; beyond it the memory starts afresh.
MEMO_WORDS = 1_000_000
FAN_IN = 64


class Model:
    """A SentencePiece BPE model with identity normalisation, byte fallback and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or any(p.type == 4 for p in proto.pieces):
            raise ValueError("only BPE models with identity normalisation and a dummy prefix, without user-defined pieces")
        spec.add_dummy_prefix = False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        normal = [p.piece for p in proto.pieces if p.type == 1]
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("pieces cross from a letter into a blank")
        self.longest = max(map(len, normal))
        self.pieces = frozenset(normal)
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(BLANK, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        self.width = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begin, self.all_bytes = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.words = WordIds(self.raw.encode, self.width, MEMO_WORDS)
        self.ids_of = functools.lru_cache(1 << 14)(lambda token: tuple(self.raw.encode(token)))
        self.own = functools.lru_cache(1 << 14)(lambda token: token in self.pieces and len(self.ids_of(token)) == 1 or len(token) == 1)
        self.compatible = functools.lru_cache(1 << 14)(lambda a, b: tuple(self.raw.encode(a + b)) == self.ids_of(a) + self.ids_of(b))

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts and where each begins, their ids and where those of each begin. Texts are normalised, with blanks as blanks.

        No piece crosses from another character into a blank, so units begin with the first blank after one.
        """
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        begins = np.zeros(len(data), bool)
        begins[1:] = (data[1:] == 32) & (data[:-1] != 32)
        begins[at[:-1][at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        joinable = (data[starts] == 32) & (data[ends - 1] != 32) if len(starts) else np.zeros(0, bool)
        return data, at, *self.words.encode(data, starts, joinable, at)

    def _batches(self, texts: list):
        """Whole texts, normalised, a batch at a time."""
        for _, parts in hashing.batches([" " + t.replace(BLANK, " ") if t else None for t in texts]):
            yield self._encode(parts)

    def encode_lattice(self, span: str) -> bytes:
        """Ids (little-endian int32) of a span of normalised text that begins and ends where no piece crosses."""
        return self._encode([span.replace(BLANK, " ").encode()])[2].astype("<i4").tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """Ids of whole texts."""
        out: list[bytes] = []
        for _, _, ids, bounds in self._batches(texts):
            raw, bounds = ids.astype("<i4").tobytes(), (bounds * 4).tolist()
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where those of each begin."""
        return gathered(self.all_bytes, self.begin[ids], self.width[ids])

    def decode(self, ids: bytes) -> str:
        text = self.spelled(np.frombuffer(ids, "<i4"))[0].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def digests(self, texts: list) -> list[tuple[int, int, bool]]:
        """Of whole texts: their number of ids, the ids' crc32, and whether decoding them gives the text."""
        out = []
        for data, at, ids, bounds in self._batches(texts):
            decoded, upto = self.spelled(ids)
            raw, back, text, upto = ids.astype("<i4").tobytes(), decoded.tobytes(), data.tobytes(), upto[bounds].tolist()
            bounds, at = bounds.tolist(), at.tolist()
            for i in range(len(at) - 1):
                a, b = bounds[i], bounds[i + 1]
                out.append((b - a, zlib.crc32(raw[4 * a : 4 * b]), back[upto[i] : upto[i + 1]] == text[at[i] : at[i + 1]]))
        return out

    def paths(self, text: str, begin: int, end: int, first: str | None) -> dict[int, tuple[int, int]]:
        """For each position up to end that the pieces after `first` (which ends at begin) reach: where its last piece starts and that piece's own end.

        Positions map to (start of the last piece, position); begin itself maps to (begin, begin).
        """
        last: dict[int, str | None] = {begin: first}
        back = {begin: (begin, begin)}
        for at in range(begin, end):
            if at not in last:
                continue
            before = last[at]
            for stop in range(at + 1, min(at + self.longest, len(text)) + 1):
                token = text[at:stop]
                if self.own(token) and (before is None or self.compatible(before, token)) and stop not in back:
                    back[stop] = (at, stop)
                    last[stop] = token
        return back


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def normalised(text: str) -> str:
    return (BLANK + text.replace(" ", BLANK)) if text else ""


def _edge(text: str, low: int, high: int, step: int) -> int | None:
    """The first place from low to high (or the last one, step -1) where no piece crosses."""
    places = range(low, high + 1) if step > 0 else range(high, low - 1, -1)
    return next((i for i in places if 0 < i < len(text) and text[i] == BLANK and text[i - 1] != BLANK), None)


State = tuple[int, int]
#: The state before a document's first character, and at a boundary that no piece crosses.
START: State = (0, 0)


def chunk_window(text_length: int, chunk: int, number: int, margin: int) -> tuple[int, int]:
    return max(0, number * chunk - margin), min(text_length, (number + 1) * chunk + margin)


def _states(m: Model, window: str, at: int) -> list[State]:
    """All pieces of the window that begin before `at` and end there or later."""
    return [(o, n) for o in range(1, min(at, m.longest) + 1) for n in range(o, min(m.longest, len(window) - at + o) + 1) if m.own(window[at - o : at - o + n])]


def _from(m: Model, window: str, left: int, right: int, state: State, stop: int | None):
    """Reachable positions after a boundary state at left, up to stop (a safe place) or to the right boundary."""
    if state == START:
        begin, first = left, None
    else:
        begin, first = left - state[0] + state[1], window[left - state[0] : left - state[0] + state[1]]
    if stop is not None and begin > stop:
        return {}
    return m.paths(window[:stop] if stop is not None else window, begin, stop if stop is not None else right, first)


def _ends(back: dict[int, tuple[int, int]], right: int, length: int, last: bool) -> dict[State, int]:
    """The states at right that a search's positions give; at the document's end only the piece that ends with it."""
    return {(right - s, e - s): e for s, e in back.values() if s < right <= e and s < e and (not last or e == length)}


def transfer(m: Model, window: str, left: int, right: int, first: bool, last: bool) -> list[tuple[State, State]]:
    """The pairs of boundary states of the chunk window[left:right] whose weight is 0, not minus infinity."""
    a, b = _edge(window, left + 1, right, 1), _edge(window, left + 1, right, -1)
    starts = [START] if first or _edge(window, left, left, 1) is not None else _states(m, window, left)
    if a is None:
        out = []
        for s in starts:
            if s != START and s[1] - s[0] + left >= right:  # the piece covers the whole chunk
                if not last or s[1] - s[0] + left == right:
                    out.append((s, (s[0] + right - left, s[1])))
                continue
            out += [(s, e) for e in _ends(_from(m, window, left, right, s, None), right, len(window), last)]
        return out
    good = [s for s in starts if a in _from(m, window, left, right, s, a)]
    ends = _ends(m.paths(window, b, right, None), right, len(window), last) if b < right else [START]
    return [(s, e) for s in good for e in ends]


def trace(m: Model, window: str, left: int, right: int, begin: State, end: State) -> bytes:
    """The ids of the pieces that begin in window[left:right], given the states at its ends."""
    a, b = _edge(window, left + 1, right, 1), _edge(window, left + 1, right, -1)

    def walk(back: dict, stop: int) -> list[str]:
        out = []
        while back[stop][0] != back[stop][1]:
            out.append(window[back[stop][0] : stop])
            stop = back[stop][0]
        return out[::-1]

    if a is None:
        if begin != START and begin[1] - begin[0] + left >= right:
            return b""
        tokens = walk(_from(m, window, left, right, begin, None), right - end[0] + end[1])
        return np.array([i for t in tokens for i in m.ids_of(t)], "<i4").tobytes()
    head = walk(_from(m, window, left, right, begin, a), a)
    tail = walk(m.paths(window, b, right, None), right - end[0] + end[1]) if b < right else []
    ids = lambda tokens: np.array([i for t in tokens for i in m.ids_of(t)], "<i4").tobytes()
    return ids(head) + m.encode_lattice(window[a:b]) + ids(tail)


def multiply(x: list[tuple[State, State]], y: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """The max-plus product of two sparse transfer matrices with weights 0 and minus infinity."""
    after: dict[State, set[State]] = {}
    for s, e in y:
        after.setdefault(s, set()).add(e)
    return sorted({(s, f) for s, e in x for f in after.get(e, ())})


def product(matrices: list[list[tuple[State, State]]]) -> list[tuple[State, State]]:
    return functools.reduce(multiply, matrices)


def settle(matrices: list[list[tuple[State, State]]], begin: State, end: State) -> list[tuple[State, State]]:
    """The states at both ends of every chunk of a run, given those at the run's ends."""
    prefix = [[(begin, begin)]]
    for m in matrices:
        prefix.append(multiply(prefix[-1], m))
    state, out = end, []
    for before, m in zip(reversed(prefix[:-1]), reversed(matrices), strict=True):
        reached = {e for _, e in before}
        left = next(s for s, e in m if e == state and s in reached)
        out.append((left, state))
        state = left
    return out[::-1]


def _pack(pairs: list[tuple[State, State]]) -> bytes:
    return np.array(pairs, np.int32).tobytes()


def _unpack(packed: bytes) -> list[tuple[State, State]]:
    return [((a, b), (c, d)) for a, b, c, d in np.frombuffer(packed, np.int32).reshape(-1, 4).tolist()]


def _settled(matrices: DataFrame) -> DataFrame:
    """matrices: (key, number, pairs). Returns (key, number, ends): the states at each chunk's ends, packed."""

    def up(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "number": [key[1]], "pairs": [_pack(product([_unpack(x) for x in frame.sort_values("number")["pairs"]]))]})

    def down(key, children: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("number")
        ((begin, end),) = _unpack(nodes["ends"].iloc[0])
        ends = settle([_unpack(x) for x in children["pairs"]], begin, end)
        return pd.DataFrame({"key": children["key"], "number": children["number"], "ends": [_pack([x]) for x in ends]})

    levels, most = [matrices], matrices.agg(F.max("number")).head()[0] or 0
    branch = [F.col("key"), F.floor(F.col("number") / FAN_IN).cast("int").alias("branch")]
    while most or len(levels) == 1:
        levels.append(table(levels[-1].groupBy(*branch).applyInPandas(up, "key string, number int, pairs binary")))
        most //= FAN_IN
    # a document's product is the one pair of its start and of the state at its end
    ends = levels[-1].select("key", "number", F.col("pairs").alias("ends"))
    for level in reversed(levels[:-1]):
        ends = level.groupBy(*branch).cogroup(ends.groupBy("key", "number")).applyInPandas(down, "key string, number int, ends binary")
    return ends


@scoped
def _giant_ids(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """giants: (key, text), keys distinct. Returns (key, ids)."""
    partitions = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        m = model(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = normalised(text)
                count = -(-len(n) // chunk)
                for i in range(count):
                    low, high = chunk_window(len(n), chunk, i, m.longest)
                    left, right = i * chunk - low, min((i + 1) * chunk, len(n)) - low
                    yield pa.RecordBatch.from_pylist([{"key": key, "number": i, "chunks": count, "left": left, "right": right, "window": n[low:high]}], schema=types)

    types = pa.schema([("key", pa.string()), ("number", pa.int32()), ("chunks", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("window", pa.string())])
    chunks = table(giants.mapInArrow(cut, "key string, number int, chunks int, left int, right int, window string").repartition(partitions, "key", "number"))

    def matrix(frames):
        m = model(path)
        for f in frames:
            rows = [transfer(m, r.window, r.left, r.right, r.number == 0, r.number == r.chunks - 1) for r in f.itertuples()]
            yield pd.DataFrame({"key": f["key"], "number": f["number"], "pairs": [_pack(x) for x in rows]})

    matrices = table(chunks.select("key", "number", "chunks", "left", "right", "window").mapInPandas(matrix, "key string, number int, pairs binary"))

    def back(frames):
        m = model(path)
        for f in frames:
            states = [_unpack(x)[0] for x in f["ends"]]
            yield pd.DataFrame({"key": f["key"], "number": f["number"], "ids": [trace(m, r.window, r.left, r.right, *s) for r, s in zip(f.itertuples(), states, strict=True)]})

    traced = chunks.join(_settled(matrices), ["key", "number"]).mapInPandas(back, "key string, number int, ids binary")
    return traced.groupBy("key").agg(F.expr("coalesce(listagg(ids) within group (order by number), x'')").alias("ids"))


def _giants(docs: DataFrame, chunk: int) -> DataFrame:
    """(key, text): the distinct texts of more than chunk characters."""
    return docs.where(F.length("text") > chunk).select(_key().alias("key"), "text").dropDuplicates(["key"])


def _key():
    return F.sha2(F.col("text").cast("binary"), 256)


def encode(docs: DataFrame, *, model_path: str, chunk_chars: int = 1 << 15) -> DataFrame:
    """docs with ids (binary, little-endian int32); a column of that name is replaced."""
    rows = docs.drop("ids").select(F.struct("*").alias("row"), "text")
    giants = _giant_ids(_giants(docs, chunk_chars), model_path, chunk_chars)

    @F.pandas_udf("binary")
    def short(texts: pd.Series) -> pd.Series:
        return pd.Series(model(model_path).encode(texts.tolist()), dtype=object)

    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    small = rows.where(~giant).select("row", short(F.col("text")).alias("ids"))
    large = rows.where(giant).select("row", _key().alias("key")).join(giants, "key").select("row", "ids")
    return small.unionByName(large).select("row.*", "ids")


def decode(rows: DataFrame, *, model_path: str) -> DataFrame:
    """rows (with ids as encode makes them) with decoded (the text of the ids); a column of that name is replaced."""

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        return ids.map(model(model_path).decode)

    return rows.drop("decoded").withColumn("decoded", back(F.col("ids")))


_DIGEST = "n_tokens bigint, ids_crc32 bigint, round_trip boolean"


@scoped
def encode_digest(docs: DataFrame, *, model_path: str, chunk_chars: int = 1 << 15) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip (decoding gives the text, U+2581 read as a blank).

    Short texts are encoded and decoded in one pass; a giant text's digest is made once for all its copies, which
    meet it by their key alone.
    """
    docs = docs.select("doc_id", "text")
    texts = table(_giants(docs, chunk_chars))
    giants = _giant_ids(texts, model_path, chunk_chars)
    same = F.col("decoded") == F.translate("text", BLANK, " ")
    giants = decode(giants, model_path=model_path).join(texts, "key").select("key", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))
    giants = table(giants)

    @F.pandas_udf(_DIGEST)
    def short(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model(model_path).digests(texts.tolist()), columns=["n_tokens", "ids_crc32", "round_trip"])

    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    small = docs.where(~giant).select("doc_id", short(F.col("text")).alias("d")).select("doc_id", "d.*")
    large = docs.where(giant).select("doc_id", _key().alias("key")).join(giants, "key").drop("key")
    return small.unionByName(large)
