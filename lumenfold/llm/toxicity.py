"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and five-byte word beginnings that mark label 1) is learnt from training rows, with no language
or source given. Features of a whole text: lexicon densities, nearness of lexicon words to second-person words,
capitals, punctuation and obfuscation rates. Training rows are cross-fitted: those of a fold get features from
the lexicon of the other folds, so the trees see the lexicon as it works on texts that it was not learnt from.
The last fold calibrates the trees' output.

Learning uses at most ``SAMPLE_ROWS`` labelled rows (those of least hash); the lexicon holds every word of theirs that
marks label 1. All else covers every row.

Defined results: columns named score, held_out and predicted are replaced; a null or empty text has all features 0 and gets the score of that; labels that are null or
without a document are ignored, of several labels for one id the largest holds; with no labelled rows, or only one
class, every score is the share of label 1 among them (0 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .work import scoped, table

SAMPLE_ROWS, FOLDS = 20_000, 4
LEAST_COUNT, LEAST_LOG_ODDS, NEAR = 3, 2.0, 4
THRESHOLD = 0.7

# Words of address in the languages that the operator knows.
SECOND_PERSON = "you your yours yourself u ur ya du dich dir dein deine deinen ihr euch sie ihnen tu te toi ton ta tes vous votre vos ti usted ustedes vosotros vuestra vuestro".split()
# Characters that stand for letters in disguised words.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = "lexicon_density lexicon_mean lexicon_hits prefix_density prefix_mean second_person near_second_person capitals shouted marks punctuation obfuscated disguised spelled_out words".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SOLVED = np.arange(256, dtype=np.uint8)
for _a, _b in LOOKALIKE.items():
    _SOLVED[ord(_a)] = ord(_b)
_PREFIX_SALT = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Lexicon:
    keys: np.ndarray
    odds: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Log-odds of each hash, 0 where the lexicon lacks it."""
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.odds[at], 0.0)


def _runs(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def _letter_words(data: np.ndarray, at: np.ndarray):
    """Runs of letters: hash, text number, bounds, hash of the first five bytes (0: shorter than six)."""
    starts, ends = _runs(_LETTER[data])
    hashes = hashing.span_hashes(data, starts, ends, True)
    long = ends - starts >= 6
    prefix = np.zeros(len(hashes), np.uint64)
    prefix[long] = hashing.span_hashes(data, starts[long], starts[long] + 5, True) ^ _PREFIX_SALT
    return hashes, np.searchsorted(at, starts, "right") - 1, starts, ends, prefix


def _you() -> np.ndarray:
    data, starts, ends, _ = hashing.spans([w.encode() for w in SECOND_PERSON])
    return np.sort(hashing.span_hashes(data, starts, ends, True))


_YOU = _you()


def _sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def features(texts: list, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of every text (None: empty), a row each."""
    out = np.zeros((len(texts), len(FEATURES)))
    for start, parts in hashing.batches(texts):
        if len(parts) == 1 and len(parts[0]) > hashing.BATCH_BYTES:
            sums = _long_sums(parts[0], lexicon)
        else:
            sums = _sums(parts, lexicon)
        out[start : start + len(parts)] = _rates(sums)
    return out


def _sums(parts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """What the features are made of, summed over each text: words, letters, bytes, then what is counted in them."""
    n = len(parts)
    data, _, _, at = hashing.spans(parts)
    text_of = np.repeat(np.arange(n), np.diff(at))
    hashes, owner, begins, ends, prefix = _letter_words(data, at)
    odds, start_odds = lexicon.of(hashes), lexicon.of(prefix)
    hits = odds > 0
    you = _YOU[np.minimum(np.searchsorted(_YOU, hashes), len(_YOU) - 1)] == hashes
    reach = np.zeros(len(hashes) + 1)
    np.cumsum(you, out=reach[1:])
    index = np.arange(len(hashes))
    first = np.searchsorted(owner, np.arange(n + 1))
    low, high = np.maximum(index - NEAR, first[owner]), np.minimum(index + NEAR + 1, first[owner + 1])
    near = hits & (reach[high] - reach[low] > 0)
    capitals = np.zeros(len(data) + 1)
    np.cumsum(_CAPITAL[data], out=capitals[1:])
    shouted = (ends - begins >= 3) & (capitals[ends] - capitals[begins] == ends - begins)
    marks = (data == 33) | (data == 63)
    punctuation = ~_LETTER[data] & ~_BLANK[data] & ~((data >= 48) & (data <= 57))
    mixed = ~_LETTER[data] & ~_BLANK[data]
    inner = mixed[1:-1] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    solved = _SOLVED[data]
    keep = _LETTER[solved] | _BLANK[data]
    squeezed = np.ascontiguousarray(solved[keep])
    at_squeezed = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, at[:-1].astype(np.int64)))])
    s, e = _runs(_LETTER[squeezed])
    open_hits = _sum(lexicon.of(hashing.span_hashes(squeezed, s, e, True)) > 0, np.searchsorted(at_squeezed, s, "right") - 1, n)
    single = ends - begins == 1
    spelled = np.zeros(len(single), bool)
    if len(single) > 2:
        spelled[1:-1] = single[1:-1] & single[:-2] & single[2:]
    of_words = [_sum(x, owner, n) for x in (hits, odds, start_odds > 0, start_odds, you, near, shouted, spelled)]
    of_bytes = [_sum(x, text_of, n) for x in (_CAPITAL[data], marks, punctuation)]
    return np.stack([np.bincount(owner, minlength=n), _sum(_LETTER[data], text_of, n), np.diff(at) - 1, *of_words, *of_bytes, _sum(inner, text_of[1:-1], n), open_hits], 1)


#: What _sums counts over several words.
_OVER_WORDS = [8, 10]


def _long_sums(part: bytes, lexicon: Lexicon) -> np.ndarray:
    """_sums of one long text, taken in pieces. What a cut between words hides is counted again over the words around it."""
    total, before, reach = np.zeros(1), None, 2 * NEAR
    for piece in hashing.pieces(part):
        total = total + _sums([piece], lexicon)
        starts, ends = _runs(_LETTER[np.frombuffer(piece, np.uint8)])
        if before is not None:
            after = piece[: ends[reach - 1]] if len(ends) >= reach else piece
            seam = _sums([before + after], lexicon) - _sums([before], lexicon) - _sums([after], lexicon)
            total[:, _OVER_WORDS] += seam[:, _OVER_WORDS]
        before = piece[starts[-reach] :] if len(starts) >= reach else (before or b"") + piece
    return total


def _rates(sums: np.ndarray) -> np.ndarray:
    """FEATURES from _sums."""
    words, letters, chars, hits, odds, starts, start_odds, you, near, shouted, spelled, capitals, marks, punctuation, inner, open_hits = sums.T
    per_word, per_letter, per_char = np.maximum(words, 1), np.maximum(letters, 1), np.maximum(chars, 1)
    columns = (hits / per_word, odds / per_word, np.log1p(hits), starts / per_word, start_odds / per_word, you / per_word, near / per_word, capitals / per_letter, shouted / per_word, marks / per_char, punctuation / per_char, inner / per_word, np.maximum(open_hits - hits, 0) / per_word, spelled / per_word, np.log1p(words))
    return np.stack(columns, 1)


def _word_counts(sample: DataFrame) -> DataFrame:
    """By hash and fold, in how many sampled texts of either label a word or a word's beginning occurs."""

    def run(batches):
        for batch in batches:
            toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for start, parts in hashing.batches(batch.column("text").to_pylist()):
                data, _, _, at = hashing.spans(parts)
                hashes, owner, _, _, prefix = _letter_words(data, at)
                first = np.searchsorted(owner, np.arange(len(parts) + 1))
                for i in range(len(parts)):
                    own = slice(first[i], first[i + 1])
                    keys = np.unique(np.concatenate([hashes[own], prefix[own][prefix[own] > 0]]))
                    one = np.full(len(keys), 1, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(one * int(fold[start + i])), pa.array(one * int(toxic[start + i])), pa.array(one)], names=["key", "fold", "marked", "seen"])

    return sample.select("text", "toxic", "fold").mapInArrow(run, "key bigint, fold bigint, marked bigint, seen bigint").groupBy("key", "fold").agg(F.sum("marked").alias("marked"), F.sum("seen").alias("seen"))


def _lexicon(counts: dict[str, np.ndarray], totals: dict[int, tuple[int, int]], without: int | None) -> Lexicon:
    folds = [f for f in totals if f != without]
    marked_all, all_ = (sum(totals[f][i] for f in folds) for i in (0, 1))
    marked, seen = (sum(counts[f"{x}{f}"] for f in folds) for x in ("marked", "seen"))
    clean = seen - marked
    odds = np.log((marked + 0.5) / (marked_all - marked + 1)) - np.log((clean + 0.5) / (all_ - marked_all - clean + 1))
    keep = (marked >= LEAST_COUNT) & (odds >= LEAST_LOG_ODDS)
    keys = counts["key"][keep].view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], odds[keep][order])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score (0 to 1, higher: label 1 likelier); works in place, without a shuffle. Only text is an input."""
        shared = docs.sparkSession.sparkContext.broadcast(self.lexicon)
        if self.trees is None:
            return docs.withColumn("score", F.lit(self.base))

        @F.pandas_udf("array<double>")
        def featured(texts):
            import pandas as pd

            return pd.Series(list(features(texts.tolist(), shared.value)))

        own = docs.drop("score").select(F.struct("*").alias("_row"), array_to_vector(featured(F.col("text"))).alias("features"))
        return _calibrated(self.trees, self.calibration, own).select("_row.*", "score")


def _calibrated(trees, calibration, rows: DataFrame) -> DataFrame:
    rows = trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
    rows = calibration.transform(rows)
    # the trees' own order breaks the ties within a calibrated step
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw"))))


@scoped
def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic): give only the rows that may be learnt from."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows rows of two numbers
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = table(sample.select("text", "toxic", F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(FOLDS)).cast("int").alias("fold")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    totals = {r["fold"]: (r["marked"], r["n"]) for r in sample.groupBy("fold").agg(F.sum("toxic").alias("marked"), F.count("*").alias("n")).collect()}
    marked, n = (sum(v[i] for v in totals.values()) for i in (0, 1))
    fit_on = {f: v for f, v in totals.items() if f != FOLDS - 1}
    if not 0 < marked < n or not 0 < sum(v[0] for v in fit_on.values()) < sum(v[1] for v in fit_on.values()):
        return ToxicityModel(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, marked / n if n else 0.0)
    sums = [F.sum(F.when(F.col("fold") == f, F.col(x)).otherwise(0)).alias(f"{x}{f}") for x in ("marked", "seen") for f in totals]
    counts = _word_counts(sample).groupBy("key").agg(F.sum("marked").alias("marked"), F.sum("seen").alias("seen"), *sums)
    # numbers of the words that mark label 1 in the sample, which is bounded
    found = counts.where((F.col("marked") >= LEAST_COUNT) & (F.col("marked") * n > 2 * F.col("seen") * marked)).toArrow()
    counts = {x: found.column(x).to_numpy() for x in found.column_names}
    by_fold = {f: _lexicon(counts, totals, f) for f in totals}

    def run(batches):
        for batch in batches:
            fold, texts = batch.column("fold").to_numpy(), batch.column("text").to_pylist()
            own = np.zeros((len(texts), len(FEATURES)))
            for f in set(fold.tolist()):
                at = np.flatnonzero(fold == f)
                own[at] = features([texts[i] for i in at], by_fold[f])
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.float64()), batch.column("fold"), pa.array(own.tolist(), pa.list_(pa.float64()))], names=["label", "fold", "x"])

    ready = table(sample.mapInArrow(run, "label double, fold int, x array<double>")).select("label", "fold", array_to_vector("x").alias("features"))
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, maxBins=64, seed=1).fit(ready.where(F.col("fold") != FOLDS - 1))
    held = trees.transform(ready.where(F.col("fold") == FOLDS - 1)) if totals.get(FOLDS - 1, (0, 0))[0] else trees.transform(ready)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held.select("label", vector_to_array("probability")[1].alias("raw")))
    return ToxicityModel(_lexicon(counts, totals, None), trees, calibration, marked / n)


def learnable(docs_id: Column) -> Column:
    """The rows that labels may be learnt from: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(F.crc32(docs_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted, learnt from those labelled rows that are not held out."""
    model = fit(docs, labels.where(learnable(F.col("doc_id"))))
    scored = model.score(docs)
    return scored.withColumn("held_out", ~learnable(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
