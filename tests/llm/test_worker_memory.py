"""What a Python worker holds while it hashes texts and remembers words; the workers are reused, so all stages of the pipeline pay for it."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from lumenfold.llm import hashing, toxicity
from lumenfold.llm.word_ids import WordIds


def _peak(f) -> float:
    """MB that f holds at most."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _texts() -> list:
    draw = random.Random(3)
    return ["", None, *[" ".join("word%d" % draw.randrange(5000) for _ in range(300)) for _ in range(800)]]


def test_features_hold_little():
    texts, lexicon = _texts(), toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    assert sum(len(t or "") for t in texts) > 2 << 20  # more than a batch of 1 MB
    hashing._powers.clear()
    assert _peak(lambda: toxicity.features(texts, lexicon)) < 60


def test_batches_change_no_result(monkeypatch):
    texts, lexicon = _texts(), toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    small = toxicity.features(texts, lexicon), [(i, s.tolist()) for i, s in hashing.shingle_sets(texts, 5)]
    monkeypatch.setattr(hashing, "BATCH_BYTES", 1 << 20)
    monkeypatch.setattr(hashing.batches, "__defaults__", (1 << 20,))
    assert (small[0] == toxicity.features(texts, lexicon)).all()
    assert small[1] == [(i, s.tolist()) for i, s in hashing.shingle_sets(texts, 5)]


def _encoded(words: WordIds, numbers) -> list[int]:
    """The ids of a text of these numbers, each a unit."""
    units = [b" %d" % i for i in numbers]
    data = np.frombuffer(b"".join(units), np.uint8)
    ends = np.cumsum([len(u) for u in units])
    ids, bounds = words.encode(data, ends - [len(u) for u in units], np.zeros(len(units), bool), np.array([0, len(data)]))
    assert bounds.tolist() == [0, len(ids)]
    return ids.tolist()


def _digits() -> WordIds:
    """An id a byte."""
    return WordIds(lambda units: [list(u.encode()) for u in units], np.ones(256, np.int64), 300_000)


def test_words_are_put_in_their_places():
    words, draw = _digits(), random.Random(5)
    for _ in range(30):
        numbers = [draw.randrange(2000) for _ in range(200)]
        assert _encoded(words, numbers) == list(b"".join(b" %d" % i for i in numbers))
    assert (np.diff(words.keys.astype(object)) > 0).all()


def test_few_new_words_copy_no_memory_of_many():
    words = _digits()
    _encoded(words, range(200_000))
    assert _peak(lambda: _encoded(words, range(200_000, 200_100))) < 5
