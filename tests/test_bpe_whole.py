"""Merges are learned from all pieces, in flat arrays."""

import inspect
import random
from collections import Counter

from corpusloom.functions import bpe


def by_hand(counted, merges):
    """Each time all pairs are counted anew."""
    words, out = {p: list(p) for p in counted}, []
    while len(out) < merges:
        totals = Counter()
        for p, w in words.items():
            for pair in zip(w, w[1:], strict=False):
                totals[pair] += counted[p]
        if not totals:
            break
        best = min(totals, key=lambda x: (-totals[x], x))
        words = {p: bpe.merged(w, best, 256 + len(out)) for p, w in words.items()}
        out.append(best)
    return out


def test_merges_against_counting_anew():
    rng = random.Random(1)
    for t in range(60):
        letters = b"aab" if t % 2 else b"abcdef"
        counted = {bytes(rng.choice(letters) for _ in range(rng.randrange(1, 14))): rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))}
        assert bpe.learned_merges(counted, 30) == by_hand(counted, 30)


def test_no_cap_and_nothing_on_the_driver(spark):
    """Rare pieces count: here only they have the pair of most weight. Pieces stay with the executors."""
    rows = [(i, f" {w}zq") for i, w in enumerate("bcdefghijk")] + [(100 + i, " a") for i in range(3)]
    model = bpe.train(spark.createDataFrame(rows, "doc_id long, text string"), 256 + 1 + len(bpe.SPECIALS))
    assert model.merges == [(ord("z"), ord("q"))]
    assert "most_pieces" not in inspect.signature(bpe.train).parameters and "toLocalIterator" not in inspect.getsource(bpe.train)
