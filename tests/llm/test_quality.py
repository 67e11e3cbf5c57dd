import itertools
import re
from collections import Counter

import numpy as np
from helpers import documents, sentence

from corpusloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a a a a", "a b c a b c", "one\ntwo\none\n\n\none ", "x y #*$%&|<> é z", "\x1c a \x1c", sentence(1, 60), "\n".join([sentence(2, 30)] * 4), "w " * 5000]


def test_base_counts():
    for t in TEXTS:
        assert quality.base_counts(t) == brute(t), t


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        field = quality.Field(rng.normal(size=(quality.OFFSETS[-1], 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        lines = [[int(rng.integers(a, b)) for a, b in itertools.pairwise(quality.OFFSETS)] for _ in range(6)]

        def value(labels, lines=lines, field=field):
            return field.first[labels[0]] + sum(field.weights[f][y] for fs, y in zip(lines, labels, strict=True) for f in fs) + sum(field.steps[a][b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(field.decoder()(lines)) == best
    assert quality.Field().decoder()([]) == []


def test_rows(spark):
    good = [(i, "\n".join(sentence(i + k, 30).capitalize() + "." for k in range(4))) for i in range(60)]
    poor = [(100 + i, "\n".join("| ".join(["HOME", "MENU!!", "%%%", str(i + k)] * 6) for k in range(12))) for i in range(60)]
    odd = [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs = documents(spark, good + poor + odd + good[:1])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in poor] + [(1000, None), (None, 1)], "doc_id long, quality int")
    field = quality.trained(docs, labels)
    out = docs.select("doc_id", "text", quality.quality(field, docs.text).alias("q")).collect()
    assert len(out) == len(good) + len(poor) + len(odd) + 1
    for r in out:
        n_words, chars, symbols, dup, repeat = brute(r.text)
        assert tuple(r.q)[:5] == (n_words, chars, symbols, dup, repeat)
        assert r.q.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert not (r.q.kept and r.q.base_failed)
        if r.doc_id < 100:
            assert r.q.kept
        elif r.doc_id < 1000:
            assert not r.q.kept and set(r.q.labels) == {"b"}


def test_without_labels(spark):
    docs = documents(spark, [(1, sentence(1, 80)), (2, None)])
    field = quality.trained(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r[0].kept for r in docs.select(quality.quality(field, docs.text)).collect()] == [True, False]
    assert docs.limit(0).select(quality.quality(field, docs.text)).count() == 0


def test_share_tells_the_kinds_apart():
    field = quality.Field()
    field.weights[:, 1] = 0.0
    lines = quality.document_features("a fine line of words\nanother one")[0]
    assert quality.chosen_share(field, []) == quality.chosen_share(field, [(1, lines, [5, 2])]) == quality.CONTENT_SHARE
    assert quality.chosen_share(field, [(1, lines, [5, 2]), (0, lines, [5, 2])]) == quality.SHARES[0]  # nothing tells them apart


def test_ids_with_both_labels_are_not_learned_from(spark):
    from corpusloom.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    found = sorted((r.k, r.y) for r in labelled_sample(docs, labels, "doc_id", "text", "quality", 5).collect())
    assert found == [(1, 1), (2, 0)]
