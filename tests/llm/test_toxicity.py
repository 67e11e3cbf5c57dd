import math
import random

from helpers import documents, sentence

from corpusloom.llm import toxicity


def test_folding():
    assert toxicity.fold(None) == " "
    assert toxicity.fold("1D10T, Ιdіοt!") == toxicity.fold("idiot idiot")
    assert toxicity.fold("ｓｃｕｍ sc​um") == toxicity.fold("scum scum")
    assert toxicity.fold("$tupid !diot, (m@ron) cl0wn$$$ 100") == toxicity.fold("stupid idiot maron clown 100")
    assert toxicity.fold("l0s3r") == toxicity.fold("LOSER")


def test_exception_phrases_and_length():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {"idiot proof"}, 0.5, 4.0, -2.0)
    match = lexicon.matcher()
    assert match("an idiot")[1] > match("an idiot " + "word " * 200)[1] > match("idiot proof")[1]
    assert match("idiot proof")[0] == [] and match("the idiotic")[0] == [("idiotic", 5.0)]


def test_learns_and_spares_clean(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        text = sentence(i, 40) + (" zorgish creature zorgan" if bad else " the harmless zorgful tale" if i % 8 == 1 else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "z0rgish zorgan creature"), (1003, "harmless zorgful tale " + sentence(9, 30)), (0, rows[0][1])]
    labels += [(1000, None), (None, 1), (5000, 1)]
    docs = documents(spark, rows)
    lexicon = toxicity.learned_from(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = docs.select("doc_id", toxicity.toxicity(lexicon, docs.text).alias("t")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.t.score <= 1
        toxic = r.doc_id == 1002 or (r.doc_id < 400 and r.doc_id % 8 == 0)
        assert (r.t.score >= 0.5) == toxic, r


def test_no_labels(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learned_from(docs, labels)
    assert [r[0].score < 0.5 for r in docs.select(toxicity.toxicity(lexicon, docs.text)).collect()] == [True, True]
    assert docs.limit(0).select(toxicity.toxicity(lexicon, docs.text)).count() == 0


def test_held_out_accuracy(spark):
    from corpusloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_toxicity"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right >= 0.95 * len(rows) > 0


def test_matcher_against_every_word_and_term():
    """Overlapping terms, ties between them, exceptions, repeats, digits for letters and a very long text."""
    rng = random.Random(4)
    terms = {"".join(rng.choice("abi") for _ in range(rng.randrange(4, 8))): float(rng.randrange(1, 4)) for _ in range(60)}
    words = ["".join(rng.choice("abi1") for _ in range(rng.randrange(1, 10))) for _ in range(200)]
    exceptions = {f"{toxicity.fold(rng.choice(words)).strip()} {toxicity.fold(rng.choice(words)).strip()}" for _ in range(800)}
    lexicon = toxicity.Lexicon(terms, exceptions, 0.5, 1.0, -1.0)
    match = lexicon.matcher()
    for n in (0, 1, 3, 40, 30000):
        text = " ".join(rng.choice(words) for _ in range(n))
        own = toxicity.fold(text).split()
        wanted = []
        for i, w in enumerate(own):
            best = max((terms[t] for t in terms if w.startswith(t)), default=None)
            beside = {f"{a} {b}" for a, b in (own[max(0, i - 1) : i + 1] if i else ["", w], [*own[i : i + 2], ""][:2])}
            if best is not None and not beside & exceptions:
                wanted.append((w, best))
        hits, score = match(text)
        assert sorted(hits) == sorted(wanted)
        mass = sum(w for _, w in set(wanted))
        assert abs(score - 1 / (1 + math.exp(1 - (mass / max(1, len(own)) ** 0.5 if wanted else 0.0)))) < 1e-12
