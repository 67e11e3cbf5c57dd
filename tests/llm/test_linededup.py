import random
import re

from helpers import documents, sentence

from corpusloom.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """Texts after deletion: every repeated run of enough words that occurs earlier, found pair by pair."""
    keys = sorted({(i is not None, i or 0, linededup_hash(t), t) for i, t in rows if t is not None}, key=lambda k: k[:3])
    seqs = [[x for x in k[3].split("\n") if WORD.search(x)] for k in keys]
    n = [[len(WORD.findall(x)) for x in s] for s in seqs]
    starts = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    gone = set()
    for b in range(len(starts)):
        db, ib = starts[b]
        for a in range(b):
            da, ia = starts[a]
            w = words = 0
            while ia + w < len(seqs[da]) and ib + w < len(seqs[db]) and seqs[da][ia + w] == seqs[db][ib + w]:
                words += n[db][ib + w]
                w += 1
            if words >= least:
                gone.update((db, ib + k) for k in range(w))
    out = {}
    for d, k in enumerate(keys):
        left, at = [], -1
        for x in k[3].split("\n"):
            at += bool(WORD.search(x))
            if not (WORD.search(x) and (d, at) in gone):
                left.append(x)
        out[k[1] if k[0] else None, k[3]] = ("\n".join(left), sum(1 for g in gone if g[0] == d))
    return out


_HASH = {}


def linededup_hash(t):
    return _HASH[t]


def check(spark, rows, least):
    docs = documents(spark, rows)
    from pyspark.sql import functions as F

    _HASH.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    found = linededup.dedup_lines(docs.withColumn("orig", docs.text), least_words=least).collect()
    wanted = brute(rows, least)
    assert len(found) == len(rows)
    for r in found:
        if r.orig is None:
            assert r.text is None and r.deleted_lines == 0
        else:
            assert (r.text, r.deleted_lines) == wanted[r.doc_id, r.orig], r


PASSAGE = "\n".join(sentence(k, 12) for k in range(6))


def test_passages_and_awkward_rows(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "\n \n"),
        (4, "own line\n" + PASSAGE + "\nend"),
        (5, "other\n" + PASSAGE + "\nthe rest"),
        (5, "other\n" + PASSAGE + "\nthe rest"),
        (5, PASSAGE),
        (6, PASSAGE + "\n" + PASSAGE),
        (None, "null\n" + PASSAGE.replace("\n", "\n\n")),
        (7, "short\nshort\nshort"),
        (8, sentence(50, 60)),
        (9, sentence(50, 60) + "\n" + sentence(50, 60)),
        (10, "own line\nend"),
        (11, "\n".join(["w"] * 200)),
    ]
    check(spark, rows, 50)


def test_random_line_sequences(spark):
    rng = random.Random(3)
    lines = [sentence(k, 1 + k % 4) for k in range(6)] + [""]
    for least in (3, 5, 9):
        rows = [(rng.randrange(12), "\n".join(rng.choice(lines) for _ in range(rng.randrange(25)))) for _ in range(14)]
        check(spark, rows, least)


def test_empty_table(spark):
    assert linededup.dedup_lines(documents(spark, [(1, "x")]).limit(0)).count() == 0
