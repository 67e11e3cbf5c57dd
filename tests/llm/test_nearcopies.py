import random

import corpus_pipeline
import numpy as np
import xxhash
from helpers import documents

from corpusloom.llm import nearcopies


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts):
    """The first index of each text's component under similarity of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def family(rng, n, copies, share):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    return [" ".join(words), *(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words) for _ in range(copies))]


def test_near_copies_in_the_pipeline_stage(spark, sf_dir):
    """One replaced word in 60 to 400, and 1 % of the words: most of these differ in over 2 of 64 bits."""
    rng = random.Random(3)
    texts = []
    for i in range(60):
        original = family(rng, 60 + 6 * i, 0, 0)[0].split()
        one = list(original)
        one[len(one) // 2] = "changed"
        texts += [" ".join(original), " ".join(one), " ".join(w if k % 100 != 50 else "other" for k, w in enumerate(original))]
    rows = corpus_pipeline.STAGES[2][1](spark, documents(spark, list(enumerate(texts))), sf_dir).collect()
    assert {r.doc_id for r in rows} == {i for i, r in enumerate(brute(texts)) if r == i} == set(range(0, 180, 3))


def test_components_equal_all_pairs(spark):
    """Families around the threshold, in light and in dense buckets; sizes of which sketches say much and little."""
    rng = random.Random(5)
    texts = [t for n in range(30) for t in family(rng, 40 + 20 * n, 4, 0.02)] + family(rng, 200, 60, 0.025) + family(rng, 6000, 6, 0.02) + ["a b", "a b", "a b c", "", None]
    wanted = brute([t or "" for t in texts])
    docs = documents(spark, list(enumerate(texts)))
    found = {r.doc_id: r.component_id for r in nearcopies.grouped(docs).collect()}
    assert [found[i] for i in range(len(texts))] == wanted
    assert 40 < len(set(wanted)) < 120


def test_sketches_never_reject_a_pair_at_the_threshold():
    rng = random.Random(6)
    sign, whole = nearcopies.signer(False), nearcopies.signer(True)
    seen = 0
    for n in (3, 30, 300, 3000):
        for share in (0.0, 0.01, 0.02, 0.03):
            a, b = family(rng, n, 1, share)
            x, y = set(whole(a)["shingles"].tolist()), set(whole(b)["shingles"].tolist())
            differ = sum(((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(sign(a)["sketch"], sign(b)["sketch"], strict=True))
            assert differ <= len(x ^ y) and sign(a)["size"] == len(x)
            seen += 5 * len(x & y) >= 4 * len(x | y)
            assert 9 * differ <= len(x) + len(y) or 5 * len(x & y) < 4 * len(x | y)
    assert seen > 5


def test_repeats_ties_and_an_empty_table(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, " ")])
    found = sorted((str(r.doc_id), r.component_id) for r in nearcopies.grouped(docs).collect())
    assert found == [("1", 1), ("1", 1), ("2", 2), ("3", 2), ("None", 1)]
    assert nearcopies.dedup(docs).count() == 2 and nearcopies.dedup(docs.limit(0)).count() == 0


def test_keys_are_deletion_variants_of_simhash_bits():
    """Every bit by a weighted vote of all shingles, in whole numbers; every key is a fingerprint without one segment."""
    text = " ".join(f"w{k * k % 97}" for k in range(60))
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in shingles(text)]
    mask, wanted, keys = (1 << 64) - 1, [], []
    for n, own in enumerate(np.random.default_rng(nearcopies.SEED).integers(0, 1 << 64, 5 * nearcopies.PRINTS, np.uint64).tolist()):
        votes, total = [0] * 12, 0
        for h in hashes:
            x = (h + own) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            weight = 2**48 // ((x >> 44) + 1) ** 2
            total += weight
            votes = [v + weight * (x >> b & 1) for b, v in enumerate(votes)]
        wanted.append("".join("01"[2 * v > total] for v in votes))
    for n in range(0, len(wanted), 5):
        for left_out in range(5):
            rest = [w for s, w in enumerate(wanted[n : n + 5]) if s != left_out]
            keys.append(int("".join(rest)[::-1], 2) + ((n + left_out) << 48))
    signed = nearcopies.signer(False)(text)
    assert [format(p, "060b")[::-1] for p in signed["prints"].tolist()] == ["".join(wanted[n : n + 5]) for n in range(0, len(wanted), 5)]
    assert signed["keys"].tolist() == keys


def test_fingerprints_find_pairs_at_the_threshold():
    """Sets at 0.8, the worst case: nearly all pairs meet, none is rejected by its distance; unlike sets do neither."""
    rng, votes, met, pairs = np.random.default_rng(7), nearcopies.voter(), 0, 0
    for n in (5, 10, 50, 500):  # n shingles together, four fifths of them in both sets
        for _ in range(150):
            hashes = rng.integers(0, 1 << 64, n, np.uint64)
            a, b, c = (votes(x) for x in (hashes[: n - n // 10], hashes[max(1, n // 10) :], rng.integers(0, 1 << 64, n, np.uint64)))
            met += bool(set(nearcopies.variants(a)) & set(nearcopies.variants(b)))
            pairs += 1
            far = [sum(int(x).bit_count() for x in (a ^ y).ravel()) for y in (b, c)]
            assert far[0] <= nearcopies.MOST_BITS < far[1]
            assert not set(nearcopies.variants(a)) & set(nearcopies.variants(c))
    assert met >= 0.99 * pairs
