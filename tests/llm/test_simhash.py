import itertools
import random
import re

import numpy as np
import xxhash
from helpers import documents, rows_of, sentence

from corpusloom.llm import simhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min([x for x in m if x is not None], default=None) for g, m in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


LONG = sentence(1, 400)
TEXTS = [(9, None), (8, ""), (7, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (None, "one two"), (6, "one two three four"), (20, LONG), (19, LONG.upper()), (18, LONG.replace("alpha", "other", 1)), (18, LONG), (30, sentence(2, 50)), (30, sentence(4, 60)), (None, "lonely null id here")]


def test_rows_against_brute_force(spark):
    found = rows_of(simhash.grouped(documents(spark, TEXTS)).select("doc_id", "fp", "component_id"))
    fps = [brute_fingerprint(t) for _, t in TEXTS]
    comps = brute_components([i for i, _ in TEXTS], fps)
    assert found == sorted(((i, signed(f), c) for (i, _), f, c in zip(TEXTS, fps, comps, strict=True)), key=repr)


def planted(seed, n):
    """Fingerprints in chains and dense clusters, and far from one another."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(n):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                base ^= 1 << rng.randrange(64)
            out.add(base)
    centre = rng.getrandbits(64)
    for a, b in itertools.combinations(range(12), 2):  # a cluster whose halves meet in dense buckets
        out.add(centre ^ (1 << a) ^ (1 << b))
        out.add(centre ^ (1 << (a + 32)) ^ (1 << (b + 40)))
    return sorted(out)


def test_links_lose_none_and_repeat_none(spark):
    fps = planted(5, 120)
    wanted = sorted(tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for dense in (64, 3):
        assert sorted(tuple(r) for r in simhash.links(df, dense=dense).collect()) == wanted


def test_one_key_with_very_many(spark):
    """100,000 fingerprints with one low half, and half of them close together: narrowed, not joined with each other."""
    rng = np.random.default_rng(3)
    high = np.unique(np.concatenate([rng.integers(0, 1 << 32, 60_000, np.uint64), (np.uint64(0xABC) << np.uint64(20)) | rng.integers(0, 1 << 20, 40_000, np.uint64)]))
    wanted = 0
    for i, j in [(i, i) for i in range(32)] + list(itertools.combinations(range(32), 2)):
        wanted += int(np.isin(high ^ np.uint64((1 << i) | (1 << j)), high, assume_unique=True).sum())
    df = spark.createDataFrame([(signed((int(h) << 32) | 12345),) for h in high], "fp long")
    assert simhash.links(df).count() == wanted // 2 > 1000


def test_narrowing_leaves_few_bits():
    for level in range(simhash.LEVELS):
        for parts in simhash.narrowing(level):
            free = [m ^ p for m, p in itertools.combinations(parts, 2)]
            assert parts[0] | parts[1] | parts[2] == 0xFFFFFFFF and all(free)
    assert max(32 - m.bit_count() for parts in simhash.narrowing(simhash.LEVELS - 1) for m in parts) <= 10


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}


def test_dedup_keeps_one_of_each_group(spark):
    docs = documents(spark, TEXTS)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    fps = [brute_fingerprint(t) for _, t in TEXTS]
    parts = {}
    order = brute_components(list(range(len(TEXTS))), fps)
    for k, root in enumerate(order):
        parts.setdefault(root, []).append(k)
    rows = kept.collect()
    where = {(i, t): order[k] for k, (i, t) in enumerate(TEXTS)}
    assert sorted(where[r.doc_id, r.text] for r in rows) == sorted(parts)
    for r in rows:
        members = [TEXTS[k][0] for k in parts[where[r.doc_id, r.text]]]
        assert r.doc_id == min([x for x in members if x is not None], default=None)


def test_empty_table(spark):
    empty = documents(spark, TEXTS).limit(0)
    assert simhash.grouped(empty).count() == 0
    assert simhash.dedup(empty).count() == 0
