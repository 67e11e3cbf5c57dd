"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash.

The scheme is that of ``simhash``: SimHash fingerprints are cut into segments and indexed under their one-wildcard
variants (one segment left out), equal variants meet in an equality join, what meets is verified by the distance of the
fingerprints and then exactly, and links go through star contractions.

A text has ``PRINTS`` fingerprints of 60 bits, each of five segments of 12 bits. A bit is 1 if shingles of over half the
weight vote for it, as Charikar's SimHash has it. A shingle's weight differs from segment to segment: 1 / u**2 for a
uniform hash u of it. With equal weights two bits agree with probability 0.85 at a similarity of 0.8, whatever the
other bits do, and 48 equal ones are hopeless (0.0004); with these few shingles outweigh the rest, so that the bits of a
segment mostly agree or differ together. At 0.8 two segments were seen to be equal with probability 0.70 (0.67 in sets
of five shingles), so a fingerprint's variants meet with 0.53 (0.47), and ten fingerprints, 50 variants a document, find
a pair at exactly 0.8 with 1 - 0.47**10 = 0.9995 (0.998), a closer one with more. Unlike sets meet by chance with 2**-48
a variant. Weights are whole numbers and their sums exact (up to some ten million shingles), so a
set has the same bits on any machine.

Verification has three steps. At 0.8 a bit differs with probability 0.11; pairs of more than ``MOST_BITS`` of the 600
bits, two fifths (unlike sets: half), are rejected inside the join. So are pairs by a sketch of 1024 bits that holds,
for each remainder of the shingles' hashes, the parity of their count. Every shingle that only one of two sets has flips
one bit, so sketches of sets at 0.8 or above differ in at most a ninth of the sets' sizes together, and no pair at the
threshold is lost by that. What is left is compared by whole sets. The two probabilities above are the only bound.

Only distinct sets are compared, so copies cost nothing. First the members of each bucket are compared with the one
that shares the most keys with others, which in a family of copies is the original or near it; after that, members of
components other than the bucket's largest with all of the bucket, in one more equality join, whose hot keys adaptive
execution splits. Nothing is collected.

Defined results: words are runs of non-space bytes in lower case (ASCII); a text of up to five words is one
shingle; null and empty texts and those without words are copies of each other. A component's id is the smallest
id in it, as in ``simhash``.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import simhash
from corpusloom.llm.common import checkpointed, row_udf

SHINGLE, SEED = 5, 42
#: Fingerprints of a text, segments of one and bits of a segment.
PRINTS, SEGMENTS, BITS = 10, 5, 12
#: Differing bits of all fingerprints beyond which a pair isn't compared.
MOST_BITS = 2 * PRINTS * SEGMENTS * BITS // 5
#: 64-bit words of a sketch.
SKETCH = 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LONGS = T.ArrayType(T.LongType())
_SIGNED = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", _LONGS), T.StructField("prints", _LONGS), T.StructField("sketch", _LONGS)])
_WHOLE = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", _LONGS)])


def voter(prints: int = PRINTS, seed: int = SEED):
    """Makes the function of a set's hashes that gives its fingerprints' segments as numbers, a row each."""
    own = np.random.default_rng(seed).integers(0, 1 << 64, (prints * SEGMENTS, 1), np.uint64)

    def segments(hashes: np.ndarray) -> np.ndarray:
        votes, total = np.zeros((len(own), 16)), np.zeros((len(own), 1))
        for at in range(0, len(hashes), 1024):  # bounded memory for very long texts
            x = hashes[at : at + 1024] + own
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            u = (x >> np.uint64(44)).astype(float) + 1  # of 2**20
            weight = np.floor(2.0**48 / (u * u))
            bits = np.unpackbits(x.astype("<u2").view(np.uint8).reshape(len(own), -1, 2), axis=2, bitorder="little")
            votes += np.matmul(weight[:, None, :], bits.astype(float))[:, 0]
            total += weight.sum(axis=1, keepdims=True)
        return ((2 * votes > total)[:, :BITS] @ (1 << np.arange(BITS))).reshape(prints, SEGMENTS)

    return segments


def variants(segments: np.ndarray) -> np.ndarray:
    """The index keys: for each fingerprint and each of its segments, which these are, and the other segments."""
    places = 1 << BITS * np.arange(SEGMENTS)
    rest = np.stack([np.delete(segments, s, axis=1) @ places[:-1] for s in range(SEGMENTS)], axis=1).ravel()
    return rest + (np.arange(rest.size) << BITS * (SEGMENTS - 1))


def signer(whole: bool, shingle: int = SHINGLE, prints: int = PRINTS, seed: int = SEED):
    """Makes the function of a text that gives its set's hash and either size, keys, fingerprints and sketch, or the ``whole`` set."""
    from xxhash import xxh64_intdigest

    segments_of = voter(prints, seed)

    def signed(text: str | None) -> dict:
        words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        if not words:
            return {"node": 0, "size": 0, "keys": [], "prints": [0] * prints, "sketch": [0] * SKETCH, "shingles": []}
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes = [xxh64_intdigest(line, seed)]
        else:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            starts = [0, *(spaces[: len(words) - shingle] + 1).tolist()]
            ends = [*spaces[shingle - 1 :].tolist(), len(line)]
            hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)]
        own = np.unique(np.array(hashes, np.uint64))
        node = int(np.uint64(xxh64_intdigest(own.astype("<u8").tobytes(), seed)).view(np.int64))
        if whole:
            return {"node": node, "shingles": own.view(np.int64)}
        segments = segments_of(own)
        parity = np.bincount((own & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
        return {"node": node, "size": len(own), "keys": variants(segments), "prints": segments @ (1 << BITS * np.arange(SEGMENTS)), "sketch": np.packbits(parity.astype(bool), bitorder="little").view("<i8")}

    return signed


def signature(text: Column, whole: bool = False) -> Column:
    """node, size, keys, prints and sketch, or node and shingles."""
    names = (_WHOLE if whole else _SIGNED).names

    def make():
        signed = signer(whole)
        return lambda text: {k: v for k, v in signed(text).items() if k in names}

    return row_udf(make, _WHOLE if whole else _SIGNED)(text)


def _differ(name: str, words: int) -> Column:
    return sum((F.bit_count(F.col(f"u_{name}")[i].bitwiseXOR(F.col(f"v_{name}")[i])) for i in range(words)), F.lit(0))


def _close() -> Column:
    """Whether sets u and v may have a similarity of 0.8 or more, by their sizes, fingerprints and sketches."""
    a, b = F.col("u_size"), F.col("v_size")
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (_differ("prints", PRINTS) <= MOST_BITS) & (9 * _differ("sketch", SKETCH) <= a + b)


def _side(rows: DataFrame, side: str, *names: str) -> DataFrame:
    return rows.select(*[F.col(n) if n == "key" else F.col(n).alias(side if n == "fp" else f"{side}_{n}") for n in names])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose sets have a similarity of 0.8 or more, with all their columns."""
    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("fp").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    a, b = F.size("u_set"), F.size("v_set")
    return pairs.where(9 * F.size(F.array_intersect("u_set", "v_set")) >= 4 * (a + b)).drop("u_set", "v_set")


def _crossing(met: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """u, v: pairs of different roots that meet under a key and may be similar, each once.

    Members of the root that most of a key's members have don't meet each other; keys with one root aren't joined.
    """
    rows = met.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    each = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    keys = each.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main")).where("roots > 1").select("key", "main")
    left = rows.join(checkpointed(keys), "key")
    wide = checkpointed(left.join(members.select("fp", "size", "prints", "sketch"), "fp"))
    a = _side(wide.where("root <> main"), "u", "key", "fp", "root", "main", "size", "prints", "sketch")
    b = _side(wide, "v", "key", "fp", "root", "size", "prints", "sketch")
    meet = (a["key"] == b["key"]) & (F.col("u_root") != F.col("v_root")) & ((F.col("v_root") == F.col("u_main")) | (F.col("u") < F.col("v"))) & _close()
    return a.join(b, meet).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (its set's hash), component_id and component (its smallest hash) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = rows.select("doc_id", signature(F.col("text")).alias("s"))
    marked = checkpointed(signed.select("doc_id", F.col("s.node").alias("fp"), F.col("s.size").alias("size"), F.col("s.keys").alias("keys"), F.col("s.prints").alias("prints"), F.col("s.sketch").alias("sketch")))
    keyed = marked.select("fp", F.explode("keys").alias("key")).distinct()
    met = checkpointed(keyed.join(checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")), "key"))
    scores = met.groupBy("fp").agg(F.sum("n").alias("score"))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("prints").alias("prints"), F.first("sketch").alias("sketch"))  # copies are summed up before they are dealt out
    members = checkpointed(distinct.join(scores, "fp"))

    centres = checkpointed(met.join(members.select("fp", "score"), "fp").groupBy("key").agg(F.max(F.struct("score", "fp"))["fp"].alias("centre")))
    star = met.join(centres, "key").where("fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v")).distinct()
    star = star.join(_side(members, "u", "fp", "size", "prints", "sketch"), "u")
    beside = _side(members, "v", "fp", "size", "prints", "sketch", "score")
    sets = _sets(rows, members)
    linked = checkpointed(similar(star.join(beside, (star["v"] == beside["v"]) & _close()).select("u", beside["v"], "v_score"), sets))

    # until all links are known, a member counts as one with its best centre, and with that centre's own
    best = linked.groupBy(F.col("u").alias("fp")).agg(F.max(F.struct("v_score", "v"))["v"].alias("root"))
    higher = best.join(members.select("fp", F.col("score").alias("own")), "fp").join(members.select(F.col("fp").alias("root"), "score"), "root").where("score > own or (score = own and root > fp)").select("fp", "root")
    higher = checkpointed(higher)
    roots = higher.join(higher.select(F.col("fp").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))
    links = linked.select("u", "v").unionByName(similar(_crossing(met, roots, members), sets))
    found = checkpointed(simhash.components(links)).select(F.col("node").alias("fp"), "root")

    rooted = marked.select("doc_id", "fp").join(found, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    named = checkpointed(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rooted.join(named, "root").select("doc_id", "fp", "component_id", F.col("root").alias("component"))


def _sets(rows: DataFrame, members: DataFrame) -> DataFrame:
    """fp and shingles of the members, from the rows of their smallest ids."""
    again = rows.join(members.select(F.col("least").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(signature(F.col("text"), True).alias("s"))
    again = again.select(F.col("s.node").alias("fp"), F.col("s.shingles").alias("shingles")).join(members.select("fp"), "fp", "left_semi")
    return checkpointed(again.groupBy("fp").agg(F.first("shingles").alias("shingles")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id; of a component of null ids, one row."""
    return simhash.dedup(docs, doc_id, text, grouped, lambda text: signature(text)["node"])
