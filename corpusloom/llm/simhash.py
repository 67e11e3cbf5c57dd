"""SimHash near-duplicates: 64-bit fingerprints linked at ``MOST_BITS`` differing bits through deletion variants.

Two fingerprints that differ in at most 2 of 64 bits differ in at most 1 bit in one of their two halves.
Each half is indexed under its 32 one-wildcard variants (one bit left out), so halves at distance 0 or 1 meet
in an equality join. Every meeting is verified by the full distance and reported once. A bucket of over
``DENSE`` fingerprints isn't joined on its own key: its other half, which differs in at most 2 bits, is cut
in three, of which one part is equal, and the part joins the key. What is still dense is narrowed again, ``LEVELS``
times in all: the other half's equal bits then leave 10, so a key has at most 2^11 distinct fingerprints, whatever the
corpus; nothing is lost.

Only distinct fingerprints are indexed, so copies cost nothing; links go through alternating star
contractions, each written to the shared folder, until components stand. Nothing is collected.

Defined results: a null or empty text or one without words has fingerprint zero, linked like any other. The
component's id is the smallest id in it; null ids are ignored for that, and a component of null ids alone has
a null id. Repeated rows give repeated rows; other columns play no part; an empty table gives no row.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, free_name, row_udf

SHINGLE, SEED, MOST_BITS, DENSE, LEVELS = 3, 42, 2, 64, 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprinter(shingle: int = SHINGLE, seed: int = SEED):
    """Makes the function of a text that gives its fingerprint as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    def fingerprint(text: str | None) -> int:
        words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        if not words:
            return 0
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes = [xxh64_intdigest(line, seed)]
        else:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            starts = [0, *(spaces[: len(words) - shingle] + 1).tolist()]
            ends = [*spaces[shingle - 1 :].tolist(), len(line)]
            hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)]
        set_in = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
            part = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
            set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
        return int(bits.view("<i8")[0])

    return fingerprint


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    return row_udf(lambda: fingerprinter(shingle, seed), T.LongType())(text)


def _half(fp: str, s: Column) -> Column:
    return F.when(s == 0, F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def links(distinct: DataFrame, fp: str = "fp", dense: int = DENSE) -> DataFrame:
    """Pairs u < v of the distinct fingerprints that differ in 1 or 2 bits, each once."""
    slots = distinct.select(F.col(fp).alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    side = F.shiftright("slot", 5)
    bit = F.expr("shiftleft(1L, slot & 31)")
    half = _half("fp", side)
    keyed = slots.select("fp", (F.shiftleft(F.col("slot").cast("long"), 32) + half.bitwiseAND(F.bitwise_not(bit))).alias("key"))
    same = F.lit(0).cast("long")
    met = _counted(keyed.select("key", F.lit(0).alias("path"), same.alias("same"), "fp"))
    found = _meeting(met.where(F.col("n") <= dense))
    for level in range(LEVELS):
        masks = F.array(*[F.array(*map(F.lit, parts)) for parts in narrowing(level)])
        own = F.get(masks, F.col("path"))
        wider = F.explode(F.transform(own, lambda m, j: F.struct((F.col("path") * 3 + j).alias("path"), m.alias("mask"))))
        rows = met.where(F.col("n") > dense).select("key", "fp", wider.alias("w"))
        met = _counted(rows.select("key", "w.path", _half("fp", F.lit(1) - F.shiftright("key", 37)).bitwiseAND(F.col("w.mask")).alias("same"), "fp"))
        last = level == LEVELS - 1
        found = found.unionByName(_meeting(met if last else met.where(F.col("n") <= dense)))
    return found.distinct()


def narrowing(level: int) -> list[list[int]]:
    """For each path of so many choices, the masks of the other half's bits that are equal after one more choice."""
    masks = [0]
    for _ in range(level + 1):
        parts = []
        for mask in masks:
            free = [b for b in range(32) if not mask >> b & 1]
            cuts = [-(-len(free) * k // 3) for k in range(4)]
            parts.append([mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
        masks = [m for p in parts for m in p]
    return parts


def _counted(rows: DataFrame) -> DataFrame:
    """The rows of buckets (key, path, same) that hold several, with their number n."""
    return checkpointed(rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "path", "same"))).where("n > 1"))


def _meeting(rows: DataFrame) -> DataFrame:
    """u < v of a bucket that differ in at most ``MOST_BITS`` bits, under one of the keys that they share."""
    on = ["key", "path", "same"]
    a, b = (rows.select(*on, F.col("fp").alias(x)) for x in ("u", "v"))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    slot = F.shiftright("key", 32)
    own = F.when(F.shiftright(slot, 5) == 0, differ.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(differ, 32))
    # counted where the half's own differing bit is the wildcard, or under bit 0 if the half is equal
    first_slot = F.when(own == 0, F.lit(0)).otherwise(F.bit_count(own - 1))
    in_low = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1  # then the pair is the low half's
    report = (slot.bitwiseAND(F.lit(31)) == first_slot) & ((F.shiftright(slot, 5) == 0) | ~in_low)
    return a.join(b, on).where((F.col("u") < F.col("v")) & (F.bit_count(differ) <= MOST_BITS) & report).select("u", "v")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links u, v: node and root, the smallest node reachable, for every node with a link.

    Alternating large-star and small-star contractions. Each round is checkpointed.
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v"))
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the sums are written, so that a hub's rows can be split when they are joined
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        down = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())  # v > u >= m
        least = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components don't stand yet")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id and component (its smallest fingerprint) of every row."""
    marked = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    each = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(each.select("fp")))
    rooted = each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(ids, "root").select("fp", "component_id", F.col("root").alias("component"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "component")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grouping=grouped, mark=fingerprint) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id; of a component of null ids, one row.

    ``grouping`` gives what ``grouped`` does, ``mark`` the fp that it gives a text.
    """
    found = checkpointed(grouping(docs, doc_id, text))
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "id")
    kept = found.where("doc_id <=> component_id").groupBy("doc_id", "component").agg(F.min("fp").alias("fp"))
    keep_id, keep_fp, turn = (free_name(docs, x) for x in ("keep_id", "keep_fp", "turn"))
    kept = checkpointed(kept.join(rows, F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("doc_id").alias(keep_id), F.col("fp").alias(keep_fp), "n"))
    own_id = F.col(doc_id).eqNullSafe(F.col(keep_id))
    once = docs.join(kept.where("n = 1").select(keep_id), own_id, "left_semi")
    several = kept.where("n > 1").drop("n")
    if several.isEmpty():
        return once
    # where an id repeats, the fingerprint says which of its rows stays
    own_fp = free_name(docs, "own_fp")
    again = docs.withColumn(own_fp, mark(F.col(text))).join(several, own_id & (F.col(own_fp) == F.col(keep_fp)))
    first = F.row_number().over(Window.partitionBy(keep_id, keep_fp).orderBy(F.xxhash64(text), text))
    return once.unionByName(again.withColumn(turn, first).where(F.col(turn) == 1).select(docs.columns))
