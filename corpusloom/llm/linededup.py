"""Line dedup: repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its lines that have a word; a line's id is its whole text. Ranks of single
lines are refined to ranks of line runs of 2, 4, 8 ... lines: the pairs (rank, rank 2^k lines on) that occur
twice or more are sorted over all machines and numbered in order. A suffix whose pair occurs once is settled
and leaves. Suffixes with a common prefix of w lines are neighbours in this order: they form the
longest-common-prefix interval of depth w, which the ranks of the run's first and last 2^k lines name
exactly (2^k <= w < 2^(k+1)). In every interval the first run in the order (id, text hash, line) is the
original and the others are later copies.

Only runs of ``least_words`` words count. It is enough to look at the shortest such runs from each first
line on and up to each last line, for they cover every longer repeated run line by line; they have at most
``least_words`` lines, so rounds are bounded whatever the corpus. Lines of later copies are deleted;
overlapping and touching copies thereby grow to the maximal repeated run. The first occurrence of a line is
never in a later copy, so no line's text is lost from the corpus.

Pairs are summed before they are shuffled and sorted as distinct pairs, so a line that a third of all rows
share is one key; joins back to the rows are equality joins that adaptive execution splits by size.

Defined results: null and empty texts have no lines and pass unchanged; rows that share id and text are one
document for the order, and lose the same lines; null ids come first; other columns pass through.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, free_name, row_udf

LEAST_WORDS = 50

_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per line with a word: d, th, n (its number among those), h1, h2, words."""
    worded = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(_WORD))
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("th"), F.posexplode(worded).alias("n", "line"))
    return rows.select("d", "th", "n", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), F.regexp_count("line", F.lit(_WORD + "+")).alias("words"))


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur twice or more, numbered in their order over all partitions."""
    again = pairs.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*keys)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(again.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id()))


def _by_document(rows: DataFrame, step, schema: str) -> DataFrame:
    """``step`` on each document's rows in line order: lists of line numbers and of the other columns' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, out, kind = [], None, [], None
        target = None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

        for batch in batches:
            if target is None:
                kind = batch.schema.field("d").type
                from pyspark.sql.pandas.types import to_arrow_schema

                target = to_arrow_schema(result)
                target = target.set(0, pa.field("d", kind))
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:2] != own:
                    if held:
                        out += [(*own, *x) for x in step(held)]
                    held, own = [], row[:2]
                if not held or held[-1][0] != row[2]:  # equal rows of one document count once
                    held.append(row[2:])
            if len(out) >= 20000:
                yield packed()
                out = []
        if held:
            out += [(*own, *x) for x in step(held)]
        if out:
            yield packed()

    result = T.StructType([rows.schema["d"], T.StructField("th", T.LongType()), *T._parse_datatype_string(schema).fields])
    return rows.repartition("d", "th").sortWithinPartitions("d", "th", "n").mapInArrow(run, result)


def shortest_runs(rows: list[tuple], least_words: int) -> list[tuple[int, int, list[int]]]:
    """(n, rank, widths) of each row (n, rank, words): widths of the shortest runs of enough words that start there.

    A run has consecutive n. There is the shortest run from each first line and up to each last line.
    """
    widths: list[set[int]] = [set() for _ in rows]
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end][0] == rows[end - 1][0] + 1:
            end += 1
        first, held = at, 0
        for last in range(at, end):  # two pointers: [first, last] is the shortest run up to last
            held += rows[last][2]
            while held - rows[first][2] >= least_words:
                held -= rows[first][2]
                first += 1
            if held >= least_words:
                widths[first].add(last - first + 1)
        last, held = end - 1, 0
        for first in range(end - 1, at - 1, -1):  # and the shortest run from first
            held += rows[first][2]
            while held - rows[last][2] >= least_words:
                held -= rows[last][2]
                last -= 1
            if held >= least_words:
                widths[first].add(last - first + 1)
        at = end
    return [(r[0], r[1], sorted(w)) for r, w in zip(rows, widths, strict=True)]


def doubled(rows: list[tuple], k: int) -> list[tuple]:
    """Of rows (n, rank of 2^k lines, widths): the intervals' names of widths below 2^(k+1), and the pairs for the next round.

    A name is (n, None, width, rank, rank at the run's end); a pair is (n, widths, None, rank, rank 2^k lines on).
    """
    rank = {r[0]: r[1] for r in rows}
    size, out, needed = 1 << k, [], set()
    for n, r, widths in rows:
        for w in widths or ():
            if w < 2 * size:
                if (b := rank.get(n + w - size)) is not None:
                    out.append((n, None, w, r, b))
            else:
                needed.update(range(n, n + w - 2 * size + 1))
    for n, r, widths in rows:
        if n in needed and (b := rank.get(n + size)) is not None:
            out.append((n, [w for w in widths or () if w >= 2 * size], None, r, b))
    return out


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs that are later copies: d (the id), th (xxhash64 of the text), n (first line) and w (lines), of lines with a word."""
    lines = checkpointed(_lines(docs, doc_id, text))
    ranks = _ranked(lines, ["h1", "h2"])
    rows = lines.join(ranks, ["h1", "h2"]).select("d", "th", "n", "r", "words")
    rows = _by_document(rows, lambda held: shortest_runs(held, least_words), "n int, r long, ws array<int>")
    runs, k = None, 0
    while True:
        level = checkpointed(_by_document(rows, lambda held, k=k: doubled(held, k), "n int, ws array<int>, w int, a long, b long"))
        named = level.where("w is not null").select("d", "th", "n", "w", "a", "b")
        runs = named if runs is None else runs.unionByName(named)
        pairs = level.where("w is null").select("d", "th", "n", "ws", "a", "b")
        if (2 << k) > least_words or pairs.isEmpty():  # no run has more lines than words
            break
        rows = pairs.join(_ranked(pairs, ["a", "b"]), ["a", "b"]).select("d", "th", "n", "r", "ws")
        k += 1
    place = F.struct("d", "th", "n")
    first = runs.groupBy("w", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    first = checkpointed(first)  # a join with the sums themselves would keep their partitions, and none of them could be split
    return runs.join(first, ["w", "a", "b"]).where(~place.eqNullSafe(F.col("first"))).select("d", "th", "n", "w")


def _without() -> Column:
    def make():
        import re

        worded = re.compile(_WORD).search

        def without(text: str | None, runs: list[dict] | None) -> dict:
            if not runs:
                return {"text": text, "lines": 0}
            gone = set()
            for run in runs:
                gone.update(range(run["n"], run["n"] + run["w"]))
            kept, n = [], 0
            for line in text.split("\n"):
                if worded(line):
                    n += 1
                    if n - 1 in gone:
                        continue
                kept.append(line)
            return {"text": "\n".join(kept), "lines": len(gone)}

        return without

    return row_udf(make, T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.LongType())]), 2)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted: str = "deleted_lines", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the lines of later copies, with one more column: how many lines each row lost."""
    d, th, gone, out = (free_name(docs, x) for x in ("d", "th", "runs", "without"))
    runs = later_copies(docs, doc_id, text, least_words).groupBy("d", "th").agg(F.collect_set(F.struct("n", "w")).alias(gone))
    runs = runs.select(F.col("d").alias(d), F.col("th").alias(th), gone)
    # the text's hash joins as a column of its own, so that null ids and repeated ids find their runs
    joined = docs.join(runs, docs[doc_id].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text]) == F.col(th)), "left")
    changed = joined.withColumn(out, _without()(F.col(text), F.col(gone)))
    return changed.select(*[F.col(out)["text"].alias(text) if c == text else F.col(c) for c in docs.columns], F.col(out)["lines"].alias(deleted))
