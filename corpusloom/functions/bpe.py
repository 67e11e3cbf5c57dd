"""Byte-pair encoding: pieces are counted by Spark, merges are learned from the piece table, texts are encoded by Arrow UDF."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The split pattern, and the special tokens, which take the ids after the merges.
SPLIT = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
SPECIALS = "<|bos|> <|user_start|> <|user_end|> <|assistant_start|> <|assistant_end|> <|python_start|> <|python_end|> <|output_start|> <|output_end|>".split()

Pair = tuple[int, int]


def pieces(text: Column) -> Column:
    """The pieces that no token crosses; together they are the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT), F.lit(0))


def training_texts(docs: DataFrame, order: str, text: str, doc_cap: int, max_chars: int) -> DataFrame:
    """order and kept text: texts cut to ``doc_cap`` characters, up to and with the one that passes ``max_chars``.

    The running sum is taken in blocks of 1024 ordinals and then over the blocks' totals, so no task holds all.
    """
    rows = docs.select(F.col(order), F.substring(F.coalesce(F.col(text), F.lit("")), 1, doc_cap).alias("kept")).withColumn("_n", F.length("kept").cast("long")).withColumn("_b", F.floor(F.col(order) / 1024))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_b").agg(F.sum("_n").alias("_t")).select("_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return rows.join(blocks, "_b").withColumn("_run", running).where(F.col("_run") <= max_chars).select(order, "kept")


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """piece, cnt."""
    return docs.select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("cnt"))


def _laid_out(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes one after the other, -1 after each piece, and for each place the piece's number."""
    pieces = pieces.cast(pa.large_binary())
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(offsets) + 1)
    out = np.full(len(row), -1, np.int32)
    out[np.arange(len(data)) + np.repeat(np.arange(len(pieces)), np.diff(offsets))] = data
    return out, row


def learned_merges(counted: dict[bytes, int], merges: int) -> list[Pair]:
    """The merges of most weight, one after the other; ties go to the lower pair."""
    symbols, row = _laid_out(pa.array(list(counted), pa.binary()))
    return merges_of(symbols, np.array(list(counted.values()), np.int64)[row], merges)


def merges_of(symbols: np.ndarray, weights: np.ndarray, merges: int) -> list[Pair]:
    """The same for pieces that are laid out in one array, with a weight for each place. Changes ``symbols``.

    All pieces take part. A symbol's token stands at its first and its last byte, -2 between these, so its neighbours
    are found from the tokens' lengths; a token knows the places where it began to be. A merge goes through the places
    of the rarer of its two tokens: some 12 bytes a byte of pieces are held, and a weight for each pair there is.
    """
    lengths = [1] * 256
    known = np.flatnonzero(symbols >= 0).astype(np.int32)
    order = np.argsort(symbols[known].astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(symbols[known], minlength=256))
    where = dict(enumerate(np.split(known[order], ends[:-1])))
    del known, order
    sums = np.zeros(1 << 16, np.int64)
    for i in range(0, len(symbols) - 1, 1 << 22):
        a, b = symbols[i : i + (1 << 22)][: len(symbols) - 1 - i], symbols[i + 1 : i + 1 + (1 << 22)]
        both = (a >= 0) & (b >= 0)
        sums += np.bincount((a[both] << 8) | b[both], weights=weights[i : i + len(a)][both], minlength=1 << 16).astype(np.int64)
    totals = {(int(k) >> 8, int(k) & 255): int(sums[k]) for k in np.flatnonzero(sums)}
    # a heap of (weight, pair) with stale entries: the weight is looked up again when an entry comes out
    heap = [(-n, p) for p, n in totals.items()]
    heapq.heapify(heap)
    out: list[Pair] = []

    def moved(neighbours: np.ndarray, w: np.ndarray, old: Callable[[int], Pair], fresh: Callable[[int], Pair]) -> None:
        """Weights of pairs with a token that became part of the new one go to the new one's pairs."""
        found, place = np.unique(neighbours, return_inverse=True)
        for x, n in zip(found.tolist(), np.bincount(place, weights=w).astype(np.int64).tolist(), strict=True):
            before, after = old(x), fresh(x)
            if before in totals:
                totals[before] -= n
            totals[after] = totals.get(after, 0) + n
            heapq.heappush(heap, (-totals[after], after))

    while len(out) < merges and heap:
        weight, pair = heapq.heappop(heap)
        have = totals.get(pair, 0)
        if have != -weight:
            if have > 0:
                heapq.heappush(heap, (-have, pair))
            else:
                totals.pop(pair, None)
            continue
        first, second = pair
        new, size, more = len(lengths), lengths[first], lengths[second]
        out.append(pair)
        lengths.append(size + more)
        rarer = first if len(where[first]) <= len(where[second]) else second
        at = where[rarer]
        at = at[symbols[at] == rarer]
        if rarer == first:
            rest = at + size
            here = symbols[rest] == second
        else:
            rest = at
            at = rest - size
            here = symbols[rest - 1] == first if len(rest) and rest[0] > 0 else np.concatenate((np.zeros(1, bool), symbols[rest[1:] - 1] == first)) if len(rest) else np.zeros(0, bool)
        where[rarer] = (at if rarer == first else rest)[~here] if first != second else at
        at = at[here]
        if first == second and len(at):  # of a run of them every second one begins a merge
            breaks = np.ones(len(at), bool)
            breaks[1:] = at[1:] != at[:-1] + size
            begins = np.flatnonzero(breaks)
            at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
        w = weights[at]
        end = at + (size + more - 1)
        left = symbols[at - 1] if not len(at) or at[0] > 0 else np.concatenate((np.full(1, -1, np.int32), symbols[at[1:] - 1]))
        right = symbols[end + 1]
        after_one = np.zeros(len(at), bool)
        after_one[1:] = at[1:] == end[:-1] + 1
        before_one = np.append(after_one[1:], False)[: len(at)]
        if size > 1:
            symbols[at + (size - 1)] = -2
        if more > 1:
            symbols[at + size] = -2
        symbols[at], symbols[end] = new, new
        where[new] = at
        totals.pop(pair)
        edge = (left >= 0) & ~after_one
        moved(left[edge], w[edge], lambda x: (x, first), lambda x: (x, new))
        edge = (right >= 0) & ~before_one
        moved(right[edge], w[edge], lambda x: (second, x), lambda x: (new, x))
        if after_one.any():
            moved(np.zeros(int(after_one.sum()), np.int64), w[after_one], lambda _: (second, first), lambda _: (new, new))
    return out


def merged(ids: list[int], pair: Pair, new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


class Bpe:
    """A vocabulary: 256 bytes, then merges, then special tokens."""

    def __init__(self, merges: list[Pair], specials: list[str] = SPECIALS):
        self.merges, self.specials = merges, specials
        self.ranks = {p: i for i, p in enumerate(merges)}
        self.bytes = [bytes([b]) for b in range(256)]
        for a, b in merges:
            self.bytes.append(self.bytes[a] + self.bytes[b])
        self.special_ids = {s: len(self.bytes) + i for i, s in enumerate(specials)}

    @property
    def size(self) -> int:
        return len(self.bytes) + len(self.specials)

    def piece(self, piece: bytes) -> list[int]:
        ids = list(piece)
        while len(ids) > 1:
            rank, pair = min(((self.ranks.get(p, len(self.merges)), p) for p in zip(ids, ids[1:], strict=False)))
            if rank == len(self.merges):
                break
            ids = merged(ids, pair, 256 + rank)
        return ids

    def decode(self, ids: list[int]) -> str:
        names = {i: s.encode() for s, i in self.special_ids.items()}
        return b"".join(names[i] if i in names else self.bytes[i] for i in ids).decode("utf-8", "replace")

    def token_bytes(self) -> list[int]:
        """Bytes of each id; special tokens have none."""
        return [len(b) for b in self.bytes] + [0] * len(self.specials)


def train(docs: DataFrame, vocab_size: int, text: str = "text", specials: list[str] = SPECIALS) -> Bpe:
    """A vocabulary of ``vocab_size`` from all of the corpus's pieces.

    Counting is distributed; one executor's task learns the merges from the table of distinct pieces, and only the merges
    come to the driver.
    """
    merges = vocab_size - 256 - len(specials)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            symbols, row = _laid_out(batch.column("piece"))
            parts.append((symbols.astype(np.int16), batch.column("cnt").to_numpy()[row]))
        kind = np.int32 if all(w.max(initial=0) < 1 << 31 for _, w in parts) else np.int64
        parts = [(x, w.astype(kind)) for x, w in parts]
        symbols, weights = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int16)]) for i in (0, 1))
        parts.clear()
        pairs = merges_of(symbols.astype(np.int32), weights, merges)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1)], names=["a", "b"])

    counted = piece_counts(docs, text).select(F.col("piece").cast("binary").alias("piece"), "cnt")
    learned = counted.repartition(1).mapInArrow(run, "a int, b int").toArrow()
    return Bpe(list(zip(learned.column("a").to_pylist(), learned.column("b").to_pylist(), strict=True)), specials)


#: Rows whose pieces or ids are Python objects at once.
ROWS = 64


def _by_rows(x: pa.Array, convert: Callable[[list], pa.Array], kind: pa.DataType) -> pa.Array:
    parts = [convert(x.slice(i, ROWS).to_pylist()) for i in range(0, len(x), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encoded(parts: Column, model: Bpe, cache: int = 200_000) -> Column:
    """Ids of an array of pieces. Specials in a text are ordinary text."""
    merges = model.merges

    def run(x: pa.Array) -> pa.Array:
        own, known = Bpe(merges, []), {}

        def ids(p: str) -> list[int]:
            if p not in known:
                if len(known) >= cache:
                    known.clear()
                known[p] = own.piece(p.encode("utf-8", "replace"))
            return known[p]

        kind = pa.list_(pa.int32())
        return _by_rows(x, lambda rows: pa.array([None if v is None else [i for p in v for i in ids(p)] for v in rows], kind), kind)

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(parts)


def decoded(ids: Column, model: Bpe) -> Column:
    merges, specials = model.merges, model.specials

    def run(x: pa.Array) -> pa.Array:
        own = Bpe(merges, specials)
        return _by_rows(x, lambda rows: pa.array([None if v is None else own.decode(v) for v in rows], pa.string()), pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def vocabulary_table(spark, model: Bpe) -> DataFrame:
    """id, token (as text), n_bytes, special."""
    rows = [(i, b.decode("utf-8", "replace"), len(b), False) for i, b in enumerate(model.bytes)]
    rows += [(i, s, 0, True) for s, i in model.special_ids.items()]
    return spark.createDataFrame(rows, "id long, token string, n_bytes long, special boolean")


def compression(rows: DataFrame, group: list[str], text: str, n_tokens: str) -> DataFrame:
    """Bytes, tokens and bytes a token."""
    sums = rows.groupBy(*group).agg(F.sum(F.octet_length(text)).cast("long").alias("n_bytes"), F.sum(n_tokens).cast("long").alias("n_tokens"))
    return sums.withColumn("ratio", F.col("n_bytes") / F.col("n_tokens"))
