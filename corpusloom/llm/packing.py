"""Packing: token ids of whole documents into sequences of at most ``capacity`` ids, by multiway differencing.

Each task walks its rows once. Ids are gathered until they nearly fill ``windows`` sequences; the block is
then cut at its end, split into pieces and dealt out by the Karmarkar-Karp method: a heap holds partial
partitions, each one load per window; the two with the widest imbalance are merged with opposing order, the
heaviest window of one with the lightest of the other, until one partition is left. If a window exceeds the
capacity, the window count rises and the block is dealt again; if that costs more padding than
``worst_padding``, the block's pieces are cut smaller and dealt again, and the tightest deal is used.

A document may lie in several pieces, each id in exactly one. Nothing is shuffled or collected: a task holds
one block. Which documents share a sequence follows the partitions of the input, so the input should be read
from files or a table. Defined results: a null text is empty, and an empty document is its end id alone; rows
with equal or null ids are packed as documents of their own; other columns play no part; an empty table
gives no piece.
"""

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.tokens import encoder

CAPACITY, END_ID, WINDOWS, PIECE, WORST_PADDING = 4096, 2, 128, 512, 0.01


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` by window, at most ``windows`` of them, of near-equal sums."""
    if windows == 1:
        return [list(range(len(sizes)))]
    # a partition: (load, items) of the windows in use, heaviest first; items nest as pairs
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        alone = min(len(one), windows - len(two))
        met = len(one) - alone
        lightest = two[::-1]
        slots = [*one[:alone], *[(x[0] + y[0], (x[1], y[1])) for x, y in zip(one[alone:], lightest, strict=False)], *lightest[met:]]
        slots.sort(key=lambda x: -x[0])
        count += 1
        heapq.heappush(heap, (-(slots[0][0] - (slots[-1][0] if len(slots) == windows else 0)), count, slots))
    out = []
    for _, node in heap[0][2] if heap else ():
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def deal(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE, worst_padding: float = WORST_PADDING) -> list[list[tuple[int, int, int]]]:
    """Windows of (index of ``lengths``, start, length): every length is covered once, no window exceeds ``capacity``."""
    total = sum(lengths)
    least, best = -(-total // capacity), None
    while True:
        cuts = [(i, at, min(piece, n - at)) for i, n in enumerate(lengths) for at in range(0, n, piece)]
        windows = least
        while True:
            dealt = difference([c[2] for c in cuts], windows)
            if max(sum(cuts[i][2] for i in w) for w in dealt) <= capacity:
                break
            windows += max(1, windows // 100)
        if best is None or len(dealt) < len(best[0]):
            best = dealt, cuts
        if len(best[0]) <= least + worst_padding * least or piece <= 64:
            break
        piece //= 2
    dealt, cuts = best
    out = []
    for w in dealt:
        joined: list[tuple[int, int, int]] = []
        for i in w:
            k, start, n = cuts[i]
            if joined and joined[-1][0] == k and joined[-1][1] + joined[-1][2] == start:  # neighbours are one piece again
                joined[-1] = (k, joined[-1][1], joined[-1][2] + n)
            else:
                joined.append((k, start, n))
        out.append(joined)
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, windows: int = WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    sequence_id is unique, from the partition's number and a count within it. ids are little-endian unsigned
    32-bit values, and ids_crc32 is their checksum.
    """
    kind = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    end = end_id.to_bytes(4, "little")
    full = capacity * windows - max(1, capacity * windows // 256)  # a little room lets near-equal windows fit at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        held, total, arrow = [], 0, None  # held: (doc_id, ids before, ids, ids of the document)

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, total
            rows = []
            for window in deal([len(x[2]) // 4 for x in held], capacity):
                offset = 0
                for k, start, n in window:
                    key, before, ids, tokens = held[k]
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((key, before + start, n, zlib.crc32(part), tokens, sequence, offset, *[part] * with_ids))
                    offset += n
                sequence += 1
            held, total = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)

        for batch in batches:
            arrow = [batch.schema.field(0).type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py()) + end
                tokens, at = len(ids) // 4, 0
                while at < tokens:
                    n = min(tokens - at, full - total)
                    held.append((key, at, ids[4 * at : 4 * (at + n)], tokens))
                    at, total = at + n, total + n
                    if total == full:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
