"""Best-fit packing of token lists into rows, by crop or by pad, and the arrays around it.

Which rows come out depends on the order of documents and on a buffer, so packing is defined per key: each
key's documents are taken in order, and keys are packed in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BestFit:
    """Rows of one stream of (id, length): the largest buffered item that fits goes next, the earliest of equals."""

    def __init__(self, capacity: int, buffer: int, crop: bool):
        self.capacity, self.buffer, self.crop = capacity, buffer, crop

    def rows(self, items: Iterator[tuple]) -> Iterator[tuple[int, int, object, int, int]]:
        """(row, slot, id, used, length). A crop cuts the shortest item to the room that is left; with padding an item
        longer than a row is cut to it, since nothing else could ever place it."""
        held: list[tuple] = []
        row = slot = at = 0
        items = iter(items)
        more = True
        while True:
            while more and len(held) < self.buffer:
                nxt = next(items, None)
                if nxt is None:
                    more = False
                else:
                    held.append(nxt)
            if not held:
                return
            room = self.capacity - at
            fits = [(-n, i) for i, (_, n) in enumerate(held) if 0 < n <= room]
            if fits:
                key, n = held.pop(min(fits)[1])
                used = n
            elif self.crop or at == 0:
                i = min(range(len(held)), key=lambda i: (held[i][1], i))
                key, n = held.pop(i)
                used = min(n, room)
            else:
                row, slot, at = row + 1, 0, 0
                continue
            if n <= 0:
                continue
            yield row, slot, key, used, n
            slot, at = slot + 1, at + used
            if at == self.capacity:
                row, slot, at = row + 1, 0, 0


def pack(items: DataFrame, key: str, item: str, length: str, order: str, capacity: int, buffer: int = 1000, crop: bool = True) -> DataFrame:
    """key, row, slot, item, used, length: each key's items in ``order``, packed by best fit."""
    kinds = {c: items.schema[c].dataType for c in (key, item)}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField("row", T.LongType()), T.StructField("slot", T.LongType()), T.StructField(item, kinds[item]), T.StructField("used", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def stream():
            for batch in batches:
                if not kind:
                    kind.extend([batch.schema.field(0).type, batch.schema.field(1).type])
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        out, rest = [], stream()
        held = next(rest, None)
        while held is not None:
            own = held[0]

            def group(own=own):
                nonlocal held
                while held is not None and held[0] == own:
                    yield held[1], held[2] or 0
                    held = next(rest, None)

            for r in BestFit(capacity, buffer, crop).rows(group()):
                out.append((own, *r))
                if len(out) == 20000:
                    yield table(out, kind)
                    out = []
        if out:
            yield table(out, kind)

    def table(out: list, kind: list) -> pa.RecordBatch:
        types = [kind[0], pa.int64(), pa.int64(), kind[1], pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    rows = items.select(key, item, F.col(length).cast("long"), F.col(order).alias("_order")).repartition(key).sortWithinPartitions(key, "_order").drop("_order")
    return rows.mapInArrow(run, schema)


def inputs_and_targets(ids, size: int):
    """A row's first ``size`` ids, and those one place on."""
    return F.slice(ids, 1, size), F.slice(ids, 2, size)


def stacked(rows: DataFrame, ids: str, value: int) -> DataFrame:
    """Lists filled at their end to the longest one's length."""
    longest = rows.agg(F.max(F.size(ids))).first()[0] or 0
    return rows.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(value), F.lit(longest) - F.size(ids))))


def training_rows(placed: DataFrame, items: DataFrame, key: str, item: str, capacity: int, filler: int, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """key, row, inputs, targets: the packed rows of ``capacity`` places, one more id than a step sees.

    ``placed`` is what ``pack`` gives, ``items`` has the ids of each item and their masks. A row's end is filled with
    ``filler``. Targets are -1 where the mask is 0 and in the filled part. A row is bounded, and so is its list of items.
    """
    cells = placed.join(items.select(item, ids, mask), item).select(key, "row", F.struct("slot", F.slice(ids, F.lit(1), F.col("used").cast("int")).alias("i"), F.slice(mask, F.lit(1), F.col("used").cast("int")).alias("m")).alias("c"))
    rows = cells.groupBy(key, "row").agg(F.array_sort(F.collect_list("c")).alias("c"))
    flat = lambda n: F.flatten(F.transform("c", lambda x: x[n].cast("array<long>")))
    room = F.lit(capacity) - F.size("i")
    filled = rows.select(key, "row", flat("i").alias("i"), flat("m").alias("m")).select(key, "row", F.concat("i", F.array_repeat(F.lit(filler).cast("long"), room)).alias("i"), F.concat("m", F.array_repeat(F.lit(0).cast("long"), room)).alias("m"))
    inputs, following = inputs_and_targets(F.col("i"), capacity - 1)
    return filled.select(key, "row", inputs.alias("inputs"), F.zip_with(following, F.slice("m", 2, capacity - 1), lambda x, k: F.when(k != 0, x).otherwise(F.lit(-1).cast("long"))).alias("targets"))
