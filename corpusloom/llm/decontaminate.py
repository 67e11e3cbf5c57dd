"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts scans each text once.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case: digits, letters and
everything beyond ASCII. A window is ``width`` consecutive words of an item; an item with fewer words, but
at least one, is one window. Every occurrence of a window in a document marks its words as hit, and the hit
runs are mapped back to character offsets of the original text.

Defined results: a null or empty text has no words and no hits; a null or empty item has no window; a null
item_id takes part as a window owner but isn't named in ``item_ids``; repeated documents give repeated rows;
a repeated item is named once; other columns of either table play no part.
"""

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, free_name, row_udf

WIDTH = 10
#: The automaton is sent to every task: so many bytes of normalised benchmark text make one block at most;
#: a larger benchmark is cut into blocks by items, each scanned in a pass of its own.
BLOCK_BYTES = 32 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ORIGINAL_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def normalised_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def windows(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> dict[bytes, list]:
    """Each window, its words with one space around each, and the items that have it."""
    found: dict[bytes, set] = {}
    for item, text in items:
        words = normalised_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i : i + width]) + b" ", set()).add(item)
    return {w: sorted(x for x in ids if x is not None) for w, ids in found.items()}


def scanner(block: dict[bytes, list]):
    """Makes the function of a text and of what earlier blocks found in it; the automaton is built once a task."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w, ids in block.items():
        automaton.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, ids))
    automaton.make_automaton()
    found = automaton.iter if block else lambda _: ()
    original = re.compile(_ORIGINAL_WORD)

    def scan(text: str | None, before: dict | None = None) -> dict:
        words = normalised_words(text)
        line = b" " + b" ".join(words) + b" "
        spaces, edges, ids = None, None, set(before["item_ids"] if before else ())
        if before and before["spans"]:
            edges = np.zeros(len(words) + 1, np.int64)
            starts = [m.start() for m in original.finditer(text)]
            for span in before["spans"]:
                edges[np.searchsorted(starts, span["start"])] += 1
                edges[np.searchsorted(starts, span["end"])] -= 1
        for end, (size, n, owners) in found(line.decode("latin-1")):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                edges = np.zeros(len(words) + 1, np.int64) if edges is None else edges
            first = int(np.searchsorted(spaces, end - size + 1))
            edges[first] += 1
            edges[first + n] -= 1
            ids.update(owners)
        if edges is None:
            return {"n_words": len(words), "n_hit": 0, "item_ids": [], "spans": []}
        hit = np.cumsum(edges)[:-1] > 0
        turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        at = [m.span() for m in original.finditer(text)]
        spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in turns.reshape(-1, 2).tolist()]
        return {"n_words": len(words), "n_hit": int(hit.sum()), "item_ids": sorted(ids), "spans": spans}

    return scan


def cut(item: str | None, text: str, width: int, block_bytes: int) -> Iterator[tuple[str | None, str]]:
    """The item, or parts of it that have all its windows between them, where its windows alone would fill a block."""
    if len(text) * width <= block_bytes:
        yield item, text
        return
    words = [w.decode() for w in normalised_words(text)]
    longest = max(map(len, words), default=1)
    size = max(1, block_bytes // (width * (longest + 1)))  # windows of a part
    for at in range(0, max(1, len(words) - width + 1), size):
        yield item, " ".join(words[at : at + size + width - 1])


def _blocks(items: DataFrame, width: int, block_bytes: int) -> Iterator[dict[bytes, list]]:
    """The windows of the items, read one row after the other, in blocks of bounded size; one block at least."""
    block, held, none_yet = [], 0, True
    for item, text in (part for row in items.toLocalIterator() for part in cut(row[0], row[1], width, block_bytes)):
        block.append((item, text))
        held += len(text) * width  # each word is in as many windows
        if held > block_bytes:
            yield windows(block, width)
            block, held, none_yet = [], 0, False
    if block or none_yet:
        yield windows(block, width)


def with_contamination(docs: DataFrame, items: DataFrame, column: str = "contamination", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one more column: RESULT of each text against all items.

    Items are the only thing sent to tasks, in blocks of ``block_bytes``. As a rule there is one block. Each
    further block is a further pass over the checkpointed rows, so no task holds two automata.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.col(item_text).isNotNull()).distinct()
    marked = None
    for block in _blocks(known, width, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        make = lambda sent=sent: scanner(sent.value)
        if marked is None:
            marked = docs.withColumn(column, row_udf(make, RESULT)(F.col(text)))
        else:
            marked = checkpointed(marked).withColumn(column, row_udf(make, RESULT, 2)(F.col(text), F.col(column)))
    return marked


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with all their columns."""
    column = free_name(docs, "contamination")
    return with_contamination(docs, items, column, text, **options).where(F.col(column)["n_hit"] == 0).drop(column)
