import hashlib
import re

from helpers import documents, sentence

from corpusloom.llm import decontaminate

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items):
    words = W.findall(lower(text))
    hit, ids = set(), set()
    for item, body in items:
        own = W.findall(lower(body))
        for s in range(max(1, len(own) - 9) if own else 0):
            win = own[s : s + 10]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(item)
    return len(words), len(hit), sorted(x for x in ids if x is not None)


ITEMS = [("7", sentence(3, 25)), ("12", "Short ÉTÉ item"), ("9", ""), ("4", None), (None, sentence(5, 12)), ("7", sentence(3, 25)), ("70", sentence(3, 12)), ("x", "?!")]
TEXTS = [
    (1, None),
    (2, ""),
    (3, "  \n"),
    (4, "clean words only"),
    (5, "Before. " + sentence(3, 25).upper().replace(" ", " ,\n") + "; after"),
    (5, "Before. " + sentence(3, 25)),
    (6, sentence(3, 9)),
    (7, "a short été item, SHORT ÉTÉ ITEM short Été item"),
    (8, "short été item"),
    (9, sentence(5, 12) + " " + sentence(3, 14)),
    (None, sentence(3, 11)),
    (10, "x " * 20000 + sentence(3, 25)),
]


def check(spark, **options):
    docs = documents(spark, TEXTS)
    items = spark.createDataFrame([(a, b, 1) for a, b in ITEMS], "item_id string, text string, n_words int")
    out = decontaminate.with_contamination(docs, items, "c", **options).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        n, hit, ids = brute(r.text, ITEMS)
        assert (r.c.n_words, r.c.n_hit, r.c.item_ids) == (n, hit, ids), r
        inside = [w for s in r.c.spans for w in W.findall(lower(r.text[s.start : s.end]))]
        assert len(inside) == hit


def test_against_brute_force(spark):
    check(spark)


def test_blocks_give_the_same(spark):
    check(spark, block_bytes=50)


def test_empty_tables_and_filter(spark):
    docs = documents(spark, TEXTS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == len(TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8]  # only A-Z are lower-cased: the item has a capital É


def test_query_digest(spark, sf_dir):
    from corpusloom.llm.queries import QUERIES

    rows = QUERIES["op5_benchmark_decontamination"](spark, sf_dir).collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows[:40]:
        n, hit, ids = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_an_item_that_fills_several_blocks(spark):
    """Its parts overlap, so that no window is lost and none is new."""
    words = [f"w{i}" for i in range(300)]
    for size in (1, 50, 4000, 10**6):
        parts = list(decontaminate.cut("7", " ".join(words), 10, size))
        found = set().union(*(decontaminate.windows([p]) for p in parts))
        assert found == set(decontaminate.windows([("7", " ".join(words))])) and len(found) == 291
    assert len(parts) == 1 and len(list(decontaminate.cut("7", " ".join(words), 10, 4000))) > 1
    assert list(decontaminate.cut("7", "a b", 10, 1)) == [("7", "a b")]
    docs = spark.createDataFrame([(1, " ".join(words[95:120])), (2, " ".join(words[5:14]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    for size in (2000, 1 << 20):
        rows = decontaminate.with_contamination(docs, items, "c", block_bytes=size).select("doc_id", "c.n_hit", "c.item_ids").orderBy("doc_id").collect()
        assert [tuple(r) for r in rows] == [(1, 25, ["7"]), (2, 0, [])]
