import zlib

import numpy as np
import pytest
from helpers import documents, sentence
from tokenizers import Tokenizer

from corpusloom.llm import packing, tokens

TEXTS = [(1, None), (2, ""), (3, "one"), (4, sentence(1, 9000)), (5, sentence(2, 300)), (5, sentence(2, 300)), (None, sentence(3, 2000)), (6, "It's  <|endoftext|> 3.5 İstanbul ΟΔΟΣ\x85x ý ½.")] + [(10 + i, sentence(i, 40 + 13 * i)) for i in range(150)]


def ids_of(text):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_tokenizer(spark, sf_dir):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    encode = tokens.encoder()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = ["", " \n ", "a.'s b!'t", "<|endoftext|>x<|ENDOFTEXT|>", "x y z", "É.È,", "１２.", "don't. 're.", "é.", "a..b,c;", "ſß.", "İ.", "ẞ."]
    for x in [*texts, *odd]:
        assert encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x[:80]


@pytest.mark.parametrize("partitions", [1, 3])
def test_pieces_give_the_documents_back(spark, partitions):
    docs = documents(spark, TEXTS).repartition(partitions)
    rows = packing.pack(docs, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) * 4096 - total < 0.02 * total + 4096 * partitions
    expected = {}
    for i, t in TEXTS:
        expected.setdefault(i, []).append(ids_of(t))
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    assert found.keys() == expected.keys()
    for i, wanted in expected.items():
        covered = sorted((r.start, r.ids) for r in found[i])
        copies = len(wanted)
        assert sum(len(x) for _, x in covered) == 4 * sum(map(len, wanted))
        if copies == 1:
            assert b"".join(x for _, x in covered) == np.array(wanted[0], "<u4").tobytes()
            assert {r.doc_tokens for r in found[i]} == {len(wanted[0])}


def test_empty_table(spark):
    assert packing.pack(documents(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[5], [4097], [900] * 300, [4095] * 50, [3000] * 40, [2049] * 60, [1] * 5000, [20000, 1, 1]])
def test_deal_covers_every_length_once(sizes):
    windows = packing.deal(sizes)
    covered = {}
    for w in windows:
        assert sum(n for _, _, n in w) <= 4096
        for i, start, n in w:
            covered.setdefault(i, []).append((start, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, k in sorted(covered[i]):
            assert start == at
            at += k
        assert at == n
    assert len(windows) <= -(-sum(sizes) // 4096) * 1.03 + 1


def test_differencing_beats_greedy_by_size():
    sizes = [(i * 7919) % 997 + 20 for i in range(200)]
    windows = packing.difference(sizes, 20)
    loads = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(200))
    assert max(loads) - min(loads) <= 30
