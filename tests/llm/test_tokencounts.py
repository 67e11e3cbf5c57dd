from helpers import documents, sentence
from tokenizers import Tokenizer

from corpusloom.llm import tokencounts, tokens

TEXTS = [(1, None), (1, ""), (2, "one"), (3, sentence(1, 900)), (None, sentence(1, 900))] + [(i, sentence(i, i)) for i in range(1, 120)]


def test_histogram_suffix_sums_limits_and_quantiles(spark):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    lengths = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in TEXTS)
    summed = tokencounts.with_suffix_sums(tokencounts.length_histogram(documents(spark, TEXTS)))
    found = {r.n_tokens: r for r in summed.collect()}
    assert sorted(found) == sorted(set(lengths))
    for n, r in found.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.docs_at_most == sum(x <= n for x in lengths)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
    limits = [1, 7, 64, 100, 5000]
    for r in tokencounts.at_limits(summed, limits).collect():
        assert (r.docs, r.tokens) == (len(lengths), sum(lengths))
        assert r.docs_over == sum(x > r.context_limit for x in lengths)
        assert r.tokens_left == sum(min(x, r.context_limit) for x in lengths)
    for r in tokencounts.quantiles(summed, [0.5, 0.9, 1.0]).collect():
        need = -(-r.share * len(lengths) // 1)
        assert r.n_tokens == lengths[int(need) - 1]


def test_empty_table(spark):
    empty = tokencounts.length_histogram(documents(spark, TEXTS).limit(0))
    assert tokencounts.with_suffix_sums(empty).count() == 0
    assert [tuple(r) for r in tokencounts.at_limits(tokencounts.with_suffix_sums(empty), [8]).collect()] == [(8, 0, 0, 0, 0)]


def test_other_tokenizers_encode_whole_texts():
    import struct

    import public_tokenizers
    import tokenizers

    from corpusloom.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    for text in ("", "two  spaces and\n\nlines  ", "plain words here", None):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert tokens.encoder(path)(text) == struct.pack(f"<{len(ids)}I", *ids)
