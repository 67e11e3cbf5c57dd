import gzip

import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.functions import bpe, chat
from corpusloom.sources import tables
from corpusloom.streaming import ingest

CORPUS = ["hello world, hello there", "the rain in Spain stays", "numbers 123 and 4567 again", "äöü and emoji 😀 twice 😀"]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS * 8)], "doc_id long, text string")
    return bpe.train(docs, 256 + 9 + 35)


def test_bpe(spark, model):
    assert model.size == 300 and len(set(model.special_ids.values())) == 9
    texts = [*CORPUS, "", "unseen Wörter\r\n\n  x  ", "<|bos|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", bpe.pieces(F.col("t")).alias("p"), bpe.encoded(bpe.pieces(F.col("t")), model).alias("ids")).select("*", bpe.decoded(F.col("ids"), model).alias("back")).collect()
    for r in rows:
        assert "".join(r.p) == r.t and r.p == regex.findall(bpe.SPLIT, r.t) and r.back == r.t and all(i < 291 for i in r.ids)
    sizes = bpe.vocabulary_table(spark, model).collect()
    assert len(sizes) == 300 and sum(r.n_bytes == 0 for r in sizes) == 9


def test_merges_follow_weights():
    assert bpe.learned_merges({b"aab": 3, b"ab": 2}, 2) == [(97, 98), (97, 256)]
    assert bpe.learned_merges({b"aaaa": 1}, 2) == [(97, 97), (256, 256)]
    assert bpe.learned_merges({}, 3) == []


def messages(spark, convs):
    rows = [(i, [(r, [(t, x) for t, x in parts]) for r, parts in c]) for i, c in enumerate(convs)]
    return spark.createDataFrame(rows, "conv_id long, messages array<struct<role: string, parts: array<struct<type: string, text: string>>>>")


def test_conversation_masks(spark, model):
    convs = [
        [("user", [("text", "hi")]), ("assistant", [("text", "yo")]), ("user", [("text", "q")]), ("assistant", [("text", "a")])],
        [("user", [("text", "sum")]), ("assistant", [("text", "see "), ("python", "1+1"), ("python_output", "2"), ("text", "!")])],
    ]
    df = messages(spark, convs)
    rows = df.select(chat.conversation_ids(F.col("messages"), model).alias("r")).collect()
    learned = [model.decode([i for i, m in zip(r.r.ids, r.r.mask, strict=True) if m]) for r in rows]
    assert learned == ["yo<|assistant_end|>a<|assistant_end|>", "see <|python_start|>1+1<|python_end|>!<|assistant_end|>"]
    whole = model.decode(rows[1].r.ids)
    assert "<|output_start|>2<|output_end|>" in whole and whole.startswith("<|bos|><|user_start|>sum<|user_end|>")
    prompt = df.select(chat.conversation_ids(F.col("messages"), model, for_completion=True).alias("r")).first().r
    assert model.decode(prompt.ids).endswith("<|user_start|>q<|user_end|><|assistant_start|>") and not any(model.decode([i]) == "a" for i in prompt.ids[-2:])
    assert len(df.select(chat.conversation_ids(F.col("messages"), model, most=5).alias("r")).first().r.ids) == 5


def test_system_messages(spark):
    turns = spark.createDataFrame([(0, 0, "system", "sys prompt"), (0, 1, "user", "hi"), (1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.conversations(turns).select("conv_id", chat.rendered(F.col("messages")).alias("t"), chat.is_valid(F.col("messages")).alias("ok"), chat.completion_prompt(F.col("messages")).alias("p")).collect()}
    assert found[0].t == "<|bos|><|user_start|>sys prompt\n\nhi<|user_end|>" and found[0].p is None
    assert found[1].p == "<|bos|><|user_start|>x<|user_end|><|assistant_start|>"
    assert found[1].ok and not found[2].ok
    assert [r.text for r in chat.merged_turns(turns).where("conv_id = 0").collect()] == ["sys prompt\n\nhi"]


def test_files(spark, tmp_path):
    for name, n in (("a", 2), ("b", 3), ("c", 1)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "t" / name))
        part = next((tmp_path / "t" / name).glob("*.parquet"))
        (tmp_path / "p").mkdir(exist_ok=True)
        part.rename(tmp_path / "p" / f"{name}.parquet")
    (tmp_path / "p" / "d.parquet.tmp").write_bytes(b"unfinished")
    folder = str(tmp_path / "p")
    assert [r.file for r in tables.parquet_files(spark, folder).orderBy("ordinal").collect()] == ["a.parquet", "b.parquet", "c.parquet"]
    assert tables.read_split(spark, folder, "train").count() == 5 and tables.read_split(spark, folder, "val").count() == 1

    (tmp_path / "s.txt").write_text("one\n<|endoftext|>\n\n<|endoftext|>\ntwo\nlines\n<|endoftext|>\nlast")
    found = tables.stories(spark, str(tmp_path / "s.txt")).orderBy("story_id").collect()
    assert [(r.story_id, r.text) for r in found] == [(0, "one"), (1, "two\nlines"), (2, "last")]

    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "42.txt").write_bytes(b"caf\xff text")
    book = tables.books(spark, str(tmp_path / "books")).first()
    assert book.book_id == "42" and book.text.endswith("text")

    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"content": "a"}\n\n{"content": ""}\n{"content": "b"}\n')
    assert [(r.line_no, r.content) for r in tables.code_files(spark, str(tmp_path / "c.jsonl.gz")).collect()] == [(0, "a"), (3, "b")]
    assert tables.json_lines(spark, str(tmp_path / "c.jsonl.gz"), "content string").count() == 3


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([("train" if i < 5 else "val", i, 3) for i in range(7)], "split string, doc_id long, n long")
    sharded = tables.with_shards(rows, "split", "doc_id", 2)
    tables.write_shards(sharded, str(tmp_path / "sh"))
    assert {(r["split"], r.shard): (r.n_examples, r.n_tokens) for r in tables.manifest(sharded, "n").collect()} == {("train", 0): (2, 6), ("train", 1): (2, 6), ("train", 2): (1, 3), ("val", 0): (2, 6)}
    assert tables.read_shards(spark, str(tmp_path / "sh"), "train", start_shard=1).count() == 3
    assert [r.doc_id for r in tables.missing(rows, rows.where("doc_id < 6"), ["split", "doc_id"]).collect()] == [6]


def test_streaming(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.limit(40).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), docs.schema, files_per_batch=1)
    run = ingest.streaming_census(stream).writeStream.outputMode("complete").format("memory").queryName("census").trigger(availableNow=True).start()
    run.awaitTermination(120)
    from corpusloom.operators.vocabulary import census, clause_stream

    whole = {r.tok: (r.cnt, r.pos_sum) for r in census(clause_stream(spark.read.parquet(str(tmp_path / "in")))).collect()}
    assert {r.tok: (r.cnt, r.pos_sum) for r in spark.table("census").collect()} == whole
    once = ingest.new_only(stream.unionByName(stream), ["doc_id"])
    ingest.write_batches(once, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    lengths = stream.select((F.col("doc_id") % 2).alias("k"), F.least(F.length("text"), F.lit(900)).alias("n"))
    run = ingest.greedy_rows(lengths, "k", 1000).writeStream.outputMode("append").format("memory").queryName("packed").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert all(0 < r.used <= 1000 for r in spark.table("packed").collect())
