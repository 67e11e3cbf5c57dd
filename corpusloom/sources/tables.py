"""Reading and writing corpora: parquet folders, JSON lines, story files, books, shards and their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where a small input came in fewer partitions than there are cores; else as they are.

    Only inputs of a few files or row groups are moved: what a cluster reads in earnest has more partitions.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's parquet files in name order: file and ordinal. Unfinished ``.tmp`` files are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    names = found.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("ordinal"))  # one row a file


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Rows of ``train`` or ``val``: the last file by name is val, all others are train; with one file train is empty."""
    if split not in ("train", "val"):
        raise ValueError("split is train or val")
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("_file", F.col("_metadata.file_name"))
    last = rows.agg(F.max("_file")).first()[0]
    return rows.where((F.col("_file") == last) if split == "val" else (F.col("_file") < last)).drop("_file")


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """The rows ``n`` times over, numbered by ``epoch``."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def strided(rows: DataFrame, ordinal: str, start: int, step: int) -> DataFrame:
    """Every ``step``-th row from ordinal ``start`` on: what one of several readers takes."""
    return rows.where((F.col(ordinal) >= start) & ((F.col(ordinal) - start) % step == 0))


def _numbered_lines(rows: DataFrame, name: str, within: list[str]) -> DataFrame:
    """Rows with file, block and at, numbered from 0 in file order, or within each file.

    They are numbered within each block of a file, then moved up by the blocks before it: a row a block is all that
    one task sees.
    """
    earlier = Window.partitionBy(*within).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("inside", inside).join(blocks, ["file", "block"]).withColumn(name, F.col("before") + F.col("inside")).drop("before", "inside")


def _lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """value, file, block and at of a text file's lines."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def stories(spark: SparkSession, path: str, separator: str = "<|endoftext|>") -> DataFrame:
    """Stories between separators: story_id counts non-empty stories in file order, text is trimmed."""
    rows = _lines(spark, path, separator).withColumn("text", F.regexp_replace("value", r"^\s+|\s+$", "")).where("text <> ''")
    return _numbered_lines(rows, "story_id", []).select("story_id", "text")


def archive_stories(spark: SparkSession, path: str, column: str = "text", limit: int | None = None) -> DataFrame:
    """Stories of the CSV files in zip archives: member, story_id (the row's number) and text.

    Empty texts are left out but keep their number; a limit counts rows of a member, empty ones too. An archive
    is read by one task, row by row.
    """
    import pyarrow as pa

    def run(batches):
        import csv
        import io
        import zipfile

        csv.field_size_limit(1 << 30)
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in sorted(n for n in archive.namelist() if n.endswith(".csv")):
                        rows = []
                        with archive.open(member) as raw:
                            for i, row in enumerate(csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""))):
                                if limit is not None and i >= limit:
                                    break
                                if text := (row.get(column) or "").strip():
                                    rows.append((member, i, text))
                                if len(rows) == 1000:
                                    yield packed(rows)
                                    rows = []
                        if rows:
                            yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["member", "story_id", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, story_id long, text string")


def last_matches(lines: DataFrame, line: str, order: str, patterns: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """The first group of each pattern's last match in order: what remains of a log."""
    found = {n: F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for n, p in patterns.items()}
    return lines.groupBy(*(group or [])).agg(*[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in found.items()])


def books(spark: SparkSession, folder: str) -> DataFrame:
    """One row a text file: book_id is the file's stem; bytes that aren't UTF-8 become replacement characters."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("book_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped."""
    return spark.read.schema(schema).json(path).dropna("all")


def code_files(spark: SparkSession, path: str, minified: Column | None = None) -> DataFrame:
    """``content`` of JSON lines with the file's name and the line's number in it; empty content is skipped."""
    numbered = _numbered_lines(_lines(spark, path), "line_no", ["file"])
    parsed = numbered.select("file", "line_no", F.get_json_object("value", "$.content").alias("content")).where("content <> ''")
    return parsed if minified is None else parsed.where(~minified)


def write_json_lines(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines with the keys in name order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def numbered(rows: DataFrame, within: list[str], order: str, name: str, block: int = 1024) -> DataFrame:
    """Adds the rows' place, from 0, by a whole-number column ``order`` within the columns ``within``.

    Rows are numbered in blocks of neighbouring values and moved up by the blocks before theirs, so a group of
    any size is spread over tasks.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    blocks = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*within, "_block").agg(F.count("*").alias("_n")).select(*within, "_block", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*within, "_block").orderBy(order)) - 1
    return rows.join(before, [*within, "_block"]).withColumn(name, F.col("_before") + inside).drop("_block", "_before")


def with_shards(rows: DataFrame, split: str, order: str, per_shard: int) -> DataFrame:
    """Adds ``shard``: rows of each split are numbered by the id ``order``, ``per_shard`` to a shard."""
    return numbered(rows, [split], order, "_at").withColumn("shard", F.floor(F.col("_at") / per_shard)).drop("_at")


def write_shards(rows: DataFrame, path: str, split: str = "split") -> None:
    """Parquet folders by split and shard."""
    rows.repartition(split, "shard").write.mode("overwrite").partitionBy(split, "shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, split: str, start_shard: int = 0, seed: int | None = None) -> DataFrame:
    """The shards of one split from ``start_shard`` on; only their files are read. A seed orders them by hash."""
    rows = spark.read.parquet(path).where((F.col("split") == split) & (F.col("shard") >= start_shard))
    return rows if seed is None else rows.withColumn("shard_order", F.xxhash64("shard", F.lit(seed)))


def manifest(rows: DataFrame, tokens: str, split: str = "split") -> DataFrame:
    """Examples and tokens of each split and shard."""
    return rows.groupBy(split, "shard").agg(F.count("*").alias("n_examples"), F.sum(tokens).alias("n_tokens"))


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``done`` yet, for a resumed run that appends."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def repackaged(docs: DataFrame, doc_id: str, text: str, seed: int, chars_per_shard: int) -> DataFrame:
    """Rows in a seeded order (md5 of seed and id) with ``shard``: a shard ends with the row whose characters fill it.

    The running sum is taken in hash buckets and then over the buckets' totals, so no task holds all rows.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = docs.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")).cast("binary"))).withColumn("_bucket", F.left("_h", F.lit(3)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket").agg(F.sum(size).alias("_chars")).select("_bucket", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_h", doc_id).rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return rows.join(totals, "_bucket").withColumn("shard", F.floor(running / chars_per_shard)).drop("_h", "_bucket", "_before")


def core_inputs(spark: SparkSession, folder: str, schema: str | T.StructType, baselines: str = "eval_meta_data.csv") -> tuple[DataFrame, DataFrame]:
    """Items of all JSON lines files below a folder, with their task (the file's stem), and the tasks' baselines from a CSV."""
    items = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("task")
    return items.select(task, "*").dropna("all", subset=items.columns), spark.read.option("header", True).option("inferSchema", True).csv(f"{folder.rstrip('/')}/{baselines}")


def write_results(rows: DataFrame, path: str) -> None:
    """A small table of results, a row a task, as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
