"""What the operators share: tables, the shared folder, Arrow UDFs over whole rows."""

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.sources.shared import shared_dir, written


#: Rows of an Arrow batch that are Python objects at once.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: lineage ends here and no executor's loss costs them."""
    return written(df)


def row_udf(make: Callable[[], Callable], schema: T.DataType, inputs: int = 1) -> Callable[..., Column]:
    """A UDF of ``inputs`` columns whose ``make`` runs once a task and gives a function of one row's values.

    Values go to Python in Arrow batches. The result is one value, or a dict for a struct. It's marked
    non-deterministic only so that Catalyst never evaluates it twice for a filter and a projection.
    """
    arrow = to_arrow_type(schema)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for x in batches:
            yield joined([pa.array([f(v) for v in x.slice(i, ROWS).to_pylist()], arrow) for i in range(0, len(x), ROWS)])

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for xs in batches:
            yield joined([pa.array([f(*v) for v in zip(*(x.slice(i, ROWS).to_pylist() for x in xs), strict=True)], arrow) for i in range(0, len(xs[0]), ROWS)])

    def joined(parts: list[pa.Array]) -> pa.Array:
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run = one if inputs == 1 else many
    return F.arrow_udf(run, schema).asNondeterministic()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """k (the id), t (a text) and y (the label) of at most ``sample`` documents of each label 0 and 1.

    The ids are chosen from the labels alone, by hash; only these, 2 * ``sample`` at most, are broadcast. Where
    an id repeats, one of its texts is taken; an id with both labels is left out.
    """
    known = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    first, second = (known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (1, 0))
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where("t is not null")
    return rows.join(F.broadcast(first.unionByName(second)), "k").groupBy("k", "y").agg(F.max("t").alias("t"))
