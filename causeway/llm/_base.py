"""What the operators of this subpackage share: input columns, shared storage, array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.shared import discard, materialize, shared_dir  # noqa: F401

#: ``[^\x20\x09-\x0D]+`` is a word wherever an operator counts words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once; texts may be long, and Spark's own default is ten times as many.
BATCH_ROWS = 1024


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batch to ``BATCH_ROWS`` where it is larger."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of every fit."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def starts(lengths: Column, block: int = 256) -> Column:
    """Running sums before each element of an array of ints, for arrays of any size.

    Sums are gathered in blocks, so that growing an array copies a block and not all.  The
    lambdas refer to nothing outside, so that the array is evaluated once wherever the
    optimiser moves this.  An empty array gives an empty array, null gives null.
    """
    none = F.array().cast("array<bigint>")
    state = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("done"), none.alias("now"))

    def step(s: Column, x: Column) -> Column:
        full = F.size(s["now"]) >= block
        return F.struct(
            (s["total"] + x).alias("total"),
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, none).otherwise(s["now"]), F.array(s["total"])).alias("now"),
        )

    return F.aggregate(lengths, state, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))
