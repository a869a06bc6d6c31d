"""A small made-up event table, for smoke runs without data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transactions(spark: SparkSession, rows: int = 600, seed: int = 7) -> DataFrame:
    """``(tx_id, row_ord, t, amount, label, card, addr, email, device)``, a function of the arguments alone.

    Times grow by random gaps, amounts are log-normal, and labels are likelier in bursts and for
    cards that are seldom seen.  Every column is a hash of the row's number, so any part of the
    table can be made by any task.
    """
    unit = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "tx_id"), F.lit(1_000_003)) / 1_000_003.0
    normal = F.sqrt(-2 * F.log(unit("n1") + 1e-9)) * F.cos(6.283185307179586 * unit("n2"))
    df = spark.range(1, rows + 1).withColumnRenamed("id", "tx_id").withColumn("row_ord", F.col("tx_id"))
    df = df.withColumn("t", (F.col("tx_id") * 300 + F.floor(unit("gap") * 290)).cast("long"))
    burst = F.floor(F.col("tx_id") / 25) % 9 == 4
    rare = unit("card") > 0.8
    card = F.when(burst, F.lit(7)).when(rare, 1000 + F.floor(unit("card2") * rows)).otherwise(F.floor(unit("card2") * 40))
    df = df.withColumns(
        {
            "amount": F.round(F.exp(3.5 + normal), 2),
            "card": F.concat(F.lit("c"), card.cast("string")),
            "addr": F.concat(F.lit("a"), F.floor(unit("addr") * 25).cast("string")),
            "email": F.when(unit("email?") > 0.2, F.element_at(F.array(*map(F.lit, ("one.example", "two.example", "three.example"))), 1 + F.floor(unit("email") * 3).cast("int"))),
            "device": F.when(unit("device?") > 0.5, F.concat(F.lit("d"), F.floor(unit("device") * 12).cast("string"))),
            "label": (unit("label") < F.when(burst, 0.4).when(rare, 0.12).otherwise(0.02)).cast("int"),
        }
    )
    return df
