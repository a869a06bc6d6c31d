"""Gains of models over a baseline, wins by window, and what counts as success."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gain_table(m: DataFrame, baseline: str, metrics: list[str], windows: list[str] = ("window",), by: list[str] = ()) -> DataFrame:
    """``(by..., model, windows, mean_gain_<metric>, wins_<metric>)`` against the baseline in the same window."""
    keys = [*by, *windows]
    base = m.where(F.col("model") == baseline).select(*keys, *[F.col(c).alias(f"__{c}") for c in metrics])
    both = m.where(F.col("model") != baseline).join(base, keys)
    gain = lambda c: F.col(c) - F.col(f"__{c}")
    return both.groupBy(*by, "model").agg(
        F.count("*").alias("windows"), *[F.avg(gain(c)).alias(f"mean_gain_{c}") for c in metrics], *[F.sum((gain(c) > 0).cast("int")).alias(f"wins_{c}") for c in metrics]
    )


def comparisons(m: DataFrame, pairs: list[tuple[str, str, str]], metrics: list[str], windows: list[str] = ("window",), by: list[str] = (), least_wins: int = 4) -> DataFrame:
    """Named ``(name, left, right)`` comparisons with ``success``: a mean gain above 0 and enough wins."""
    given = F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.lit(a).alias("left"), F.lit(b).alias("right")) for n, a, b in pairs])).alias("c")
    keys = [*by, *windows]
    left = m.select("*", given).where("model = c.left").select(*keys, "c.comparison", F.col("c.right").alias("__other"), *[F.col(c).alias(f"__{c}") for c in metrics])
    both = left.join(m.withColumnRenamed("model", "__other"), [*keys, "__other"])
    out = both.groupBy(*by, "comparison").agg(
        F.count("*").alias("windows"),
        *[F.avg(F.col(f"__{c}") - F.col(c)).alias(f"mean_gain_{c}") for c in metrics],
        *[F.sum((F.col(f"__{c}") > F.col(c)).cast("int")).alias(f"wins_{c}") for c in metrics],
    )
    ok = F.lit(True)
    for c in metrics:
        ok = ok & (F.col(f"mean_gain_{c}") > 0) & (F.col(f"wins_{c}") >= least_wins)
    return out.withColumn("success", ok)


def margins(m: DataFrame, cohorts: list[str], left: str, right: str, metric: str, windows: list[str] = ("window",)) -> DataFrame:
    """The mean and least margin of one model over another in critical cohorts."""
    rows = m.where(F.col("cohort").isin(*cohorts))
    a = rows.where(F.col("model") == left).select(*windows, "cohort", F.col(metric).alias("__a"))
    b = rows.where(F.col("model") == right).select(*windows, "cohort", F.col(metric).alias("__b"))
    gap = F.col("__a") - F.col("__b")
    return a.join(b, [*windows, "cohort"]).groupBy("cohort").agg(F.avg(gap).alias("mean_margin"), F.min(gap).alias("least_margin"), F.sum((gap > 0).cast("int")).alias("wins"))


def collapse(real: DataFrame, placebo: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """What of a gain is gone when labels are permuted: real minus placebo."""
    return real.select(*keys, F.col(metric).alias("real")).join(placebo.select(*keys, F.col(metric).alias("placebo")), keys).withColumn("collapse", F.col("real") - F.col("placebo"))


def acceptance(table: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds a boolean for each rule (SQL condition) and ``accepted`` for all of them."""
    out = table.withColumns({k: F.coalesce(F.expr(v), F.lit(False)) for k, v in rules.items()})
    return out.withColumn("accepted", F.forall(F.array(*[F.col(k) for k in rules]), lambda x: x))
