"""Ranking and calibration metrics of scores, for any number of groups at once, by windows.

All take ``(keys..., y, score, order)``; ties at a cut-off are taken in the order of ``order``.
Cumulative counts run over distinct scores, after rows of one score are added up.  Without keys
there is one group, which may be a whole table: its running sums are taken in two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGETS = (0.005, 0.01, 0.02, 0.05)


#: Parts of the range of a value into which a group without keys is cut.
BUCKETS = 64


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], descending: bool = False, then: str | None = None) -> DataFrame:
    """``df`` with ``out``, for each ``out: column``: the sum of the column up to and with a row, in the order of ``value`` then ``then``.

    Groups of ``keys`` are windows.  Without keys, rows are cut at quantiles of the value into ``BUCKETS`` parts that are windows of
    their own, and the parts' totals, a row each, are added up before.
    """
    order = [F.desc(value) if descending else F.asc(value), *([F.asc(then)] if then else [])]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    cuts = df.agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 1000)).first()[0] or []
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + (F.col(value) > F.lit(c)).cast("int")
    rows = df.withColumn("__bucket", F.coalesce(-bucket if descending else bucket, F.lit(1 if descending else -1)))
    totals = rows.groupBy("__bucket").agg(*[F.sum(c).alias(f"__b_{out}") for out, c in sums.items()])
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("__bucket", *[F.coalesce(F.sum(f"__b_{out}").over(earlier), F.lit(0)).alias(f"__b_{out}") for out in sums])
    w = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumns({f"__i_{out}": F.sum(c).over(w) for out, c in sums.items()})
    out = inside.join(F.broadcast(shift), "__bucket")  # a row for each part
    return out.withColumns({o: F.col(f"__i_{o}") + F.col(f"__b_{o}") for o in sums}).drop("__bucket", *[f"__{x}_{o}" for o in sums for x in "ib"])


def totals(df: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sums of columns over its group; without keys, numbers from one aggregation."""
    if keys:
        return df.withColumns({out: F.sum(c).over(Window.partitionBy(*keys)) for out, c in sums.items()})
    got = df.agg(*[F.sum(c).alias(out) for out, c in sums.items()]).first()
    kind = dict(df.agg(*[F.sum(c).alias(out) for out, c in sums.items()]).dtypes)
    return df.withColumns({out: F.lit(got[out]).cast(kind[out]) for out in sums})


def precision_at(df: DataFrame, keys: list[str], budgets: list[float] = BUDGETS, ceil: bool = False, counts: list[int] = (), y: str = "y", score: str = "score", order: str = "order") -> DataFrame:
    """``(keys..., budget, k, precision, recall)``: of the k best; k is at least 1, ``n * budget`` with floor or ceil, or a given count. Recall is null without positives."""
    ranked = running(totals(df.withColumn("__one", F.lit(1)), keys, {"__n": "__one", "__p": y}), keys, score, {"__r": "__one"}, True, order)
    cut = F.ceil if ceil else F.floor
    wanted = [F.struct(F.lit(float(b)).alias("budget"), F.greatest(F.lit(1), cut(F.round(F.col("__n") * float(b), 9))).cast("bigint").alias("k")) for b in budgets]
    wanted += [F.struct(F.lit(float(c)).alias("budget"), F.least(F.lit(c), F.col("__n")).cast("bigint").alias("k")) for c in counts]
    rows = ranked.select(*keys, y, "__r", "__p", F.explode(F.array(*wanted)).alias("b")).where("__r <= b.k")
    by = rows.groupBy(*keys, F.col("b.budget").alias("budget"), F.col("b.k").alias("k")).agg(F.sum(y).alias("hits"), F.max("__p").alias("p"))
    return by.select(*keys, "budget", "k", (F.col("hits") / F.col("k")).alias("precision"), F.when(F.col("p") > 0, F.col("hits") / F.col("p")).alias("recall"))


def curve(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """``(keys..., score, pos, neg, tp, fp, P, N)`` of each distinct score, best first."""
    by = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    return running(totals(by, keys, {"P": "pos", "N": "neg"}), keys, "score", {"tp": "pos", "fp": "neg"}, True)


def ranking(df: DataFrame, keys: list[str], max_fpr: float = 0.005, y: str = "y", score: str = "score") -> DataFrame:
    """``(keys..., prevalence, average_precision, roc_auc, recall_at_fpr)``: step-sum precision, tie-aware area, best recall within the rate."""
    c = curve(df, keys, y, score)
    return c.groupBy(*keys).agg(
        (F.max("P") / (F.max("P") + F.max("N"))).alias("prevalence"),
        F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"),
        F.sum(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("neg") * (F.col("tp") - F.col("pos") / 2) / (F.col("P") * F.col("N")))).alias("roc_auc"),
        F.coalesce(F.max(F.when((F.col("N") > 0) & (F.col("P") > 0) & (F.col("fp") / F.col("N") <= max_fpr), F.col("tp") / F.col("P"))), F.lit(0.0)).alias("recall_at_fpr"),
    )


def _ece(rows: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration_bins(df: DataFrame, keys: list[str], bins: int = 10, equal: str = "width", y: str = "y", score: str = "score", order: str = "order") -> DataFrame:
    """``(keys..., bin, n, mean_score, rate)`` for bins of equal width, or equal size with the first ones larger."""
    if equal == "width":
        rows = df.withColumn("bin", F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int"))
    else:
        rows = running(totals(df.withColumn("__one", F.lit(1)), keys, {"__n": "__one"}), keys, score, {"__r": "__one"}, False, order)
        size, more, k = F.floor(F.col("__n") / bins), F.col("__n") % bins, F.col("__r") - 1
        long = more * (size + 1)
        rows = rows.withColumn("bin", F.when(k < long, F.floor(k / (size + 1))).otherwise(more + F.floor((k - long) / F.greatest(size, F.lit(1)))).cast("int"))
    return _ece(rows, keys, y, score)


def ece(df: DataFrame, keys: list[str], bins: int = 10, equal: str = "width", **names: str) -> DataFrame:
    """``(keys..., ece, brier)``-style expected calibration error: the weighted gap between bins' scores and rates."""
    b = calibration_bins(df, keys, bins, equal, **names)
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))


def evaluate(df: DataFrame, keys: list[str], **names: str) -> DataFrame:
    """All metrics of a score in one row for each group."""
    base = {k: v for k, v in names.items() if k != "order"}
    at = precision_at(df, keys, **names)
    cols = [F.max(F.when(F.col("budget") == b, F.col(c))).alias(f"{c}_at_{b}") for b in BUDGETS for c in ("precision", "recall")]
    wide = at.groupBy(*keys).agg(*cols)
    out = ranking(df, keys, **base)
    one = ["__one"]  # without keys each part is a row
    out = out.withColumn("__one", F.lit(1))
    for more in (brier(df, keys, **base), ece(df, keys, **names), wide):
        out = out.join(more.withColumn("__one", F.lit(1)), [*keys, *one])
    return out.drop("__one")


def top_tail(df: DataFrame, keys: list[str], budgets: list[float] = BUDGETS, y: str = "y", score: str = "score", order: str = "order") -> DataFrame:
    """``(keys..., budget, k, mean_score, rate, gap, ratio)``: how the best ranked are calibrated."""
    ranked = running(totals(df.withColumn("__one", F.lit(1)), keys, {"__n": "__one"}), keys, score, {"__r": "__one"}, True, order)
    wanted = [F.struct(F.lit(float(b)).alias("budget"), F.greatest(F.lit(1), F.floor(F.round(F.col("__n") * float(b), 9))).cast("bigint").alias("k")) for b in budgets]
    rows = ranked.select(*keys, y, score, "__r", F.explode(F.array(*wanted)).alias("b")).where("__r <= b.k")
    by = rows.groupBy(*keys, F.col("b.budget").alias("budget"), F.col("b.k").alias("k")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate"))
    return by.withColumns({"gap": F.col("mean_score") - F.col("rate"), "ratio": F.when(F.col("rate") > 0, F.col("mean_score") / F.col("rate"))})


def by_masks(df: DataFrame, keys: list[str], masks: dict[str, object], least: int = 20, y: str = "y", **names: str) -> DataFrame:
    """Metrics of each overlapping cohort that has ``least`` rows and both classes."""
    rows = df.withColumn("cohort", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))))
    ok = rows.groupBy(*keys, "cohort").agg(F.count("*").alias("rows"), F.sum(y).alias("positives")).where(f"rows >= {least} and positives > 0 and positives < rows")
    scored = rows.join(F.broadcast(ok.select(*keys, "cohort")), [*keys, "cohort"], "left_semi")  # a row for each group
    return ok.join(ranking(scored, [*keys, "cohort"], y=y, **{k: v for k, v in names.items() if k == "score"}), [*keys, "cohort"])


def safe_evaluate(df: DataFrame, keys: list[str], least: int = 20, y: str = "y", **names: str) -> DataFrame:
    """``evaluate`` of the groups that have ``least`` rows and both classes; the others are left out."""
    ok = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(y).alias("positives")).where(f"rows >= {least} and positives > 0 and positives < rows")
    if not keys:
        return evaluate(df, keys, y=y, **names) if ok.limit(1).count() else evaluate(df.limit(0), keys, y=y, **names).limit(0)
    return ok.join(evaluate(df.join(ok.select(*keys), keys, "left_semi"), keys, y=y, **names), keys)


def ordered(table: DataFrame, by: list[str], descending: bool = True) -> DataFrame:
    """A summary, sorted for reading."""
    return table.orderBy(*[F.desc(c) if descending else F.asc(c) for c in by])
