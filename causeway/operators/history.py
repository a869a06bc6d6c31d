"""Released history: what was known of each endpoint when a row came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.cumulate import before
from causeway.spec import TransactionSpec


def _counts(delays: list[int], names: tuple[str, str]) -> dict[str, tuple[str, str, int]]:
    return {f"{name}_{i}": ("sum", c, d) for i, d in enumerate(delays) for c, name in zip(("__n", "__f"), names, strict=True)}


def global_rates(e: DataFrame, spec: TransactionSpec, delays: list[int]) -> DataFrame:
    """``(layer, t, global_n_<i>, global_f_<i>)`` for each time that occurs; a transaction counts once in a layer."""
    keys = spec.keys("layer")
    by = e.groupBy(*keys, spec.time).agg(F.count(spec.label).alias("__n"), F.coalesce(F.sum(spec.label), F.lit(0)).alias("__f"))
    return before(by, spec, keys, _counts(delays, ("global_n", "global_f"))).drop("__n", "__f")


def history(e: DataFrame, ends: DataFrame, spec: TransactionSpec, delays: list[int], recent: int | None = None) -> DataFrame:
    """Endpoint rows with ``n_<i>, f_<i>`` (released count and positives), ``rate_<i>`` (the layer's, 0 if none), and ``recent_<i>``.

    A label is released once ``time + delay < now``; rows of one time never see each other.
    ``recent_<i>`` counts releases within ``recent`` before now, by release time, as the
    difference of two growing frames over one sort.
    """
    keys = spec.keys("layer", "node")
    wants = _counts(delays, ("n", "f"))
    if recent is not None:
        wants |= {f"__old_{i}": ("sum", "__n", d + recent) for i, d in enumerate(delays)}
    label = F.col(spec.label)
    rows = before(ends.withColumns({"__n": label.isNotNull().cast("bigint"), "__f": F.coalesce(label, F.lit(0))}), spec, keys, wants).drop("__n", "__f")
    if recent is not None:
        rows = rows.withColumns({f"recent_{i}": F.col(f"n_{i}") - F.col(f"__old_{i}") for i in range(len(delays))}).drop(*[f"__old_{i}" for i in range(len(delays))])
    return _with_rates(rows, e, spec, delays)


def _with_rates(rows: DataFrame, e: DataFrame, spec: TransactionSpec, delays: list[int]) -> DataFrame:
    rows = rows.join(global_rates(e, spec, delays), spec.keys("layer", spec.time))
    rates = {f"rate_{i}": F.when(F.col(f"global_n_{i}") > 0, F.col(f"global_f_{i}") / F.col(f"global_n_{i}")).otherwise(0.0) for i in range(len(delays))}
    return rows.withColumns(rates).drop(*[f"global_{x}_{i}" for x in "nf" for i in range(len(delays))])


def signal(f: Column, n: Column, rate: Column, alpha: float) -> Column:
    return (f + alpha * rate) / (n + alpha)


def field_h(h: DataFrame, i: int, alpha: float) -> DataFrame:
    """Endpoint rows with ``H``, ``H_raw`` (the rate if unseen), ``fraud_log``, ``exposure_log`` and ``missing`` of delay ``i``."""
    n, f, r = F.col(f"n_{i}"), F.col(f"f_{i}"), F.col(f"rate_{i}")
    return h.withColumns(
        {"H": signal(f, n, r, float(alpha)), "H_raw": F.when(n > 0, f / n).otherwise(r), "fraud_log": F.log1p(f.cast("double")), "exposure_log": F.log1p(n.cast("double")), "missing": (n == 0).cast("int")}
    )


def both_sides(h: DataFrame, spec: TransactionSpec, values: list[str]) -> DataFrame:
    """A row for each edge with ``<value>_left`` and ``<value>_right``."""
    keys = spec.keys(spec.order, spec.time, "layer")
    pick = lambda v, s: F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{v}_{s}")
    return h.groupBy(*keys).agg(*[pick(v, s) for v in ["node", *values] for s in ("left", "right")])
