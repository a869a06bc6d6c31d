"""Green fields of candidate edges: a ``Scorer`` over the layers of each window.

The state before a row is a function of the rows before it, so candidates are independent of
each other given the edges.  Work is dealt by window, layer and slice: a slice lays out the
window's edges of its layer as arrays and solves its own candidates.  Windows are independent (cold
start) and of a fixed number of rows, which bounds a group, so that ``window_fields`` deals events by window alone; without a
window column the graph is one, and the slices alone spread the solves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalar import key, node
from causeway.operators.kernel import FieldConfig, Scorer
from causeway.spec import TransactionSpec


def fields(e: DataFrame, spec: TransactionSpec, config: FieldConfig, slices: int = 2, score_from: int | None = None, score_to: int | None = None) -> DataFrame:
    """``([window], row_ord, t, layer, <config.columns()>)`` of each edge, or of those with rank in ``[score_from, score_to)``.

    Rows outside that range still build the state (a warm start).  Only rows before a slice's last candidate bear on it;
    the edges travel once for each of the ``slices``.
    """
    names = config.columns()
    keep = spec.keys()
    order, time, label = spec.order, spec.time, spec.label

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([time, order], kind="stable")
        mine = ((frame[order] % slices) == frame["__slice"].iloc[0]).to_numpy()
        if score_from is not None:
            mine &= (frame[order] >= score_from).to_numpy()
        if score_to is not None:
            mine &= (frame[order] < score_to).to_numpy()
        at = np.flatnonzero(mine)
        scorer = Scorer(config, frame[time].to_numpy(), frame["a"].to_numpy(object), frame["b"].to_numpy(object), frame[label].to_numpy(float))
        found = pd.DataFrame(scorer.run(at), columns=names)
        head = frame.iloc[at][[*keep, order, time, "layer"]].reset_index(drop=True)
        return pd.concat([head, found], axis=1)

    rows = e.select(*keep, order, time, label, "layer", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__slice"))
    kind = {c: t for c, t in rows.dtypes}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in [*keep, order, time, "layer"]), *(f"`{c}` double" for c in names)])
    return rows.groupBy(*keep, "layer", "__slice").applyInPandas(run, schema)


def window_fields(tx: DataFrame, spec: TransactionSpec, config: FieldConfig, layers: list[str] | None = None) -> DataFrame:
    """``fields`` of all edges of a table of events with windows: an event travels once, as one row, and a window's relations are scored in one group."""
    names, keep = config.columns(), spec.keys(spec.order, spec.time)
    relations = [r for r in spec.relations if "--".join(r) in (layers or spec.layers()) and set(r) <= set(tx.columns)]
    columns, kind = list(dict.fromkeys(c for r in relations for c in r)), dict(tx.dtypes)
    name = lambda c: node(tx, c) if kind[c] in ("double", "float") else key(tx, c)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t = table[spec.time].to_numpy()
        order = np.lexsort((table[spec.order].to_numpy(), t))
        label, code, n = table["__label"].to_numpy(), {}, 0
        for c in columns:
            found = table[f"__{c}"].combine_chunks().dictionary_encode()
            code[c] = np.where(found.is_valid().to_numpy(False), found.indices.fill_null(0).to_numpy() + n, -1)
            n += len(found.dictionary)
        places, values = [np.empty(0, np.int64)], [np.empty((0, len(names)))]
        for a, b in relations:
            at = order[(np.minimum(code[a], code[b]) >= 0)[order]]
            places.append(at)
            values.append(Scorer(config, t[at], code[a][at], code[b][at], label[at]).run(np.arange(len(at))))
        layer = pa.chunked_array([pa.repeat("--".join(r), len(at)) for r, at in zip(relations, places[1:], strict=True)], pa.string())
        head, found = table.select(keep).take(pa.array(np.concatenate(places))), np.concatenate(values)
        return pa.table([*head.columns, layer, *[np.ascontiguousarray(x) for x in found.T]], [*keep, "layer", *names])

    rows = tx.select(*keep, F.col(spec.label).cast("double").alias("__label"), *[name(c).alias(f"__{c}") for c in columns])
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "layer string", *(f"`{c}` double" for c in names)])
    return rows.groupBy(*spec.keys()).applyInArrow(run, schema)


def two_ends(x: Column, ridge: float) -> dict[str, Column]:
    """Green values of a two-node graph of weight ``x``."""
    x, lam = x.cast("double"), F.lit(float(ridge))
    det = lam * (lam + 2 * x)
    return {"G_aa": (lam + x) / det, "G_bb": (lam + x) / det, "G_ab": x / det, "R_ab": 2 / (lam + 2 * x)}


def two_nodes(x: Column, a: Column, b: Column, n_a: Column, n_b: Column, ridge: float, alpha: float) -> dict[str, Column]:
    """``two_ends`` and the field, from history ``a, b`` and released counts of the ends: the closed form of radius 0."""
    g = two_ends(x, ridge)
    same, cross, r = g["G_aa"], g["G_ab"], g["R_ab"]
    x, lam = x.cast("double"), F.lit(float(ridge))
    s_a, s_b = lam * (same * a + cross * b), lam * (same * b + cross * a)
    move = (s_a - s_b) / (1 + r) * (same - cross)
    d_a, d_b = alpha + n_a, alpha + n_b
    both = (d_a + x) * (d_b + x) - x * x
    return g | {
        "S_left": s_a, "S_right": s_b, "TR_left": -move, "TR_right": move,
        "SD_left": ((d_b + x) * d_a * a + x * d_b * b) / both, "SD_right": ((d_a + x) * d_b * b + x * d_a * a) / both,
    }


def radius_zero(h: DataFrame, ridge: float, alpha: float, w: str = "w") -> DataFrame:
    """``two_nodes`` as columns beside ``H_left, H_right, n_0_left, n_0_right`` and the weight."""
    return h.withColumns(two_nodes(F.col(w), *[F.col(c) for c in ("H_left", "H_right", "n_0_left", "n_0_right")], ridge, alpha))


def edge_values(g: DataFrame, eps: float = 1e-12) -> DataFrame:
    """What is read off the Green values of each candidate edge, as columns beside ``G_aa, G_bb, G_ab`` and ``R_ab``."""
    aa, bb, ab, r = F.col("G_aa"), F.col("G_bb"), F.col("G_ab"), F.col("R_ab")
    return g.withColumns(
        {
            "logdet_edge": F.log1p(r), "fragility_diag_sum": aa + bb, "fragility_diag_max": F.greatest(aa, bb),
            "cross_ratio": ab / F.sqrt(F.greatest(aa * bb, F.lit(0.0)) + eps), "resistance_additive_gap": r - aa - bb,
        }
    )


def field_columns(left: str, right: str, raw_left: str, raw_right: str):
    """The S block: sum, max, min, difference and contrasts with raw history."""
    a, b = F.col(left), F.col(right)
    return {"sum": a + b, "max": F.greatest(a, b), "min": F.least(a, b), "diff": a - b, "absdiff": F.abs(a - b), "left_minus_raw": a - F.col(raw_left), "right_minus_raw": b - F.col(raw_right)}


def layer_aggregates(f: DataFrame, keys: list[str], left: str, right: str, prefix: str) -> DataFrame:
    """Over the endpoints of all layers of a row: sum, max and mean, and the layers' absolute differences."""
    a, b = F.col(left), F.col(right)
    return f.groupBy(*keys).agg(
        F.sum(a + b).alias(f"{prefix}_sum"), F.max(F.greatest(a, b)).alias(f"{prefix}_max"), (F.sum(a + b) / (2 * F.count(a))).alias(f"{prefix}_mean"),
        F.max(F.abs(a - b)).alias(f"{prefix}_absdiff_max"), F.avg(F.abs(a - b)).alias(f"{prefix}_absdiff_mean"),
    )


def array_aggregates(ends: Column, prefix: str) -> dict[str, Column]:
    """``layer_aggregates`` of a row's layers in an array of ``(a, b)``."""
    total = F.aggregate(ends, F.lit(0.0), lambda s, e: s + e["a"] + e["b"])
    gaps = F.transform(ends, lambda e: F.abs(e["a"] - e["b"]))
    return {
        f"{prefix}_sum": total, f"{prefix}_max": F.array_max(F.transform(ends, lambda e: F.greatest(e["a"], e["b"]))), f"{prefix}_mean": total / (2 * F.size(ends)),
        f"{prefix}_absdiff_max": F.array_max(gaps), f"{prefix}_absdiff_mean": F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(ends),
    }


def runtime_summary(f: DataFrame) -> DataFrame:
    """Solves, ego sizes and how many walks were cut, by layer."""
    return f.groupBy("layer").agg(F.count("*").alias("solves"), F.avg("ego_nodes").alias("ego_mean"), F.max("ego_nodes").alias("ego_max"), F.sum("over_cap").alias("over_cap"))
