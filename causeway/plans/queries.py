"""The registered queries of the event-table engine, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import scalar
from causeway.operators import address, assemble, audit, bootstrap, edges, gains, green, history, metrics, models, rerank, states, tails, temporal
from causeway.operators.kernel import FieldConfig
from causeway.sources import tables
from causeway.sources.shared import discard, materialize
from causeway.spec import DAY, EVENTS, LINES, MAX_NODES

WINDOW_ROWS = 10_000
#: The ego walk of registered graph queries: radius 2 under the default cap; the bounded ladder's; the address graph's.
FIELDS = FieldConfig(delays=(0, 7 * DAY), alphas=(5.0, 20.0), radius=2, cap=MAX_NODES)
BOUNDED = FieldConfig(delays=(DAY,), green=False, cap=MAX_NODES, fallback_cap=30)
ADDRESS_CAP = 50


def r6(c: str | Column, out: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(out or c)


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return tables.lines(spark, d)


def _edges(spark: SparkSession, d: str, layers=None) -> DataFrame:
    return edges.edges(_tx(spark, d), LINES, layers)


def _history(spark, d, delays, recent=None, layers=LINES.risk):
    e = _edges(spark, d, list(layers))
    return e, history.history(e, edges.endpoints(e, LINES), LINES, [x * DAY for x in delays], recent)


# ---------------------------------------------------------------- tables and projections


def tx_table(spark, d):
    return _tx(spark, d)


def edges_long(spark, d):
    return _edges(spark, d).drop("w")


def tabular(spark, d):
    f = scalar.tabular_features(_tx(spark, d), "t", "amount", ["brand", "segment"], present=["brand", "segment"])
    return f.select("row_ord", r6("log_amount"), r6("hour"), r6("hour_sin"), r6("hour_cos"), r6("relative_day"), "brand", "segment", "identity_present")


def entity_norm(spark, d):
    cu = tables.read(spark, d, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]).withColumn("whole", F.floor("c_acctbal").cast("double"))
    return cu.select("c_custkey", scalar.node(cu, "c_custkey").alias("id_node"), scalar.node(cu, "whole").alias("whole_node"), scalar.node(cu, "c_mktsegment").alias("segment_node"))


def chrono_split(spark, d):
    rows = tables.with_window(tables.chronological_split(_tx(spark, d)), WINDOW_ROWS)
    return rows.groupBy("window", "split").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.min("row_ord").alias("first"), F.max("row_ord").alias("last"))


# ---------------------------------------------------------------- released history


def _hist(delay: int, alpha: int):
    def query(spark, d):
        _, h = _history(spark, d, [delay])
        h = history.field_h(h, 0, alpha)
        return h.select("row_ord", "layer", "side", "node", r6("H"), r6("H_raw"), r6("fraud_log"), r6("exposure_log"), "missing")

    return query


def global_rate_by_layer(spark, d):
    g = history.global_rates(_edges(spark, d, list(LINES.risk)), LINES, [0, 7 * DAY])
    return g.select("layer", "t", *[F.col(f"global_{x}_{i}").cast("long").alias(f"{x}{i}") for x in "nf" for i in (0, 1)])


def recent_release_7d(spark, d):
    _, h = _history(spark, d, [3], 7 * DAY)
    return h.select("row_ord", "layer", "side", F.col("n_0").alias("n"), F.col("recent_0").alias("recent"))


def event_history(spark, d):
    e = edges.edges(tables.events(spark, d), EVENTS)
    h = history.field_h(history.history(e, edges.endpoints(e, EVENTS), EVENTS, [EVENTS.tick]), 0, 20)
    return h.select("row_ord", "side", "node", F.col("n_0").alias("n"), F.col("f_0").cast("long").alias("f"), r6("H"), "missing")


# ---------------------------------------------------------------- temporal features


def temporal_features(spark, d):
    f = temporal.of_states(_states(spark, d, states.TEMPORAL, ("count", "last"), LINES.layers()))
    whole = ("count_a", "count_b", "count_ab", "edge_seen", "time_since_a", "time_since_b", "time_since_edge", "degree_a", "degree_b", "degree_product")
    return f.select("row_ord", "layer", "cohort", *[F.col(c).cast("long").alias(c) for c in whole], r6("amount_mean_a"), r6("amount_mean_b"), r6("delta_log_amt_mean"), r6("count_velocity"))


def row_aggregates(spark, d):
    s = _states(spark, d, ("count", "degree"), ("count", "last"), LINES.layers())
    rows = s.rows.select("row_ord", "t", s.array().alias("e")).where(F.size("e") > 0)
    found = temporal.array_aggregates(F.col("e"), {"count_a": lambda e: e["count_a"], "degree_b": lambda e: e["degree_b"], "time_since_edge": lambda e: F.col("t") - e["last_ab"]})
    flags = temporal.cohort_flags(F.col("e"))
    order = ["cohort_any_C00_newedge", "cohort_any_C00_oldedge", "cohort_any_C10", "cohort_all_C11", "known_endpoints_all_edges"]
    return rows.select("row_ord", *[r6(c, k) for k, c in found.items()], *[flags[k].alias(k) for k in order])


def common_neighbors(spark, d):
    """Customers and parts in one id space: a graph that is not bipartite by column."""
    tx = _tx(spark, d)
    e = tx.select("row_ord", "t", F.lit("mix").alias("layer"), F.col("cust").cast("string").alias("a"), (F.col("supp") * 37 + F.col("size") * 11).cast("string").alias("b"))
    e = materialize(e, "edges")  # read six times; else the lines are put in order for each
    discard(tx)
    n = temporal.neighborhood(e, LINES)
    return n.groupBy("common_neighbors").agg(F.count("*").alias("n"), r6(F.sum("jaccard"), "jaccard"), r6(F.sum("adamic_adar"), "adamic_adar"))


# ---------------------------------------------------------------- fields of radius 0 and what follows from them


def _states(spark, d, names, pair=("count",), layers=LINES.risk, keep=(), delay=0):
    tx = _tx(spark, d)
    # States read the events that they wrote.
    return states.States(tx, LINES, list(layers), states.wanted(LINES, *names, delay=delay * DAY), pair, keep, done=lambda: discard(tx))


def _radius_zero(spark, d, alpha=5):
    g = _states(spark, d, ("n", "f")).with_rates(0).long()
    for x, s in (("a", "left"), ("b", "right")):
        n, f = F.col(f"n_{x}"), F.col(f"f_{x}")
        g = g.withColumns({f"n_0_{s}": n, f"H_{s}": history.signal(f, n, F.col("rate"), float(alpha)), f"H_raw_{s}": F.when(n > 0, f / n).otherwise(F.col("rate"))})
    return green.radius_zero(g.withColumn("w", F.col("count_ab")), 0.1, float(alpha))


def green_r0(spark, d):
    g = _radius_zero(spark, d)
    return g.select("row_ord", "layer", *[r6(c) for c in ("G_aa", "G_ab", "R_ab", "S_left", "S_right", "TR_left", "TR_right", "SD_left", "SD_right")])


def edge_amount_statistics(spark, d):
    s = _states(spark, d, ("count", "amount"), keep=("amount",)).long()
    mean = lambda x: F.when(F.col(f"count_{x}") > 0, F.col(f"amount_{x}") / F.col(f"count_{x}"))
    s = s.withColumns({"log_amount": scalar.log_amount(F.col("amount")), **{f"amount_mean_{x}": F.when(~F.isnan(mean(x)), mean(x)) for x in "ab"}, **green.two_ends(F.col("count_ab"), 0.1)})
    s = temporal.edge_contrasts(s.withColumn("delta_log_amt_mean", F.col("amount_mean_a") - F.col("amount_mean_b")))
    return s.select("row_ord", "layer", *[r6(c) for c in ("t_edge_amount", "t_endpoint_a_amount", "t_endpoint_b_amount", "t_endpoint_max_abs", "t_endpoint_sum_sq")])


def shrinkage(spark, d):
    g = _radius_zero(spark, d)
    out = {}
    for s in ("left", "right"):
        h, f, n = F.col(f"H_{s}"), F.col(f"S_{s}"), F.col(f"n_0_{s}").cast("double")
        out |= {f"SG_count_{s}": scalar.shrinkage(h, f, n, "count"), f"SG_sqrt_{s}": scalar.shrinkage(h, f, n, "sqrt"), f"PS_log1p_{s}": scalar.precision_screen(h, f, n, "log1p", 5), f"PS_sqrt_{s}": scalar.precision_screen(h, f, n, "sqrt", 20)}
    return g.select("row_ord", "layer", *[r6(c, k) for k, c in out.items()])


def layer_field_aggregates(spark, d):
    s = _states(spark, d, ("n", "f")).with_rates(0)

    def field(e):
        g = green.two_nodes(e["count_ab"], *[history.signal(e[f"f_{x}"], e[f"n_{x}"], e["rate"], 5.0) for x in "ab"], e["n_a"], e["n_b"], 0.1, 5.0)
        return F.struct(g["S_left"].alias("a"), g["S_right"].alias("b"))

    rows = s.rows.select("row_ord", F.transform(s.array(), field).alias("e")).where(F.size("e") > 0)
    return rows.select("row_ord", *[r6(c, k) for k, c in green.array_aggregates(F.col("e"), "S_all").items()])


def delay_contrast(spark, d):
    _, h = _history(spark, d, [0, 1, 7, 14])
    value = lambda i: history.signal(F.col(f"f_{i}"), F.col(f"n_{i}"), F.col(f"rate_{i}"), 5.0)
    return h.select("row_ord", "layer", "side", r6(value(0) - value(2), "contrast_0_minus_7"), r6(value(1) - value(3), "contrast_1_minus_14"))


def edge_resistance(spark, d):
    """The resistance block of candidate edges, at radius 0, where it has a closed form."""
    g = green.edge_values(_radius_zero(spark, d))
    return g.select("row_ord", "layer", *[r6(c) for c in ("logdet_edge", "fragility_diag_sum", "fragility_diag_max", "cross_ratio", "resistance_additive_gap")])


def field_block(spark, d):
    """Sums, extremes, differences and contrasts with raw history of the field of radius 0."""
    g = _radius_zero(spark, d)
    return g.select("row_ord", "layer", *[r6(c, f"S_{k}") for k, c in green.field_columns("S_left", "S_right", "H_raw_left", "H_raw_right").items()])


def precision_screens(spark, d):
    g = _radius_zero(spark, d)
    one = lambda rule, alpha, s: scalar.precision_screen(F.col(f"H_{s}"), F.col(f"S_{s}"), F.col(f"n_0_{s}").cast("double"), rule, alpha)
    return g.select("row_ord", "layer", *[r6(one(rule, alpha, s), f"SG_{rule}_a{alpha}_{s}") for rule, alpha in scalar.SCREENS for s in ("left", "right")])


def _exposed() -> dict[str, Column]:
    """Released counts and cohort flags of a row with its edges in ``e``."""
    side = lambda x: F.aggregate("e", F.lit(0).cast("bigint"), lambda n, e: n + e[f"n_{x}"])
    return scalar.exposure(side("a"), side("b")) | temporal.cohort_flags(F.col("e"))


def _exposure(spark, d) -> DataFrame:
    """``(row_ord, label, released counts, cohort flags)``."""
    s = _states(spark, d, ("count", "n"), keep=("label",))
    rows = s.rows.select("row_ord", "label", s.array().alias("e")).where(F.size("e") > 0)
    return rows.select("row_ord", "label", *[c.alias(k) for k, c in _exposed().items()])


def _strata() -> dict[str, Column]:
    return scalar.strata(F.col("released_count_left_sum"), F.col("released_count_right_sum"), F.col("known_endpoints_all_edges") == 1, F.col("cohort_any_C00_newedge") == 1)


def exposure_counts(spark, d):
    return _exposure(spark, d).select("row_ord", *scalar.exposure(F.lit(0), F.lit(0)))


def exposure_strata(spark, d):
    s = _exposure(spark, d).withColumn("stratum", F.explode(scalar.named(_strata())))
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), r6(F.avg("released_count_min"), "min_mean"), r6(F.avg("released_count_sum"), "sum_mean"))


def wide_history(spark, d):
    _, h = _history(spark, d, [0])
    both = history.both_sides(history.field_h(h, 0, 5), LINES, ["H"])
    w = assemble.to_wide(both, LINES, ["H_left", "H_right"], ["cust--brand", "supp--brand"], "d0_a5__")
    return w.select("row_ord", *[r6(F.col(f"`{c}`"), c.replace("--", "_")) for c in w.columns if c != "row_ord"])


# ---------------------------------------------------------------- metrics; the score is history itself


def _scored(s: states.States, k: int) -> DataFrame:
    """Rows of the relation ``k`` of states with rates: ``y``, ``score`` by its left end's history, and their edges in ``e``."""
    rows = s.rows.where(s.there(k)).withColumn("e", s.array())
    return rows.withColumns({"y": F.col("label"), "score": F.round(history.signal(F.col(f"f_{k}_a"), F.col(f"n_{k}_a"), F.col(f"rate_{k}"), 5.0), 9)})


def _scores(spark, d) -> DataFrame:
    """``(window, order, y, score, second)``: history of the customer, and of the brand, in the cust--brand layer."""
    s = _states(spark, d, ("n", "f"), (), ["cust--brand"], keep=("label",)).with_rates(0)
    of = lambda x: F.round(history.signal(F.col(f"f_0_{x}"), F.col(f"n_0_{x}"), F.col("rate_0"), 5.0), 9)
    rows = s.rows.where(s.there(0)).select("row_ord", F.col("label").alias("y"), of("a").alias("score"), of("b").alias("second"), F.col("n_0_a").alias("seen"))
    return tables.with_window(rows, WINDOW_ROWS).withColumnRenamed("row_ord", "order")


def p_at_k(spark, d):
    p = metrics.precision_at(_scores(spark, d), ["window"], [0.005, 0.01, 0.05])
    return p.select("window", "budget", "k", r6("precision"), r6("recall"))


def p_at_k_ceil(spark, d):
    p = metrics.precision_at(_scores(spark, d), ["window"], [0.01], ceil=True, counts=[100, 500])
    return p.select("window", "budget", "k", r6("precision"), r6("recall"))


def ranking_metrics(spark, d):
    r = metrics.ranking(_scores(spark, d), ["window"], 0.05)
    return r.select("window", *[r6(c) for c in ("prevalence", "average_precision", "roc_auc", "recall_at_fpr")])


def calibration(spark, d):
    s = _scores(spark, d)
    a = metrics.ece(s, ["window"]).withColumnRenamed("ece", "ece_width").join(metrics.ece(s, ["window"], equal="size").withColumnRenamed("ece", "ece_size"), "window")
    return a.join(metrics.brier(s, ["window"]), "window").select("window", r6("ece_width"), r6("ece_size"), r6("brier"))


def top_tail_calibration(spark, d):
    t = metrics.top_tail(_scores(spark, d), ["window"], [0.01, 0.05])
    return t.select("window", "budget", "k", *[r6(c) for c in ("mean_score", "rate", "gap", "ratio")])


def cohort_metrics(spark, d):
    seen = F.col("seen")
    m = metrics.by_masks(_scores(spark, d), ["window"], {"cold": seen == 0, "low": (seen > 0) & (seen <= 5), "seen": seen > 0, "all": F.lit(True)})
    return m.select("window", "cohort", "rows", F.col("positives").cast("long").alias("positives"), r6("average_precision"), r6("roc_auc"))


def strata_metrics(spark, d):
    """Metrics of a score in each stratum of released counts."""
    s = _states(spark, d, ("count", "n", "f"), keep=("label",)).with_rates(0)
    rows = _scored(s, 0).select("y", "score", *[c.alias(k) for k, c in _exposed().items()])
    m = metrics.by_masks(rows, [], _strata())
    return m.select("cohort", "rows", F.col("positives").cast("long").alias("positives"), r6("average_precision"), r6("roc_auc"))


def cohort_seven(spark, d):
    """Metrics of a score in each of the seven cohorts."""
    s = _states(spark, d, ("count", "n", "f"), keep=("label", "brand", "segment")).with_rates(0)
    flags = temporal.cohort_flags(F.col("e")) | {"identity_present": (F.col("brand").isNotNull() & F.col("segment").isNotNull()).cast("int")}
    rows = _scored(s, 0).select("y", "score", *[c.alias(k) for k, c in flags.items()])
    masks = scalar.cohorts({c: F.col(c) for c in ("known_endpoints_all_edges", "cohort_any_C00_newedge", "cohort_any_C10", "cohort_all_C11", "identity_present")})
    m = metrics.by_masks(rows, [], masks)
    return m.select("cohort", "rows", F.col("positives").cast("long").alias("positives"), r6("average_precision"), r6("roc_auc"))


def _valid(spark, d) -> DataFrame:
    """Scores of the rows on which choices are made, with two more scores and a cohort."""
    rows = tables.chronological_split(_scores(spark, d), "order", n=tables.read(spark, d, "lineitem", ["l_orderkey"]).count()).where("split = 'valid'")
    cohort = F.when(F.col("seen") == 0, "cold").when(F.col("seen") <= 5, "low").otherwise("seen")
    return rows.withColumns({"mean": F.round((F.col("score") + F.col("second")) / 2, 9), "most": F.greatest("score", "second"), "cohort": cohort}).withColumnRenamed("score", "left")


def delta_mixture(spark, d):
    """How the best of 6^3 mixtures of logit differences ranks the validation rows."""
    _, table = tails.delta_mixture(_valid(spark, d), "left", ["second", "mean", "most"])
    return rerank.select_lexicographic(table, []).select(F.col("trial").cast("int").alias("trial"), *[r6(c) for c in ("p1", "p05", "ap")])


def gate_choice(spark, d):
    return tails.gate_choice(_valid(spark, d), ["left", "second", "mean", "most"]).select("cohort", "model", *[r6(c) for c in ("p1", "p05", "ap")])


def robust_gate_choice(spark, d):
    return tails.gate_choice(_valid(spark, d), ["left", "second", "mean", "most"], robust=0.65).select("cohort", "model", *[r6(c) for c in ("p1", "p05", "ap")])


def reranked(spark, d):
    rows = rerank.rerank(rerank.tail_mask(_scores(spark, d), ["window"], 0.2), ["window"], "score", "second")
    return rows.select("window", "order", "tail", r6("reranked"))


def mixture_selected(spark, d):
    t = rerank.trials(rerank.mixture_grid(_scores(spark, d), ["window"], ["score", "second"], (0.0, 0.5, 1.0)), ["window"])
    best = rerank.select_lexicographic(t.withColumn("ap", F.round("ap", 9)), ["window"])
    return best.select("window", "trial", *[r6(c) for c in ("p1", "p05", "ap")])


def _models(spark, d) -> DataFrame:
    s = _scores(spark, d).withColumns({"mean": (F.col("score") + F.col("second")) / 2, "most": F.greatest("score", "second")})
    rows = s.select("window", "order", "y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(F.col(c), 9).alias("score")) for m, c in (("left", "score"), ("right", "second"), ("mean", "mean"), ("most", "most"))])).alias("x"))
    return metrics.ranking(rows.select("window", "order", "y", "x.model", "x.score"), ["window", "model"])


def gain_table(spark, d):
    g = gains.gain_table(_models(spark, d), "right", ["average_precision", "roc_auc"])
    return g.select("model", "windows", r6("mean_gain_average_precision"), r6("mean_gain_roc_auc"), F.col("wins_average_precision").cast("long").alias("wins_ap"), F.col("wins_roc_auc").cast("long").alias("wins_roc"))


def comparisons(spark, d):
    g = gains.comparisons(_models(spark, d), [("mean vs left", "mean", "left"), ("most vs right", "most", "right")], ["average_precision"])
    return g.select("comparison", "windows", r6("mean_gain_average_precision"), F.col("wins_average_precision").cast("long").alias("wins"), "success")


# ---------------------------------------------------------------- audits


def tie_audit(spark, d):
    tx = _tx(spark, d)
    return audit.ties(tx, edges.endpoints(edges.edges(tx, LINES, list(LINES.risk)), LINES), LINES)


def release_audit(spark, d):
    return audit.release_of_states(_states(spark, d, ("n",), (), delay=7), "n", 7 * DAY).select("rows", r6("max_gap"), "mismatches")


def placebo_labels(spark, d):
    tx = tables.with_window(_tx(spark, d), WINDOW_ROWS)
    from dataclasses import replace

    p = audit.permute_labels(tx, replace(LINES, window="window"), 17)
    return p.select("row_ord", "window", F.col("label").cast("long").alias("label"))


def warm_and_cold(spark, d):
    """Exposure with the state of all earlier rows, and with that of the row's own window only."""
    from dataclasses import replace

    tx = tables.with_window(_tx(spark, d), WINDOW_ROWS)
    out = None
    for name, spec in (("warm", LINES), ("cold", replace(LINES, window="window"))):
        e = edges.edges(tx, spec, ["cust--brand"])
        h = history.history(e, edges.endpoints(e, spec), spec, [0]).select("row_ord", "side", F.col("n_0").alias(name))
        out = h if out is None else out.join(h, ["row_ord", "side"])
    return out


# ---------------------------------------------------------------- address graph


def bipartite_pairs(spark, d):
    p = address.pairs(*tables.bipartite(spark, d))
    return p.groupBy("step").agg(F.count("*").alias("edges"), F.countDistinct("tx").alias("txs"), F.countDistinct("a").alias("inputs"), F.countDistinct("b").alias("outputs"))


def addr_history(spark, d):
    h = address.history(*tables.bipartite(spark, d))
    whole = ("ell_addr_n_sum", "ell_addr_n_max", "ell_endpoint_count")
    return h.select("tx", *[r6(c) for c in ("ell_h_mean", "ell_h_max", "ell_h_min", "ell_h_std", "ell_prior_rate")], *[F.col(c).cast("long").alias(c) for c in whole])


def addr_step_split(spark, d):
    tx, _, _ = tables.bipartite(spark, d)
    return tx.groupBy(tables.step_split(F.col("step")).alias("split")).agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step").alias("last"), F.sum((F.col("cls") == 1).cast("long")).alias("positives"))


def addr_numbers(spark, d):
    """How many distinct addresses there are, and that their numbers are as many and dense."""
    _, ins, outs = tables.bipartite(spark, d)
    n = tables.with_number(ins.union(outs).select("address"), "address", "k")
    return n.agg(F.countDistinct("address").alias("addresses"), F.countDistinct("k").alias("numbers"), F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("rows"))


def addr_one_hop(spark, d):
    return address.one_hop(*tables.bipartite(spark, d)).select("tx", r6("ell_s_mean"), r6("ell_s_max"))


def addr_exact_green(spark, d):
    return address.exact_green(*tables.bipartite(spark, d), cap=ADDRESS_CAP)


# ---------------------------------------------------------------- fields of radius 2, models, streams: not for SQL


def _windowed(spark, d):
    from dataclasses import replace

    return tables.with_window(_tx(spark, d), WINDOW_ROWS), replace(LINES, window="window")


def green_r2(spark, d):
    return green.window_fields(*_windowed(spark, d), FIELDS, list(LINES.risk))


def resistance_r2(spark, d):
    """All ten values of the resistance block on the whole neighbourhood, with ``ego_nodes``."""
    return green.window_fields(*_windowed(spark, d), FieldConfig(alphas=(5.0,), cap=MAX_NODES, resistance=True), list(LINES.risk))


def precision_r2(spark, d):
    config = FieldConfig(delays=(0,), green=False, cap=MAX_NODES, panel=(("sqrt", 5.0, 1.0), ("count", 5.0, 1.0), ("log1p", 5.0, 0.5), ("recent", 5.0, 1.0)), posterior=True, recent=7 * DAY)
    return green.window_fields(*_windowed(spark, d), config, list(LINES.risk))


def bounded_r2(spark, d):
    return green.window_fields(*_windowed(spark, d), BOUNDED, list(LINES.risk))


def _model_rows(spark, d) -> DataFrame:
    """History of both ends of each relation and an event's own columns, a written table that models read many times."""
    s = _states(spark, d, ("n", "f"), (), keep=("label", "amount", "status")).with_rates(0)
    wide = {}
    for k, layer in enumerate(s.names):
        side = {x: (F.col(f"n_{k}_{x}"), F.col(f"f_{k}_{x}")) for x in "ab"}
        found = {"H_left": history.signal(*reversed(side["a"]), F.col(f"rate_{k}"), 5.0), "H_right": history.signal(*reversed(side["b"]), F.col(f"rate_{k}"), 5.0)}
        found |= {"exposure_log_left": F.log1p(side["a"][0].cast("double")), "exposure_log_right": F.log1p(side["b"][0].cast("double"))}
        wide |= {f"{layer}__d0_a5__{c}".replace("--", "_"): F.when(s.there(k), v) for c, v in found.items()}
    some = F.greatest(*[s.there(k) for k in range(len(s.names))])
    rows = s.rows.where(some).select("row_ord", *[v.alias(c) for c, v in wide.items()], F.col("label").alias("y"), scalar.log_amount(F.col("amount")).alias("log_amount"), "status")
    return tables.chronological_split(materialize(rows, "model"))


def _features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "__" in c or c == "log_amount"]


def _based(spark, d, trees: int | None = 8) -> tuple[DataFrame, list[str]]:
    """Rows with ``base``, the score of trees that were fitted on the training rows, and the columns these had; without ``trees`` these are those of ``gbt_scores``."""
    rows = _model_rows(spark, d)
    train = rows.where("split = 'train'")
    p = models.Preprocess(_features(rows), ["status"]).fit(train)
    model = models.gbt(p.transform(train), trees=trees, depth=3) if trees else models.stopped_early(p.transform(train), p.transform(rows.where("split = 'valid'")), **models.FULL)[0]
    based = models.scored(model, p.transform(rows), "base").drop("features").withColumnRenamed("row_ord", "order")
    return materialize(based, "based"), _features(rows)


def gbt_scores(spark, d):
    """Boosted trees of up to 500 rounds, as many as rank the validation rows best."""
    rows = _model_rows(spark, d)
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    p = models.Preprocess(_features(rows), ["status"]).fit(train)
    model, _ = models.stopped_early(p.transform(train), p.transform(valid), **models.FULL)
    return models.scored(model, p.transform(rows)).select("row_ord", "split", "y", "score")


def logistic_tail(spark, d):
    rows, columns = _based(spark, d)
    out, _ = models.logistic_tail(rows.where("split = 'valid'"), rows.where("split = 'test'"), "base", columns, (0.1, 0.2))
    return out.select("order", "y", F.col("base").alias("score"), "tail", "reranked")


def _crossfit(kind: str, transfer: bool):
    def query(spark, d):
        rows, columns = _based(spark, d, None)
        train = rows.where("split = 'train'").drop("base")
        folds = models.oof_folds(train, train.count(), "order")
        scored = models.oof_scores(folds, columns, patience=models.FOLD_PATIENCE, order="order", **models.FOLD)
        oof = materialize(scored.withColumnRenamed("oof", "base").drop("fold", "weight"), "oof")
        out, _ = tails.crossfit(oof, rows.where("split = 'valid'"), rows.where("split = 'test'"), "base", ["base"], columns, tails.FRACTIONS, kind, transfer)
        return out.select("order", "y", "base", "tail", "reranked")

    return query


def tree_tail(spark, d):
    rows, columns = _based(spark, d)
    out, _ = tails.split_half(rows.where("split = 'valid'"), rows.where("split = 'test'"), "base", ["base"], columns, (0.2,))
    return out.select("order", "y", "base", "tail", "reranked")


def fixed_tail(spark, d):
    rows, columns = _based(spark, d)
    return tails.fixed(rows.where("split = 'valid'"), rows.where("split = 'test'"), "base", columns).select("order", "y", "base", "replaced")


def gated_scores(spark, d):
    """Test rows' scores by the model that their cohort's validation rows choose."""
    rows = tables.chronological_split(_scores(spark, d), "order", n=tables.read(spark, d, "lineitem", ["l_orderkey"]).count())
    cohort = F.when(F.col("seen") == 0, "cold").when(F.col("seen") <= 5, "low").otherwise("seen")
    rows = rows.withColumn("cohort", cohort)
    choice = tails.gate_choice(rows.where("split = 'valid'"), ["score", "second"])
    return rerank.cohort_gate(rows.where("split = 'test'"), choice, ["cohort"], ["score", "second"], "score").select("order", "cohort", "y", r6("gated"))


def oof_scores(spark, d):
    rows = _model_rows(spark, d)
    folds = models.oof_folds(rows, rows.count())
    return models.oof_scores(folds, _features(rows), trees=4, depth=3).select("row_ord", "fold", "y", "oof")


def block_bootstrap(spark, d):
    return bootstrap.block_bootstrap(_scores(spark, d), [], "score", "second", window="window", replicates=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tx_table, edges_long, tabular, entity_norm, chrono_split, global_rate_by_layer, recent_release_7d, event_history, temporal_features, row_aggregates, common_neighbors, green_r0, edge_amount_statistics, shrinkage, layer_field_aggregates,
        delay_contrast, exposure_strata, wide_history, p_at_k, p_at_k_ceil, ranking_metrics, calibration, top_tail_calibration, cohort_metrics, reranked, mixture_selected, gain_table, comparisons, tie_audit, release_audit,
        edge_resistance, field_block, precision_screens, exposure_counts, strata_metrics, cohort_seven, delta_mixture, gate_choice, robust_gate_choice, gated_scores, tree_tail, fixed_tail, addr_step_split, addr_numbers, resistance_r2,
        placebo_labels, warm_and_cold, bipartite_pairs, addr_history, addr_one_hop, addr_exact_green, green_r2, precision_r2, bounded_r2, gbt_scores, logistic_tail, oof_scores, block_bootstrap,
    )
} | {"crossfit_tail": _crossfit("logistic", False), "crossfit_transfer": _crossfit("logistic", True), "crossfit_trees": _crossfit("trees", False), "hist_d0_a5": _hist(0, 5), "hist_d7_a20": _hist(7, 20)}
