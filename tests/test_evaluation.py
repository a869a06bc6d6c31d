"""Metrics, reranking, gains, bootstrap and models against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import bootstrap, gains, metrics, models, rerank, tails


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 1200
    y = rng.integers(0, 2, n) * (rng.random(n) < 0.5)
    score = np.round(np.clip(0.3 * y + 0.7 * rng.random(n), 0, 1), 2)  # many ties
    pdf = pd.DataFrame({"window": np.arange(n) % 3, "order": np.arange(n), "y": y.astype(int), "score": score, "second": np.round(rng.random(n), 2)})
    return spark.createDataFrame(pdf).cache(), pdf


def plain(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[s[1:] != s[:-1], True]
    tp, n = np.cumsum(y)[last], (np.arange(len(y)) + 1)[last]
    fp = n - tp
    p, q = y.sum(), len(y) - y.sum()
    ap = (np.diff(np.r_[0, tp]) * tp / n).sum() / p
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (p * q)
    ok = fp / q <= 0.05
    return ap, auc, (tp[ok] / p).max() if ok.any() else 0.0


def test_ranking_with_ties(scored):
    df, pdf = scored
    got = {r["window"]: r for r in metrics.ranking(df, ["window"], 0.05).collect()}
    for w, g in pdf.groupby("window"):
        ap, auc, rec = plain(g["y"].to_numpy(), g["score"].to_numpy())
        assert (got[w]["average_precision"], got[w]["roc_auc"], got[w]["recall_at_fpr"]) == pytest.approx((ap, auc, rec))
        assert bootstrap.average_precision(g["y"].to_numpy(float), g["score"].to_numpy()) == pytest.approx(ap)


def test_precision_floor_ceil_and_no_positives(spark, scored):
    df, pdf = scored
    g = pdf[pdf.window == 0].sort_values(["score", "order"], ascending=[False, True])
    for ceil, k in ((False, 2), (True, 3)):
        r = metrics.precision_at(df.where("window = 0"), [], [0.0059], ceil).first()
        assert (r["k"], r["precision"]) == (k, pytest.approx(g["y"][:k].mean()))
    none = metrics.precision_at(spark.createDataFrame([(1, 0, 0.5)], "order long, y int, score double"), [], [0.01]).first()
    assert (none["k"], none["precision"], none["recall"]) == (1, 0.0, None)


def test_calibration_errors(scored):
    df, pdf = scored
    bins = np.clip((pdf.score * 10).astype(int), 0, 9)
    want = sum(len(g) * abs(g.score.mean() - g.y.mean()) for _, g in pdf.groupby(bins)) / len(pdf)
    assert metrics.ece(df, []).first()["ece"] == pytest.approx(want)
    parts = np.array_split(pdf.sort_values(["score", "order"]), 10)
    want = sum(len(g) * abs(g.score.mean() - g.y.mean()) for g in parts) / len(pdf)
    assert metrics.ece(df, [], equal="size").first()["ece"] == pytest.approx(want)
    whole = metrics.evaluate(df, ["window"]).first()
    assert 0 < whole["brier"] < 1 and whole["precision_at_0.01"] is not None


def test_small_or_one_class_cohorts_are_left_out(scored):
    df, _ = scored
    got = metrics.by_masks(df, [], {"all": F.lit(True), "few": F.col("order") < 10, "one": F.col("y") == 1})
    assert [r["cohort"] for r in got.collect()] == ["all"]


def test_rerank_puts_the_tail_first(scored):
    df, pdf = scored
    rows = rerank.rerank(rerank.tail_mask(df, [], 0.1), [], "score", "second").toPandas()
    mask = pdf.score >= np.quantile(pdf.score, 0.9)
    pct = pdf.second[mask].rank(pct=True)
    want = pdf.score.copy()
    want[mask] = pdf.score[~mask].max() + 1 + pct
    assert np.allclose(rows.sort_values("order")["reranked"], want / want.max())


def test_running_sums_in_two_levels_equal_one_window(scored):
    df, pdf = scored
    for descending in (False, True):
        got = metrics.running(df.withColumn("one", F.lit(1)), [], "score", {"k": "one", "p": "y"}, descending, "order").toPandas().sort_values("k")
        want = pdf.sort_values(["score", "order"], ascending=[not descending, True])
        assert list(got["order"]) == list(want["order"]) and list(got["k"]) == list(range(1, len(pdf) + 1)) and list(got["p"]) == list(want["y"].cumsum())
    ranks = rerank.with_average_rank(df, [], "second", "r").toPandas().sort_values("order")["r"]
    assert np.allclose(ranks, pdf["second"].rank(pct=True))
    assert metrics.running(df.limit(0).withColumn("one", F.lit(1)), [], "score", {"k": "one"}).count() == 0


def test_groups_that_cannot_be_evaluated_are_left_out(scored):
    df, _ = scored
    odd = df.withColumn("g", F.when(F.col("order") < 10, "few").when(F.col("y") == 0, "one").otherwise("both")).withColumn("y", F.when(F.col("g") == "both", F.col("order") % 2).otherwise(F.col("y")))
    got = metrics.safe_evaluate(odd, ["g"]).collect()
    assert [r["g"] for r in got] == ["both"] and got[0]["precision_at_0.01"] is not None
    assert metrics.safe_evaluate(df, []).count() == 1 and metrics.safe_evaluate(df.where("y = 1"), []).count() == 0
    assert [r["g"] for r in metrics.ordered(odd.groupBy("g").count(), ["count"]).collect()][0] == "one"


def test_delta_mixtures_rank_some_trials_at_a_time(scored, monkeypatch):
    found = []
    for rows in (2500, 10**9):
        monkeypatch.setattr(tails, "MIXED", rows)
        weights, table = tails.delta_mixture(scored[0], "score", ["second"], (-0.5, 0.0, 0.5, 1.0, 1.5))
        found.append((weights, sorted(tuple(r) for r in table.collect()), len({f.rsplit("/", 1)[0] for f in table.inputFiles()})))
    assert found[0][:2] == found[1][:2] and len(found[0][1]) == 5 and (found[0][2], found[1][2]) == (3, 1)


def test_delta_mixtures_rank_rows_alike_once(scored, monkeypatch):
    """Rows of few distinct scores are ranked in arrays of what is distinct, ties at a cut-off by order; row by row gives the same."""
    from pyspark.sql.readwriter import DataFrameWriter

    df, labels, found = scored[0].withColumns({"score": F.round("score", 1), "second": F.round("second", 1)}), [], []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, **kwargs: labels.append(path.rsplit("/", 1)[-1].split("-")[0]) or write(self, path, *args, **kwargs))
    for sent in (10**9, 0):
        monkeypatch.setattr(tails, "SENT", sent, raising=False)
        weights, table = tails.delta_mixture(df, "score", ["second"], (-0.5, 0.0, 0.5, 1.0))
        found.append((weights, sorted(map(tuple, table.select("trial", "p1", "p05", "p2", "ap").collect()))))
    assert found[0][0] == found[1][0] and len(found[0][1]) == 4 and [x[:4] for x in found[0][1]] == [x[:4] for x in found[1][1]]
    assert [x[4] for x in found[0][1]] == pytest.approx([x[4] for x in found[1][1]]) and labels.count("ends") == 1


def test_delta_mixtures_equal_a_plain_grid(scored):
    df, pdf = scored
    weights, table = tails.delta_mixture(df.withColumn("third", 1 - F.col("second")), "score", ["second", "third"], (-0.5, 0.0, 1.0))
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    best = None
    for i, (a, b) in enumerate((a, b) for a in (-0.5, 0.0, 1.0) for b in (-0.5, 0.0, 1.0)):
        z = logit(pdf.score) + a * (logit(pdf.second) - logit(pdf.score)) + b * (logit(1 - pdf.second) - logit(pdf.score))
        s = np.round(1 / (1 + np.exp(-z)), 12)
        top = pdf.y.to_numpy()[np.lexsort((pdf.order, -s))]
        key = (top[:12].mean(), top[:6].mean(), round(plain(pdf.y.to_numpy(), s.to_numpy())[0], 9), -i)
        best = max(best or key, key)
        if best == key:
            want = {"second": a, "third": b}
    assert weights == want and table.count() == 9
    moved = df.withColumn("third", 1 - F.col("second")).select("order", tails.moved("score", {"second": 0.0, "third": 0.0}).alias("m"), "score").where("abs(m - score) > 1e-5")
    assert moved.count() == 0


def test_gates_choose_by_cohort(scored):
    df, pdf = scored
    rows = df.withColumns({"good": F.col("y") * 0.5 + 0.2, "cohort": F.when(F.col("order") % 3 == 0, "a").when(F.col("order") < 20, "few").otherwise("b"), "mix": F.when(F.col("order") % 3 == 0, F.col("y") * 0.9).otherwise(0.1)})
    got = {r["cohort"]: r["model"] for r in tails.gate_choice(rows, ["score", "good"]).collect()}
    assert got == {"a": "good", "b": "good", "few": "good"}
    got = {r["cohort"]: r["model"] for r in tails.gate_choice(rows.drop("good"), ["score", "mix"]).collect()}
    assert got["a"] == "mix"
    flags = rows.limit(3).select(tails.cohort_of(F.col("order") == 0, F.col("order") < 2).alias("c"), "order").orderBy("order")
    assert [r["c"] for r in flags.collect()] == ["C00_newedge", "known_endpoints", "other"]


def test_choice_by_validation_takes_the_first_best(spark):
    t = spark.createDataFrame([(0, 0.5, 0.2, 0.99), (1, 0.7, 0.1, 0.1), (2, 0.7, 0.1, 0.1), (3, 0.7, 0.05, 0.9)], "trial int, p1 double, p05 double, ap double")
    assert rerank.select_lexicographic(t, []).first()["trial"] == 1
    assert rerank.select_by_validation(t, [], "p1").first()["trial"] == 1


def test_gains_wins_and_success(spark):
    rows = [(w, m, v) for w in range(5) for m, v in (("base", 0.5), ("good", 0.5 + 0.01 * (w + 1)), ("mixed", 0.5 + (0.1 if w else -0.2)))]
    m = spark.createDataFrame(rows, "window int, model string, ap double")
    got = {r["model"]: r for r in gains.gain_table(m, "base", ["ap"]).collect()}
    assert (got["good"]["mean_gain_ap"], got["good"]["wins_ap"], got["mixed"]["wins_ap"]) == (pytest.approx(0.03), 5, 4)
    done = {r["comparison"]: r["success"] for r in gains.comparisons(m, [("a", "good", "base"), ("b", "base", "mixed")], ["ap"]).collect()}
    assert done == {"a": True, "b": False}
    c = gains.collapse(spark.createDataFrame([("x", 0.3)], "model string, g double"), spark.createDataFrame([("x", 0.1)], "model string, g double"), ["model"], "g").first()
    assert c["collapse"] == pytest.approx(0.2)
    assert gains.acceptance(spark.createDataFrame([(1.0, None)], "a double, b double"), {"x": "a > 0", "y": "b > 0"}).first()["accepted"] is False


def test_bootstrap_is_the_same_for_any_partitioning(scored):
    df, _ = scored
    a, b = (bootstrap.block_bootstrap(x, [], "score", "second", window="window", replicates=60, block=50, chunk=20).orderBy("metric").collect() for x in (df, df.repartition(7)))
    assert a == b and a[0]["replicates"] == 60 and a[0]["low"] <= a[0]["delta"] <= a[0]["high"]
    assert a[0]["low"] <= a[0]["mean"] <= a[0]["high"]
    assert bootstrap.block_bootstrap(df.limit(50), [], "score", "second", replicates=10).count() == 0
    assert bootstrap.block_bootstrap(df.where("y = 0"), [], "score", "second", replicates=10).count() == 0


@pytest.mark.parametrize(("keys", "window"), [([], "window"), ([], None), (["window"], None)])
def test_bootstrap_equals_rows_drawn_one_by_one(scored, keys, window):
    df, pdf = scored
    got = {(*[r[k] for k in keys], r["metric"]): r for r in bootstrap.block_bootstrap(df, keys, "score", "second", window=window, replicates=25, block=70, chunk=10).collect()}
    groups = [((k,), g) for k, g in pdf.groupby("window")] if keys else [((), pdf)]
    assert len(got) == 2 * len(groups)
    for key, g in groups:
        g = g.sort_values([*([window] if window else []), "order"])
        y, a, b = (g[c].to_numpy(float) for c in ("y", "score", "second"))
        parts = [np.flatnonzero(g["window"] == w) for w in range(3)] if window else [np.arange(len(g))]
        blocks = [[p[i : i + 70] for i in range(0, len(p), 70)] for p in parts]
        deltas = {"average_precision": [], "precision_at_1": []}
        for c in range(3):
            rng = np.random.default_rng([7, c])
            for _ in range(10 * c, min(25, 10 * c + 10)):
                at = np.concatenate([x[i] for x in blocks for i in rng.integers(0, len(x), len(x))])
                deltas["average_precision"].append(bootstrap.average_precision(y[at], a[at]) - bootstrap.average_precision(y[at], b[at]))
                deltas["precision_at_1"].append(bootstrap.precision_at(y[at], a[at], 0.01) - bootstrap.precision_at(y[at], b[at], 0.01))
        for metric, d in deltas.items():
            r = got[(*key, metric)]
            assert [r["mean"], r["low"], r["high"], r["replicates"]] == pytest.approx([np.mean(d), np.quantile(d, 0.025), np.quantile(d, 0.975), 25])


def test_bootstrap_copies_no_rows_for_its_draws(scored, spark):
    from test_size import shuffled

    def wrote(replicates):
        before = shuffled(spark)
        bootstrap.block_bootstrap(scored[0].repartition(4), [], "score", "second", window="window", replicates=replicates, chunk=2).collect()
        return shuffled(spark) - before

    assert wrote(40) < 4 * wrote(2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 1500
    x = rng.normal(size=n)
    c = np.where(rng.random(n) < 0.02, "rare", np.where(rng.random(n) < 0.5, "a", "b"))
    pdf = pd.DataFrame({"row_ord": np.arange(1, n + 1), "order": np.arange(n), "x": x, "z": rng.normal(size=n), "c": c, "y": (x + 0.3 * rng.normal(size=n) > 0.5).astype(int)})
    df = spark.createDataFrame(pdf)
    return df.withColumn("x", F.when(F.col("order") % 11 != 0, F.col("x"))).cache()


def test_models_learn_and_impute(rows):
    train, valid = rows.where("order < 900"), rows.where("order >= 900")
    p = models.Preprocess(["x", "z"], ["c"], 40).fit(train)
    assert p.common["c"] == ["a", "b"]
    for model in (models.gbt(p.transform(train), trees=5, depth=3), models.logistic(p.transform(train))):
        out = models.scored(model, p.transform(valid))
        assert metrics.ranking(out, []).first()["roc_auc"] > 0.85
    kept = models.screen(train, valid, {"x": ["x"], "z": ["z"], "broken": ["nothing"]}, keep=1, always=["z"])
    assert [k for k, _ in kept] == ["x", "z"]
    slope, _ = models.calibration_line(out)
    assert slope > 0


def test_out_of_fold_scores_come_from_earlier_rows(rows):
    folds = models.oof_folds(rows, 1500)
    assert {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()} == {0: 750, 1: 250, 2: 250, 3: 250}
    out = models.oof_scores(folds, ["x"], trees=3, depth=2)
    changed = folds.withColumn("y", F.when(F.col("fold") == 3, 1 - F.col("y")).otherwise(F.col("y")))
    again = models.oof_scores(changed, ["x"], trees=3, depth=2)
    pick = lambda d: sorted((r["row_ord"], r["oof"]) for r in d.select("row_ord", "oof").collect())
    assert pick(out) == pick(again) and len(pick(out)) == 750
    few = models.oof_scores(folds, ["x"], least=10_000)
    assert few.select("oof").distinct().count() == 3


def test_logistic_tail_helps_the_tail(rows):
    weak = rows.withColumn("score", F.round(1 / (1 + F.exp(-0.3 * F.coalesce("x", F.lit(0.0)) - F.col("z"))), 6))
    out, fraction = models.logistic_tail(weak.where("order < 900"), weak.where("order >= 900"), "score", ["x"], (0.2, 0.5))
    assert fraction in (0.2, 0.5)
    before = metrics.precision_at(out, [], [0.05]).first()["precision"]
    assert metrics.precision_at(out, [], [0.05], score="reranked").first()["precision"] >= before


def test_second_models_for_a_tail(rows):
    weak = rows.withColumn("base", F.round(1 / (1 + F.exp(-0.3 * F.coalesce("x", F.lit(0.0)) - F.col("z"))), 6)).cache()
    oof, valid, test = (weak.where(c).drop("row_ord") for c in ("order < 600", "order >= 600 and order < 1000", "order >= 1000"))
    before = metrics.precision_at(test, [], [0.05], score="base").first()["precision"]
    for transfer in (False, True):
        out, tail = tails.crossfit(oof, valid, test, "base", ["base"], ["x"], (0.2, 0.5), transfer=transfer)
        assert out.count() == 500 and set(test.columns) < set(out.columns) and {t["fraction"] for t in tail.trials} == {0.2, 0.5}
        cut = tail.cut if transfer else tails.cutoff(test, "base", tail.fraction)
        assert out.where("tail").count() == test.where(F.col("base") >= cut).count() and out.where("tail").agg(F.min("reranked")).first()[0] > out.where("not tail").agg(F.max("reranked")).first()[0]
        assert metrics.precision_at(out, [], [0.05], score="reranked").first()["precision"] >= before
    one = tails.crossfit(oof.withColumn("y", F.lit(0)), valid, test, "base", ["base"], ["x"])
    assert one[1] is None and one[0].where("reranked <> base or tail").count() == 0
    tail = tails.choose(oof, valid, "base", ["x"], (0.3,), ({"depth": 2, "least": 5, "trees": 3},), models.tail_trees)
    assert tail.params["depth"] == 2 and tail.apply(test).count() == 500
    fixed = tails.fixed(valid, test, "base", ["x"])
    cut = tails.cutoff(valid, "base", 0.2)
    assert fixed.where(F.col("base") < cut).where("replaced <> base").count() == 0 < fixed.where(F.col("base") >= cut).where("replaced <> base").count()


def test_trees_keep_the_rounds_of_least_loss(rows):
    p = models.Preprocess(["x", "z"]).fit(rows)
    train, valid = (p.transform(rows.where(c)) for c in ("order < 300", "order >= 300"))
    losses = models.gbt(train, trees=30, depth=4, rate=0.5).evaluateEachIteration(models.balanced(valid))
    best = losses.index(min(losses)) + 1
    model = models.best_rounds(train, valid, trees=30, depth=4, rate=0.5, patience=30)
    assert 1 <= len(model.trees) == best < 30 and models.scored(model, valid).where("score between 0 and 1").count() == valid.count()
    out = models.oof_scores(models.oof_folds(rows, 1500), ["x"], patience=2, trees=4, depth=2)
    assert out.count() == 750 and out.where("oof between 0 and 1").count() == 750


def test_cross_fitted_models_are_whole(monkeypatch):
    """Base scores of as many rounds as are best of 500, folds of 160, and all five fractions, trees of 180 rounds by two sizes."""
    from causeway.plans import queries

    class Rows:
        def __getattr__(self, name):
            return lambda *args: self

    seen = {}
    monkeypatch.setattr(queries, "_based", lambda spark, d, trees=8: (seen.update(trees=trees) or Rows(), ["x"]))
    monkeypatch.setattr(queries, "materialize", lambda df, label: df)
    monkeypatch.setattr(models, "oof_folds", lambda *args: Rows())
    monkeypatch.setattr(models, "oof_scores", lambda df, columns, **params: seen.update(fold=params) or Rows())
    monkeypatch.setattr(tails, "choose", lambda *args: seen.update(grid=args[5], fractions=args[4]))
    monkeypatch.setattr(tails, "meta", lambda df, scores, summaries: (df, []))
    monkeypatch.setattr(tails, "_unchanged", lambda test, base: test)
    for name in ("crossfit_trees", "crossfit_tail", "crossfit_transfer"):
        queries.QUERIES[name](None, "")
        assert seen["trees"] is None and seen["fold"]["trees"] == 160 and seen["fractions"] == (0.025, 0.05, 0.1, 0.2, 0.3)
        assert name != "crossfit_trees" or [(g["trees"], g["rate"]) for g in seen["grid"]] == [(180, 0.03)] * 2


def test_trees_stop_at_the_best_number_of_rounds(rows):
    p = models.Preprocess(["x", "z"], ["c"]).fit(rows)
    model, n = models.stopped_early(p.transform(rows.where("order < 900")), p.transform(rows.where("order >= 900")), trees=8, patience=2, first=2, depth=2)
    assert n in (2, 4, 8) and len(model.trees) == n
    found, params = models.fit_selected(p.transform(rows.where("order < 900")), p.transform(rows.where("order >= 900")), [{"trees": 2, "depth": 1}, {"trees": 3, "depth": 3}])
    assert len(found.trees) == params["trees"]
    importance = models.permutation_importance(model, p, rows.where("order >= 900"), ["x", "z"])
    assert importance[0][0] == "x"
