"""The causal contract on tiny tables, and plans that do not look ahead."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.functions import scalar
from causeway.operators import assemble, audit, edges, green, history, states, temporal
from causeway.operators.cumulate import before
from causeway.operators.kernel import FieldConfig
from causeway.sources import sinks, tables
from causeway.spec import DAY, TransactionSpec

SPEC = TransactionSpec(relations=(("card", "addr"),), risk=("card--addr",))


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[0], *r[1:]) for r in rows], "row_ord long, tx_id long, t long, label int, card string, addr string, amount double")


def hist(df, delay):
    e = edges.edges(df, SPEC)
    h = history.field_h(history.history(e, edges.endpoints(e, SPEC), SPEC, [delay]), 0, 5)
    return {(r["row_ord"], r["side"]): r for r in h.collect()}


def test_missing_ends_make_no_edges(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 5.0, float("nan"), 1.0), (2, 2, 1, 0, 7.5, 3.0, 1.0), (3, 3, 2, 0, None, 3.0, 1.0)], "row_ord long, tx_id long, t long, label int, card double, addr double, amount double")
    got = [(r["a"], r["b"]) for r in edges.edges(df, SPEC).collect()]
    assert got == [("card=7.5", "addr=3")]
    text = spark.createDataFrame([(" x ",), ("",), ("  ",), (None,)], "card string")
    assert [r[0] for r in text.select(scalar.node(text, "card")).collect()] == ["card=x", None, None, None]


def test_delay_boundary_is_strict(spark):
    df = frame(spark, [(1, 0, 1, "c", "a", 1.0), (2, 86399, 0, "c", "a", 1.0), (3, 86400, 0, "c", "a", 1.0), (4, 86401, 0, "c", "a", 1.0)])
    got = hist(df, DAY)
    assert [got[k, "left"]["n_0"] for k in (1, 2, 3, 4)] == [0, 0, 0, 1]


def test_new_node_has_the_prior(spark):
    got = hist(frame(spark, [(1, 0, 1, "99", "77", 1.0)]), 0)[1, "left"]
    assert (got["H"], got["missing"], got["exposure_log"]) == (0, 1, 0)


def test_same_time_sees_the_same_state(spark):
    rows = [(1, 100, 1, "1", "10", 1.0), (2, 100, 0, "1", "11", 1.0), (3, 101, 0, "1", "12", 1.0)]
    got = hist(frame(spark, rows), 0)
    assert [got[k, "left"]["n_0"] for k in (1, 2, 3)] == [0, 0, 2]
    f = {r["row_ord"]: r for r in temporal.features(edges.edges(frame(spark, rows), SPEC), SPEC).collect()}
    assert [f[k]["count_a"] for k in (1, 2, 3)] == [0, 0, 2] and [f[k]["time_since_a"] for k in (1, 2, 3)] == [None, None, 1]


def test_temporal_states(spark):
    e = edges.edges(frame(spark, [(1, 1, 0, "a", "b", 9.0), (2, 2, 0, "a", "b", 99.0), (3, 3, 0, "a", "z", 1.0)]), SPEC)
    f = {r["row_ord"]: r for r in temporal.features(e, SPEC).collect()}
    assert [f[k]["edge_seen"] for k in (1, 2, 3)] == [0, 1, 0] and [f[k]["cohort"] for k in (1, 2, 3)] == ["C11", "C00_oldedge", "C10"]
    assert f[2]["delta_log_amt_mean"] == 0 and f[2]["time_since_edge"] == 1 and f[3]["degree_a"] == 1 and f[3]["count_velocity"] > 0


def test_future_rows_and_shuffles_change_nothing(spark):
    rows = [(i, (i // 3) * 7, i % 2, f"c{i % 5}", f"a{i % 4}", float(i)) for i in range(1, 60)]
    pick = lambda d: sorted(tuple(r) for r in temporal.features(edges.edges(d, SPEC), SPEC).where("row_ord <= 30").collect())
    base = pick(frame(spark, rows))
    assert pick(frame(spark, rows[::-1]).repartition(7)) == base
    assert pick(frame(spark, rows[:30])) == [r for r in base if r[1] < rows[30][1]] + [r for r in pick(frame(spark, rows[:30])) if r[1] >= rows[30][1]]


def test_neighbourhoods_are_looked_up_in_steps(spark, monkeypatch):
    rows = [(i, i // 3, "x", f"a{i % 7}", f"a{i * i % 11}") for i in range(1, 90)]
    e = spark.createDataFrame(rows, "row_ord long, t long, layer string, a string, b string")
    found = []
    for most in (100, 10**9):
        monkeypatch.setattr(temporal, "LOOKED_UP", most)
        n = temporal.neighborhood(e, SPEC)
        found.append((sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in n.collect()), len({f.rsplit("/", 1)[0] for f in n.inputFiles() if "/shared-" in f})))
    assert found[0][0] == found[1][0] and len(found[0][0]) == 89 and found[0][1] > 1 == found[1][1]


def test_neighbourhoods_are_looked_up_in_arrays(spark, monkeypatch):
    """Nothing of an edge's neighbours is shuffled; a graph too large to be sent is joined row by row and gives the same."""
    rows = [(i, i // 3, "xy"[i % 2], f"a{i % 7}" if i % 13 else None, f"a{i * i % 11}" if i % 17 else None) for i in range(1, 300)]
    e = spark.createDataFrame(rows, "row_ord long, t long, layer string, a string, b string")
    store, found = spark.sparkContext._jsc.sc().statusStore(), []
    shuffled = lambda: sum(x.totalShuffleWrite() for x in map(store.executorList(False).apply, range(store.executorList(False).size())))
    for sent in (10**9, 0):
        monkeypatch.setattr(temporal, "SENT", sent, raising=False)
        before = shuffled()
        n = temporal.neighborhood(e, SPEC)
        got = sorted((r[0], r[1], r[2], round(r[3], 9), round(r[4], 9)) for r in n.select("layer", *[c for c in n.columns if c != "layer"]).collect())
        found.append((shuffled() - before, got, n.dtypes))
    assert found[0][1:] == found[1][1:] and found[0][1] and max(r[2] for r in found[0][1]) > 2
    assert found[0][0] < found[1][0] / 2


def test_neighbourhood_of_any_graph(spark):
    rows = [(1, 1, "a", "m"), (2, 2, "b", "m"), (3, 3, "a", "n"), (4, 4, "b", "n"), (5, 5, "a", "b"), (6, 5, "b", "m")]
    e = spark.createDataFrame([(i, t, "x", a, b) for i, t, a, b in rows], "row_ord long, t long, layer string, a string, b string")
    got = {r["row_ord"]: r for r in temporal.neighborhood(e, SPEC).collect()}
    assert got[5]["common_neighbors"] == 2 and got[5]["jaccard"] == 1.0 and got[5]["adamic_adar"] == pytest.approx(2 / 0.6931471805599453)
    assert got[2]["common_neighbors"] == 0


def test_fields_do_not_depend_on_slices_or_partitions(spark):
    rows = [(i, (i // 4) * DAY, i % 2, f"c{i % 9}", f"a{i % 7}", 1.0) for i in range(1, 120)]
    e = edges.edges(frame(spark, rows), SPEC)
    config = FieldConfig(delays=(0, DAY), cap=8, panel=(("sqrt", 5.0, 1.0),), fallback_cap=4)
    a, b = (sorted(tuple(r) for r in green.fields(x, SPEC, config, s).collect()) for x, s in ((e, 1), (e.repartition(5), 4)))
    assert a == b and len(a) == len(rows)
    warm = green.fields(e, SPEC, config, 3, score_from=50, score_to=60).collect()
    assert sorted(tuple(r) for r in warm) == [r for r in a if 50 <= r[0] < 60]


def test_windows_are_independent(spark):
    rows = [(i, i, 1, "c", "a", 1.0) for i in range(1, 9)]
    df, spec = tables.with_window(frame(spark, rows), 4), replace(SPEC, window="window")
    e = edges.edges(df, spec)
    got = {r["row_ord"]: r["n_0"] for r in history.history(e, edges.endpoints(e, spec), spec, [0]).where("side = 'left'").collect()}
    assert [got[k] for k in range(1, 9)] == [0, 1, 2, 3, 0, 1, 2, 3]


@pytest.mark.parametrize("delays", [(0,), (0, DAY // 2, 40 * DAY), (3 * DAY,)])
def test_sums_before_now_in_blocks(spark, delays):
    """Rows over many blocks, ties, rows that only count, against all pairs."""
    rows = [(i, (i * i) % 97 * 3 * DAY + (i % 5) * DAY // 2, f"c{i % 3 if i % 4 else 0}", i % 7, i % 6 > 0) for i in range(1, 250)]
    df = spark.createDataFrame(rows, "row_ord long, t long, node string, x long, asked boolean")
    wants = {f"s{k}": ("sum", "x", d) for k, d in enumerate(delays)} | {"top": ("max", "x", 0)}
    got = {r["row_ord"]: tuple(r[w] for w in wants) for r in before(df, SPEC, ["node"], wants, F.col("asked")).collect()}
    want = {}
    for i, t, v, _, asked in rows:
        if asked:
            past = lambda d: [r[3] for r in rows if r[2] == v and r[1] + d < t]  # noqa: B023, E731
            want[i] = (*(sum(past(d)) for d in delays), max(past(0), default=None))
    assert got == want


def test_history_of_labels_that_are_missing(spark):
    rows = [(i, (i * i) % 97 * 5000, None if i % 13 == 0 else i % 2, f"c{i % 3 if i % 4 else 0}", f"a{i % 5}", 1.0) for i in range(1, 200)]
    e = edges.edges(frame(spark, rows), SPEC)
    for r in history.history(e, edges.endpoints(e, SPEC), SPEC, [0, DAY // 2, 3 * DAY], DAY).collect():
        k = 3 if r["side"] == "left" else 4
        for i, d in enumerate((0, DAY // 2, 3 * DAY)):
            out = [x for x in rows if x[2] is not None and x[1] + d < r["t"]]
            mine = [x for x in out if f"{('card', 'addr')[k - 3]}={x[k]}" == r["node"]]
            assert (r[f"n_{i}"], r[f"f_{i}"]) == (len(mine), sum(x[2] for x in mine)) and r[f"recent_{i}"] == sum(x[1] + d >= r["t"] - DAY for x in mine)
            assert r[f"rate_{i}"] == pytest.approx(sum(x[2] for x in out) / len(out) if out else 0.0)


def test_amounts_that_are_no_numbers(spark):
    """A null amount counts as 0; NaN makes later means of its nodes missing, and theirs alone."""
    rows = [(1, 1, 0, "a", "x", None), (2, 2, 0, "a", "y", float("nan")), (3, 3, 0, "a", "z", 5.0), (4, 4, 0, "b", "x", 5.0), (5, 5, 0, "b", "y", 1.0)]
    f = {r["row_ord"]: r for r in temporal.features(edges.edges(frame(spark, rows), SPEC), SPEC).collect()}
    assert [f[k]["amount_mean_a"] for k in (1, 2, 3)] == [None, 0.0, None]
    assert (f[4]["amount_mean_b"], f[5]["amount_mean_b"], f[5]["amount_mean_a"]) == (0.0, None, pytest.approx(1.791759469228055))


def test_row_order_and_split(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 13 * DAY // 2) for i in range(100)], "id long, t long")
    got = sorted((r["t"], r["id"], r["row_ord"]) for r in tables.with_row_order(df, "t", ["id"]).collect())
    assert [r[2] for r in got] == list(range(1, 101))
    split = tables.chronological_split(tables.with_row_order(df, "t", ["id"])).groupBy("split").agg(F.min("row_ord").alias("a"), F.max("row_ord").alias("b")).collect()
    assert {(r["split"], r["a"], r["b"]) for r in split} == {("train", 1, 60), ("valid", 61, 80), ("test", 81, 100)}


def test_sources_refuse_what_is_wrong(spark, tmp_path):
    with pytest.raises(ValueError, match="required"):
        SPEC.check(spark.createDataFrame([(1,)], "t long"))
    two = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    with pytest.raises(ValueError, match="not unique"):
        tables.join_one_to_one(spark.createDataFrame([(1,)], "id long"), two, "id")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read(spark, str(tmp_path), "nothing")


def test_sinks_carry_their_policy(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id long, x double")
    path = f"file://{tmp_path}/f"
    sinks.write_features(df, path, kind="green", delays_days=[0, 7], alphas=[5], ego_radius=2, max_ego_nodes=100)
    assert dict(spark.read.parquet(path).dtypes)["x"] == "float"
    assert sinks.causal_meta_ok(spark, path, delays_days=[0, 7]) and not sinks.causal_meta_ok(spark, path, delays_days=[0])
    assert sinks.footer(spark, path)["columns"] == {"id": "bigint", "x": "float"} and sinks.footer(spark, path)["policy"]["cache_version"] == "block_causal_v1"
    assert sinks.footer(spark, f"{path}-absent") == {"columns": {}, "policy": {}}
    with pytest.raises(ValueError, match="ego_radius"):
        sinks.write_features(df, path, kind="precision", delay_days=0, history_alpha=5, precision_alpha=5, max_ego_nodes=100)
    df.write.parquet(f"{path}2")
    assert not sinks.causal_meta_ok(spark, f"{path}2")
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy(F.desc("id")).repartition(3)) != sinks.content_digest(df.limit(1))


def test_a_cache_goes_by_its_sources_and_version(spark, tmp_path):
    source, path, made = tmp_path / "s.csv", f"file://{tmp_path}/c", []
    source.write_text("a\n1\n")

    def make():
        made.append(1)
        return spark.range(3)

    get = lambda **more: sinks.cached(spark, path, make, [f"file://{source}"], **more).count()
    assert (get(), get(), len(made)) == (3, 3, 1)
    get(version="2")
    source.write_text("a\n1\n2\n")
    get(version="2")
    assert len(made) == 3
    a = [sinks.predictions(spark, f"file://{tmp_path}/p", "m", cols, seed, make).count() for cols, seed in ((["x", "y"], 1), (["y", "x"], 1), (["x"], 1), (["x", "y"], 2))]
    assert a == [3] * 4 and len(made) == 6
    sinks.write_status(spark, f"file://{tmp_path}/status.json", "fields", rows=3)
    assert '"stage": "fields"' in (tmp_path / "status.json").read_text()


def test_csv_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,t,x\n3,5,1.5\n1,oops,NaN\n2,4,\n")
    df = tables.read_csv(spark, f"file://{tmp_path}/t.csv", required=["id", "t"])
    assert [tuple(r) for r in tables.coerced(df, ["x"], ["t"]).collect()] == [("3", 5.0, 1.5), ("1", 0.0, None), ("2", 4.0, None)]
    assert [r["id"] for r in tables.read_csv(spark, f"file://{tmp_path}/t.csv", "id int, t string, x string", max_rows=2).collect()] == [3, 1]
    with pytest.raises(ValueError, match="missing: y"):
        tables.read_csv(spark, f"file://{tmp_path}/t.csv", required=["id", "y"])
    for w in (0, 3):
        (tmp_path / f"window_{w}").mkdir()
        (tmp_path / f"window_{w}" / "summary.csv").write_text(f"model,ap\nm,{w}.5\n")
        (tmp_path / f"window_{w}" / "cohorts.json").write_text(f'{{"rows": {w}}}')
    assert sorted(tuple(r) for r in tables.glob_results(spark, f"file://{tmp_path}/window_*/summary.csv").collect()) == [("m", 0.5, 0), ("m", 3.5, 3)]
    assert sorted(tuple(r) for r in tables.glob_results(spark, f"file://{tmp_path}/window_*/cohorts.json", "json").collect()) == [(0, 0), (3, 3)]


def test_address_graph_files(spark, tmp_path):
    (tmp_path / "txs_features.csv").write_text("txId,Time step,f1\n10,1,0.5\n11,2,x\n12,2,\n")
    (tmp_path / "txs_classes.csv").write_text("txId,class\n10,1\n11,2\n99,1\n")
    (tmp_path / "AddrTx_edgelist.csv").write_text("input_address,txId\na,10\na,10\nb,11\nb,99\n")
    (tmp_path / "TxAddr_edgelist.csv").write_text("txId,output_address\n10,b\n11,c\n12,a\n")
    tx, ins, outs, features = tables.address_files(spark, f"file://{tmp_path}", f"file://{tmp_path}")
    assert sorted(tuple(r) for r in tx.collect()) == [(10, 1, 1), (11, 2, 2), (12, 2, 3)]
    assert sorted(tuple(r) for r in ins.collect()) == [(10, "a"), (11, "b")] and outs.count() == 3
    assert sorted((r["tx"], r["f1"]) for r in features.collect()) == [(10, 0.5), (11, None), (12, None)]
    from causeway.operators import address

    h = {r["tx"]: r for r in address.history(tx, ins, outs).collect()}
    assert h[12]["ell_addr_n_sum"] == 1 and h[11]["ell_h_max"] == pytest.approx((1 + 5) / 6)


def test_numbers_of_values(spark):
    df = spark.createDataFrame([(f"v{i % 37}" if i % 10 else None,) for i in range(200)], "v string")
    got = [tables.with_number(d, "v", "n", 8).collect() for d in (df, df.repartition(5))]
    code = [{r["v"]: r["n"] for r in rows} for rows in got]
    assert code[0] == code[1] and sorted(n for v, n in code[0].items() if v is not None) == list(range(len(code[0]) - 1)) and code[0][None] is None
    assert len(got[0]) == 200


def test_even_subsamples(spark):
    for n, most in ((10, 4), (1000, 37), (7, 7), (5, 9), (12, 1), (2, 2)):
        got = [r[0] for r in spark.range(1, n + 1).where(scalar.evenly(F.col("id"), n, most)).orderBy("id").collect()]
        want = list(range(1, n + 1)) if n <= most else [int(j * (n - 1) / (most - 1)) + 1 for j in range(most)] if most > 1 else [1]
        assert got == want


def test_audits_pass_or_fail_as_one(spark, tmp_path):
    df = frame(spark, [(i, (i // 2) * DAY // 4, i % 2, f"c{i % 5}", f"a{i % 3}", 1.0) for i in range(1, 60)])
    good, bad = f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    sinks.write_features(df, good)
    df.write.parquet(bad)
    ok, report = audit.audit(df, SPEC, DAY, {"good": good}, ['{"test_used_for_selection": false}'])
    assert ok and "FAIL" not in report and report.count("PASS") == 8
    ok, report = audit.audit(df, SPEC, DAY, {"good": good, "bad": bad, "none": f"{bad}2"}, ['{"x": {"test_used_for_selection": true}}'])
    assert not ok and "`provenance`: FAIL - bad, none" in report and "`selection`: FAIL - /x/test_used_for_selection" in report
    rows = {r["role"]: r for r in audit.provenance(spark, {"good": good, "bad": bad, "none": f"{bad}2"})}
    assert (rows["good"]["rows"], rows["bad"]["columns"], rows["none"]["exists"]) == (59, 7, False) and len(rows["bad"]["sha256"]) == 64
    assert [c["pass"] for c in audit.block_checks(spark)] == [True] * 4


def test_local_nodes_of_the_address_graph(spark):
    """Against a replay by plain dicts: own addresses first, then history, whatever the distance; cut ends keep their history."""
    import random

    import numpy as np

    from causeway.operators import address

    rng = random.Random(4)
    tx = [(i, i // 6 + 1, rng.choice([1, 2, 2, 3])) for i in range(60)]
    ins = [(i, f"s{rng.randrange(6)}") for i, _, _ in tx for _ in range(rng.randrange(0, 4))]
    outs = [(i, f"p{rng.randrange(9)}") for i, _, _ in tx for _ in range(rng.randrange(0, 5))]
    ins, outs = sorted(set(ins)), sorted(set(outs))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((tx, "tx long, step int, cls int"), (ins, "tx long, address string"), (outs, "tx long, address string"))]
    for cap in (3, 5, 100):
        got = {r["tx"]: r for r in address.exact_green(*frames, cap=cap).collect()}
        for i, step, _ in tx:
            past = [x for x in tx if x[1] < step]
            known = [x for x in past if x[2] != 3]
            p0 = sum(x[2] == 1 for x in known) / len(known) if known else 0.05
            of = lambda t: {a for x, a in ins + outs if x == t}
            n = lambda v: sum(v in of(x[0]) for x in known)  # noqa: B023, E731
            h = lambda v: (sum(v in of(x[0]) for x in known if x[2] == 1) + 5 * p0) / (n(v) + 5)  # noqa: B023, E731
            links = {frozenset((a, b)) for x in past for t, a in ins if t == x[0] for u, b in outs if u == x[0] and a != b}
            own = sorted(of(i))
            met, level = list(own), list(own)
            for _ in range(2):
                if len(met) >= 3 * cap:
                    break
                level = sorted({next(iter(k - {v})) for k in links for v in level if v in k} - set(met))
                met = [*met, *level][: max(3 * cap, len(own))]
                level = [v for v in level if v in met]
            rest = [v for v in met if v not in own]
            nodes = met if len(met) <= cap else own[:cap] + sorted(rest, key=lambda v: (-n(v), v))[: max(0, cap - len(own))]
            if not own:
                assert got[i]["ell_sd_mean"] == pytest.approx(p0) and got[i]["ell_green_nodes"] == 0
                continue
            at = {v: k for k, v in enumerate(nodes)}
            m = np.diag([5 + n(v) ** 0.5 for v in nodes])
            for k in links:
                a, b = sorted(k)
                if a in at and b in at:
                    m[[at[a], at[b]], [at[a], at[b]]] += 1
                    m[[at[a], at[b]], [at[b], at[a]]] -= 1
            s = np.linalg.solve(m, [(5 + n(v) ** 0.5) * h(v) for v in nodes])
            ends = [s[at[v]] if v in at else h(v) for v in own]
            assert got[i]["ell_sd_mean"] == pytest.approx(np.mean(ends)) and got[i]["ell_sd_max"] == pytest.approx(max(ends)), (cap, i)
            assert got[i]["ell_sd_absdiff_mean"] == pytest.approx(np.mean([abs(x - h(v)) for x, v in zip(ends, own, strict=True)])) and got[i]["ell_green_nodes"] == len(nodes)


def test_plans_do_not_look_ahead(spark):
    e = edges.edges(frame(spark, [(1, 0, 1, "c", "a", 1.0)]), SPEC)
    h = history.history(e, edges.endpoints(e, SPEC), SPEC, [0, DAY], 7 * DAY)
    assert audit.looks_ahead(h) == [] and audit.looks_ahead(temporal.features(e, SPEC)) == []
    from pyspark.sql import Window

    peeks = e.withColumn("x", F.count("*").over(Window.partitionBy("a").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)))
    assert audit.looks_ahead(peeks)


def test_permuted_labels_keep_their_number(spark):
    df = tables.with_window(frame(spark, [(i, i, int(i % 3 == 0), "c", "a", 1.0) for i in range(1, 41)]), 20)
    spec = replace(SPEC, window="window")
    a, b = (audit.permute_labels(df, spec, s) for s in (1, 2))
    count = lambda d: sorted(map(tuple, d.groupBy("window").agg(F.sum("label")).collect()))
    rows = lambda d: sorted(map(tuple, d.select("row_ord", "label").collect()))
    assert count(a) == count(df) == count(b) and rows(a) != rows(df) and rows(a) == rows(audit.permute_labels(df, spec, 1))


def test_made_up_events_are_the_same_for_any_partitioning(spark):
    from causeway.sources.synthetic import transactions

    a = transactions(spark)
    rows = sorted(map(str, a.collect()))
    assert len(rows) == 600 and rows == sorted(map(str, transactions(spark).repartition(7).collect()))
    times = [r["t"] for r in a.orderBy("row_ord").collect()]
    assert times == sorted(times) and 10 < a.agg(F.sum("label")).first()[0] < 200
    e = edges.edges(a, SPEC)
    assert green.fields(e, SPEC, FieldConfig(cap=10)).count() == 600


def test_gates_and_screens(spark):
    from causeway.operators import gains, rerank

    df = spark.createDataFrame([("a", 0.2, 0.8), ("b", 0.2, 0.8), ("c", 0.2, 0.8)], "cohort string, base double, other double")
    choice = spark.createDataFrame([("a", "other"), ("b", "base")], "cohort string, model string")
    got = {r["cohort"]: r["gated"] for r in rerank.cohort_gate(df, choice, ["cohort"], ["base", "other"], "base", 0.65).collect()}
    assert got == {"a": pytest.approx(0.65 * 0.8 + 0.35 * 0.2), "b": pytest.approx(0.2), "c": 0.2}
    assert df.select(rerank.logit_delta("base", "other", 1.0)).first()[0] == pytest.approx(0.8)
    m = spark.createDataFrame([(w, c, x, v) for w in range(2) for c in "ab" for x, v in (("l", 0.5 + w / 10), ("r", 0.4))], "window int, cohort string, model string, ap double")
    assert gains.margins(m, ["a"], "l", "r", "ap").first()["least_margin"] == pytest.approx(0.1)
    assert audit.selection_leaks('{"a": [{"test_used_for_selection": true}, {"test_used_for_selection": false}]}') == ["/a/0/test_used_for_selection"]


def test_names_and_merges(spark):
    cols = ["card--addr__d0_a5__S_left", "card--addr__d0_a5__SD_sqrt_left", "agg__count_velocity__max", "card__addr__count_a"]
    assert assemble.column_marker(cols, 0, 5, "S") == cols[:1]
    assert assemble.base_groups(cols)["cold"] == cols[2:]
    long = spark.createDataFrame([(1, 0, 0.5), (1, 7, 0.2), (2, 0, 0.1)], "k long, delay int, h double")
    assert sorted(map(tuple, assemble.delay_contrast(long, ["k"], "h", "delay", [(0, 7)]).collect())) == [(1, pytest.approx(0.3)), (2, None)]
    a, b = spark.createDataFrame([(1, 2)], "k long, x long"), spark.createDataFrame([(1, 3, 4)], "k long, x long, y long")
    assert assemble.merge_features(a, b, keys=["k"]).collect() == [(1, 2, 4)]
    t = scalar.tabular_features(spark.createDataFrame([(3600 * 30, -4.0, None)], "t long, amount double, c string"), "t", "amount", ["c"], ["c"], ["c"]).first()
    assert (t["hour"], t["relative_day"], t["log_amount"], t["c_missing"], t["identity_present"]) == (6.0, 1.0, 0.0, 1, 0)
    assert isinstance(t.asDict(), dict) and pd.isna(float("nan"))


@pytest.mark.parametrize("sent, heavy", [(10**6, 10**6), (0, 10**6), (0, 30)])
def test_states_of_events_equal_those_of_their_ends(spark, sent, heavy):
    """Whether columns are sent, shuffled or cut in blocks, the states are those that a row for each end gives."""
    rng = np.random.default_rng(5)
    spec = TransactionSpec(relations=(("p", "q"), ("p", "r"), ("q", "r")), risk=("p--q",), tick=10)
    pick = lambda of: of[int(rng.integers(0, len(of)))]
    rows = [(i, int(rng.integers(0, 400)), pick([1.0, 2.5, None]), pick([0, 1, None]), pick([1, 1, 1, 2, 3, None]), pick(["x", "y", " ", None]), pick([0.0, -0.0, 1.5, float("nan")])) for i in range(1, 161)]
    tx = spark.createDataFrame(rows, "row_ord long, t long, amount double, label int, p int, q string, r double")
    got = states.States(tx, spec, spec.layers(), states.wanted(spec, *states.TEMPORAL, "n", "f", delay=25), ("count", "last"), sent=sent, heavy=heavy).with_rates(25)
    e = edges.edges(tx, spec)
    show = lambda df, columns: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())
    want = temporal.features(e, spec)
    assert show(temporal.of_states(got), want.columns) == show(want, want.columns)
    both = history.both_sides(history.history(e, edges.endpoints(e, spec), spec, [25]), spec, ["n_0", "f_0", "rate_0"])
    assert show(got.long(), ["row_ord", "layer", "n_a", "n_b", "f_a", "f_b", "rate"]) == show(both, ["row_ord", "layer", "n_0_left", "n_0_right", "f_0_left", "f_0_right", "rate_0_left"])
    flags = temporal.row_aggregates(want, spec, ["count_a", "degree_b"])
    arrays = got.rows.select("row_ord", got.array().alias("e")).where("size(e) > 0")
    arrays = arrays.select("row_ord", *[c.alias(k) for k, c in (temporal.array_aggregates(F.col("e"), {"count_a": lambda e: e["count_a"], "degree_b": lambda e: e["degree_b"]}) | temporal.cohort_flags(F.col("e"))).items()])
    assert show(arrays, flags.columns) == show(flags, flags.columns)


def test_release_of_states_counts_each_row_that_differs(spark):
    tx = spark.createDataFrame([(i, 10 * (i // 3), 1.0, i % 2, "x", "y" if i % 4 else None) for i in range(1, 13)], "row_ord long, t long, amount double, label int, p string, q string")
    spec = TransactionSpec(relations=(("p", "q"),), risk=("p--q",), tick=10)
    s = states.States(tx, spec, spec.layers(), states.wanted(spec, "n", delay=5))
    assert audit.release_of_states(s, "n", 5).collect() == [(18, 0.0, 0)]
    s.rows = s.rows.withColumn("n_0_a", F.col("n_0_a") + (F.col("row_ord").isin(7, 8)).cast("int"))
    got = audit.release_of_states(s, "n", 5).first()
    assert got["rows"] == 18 and got["mismatches"] == 1 and got["max_gap"] > 0.01
