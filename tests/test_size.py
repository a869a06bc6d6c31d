"""What queries write to shuffles, which is what grows to the limit of a disk."""

import pytest

from causeway.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
#: Bytes a line of ``lineitem`` that a query may write to shuffles; each wrote more when its edges' ends were rows of their own.
MOST = {"layer_field_aggregates": 600, "cohort_seven": 600, "edge_amount_statistics": 600, "exposure_counts": 600, "exposure_strata": 600, "field_block": 600, "green_r0": 600, "precision_screens": 600, "row_aggregates": 1000, "shrinkage": 600, "strata_metrics": 600, "temporal_features": 1000, "release_audit": 700}


def shuffled(spark) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("name", sorted(MOST))
def test_a_line_is_not_shuffled_once_for_each_end(spark, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    before = shuffled(spark)
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert (shuffled(spark) - before) / lines <= MOST[name]


def test_rows_of_models_are_written_once(spark):
    from causeway.plans import queries

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    before = shuffled(spark)
    rows = queries._model_rows(spark, SF)
    rows.count(), rows.agg({"log_amount": "sum"}).collect()
    assert (shuffled(spark) - before) / lines <= 600 and rows.columns[0] == "row_ord" and len(rows.columns) == 21


@pytest.mark.parametrize("name", ["exposure_strata", "green_r0", "precision_screens", "shrinkage"])
def test_joined_lines_are_written_once_and_go(spark, name, monkeypatch):
    from pathlib import Path

    from causeway.plans import queries

    seen, tx = [], queries._tx
    monkeypatch.setattr(queries, "_tx", lambda *args: seen.append(tx(*args)) or seen[-1])
    QUERIES[name](spark, SF)
    (lines,) = seen
    assert not any("testdata" in f for f in lines.inputFiles())
    assert not Path(str(lines._causeway_path.toUri().getPath())).exists()


@pytest.mark.parametrize("name", ["exposure_strata", "precision_screens", "shrinkage"])
def test_no_write_shuffles_most_of_what_is_shuffled(spark, name, monkeypatch):
    """Many lines are joined and ranked in parts, and the states of a shuffled column are written before the next one's shuffle."""
    from pyspark.sql.readwriter import DataFrameWriter

    from causeway.operators import states
    from causeway.sources import tables

    want = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(tables, "AT_ONCE", 1000, raising=False)
    monkeypatch.setattr(states.States.__init__, "__defaults__", ((), (), 10_000, states.HEAVY, None))
    sizes, write = [], DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        before = shuffled(spark)
        write(self, path, *args, **kwargs)
        sizes.append(shuffled(spark) - before)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    before = shuffled(spark)
    assert sorted(map(tuple, QUERIES[name](spark, SF).collect())) == want
    sizes.append(shuffled(spark) - before - sum(sizes))
    assert max(sizes) <= 0.4 * sum(sizes)


@pytest.mark.parametrize("name", ["crossfit_tail"])
def test_second_models_read_rows_that_are_scored_once(spark, name):
    found = QUERIES[name](spark, SF.replace("0.01", "0.001"))
    assert {f.split("/")[-2].split("-")[0] for f in found.inputFiles()} <= {"based", "tail"}


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_sums_over_neighbours_in_blocks(spark, blocks):
    import random

    from causeway.operators import address

    rng = random.Random(blocks)
    steps = {a: sorted(rng.sample(range(1, 12), rng.randrange(1, 8))) for a in "abcdefghij"}
    known = {(a, s): (rng.randrange(3), 0) for a, x in steps.items() for s in x}
    known = {k: (n, rng.randrange(n + 1)) for k, (n, _) in known.items()}
    links = [(s, *rng.sample([a for a in steps if s in steps[a]], 2)) for _ in range(60) for s in [rng.randrange(1, 12)] if sum(s in x for x in steps.values()) > 1]
    by = spark.createDataFrame([(a, x, [known[a, s][0] for s in x], [known[a, s][1] for s in x]) for a, x in steps.items()], "address string, step array<int>, kn array<int>, kf array<int>")
    p0 = [(s, s / 20) for s in range(1, 12)]
    got = {(r["address"], r["step"]): r for r in address.neighbour_sums(spark.createDataFrame(links, "step int, a string, b string"), by, p0, 5.0, blocks).collect()}
    assert len(got) == len(known)
    state = lambda a, s: [sum(known[a, x][k] for x in steps[a] if x < s) for k in (0, 1)]
    for (a, s), r in got.items():
        near = {b for t, *pair in links if t < s and a in pair for b in pair if b != a}
        total = sum((f + 5 * s / 20) / (n + 5) for n, f in (state(b, s) for b in near))
        assert [r["n"], r["f"]] == state(a, s) and r["deg"] == len(near) and r["total"] == pytest.approx(total)


def test_fields_of_windows_deal_an_event_once(spark, monkeypatch):
    """An event goes to its window as one row, whatever its relations, and gives what its edges give."""
    from dataclasses import replace

    from causeway.operators import edges, green
    from causeway.operators.kernel import FieldConfig
    from causeway.sources import tables
    from causeway.spec import LINES

    tx, spec, config = tables.with_window(tables.lines(spark, SF.replace("0.01", "0.001")), 1000), replace(LINES, window="window"), FieldConfig(green=False, cap=12, fallback_cap=6)
    got = green.window_fields(tx, spec, config, list(LINES.risk))
    want = green.fields(edges.edges(tx, spec, list(LINES.risk)), spec, config)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not any(x in QUERIES[q](spark, SF.replace("0.01", "0.001"))._jdf.queryExecution().toString() for q in ("bounded_r2", "green_r2") for x in ("Generate", "explode"))


def test_local_graphs_are_walked_in_arrays(spark, monkeypatch):
    """A transaction is one row throughout; a graph too large to be sent is joined row by row and gives the same."""
    import random

    from causeway.operators import address

    rng = random.Random(5)
    tx = [(i, rng.randrange(1, 9), rng.choice([1, 2, 3])) for i in range(150)]
    side = lambda: sorted({(i, f"n{rng.choice([rng.randrange(4), rng.randrange(60)])}") for i, _, _ in tx[:-3] for _ in range(rng.randrange(1, 4))})
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((tx, "tx long, step int, cls int"), (side(), "tx long, address string"), (side(), "tx long, address string"))]
    for cap, fanout in ((2, 200), (4, 6), (50, 200)):
        found = []
        for sent in (40_000_000, 0):
            monkeypatch.setattr(address, "SENT", sent, raising=False)
            before = shuffled(spark)
            rows = sorted(map(tuple, address.exact_green(*frames, cap=cap, fanout=fanout).collect()))
            found.append((shuffled(spark) - before, rows))
        assert [x[0] for x in found[0][1]] == [x[0] for x in found[1][1]] == list(range(150))
        assert [x[1:] for x in found[0][1]] == [pytest.approx(x[1:]) for x in found[1][1]] and found[0][0] < found[1][0] / 2


@pytest.mark.parametrize("name", ["precision_screens", "shrinkage"])
def test_columns_are_shuffled_in_parts_that_are_written(spark, name, monkeypatch):
    """The last column's shuffle is not left to whoever reads the rows, beside the tables that it reads; the first events go."""
    from causeway.operators import states
    from causeway.plans import queries
    from causeway.sources import tables

    monkeypatch.setattr(tables, "AT_ONCE", 1000)
    monkeypatch.setattr(states.States.__init__, "__defaults__", ((), (), 10_000, states.HEAVY, None))
    before = shuffled(spark)
    rows = QUERIES[name](spark, SF)
    made = shuffled(spark)
    rows.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - made <= 0.1 * (made - before)
    assert {f.split("/")[-2].split("-")[0] for f in rows.inputFiles()} == {"column"}
    monkeypatch.undo()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()))
