"""Audits: ties, label release, alignment, placebo labels, and plans that look ahead."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.operators import edges, history, temporal
from causeway.operators.metrics import running
from causeway.operators.states import States
from causeway.sources import sinks
from causeway.spec import TransactionSpec


def ties(df: DataFrame, ends: DataFrame, spec: TransactionSpec) -> DataFrame:
    """One row: distinct times, times of several rows, the rows at these, and rows that share an endpoint with an earlier row of the same time."""
    by = df.groupBy(*spec.keys(spec.time)).agg(F.count("*").alias("n"))
    sums = by.agg(F.count("*").alias("times"), F.sum((F.col("n") > 1).cast("long")).alias("tied_times"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("tied_rows"))
    first = F.row_number().over(Window.partitionBy(*spec.keys(spec.time, "layer", "node")).orderBy(spec.order))
    shared = ends.withColumn("__k", first).where("__k > 1").agg(F.countDistinct(*spec.keys(spec.order)).alias("shared_rows"))
    return sums.withColumn("__one", F.lit(1)).join(shared.withColumn("__one", F.lit(1)), "__one").drop("__one")  # a row each


def release(ends: DataFrame, features: DataFrame, spec: TransactionSpec, delay: int, column: str = "exposure_log", tolerance: float = 1e-4) -> DataFrame:
    """One row: how many endpoint rows there are, how far stored exposure is from a recount, and how many differ.

    The recount adds releases by (node, time) and cumulates over times, a way of its own.
    """
    keys = spec.keys("layer", "node")
    out = ends.groupBy(*keys, F.col(spec.time).alias("at")).agg(F.count(spec.label).alias("n"))
    given = out.select(*keys, (F.col("at") + delay).alias("at"), "n", F.lit(1).alias("__release"))
    asked = out.select(*keys, "at", F.lit(0).alias("n"), F.lit(0).alias("__release"))
    # At one instant questions come before releases: release is strict.
    w = Window.partitionBy(*keys).orderBy("at", "__release").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = given.union(asked).withColumn("expected", F.sum("n").over(w)).where("__release = 0").select(*keys, F.col("at").alias(spec.time), "expected")
    both = features.join(counted, [*keys, spec.time])
    gap = F.abs(F.col(column) - F.log1p(F.col("expected").cast("double")))
    return both.agg(F.count("*").alias("rows"), F.max(gap).alias("max_gap"), F.sum((gap > tolerance).cast("long")).alias("mismatches"))


def release_of_states(s: States, n: str, delay: int, tolerance: float = 1e-4) -> DataFrame:
    """``release`` of the released counts ``n`` of events' states, by column: a node is compared once for each of its times."""
    time, out = s.spec.time, None
    for c in s.columns:
        own, sides = s.spec.keys(f"__{c}"), s.sides(c)
        there = F.col(f"__{c}").isNotNull()
        given = [f"{n}_{k}_{x}" for k, x in sides]
        stored = s.rows.where(there).groupBy(*own, time, *given).agg(*[F.count_if(s.there(k)).alias(f"__rows_{i}") for i, (k, _) in enumerate(sides)])
        counts = [F.count_if(s.there(k) & F.col("__label").isNotNull()).alias(f"__n_{i}") for i, (k, _) in enumerate(sides)]
        by = s.base.where(there).groupBy(*own, time).agg(*counts)
        names = [f"__n_{i}" for i in range(len(sides))]
        two = F.array(
            F.struct((F.col(time) + delay).alias("at"), F.lit(1).alias("release"), *names), F.struct(F.col(time).alias("at"), F.lit(0).alias("release"), *[F.lit(0).cast("bigint").alias(x) for x in names])
        )
        # At one instant questions come before releases: release is strict.
        w = Window.partitionBy(*own).orderBy("at", "release").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = by.select(*own, F.explode(two).alias("x")).select(*own, "x.*").withColumns({f"__e_{i}": F.log1p(F.sum(x).over(w).cast("double")) for i, x in enumerate(names)})
        counted = counted.where("release = 0").select(*own, F.col("at").alias(time), *[f"__e_{i}" for i in range(len(sides))])
        gap = lambda i: F.when(F.col(f"__rows_{i}") > 0, F.abs(F.log1p(F.col(given[i]).cast("double")) - F.col(f"__e_{i}")))
        one = F.explode(F.array(*[F.struct(F.col(f"__rows_{i}").alias("n"), gap(i).alias("gap")) for i in range(len(sides))])).alias("x")
        part = stored.join(counted, [*own, time]).select(one).select("x.*")
        part = part.agg(F.sum("n").alias("rows"), F.max("gap").alias("max_gap"), F.coalesce(F.sum(F.when(F.col("gap") > tolerance, F.col("n"))), F.lit(0)).alias("mismatches"))
        out = part if out is None else out.union(part)
    return out.agg(F.sum("rows").alias("rows"), F.max("max_gap").alias("max_gap"), F.sum("mismatches").alias("mismatches"))


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two tables have the same keys."""
    return not a.join(b, keys, "left_anti").limit(1).count() and not b.join(a, keys, "left_anti").limit(1).count()


def permute_labels(df: DataFrame, spec: TransactionSpec, seed: int, out: str = "label") -> DataFrame:
    """Labels dealt anew within each window by a seeded order of hashes: a permutation, the same for the same seed."""
    keys = spec.keys("__k")
    digest = F.md5(F.concat_ws(":", F.lit(seed), spec.order))
    if spec.keys():
        w = Window.partitionBy(*spec.keys())
        drawn = df.withColumn("__k", F.row_number().over(w.orderBy(digest, spec.order)))
        placed = df.withColumn("__k", F.row_number().over(w.orderBy(spec.order)))
    else:
        one = df.withColumns({"__one": F.lit(1), "__h": F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")})
        drawn = running(one, [], "__h", {"__k": "__one"}, then=spec.order)
        placed = running(one, [], spec.order, {"__k": "__one"}).drop("__one", "__h")
    shuffled = drawn.select(*spec.keys(), F.col(spec.label).alias("__y"), "__k")
    return placed.join(shuffled, keys).withColumn(out, F.col("__y")).drop("__k", "__y")


def looks_ahead(df: DataFrame) -> list[str]:
    """Window frames of a plan that reach the current time or later; a causal feature plan has none ordered by range."""
    plan = df._jdf.queryExecution().analyzed().toString()
    frames = re.findall(r"RangeFrame, [^,]+, (?:-?\d+|cast\(-?\d+ as \w+\)|\w+\$\(\))", plan)
    return [f for f in frames if not re.search(r", (?:cast\()?-[1-9]", f)]


def selection_leaks(report: str, marker: str = "test_used_for_selection") -> list[str]:
    """Paths in a JSON report at which the marker is true."""
    found: list[str] = []

    def walk(x, path: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if k == marker and v:
                    found.append(f"{path}/{k}")
                walk(v, f"{path}/{k}")
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}/{i}")

    walk(json.loads(report), "")
    return found


def block_checks(spark: SparkSession) -> list[dict]:
    """Four checks of the causal contract on three made-up rows, two of one time and one later."""
    spec = TransactionSpec(relations=(("card", "addr"),), risk=("card--addr",))
    rows = [(k, k, t, y, "1", "10", 10.0) for k, t, y in ((1, 100, 1), (2, 100, 0), (3, 101, 0))]
    e = edges.edges(spark.createDataFrame(rows, "row_ord long, tx_id long, t long, label int, card string, addr string, amount double"), spec)
    n = {r["row_ord"]: r["n_0"] for r in history.history(e, edges.endpoints(e, spec), spec, [0]).where("side = 'left'").collect()}
    seen = {r["row_ord"]: r["count_a"] for r in temporal.features(e, spec).collect()}
    found = (("same_timestamp_label_excluded", n[2], n[2] == 0), ("strictly_later_label_included", n[3], n[3] > 0), ("same_timestamp_edge_excluded", seen[2], seen[2] == 0), ("strictly_later_edge_included", seen[3], seen[3] == 2))
    return [{"check": c, "observed": float(v), "pass": bool(ok)} for c, v, ok in found]


def provenance(spark: SparkSession, tables: dict[str, str], max_bytes: int = 1 << 28) -> list[dict]:
    """For each named table: whether it is there, its files' newest change, bytes, sha256 (of tables of up to ``max_bytes``), rows, columns, policy, and whether it may be used again.

    The digest is of the files' digests in the order of their names; files are read by Spark, not by the driver.
    """
    out = []
    for role, path in sorted(tables.items()):
        found = sinks.files(spark, path)
        size = sum(n for _, n, _ in found)
        row = {"role": role, "path": path, "exists": bool(found), "mtime_ms": max((m for _, _, m in found), default=0), "size_bytes": size, "sha256": "", "rows": 0, "columns": 0, "reuse_allowed": False}
        if found:
            if size <= max_bytes:
                each = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path").collect()  # a row for each file
                row["sha256"] = hashlib.sha256("".join(r["d"] for r in each).encode()).hexdigest()
            said = sinks.footer(spark, path)
            row |= {"rows": spark.read.parquet(path).count() if said["columns"] else -1, "columns": len(said["columns"]), **{k: said["policy"].get(k, "") for k in sinks.POLICY}}
            row["reuse_allowed"] = bool(said["columns"]) and sinks.causal_meta_ok(spark, path)
        out.append(row)
    return out


def gate(checks: dict[str, tuple[bool, str]]) -> tuple[bool, str]:
    """Whether all checks pass, and a report in Markdown; no checks do not pass."""
    ok = bool(checks) and all(passed for passed, _ in checks.values())
    lines = ["# Leakage and causality audit", "", f"Overall: **{'PASS' if ok else 'FAIL'}**", "", *(f"- `{name}`: {'PASS' if passed else 'FAIL'}{' - ' + note if note else ''}" for name, (passed, note) in checks.items())]
    return ok, "\n".join(lines) + "\n"


def audit(df: DataFrame, spec: TransactionSpec, delay: int, tables: dict[str, str] | None = None, reports: list[str] = ()) -> tuple[bool, str]:
    """All audits of an event table in one gate: ties, label release, plans, permuted labels, made-up rows, tables and reports."""
    e = edges.edges(df, spec, list(spec.risk))
    ends = edges.endpoints(e, spec)
    h = history.field_h(history.history(e, ends, spec, [delay]), 0, 5)
    tied, out = ties(df, ends, spec).first(), release(ends, h, spec, delay).first()
    ahead = looks_ahead(h) + looks_ahead(temporal.features(e, spec))
    dealt = permute_labels(df, spec, 17)
    same = df.agg(F.sum(spec.label)).first()[0] == dealt.agg(F.sum("label")).first()[0]
    block = block_checks(df.sparkSession)
    found = provenance(df.sparkSession, tables or {})
    leaks = [x for r in reports for x in selection_leaks(r)]
    return gate(
        {
            "same_timestamp": (True, f"{tied['tied_rows']} rows in {tied['tied_times']} times of several rows; {tied['shared_rows']} share an end with an earlier row of their time"),
            "label_release": (out["mismatches"] == 0, f"{out['mismatches']} of {out['rows']} exposures differ"),
            "plan": (not ahead, "; ".join(ahead)),
            "placebo": (same, "permuted labels keep their number"),
            "block": (all(c["pass"] for c in block), ", ".join(c["check"] for c in block if not c["pass"])),
            "provenance": (all(r["reuse_allowed"] for r in found), ", ".join(r["role"] for r in found if not r["reuse_allowed"])),
            "selection": (not leaks, ", ".join(leaks)),
        }
    )
