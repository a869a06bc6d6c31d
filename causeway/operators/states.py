"""States before now of both ends of every relation, a row for each event.

``edges`` and ``endpoints`` make a row for each end of each relation, and a shuffle of them moves an event eight times or more.
Here an event stays one row.  A column that takes few values at few times is added up by value and time and sent to
every task.  Any other column costs one shuffle of the events, in which all its relations are counted: the windows of
a pair are sorted within the column's partitions.  A value of more than ``HEAVY`` events would be one task; it goes by blocks
of time (``cumulate.before``).  Of more than ``tables.AT_ONCE`` events a column's values are shuffled in parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalar import key, log_amount
from causeway.operators.cumulate import before
from causeway.sources import tables
from causeway.sources.shared import discard, materialize
from causeway.spec import TransactionSpec

#: Rows of a few numbers that may be sent to every task.
SENT = 500_000
#: Events of one value in one task, at most.
HEAVY = 2_000_000

Wants = dict[str, tuple[str, str, int]]
#: What a temporal feature needs of a node.
TEMPORAL = ("count", "short", "long", "degree", "amount", "last")


def wanted(spec: TransactionSpec, *names: str, delay: int = 0) -> Wants:
    """``name: (how, what, delay)`` of the states of nodes that are known by name."""
    known = {
        "count": ("sum", "w", 0), "short": ("sum", "w", spec.tick), "long": ("sum", "w", 7 * spec.tick), "degree": ("sum", "fresh", 0), "amount": ("sum", "log", 0), "last": ("max", "t", 0),
        "n": ("sum", "n", delay), "f": ("sum", "f", delay),
    }
    return {n: known[n] for n in names}


class States:
    """``rows``: the events with ``<name>_<k>_a``, ``_b`` and ``<pair>_<k>_ab`` of relation ``k``; meaningless where an end is missing."""

    def __init__(self, tx: DataFrame, spec: TransactionSpec, layers: list[str], node: Wants, pair: tuple[str, ...] = (), keep: tuple[str, ...] = (), sent: int = SENT, heavy: int = HEAVY, done: Callable[[], None] | None = None) -> None:
        self.spec, self.node, self.sent, self.heavy = spec, node, sent, heavy
        self.relations = [r for r in spec.relations if "--".join(r) in layers and set(r) <= set(tx.columns)]
        self.names = ["--".join(r) for r in self.relations]
        self.columns = list(dict.fromkeys(c for r in self.relations for c in r))
        self.whats = list(dict.fromkeys(what for _, what, _ in node.values()))
        self.fresh = "fresh" in self.whats
        self.pair = tuple(pair)
        self.keep = spec.keys(spec.order, spec.time, *keep)
        more = [F.col(spec.label).alias("__label")] if {"n", "f"} & set(self.whats) else []
        if "log" in self.whats:
            more.append(log_amount(F.coalesce(F.col(spec.amount), F.lit(0.0)).cast("double")).alias("__log"))
        self.base = materialize(tx.select(*dict.fromkeys(self.keep), *more, *[key(tx, c).alias(f"__{c}") for c in self.columns]), "events")
        if done:
            done()  # ``tx`` is not read again
        self._plan()
        rows = self.base
        parts = tables.PARTS if self.big and self.base.count() > tables.AT_ONCE else 1
        for c in self.big:
            heavy, own = self._heavy(c), F.xxhash64(*spec.keys(f"__{c}"))
            some = [self._by_column(rows.where(F.pmod(own, F.lit(parts)) == p) if parts > 1 else rows, c, heavy) for p in range(parts)]
            if parts == 1 and c == self.big[-1]:
                rows = some[0]
                break
            # Written, so that the shuffle of a column, or of a part of its values, is not on disk with the next; what it was made of goes.
            rows = materialize(some[0], "column", *some[1:])
            discard(self.base)
            self.base = rows
        for k in self.few:
            rows = self._by_pair(rows, k)
        if self.fresh and self.small:
            rows = materialize(rows, "states")
        source = rows if self.fresh else self.base
        for c in self.small:
            rows = self._sent(rows, source, c)
        self.rows = rows

    def there(self, k: int) -> Column:
        a, b = self.relations[k]
        return F.col(f"__{a}").isNotNull() & F.col(f"__{b}").isNotNull()

    def _plan(self) -> None:
        """Which columns are shuffled, in which order, which relations' pairs are sent, and which values are heavy."""
        spec = self.spec
        size = lambda *cs: F.approx_count_distinct(F.xxhash64(*spec.keys(*[f"__{c}" for c in cs], spec.time)))
        sizes = [size(c).alias(c) for c in self.columns] + [size(*r).alias("--".join(r)) for r in self.relations]
        got = self.base.agg(*sizes, *[F.count_if(F.col(f"__{c}").isNull()).alias(f"no {c}") for c in self.columns]).first().asDict()
        big = {c for c in self.columns if got[c] > self.sent}
        pairs = bool(self.pair or self.fresh)
        for r in self.relations if pairs else []:
            if not big & set(r) and got["--".join(r)] > self.sent:
                big.add(r[0])
        degree = lambda c: sum(c in r for r in self.relations)
        self.big = sorted(big, key=lambda c: (-degree(c), self.columns.index(c)))
        self.small = [c for c in self.columns if c not in big]
        at = {c: i for i, c in enumerate(self.big)}
        #: The column in whose partitions the pairs of a relation are counted.
        self.home = {k: min((c for c in r if c in big), key=at.get) for k, r in enumerate(self.relations) if pairs and big & set(r)}
        self.few = [k for k in range(len(self.relations)) if pairs and k not in self.home]
        self.gaps = {c: got[f"no {c}"] > 0 for c in self.columns}

    def _what(self, what: str, k: int) -> Column:
        here, label, none = self.there(k), F.col("__label"), F.lit(0).cast("bigint")
        if what == "w":
            return here.cast("bigint")
        if what == "n":
            return F.when(here & label.isNotNull(), F.lit(1).cast("bigint")).otherwise(none)
        if what == "f":
            return F.when(here, F.coalesce(label, F.lit(0)).cast("bigint")).otherwise(none)
        if what == "log":
            return F.when(here, F.col("__log")).otherwise(0.0)
        if what == "t":
            return F.when(here, F.col(self.spec.time))
        return F.coalesce(F.col(f"__fresh_{k}"), none)

    def sides(self, c: str) -> list[tuple[int, str]]:
        """The relations that a column is an end of, and which end."""
        return [(k, s) for k, r in enumerate(self.relations) for s, end in zip("ab", r, strict=True) if end == c]

    def _pair_wants(self, k: int) -> dict[str, tuple[str, str]]:
        return {f"{p}_{k}_ab": {"count": ("sum", "w"), "last": ("max", "t")}[p] for p in self.pair}

    def _cumulated(self, rows: DataFrame, keys: list[str], wants: dict[str, tuple[str, Column, int]]) -> DataFrame:
        """``rows`` with sums and maxima over rows of the same keys and ``time + delay < now`` by one window."""
        w = Window.partitionBy(*keys).orderBy(self.spec.time)
        frame = lambda d: w.rangeBetween(Window.unboundedPreceding, -d - 1)
        one = lambda how, c, d: F.coalesce(F.sum(c).over(frame(d)), F.lit(0)) if how == "sum" else F.max(c).over(frame(d))
        return rows.withColumns({out: one(*x) for out, x in wants.items()})

    def _heavy(self, c: str) -> list[tuple]:
        own = self.spec.keys(f"__{c}")
        return [tuple(r) for r in self.base.where(F.col(f"__{c}").isNotNull()).groupBy(*own).count().where(F.col("count") > self.heavy).select(*own).collect()]

    def _by_column(self, rows: DataFrame, c: str, found: list[tuple]) -> DataFrame:
        spec, own = self.spec, self.spec.keys(f"__{c}")
        mine = [k for k, home in self.home.items() if home == c]
        other = lambda k: next((f"__{x}" for x in self.relations[k] if x != c), f"__{c}")
        nodes = lambda: {f"{n}_{k}_{s}": (how, self._what(what, k), d) for n, (how, what, d) in self.node.items() for k, s in self.sides(c)}
        there = rows.where(F.col(f"__{c}").isNotNull()) if self.gaps[c] else rows

        def plain(part: DataFrame) -> DataFrame:
            part = part.repartition(*own)  # else the first pair's window deals rows by the pair, and each later one again
            for k in mine:
                pair = dict.fromkeys([*own, other(k)])
                if self.fresh:
                    first = F.row_number().over(Window.partitionBy(*pair).orderBy(spec.time, spec.order)) == 1
                    part = part.withColumn(f"__fresh_{k}", (first & self.there(k)).cast("bigint"))
                part = self._cumulated(part, list(pair), {out: (how, self._what(what, k), 0) for out, (how, what) in self._pair_wants(k).items()})
            return self._cumulated(part, own, nodes())

        def blocks(part: DataFrame) -> DataFrame:
            for k in mine:
                part = self._in_blocks(part, list(dict.fromkeys([*own, other(k)])), {out: (how, self._what(what, k), 0) for out, (how, what) in self._pair_wants(k).items()}, k)
            return self._in_blocks(part, own, nodes())

        if not found:
            out = plain(there)
        else:
            keys = there.sparkSession.createDataFrame(found, there.select(*own).schema)  # at most rows / HEAVY rows
            there = materialize(there, "rows")
            out = plain(there.join(F.broadcast(keys), own, "left_anti")).unionByName(blocks(there.join(F.broadcast(keys), own, "left_semi")))
        return out if not self.gaps[c] else out.unionByName(rows.where(F.col(f"__{c}").isNull()), allowMissingColumns=True)

    def _first(self, rows: DataFrame, keys: list[str], k: int, sent: bool = False) -> DataFrame:
        """``rows`` with ``__fresh_<k>``: 1 for the first event of each pair."""
        spec = self.spec
        first = rows.where(self.there(k)).groupBy(*keys).agg(F.min(F.struct(spec.time, spec.order)).alias("__x"))
        out = rows.join(F.broadcast(first) if sent else first, keys, "left")
        return out.withColumn(f"__fresh_{k}", F.coalesce((F.col(f"__x.{spec.order}") == F.col(spec.order)).cast("bigint"), F.lit(0).cast("bigint"))).drop("__x")

    def _in_blocks(self, rows: DataFrame, keys: list[str], wants: dict[str, tuple[str, Column, int]], k: int | None = None) -> DataFrame:
        if not wants and not (self.fresh and k is not None):
            return rows
        rows = materialize(rows, "blocks")  # read twice by each step
        gone = rows.where(F.expr(" or ".join(f"{c} is null" for c in keys)))
        rows = rows.where(F.expr(" and ".join(f"{c} is not null" for c in keys)))
        if self.fresh and k is not None:
            rows = self._first(rows, keys, k)
        if wants:
            names = {out: f"__v_{i}" for i, out in enumerate(wants)}
            rows = before(rows.withColumns({names[out]: c for out, (_, c, _) in wants.items()}), self.spec, keys, {out: (how, names[out], d) for out, (how, _, d) in wants.items()}).drop(*names.values())
        return rows.unionByName(gone, allowMissingColumns=True)

    def _by_pair(self, rows: DataFrame, k: int) -> DataFrame:
        keys = self.spec.keys(*dict.fromkeys(f"__{x}" for x in self.relations[k]))
        if self.fresh:
            rows = self._first(rows, keys, k, sent=True)
        wants = self._pair_wants(k)
        return self._joined(rows, self.base, keys, {out: (how, self._what(what, k), 0) for out, (how, what) in wants.items()}, self.there(k)) if wants else rows

    def _joined(self, rows: DataFrame, source: DataFrame, keys: list[str], wants: dict[str, tuple[str, Column, int]], where: Column) -> DataFrame:
        """``rows`` with states that are added up by keys and time, few enough to be sent."""
        time = self.spec.time
        cols = {out: F.sum(c) if how == "sum" else F.max(c) for out, (how, c, _) in wants.items()}
        by = source.where(where).groupBy(*keys, time).agg(*[c.alias(f"__in_{out}") for out, c in cols.items()])
        by = self._cumulated(by, keys, {out: (how, F.col(f"__in_{out}"), d) for out, (how, _, d) in wants.items()}).select(*keys, time, *wants)
        return rows.join(F.broadcast(by), [*keys, time], "left")

    def _sent(self, rows: DataFrame, source: DataFrame, c: str) -> DataFrame:
        wants = {f"{n}_{k}_{s}": (how, self._what(what, k), d) for n, (how, what, d) in self.node.items() for k, s in self.sides(c)}
        return self._joined(rows, source, self.spec.keys(f"__{c}"), wants, F.col(f"__{c}").isNotNull()) if wants else rows

    def with_rates(self, delay: int) -> States:
        """Adds ``rate_<k>``: the relation's share of positives among what was released before now, 0 if nothing was."""
        spec, n = self.spec, len(self.relations)
        by = self.base.groupBy(*spec.keys(spec.time)).agg(*[F.sum(self._what(x, k)).cast("bigint").alias(f"__{x}_{k}") for k in range(n) for x in "nf"])
        one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__n_{k}").alias("n"), F.col(f"__f_{k}").alias("f")) for k in range(n)])).alias("x")
        rates = before(by.select(*spec.keys(spec.time), one).select(*spec.keys(spec.time), "x.*"), spec, spec.keys("k"), {"gn": ("sum", "n", delay), "gf": ("sum", "f", delay)})
        rate = F.when(F.col("gn") > 0, F.col("gf") / F.col("gn")).otherwise(0.0)
        wide = rates.groupBy(*spec.keys(spec.time)).agg(*[F.max(F.when(F.col("k") == k, rate)).alias(f"rate_{k}") for k in range(n)])
        few = self.base.agg(F.approx_count_distinct(F.xxhash64(*spec.keys(spec.time)))).first()[0] <= self.sent
        self.rows = self.rows.join(F.broadcast(wide) if few else wide, spec.keys(spec.time))
        return self

    def array(self) -> Column:
        """The relations that a row has, as an array of structs of ``layer`` and the states, without the relation's number."""
        one = []
        for k, layer in enumerate(self.names):
            ends = {f"_{k}_{s}": f"_{s}" for s in ("a", "b", "ab")} | {f"rate_{k}": "rate"}
            found = {n.removesuffix(x) + out: F.col(n) for n in self.rows.columns for x, out in ends.items() if n.endswith(x) and not n.startswith("__")}
            fields = [found[n].alias(n) for n in sorted(found)]
            one.append(F.when(self.there(k), F.struct(F.lit(layer).alias("layer"), *fields)))
        return F.array_compact(F.array(*one))

    def long(self) -> DataFrame:
        """A row for each relation of each event."""
        out = self.rows.select(*self.keep, F.explode(self.array()).alias("x"))
        return out.select(*self.keep, "x.*")
