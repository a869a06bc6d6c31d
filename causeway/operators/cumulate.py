"""Sums over all earlier rows of a key, for keys of any size.

A window over a key alone puts all its rows into one task, and a key may hold a third of the table.
Here a key's time is cut into blocks.  What lies in earlier blocks is added up before any shuffle
and cumulated over blocks, a row for each; what lies in a row's own block is a range frame there.
A delayed frame may end before its block begins, so a block also sees the end of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.spec import TransactionSpec

#: Ticks in a block, at least; a block is also four times as long as the longest delay.
BLOCK = 32


def before(rows: DataFrame, spec: TransactionSpec, keys: list[str], wants: dict[str, tuple[str, str, int]], asked: Column | None = None) -> DataFrame:
    """``rows`` with ``out`` for each ``out: (how, column, delay)``: over the rows of the same keys with ``time + delay < now``.

    ``how`` is ``sum`` (0 where there is none) or, without delay, ``max`` (null where there is none).  Rows of one time never see
    each other.  Rows for which ``asked`` is not true only count; they are not given back.
    """
    longest = max(d for _, _, d in wants.values())
    length = max(BLOCK, 4 * -(-(longest + 1) // spec.tick)) * spec.tick
    t, block = F.col(spec.time), F.floor(F.col(spec.time) / length)
    late = (t - block * length >= length - longest - 1) if longest else F.lit(False)
    sums = {c for how, c, _ in wants.values() if how == "sum"}
    tops = {c for how, c, d in wants.values() if how == "max"}
    if any(how == "max" and d for how, _, d in wants.values()):
        raise ValueError("a maximum has no delay")
    parts = [x for c in sums for x in (F.sum(c).alias(f"__all_{c}"), *([F.sum(F.when(late, F.col(c))).alias(f"__late_{c}")] if longest else []))]
    totals = rows.groupBy(*keys, block.alias("__block")).agg(*parts, *[F.max(c).alias(f"__top_{c}") for c in tops])
    over = Window.partitionBy(*keys).orderBy("__block")
    earlier, last = over.rangeBetween(Window.unboundedPreceding, -1), over.rangeBetween(-1, -1)
    none = F.lit(0)
    past = {f"__past_{c}": F.coalesce(F.sum(f"__all_{c}").over(earlier), none) - (F.coalesce(F.sum(f"__late_{c}").over(last), none) if longest else none) for c in sums}
    past |= {f"__most_{c}": F.max(f"__top_{c}").over(earlier) for c in tops}
    totals = totals.select(*keys, "__block", *[v.alias(k) for k, v in past.items()])
    own = F.struct(block.alias("b"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("own"))
    if longest:
        again = F.struct((block + 1).alias("b"), F.lit(False).alias("own"))
        seen = rows.withColumn("__x", F.explode(F.when(late, F.array(own, again)).otherwise(F.array(own))))
    else:
        seen = rows.withColumn("__x", own)
    seen = seen.withColumns({"__block": F.col("__x.b"), "__own": F.col("__x.own")}).drop("__x")
    w = Window.partitionBy(*keys, "__block").orderBy(spec.time)
    frame = lambda d: w.rangeBetween(Window.unboundedPreceding, -d - 1)
    inside = {f"__in_{out}": (F.sum if how == "sum" else F.max)(c).over(frame(d)) for out, (how, c, d) in wants.items()}
    both = seen.withColumns(inside).where("__own").join(totals, [*keys, "__block"])
    value = {out: F.col(f"__past_{c}") + F.coalesce(F.col(f"__in_{out}"), none) if how == "sum" else F.greatest(f"__most_{c}", f"__in_{out}") for out, (how, c, _) in wants.items()}
    return both.withColumns(value).drop("__block", "__own", *inside, *past)
