"""What an event table looks like, which relations its edges come from, and the defaults of the features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Defaults of released history and fields.
DELAYS_DAYS = (0, 1, 3, 7, 14, 30, 60)
ALPHAS = (5, 20, 100)
RIDGE, RADIUS, MAX_NODES = 0.1, 2, 100
DAY = 86_400


@dataclass(frozen=True)
class TransactionSpec:
    """Column names of a chronological event table.  ``tick`` is a day in units of ``time``."""

    id: str = "tx_id"
    time: str = "t"
    amount: str = "amount"
    label: str = "label"
    order: str = "row_ord"
    window: str | None = None
    relations: tuple[tuple[str, str], ...] = ()
    risk: tuple[str, ...] = ()
    tick: int = DAY
    required: tuple[str, ...] = field(default=("tx_id", "t", "label"))

    def layers(self) -> list[str]:
        return [f"{a}--{b}" for a, b in self.relations]

    def check(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"required columns are missing: {', '.join(missing)}")
        return df

    def keys(self, *more: str) -> list[str]:
        """Partitioning keys: windows are independent where the spec has them."""
        return [*([self.window] if self.window else []), *more]


#: The line-item view: eight relations, four of them risk layers.
LINES = TransactionSpec(
    relations=(("cust", "brand"), ("cust", "supp"), ("cust", "segment"), ("supp", "brand"), ("cust", "status"), ("supp", "segment"), ("cust", "size"), ("supp", "status")),
    risk=("cust--brand", "cust--supp", "cust--segment", "supp--brand"),
)
#: The event view: times in microseconds.
EVENTS = TransactionSpec(relations=(("user", "k"),), risk=("user--k",), tick=DAY * 1_000_000)
