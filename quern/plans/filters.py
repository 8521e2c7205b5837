"""The shared filters of every sales report, as one predicate and semi joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Dates are inclusive; customer_type is identified, guest or None; empty lists restrict nothing."""

    date_from: datetime | None = None
    date_to: datetime | None = None
    regions: Sequence[str] = ()
    product_codes: Sequence[str] = ()
    categories: Sequence[str] = ()
    customer_type: str | None = None
    include_returns: bool = True

    def predicate(self) -> Column:
        parts: list[Column] = []
        if self.date_from is not None:
            parts.append(F.col("occurred_at") >= F.lit(self.date_from))
        if self.date_to is not None:
            parts.append(F.col("occurred_at") <= F.lit(self.date_to))
        for column, values in (("region", self.regions), ("product_code", self.product_codes), ("category", self.categories)):
            if values:
                parts.append(F.col(column).isin(list(values)))
        if self.customer_type == "identified":
            parts.append(F.col("customer_id").isNotNull())
        elif self.customer_type == "guest":
            parts.append(F.col("customer_id").isNull())
        if not self.include_returns:
            parts.append(~F.col("is_return"))
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out

    def apply(self, sales: DataFrame) -> DataFrame:
        return sales.where(self.predicate())


def within(sales: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Rows whose column is among the values of `allowed`, whatever its size."""
    return sales.join(allowed.select(column).distinct(), column, "left_semi")
