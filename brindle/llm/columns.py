"""Given columns packed away, so that no column that an operator makes can clash with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def given(docs: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """One struct `given` of the columns (all, unless named); a field that nothing reads is pruned from the scan."""
    return F.struct(*[F.col(quoted(c)) for c in (docs.columns if columns is None else columns)]).alias("given")


def named(columns: Iterable[str], *but: str) -> list[Column]:
    """The packed columns by their names again, without those in `but`, which the operator gives anew."""
    new = {b.lower() for b in but}
    return [F.col(f"given.{quoted(c)}").alias(c) for c in columns if c.lower() not in new]
