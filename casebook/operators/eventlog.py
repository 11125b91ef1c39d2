"""The columns that make a table an event log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventLog:
    """Case key, integer time in seconds, and columns that order events of one case at one time.

    ``only`` is an SQL condition that tells the log's rows from those of other logs in the same table.
    """

    key: str = "reference_id"
    time: str = "seconds_since_case_start"
    ties: Sequence[str] = ()
    only: str | None = None

    @classmethod
    def of(cls, df: DataFrame, key: str = "reference_id", time: str = "seconds_since_case_start") -> EventLog:
        """Break ties by every other column, in table order."""
        return cls(key, time, tuple(c for c in df.columns if c not in (key, time)))

    @property
    def order(self) -> Column:
        """Position of an event in its case. Nullable ties are safe inside the struct."""
        return self.here(F.struct(self.time, *self.ties))

    def here(self, value: str | Column) -> Column:
        """A value in the log's own rows, null in those of other logs."""
        value = F.col(value) if isinstance(value, str) else value
        return value if self.only is None else F.when(F.expr(self.only), value)
