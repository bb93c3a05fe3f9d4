"""Which rows a read sees (S2, S3, P16-P18): one Column builder per rule, used by every verb."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import InvalidArgument


def current(superseded_at: str = "superseded_at") -> Column:
    return F.col(superseded_at).isNull()


def active(state: str = "state") -> Column:
    return F.col(state) == "active"


def valid_at(now: int, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open validity; null is unbounded."""
    return (F.col(start).isNull() | (F.col(start) <= now)) & (F.col(end).isNull() | (F.col(end) > now))


def edge_live(now: int) -> Column:
    """An edge that isn't superseded and hasn't ended by ``now``."""
    return F.col("superseded_at").isNull() & (F.col("t_invalid").isNull() | (F.col("t_invalid") > now))


@dataclass(frozen=True)
class ReadView:
    """Independent relaxations of the default view; ``valid_as_of`` replaces the caller's now."""

    include_superseded: bool = False
    include_inactive: bool = False
    include_out_of_window: bool = False
    valid_as_of: int | None = None

    def condition(self, now: int, columns: list[str]) -> Column:
        parts = [F.lit(True)]
        if not self.include_superseded and "superseded_at" in columns:
            parts.append(current())
        if not self.include_inactive and "state" in columns:
            parts.append(F.coalesce(active(), F.lit(False)))
        if not self.include_out_of_window:
            parts.append(valid_at(now if self.valid_as_of is None else self.valid_as_of))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def of(self, nodes: DataFrame, now: int) -> DataFrame:
        return nodes.filter(self.condition(now, nodes.columns))

    def for_search(self) -> "ReadView":
        """Search honours validity only."""
        if self.include_superseded or self.include_inactive:
            raise InvalidArgument("search can't include superseded or inactive rows")
        return self


DEFAULT_VIEW = ReadView()
