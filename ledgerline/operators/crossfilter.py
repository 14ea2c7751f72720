"""Cross-filtering: named clauses over turn columns, folded into one predicate.

Each view owns at most one clause. A view is normally evaluated without its own clause
(so what it is brushing stays visible); a drawn layer obeys all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_range(bounds: tuple[int, int] | None, ts: str = "ts") -> Column | None:
    """Closed interval in epoch milliseconds; None clears.

    The bounds are compared as timestamps, so the condition reaches the Parquet reader.
    """
    if bounds is None:
        return None
    low, high = min(bounds), max(bounds)
    return (F.col(ts) >= F.timestamp_millis(F.lit(low))) & (
        F.col(ts) < F.timestamp_millis(F.lit(high + 1))
    )


def members(values: Iterable[str] | None, column: str = "project") -> Column | None:
    """One of a set of values; None means all of them."""
    return None if values is None else F.col(column).isin(sorted(values))


def box(
    bounds: tuple[int, int] | None,
    amounts: tuple[float, float] | None,
    ts: str = "ts",
    amount: str = "costTotal",
) -> Column | None:
    """A time interval and an amount interval together."""
    if bounds is None or amounts is None:
        return None
    return time_range(bounds, ts) & F.col(amount).between(min(amounts), max(amounts))


def within_hour(hour_ms: int | None, ms: Column) -> Column:
    """Half-open hour; None passes everything."""
    if hour_ms is None:
        return F.lit(True)
    return (ms >= hour_ms) & (ms < hour_ms + 3_600_000)


class CrossFilter:
    def __init__(self) -> None:
        self._clauses: dict[str, tuple[Column, bool]] = {}
        self.visible: frozenset[str] | None = None
        self.brush: tuple[int, int] | None = None

    def publish(self, source: str, clause: Column | None, skip_self: bool = True) -> None:
        """Set, replace or (with None) withdraw the clause of one source.

        ``skip_self=False`` makes the clause apply to its own source as well.
        """
        if clause is None:
            self._clauses.pop(source, None)
        else:
            self._clauses[source] = (clause, skip_self)

    def brush_time(self, bounds: tuple[int, int] | None) -> None:
        self.brush = bounds
        self.publish("timeline", time_range(bounds))

    def show_projects(self, projects: Iterable[str] | None) -> None:
        self.visible = None if projects is None else frozenset(projects)
        self.publish("project-filter", members(self.visible))

    def toggle_project(self, project: str, everything: Iterable[str]) -> None:
        """Flip one project; back to all of them means no clause at all."""
        everything = frozenset(everything)
        shown = set(self.visible if self.visible is not None else everything)
        shown.symmetric_difference_update({project})
        self.show_projects(None if len(shown) == len(everything) else shown)

    def predicate(self, exclude: str | None = None) -> Column:
        """All clauses, or all but the one ``exclude`` published for itself."""
        kept = [
            clause
            for source, (clause, skip_self) in self._clauses.items()
            if not (skip_self and source == exclude)
        ]
        return reduce(and_, kept, F.lit(True))

    def apply(self, turns: DataFrame, exclude: str | None = None) -> DataFrame:
        return turns.where(self.predicate(exclude))

    @property
    def active(self) -> bool:
        return bool(self._clauses)

    def clear(self) -> None:
        self._clauses.clear()
        self.visible = None
        self.brush = None

    def views(
        self, turns: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]]
    ) -> dict[str, DataFrame]:
        """One lazy frame per view, each under everybody else's clauses."""
        return {name: build(self.apply(turns, exclude=name)) for name, build in builders.items()}


def brush_bounds(start: object, end: object) -> tuple[int, int] | None:
    """Brush bounds from ISO text or epoch milliseconds, in either order; None clears."""
    from datetime import datetime, timezone

    def to_ms(value: object) -> int | None:
        if value is None or value == "":
            return None
        if isinstance(value, (int, float)):
            return int(value)
        try:
            moment = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        except ValueError:
            return None
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        return round(moment.timestamp() * 1000)

    a, b = to_ms(start), to_ms(end)
    return None if a is None or b is None else (min(a, b), max(a, b))


__all__ = [
    "CrossFilter",
    "box",
    "brush_bounds",
    "members",
    "time_range",
    "within_hour",
]
