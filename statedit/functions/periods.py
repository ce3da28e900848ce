"""Period columns: one (a year) or several (year and quarter or month), and what lies before a period.

A spine is the ordered table of the period tuples. Predicates, links and joins to the period
before come from it, so that no operator counts periods itself: the quarter before the first
of a year is the last of the year before, and a year may have lost a period.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import small_table

Period = tuple[int, ...]

#: Distinct periods a table may have; more are no periods.
MOST_PERIODS = 10_000

#: What counts as the period before: the one in front, or the same part of the year before.
BY_POSITION, BY_YEAR = "position", "year"


@dataclass(frozen=True)
class Spine:
    """Ascending tuples of the period columns, the year first.

    Without tuples the spine is that of a single column that counts up by one.
    """

    columns: tuple[str, ...] = ("period",)
    periods: tuple[Period, ...] = ()

    def __post_init__(self) -> None:
        if not self.periods and len(self.columns) != 1:
            raise ValueError("Several period columns need the list of their periods")
        if any(len(p) != len(self.columns) for p in self.periods):
            raise ValueError(f"Every period must have a value for each of {list(self.columns)}")
        if list(self.periods) != sorted(set(self.periods)):
            raise ValueError("Periods must ascend and be distinct")

    @classmethod
    def regular(cls, columns: Sequence[str], first: Sequence[int], last: Sequence[int], parts: int) -> "Spine":
        """All periods from ``first`` to ``last`` when a year has the parts 1 to ``parts``."""
        year, part = first
        found = []
        while (year, part) <= tuple(last):
            found.append((year, part))
            year, part = (year, part + 1) if part < parts else (year + 1, 1)
        return cls(tuple(columns), tuple(found))

    @classmethod
    def of(cls, table: DataFrame, columns: Sequence[str]) -> "Spine":
        """The periods that occur in a table; rows with a null among them have no period. Runs a job."""
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        rows = table.where(known).select(*[F.col(c).cast("bigint") for c in columns]).distinct().limit(MOST_PERIODS + 1).collect()
        if len(rows) > MOST_PERIODS:
            raise ValueError(f"More than {MOST_PERIODS} periods in {list(columns)}")
        return cls(tuple(columns), tuple(sorted(tuple(r) for r in rows))) if rows or len(columns) == 1 else cls(
            tuple(columns), ((0,) * len(columns),))

    def period(self, value: Any) -> Period:
        """A period as a tuple: a number, a sequence, or a mapping with the period columns."""
        if isinstance(value, Mapping):
            value = [value[c] for c in self.columns]
            value = [v[0] if isinstance(v, (list, tuple)) else v for v in value]
        found = tuple(int(v) for v in (value if isinstance(value, (list, tuple)) else (value,)))
        if len(found) != len(self.columns):
            raise ValueError(f"{value!r} is no period of {list(self.columns)}")
        return found

    def previous(self, value: Any, by: str = BY_POSITION, back: int = 1) -> Period | None:
        """The period ``back`` places before, or None where the spine has none."""
        p = self.period(value)
        if by == BY_YEAR:
            before = (p[0] - back, *p[1:])
            return before if not self.periods or before in self.periods else None
        if by != BY_POSITION:
            raise ValueError(f"'by' must be {BY_POSITION!r} or {BY_YEAR!r}, not {by!r}")
        if not self.periods:
            return (p[0] - back,)
        at = bisect_left(self.periods, p) - back
        return self.periods[at] if at >= 0 else None

    def label(self, value: Any) -> str:
        return "-".join(map(str, self.period(value)))

    def is_in(self, periods: Iterable[Period | None]) -> Column:
        """Rows of these periods, as equalities that prune folders and row groups; None matches nothing."""
        wanted = [p for p in periods if p is not None]
        if len(self.columns) == 1:
            return F.col(self.columns[0]).isin([p[0] for p in wanted])
        tests = [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(self.columns, p)]) for p in wanted]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def filters(self, value: Any) -> dict[str, int]:
        return dict(zip(self.columns, self.period(value)))

    def following(self, table: DataFrame, by: str = BY_POSITION) -> DataFrame:
        """``table`` with every period replaced by the one that it is the period before of.

        Rows whose period comes before none are dropped. A spine without tuples is
        arithmetic; else it is joined as a small table of at most ``MOST_PERIODS`` rows.
        """
        if not self.periods:
            return table.withColumn(self.columns[0], F.col(self.columns[0]) + 1)
        pairs = [(self.previous(p, by), p) for p in self.periods]
        names = [*self.columns, *[f"__next_{c}" for c in self.columns]]
        steps = small_table(
            table.sparkSession, [(*a, *b) for a, b in pairs if a is not None], ", ".join(f"`{n}` long" for n in names))
        rest = [c for c in table.columns if c not in self.columns]
        return table.join(F.broadcast(steps), [*self.columns]).select(
            *[F.col(f"__next_{c}").alias(c) for c in self.columns], *rest)


YEARLY = Spine()
