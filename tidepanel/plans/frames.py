"""Declared features: an aggregate, a calendar frame and its sources. Expressions, registry and the latest month that a
feature reads all come from one declaration, so they can't disagree. All share one window, hence one exchange."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

START = Window.unboundedPreceding


@dataclass(frozen=True)
class Feature:
    name: str
    agg: str  # SQL aggregate over the frame
    low: int
    high: int
    sources: tuple[str, ...] = ()
    after: str | None = None  # SQL over {x}, the aggregate, and columns of the row

    @property
    def window_end(self) -> int:
        return max(self.high, 0) if self.after and "{x}" != self.after else self.high

    def column(self, key: str, order: str) -> Column:
        return F.expr(self.agg).over(window(key, order, self.low, self.high))


def window(key: str, order: str, low: int, high: int) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rangeBetween(low, high)


def applied(df: DataFrame, features: Sequence[Feature], key: str, order: str) -> DataFrame:
    """All features in one select over one window, then what is derived from them in a second."""
    df = df.select("*", *(f.column(key, order).alias(f.name) for f in features))
    late = {f.name: F.expr(f.after.format(x=f.name)) for f in features if f.after}
    return df.withColumns(late) if late else df


class LeakageError(ValueError):
    pass


BLOCKED = ("label", "outcome", "future", "zero_balance", "rolls_deeper")


def audit(features: Sequence[Feature], columns: Sequence[str] = (), blocked: Sequence[str] = BLOCKED) -> None:
    """Refuses features that read past the row's month or from blocked columns, and columns nobody declared."""
    for f in features:
        if f.window_end > 0:
            raise LeakageError(f"{f.name} reads {f.window_end} months ahead")
        for s in f.sources:
            if any(b in s.lower() for b in blocked):
                raise LeakageError(f"{f.name} reads {s}")
    if extra := set(columns) - {f.name for f in features}:
        raise LeakageError(f"not declared: {sorted(extra)}")


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    message: str = ""


def require(checks: Sequence[Check], accepted: dict[str, str] | None = None) -> None:
    """Fails unless each check passed or is accepted with a reason of 20 characters or more."""
    accepted = accepted or {}
    if unknown := set(accepted) - {c.name for c in checks}:
        raise ValueError(f"no such checks: {sorted(unknown)}")
    if short := [k for k, v in accepted.items() if len(v.strip()) < 20]:
        raise ValueError(f"reasons too short: {short}")
    if failed := [c for c in checks if not c.passed and c.name not in accepted]:
        raise AssertionError("; ".join(f"{c.name}: {c.message}" for c in failed))
