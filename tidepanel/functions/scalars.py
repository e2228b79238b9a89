"""Scalar expressions over panel columns. All are plain column expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(c: str, sentinels: Sequence[str] = ()) -> Column:
    """Trimmed text; blank or a sentinel of this column is null."""
    t = F.trim(F.col(c))
    return F.when((t == "") | t.isin(*sentinels) if sentinels else t == "", None).otherwise(t)


def typed(c: Column, kind: str) -> Column:
    """A cast by kind that gives null instead of failing: string, int, double or yyyymm (first of the month)."""
    casts = {
        "string": lambda: c,
        "int": lambda: c.try_cast("int"),
        "double": lambda: c.try_cast("double"),
        "yyyymm": lambda: F.when(c.rlike("^[0-9]{6}$"), F.try_to_date(c, "yyyyMM")),
    }
    if kind not in casts:
        raise ValueError(f"no such kind: {kind}")
    return casts[kind]()


def cast_failures(c: Column, kind: str) -> Column:
    """How many values are there but not of their kind."""
    return F.count_if(c.isNotNull() & typed(c, kind).isNull())


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def status_months(status: Column) -> Column:
    return F.when(status.rlike("^[0-9]+$"), status.try_cast("int"))


def status_bucket(status: Column, top: int = 4, owned: str = "RA") -> Column:
    months = status_months(status)
    return F.when(status == owned, top).when(months.isNotNull(), F.least(months, F.lit(top)))


def status_owned(status: Column, owned: str = "RA") -> Column:
    return F.when(status == owned, True).when(status.rlike("^[0-9]+$"), False)


def first_range(value: Column, ranges: Mapping[str, tuple[int, int]]) -> Column:
    """The name of the first inclusive range that holds the value, else null."""
    out = None
    for name, (low, high) in ranges.items():
        out = (F if out is None else out).when(value.between(low, high), name)
    return out


def lookup(value: Column, table: Mapping[str, int]) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), value)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, F.try_divide(top, bottom))


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, (F.try_divide(now, before) - 1) * 100)


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def contacts(share: Column, n: Column) -> Column:
    """floor(share * n), safe against a share just under its decimal; a share outside [0, 1] is an error."""
    k = F.floor(share * n + F.lit(1e-9))
    return F.when(share.between(0, 1), k).otherwise(F.raise_error(F.concat(F.lit("capacity outside [0, 1]: "), share.cast("string"))).cast("long"))


def same_number(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-8) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def shuffled(seed, *keys: Column) -> Column:
    """A pseudo-random order of keys that depends on neither partitions nor engine."""
    return F.md5(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), *(k.cast("string") for k in keys)))


def capacity_grid(start: float, stop: float, step: float, extra: Sequence[float] = ()) -> list[float]:
    n = round((stop - start) / step)
    return sorted({round(x, 6) for x in [*(start + k * step for k in range(n + 1)), *extra, 1.0]})
