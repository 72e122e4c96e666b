"""Exact quantiles in a few scans, without shuffling the column or holding it in one task.

An approximate quantile sketch brackets the wanted rank. One more scan counts the rows below the
bracket and at its ends and selects the order statistic among the few rows strictly inside. A
bracket that still holds too many rows is narrowed by another sketch of its inside first. Only
scalars reach the driver, and the cut points become literals that can be pushed to the scan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_INSIDE = 1_000_000  # rows one aggregate may hold per wanted quantile


@dataclass
class _Ask:
    """One wanted quantile and what is known about the place of its rank."""

    column: str
    p: float
    group: tuple = ()
    low: float | None = None  # open interval (low, high) around the rank; None is unbounded
    high: float | None = None
    below: int = 0  # rows at or below ``low``
    inside: int = 0  # rows strictly between
    rank: int = 0  # zero-based rank of the lower neighbour
    fraction: float = 0.0
    width: float = 2 / ACCURACY
    bracket: Sequence[float] = ()
    found: dict[int, float] = field(default_factory=dict)

    def value(self, by: Sequence[str]) -> Column:
        c = F.col(self.column).cast("double")
        keep = c.isNotNull()
        for name, v in zip(by, self.group, strict=True):
            keep = keep & F.col(name).eqNullSafe(F.lit(v))
        if self.low is not None:
            keep = keep & (c > self.low)
        if self.high is not None:
            keep = keep & (c < self.high)
        return F.when(keep, c)

    @property
    def ranks(self) -> tuple[int, ...]:
        return (self.rank,) if self.fraction == 0 else (self.rank, self.rank + 1)

    @property
    def missing(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]


def quantile_values(
    df: DataFrame, asks: Sequence[tuple[str, float]], by: Sequence[str] = (), hold: bool = False
) -> dict[tuple, float | None]:
    """Linear-interpolation quantiles as ``{(column, p) or (column, p, *group): value}``.

    ``by`` must have few distinct values (classes, stages); they are listed by one aggregation.
    ``hold`` keeps the needed columns stored between the scans: right for derived panels, wrong
    for raw logs that are cheap to scan again.
    """
    if not hold:
        return _quantile_values(df, asks, by)
    needed = df.select(*dict.fromkeys([*by, *[c for c, _ in asks]])).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        return _quantile_values(needed, asks, by)
    finally:
        needed.unpersist()


def _quantile_values(
    df: DataFrame, asks: Sequence[tuple[str, float]], by: Sequence[str]
) -> dict[tuple, float | None]:
    asks = list(dict.fromkeys((c, float(p)) for c, p in asks))
    todo = _size(df, asks, by)
    result = {(a.column, a.p, *a.group): a for a in todo}
    todo = [a for a in todo if a.inside]
    if todo:
        _first_pass(df, todo, by)
    todo = [a for a in todo if a.missing]
    if todo:
        _resketch(df, todo, by)
    while todo:
        _narrow(df, todo, by)
        todo = [a for a in todo if a.missing]
    return {key: _interpolate(a) for key, a in result.items()}


def _run(df: DataFrame, exprs: Sequence[Column]) -> list:
    return list(df.agg(*[e.alias(f"x{i}") for i, e in enumerate(exprs)]).collect()[0])


def _run_by(df: DataFrame, by: Sequence[str], exprs: Sequence[Column]) -> dict[tuple, list]:
    """One row of results per group."""
    named = [e.alias(f"x{i}") for i, e in enumerate(exprs)]
    rows = df.groupBy(*by).agg(*named).collect()
    return {tuple(r[: len(by)]): list(r[len(by) :]) for r in rows}


def _sketch(value: Column, p: float, width: float) -> Column:
    return F.percentile_approx(value, [max(p - width, 0.0), min(p + width, 1.0)], ACCURACY)


def _size(df: DataFrame, asks: Sequence[tuple[str, float]], by: Sequence[str]) -> list[_Ask]:
    """Row counts, target ranks and first brackets: one scan, one sketch per column and group."""
    width = 2 / ACCURACY
    cols = list(dict.fromkeys(c for c, _ in asks))
    probs = {c: [p for name, p in asks if name == c] for c in cols}
    exprs: list[Column] = []
    for c in cols:
        v = F.col(c).cast("double")
        edges = [e for p in probs[c] for e in (max(p - width, 0.0), min(p + width, 1.0))]
        exprs += [F.count(v), F.min(v), F.max(v), F.percentile_approx(v, edges, ACCURACY)]
    out = []
    for group, got in _run_by(df, by, exprs).items():
        for i, c in enumerate(cols):
            n, lowest, highest, brackets = got[4 * i : 4 * i + 4]
            for k, p in enumerate(probs[c]):
                a = _Ask(c, p, group, inside=n)
                out.append(a)
                if not n:
                    continue
                position = p * (n - 1)
                a.rank = math.floor(position)
                a.fraction = position - a.rank
                a.bracket = brackets[2 * k : 2 * k + 2]
                a.found = {r: v for r, v in ((0, lowest), (n - 1, highest)) if r in a.ranks}
    return out


def _by_group(by: Sequence[str], values: Mapping[tuple, float]) -> Column:
    """The value that belongs to the row's group."""
    if not by:
        return F.lit(values.get((), None)).cast("double")
    out = F.lit(None).cast("double")
    for group, value in values.items():
        same = F.lit(True)
        for name, v in zip(by, group, strict=True):
            same = same & F.col(name).eqNullSafe(F.lit(v))
        out = F.when(same, F.lit(value)).otherwise(out)
    return out


def _first_pass(df: DataFrame, todo: Sequence[_Ask], by: Sequence[str]) -> None:
    """Count around all first brackets in one scan; where they can hold few rows, these are picked from in the same scan."""
    todo = [a for a in todo if a.missing]
    if not todo:
        return
    # ranks inside a first bracket: its width of 4 / ACCURACY, and the sketch's error of 1 / ACCURACY at both ends
    small = max(a.inside for a in todo) * 6 / ACCURACY <= MAX_INSIDE
    wanted = list(dict.fromkeys((a.column, a.p) for a in todo))
    place = {(a.column, a.p, *a.group): a for a in todo}
    exprs: list[Column] = []
    for c, p in wanted:
        mine = [a for a in todo if (a.column, a.p) == (c, p)]
        lo = _by_group(by, {a.group: a.bracket[0] for a in mine})
        hi = _by_group(by, {a.group: a.bracket[1] for a in mine})
        rank = F.max(_by_group(by, {a.group: float(a.rank) for a in mine})).cast("bigint")
        v = F.col(c).cast("double")
        middle = F.when((v > lo) & (v < hi), v)
        under, at_lo = F.count_if(v < lo), F.count_if(v == lo)
        exprs += [under, at_lo, F.count(middle), F.count_if((v == hi) & (lo != hi))]
        if small:
            ordered = F.sort_array(F.collect_list(middle))
            first = (rank - under - at_lo).cast("int")
            exprs += [F.get(ordered, first), F.get(ordered, first + 1)]
    step = 6 if small else 4
    for group, got in _run_by(df, by, exprs).items():
        for i, (c, p) in enumerate(wanted):
            a = place.get((c, p, *group))
            if a is not None:
                _place(a, got[step * i : step * i + 4], got[step * i + 4 : step * i + step])


def _place(a: _Ask, counts: Sequence[int], picks: Sequence[float | None]) -> bool:
    """Note the ranks that the counts around the bracket settle; whether the bracket holds all."""
    lo, hi = a.bracket
    under, at_lo, middle, at_hi = counts
    start = a.below + under
    end = start + at_lo + middle + at_hi
    if any(r < start or r >= end for r in a.missing):
        a.width *= 4  # the sketch missed a rank: bracket it more generously
        return False
    for r in a.missing:
        if r < start + at_lo:
            a.found[r] = lo
        elif r >= start + at_lo + middle:
            a.found[r] = hi
        elif picks and picks[r - a.rank] is not None:
            a.found[r] = picks[r - a.rank]
    if a.missing:
        a.low, a.high, a.below, a.inside = lo, hi, start + at_lo, middle
        a.width = 2 / ACCURACY
    return True


def _narrow(df: DataFrame, todo: Sequence[_Ask], by: Sequence[str]) -> None:
    """Count around each bracket and pick the wanted ranks, or sketch a narrower bracket."""
    exprs: list[Column] = []
    for a in todo:
        lo, hi = a.bracket
        v = a.value(by)
        middle = F.when((v > lo) & (v < hi), v)
        exprs += [F.count_if(v < lo), F.count_if(v == lo), F.count(middle)]
        exprs.append(F.count_if((v == hi) & F.lit(lo != hi)))
    got = _run(df, exprs)
    ready = [a for i, a in enumerate(todo) if _place(a, got[4 * i : 4 * i + 4], ()) and a.missing]
    _select(df, [a for a in ready if a.inside <= MAX_INSIDE], by)
    _resketch(df, [a for a in todo if a.missing], by)


def _select(df: DataFrame, ready: Sequence[_Ask], by: Sequence[str]) -> None:
    """Order statistics inside brackets of proven small size."""
    if not ready:
        return
    exprs, places = [], []
    for a in ready:
        ordered = F.sort_array(F.collect_list(a.value(by)))
        for r in a.missing:
            exprs.append(F.get(ordered, F.lit(r - a.below)))
            places.append((a, r))
    for (a, r), value in zip(places, _run(df, exprs), strict=True):
        a.found[r] = value


def _resketch(df: DataFrame, todo: Sequence[_Ask], by: Sequence[str]) -> None:
    if not todo:
        return
    exprs = []
    for a in todo:
        at = (a.missing[0] - a.below) / max(a.inside - 1, 1)
        exprs.append(_sketch(a.value(by), min(max(at, 0.0), 1.0), a.width))
    for a, bracket in zip(todo, _run(df, exprs), strict=True):
        a.bracket = bracket


def _interpolate(a: _Ask) -> float | None:
    if not a.found:
        return None
    low = a.found[a.rank]
    if a.fraction == 0:
        return low
    return low + (a.found[a.rank + 1] - low) * a.fraction


def quantile_frame(
    df: DataFrame, asks: Sequence[tuple[str, float, str]], by: Sequence[str] = ()
) -> DataFrame:
    """One row (per ``by``) of a panel with a column per ask ``(source column, p, output name)``."""
    values = quantile_values(df, [(c, p) for c, p, _ in asks], by, hold=True)
    groups = list(dict.fromkeys(k[2:] for k in values))
    rows = [
        tuple(g) + tuple(values[(c, float(p), *g)] for c, p, _ in asks) for g in groups
    ]
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema) if by else ""
    cols = ", ".join(f"`{out}` double" for _, _, out in asks)
    return df.sparkSession.createDataFrame(rows, ", ".join(x for x in (keys, cols) if x))
