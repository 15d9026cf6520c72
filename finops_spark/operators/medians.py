"""Exact medians and modes without one large group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many values the built-in median (one task, all values) is used.
DIRECT_ROWS = 100_000
# A bracket around the median is narrowed until it holds at most this many values.
BRACKET_ROWS = 100_000
# Relative accuracy of the sketch, and a margin in ranks wider than its error.
_ACCURACY = 10_000
_MARGIN = 4e-4


def exact_medians(
    df: DataFrame,
    columns: Mapping[str, Column],
    direct_rows: int = DIRECT_ROWS,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, float | None]:
    """Median of each expression (mean of the two middle values on even counts).

    Large columns: a mergeable sketch proposes a bracket, one pass counts the
    rows below and inside it, and this repeats on the inside until few values are
    left, which are then sorted. Only counts and a bracket reach the driver.
    """
    if not columns:
        return {}
    names = list(columns)
    values = df.select(*[_clean(columns[n]).alias(f"v{i}") for i, n in enumerate(names)])
    at = range(len(names))
    # The first range around one half needs no count, so both come from one pass.
    first = values.agg(
        *[F.count(f"v{i}") for i in at],
        *[F.percentile_approx(f"v{i}", [0.5 - _MARGIN, 0.5 + _MARGIN], _ACCURACY) for i in at],
    ).first()
    counts, sketches = first[: len(names)], first[len(names) :]
    found: dict[str, float | None] = {n: None for n in names}
    small = [i for i in at if 0 < counts[i] <= direct_rows]
    if small:
        row = values.agg(*[F.median(f"v{i}") for i in small]).first()
        found.update({names[i]: row[k] for k, i in enumerate(small)})
    searches = {i: _Search(counts[i], sketches[i]) for i in at if counts[i] > direct_rows}
    while searches:
        _narrow(values, searches)
        _sort_rest(values, {i: s for i, s in searches.items() if s.middle is None and s.inside <= bracket_rows})
        for i in [i for i, s in searches.items() if s.middle is not None]:
            found[names[i]] = searches.pop(i).middle
    return found


class _Search:
    """The closed range [lo, hi] known to hold the middle ranks of ``n`` values."""

    def __init__(self, n: int, proposed: Sequence[float]) -> None:
        self.k1, self.k2 = (n - 1) // 2, n // 2
        self.lo, self.hi = float("-inf"), float("inf")
        self.below, self.inside = 0, n
        self.margin = _MARGIN
        self.middle: float | None = None
        self.proposed: Sequence[float] | None = proposed

    def holds(self, v: Column) -> Column:
        return v.between(F.lit(self.lo), F.lit(self.hi))

    def settle(self, lo: float, hi: float, below: int, at_lo: int, between: int, first: float, last: float, at_hi: int):
        """Use exact counts around a proposed [lo, hi] to close in on the ranks.

        The ends are values of the column, so the range always gets smaller, also
        when a few values fill most of it.
        """
        total = below + at_lo + between + at_hi
        if self.k1 < below or self.k2 >= total:
            self.margin *= 8  # the sketch missed; propose a wider range
            return

        def zone(k: int) -> int:
            return 0 if k < below + at_lo else 1 if k < below + at_lo + between else 2

        z1, z2 = zone(self.k1), zone(self.k2)
        if z1 == z2 == 1:
            self.lo, self.hi, self.below, self.inside = first, last, below + at_lo, between
        else:  # at least one rank sits on an end, so the other is next to it
            self.middle = ((lo, last, hi)[z1] + (lo, first, hi)[z2]) / 2


def _clean(expression: Column) -> Column:
    number = expression.cast("double")
    return F.when(~F.isnan(number), number)


def _narrow(values: DataFrame, searches: dict[int, _Search]) -> None:
    sketches = {}
    for i, s in searches.items():
        if s.proposed is None:
            lo = max(0.0, (s.k1 - s.below) / s.inside - s.margin)
            hi = min(1.0, (s.k2 - s.below) / s.inside + s.margin)
            v = F.col(f"v{i}")
            sketches[i] = F.percentile_approx(F.when(s.holds(v), v), [lo, hi], _ACCURACY)
    if sketches:
        row = values.agg(*sketches.values()).first()
        for k, i in enumerate(sketches):
            searches[i].proposed = row[k]
    counting = []
    for i in searches:
        (lo, hi), v = searches[i].proposed, F.col(f"v{i}")
        strict = (v > lo) & (v < hi)
        counting += [
            F.count_if(v < lo),
            F.count_if(v == lo),
            F.count_if(strict),
            F.min(F.when(strict, v)),
            F.max(F.when(strict, v)),
            F.count_if((v == hi) & F.lit(lo != hi)),
        ]
    counted = values.agg(*counting).first()
    for at, (i, s) in enumerate(searches.items()):
        s.settle(*s.proposed, *counted[6 * at : 6 * at + 6])
        s.proposed = None


def _sort_rest(values: DataFrame, searches: dict[int, _Search]) -> None:
    if not searches:
        return
    middle = []
    for i, s in searches.items():
        v = F.col(f"v{i}")
        inside = F.sort_array(F.collect_list(F.when(s.holds(v), v)))
        middle.append(F.slice(inside, s.k1 - s.below + 1, s.k2 - s.k1 + 1))
    row = values.agg(*middle).first()
    for at, s in enumerate(searches.values()):
        s.middle = sum(row[at]) / len(row[at])


def exact_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, n): most frequent non-null value, the smallest on ties.

    Counting by (column, value) combines on the map side, so a value that fills a
    third of the table costs no more than any other.
    """
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("p")
    ).select("p.*")
    counted = pairs.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "value")).alias("best"))
        .select("column", F.col("best.value").alias("mode"), (-F.col("best.minus_n")).alias("n"))
    )
