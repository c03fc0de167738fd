"""Running totals over one global order without moving all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import written

SLICE = "_slice"


def slice_bounds(df: DataFrame, order: Sequence[tuple[str, bool]], slices: int | None = None) -> list[tuple]:
    """First keys of the slices after the first one: at most one per slice, from one small job."""
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]
    keys = [c for c, _ in order]
    ranged = df.select(*keys).repartitionByRange(*([slices] if slices else []), *ordering)
    # Falling columns are negated, so that the least struct of a slice is its first key.
    rising = F.struct(*[(-F.col(c) if d else F.col(c)).alias(c) for c, d in order])
    found = ranged.groupBy(F.spark_partition_id()).agg(F.min(rising).alias("first")).select("first.*").collect()
    return [tuple(-v if d else v for v, (_, d) in zip(r, order)) for r in sorted(map(tuple, found))[1:]]


def slice_number(df: DataFrame, order: Sequence[tuple[str, bool]], bounds: Sequence[tuple]) -> Column:
    """How many bounds a row has reached, by bisection; a function of the row alone."""
    # Without bounds one that no row reaches keeps the number a column, on which slices can be joined.
    bounds = bounds or [(None,) * len(order)]
    types = dict(df.dtypes)
    listed = F.array(*[F.struct(*[F.lit(v).cast(types[c]).alias(c) for v, (c, _) in zip(b, order)]) for b in bounds])

    def reached(bound: Column) -> Column:
        result = F.lit(True)
        for c, descending in reversed(order):
            beyond = F.col(c) < bound[c] if descending else F.col(c) > bound[c]
            result = beyond | ((F.col(c) == bound[c]) & result)
        return result

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def advance(done: Column, step: Column) -> Column:
        ahead = done + step
        return F.when((ahead <= len(bounds)) & F.coalesce(reached(F.get(listed, ahead - 1)), F.lit(False)), ahead).otherwise(done)

    return F.aggregate(steps, F.lit(0), advance)


def running_totals(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sums: Sequence[str],
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (total up to and with the row) and ``all_<c>`` (total of the group) for each
    ``sums`` column, and ``next_<c>`` (value in the following row, NULL in the last) for each ``lead``
    column.

    ``order`` lists (column, descending) of numbers and must be unique within a group of ``by``; ``lead``
    needs a single order column. ``df`` is written once, as it is read several times; it should be grouped
    already. One small job picks the bounds of the slices; a row's slice then depends on the row alone. Each slice sums its own rows and adds the total of the slices before it, so the only
    unsplit window runs over one row per slice.
    """
    if lead and len(order) != 1:
        raise ValueError("lead columns need exactly one order column")
    by = list(by)
    df = written(df, "totals")
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]
    rows = df.withColumn(SLICE, slice_number(df, order, slice_bounds(df, order, slices)))

    totals = [F.sum(c).alias(f"_sum_{c}") for c in sums]
    if lead:
        key, descending = order[0]
        pick = F.max_by if descending else F.min_by
        totals.append(pick(F.struct(*lead), F.col(key)).alias("_head"))
    group = Window.partitionBy(*by)
    before = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, SLICE).agg(*totals).select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col(SLICE).alias("_at"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(group).alias(f"all_{c}") for c in sums],
        *([F.lead("_head").over(group.orderBy(SLICE)).alias("_next_head")] if lead else []),
    )

    here = Window.partitionBy(*by, SLICE).orderBy(*ordering)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_here_{c}") for c in sums],
        *([F.lead(F.struct(*lead)).over(here).alias("_next")] if lead else []),
    )
    match = F.col(SLICE) == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    following = F.coalesce("_next", "_next_head") if lead else None
    return summed.join(offsets, match).select(
        *df.columns,
        *[(F.col(f"_here_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
        *[following[c].alias(f"next_{c}") for c in lead],
    )
