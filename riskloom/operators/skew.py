"""Per-key ordered computations that hold when one key owns a large share of the rows.

A window partitioned by a key puts all rows of that key into one task.  The operators here count the
rows per key first (a column-pruned aggregation with map-side combine) and keep the plain window for
all keys below a limit.  Only the rows of hotter keys take the two-level way: range partitioning on
(key, order) cuts a hot key into balanced cells, a window runs inside each cell, and the totals of
the earlier cells - one small row per cell - are added.  Both ways give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import settle

# Rows of one key that one task may scan in order, and, since a sliding frame is evaluated anew for
# every row, the lower number that it may slide over.
HOT_LIMIT = 1_000_000
SLIDING_LIMIT = 100_000
# Rows of a cell: at least about the first number, at most about the second up to the number of cells.
SMALL_CELL = 1_000
CELL_ROWS = 2_000_000
MAX_CELLS = 20_000
BROADCAST_KEYS = 100_000
_CELL = "__cell"


@dataclass(frozen=True)
class Split:
    """Rows of keys below the limit, rows of hot keys, the hot keys, and how many these are."""

    cold: DataFrame
    hot: DataFrame | None = None
    keys: DataFrame | None = None
    n_keys: int = 0

    @property
    def few(self) -> bool:
        """Whether the hot keys were counted to be few enough to broadcast."""
        return self.n_keys <= BROADCAST_KEYS


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def broadcast_if(frame: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(frame) if small else frame


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = HOT_LIMIT, counted: DataFrame | None = None
) -> Split:
    """Split ``df`` by whether a key has more than ``limit`` rows.

    ``counted`` is a cheaper table with the same keys, row by row, as ``df`` has, such as the table
    ``df`` was joined from.
    """
    source = df if counted is None else counted
    counts = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot_keys = counts.filter(F.col("__rows") > limit).select(*keys)
    n_keys = hot_keys.count()
    if n_keys == 0:
        return Split(df)
    hot_keys = settle(hot_keys)
    # There can be at most rows / limit hot keys; they are broadcast only if they are in fact few.
    side = broadcast_if(hot_keys, n_keys <= BROADCAST_KEYS)
    condition = null_safe(df, side, keys)
    cold, hot = df.join(side, condition, "left_anti"), df.join(side, condition, "left_semi")
    return Split(cold, hot, hot_keys, n_keys)


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, base: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(base.isNull(), local).when(local.isNull(), base).otherwise(base + local)
    return F.least(base, local) if kind == "min" else F.greatest(base, local)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    position: str | None = None,
    previous: Mapping[str, str] | None = None,
    prior: Mapping[str, tuple[str, Column]] | None = None,
    hot_limit: int = HOT_LIMIT,
) -> DataFrame:
    """Walk the rows of each key in ``order`` (ascending, total) and add

    * ``position``: the 1-based place of the row,
    * ``previous``: new column -> existing column, the value in the row before (NULL at the start),
    * ``prior``: new column -> (``sum`` | ``min`` | ``max``, expression) over all rows before
      (NULL at the start).

    Without ``keys`` the whole table is one ordered run and always takes the two-level way.
    """
    previous, prior = dict(previous or {}), dict(prior or {})
    if not keys:
        return two_level_scan(df, [], order, 0, position=position, previous=previous, prior=prior)
    split = split_hot(df, keys, hot_limit)
    plain = _windowed(split.cold, keys, order, position, previous, prior)
    if split.hot is None:
        return plain
    scanned = two_level_scan(split.hot, keys, order, split.n_keys, position=position, previous=previous, prior=prior)
    return plain.unionByName(scanned)


def _windowed(df, keys, order, position, previous, prior) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    columns = {}
    if position:
        columns[position] = F.row_number().over(window).cast("long")
    for name, source in previous.items():
        columns[name] = F.lag(source).over(window)
    for name, (kind, expression) in prior.items():
        columns[name] = _MERGE[kind](expression).over(before)
    return df.withColumns(columns)


def _cells(n: int, partitions: int) -> int:
    """As many cells as the session has partitions, fewer for small data and more for large data."""
    few, many = math.ceil(n / SMALL_CELL), math.ceil(n / CELL_ROWS)
    return max(1, min(few, partitions), min(many, MAX_CELLS))


def two_level_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n_keys: int,
    *,
    position: str | None = None,
    previous: Mapping[str, str] | None = None,
    prior: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """``ordered_scan`` of few keys with many rows each; ``n_keys`` is their number."""
    previous, prior = dict(previous or {}), dict(prior or {})
    # Range partitioning reads its input twice, and the number of cells depends on its size.
    df = settle(df)
    cells = _cells(df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The range bounds are sampled, so the cell of a row is fixed in a table before it is used twice.
    placed = settle(df.repartitionByRange(cells, *keys, *order).withColumn(_CELL, F.spark_partition_id()))
    local = _windowed(
        placed,
        [*keys, _CELL],
        order,
        "__place",
        {f"__l_{name}": source for name, source in previous.items()},
        {f"__l_{name}": spec for name, spec in prior.items()},
    )
    totals = [F.count(F.lit(1)).alias("__n")]
    totals += [_MERGE[kind](expression).alias(f"__t_{name}") for name, (kind, expression) in prior.items()]
    if previous:
        last = F.struct(*[F.col(source).alias(name) for name, source in previous.items()])
        totals.append(F.max_by(last, F.struct(*order)).alias("__last"))
    per_cell = placed.groupBy(*keys, _CELL).agg(*totals)
    # At most one row per cell and key: no key has more rows here than there are cells.
    run = Window.partitionBy(*keys).orderBy(_CELL) if keys else Window.partitionBy(F.lit(0)).orderBy(_CELL)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.sum("__n").over(earlier).alias("__b_place")]
    offsets += [_MERGE[kind](f"__t_{name}").over(earlier).alias(f"__b_{name}") for name, (kind, _) in prior.items()]
    if previous:
        offsets.append(F.lag("__last").over(run).alias("__b_last"))
    bases = per_cell.select(*keys, _CELL, *offsets)
    # Ranges of neighbouring keys share cells, so there are fewer bases than keys plus cells.
    few = n_keys + cells <= BROADCAST_KEYS
    side = broadcast_if(bases.withColumnsRenamed({key: f"__k_{key}" for key in [*keys, _CELL]}), few)
    condition = F.lit(True)
    for key in [*keys, _CELL]:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    joined = local.join(side, condition)
    columns = [F.col(name) for name in df.columns]
    if position:
        columns.append((F.coalesce(F.col("__b_place"), F.lit(0)) + F.col("__place")).alias(position))
    for name in previous:
        inside, carried = F.col(f"__l_{name}"), F.col(f"__b_last.{name}")
        columns.append(F.when(F.col("__place") > 1, inside).otherwise(carried).alias(name))
    for name, (kind, _) in prior.items():
        columns.append(_combine(kind, F.col(f"__b_{name}"), F.col(f"__l_{name}")).alias(name))
    return joined.select(*columns)
