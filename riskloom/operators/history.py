"""User history, known cards, home country, velocity and point-in-time statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.skew import HOT_LIMIT, SLIDING_LIMIT, Split, ordered_scan, split_hot, two_level_scan
from riskloom.schemas import WINDOW_1H, WINDOW_5MIN
from riskloom.session import settle


def user_history(df: DataFrame, *, user="user_id", amount="amount", label: str | None = "is_fraud") -> DataFrame:
    """Per user over the legitimate rows: mean, population standard deviation and row count.

    The mean comes from an exact decimal sum, so it does not depend on the order of the rows.
    """
    rows = df if label is None else df.filter(F.col(label) == 0)
    value = F.col(amount)
    return rows.groupBy(user).agg(
        F.try_divide(F.sum(value.cast("decimal(12,2)")).cast("double"), F.count(value)).alias("avg_amount"),
        F.stddev_pop(value.cast("double")).alias("std_amount"),
        F.count(value).alias("n_transactions"),
    )


def attach_history(df: DataFrame, history: DataFrame, *, user="user_id") -> DataFrame:
    """Left join of the history; users without one get zeros.  Spark picks the strategy by size."""
    stats = ["avg_amount", "std_amount"]
    joined = df.join(history.select(user, *stats), user, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0.0)) for name in stats})


def known_cards(df: DataFrame, *, user="user_id", card="card_last4") -> DataFrame:
    """The distinct (user, card) pairs; long form, so that no user's cards have to fit one row."""
    return df.filter(F.length(card) > 0).select(user, card).distinct()


def home_country(users: DataFrame, nations: DataFrame) -> DataFrame:
    """``user_id, home_country`` from a user table and its country table."""
    return users.join(nations, "nation_id", "left").select("user_id", "home_country")


def velocity(
    df: DataFrame,
    windows: Mapping[str, int] | None = None,
    *,
    user="user_id",
    ts="ts",
    hot_limit: int = SLIDING_LIMIT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Rows of the same user in trailing windows (seconds), the current row and ties included.

    One shuffle by user serves every window.  Users with more than ``hot_limit`` rows are counted
    through running sums instead (see ``hot_velocity``); ``counted`` as in ``split_hot``.
    """
    windows = windows or {"tx_count_last_5min": WINDOW_5MIN, "tx_count_last_1h": WINDOW_1H}
    split = split_hot(df, [user], hot_limit, counted)
    plain = split.cold.withColumns(trailing_counts(windows, user=user, ts=ts))
    if split.hot is None:
        return plain
    return plain.unionByName(hot_velocity(split, windows, user=user, ts=ts))


def trailing_counts(windows: Mapping[str, int], *, user="user_id", ts="ts") -> dict[str, Column]:
    """Window Columns of ``velocity``; a row without a time counts nothing."""
    frame = "PARTITION BY `{u}` ORDER BY `{t}` RANGE BETWEEN INTERVAL '{s}' SECOND PRECEDING AND CURRENT ROW"
    return {
        name: F.expr(f"CASE WHEN `{ts}` IS NOT NULL THEN count(1) OVER ({frame.format(u=user, t=ts, s=int(s))}) END")
        for name, s in windows.items()
    }


def hot_velocity(split: Split, windows: Mapping[str, int], *, user="user_id", ts="ts") -> DataFrame:
    """The counts as running sums: a row adds one when it comes and takes it back when its window ends.

    Rows are first collapsed to one per (user, time).  A row still counts at the very end of its
    window, so endings sort behind rows of the same time.  The cost does not depend on how many rows
    a window holds, which a sliding frame's does.
    """
    df = settle(split.hot)  # read for the points and again for the result
    per_time = df.filter(F.col(ts).isNotNull()).groupBy(user, ts).agg(F.count(F.lit(1)).alias("__n"))
    steps = {f"__step_{i}": name for i, name in enumerate(windows)}

    def point(at: Column, mark: int, **changes: Column) -> Column:
        return F.struct(at.alias("__at"), F.lit(mark).alias("__mark"), *[changes.get(s, F.lit(0).cast("long")).alias(s) for s in steps])

    points = [point(F.col(ts), 0, **{s: F.col("__n") for s in steps})]
    for i, seconds in enumerate(windows.values()):
        ends = F.col(ts) + F.expr(f"INTERVAL '{int(seconds)}' SECOND")
        points.append(point(ends, i + 1, **{f"__step_{i}": -F.col("__n")}))
    points = per_time.select(user, F.inline(F.array(*points)))
    before = {f"__before{s}": ("sum", F.col(s)) for s in steps}
    walked = two_level_scan(points, [user], ["__at", "__mark"], split.n_keys, prior=before)
    counts = walked.filter(F.col("__mark") == 0).select(
        F.col(user).alias("__user"),
        F.col("__at").alias("__ts"),
        *[(F.coalesce(F.col(f"__before{s}"), F.lit(0)) + F.col(s)).alias(name) for s, name in steps.items()],
    )
    same = F.col(user).eqNullSafe(F.col("__user")) & (F.col(ts) == F.col("__ts"))
    return df.join(counts, same, "left").drop("__user", "__ts")


def point_in_time_history(
    df: DataFrame,
    *,
    user="user_id",
    ts="ts",
    row_id="transaction_id",
    amount="amount",
    hot_limit: int = HOT_LIMIT,
) -> DataFrame:
    """Mean and population deviation of the user's earlier rows only, zero where there are none."""
    value = F.col(amount).cast("decimal(12,2)")
    scanned = ordered_scan(
        df,
        [user],
        [ts, row_id],
        prior={
            "__n": ("sum", F.lit(1).cast("long")),
            "__sum": ("sum", value),
            "__squares": ("sum", value * value),
        },
        hot_limit=hot_limit,
    )
    n = F.col("__n")
    mean = F.col("__sum").cast("double") / n
    # In whole cents: squares about a whole number next to the mean are summed exactly, so nothing cancels.
    total = (F.col("__sum") * 100).cast("decimal(26,0)")
    middle = F.floor(total / n).cast("decimal(14,0)")
    rest = (total - middle * n).cast("decimal(24,0)")
    about = (F.col("__squares") * 10000).cast("decimal(38,0)") - middle * (total + rest).cast("decimal(27,0)")
    variance = about.cast("double") / n - F.pow(rest.cast("double") / n, F.lit(2))
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0))) / 100
    return scanned.withColumns(
        {
            "prior_count": F.coalesce(n, F.lit(0)),
            "prior_avg_amount": F.coalesce(mean, F.lit(0.0)),
            "prior_std_amount": F.coalesce(deviation, F.lit(0.0)),
        }
    ).drop("__n", "__sum", "__squares", "__low", "__high")
