"""Table operators: validation, soft deletion, filters, paging, sorting, response shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from riskloom.schemas import MAX_PAGE_SIZE


def violations() -> Column:
    """Names of the constraints a transaction row breaks."""

    def unless(name: str, holds: Column) -> Column:
        return F.when(~F.coalesce(holds, F.lit(False)), name)

    category = F.col("merchant_category")
    return F.array_compact(
        F.array(
            unless("transaction_id", F.col("transaction_id").isNotNull()),
            unless("amount", F.col("amount") > 0),
            unless("currency", F.length("currency") == 3),
            unless("merchant_name", F.length("merchant_name").between(1, 255)),
            unless("merchant_category", category.isNull() | (F.length(category) <= 100)),
            unless("card_last4", F.length("card_last4") == 4),
            unless("user_id", F.col("user_id").isNotNull()),
        )
    )


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``)."""
    checked = df.withColumn("reasons", violations())
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def latest(df: DataFrame, key: str = "transaction_id", time: str = "created_at") -> DataFrame:
    """One row per key: the one of the latest time, ties by the other columns' greatest values."""
    rest = sorted((name for name in df.columns if name != key), key=lambda name: name != time)
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("__last")).select(*[key if c == key else F.col(f"__last.`{c}`") for c in df.columns])


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def soft_delete(df: DataFrame, ids: DataFrame, now, row_id: str = "transaction_id") -> DataFrame:
    """New version of the table with ``deleted_at`` set for live rows named in ``ids``; no row is lost."""
    marked = ids.select(F.col(row_id)).distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit") & F.col("deleted_at").isNull()
    stamped = F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("deleted_at"))
    return df.join(marked, row_id, "left").withColumn("deleted_at", stamped).select(*df.columns)


def within(df: DataFrame, start, end, time: str = "created_at") -> DataFrame:
    """Rows with ``start <= time <= end``, None for an open end.

    A date column ``day`` is the day of ``time``, as the stores write it: bounds on it let a reader open only these days.
    """
    by_day = "day" in df.columns and df.schema["day"].dataType == DateType()
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            moment = F.lit(bound).cast("timestamp_ntz")
            day = F.to_date(moment)
            df = df.filter(F.col(time) >= moment if after else F.col(time) <= moment)
            if by_day:
                df = df.filter(F.col("day") >= day if after else F.col("day") <= day)
    return df


def filter_transactions(df: DataFrame, *, status=None, user_id=None, date_from=None, date_to=None) -> DataFrame:
    """Live transactions; every filter is optional, dates are inclusive."""
    df = live(df)
    if status is not None:
        df = df.filter(F.col("status") == status)
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    return within(df, date_from, date_to)


def filter_alerts(df: DataFrame, *, status=None, date_from=None, date_to=None) -> DataFrame:
    if status is not None:
        df = df.filter(F.col("status") == status)
    return within(df, date_from, date_to)


def get_by_id(df: DataFrame, value, row_id: str = "transaction_id") -> DataFrame:
    """Point lookup, deleted rows included."""
    return df.filter(F.col(row_id) == value)


def newest_first(df: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col(row_id))


def page(df: DataFrame, number: int, size: int, row_id: str = "transaction_id") -> DataFrame:
    """Page ``number`` (from 1) of the list, newest first."""
    _check_page(number, size)
    return newest_first(df, row_id).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, created_at, last_id, size: int, row_id: str = "transaction_id") -> DataFrame:
    """The page behind the given last row; unlike ``page`` its cost does not grow with depth."""
    _check_page(1, size)
    at = F.lit(created_at).cast("timestamp_ntz")
    behind = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col(row_id) > F.lit(last_id)))
    return newest_first(df.filter(behind), row_id).limit(size)


def _check_page(number: int, size: int) -> None:
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1, size lies in 1..{MAX_PAGE_SIZE}")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def sort_transactions(df: DataFrame, field: str, direction: str = "asc", row_id: str = "transaction_id") -> DataFrame:
    """Sorted by ``field``, empty values last in both directions, ties by id."""
    column = F.col(field)
    first = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    return df.orderBy(first, F.col(row_id))


def transaction_response(df: DataFrame) -> DataFrame:
    """List items as clients see them: amount as double, score as ``risk_score``."""
    return df.select(
        F.col("transaction_id").alias("id"),
        F.col("amount").cast("double").alias("amount"),
        *_present(df, ("currency", "merchant_name", "merchant_category", "card_last4", "status")),
        (F.col("ensemble_score") if "ensemble_score" in df.columns else F.lit(None).cast("double")).alias("risk_score"),
        *_present(df, ("user_id", "created_at", "updated_at")),
    )


def alert_response(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("alert_id").alias("id"),
        "transaction_id",
        "status",
        F.col("score").cast("double").alias("score"),
        F.col("threshold").cast("double").alias("threshold"),
        "classification",
        "reviewed_by",
        "reviewed_at",
        "created_at",
    )


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(name) for name in names if name in df.columns]
