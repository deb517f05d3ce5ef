"""Join each transaction to its context: blacklist, velocity, cards, home country, history."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.history import hot_velocity, trailing_counts
from riskloom.operators.skew import SLIDING_LIMIT, Split, broadcast_if, split_hot
from riskloom.schemas import WINDOW_1H, WINDOW_5MIN
from riskloom.session import settle

VELOCITY_WINDOWS = {"tx_count_last_5min": WINDOW_5MIN, "tx_count_last_1h": WINDOW_1H}


@dataclass(frozen=True)
class ScoringContext:
    """Context tables; a table left out keeps its rules silent and its features zero.

    ``blacklist(merchant_name)``, ``known_cards(user_id, card_last4)`` (distinct pairs),
    ``home_country(user_id, home_country)`` and ``history(user_id, avg_amount, std_amount)``
    (one row per user each). ``card_holders`` are the users of ``known_cards``, if already worked out.
    """

    blacklist: DataFrame | None = None
    known_cards: DataFrame | None = None
    home_country: DataFrame | None = None
    history: DataFrame | None = None
    card_holders: DataFrame | None = None

    def settled(self) -> ScoringContext:
        """The tables written once, as the joins want them, for a stream that meets them batch after batch."""

        def kept(table: DataFrame | None) -> DataFrame | None:
            return None if table is None else settle(table)

        listed = None if self.blacklist is None else settle(listed_names(self.blacklist))
        cards = None if self.known_cards is None else settle(self.known_cards.select("user_id", "card_last4").distinct())
        holders = None if cards is None else settle(holders_of(cards))
        return ScoringContext(listed, cards, kept(self.home_country), kept(self.history), holders)

    def restricted(self, split: Split) -> ScoringContext:
        """The per-user tables cut down to the hot users.

        Home country and history have a row per user, so they are as few as the users, which were
        counted; the cards are left to the runtime statistics.
        """
        users = broadcast_if(split.keys, split.few)

        def cut(table: DataFrame | None) -> DataFrame | None:
            return None if table is None else table.join(users, "user_id", "left_semi")

        def small(table: DataFrame | None) -> DataFrame | None:
            return None if table is None else broadcast_if(cut(table), split.few)

        return ScoringContext(self.blacklist, cut(self.known_cards), small(self.home_country), small(self.history))


def listed_names(blacklist: DataFrame) -> DataFrame:
    """The distinct names of a blacklist in lower case."""
    return blacklist.select(F.lower("merchant_name").alias("__listed")).dropna().distinct()


def holders_of(cards: DataFrame) -> DataFrame:
    """The users who have a known card."""
    return cards.select("user_id").distinct()


def mark_blacklisted(df: DataFrame, blacklist: DataFrame | None) -> DataFrame:
    """``merchant_listed``: the whole merchant name is on the list, ignoring case."""
    if blacklist is None:
        return df.withColumn("merchant_listed", F.lit(False))
    names = blacklist if blacklist.columns == ["__listed"] else listed_names(blacklist)
    merchant = F.lower(F.coalesce(F.col("merchant_name"), F.lit("")))
    joined = df.join(names, merchant == F.col("__listed"), "left")
    return joined.withColumn("merchant_listed", F.col("__listed").isNotNull()).drop("__listed")


def join_user_context(df: DataFrame, context: ScoringContext) -> DataFrame:
    """Left joins on the user; after a window by user the big side is already partitioned for them."""
    if context.home_country is None:
        df = df.withColumn("home_country", F.lit(None).cast("string"))
    else:
        df = df.join(context.home_country, "user_id", "left")
    if context.history is None:
        df = df.withColumns({name: F.lit(None).cast("double") for name in ("avg_amount", "std_amount")})
    else:
        df = df.join(context.history.select("user_id", "avg_amount", "std_amount"), "user_id", "left")
    if context.known_cards is None:
        return df.withColumns({"has_known_cards": F.lit(False), "card_is_known": F.lit(False)})
    holders = holders_of(context.known_cards) if context.card_holders is None else context.card_holders
    holders = holders.withColumn("has_known_cards", F.lit(True))
    pairs = context.known_cards.select("user_id", "card_last4").withColumn("card_is_known", F.lit(True))
    return df.join(holders, "user_id", "left").join(pairs, ["user_id", "card_last4"], "left")


def attach_context(
    df: DataFrame,
    context: ScoringContext,
    windows: Mapping[str, int] | None = None,
    hot_limit: int = SLIDING_LIMIT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """All context columns.

    Rows are shuffled once by user: the velocity windows and the joins on the user share that
    partitioning.  Users above ``hot_limit`` rows go another way: running-sum velocity and joins
    against the context of these few users.  ``counted`` is as in ``split_hot``.
    """
    windows = windows or VELOCITY_WINDOWS
    df = mark_blacklisted(df, context.blacklist)
    split = split_hot(df, ["user_id"], hot_limit, counted)
    cold = join_user_context(split.cold.withColumns(trailing_counts(windows)), context)
    if split.hot is None:
        return cold
    hot = join_user_context(hot_velocity(split, windows), context.restricted(split))
    return cold.unionByName(hot)
