"""As-of joins: which rows held on the day of each request, with a day for each request.

Days are counted from year 1. A validity range, ends included, is cut into blocks of 1, 2, 4, ... days that start at multiples of their length: at most two blocks
of each length, none over another (the nodes of a binary tree that cover the range). A day lies in one block of each length. So a request meets a range that holds
its day in exactly one block, by an equality join of (length, block); a range costs at most twice as many rows as its length has binary digits, however long it is, and no
pair is met twice or tested afterwards. An open end takes the first or the last day there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 22  # 2**22 days are over 11,000 years
_DAY_ONE = "0001-01-01"


def day_number(day: Column) -> Column:
    """Days since year 1 of an ISO date, or null where it is none (an empty one too)."""
    return F.date_diff(F.try_to_date(F.nullif(F.trim(day), F.lit("")), "yyyy-MM-dd"), F.lit(_DAY_ONE).cast("date"))


def blocks_of_range(first: Column, last: Column) -> Column:
    """array<struct<level, block>> of the blocks that cover the days first..last (day numbers; none if last is before first)."""

    def at(level: Column) -> Column:
        length = F.pow(F.lit(2.0), level)
        lo, hi = F.ceil(first / length).cast("long"), F.floor((last + 1) / length).cast("long")
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(level.cast("int").alias("level"), lo.alias("block")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(level.cast("int").alias("level"), (hi - 1).alias("block")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)), lambda x: x.isNotNull())


def blocks_of_day(day: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.cast("int").alias("level"), F.floor(day / F.pow(F.lit(2.0), level)).cast("long").alias("block")))


def _cut(rows: DataFrame, first: str, last: str) -> DataFrame:
    """``rows`` for each block of their range (level_, block_)."""
    known = rows.withColumns({"from_": day_number(F.col(first)), "to_": day_number(F.col(last))}).where("from_ IS NOT NULL OR to_ IS NOT NULL")
    ends = F.coalesce("from_", F.lit(0)), F.coalesce("to_", F.lit((1 << LEVELS) - 1))
    return known.withColumn("b_", F.explode(blocks_of_range(*ends))).withColumns({"level_": F.col("b_.level"), "block_": F.col("b_.block")}).drop("from_", "to_", "b_")


def _asked(requests: DataFrame, day: str) -> DataFrame:
    """``requests`` for each block of their day (at_level_, at_block_)."""
    asked = requests.withColumn("day_", day_number(F.col(day))).where("day_ IS NOT NULL")
    return asked.withColumn("q_", F.explode(blocks_of_day(F.col("day_")))).withColumns({"at_level_": F.col("q_.level"), "at_block_": F.col("q_.block")}).drop("day_", "q_")


def _met(asked: DataFrame, cut: DataFrame) -> DataFrame:
    return asked.join(cut, (F.col("at_level_") == F.col("level_")) & (F.col("at_block_") == F.col("block_"))).drop("level_", "block_", "at_level_", "at_block_")


def in_force(requests: DataFrame, rows: DataFrame, day: str = "as_of", first: str = "effective_date", last: str = "expire_date") -> DataFrame:
    """Each request (with its other columns) beside each of ``rows`` that held on its day. A row with neither end known holds on no day; requests without a day meet nothing. Columns of the two must differ in name."""
    return _met(_asked(requests, day), _cut(rows, first, last))


def latest_in_force(requests: DataFrame, rows: DataFrame, by: str, request: str, key: str, day: str = "as_of", first: str = "effective_date", last: str = "expire_date") -> DataFrame:
    """For each request and value of ``by``: how many rows held on the day, and the key of the one that came into force last (ties to the smaller key).

    A day meets a range in one block, so numbers and last ones of a block's rows add up to those of a day: rows become a row for each block and ``by``, which the days
    that occur meet once each, however many requests a day has; no request meets a row."""
    order = F.struct(F.col(first), -F.col(key))
    blocks = _cut(rows.select(by, key, first, last), first, last).groupBy("level_", "block_", by).agg(F.count("*").alias("in_force"), F.max_by(key, order).alias("latest"), F.max(order).alias("last_"))
    asked = requests.repartition(request).groupBy(request, day).agg(F.count("*").alias("times_"))
    days = _met(_asked(asked.select(F.col(day).alias("of_")).distinct(), "of_"), blocks).groupBy("of_", by).agg(F.sum("in_force").alias("in_force"), F.max_by("latest", "last_").alias("latest"), F.max("last_").alias("last_"))
    found = asked.join(days, F.col(day) == F.col("of_"))
    return found.groupBy(request, by).agg(F.sum(F.col("in_force") * F.col("times_")).alias("in_force"), F.max_by("latest", "last_").alias("latest"))
