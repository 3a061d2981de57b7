"""Rows by key: a table of keys asks, so that one look-up and a million are the same join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def looked_up(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The row of each wanted key that the table has; a null or zero key asks for nothing."""
    asked = wanted.select(key).where(F.col(key).isNotNull() & (F.col(key) != 0)).distinct()
    return table.join(asked, key, "left_semi")


def decoded_attempts(attempts: DataFrame) -> DataFrame:
    """attempts with order (ids of questions, none if there is no order) and cur_perm (null if no question is shown) read from their JSON."""
    blank = F.coalesce(F.trim("cur_perm_json"), F.lit("")) == ""
    order = F.coalesce(F.from_json("order_json", "array<bigint>"), F.array().cast("array<bigint>"))
    return attempts.withColumns({"order": order, "cur_perm": F.when(~blank, F.from_json("cur_perm_json", "array<int>"))}).drop("order_json", "cur_perm_json")


def attempts_by_poll(attempts: DataFrame, polls: DataFrame) -> DataFrame:
    """The running attempt that shows each poll (poll_id), with the poll."""
    running = attempts.where((F.col("status") == "active") & F.col("cur_poll_id").isNotNull())
    return running.join(polls.select(F.col("poll_id").alias("cur_poll_id")).distinct(), "cur_poll_id")


def listed(table: DataFrame, key: str) -> DataFrame:
    """table with n, the place of each row in the order of its key."""
    return numbered(table, [], [F.asc(key)], "n")
