"""How tables that grow with the sessions meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """rows for the other side of a join by session: both sides are shuffled and sorted, and rows are never sent whole to the driver.

    Spark judges a table by its compressed bytes. Rows of sessions repeat each other, so that millions of them look small enough to broadcast.
    """
    return rows.hint("merge")


#: Rows of sessions in one task.
ROWS = 200_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks that share rows, at least one a core. Of a written table, counting reads only what its files say of themselves."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def dealt(rows: DataFrame, tasks: int, *key: str) -> DataFrame:
    """rows by key over so many tasks, a number that is kept.

    Left alone, Spark puts partitions together until their compressed bytes are many or there is one a core, so that a task sorts rows that grow with the input.
    """
    return rows.repartition(tasks, *key)


def met(rows: DataFrame, other: DataFrame, key: list[str], tasks: int, how: str = "inner") -> DataFrame:
    """rows with those of other, both dealt by key."""
    return dealt(rows, tasks, *key).join(spread(dealt(other, tasks, *key)), key, how)
