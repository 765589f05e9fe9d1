"""Registration of queries with their SQL, and the tables as most queries want them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from evidra.sources.tables import table


class Registry:
    """Queries of one module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Register a query with its SQL."""

        def keep(run: Callable) -> Callable:
            self.queries[run.__name__] = run
            if sql is not None:
                self.oracles[run.__name__] = sql
            return run

        return keep


def rows_of(spark: SparkSession, folder: str, name: str, *columns: Column | str, where: Column | str | None = None) -> DataFrame:
    """Rows of a table by ``id``, redelivered ones once, with only the columns and expressions that are needed.

    Redelivered rows are equal, so rows are filtered and expressions taken first: filters reach the
    scan, and the shuffle behind the removal of repeats holds small results only.
    """
    rows = table(spark, folder, name)
    return (rows if where is None else rows.where(where)).select("id", *columns).dropDuplicates(["id"])


#: Findings and files once each, for SQL.
FINDINGS_SQL = "with f as (select * from findings qualify row_number() over (partition by id order by loaded_at) = 1), "
FILES_SQL = "with fi as (select * from files qualify row_number() over (partition by id order by observed_at) = 1), "
