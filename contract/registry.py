"""Registration of queries together with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contract.derived import given


class Given:
    """The given tables as attributes: ``d.orders``, ``d.lineitem`` ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return given(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register the function under its name; without SQL only rows are checked."""

        def register(build: Callable[[Given], DataFrame]):
            self.queries[build.__name__] = lambda spark, sf_dir: build(Given(spark, sf_dir))
            if sql is not None:
                self.sql[build.__name__] = sql
            return build

        return register
