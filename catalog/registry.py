"""Named queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.bridge import oracle as oracle_text, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Views by attribute: ``s.mis`` is the ``mis`` view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Source], DataFrame]], Callable]:
    """Registers a function of a :class:`Source` under ``name``, with the SQL that gives the same rows."""

    def register(build: Callable[[Source], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return build

    return register
