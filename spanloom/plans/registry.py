"""Named queries over the test tables, each beside its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans.views import Views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects functions of the views; ``sql`` is what DuckDB runs on the same tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Views], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name!r} is registered twice")
        self.queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            self.oracles[name] = sql

    def query(self, sql: str | None = None):
        def register(build: Callable[[Views], DataFrame]):
            self.add(build.__name__, build, sql)
            return build

        return register


def load_all() -> Registry:
    from spanloom.plans import (
        construction, detection, ingestion, joins, parameters, scores, similar, storage, streams,
    )

    merged = Registry()
    for module in (joins, detection, construction, ingestion, scores, parameters, similar, storage,
                   streams):
        merged.queries.update(module.registry.queries)
        merged.oracles.update(module.registry.oracles)
    return merged
