"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events_seats, indicators_market, screens_profile, sources_universe
from .fixtures import Views

_PARTS = (sources_universe, indicators_market, screens_profile, events_seats)


def _bound(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(build) for part in _PARTS for name, (build, _) in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.Q.items() if sql}
