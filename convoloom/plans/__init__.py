"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

from . import conversations, judges, literal, records, synthesis  # noqa: E402

for _m in (judges, conversations, records, literal, synthesis):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
