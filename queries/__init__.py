"""Registered queries: each has a Spark form and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def registry() -> dict[str, Query]:
    from . import logistics, manifests, matrix, quality, stores, streams, structure

    merged: dict[str, Query] = {}
    for part in (
        logistics.QUERIES, manifests.QUERIES, matrix.QUERIES, structure.QUERIES, quality.QUERIES, streams.QUERIES, stores.QUERIES
    ):
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {clash}")
        merged.update(part)
    return merged
