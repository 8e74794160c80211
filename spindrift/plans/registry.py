"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["spindrift.plans.problems", *(f"spindrift.plans.q_{part}" for part in ("geometry", "psth", "trains", "activity", "spectra", "files"))]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(name)
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
