"""Names of the queries, the plans they build and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framescope.plans import curation_queries, label_queries, metric_queries, reply_queries, report_queries, review_queries, rollup_queries, stream_queries, workflow_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (metric_queries, curation_queries, label_queries, reply_queries, report_queries, review_queries, rollup_queries, stream_queries, workflow_queries)
QUERIES: dict[str, Query] = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLES.items()}
