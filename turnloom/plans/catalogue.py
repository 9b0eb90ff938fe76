"""All registered queries of the library proper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import basket_queries, case_queries, conversation_queries, document_queries, event_queries, frame_queries, function_queries, generation_queries, record_queries, reply_queries, source_queries, store_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES, Query


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__doc__, run.__name__ = query.__doc__, query.__name__
    return run


def queries() -> dict[str, Query]:
    return {name: _configured(q) for name, q in QUERIES.items()}


def oracle() -> dict[str, str]:
    return dict(ORACLE)
