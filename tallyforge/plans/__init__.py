"""All queries of the engine."""

from . import more, records, rendered, sources, statistics, streams, summaries, texts
from .registry import oracle_sql, queries

__all__ = ["more", "oracle_sql", "queries", "records", "rendered", "sources", "statistics", "streams", "summaries", "texts"]
