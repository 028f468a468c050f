"""Every query of the engine by name, with its DuckDB counterpart."""

from . import event_queries, loader_queries, model_queries, parser_queries, price_queries, stat_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
