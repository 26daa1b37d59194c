"""All queries over the driver's tables, by name, with their SQL twins."""

from . import alignment_queries, mapping_queries, quality_queries, read_queries, record_queries, source_queries, spliced_queries

_MODULES = [read_queries, alignment_queries, mapping_queries, quality_queries, record_queries, source_queries, spliced_queries]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
