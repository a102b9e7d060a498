"""All queries of the library outside of ``llm``, and their SQL."""

from tidewright.plans import loading, registry

QUERIES = registry.QUERIES | loading.QUERIES
SQL = registry.SQL | loading.SQL
