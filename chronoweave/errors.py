"""Errors raised while a query is put together, before any job runs."""


class QueryError(TypeError):
    """A query that has no type or meaning."""
