"""Scalar, array, JSON, date, text-search and vector functions with PostgreSQL's semantics."""


def load() -> None:
    """Fills the registry."""
    from . import arrays, conditionals, dates, jsonb, math, session, strings, text_search, vectors  # noqa: F401
