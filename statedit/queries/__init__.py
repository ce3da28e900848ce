"""Every operator as a runnable query over the source tables."""


def load():
    """All queries and their SQL, by name."""
    from . import editing, selection, stored, totals  # noqa: F401
    from .registry import QUERIES, SQL

    return QUERIES, SQL
